"""Repeated bytes and words against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadstone.llm import fm_index, grams, repeats, suffix_array
from tests.llm.helpers import EDGE, covered, documents, rows_of, words


def bytes_wanted(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, gone in zip(rows, texts, covered(texts, length)):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def words_wanted(rows, length):
    lists = [words(t) for _, t in rows]
    return sorted(((i, len(w), sum(g), " ".join(x for x, k in zip(w, g) if not k)) for (i, _), w, g in zip(rows, lists, covered(lists, length))), key=repr)


def bytes_got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


def test_bytes_on_awkward_texts(spark):
    assert bytes_got(suffix_array.remove_repeats(documents(spark))) == bytes_wanted(EDGE, 200)


def test_words_on_awkward_texts(spark):
    assert rows_of(fm_index.remove_repeats(documents(spark)), "doc_id", "n_words", "n_removed", "kept") == words_wanted(EDGE, 35)


def random_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab ") for _ in range(60)) for _ in range(6)]
    return [(i, "".join(r.choice(base)[r.randrange(20) : 30 + r.randrange(30)] for _ in range(r.randrange(8)))) for i in range(60)]


@pytest.mark.parametrize("length", [12, 40])
def test_bytes_of_a_small_alphabet(spark, length):
    rows = random_rows(length)
    assert bytes_got(suffix_array.remove_repeats(documents(spark, rows), length)) == bytes_wanted(rows, length)


@pytest.mark.parametrize("length", [3, 9])
def test_words_of_a_small_alphabet(spark, length):
    rows = random_rows(100 + length)
    assert rows_of(fm_index.remove_repeats(documents(spark, rows), length), "doc_id", "n_words", "n_removed", "kept") == words_wanted(rows, length)


def test_empty_tables(spark):
    none = documents(spark, []).filter("false")
    assert suffix_array.remove_repeats(none).count() == 0
    assert fm_index.remove_repeats(none).count() == 0


def test_other_columns_stay(spark):
    out = suffix_array.without_repeats(documents(spark))
    assert out.columns == documents(spark).columns
    assert out.filter(F.col("runs") != "r").count() == 0


def test_shards_of_any_size_agree(spark, monkeypatch):
    """Whole anchors stay together however small a shard's share is."""
    monkeypatch.setattr(suffix_array, "SHARD_BYTES", 500)
    monkeypatch.setattr(fm_index, "SHARD_BYTES", 500)
    rows = random_rows(5)
    assert bytes_got(suffix_array.remove_repeats(documents(spark, rows), 20)) == bytes_wanted(rows, 20)
    assert rows_of(fm_index.remove_repeats(documents(spark, rows), 4), "doc_id", "n_words", "n_removed", "kept") == words_wanted(rows, 4)


def test_long_text_in_blocks(monkeypatch):
    """Blocks change how cells are cut, never which windows they hold."""
    rng = np.random.default_rng(1)
    raw, offsets = rng.integers(97, 101, 30_000).astype(np.uint8), np.array([0, 25_000, 25_000, 30_000])
    monkeypatch.setattr(grams, "BLOCK", 1000)
    monkeypatch.setattr(grams, "LONGEST_BLOCK", 4000)
    c = grams.cells(raw, offsets, 50, 16, grams.BYTE_VALUES)
    for d, n in ((0, 25_000), (2, 5_000)):
        starts = np.concatenate([np.arange(a, z + 1) for a, z in zip(c.first[c.doc == d], c.last[c.doc == d])])
        assert sorted(starts.tolist()) == list(range(n - 50 + 1))


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 120).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, k).astype(np.uint8), shared, rng.integers(97, 123, k).astype(np.uint8)]) for k in (37, 90))
    raw, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    c = grams.cells(raw, offsets, 60, 20, grams.BYTE_VALUES)
    anchor = {(d, s): f for f, d, lo, hi in zip(c.anchor, c.doc, c.first, c.last) for s in range(lo, hi + 1)}
    assert all(anchor[0, 37 + k] == anchor[1, 90 + k] for k in range(61))


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = fm_index.FMIndex(text, 5)
    for _ in range(50):
        at = rng.integers(0, 390)
        pattern = text[at : at + rng.integers(1, 6)]
        bounds = np.array([0, index.size])
        for c in pattern[::-1]:
            bounds = index.extend(np.array([c, c]), bounds)
        want = sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))
        assert bounds[1] - bounds[0] == want


def test_refinement_sorts_by_longer_prefixes():
    text = np.frombuffer(b"abcabcabdabcabcabe", np.uint8)
    starts, twice = suffix_array.equal_windows(text, np.array([0, 9]), np.array([9, 18]), 6)
    strings = [bytes(text[s : s + 6]) for s in starts]
    assert [strings.count(x) > 1 for x in strings] == twice.tolist()


def test_no_rows_for_unique_texts(spark):
    r = random.Random(8)
    docs = documents(spark, [(i, "".join(r.choice("abcdefgh ") for _ in range(500))) for i in range(20)])
    assert repeats.runs_by_row(repeats.repeated_runs(repeats.keyed(docs, "doc_id", "text"), suffix_array._cut(200), suffix_array._extract(200), suffix_array._index(200))).count() == 0


def test_hot_anchors_in_runs_agree(spark, monkeypatch):
    """Cutting the cells of an anchor with many contents changes no result."""
    monkeypatch.setattr(repeats, "HOT_CONTENTS", 1)
    passage = "the very same passage in many documents and then some more of it to be long enough for anything " * 3
    rows = [(i, f"{i * 7919} {passage[i % 5 : len(passage) - i % 7]} {i * 104729}") for i in range(40)] + random_rows(9)[:20]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert bytes_got(suffix_array.remove_repeats(documents(spark, rows), 120)) == bytes_wanted(rows, 120)
    assert rows_of(fm_index.remove_repeats(documents(spark, rows), 20), "doc_id", "n_words", "n_removed", "kept") == words_wanted(rows, 20)


@pytest.mark.parametrize("operator", [suffix_array, fm_index])
def test_shared_passage_leaves_no_large_key(spark, monkeypatch, operator):
    """A passage in many documents with other surroundings: no key of a shard has more pieces than a hot anchor may."""
    monkeypatch.setattr(repeats, "HOT_CONTENTS", 6)
    r = random.Random(11)
    noise = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(30))
    passage = " ".join(f"p{i * i % 89}q{i}" for i in range(40))
    rows = [(i, f"{noise()} {passage} {noise()}") for i in range(50)]
    length = 90 if operator is suffix_array else 24

    def sizes(batches):
        for b in batches:
            for v in b["anchor"].value_counts().to_pylist():
                yield pa.record_batch({"rid": pa.array([-1], pa.int64()), "first": pa.array([v["counts"]], pa.int64()), "last": pa.array([v["values"]], pa.int64())})

    docs = repeats.keyed(documents(spark, rows), "doc_id", "text")
    runs = repeats.repeated_runs(docs, operator._cut(length), operator._extract(length), sizes).filter("rid = -1")
    largest = runs.groupBy("last").agg(F.sum("first").alias("n")).agg(F.max("n")).first()[0]
    assert (largest or 0) <= 6
    got, want = (bytes_got, bytes_wanted) if operator is suffix_array else (lambda d: rows_of(d, "doc_id", "n_words", "n_removed", "kept"), words_wanted)
    assert got(operator.remove_repeats(documents(spark, rows), length)) == want(rows, length)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pieces_shuffle_only_the_texts_they_need(spark):
    docs = repeats.keyed(spark.createDataFrame([(k, f"text number {k}") for k in range(20)], "doc_id long, text string"), "doc_id", "text")
    rid = docs.limit(1).collect()[0].rid
    cells = spark.createDataFrame([(7, 8, rid, 0, 0, 0, 1)], "anchor long, content long, rid long, first long, last long, place int, copies long")
    found = repeats._pieces(docs, cells, suffix_array._extract(4))
    assert "Join LeftSemi" in plan(found)
    assert {r.rid for r in found.collect()} == {rid}


def test_cells_are_cut_in_little_memory():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 2000).astype(np.uint8).tobytes().decode() for _ in range(1500)]
    batch = pa.record_batch({"rid": pa.array(range(1500), pa.int64()), "text": texts})
    grams._powers(grams.BLOCK)
    tracemalloc.start()
    try:
        made = sum(b.num_rows for b in suffix_array._cut(200)([batch]))
        assert made > 1500 and tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_texts_are_cut_and_decoded_in_one_python_pass(spark):
    out = suffix_array.without_repeats(documents(spark), 4)
    optimized = plan(out).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "MapInArrow" in optimized
    assert optimized.index("Join LeftOuter") < optimized.index("MapInArrow", optimized.index("Join LeftOuter")) and optimized.split("Join LeftOuter")[0].count("MapInArrow") == 1
