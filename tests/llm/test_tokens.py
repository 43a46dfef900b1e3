"""Encoding, token files, packing and the relational lattice."""

import zlib

import numpy as np
import pytest

from loadstone.llm import lattice, packing, token_files, tokens
from loadstone.session import scratch_path
from tests.llm.helpers import EDGE, documents, rows_of

TOKENIZER = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["don't  we'll 'tis ?'s it's", "a\n\nb", "x<|endoftext|>y ok", "tab\there", "ÿ×é 12ab3 ab12.5,.'re\n", "", " lead", "trail ", "\nfoo", "a.'s b", "naïve—dash ’s", "a\0b", "\r\n x", "é" * 500, "a" * 3000]


def test_encoder_equals_the_library(library):
    e = tokens.Encoder(TOKENIZER)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(ODD)] == [library(x) for x in ODD]


def test_memo_may_be_dropped_any_time(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    e = tokens.Encoder(TOKENIZER)
    texts = [f"word{i} and more{i % 3} text" for i in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in e.encode([t])] == [library(x) for x in texts]


def test_runs_of_line_feeds_are_one_part(library):
    texts = ["a\n\n\nb", "\n\n\n1.", "x\n\n\n\n y", "a\n b", "a\n  b", "a\n\n", "a \nb", "a\u180e b", "\x1c a\u200b\n\nb", "漢 字\n\n\n漢"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(TOKENIZER).encode(texts)] == [library(x) for x in texts]


def test_a_group_of_texts_takes_one_call_of_the_model(library, monkeypatch):
    """Parts met for the first time are merged together, and each only once."""
    calls = []
    e = tokens.Encoder(TOKENIZER)
    merged = e._merged
    monkeypatch.setattr(e, "_merged", lambda parts: calls.append(sorted(parts)) or merged(parts))
    texts = ["alpha beta. alpha", " beta gamma\nalpha", "漢 alpha"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [library(x) for x in texts]
    assert calls == [[b"\n", b" alpha", b" beta", b" gamma", b".", b"alpha"]]


def test_token_files(spark, library):
    docs = documents(spark)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, TOKENIZER)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_index(spark, path).collect())
    at = 0
    ids = {}
    for d, t in EDGE:
        ids.setdefault(d, []).append(np.array(library(t) + [2], "<u4"))
    for start, d, n, crc in got:
        assert start == at
        assert any(len(x) == n and zlib.crc32(x.tobytes()) == crc for x in ids[d])
        at += n
    assert [d for _, d, _, _ in got] == sorted((d for d, _ in EDGE), key=lambda d: (d is not None, d or 0))
    one = token_files.read_tokens(spark, path).filter("doc_id = 5").select("ids").first()
    assert one.ids == library("one two three") + [2]


def test_no_documents_no_tokens(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, []), path, TOKENIZER)
    assert token_files.token_index(spark, path).count() == 0
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_packing(spark, library):
    pieces = packing.pack(documents(spark, EDGE + [(100 + i, f"short text {i} " * (i % 9)) for i in range(200)]).filter("doc_id <> 12"), TOKENIZER).collect()
    rows = {d: t for d, t in EDGE + [(100 + i, f"short text {i} " * (i % 9)) for i in range(200)] if d != 12 and d is not None}
    whole, sequences = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        whole.setdefault(p.doc_id, []).append((p.start, p.length, bytes(p.ids), p.doc_tokens))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, t in rows.items():
        parts = sorted(whole[d])
        ids = np.frombuffer(b"".join(x[2] for x in parts), "<u4").tolist()
        assert ids == library(t) + [1] and {x[3] for x in parts} == {len(ids)}
        assert [x[0] for x in parts] == [sum(y[1] for y in parts[:k]) for k in range(len(parts))]
    used = padding = 0
    for s in sequences.values():
        n = sum(x[1] for x in s)
        assert [x[0] for x in sorted(s)] == [sum(y[1] for y in sorted(s)[:k]) for k in range(len(s))] and n <= 2048
        used += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.02 * used


@pytest.mark.parametrize("n", [1, 63, 64, 65, 2047, 2048, 2049, 5000])
def test_cuts_and_classes(n):
    assert sum(packing.cuts(n)) == n and all(0 < c <= 2048 for c in packing.cuts(n))
    assert sum(packing.end_lengths(n)) == n and all(x & (x - 1) == 0 for x in packing.end_lengths(n))


def brute(v, text):
    scores = {p: (i, s) for p, i, s in v.pieces}
    line = lattice.SPACE + text.replace(" ", lattice.SPACE) if text else ""
    best = [(0.0, 0, [])]
    for e in range(1, len(line) + 1):
        options = []
        for s in range(max(0, e - v.longest), e):
            if line[s:e] in scores:
                options.append((best[s][0] + scores[line[s:e]][1], -s, [scores[line[s:e]][0]]))
            elif e - s == 1:
                options.append((best[s][0] + v.unknown_score, -s, [v.first_byte + b for b in line[s:e].encode()]))
        best.append(max(options, key=lambda o: o[:2]))
    out, e = [], len(line)
    while e:
        out = best[e][2] + out
        e = -best[e][1]
    return out


def test_lattice_is_the_best_path_and_decodes(spark):
    rows = [(i, t) for i, t in EDGE if i is not None and i not in (12, 14)] + [(50, "  a  b \n\n c"), (51, "漢字 ok ² x²y .com 12ab का"), (52, "x" * 300 + "1" * 20 + " é"), (53, " ")]
    docs = documents(spark, rows)
    model = lattice.default_model()
    v = lattice.vocabulary(model)
    encoded = lattice.encode(docs, model)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: brute(v, t or "") for i, t in rows}
    assert {r.doc_id: r.text for r in lattice.decode(encoded, model).collect()} == {i: t or "" for i, t in rows}
    sums = {r.doc_id: r for r in lattice.digests(docs, model).collect()}
    assert {i: r.n_pieces for i, r in sums.items()} == {i: len(x) for i, x in got.items()}
    assert sums[6].checksum == sums[7].checksum and sums[2].n_units == 0


def test_lattice_without_frequent_units(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 1)
    docs = documents(spark, [(1, "the other of the"), (2, "the"), (2, "the"), (3, None)])
    model = lattice.default_model()
    v = lattice.vocabulary(model)
    got = sorted((r.doc_id, r.n_pieces) for r in lattice.digests(docs, model).collect())
    assert got == [(1, len(brute(v, "the other of the"))), (2, len(brute(v, "the"))), (2, len(brute(v, "the"))), (3, 0)]
    assert lattice.encode(docs.filter("false"), model).count() == 0


def test_query_encodes_and_decodes_whole_texts(spark, tmp_path):
    """One row a document: its whole sequence of ids, and the text that they give back."""
    import hashlib

    from loadstone.llm.queries import QUERIES

    documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = rows_of(QUERIES["op2_sentencepiece_lattice"](spark, str(tmp_path)), "doc_id", "n_pieces", "ids_sha256", "text_sha256")
    ids = lattice.encode(documents(spark), lattice.default_model()).collect()
    by_id = sorted(((r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids)))) for r in ids), key=repr)
    assert [g[:3] for g in got] == by_id
    assert sorted(((g[0], g[3]) for g in got), key=repr) == sorted(((i, sha(t or "")) for i, t in EDGE), key=repr)


def test_encoding_and_decoding_move_no_row(spark):
    """Texts are encoded, and ids decoded, where they lie: nothing is shuffled, stored or grouped for a unit or an id."""
    docs = documents(spark)
    model = lattice.default_model()
    encoded = lattice.encode(docs, model)
    for df in (encoded, lattice.decode(encoded, model)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Generate", "Aggregate"))


def test_lattice_in_small_blocks():
    """Cuts into blocks, and units remembered from batch to batch, change no id; unknown and missing ids decode to nothing."""
    import pyarrow as pa
    import regex

    v = lattice.vocabulary(lattice.default_model())
    texts = ["the other of the", "", "漢字 ok ² x²y 😀 a", "x" * 700 + " " + "▁" * 20, "the the\n\n12ab", " "]
    cut = [regex.findall(lattice.UNIT, lattice.SPACE + t.replace(" ", lattice.SPACE)) if t else [] for t in texts]
    whole = pa.record_batch({"_c0": pa.array(range(len(texts)), pa.int64()), "_units": pa.array(cut, pa.list_(pa.string()))})
    want = [brute(v, t) for t in texts]
    old = lattice.BLOCK_ITEMS, lattice.PATHS
    try:
        for lattice.BLOCK_ITEMS, lattice.PATHS, most in ((1, 1, 0), (4, 2, 3), (1 << 18, 1 << 15, 1 << 16)):
            got = pa.Table.from_batches(list(lattice._encode(v, most)(iter([whole.slice(0, 3), whole.slice(3), whole.slice(0, 0), whole]))))
            assert got["ids"].to_pylist() == want + want
            shown = pa.Table.from_batches(list(lattice._shown(v)(iter([pa.record_batch({"_c0": whole["_c0"], "_ids": pa.array(want, pa.list_(pa.int32()))})]))))
            assert [s.decode().replace(lattice.SPACE, " ")[1:] for s in shown["shown"].to_pylist()] == [t.replace(lattice.SPACE, " ") for t in texts]
    finally:
        lattice.BLOCK_ITEMS, lattice.PATHS = old
    odd = pa.record_batch({"_c0": [1], "_ids": pa.array([[want[0][0], None, -5, 10**9, 0, *want[0][1:]]], pa.list_(pa.int32()))})
    assert next(lattice._shown(v)(iter([odd])))["shown"][0].as_py().decode() == lattice.SPACE + texts[0].replace(" ", lattice.SPACE)


def test_a_long_unit_takes_linear_time():
    import time

    path = lattice._best_path(lattice.vocabulary(lattice.default_model()))
    began = time.process_time()
    assert len(path("z" * 100_000)) > 10_000 and time.process_time() - began < 20
