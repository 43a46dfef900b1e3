"""Batch functions that work in blocks give what they give row by row."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from loadstone.llm import fm_index, jaccard, suffix_array, toxicity
from loadstone.llm.common import BLOCK_BYTES, blocks, mix, rows


def _texts(n=4_000, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    out = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(n)]
    out[3], out[4], out[7], out[n // 2] = None, "", " ".join(rng.choice(vocabulary, 300_000)), "é" * 4000
    return out


@pytest.fixture(scope="module")
def batch():
    texts = _texts()
    return pa.record_batch({"rid": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def _singly(b):
    return [b.slice(i, 1) for i in range(b.num_rows)]


def _sorted(batches):
    found = [x for x in batches if x.num_rows]
    t = pa.Table.from_batches(found)
    return t.sort_by([(c, "ascending") for c in t.schema.names])


def test_blocks_hold_all_rows_in_order(batch):
    parts = list(blocks(batch, "text", 4096, BLOCK_BYTES))
    assert len(parts) >= 3 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p["text"].to_pylist() if t) <= BLOCK_BYTES for p in parts)
    sizes = [x["n"][0].as_py() for x in rows(lambda p: pa.record_batch({"n": [p.num_rows]}), "text")(iter([batch]))]
    assert sum(sizes) == batch.num_rows
    assert list(rows(lambda p: p, "text")(iter([batch.slice(0, 0)]))) == []


def test_cells_of_blocks(batch):
    cut = suffix_array._cut(60)
    some = batch.slice(0, 300)
    assert _sorted(cut(iter([some]))).equals(_sorted(cut(iter(_singly(some)))))


def test_removal_of_blocks(batch):
    runs = [None if i % 3 else [{"first": 0, "last": 2}, {"first": 5, "last": 5}] for i in range(batch.num_rows)]
    texts = batch["text"].to_pylist()
    runs = [r if t and len(t.encode()) > 50 else None for r, t in zip(runs, texts)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    b = pa.record_batch({"_c0": batch["rid"], "_text": batch["text"], "runs": pa.array(runs, kind)}).slice(0, 300)
    remove = suffix_array._remove(10)
    whole, single = list(remove(iter([b]))), list(remove(iter(_singly(b))))
    assert pa.Table.from_batches(whole).combine_chunks().equals(pa.Table.from_batches(single).combine_chunks())
    want = [None if r is None else t.encode()[15:] for r, t in zip(runs[:300], texts)]
    got = pa.Table.from_batches(whole)["kept"].to_pylist()
    assert all(w is None or w == g for w, g in zip(want, got))


def _word_batches(batch):
    """Inputs of the three functions on words: texts, texts with wanted cells, texts with runs"""
    texts = batch["text"].to_pylist()
    long = [len((t or "").split()) >= 20 for t in texts]
    cell = {"anchor": 1, "content": 2, "first": 0, "last": 5, "place": 1, "copies": 1, "step": 0}
    wanted = pa.array([[cell] if y else [] for y in long], pa.list_(pa.struct([(k, pa.int32() if k in ("place", "step") else pa.int64()) for k in cell])))
    runs = pa.array([[{"first": 0, "last": 2}, {"first": 5, "last": 5}] if y and not i % 3 else None for i, y in enumerate(long)],
                    pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    return [(fm_index._cut(10), batch), (fm_index._extract(10), pa.record_batch({"rid": batch["rid"], "text": batch["text"], "wanted": wanted})),
            (fm_index._remove(10), pa.record_batch({"_c0": batch["rid"], "_text": batch["text"], "runs": runs}))]


def test_word_functions_of_blocks(batch):
    for run, b in _word_batches(batch):
        got = pa.Table.from_batches(list(run(iter([b])))).combine_chunks()
        assert got.equals(pa.Table.from_batches([x for x in run(iter(_singly(b))) if x.num_rows]).combine_chunks())


def test_word_functions_hold_a_block_at_a_time():
    """A batch of many blocks takes the memory of one: results are passed on, nothing grows with the rows of a batch."""
    text = " ".join(f"w{i * i % 9973}" for i in range(400))
    many = [(f"{i} {text}") for i in range(4_000)]
    batch = pa.record_batch({"rid": pa.array(range(len(many)), pa.int64()), "text": pa.array(many, pa.string())})
    for run, b in _word_batches(batch):
        tracemalloc.start()
        n = sum(x.num_rows for x in run(iter([b])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= len(many) and peak < 40 << 20


def test_background_counts_documents_once(batch):
    _, w = toxicity._tokens(batch["text"])
    wanted = np.unique(np.append(w.hash[:500], mix(np.array([99], np.uint64))))
    count = toxicity._background(wanted)

    def totals(batches):
        out = {}
        for x in count(iter(batches)):
            for f, n in zip(x["feature"].to_pylist(), x["n"].to_pylist()):
                out[f] = out.get(f, 0) + n
        return out

    got = totals([batch.slice(0, 1500), batch.slice(1500)])
    some = batch.slice(0, 200)
    assert totals([some]) == totals(_singly(some)) and got[None] == batch.num_rows
    words = [set((t or "").split()) for t in batch["text"].to_pylist()]
    names = {h: bytes(t.encode()).decode() for t in {x for s in words for x in s} if t.isascii() for h in [int(toxicity._tokens(pa.array([t]))[1].hash.view(np.int64)[0])]}
    assert all(n == sum(names[f] in s for s in words) for f, n in got.items() if f in names)


def test_findings_of_blocks(batch):
    _, w = toxicity._tokens(batch["text"])
    features = np.unique(w.hash[:40])
    raw, one = toxicity._tokens(batch["text"])
    short = np.unique(toxicity._head(raw, one, toxicity.PREFIXES[0]))
    model = toxicity.Model(features, np.linspace(1, 4, len(features)), short, 0.7, np.array([-1.0, 0.5, 0.5]))
    some = batch.slice(0, 2000)
    n, found = toxicity._findings(model, some["text"])
    parts = [toxicity._findings(model, p["text"]) for p in blocks(some, "text", 100, 1 << 16)]
    assert n.tolist() == [int(k) for m, _ in parts for k in m] and found == [f for _, g in parts for f in g]


def test_segments_of_a_long_line_take_linear_steps():
    """Far apart findings each begin lower than all before them; all stay segments of their own."""
    places = np.arange(200_000) * 10
    found = toxicity.segments(places, np.ones(len(places)), 0.5)
    assert found == [(p, p, 1.0) for p in places.tolist()]


def test_token_counts_hold_little_beside_the_table():
    """Sets of a task: block by block, and merged into the table of counts without a second copy of it per column."""
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 1 << 60, 600))) for _ in range(800)]
    one = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "key": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    tracemalloc.start()
    counted = pa.Table.from_batches(list(jaccard._sketch(5)(iter([one, one]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    marks = counted.filter(pa.compute.equal(counted["kind"], 1))
    assert marks.num_rows == 800 * 596 and set(marks["n"].to_pylist()) == {2}
    assert peak < 72 << 20


def test_a_set_is_posted_once_a_task():
    one = pa.record_batch({"text": pa.array(["a b c d e f g h", "a b c d e f g h", "i j k l m n"])})
    found = pa.Table.from_batches(list(jaccard._post(5, 75, 0, np.zeros(0, np.uint64))(iter([one, one]))))
    assert found.num_rows == 2 + 1
    assert found.schema.names == ["token", "node", "n"]
