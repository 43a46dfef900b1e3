"""Near duplicates against all pairs, and neighbours against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadstone.llm import components, jaccard, neighbours
from tests.llm.helpers import EDGE, documents, shingles


def components_wanted(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_awkward_texts(spark):
    assert got(jaccard.near_duplicates(documents(spark))) == components_wanted(EDGE)


def family(seed, n, size=120):
    """Near copies in chains: each text changes a few words of an earlier one."""
    r = random.Random(seed)
    texts = [[f"{seed}x{r.randrange(10**6)}" for _ in range(size)]]
    for _ in range(n - 1):
        t = list(r.choice(texts))
        for _ in range(r.randrange(1, 6)):
            t[r.randrange(len(t))] = f"y{r.randrange(10**6)}"
        texts.append(t[: size - r.randrange(12)])
    return [" ".join(t) for t in texts]


def test_chains_of_near_copies(spark):
    common = " ".join(f"licence{i}" for i in range(25))
    texts = [t for k in range(6) for t in family(k, 12)] + [f"{common} {' '.join(f'own{i}q{j}' for j in range(30))}" for i in range(40)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    want = components_wanted(rows)
    assert 10 < len({c for _, _, c in want}) < len(rows)
    assert got(jaccard.near_duplicates(documents(spark, rows))) == want


def test_frequent_tokens_and_small_hubs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "HUB_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "COUNTED", 50)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard, "JOINED_LIST", 3)
    monkeypatch.setattr(jaccard, "MATRIX_ROWS", 4)
    rows = [(i, t) for i, t in enumerate(t for k in range(3) for t in family(20 + k, 10))]
    assert got(jaccard.near_duplicates(documents(spark, rows), orders=3)) == components_wanted(rows)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    component = {(d, c) for d, _, c in components_wanted(EDGE)}
    assert sorted(i for i in ids if i is not None) == sorted({c for d, c in component if d is not None and d == c})


def test_prefixes_hold_the_shared_tokens():
    """Linked sets share as many prefix tokens as the bound says, under any order."""
    r = random.Random(4)
    for _ in range(200):
        a = r.randrange(1, 60)
        shared = set(range(r.randrange(max(1, int(0.75 * a)), a + 1)))
        one, two = shared | {1000 + i for i in range(a - len(shared))}, shared | {2000 + i for i in range(r.randrange(0, 8))}
        if 100 * len(one & two) < 75 * len(one | two):
            continue
        order = {t: r.random() for t in one | two}
        pre = [set(sorted(s, key=order.get)[: int(jaccard.prefix_length(np.array([len(s)]), 75)[0])]) for s in (one, two)]
        need = -(-75 * (len(one) + len(two)) // 175) - (-(-75 * max(len(one), len(two)) // 100) - 1)
        assert len(pre[0] & pre[1]) >= max(1, need)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6)) for i in range(1, 60)] + [(60 + i, [1, 2, 3, 4, 5, 6]) for i in range(30)]
    rows += [(200, None), (201, [0] * 6), (202, [1, None, 0, 0, 0, 0]), (203, [float("nan")] * 6), (204, [float("inf")] + [1] * 5), (205, [1, 2]), (60, [1, 2, 3, 4, 5, 6])]
    df = vectors(spark, rows)
    out = neighbours.search(df, df.filter("vec_id % 20 = 0")).collect()
    good = sorted({i: np.array(v, np.float32).astype(float) for i, v in rows if i < 200}.items())
    for q in (20, 40, 60, 80):
        mine = [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q]
        want = sorted(((-float((v * dict(good)[q]).sum()), i) for i, v in good if i != q))[:20]
        assert [m[1] for m in mine] == [i for _, i in want] and [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in want])
    assert {r.query_id for r in out} == {20, 40, 60, 80}


def test_recall_and_few_vectors(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    monkeypatch.setattr(neighbours, "RERANK_LEAST", 150)
    out = neighbours.search(df, df.filter("vec_id % 20 = 0")).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    hits = total = 0
    for q in {r.query_id for r in out}:
        want = sorted((-float(v @ x[q]), i) for i, v in x.items() if i != q)[:20]
        hits += len({i for _, i in want} & {r.vec_id for r in out if r.query_id == q})
        total += len(want)
    assert hits >= 0.9 * total
    assert neighbours.search(df.limit(3), df.limit(3)).groupBy("query_id").count().agg(F.max("count")).first()[0] == 2
    assert neighbours.search(df.filter("false"), df).count() == 0


def test_texts_move_only_for_pairs_that_may_link(spark, monkeypatch):
    """Texts that share a passage and little else meet in posting lists, but none of them is compared."""
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    seen, linked = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *a, **k: seen.append(pairs.count()) or linked(pairs, *a, **k))
    common = " ".join(f"licence{i}" for i in range(25))
    rows = [(i, f"{common} {' '.join(f'own{i}q{j}' for j in range(30))}") for i in range(40)]
    assert got(jaccard.near_duplicates(documents(spark, rows))) == components_wanted(rows)
    assert seen == [0, 0]


def test_signatures_never_part_linked_sets():
    r = random.Random(9)
    for _ in range(150):
        n = r.choice([1, 4, 30, 63, 64, 65, 128, 130, 700])
        one = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        two = list(one)
        for _ in range(r.randrange(0, 2 + n // 40)):
            two[r.randrange(len(two))] = f"y{r.randrange(10**6)}"
        two = two[: max(5, len(two) - r.randrange(0, 1 + n // 6))]
        sets = jaccard.Sets(pa.array([" ".join(one), " ".join(two)]), 5)
        a, b = (sets.tokens[x:z] for x, z in zip(sets.ends[:-1], sets.ends[1:]))
        signs = jaccard.signatures(sets).to_pylist()
        unshared = len(np.setxor1d(a, b))
        assert jaccard._unlike_places(*signs) <= unshared
        batch = pa.record_batch({"hub": [1], "node": [2], "hub_n": [len(a)], "node_n": [len(b)], "hub_sign": pa.array(signs[:1], pa.binary()), "node_sign": pa.array(signs[1:], pa.binary())})
        passed = sum(x.num_rows for x in jaccard._alike(75)(iter([batch])))
        shared = len(np.intersect1d(a, b))
        assert passed or 100 * shared < 75 * (len(a) + len(b) - shared)
