"""Collocations, the language model and ranked search against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loadstone.llm import collocations, pitman_yor, tree_search
from tests.llm.helpers import EDGE, WORD, documents, rows_of


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# collocations

RNG = random.Random(5)
VOCAB = ["the", "of", "Red", "tape", "new", "york", "city", "é", "漢", "a\x00b"]
PHRASED = [("  ".join(RNG.choices(VOCAB, [9, 7, 3, 3, 2, 2, 2, 1, 1, 1], k=40)) + RNG.choice([".", "", "\n"]) + " red tape, new york city! new\tyork  city", RNG.choice(["en", "fr", None, ""])) for _ in range(60)]
PHRASED += [(None, "en"), ("", "fr"), (" \t..;\n", None), ("new york city " * 400, "en")] + [("exact copy of one text", "fr")] * 12


def brute_collocations(rows, least, longest=5, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        lines = []
        for p, a in found.items():
            if any(len(q) > len(p) and counts[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in found):
                continue
            s, _, le, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            lines.append((s, a, " ".join(p), le, r))
        lines.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, le, r, n[lang], s) for i, (s, a, p, le, r) in enumerate(lines[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"bits": 16, "trie_phrases": 7, "pass_tries": 2, "step": 50}, {"bits": 15, "step": 3}])
def test_collocations(spark, sizes):
    df = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in PHRASED], "text string, lang string, a int, phrase string, n int").repartition(3)
    for least in (6, 25):
        got = collocations.mine(df, least=least, **sizes)
        assert rows_of(got, *got.columns) == brute_collocations(PHRASED, least)


def test_collocations_of_little(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty, least=2).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("a b", "x")], "text string, lang string"), least=2).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big - 7), ("en", "c", 5 * big)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "a b", big - 9)], "lang string, phrase string, a long")
    original = collocations.count_phrases
    collocations.count_phrases = lambda *a, **k: (words, phrases)
    try:
        (row,) = collocations.mine(words).collect()
    finally:
        collocations.count_phrases = original
    n = 7 * big - 7
    assert row["score"] == 1000 * (big - 9) * n // (big * (big - 7))


def test_double_array():
    rng = random.Random(3)
    phrases = sorted({tuple(rng.choices(range(1, 90), k=rng.randint(2, 5))) for _ in range(900)})
    flat = np.array([w for p in phrases for w in p], np.uint64)
    letters = collocations.alphabet(flat)
    trie = collocations.double_array(collocations.coded(letters, flat), np.array([len(p) for p in phrases]), np.arange(len(phrases)))
    text = [w for _ in range(400) for w in [*rng.choice(phrases), rng.randint(1, 95)]]
    pieces = np.arange(len(text)) // 23
    counts = collocations.advance(trie, collocations.coded(letters, np.array(text, np.uint64)), pieces, len(text))
    want = collections.Counter(tuple(text[i : i + k]) for k in range(2, 6) for i in range(len(text) - k + 1) if pieces[i] == pieces[i + k - 1])
    got = {int(trie.accepts[s]): int(counts[s]) for s in np.flatnonzero(trie.accepts >= 0)}
    assert got == {i: want[p] for i, p in enumerate(phrases)}


# language model


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]
        yield [*p, 1]


def test_seating_follows_the_exact_conditional():
    n, others, parent, d, strength = 6, 3, 0.2, 0.6, 1.5
    weight = collections.Counter()
    for p in partitions(n):
        w = parent ** len(p)
        for i, size in enumerate(p):
            w *= strength + d * (others + i)
            w *= math.prod(k - d for k in range(1, size))
        weight[len(p)] += w
    total = sum(weight.values())
    m = 40_000
    for exact in (64, 8):
        t = pitman_yor.seat(np.full(m, n), np.full(m, others), np.full(m, parent), d, strength, np.random.default_rng(1), exact)
        for k in range(1, n + 1):
            assert abs((t == k).mean() - weight[k] / total) < 0.012
    t = pitman_yor.seat(np.array([1, 200_000_000]), np.array([0, 50]), np.array([0.5, 1e-3]), d, strength, np.random.default_rng(2))
    assert t[0] == 1 and 1 <= t[1] < 200_000_000


def toks(text):
    return [*WORD.findall(lower(text)), None]


def corpus():
    rng = random.Random(11)
    rows = list(EDGE)
    rows += [(100 + i, " ".join(rng.choices(["alpha", "Beta", "gamma", "delta", "of", "the"], [5, 3, 2, 1, 9, 9], k=rng.randint(0, 40))) + f" only{i}") for i in range(60)]
    return rows


def learnt(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def test_language_model_against_its_seating(spark):
    """Scores worked out pair by pair from the same seating; probabilities of a context sum to 1."""
    rows = corpus()
    df = documents(spark, rows).repartition(3)
    model = pitman_yor.learn(df)
    assert model.buckets == 1 and model.vocabulary.rare == 0
    v = model.vocabulary
    find = pitman_yor.Finder(v)

    def value(token):
        return int(find(np.array([pitman_yor.END]) if token is None else pitman_yor._tokens(pa.array([token]))[0][:1])[0])

    start = int(find.start)
    count, pairs = collections.Counter(), collections.Counter()
    cache = {}
    for i, text in rows:
        t = toks(text)
        for w in t:
            cache.setdefault(w, None)
    cache = {w: value(w) for w in cache}
    for i, text in rows:
        if learnt(i):
            t = [cache[w] for w in toks(text)]
            count.update(t)
            pairs.update(zip([start, *t[:-1]], t))
    total = sum(count.values())
    keys = sorted(pairs)
    x = pitman_yor.Restaurants(v, np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64), np.array([pairs[k] for k in keys]))
    states = list(x.chain(model.parent, model.totals, model.discount, model.strength, 0, model.burn_in, len(model.states)))
    customers, tables = collections.Counter(), [collections.Counter() for _ in states]
    for (u, _), n in pairs.items():
        customers[u] += n
    for k, s in enumerate(states):
        for (u, _), t in zip(keys, s.tolist()):
            tables[k][u] += t
    at = {p: i for i, p in enumerate(keys)}

    def parent(k, w):
        return float(model.states[k].table[w]) if w < pitman_yor.RARE else model.unknown[k]

    def probability(u, w):
        out = []
        for k, s in enumerate(states):
            b = (model.strength + model.discount * tables[k][u]) / (model.strength + customers[u])
            a = (pairs[u, w] - model.discount * int(s[at[u, w]])) / (model.strength + customers[u]) if (u, w) in at else 0.0
            out.append(a + b * parent(k, w))
        return sum(out) / len(out)

    for u in [start, cache["alpha"], cache["the"], int(pitman_yor.RARE) | 12345]:
        assert abs(sum(probability(u, w) for w in [*count, int(pitman_yor.RARE) | 999]) - 1) < 1e-5
    want = []
    for i, text in rows:
        t = [cache[w] for w in toks(text)]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in t)
        s = sum(math.log10(probability(u, w)) for u, w in zip([start, *t[:-1]], t))
        want.append((i, not learnt(i), len(t), sum(count[w] > 0 for w in t), total, round(base, 6), s))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in pitman_yor.score(df, model).collect()]
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert np.allclose([x[6] for x in got], [x[6] for x in want], rtol=2e-4)  # unknown words: mean of products for the product of means


def test_language_model_of_small_tables(spark):
    """Many buckets and a small table of frequent words: same counts, close scores, and better than the base on texts not learnt from."""
    df = documents(spark, corpus()).repartition(2)
    whole = pitman_yor.score(df, pitman_yor.learn(df)).toPandas()
    cut = pitman_yor.score(df, pitman_yor.learn(df, frequent=20, bucket_tokens=900)).toPandas()
    key = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    whole, cut = (t.sort_values([*key, "score"], na_position="first").reset_index(drop=True) for t in (whole, cut))
    assert whole[key].equals(cut[key])
    assert np.allclose(whole["base_score"], cut["base_score"])
    assert abs(whole["score"].sum() / cut["score"].sum() - 1) < 0.03
    held = whole[whole["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_language_model_without_training(spark):
    df = documents(spark, [])
    assert pitman_yor.score(df, pitman_yor.learn(df)).count() == 0
    odd = next(i for i in itertools.count() if not learnt(i))
    df = documents(spark, [(odd, "a b"), (odd, None)])
    rows = pitman_yor.score(df, pitman_yor.learn(df)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(1, 0, 0), (3, 0, 0)]


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=10):
    found = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **sizes):
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    return tree_search.search(documents(spark, docs).repartition(3), asked, **sizes)


@pytest.mark.parametrize("sizes", [{}, {"shard": 7, "block": 2}, {"shard": 50, "block": 1, "block_terms": 12}])
def test_search(spark, sizes):
    rng = random.Random(8)
    terms = ["tax", "Law", "of", "é1", "z", "the", "漢字", "q7"]
    docs = [(i, t) for i, t in EDGE] + [(200 + i, " ".join(rng.choices(terms, [1, 2, 9, 1, 3, 9, 1, 2], k=rng.randint(0, 25)))) for i in range(150)] + [(900 + i, "the law of the tax") for i in range(40)]
    items = [(1, "The law, of tax!"), (2, None), (3, ""), (4, "nowhere"), (5, "w1x1 w4x2 the"), (6, "漢字 é1 q7 z Z z"), (7, " ".join(terms)), (7, " ".join(terms)), (None, "tax law")]
    got = searched(spark, docs, items, **sizes)
    assert rows_of(got, *got.columns) == brute_search(docs, items)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]).count() == 0
    assert searched(spark, [(1, "a b")], []).count() == 0
    assert searched(spark, [(1, "a b"), (2, None)], [(1, "...")]).count() == 0


def test_bounds_leave_documents_out(spark):
    """The walk scores few blocks: most are ruled out by their subtree's maxima."""
    rng = random.Random(4)
    n_docs = 4000
    vectors = [sorted(set(min(int(rng.expovariate(0.06)), 199) for _ in range(30))) for _ in range(n_docs)]
    for i in range(12):
        vectors[i * 300] = [0, 1, 2, 190, 191, 192, 193]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in vectors])])
    ranks = np.concatenate(vectors).astype(np.int64)
    s = tree_search.Shard(pa.array(range(n_docs)), None, np.full(n_docs, 100), offsets, ranks, np.ones(len(ranks), np.int32), 200)
    looked = []
    terms, weights = np.array([0, 1, 2, 190, 191, 192, 193]), np.array([1, 2, 3, 900, 900, 900, 900])
    whole = s.best(terms, weights, 1)
    best = sorted(((sum(int(w) * (1_000_000_000 // 1800) for t, w in zip(terms, weights) if t in v), -i) for i, v in enumerate(vectors)), reverse=True)[:10]
    assert sorted(((a, b) for a, b, _ in whole), reverse=True) == best
    gain = tree_search._gain
    tree_search._gain = lambda w, tf, m: (looked.append(np.ndim(tf)), gain(w, tf, m))[1]
    try:
        s.best(terms, weights, 1)
    finally:
        tree_search._gain = gain
    blocks = sum(1 for c in s.tree.children if not len(c))
    assert sum(k == 1 for k in looked) < blocks / 5


def test_candidates_of_many_small_files_share_tries():
    spans = [(f << 33, (f << 33) + 3) for f in range(5)]
    cuts = collocations._ranges(spans, 7)
    ids = [i for a, z in spans for i in range(a, z)]
    assert [sum(lo <= i < hi for i in ids) for lo, hi in cuts] == [7, 7, 1]
    assert collocations._ranges(spans, 3) == spans
    assert collocations._ranges([], 3) == []


def test_a_candidate_known_from_a_share_is_not_listed_again(spark, monkeypatch):
    made = []
    original = collocations._candidates
    monkeypatch.setattr(collocations, "_candidates", lambda *a: made.append(a[-1]) or original(*a))
    texts = spark.createDataFrame([(f"red fox {k}",) for k in range(200)] + [("blue fox",)] * 3, "text string").selectExpr("text as _text", "'en' as _lang")
    full = [np.full(1 << 10, 255, np.uint8)] * 3
    got = {r["phrase"] for r in collocations._listed(texts, full, 13, 3, 100).collect()}
    assert {"red fox", "blue fox", "fox 199", "red fox 7"} <= got and len(got) == 402
    assert len(made[0]) == 0 and 0 < len(made[1]) <= len(made[2]) < 402
    again = texts.mapInArrow(original(spark.sparkContext.broadcast(full), 13, 3, 100, made[2]), "lang string, phrase string, mark long").collect()
    assert not {r["mark"] for r in again} & set(made[2].view(np.int64).tolist())


def test_counting_has_no_more_tasks_for_more_files(spark, monkeypatch):
    plans = {}
    original = collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or original(df, name))
    df = spark.createDataFrame([(t, lang) for t, lang in PHRASED], "text string, lang string").repartition(40)
    collocations.count_phrases(df, least=6)
    tasks = max(collocations.COUNT_TASKS, spark.sparkContext.defaultParallelism)
    assert f"Coalesce {tasks}" in plans["phrase-counts"]
