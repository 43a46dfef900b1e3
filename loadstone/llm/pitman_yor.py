"""Hierarchical Pitman-Yor language model: word pairs, seated by Gibbs sampling.

Every word is the context of a restaurant whose customers are the words that follow it in the training
texts; all restaurants share one parent, the restaurant of single words, whose customers are the children's tables and whose
own parent is uniform over the words and one unknown word. A seating is kept as the number
of tables of every (context, word). Given the parent and the tables of the other words of its
restaurant, that number is drawn from its exact conditional (generalised Stirling numbers) up to ``EXACT``
customers; of more, the first ``EXACT`` are seated so and the others binomially, in blocks of a sixteenth of those who sit.
All pairs of a restaurant are drawn at once against the last sweep's tables, and the
parent is brought up to date between rounds, as distributed Gibbs samplers do.

Rounds: the counts of all pairs are dealt into buckets by context (and, for contexts of the ``FREQUENT`` table,
by word too, so no context is a hot group) and stored, one row a bucket. Round 1 seats under relative
frequencies, its tables give the first parent. Round 2 seats under it; each of its ``SAMPLES`` last sweeps is one seating state: tables
per word for a parent of that state, tables per context. Scoring deals all tokens out in the same way, repeats
round 2 of the bucket (same seed, same counts) and averages the predictive probabilities over the states.

The ``FREQUENT`` words (about, never more) travel to all tasks; other words meet their parent, averaged over the states, in a join, and in seating count as their mean. Discounts
come from the pairs (words) seen once and twice. What is learnt grows with the training texts; nothing is sampled from them.

Defined cases: a null or empty text is one end token; a null id counts as the empty string in the choice of training rows; repeated rows count
each time and score alike; without training rows every probability is the uniform one; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.llm import grams
from loadstone.llm.common import blocks, flat_bytes, mix, stored

FREQUENT = 1 << 18
BUCKET_TOKENS = 1 << 20
HELD_TOKENS = 3 << 19
BLOCK_BYTES = 4 << 20
SLICE = 1 << 14
EXACT = 64
BURN_IN = 2
SAMPLES = 3
STRENGTHS = (1.0, 1.0)  # of the parent and of the contexts
END, START = np.uint64(2), np.uint64(1)  # fingerprints of the two marks
RARE = np.uint64(1 << 63)  # set in the value of a word outside the table; words of the table are their place in it


def learns(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 != 1


class Vocabulary(NamedTuple):
    marks: np.ndarray  # sorted fingerprints of the frequent words and START
    value: np.ndarray  # their places: 0 is the most frequent
    count: np.ndarray  # training tokens by place, as words and as contexts alike (START is only, END never a context)
    tokens: int  # N
    words: int  # V
    rare: int  # words outside the table

    @property
    def rare_count(self) -> float:
        return max(self.tokens + int(self.count[self.value[self.marks == START]].sum()) - int(self.count.sum()), 0) / max(self.rare, 1)


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, and the offsets of the texts."""
    offsets, raw = flat_bytes(col)
    w = grams.words(raw, offsets, lower=True)
    return np.insert(w.hash, w.offsets[1:], END), w.offsets + np.arange(len(w.offsets))


class Finder:
    """Values of fingerprints: the place of a frequent word, else the fingerprint itself, marked. One look into a slot table mostly."""

    BITS = 21

    def __init__(self, v: Vocabulary):
        self.marks, self.value = v.marks, v.value
        self.slot = np.zeros(1 << self.BITS, np.int32)
        self.slot[self._at(v.marks)] = np.arange(len(v.marks))
        self.start = np.uint64(self(np.array([START]))[0])

    def _at(self, marks: np.ndarray) -> np.ndarray:
        return (marks >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, marks: np.ndarray) -> np.ndarray:
        at = self.slot[self._at(marks)]
        hit = self.marks[at] == marks
        out = np.where(hit, self.value[at].astype(np.uint64), marks | RARE)
        rest = np.flatnonzero(~hit)
        at = np.minimum(np.searchsorted(self.marks, marks[rest]), len(self.marks) - 1)
        same = self.marks[at] == marks[rest]
        out[rest[same]] = self.value[at[same]].astype(np.uint64)
        return out

    def pairs(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of all tokens and of the tokens before them, and the offsets of the texts."""
        marks, offsets = _tokens(col)
        word = self(marks)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[offsets[:-1]] = self.start
        return word, before, offsets


def _pack(a: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers byte plane by byte plane, compressed: small numbers cost little. ``rising``: as differences, small of either sign."""
    a = a.astype("<u8")
    if rising and len(a):
        step = np.diff(a, prepend=np.uint64(0)).view(np.int64)
        a = ((step << 1) ^ (step >> 63)).view("<u8")
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpack(b: bytes, n: int, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(b, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    a = np.ascontiguousarray(planes.T).view("<u8").ravel()
    if rising:
        a = np.cumsum((a >> np.uint64(1)) ^ (np.uint64(0) - (a & np.uint64(1))), dtype=np.uint64)
    return a


def _bucket(v: Vocabulary, before: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Context's bucket; pairs of a context in the table are dealt by word, too."""
    spread = np.where(before < RARE, mix(word + np.uint64(0x9E37)), np.uint64(0))
    return (mix(before * grams.ODD ^ spread) % np.uint64(n)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens by fingerprint (null: tokens of all texts; START: training texts)."""
    for batch in batches:
        for b in blocks(batch, "_text", 8192, BLOCK_BYTES):
            word, offsets = _tokens(b["_text"])
            learnt = b["_learns"].to_numpy(zero_copy_only=False)
            mark, n = np.unique(word[np.repeat(learnt, np.diff(offsets))], return_counts=True)
            marks = pa.concat_arrays([pa.array(mark.view(np.int64)), pa.array([int(START), None], pa.int64())])
            yield pa.record_batch({"mark": marks, "n": np.append(n, [int(learnt.sum()), len(word)]).astype(np.int64)})


def _sorted_pairs(before: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of ``n``."""
    order = np.lexsort((word, before))
    before, word, n = before[order], word[order], n[order]
    new = np.ones(len(before), bool)
    new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    return before[new], word[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def _cut(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _packed_pairs(before: np.ndarray, word: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    return {"size": pa.array([len(n)], pa.int64()), "before": pa.array([_pack(before, True)], pa.binary()), "word": pa.array([_pack(word, True)], pa.binary()), "n": pa.array([_pack(n)], pa.binary())}


def _unpacked_pairs(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(r["before"], r["size"], True), _unpack(r["word"], r["size"], True), _unpack(r["n"], r["size"]).astype(np.int64)


def _pairs(v: Vocabulary, n_buckets: int):
    """Pairs of the training texts of a task, counted ``HELD_TOKENS`` at a time: one row a bucket."""

    def run(batches):
        find = Finder(v)
        held, size = [], 0

        def out():
            before, word = (np.concatenate(x) for x in zip(*held))
            order, cut = _cut(_bucket(v, before, word, n_buckets), n_buckets)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[k] : cut[k + 1]]
                yield pa.record_batch({"bucket": pa.array([k], pa.int32())} | _packed_pairs(*_sorted_pairs(before[at], word[at], np.ones(len(at), np.int64))))

        for batch in batches:
            for b in blocks(batch, "_text", 8192, BLOCK_BYTES):
                word, before, _ = find.pairs(b["_text"])
                held.append((before, word))
                size += len(word)
                if size > HELD_TOKENS:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


def _merge_pairs(t: pa.Table) -> pa.Table:
    """All pairs of a bucket, in order."""
    before, word, n = _sorted_pairs(*[np.concatenate(x) for x in zip(*[_unpacked_pairs(r) for r in t.to_pylist()])])
    seen = {"once": pa.array([int((n == 1).sum())], pa.int64()), "twice": pa.array([int((n == 2).sum())], pa.int64())}
    return pa.table({"bucket": t["bucket"][:1]} | _packed_pairs(before, word, n) | seen)


@functools.cache
def _log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, out[c, t] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def seat(n: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """Numbers of tables drawn for pairs of ``n`` customers, ``others`` the tables of the restaurant's other words."""
    tables = np.minimum(n, 1)
    log_s = _log_stirling(round(discount, 6), exact)
    log_parent = np.log(parent)
    first = np.minimum(n, exact)
    order = np.argsort(first, kind="stable")
    edges = np.searchsorted(first[order], np.arange(2, exact + 2))
    for c in range(2, exact + 1):
        at = order[edges[c - 2] : edges[c - 1]]
        if len(at):
            t = np.arange(c)
            opens = np.cumsum(np.log(np.maximum(strength + discount * (others[at][:, None] + t), 1e-300)), 1)
            logits = log_s[c, 1 : c + 1] + opens + (t + 1) * log_parent[at][:, None]
            tables[at] = 1 + np.argmax(logits + rng.gumbel(size=logits.shape), 1)
    at = np.flatnonzero(n > exact)
    sat = np.full(len(at), exact, np.int64)
    while len(at):
        block = np.minimum(np.maximum(sat // 16, 1), n[at] - sat)
        opens = (strength + discount * (others[at] + tables[at])) * parent[at]
        tables[at] += rng.binomial(block, opens / (opens + sat - discount * tables[at]))
        sat = sat + block
        more = sat < n[at]
        at, sat = at[more], sat[more]
    return tables


class Restaurants:
    """The pairs of a bucket, in order, and the restaurants of their contexts."""

    def __init__(self, v: Vocabulary, before: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.before, self.word, self.n = before, word, n.astype(np.int64)
        self.cut = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.cut)), np.diff(np.append(self.cut, len(before))))
        self.context = before[self.cut]
        self.wide = self.context < RARE  # spread over buckets
        here = np.add.reduceat(self.n, self.cut) if len(self.cut) else self.n
        self.customers = here.copy()
        self.customers[self.wide] = v.count[self.context[self.wide].astype(np.int64)]
        self.part = here / np.maximum(self.customers, 1)

    def chain(self, parent: Parent, totals: np.ndarray | None, discount: float, strength: float, seed: int, burn_in: int, samples: int) -> Iterator[np.ndarray]:
        """Tables of every pair in the last ``samples`` sweeps. ``totals``: tables of the wide contexts; None: judged from this bucket."""
        rng = np.random.default_rng(seed)
        many = np.flatnonzero(self.n > 1)  # the others have one customer and one table
        owner, n, share = self.owner[many], self.n[many], _of_words(parent, self.word[many])
        single = np.bincount(self.owner[self.n == 1], minlength=len(self.cut))
        drawn = np.ones(len(many), np.int64)
        for sweep in range(burn_in + samples):
            whole = single + np.bincount(owner, drawn, len(self.cut))
            if totals is None:
                whole /= np.maximum(self.part, 1e-12)
            else:
                whole[self.wide] = totals[self.context[self.wide].astype(np.int64)]
            drawn = seat(n, np.maximum(whole[owner] - drawn, 0), share, discount, strength, rng)
            if sweep >= burn_in:
                tables = np.ones(len(self.n), np.int64)
                tables[many] = drawn
                yield tables


class Parent(NamedTuple):
    """Predictive probabilities of the single-word restaurant."""

    table: np.ndarray  # by place in the vocabulary
    rare: float  # mean of the training words outside it


def _of_words(p: Parent, word: np.ndarray) -> np.ndarray:
    known = word < RARE
    return np.where(known, p.table[np.where(known, word, 0).astype(np.int64)].astype(float), p.rare)


def _tables(v: Vocabulary, p: Parent, totals: np.ndarray | None, discount: float, strength: float, burn_in: int, samples: int, apart: bool):
    """Tables by word (kind 0) and by wide context (kind 1), state by state: of the vocabulary in slices of ``SLICE`` places,
    summed over the buckets of a task; of other words one by one (``apart``) or all together (value null)."""

    def run(batches):
        size = -(-len(v.count) // SLICE) * SLICE
        sums = np.zeros((2, samples, size), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                x = Restaurants(v, *_unpacked_pairs(r))
                home = x.word < RARE
                place, context = x.word[home].astype(np.int64), x.context[x.wide].astype(np.int64)
                away, back = np.unique(x.word[~home], return_inverse=True)
                by_word = {}
                for k, t in enumerate(x.chain(p, totals, discount, strength, r["bucket"], burn_in, samples)):
                    sums[0, k] += np.bincount(place, t[home], size).astype(np.int64)
                    sums[1, k, context] += np.bincount(x.owner, t, len(x.cut)).astype(np.int64)[x.wide]
                    by_word[f"t{k}"] = np.bincount(back, t[~home], len(away)).astype(np.int64)
                if len(away) and not apart:
                    away, by_word = np.zeros(1, np.int64), {c: t.sum(keepdims=True) for c, t in by_word.items()}
                if len(away):
                    yield pa.record_batch({"slice": pa.nulls(len(away), pa.int32()), "packed": pa.nulls(len(away), pa.binary()), "value": pa.array(away.view(np.int64)) if apart else pa.nulls(1, pa.int64())} | by_word)
        for kind in (0, 1):
            for k in range(size // SLICE):
                part = sums[kind, :, k * SLICE : (k + 1) * SLICE]
                if part.any():
                    yield pa.record_batch({"slice": pa.array([2 * k + kind], pa.int32()), "packed": pa.array([_pack(part.ravel())], pa.binary()), "value": pa.nulls(1, pa.int64())} | {f"t{j}": pa.nulls(1, pa.int64()) for j in range(samples)})

    return run


def _seated_slice(samples: int, words: int, discount: float, strength: float):
    """Sums of a slice; for words, the tables of the single-word restaurant, too."""

    def run(t: pa.Table) -> pa.Table:
        total = sum(_unpack(x, samples * SLICE).astype(np.int64) for x in t["packed"].to_pylist()).reshape(samples, SLICE)
        at = t["slice"][0].as_py()
        tables = total.copy()
        if at % 2 == 0:
            for k in range(samples):
                tables[k] = _seat_root(total[k], words, discount, strength, [k, at])
        return pa.table({"slice": t["slice"][:1], "packed": pa.array([_pack(np.concatenate([total.ravel(), tables.ravel()]))], pa.binary())})

    return run


def _seat_root(n: np.ndarray, words: int, discount: float, strength: float, seed: list[int]) -> np.ndarray:
    return seat(n, np.full(len(n), words - 1), np.full(len(n), 1 / (words + 1)), discount, strength, np.random.default_rng(seed))


def _discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


def _seat_words(samples: int, words: int, discount: float, strength: float):
    """Seats the customers of the single-word restaurant that are outside the vocabulary: its tables, state by state."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = {"value": b["value"]}
                for k in range(samples):
                    out |= {f"t{k}": b[f"t{k}"], f"s{k}": _seat_root(b[f"t{k}"].to_numpy(), words, discount, strength, [k, b.num_rows, b["value"][0].as_py() & 0xFFFFFFFF])}
                yield pa.record_batch(out)

    return run


class Model(NamedTuple):
    vocabulary: Vocabulary
    buckets: int
    parent: Parent  # of the seating
    totals: np.ndarray | None  # tables of the table's contexts in the seating
    states: list[Parent]
    state_totals: list[np.ndarray]
    unknown: list[float]  # probability of a word never seen, state by state
    discount: float
    strength: float
    burn_in: int
    words: DataFrame | None  # value, n (training tokens), p (probability, mean of the states): words outside the table


def _gather(seated: DataFrame, v: Vocabulary, samples: int, discount: float, strength: float, words: DataFrame, apart: bool):
    """Parents, totals and unknown words' probabilities of each state, and the words outside the vocabulary.

    Where those were not seated ``apart``, they are taken to have a table each, and none comes back.
    """
    columns = [f"t{k}" for k in range(samples)]
    seated = stored(seated, "seated")
    sliced = seated.filter("slice IS NOT NULL").select("slice", "packed").groupBy("slice").applyInArrow(_seated_slice(samples, v.words, discount, strength), "slice int, packed binary")
    size = -(-len(v.count) // SLICE) * SLICE
    t, s = np.zeros((2, samples, size), np.int64), np.zeros((2, samples, size), np.int64)
    for r in sliced.collect():  # the vocabulary, at most FREQUENT places
        both = _unpack(r["packed"], 2 * samples * SLICE).astype(np.int64).reshape(2, samples, SLICE)
        at = r["slice"] // 2 * SLICE
        t[r["slice"] % 2, :, at : at + SLICE], s[r["slice"] % 2, :, at : at + SLICE] = both
    t, s = t[:, :, : len(v.count)], s[:, :, : len(v.count)]
    rare, sums = None, None
    if v.rare and not apart:
        sums = {f"t{k}": t_ or 0 for k, t_ in enumerate(seated.filter("slice IS NULL").agg(*[F.sum(c) for c in columns]).first())}
        sums |= {f"s{k}": min(sums[f"t{k}"], v.rare) for k in range(samples)}
    elif v.rare:
        summed = seated.filter("slice IS NULL").groupBy("value").agg(*[F.sum(c).alias(c) for c in columns])
        rare = stored(summed.mapInArrow(_seat_words(samples, v.words, discount, strength), "value long, " + ", ".join(f"t{k} long, s{k} long" for k in range(samples))), "tables")
        sums = rare.agg(*[F.sum(c).alias(c) for k in range(samples) for c in (f"t{k}", f"s{k}")]).first()
    parents, unknown, rare_columns = [], [], []
    for k in range(samples):
        customers, tables = int(t[0, k].sum()) + ((sums[f"t{k}"] or 0) if sums else 0), int(s[0, k].sum()) + ((sums[f"s{k}"] or 0) if sums else 0)
        base = (strength + discount * tables) / (strength + customers) / (v.words + 1)
        left = (((sums[f"t{k}"] or 0) - discount * (sums[f"s{k}"] or 0)) / (strength + customers) / v.rare if sums else 0.0) + base
        parents.append(Parent((base + (t[0, k] - discount * s[0, k]) / (strength + customers)).astype(np.float32), left))
        unknown.append(base)
        rare_columns.append(((F.col(f"t{k}") - discount * F.col(f"s{k}")) / F.lit(float(strength + customers)) + F.lit(base)))
    if rare is not None:
        rare = words.join(rare.select("value", (sum(rare_columns[1:], rare_columns[0]) / samples).alias("p")), "value")
    return parents, list(t[1].astype(np.float32)), unknown, rare


def _vocabulary(counts: DataFrame, frequent: int) -> Vocabulary:
    """The words of greatest count, by a threshold from a small histogram so that they are at most ``frequent`` (the marks besides)."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    marks = F.col("mark").isin(int(END), int(START))
    hist = counts.filter("mark IS NOT NULL").groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()  # 64 rows to a doubling
    room, least = frequent, None
    for h in hist:
        if h["k"] > room:
            break
        room, least = room - h["k"], h["level"]
    chosen = counts.filter("mark IS NOT NULL").filter(marks | (level >= least) if least is not None else marks).select("mark", "n").toArrow()
    mark, n = chosen["mark"].to_numpy().view(np.uint64), chosen["n"].to_numpy()
    order = np.lexsort((mark, -n))
    mark, n = mark[order], n[order]
    sums = counts.filter(F.col("mark").isNotNull() & (F.col("mark") != int(START))).agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    by_mark = np.argsort(mark)
    return Vocabulary(mark[by_mark], by_mark.astype(np.int32), n, sums["n"] or 0, sums["v"], sums["v"] - int((mark != START).sum()))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, bucket_tokens: int = BUCKET_TOKENS,
          burn_in: int = BURN_IN, samples: int = SAMPLES, strengths: tuple[float, float] = STRENGTHS) -> Model:
    """Fit on the rows ``learns`` chooses."""
    texts = docs.select(F.col(f"`{text_col}`").alias("_text"), learns(id_col).alias("_learns"))
    counts = stored(texts.mapInArrow(_word_counts, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).filter("n > 0"), "word-counts")
    total = counts.filter("mark IS NULL").agg(F.sum("n")).first()[0] or 0
    v = _vocabulary(counts, frequent)
    buckets = max(1, math.ceil(total / bucket_tokens))
    if not v.tokens:
        flat = Parent(np.full(max(len(v.count), 1), 1.0), 1.0)
        return Model(v, buckets, flat, None, [], [], [], 0.5, strengths[1], burn_in, None)
    packed = "bucket int, size long, before binary, word binary, n binary"
    pairs = texts.filter("_learns").mapInArrow(_pairs(v, buckets), packed)
    kinds = packed + ", once long, twice long"
    held = stored(pairs.groupBy("bucket").applyInArrow(_merge_pairs, kinds), "pairs")
    seen = held.agg(F.sum("once"), F.sum("twice")).first()
    discount = _discount(*seen)
    singles = counts.filter(F.col("mark").isNotNull() & (F.col("mark") != int(START)))
    known = np.sort(v.marks)
    words = singles.select((F.col("mark").bitwiseOR(F.lit(-(1 << 63)).cast("long"))).alias("value"), "n", "mark")
    if v.rare:
        def outside(batches):
            for b in batches:
                m = b["mark"].to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(known, m), len(known) - 1)
                yield b.filter(pa.array(known[at] != m)).select(["value", "n"])

        words = words.mapInArrow(outside, "value long, n long")
    flat = Parent(((v.count + 0.5) / (v.tokens + 0.5 * (v.words + 1))).astype(np.float32), (v.rare_count + 0.5) / (v.tokens + 0.5 * (v.words + 1)))
    root = _discount(*[r or 0 for r in singles.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()])
    schema = "slice int, packed binary, value long, "
    first = held.mapInArrow(_tables(v, flat, None, discount, strengths[1], burn_in, 1, False), schema + "t0 long")
    parents, totals, _, _ = _gather(first, v, 1, root, strengths[0], words, False)
    second = held.mapInArrow(_tables(v, parents[0], totals[0], discount, strengths[1], burn_in, samples, True), schema + ", ".join(f"t{k} long" for k in range(samples)))
    states, state_totals, unknown, rare = _gather(second, v, samples, root, strengths[0], words, True)
    return Model(v, buckets, parents[0], totals[0], states, state_totals, unknown, discount, strengths[1], burn_in, rare)


def _dealt(v: Vocabulary, buckets: int):
    """All tokens of all texts, dealt to buckets (row numbers in the block, whether learnt, tokens, tokens before),
    and one row a block with its texts' ids and what the vocabulary alone tells of them."""
    floor = v.tokens + 0.5 * (v.words + 1)

    def run(batches):
        find, number = Finder(v), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for b in blocks(batch, "_text", 4096, BLOCK_BYTES):
                word, before, offsets = find.pairs(b["_text"])
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                learnt = b["_learns"].to_numpy(zero_copy_only=False)
                block = task << 32 | number
                number += 1
                at_home = word < RARE
                count = np.where(at_home, v.count[np.where(at_home, word, 0).astype(np.int64)], 0)
                known = np.bincount(row, count > 0, b.num_rows).astype(np.int64)
                base = np.bincount(row, np.where(at_home, np.log10((count + 0.5) / floor), 0.0), b.num_rows)
                order, cut = _cut(_bucket(v, before, word, buckets), buckets)
                cells = [(k, order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]
                flagged = row * 2 + learnt[row]
                ids, none = b["_id"], pa.nulls(len(cells))
                yield pa.record_batch({
                    "bucket": pa.array([k for k, _ in cells], pa.int32()), "block": pa.array([block] * len(cells), pa.int64()), "size": pa.array([len(at) for _, at in cells], pa.int64()),
                    "rows": pa.array([_pack(flagged[at], True) for _, at in cells], pa.binary()), "before": pa.array([_pack(before[at]) for _, at in cells], pa.binary()),
                    "word": pa.array([_pack(word[at]) for _, at in cells], pa.binary()),
                    "ids": none.cast(pa.list_(ids.type)), "tokens": none.cast(pa.list_(pa.int64())), "known": none.cast(pa.list_(pa.int64())), "base": none.cast(pa.list_(pa.float64()))})

                def whole(a):
                    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.record_batch({
                    "bucket": pa.array([-1 - block % buckets], pa.int32()), "block": pa.array([block], pa.int64()), "size": pa.array([b.num_rows], pa.int64()),
                    "rows": pa.nulls(1, pa.binary()), "before": pa.nulls(1, pa.binary()), "word": pa.nulls(1, pa.binary()),
                    "ids": whole(ids), "tokens": whole(pa.array(np.diff(offsets))), "known": whole(pa.array(known)), "base": whole(pa.array(base))})

    return run


def _scored(m: Model):
    """Of a bucket: per block the sums of log10 probability by row, and the tokens outside the vocabulary with the
    parts of their probability (their own, ``alpha``, and the share ``beta`` of the parent)."""
    v, n_states = m.vocabulary, len(m.states)

    def run(t: pa.Table) -> pa.Table:
        none = pa.nulls(t.num_rows)
        empty = {"rare": none.cast(pa.list_(pa.int64())), "row": none.cast(pa.list_(pa.int32())), "alpha": none.cast(pa.list_(pa.float32())), "beta": none.cast(pa.list_(pa.float32())), "sums": none.cast(pa.list_(pa.float32()))}
        keep = ["block", "size", "ids", "tokens", "known", "base"]
        if t["bucket"][0].as_py() < 0:
            return pa.table({c: t[c] for c in keep} | empty)
        lines = t.select(["size", "rows", "before", "word"]).to_pylist()
        sizes = np.cumsum([0, *[r["size"] for r in lines]])
        before, word = (np.concatenate([_unpack(r[c], r["size"]) for r in lines]) for c in ("before", "word"))
        rows = [_unpack(r["rows"], r["size"], True) for r in lines]
        # Distinct pairs (by a 64-bit fingerprint), how often they are learnt, and which pair every token is.
        finger = mix(before * grams.ODD ^ mix(word))
        order = np.argsort(finger)
        finger = finger[order]
        new = np.append(True, finger[1:] != finger[:-1])
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(new) - 1
        before, word = before[order[new]], word[order[new]]
        del finger, order, new
        n = np.bincount(pair, np.concatenate([(r & np.uint64(1)).astype(np.float64) for r in rows]), len(word)).astype(np.int64)
        # Learnt pairs in the order of the model's rounds, so that the seating comes out the same.
        at = np.flatnonzero(n)
        at = at[np.lexsort((word[at], before[at]))]
        x = Restaurants(v, before[at], word[at], n[at])
        # Every pair's context: its customers, and its tables state by state.
        c = np.minimum(np.searchsorted(x.context, before), max(len(x.context) - 1, 0))
        met = x.context[c] == before if len(x.context) else np.zeros(len(word), bool)
        wide, home = before < RARE, word < RARE
        place = np.where(wide, before, 0).astype(np.int64)
        customers = np.where(wide, v.count[place], np.where(met, x.customers[c], 0) if len(x.context) else 0)
        p, alpha, beta = np.zeros(len(word)), np.zeros(len(word)), np.zeros(len(word))
        for k, s in enumerate(x.chain(m.parent, m.totals, m.discount, m.strength, t["bucket"][0].as_py(), m.burn_in, n_states)):
            mine = np.bincount(x.owner, s, len(x.cut))
            tables = np.where(wide, m.state_totals[k][place], np.where(met, mine[c], 0) if len(x.context) else 0)
            own = np.zeros(len(word))
            own[at] = (x.n - m.discount * s) / (m.strength + customers[at])
            lean = (m.strength + m.discount * tables) / (m.strength + customers)
            p += own + lean * _of_words(m.states[k], word)
            alpha += own
            beta += lean
        logs = np.where(home, np.log10(p / n_states), 0.0)
        out = {c: [] for c in empty}
        for lo, hi, r in zip(sizes[:-1], sizes[1:], rows):
            row, mine = (r >> np.uint64(1)).astype(np.int64), pair[lo:hi]
            out["sums"].append(np.bincount(row, logs[mine]).astype(np.float32))
            away = np.flatnonzero(~home[mine])
            out["rare"].append(word[mine[away]].view(np.int64))
            out["row"].append(row[away].astype(np.int32))
            out["alpha"].append((alpha[mine[away]] / n_states).astype(np.float32))
            out["beta"].append((beta[mine[away]] / n_states).astype(np.float32))
        return pa.table({c: t[c] for c in keep} | {c: pa.array(out[c], empty[c].type) for c in out})

    return run


def _summed(t: pa.Table) -> pa.Table:
    """Rows of a block with their sums over all buckets, and their tokens outside the vocabulary."""
    home = t.filter(pc.is_valid(t["ids"]))
    if not home.num_rows:
        raise RuntimeError("a block of texts came without its ids")
    ids = home["ids"].combine_chunks().flatten()
    info = {c: home[c].combine_chunks().flatten() for c in ("tokens", "known", "base")}
    total = np.zeros(len(ids))
    for s in t["sums"].combine_chunks():
        if s.is_valid:
            part = s.values.to_numpy()
            total[: len(part)] += part
    row, rare, alpha, beta = (t[c].combine_chunks().flatten().to_numpy() for c in ("row", "rare", "alpha", "beta"))
    order = np.argsort(row, kind="stable")
    cut = np.searchsorted(row[order], np.arange(len(ids) + 1)).astype(np.int32)
    away = {c: pa.ListArray.from_arrays(cut, pa.array(a[order])) for c, a in (("rare", rare), ("alpha", alpha), ("beta", beta))}
    block = home["block"][0].as_py()
    return pa.table({"block": pa.array([block] * len(ids), pa.int64()), "row": pa.array(np.arange(len(ids))), "_id": ids, "n_tokens": info["tokens"], "known": info["known"], "base": info["base"], "score": pa.array(total)} | away)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: its id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text)."""
    v, n_states = model.vocabulary, len(model.states)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), learns(id_col).alias("_learns"))
    kind = texts.schema["_id"].dataType
    if not n_states:  # nothing was learnt: one unknown word, probability 1
        def alone(batches):
            for b in batches:
                for part in blocks(b, "_text", 8192):
                    yield pa.record_batch({"_id": part["_id"], "n": np.diff(_tokens(part["_text"])[1])})
        flat = texts.mapInArrow(alone, T.StructType([T.StructField("_id", kind), T.StructField("n", T.LongType())]))
        zero = F.lit(0).cast("long")
        return flat.select(F.col("_id").alias(id_col), (~learns("_id")).alias("held_out"), F.col("n").alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    long, double = T.LongType(), T.DoubleType()
    longs, doubles, floats = T.ArrayType(long), T.ArrayType(double), T.ArrayType(T.FloatType())

    def schema(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])

    block = {"ids": T.ArrayType(kind), "tokens": longs, "known": longs, "base": doubles}
    away = {"rare": longs, "alpha": floats, "beta": floats}
    dealt = texts.mapInArrow(_dealt(v, model.buckets), schema(bucket=T.IntegerType(), block=long, size=long, rows=T.BinaryType(), before=T.BinaryType(), word=T.BinaryType(), **block))
    sent = model._replace(words=None)  # what travels to the tasks
    scored = dealt.groupBy("bucket").applyInArrow(_scored(sent), schema(block=long, size=long, **block, **away, row=T.ArrayType(T.IntegerType()), sums=floats))
    summed = scored.groupBy("block").applyInArrow(_summed, schema(block=long, row=long, _id=kind, n_tokens=long, known=long, base=double, score=double, **away))
    held = stored(summed, "text-scores")
    # Tokens outside the vocabulary meet their counts and the parent's probability by word.
    floor = float(v.tokens + 0.5 * (v.words + 1))
    met = held.select("block", "row", F.explode(F.arrays_zip("rare", "alpha", "beta")).alias("t")).select("block", "row", F.col("t.rare").alias("value"), "t.alpha", "t.beta")
    if model.words is not None:
        met = met.join(model.words, "value", "left")
    else:
        met = met.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("p"))
    p = F.col("alpha").cast("double") + F.col("beta").cast("double") * F.coalesce("p", F.lit(float(sum(model.unknown) / n_states)))
    more = met.groupBy("block", "row").agg(
        F.sum(F.log10(p)).alias("more"), F.count("n").alias("more_known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)).alias("more_base"))
    both = held.drop("rare", "alpha", "beta").join(more, ["block", "row"], "left")
    return both.select(
        F.col("_id").alias(id_col), (~learns("_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
