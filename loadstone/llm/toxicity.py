"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: every word and its leading 4, 5 and 6 bytes are features; a feature's weight is its
log-odds between toxic and clean labelled documents under a Dirichlet prior in proportion to
its share of all documents of the corpus (worth ``PRIOR_SHARE`` of the labelled ones), kept if it is ``WEIGHT_LEAST`` and
``Z_LEAST`` deviations above zero. Copies of a text count once. The strongest ``FEATURES``
weights are the model; that and the labelled sample (``TRAIN_ROWS``, the rows of least hash)
are its only bounds.

Scoring: a token scores its best weight, or ``-DRIFT`` if it has none. One linear scan per document
finds all maximal segments, each the best of its surroundings. Their scores follow an
extreme-value law: a clean text of n tokens has K n exp(-lambda s) segments of s or more, with
lambda and K from the counted token scores of the clean labelled documents (half a token more at the
greatest score keeps lambda finite; K on scores rounded to multiples of ``GRID``). The expected count for the best segment
and the number of significant segments give the probability, by a logistic curve fitted on
the labelled sample.

Defined cases: a null or empty text has no tokens and gets the score of a text without findings;
null labels are not learnt from; without a label of both kinds every score is the share
of toxic rows; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.llm import grams
from loadstone.llm.common import BLOCK_BYTES, BLOCK_ROWS, blocks, carried, flat_bytes, mix, rows, stored

TRAIN_ROWS = 20_000
FEATURES = 20_000
PREFIXES = (4, 5, 6)
PRIOR_SHARE = 0.03
Z_LEAST = 3.3
WEIGHT_LEAST = 1.5
CLIP = 8.0
DRIFT = 0.5
SIGNIFICANT = 0.01
GRID = DRIFT / 8

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Model(NamedTuple):
    features: np.ndarray  # sorted fingerprints
    weights: np.ndarray
    short: np.ndarray  # sorted fingerprints of the features' first bytes
    rate: float  # lambda of the extreme-value law
    curve: np.ndarray  # logistic coefficients
    scale: float = 1.0  # K of the extreme-value law


def _tokens(col: pa.Array):
    offsets, raw = flat_bytes(col)
    return raw, grams.words(raw, offsets, lower=True, breaks=_BREAKS)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def _head(raw: np.ndarray, w: grams.Words, size: int, pick: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Fingerprint of the first ``size`` (at most 8) bytes of the words, shorter ones padded."""
    start, end = w.start[pick], w.end[pick]
    out = np.full(len(start), size, np.uint64)
    last = max(len(raw) - 1, 0)
    for k in range(size):
        byte = _LOWER[raw[np.minimum(start + k, last)]].astype(np.uint64)
        out = (out << np.uint64(8)) | np.where(start + k < end, byte, np.uint64(0))
    return mix(out)


def _background(wanted: np.ndarray):
    """Documents of a task that have each ``wanted`` (sorted) feature; all documents under a null feature."""

    def task(batches):
        total, held = 0, np.zeros(len(wanted), np.int64)
        for b in (part for whole in batches if whole.num_rows for part in blocks(whole, "text", BLOCK_ROWS, BLOCK_BYTES)):
            raw, w = _tokens(b["text"])
            doc = np.repeat(np.arange(b.num_rows), np.diff(w.offsets))
            keys = [np.zeros(0, np.int64)]
            for f in [w.hash, *[_head(raw, w, k) for k in PREFIXES]]:
                at = np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)
                hit = wanted[at] == f
                keys.append(at[hit] * b.num_rows + doc[hit])
            held += np.bincount(np.unique(np.concatenate(keys)) // b.num_rows, minlength=len(wanted))
            total += b.num_rows
        if total:
            at = np.flatnonzero(held)
            feature = pa.array([*wanted[at].view(np.int64).tolist(), None], pa.int64())
            yield pa.record_batch({"feature": feature, "n": np.append(held[at], total)})

    return task


def _per_document(b: pa.RecordBatch) -> pa.RecordBatch:
    """Features of the labelled documents of a batch, with their toxic and clean documents."""
    raw, w = _tokens(b["text"])
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    toxic = b["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
    head = _head(raw, w, PREFIXES[0])
    found = [np.stack([f.view(np.int64), doc, head.view(np.int64)]) for f in [w.hash, *[_head(raw, w, k) for k in PREFIXES]]]
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    once = np.ones(pairs.shape[1], bool)
    once[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
    f, d, h = pairs[0, once], pairs[1, once], pairs[2, once]
    cut = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
    y = toxic[d]
    return pa.record_batch({
        "feature": f[cut], "head": h[cut],
        "y1": np.add.reduceat(y, cut) if len(cut) else cut, "y0": np.add.reduceat(1 - y, cut) if len(cut) else cut,
    })


def segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal segments (first token, last token, score) of a line of tokens that score ``-drift``
    but for those at ``places``; linear in the places."""
    stack: list[list[float]] = []  # first, last, total before, total after, nearest one below that began lower
    total, previous = 0.0, None
    for at, s in zip(places.tolist(), scores.tolist()):
        if previous is not None:
            total -= drift * (at - previous - 1)
        previous = at
        new = [at, at, total, total + s]
        total += s
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]  # all between began no lower
            if k < 0 or stack[k][3] >= new[3]:
                stack.append([*new, k])
                break
            below = stack[k]
            new = [below[0], new[1], below[2], new[3]]
            del stack[k:]
            k = below[4]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in stack]


def _scored_tokens(model: Model, col: pa.Array):
    """Token offsets of the documents, and the tokens with a weight: their places and scores."""
    raw, w = _tokens(col)
    if not len(w.start) or not len(model.features):
        return w.offsets, np.zeros(0, np.int64), np.zeros(0)
    head = _head(raw, w, PREFIXES[0])
    live = np.flatnonzero(model.short[np.minimum(np.searchsorted(model.short, head), len(model.short) - 1)] == head)
    best = np.zeros(len(live))
    for f in [w.hash[live], *[_head(raw, w, k, live) for k in PREFIXES]]:
        at = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
        best = np.maximum(best, np.where(model.features[at] == f, model.weights[at], 0))
    return w.offsets, live[best > 0], best[best > 0]


def _findings(model: Model, col: pa.Array):
    """Tokens per document, and the documents' maximal segments."""
    offsets, live, best = _scored_tokens(model, col)
    n = np.diff(offsets)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(n))]
    doc = np.searchsorted(offsets, live, "right") - 1
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    for d in np.flatnonzero(np.diff(edges)):
        a, z = edges[d], edges[d + 1]
        found[d] = segments(live[a:z] - offsets[d], best[a:z])
    return n, found


def _evidence(model: Model, n: np.ndarray, found) -> np.ndarray:
    """Per document: a constant, the log of the best segment's expected count, and the count of significant segments."""
    out = np.zeros((len(n), 3))
    out[:, 0] = 1
    for i, segs in enumerate(found):
        if segs:
            size = math.log(max(int(n[i]), 1) * model.scale)
            logs = [max(min(model.rate * s - size, 40.0), -10.0) for _, _, s in segs]
            out[i, 1] = max(logs)
            out[i, 2] = math.log1p(sum(x > -math.log(SIGNIFICANT) for x in logs))
        else:
            out[i, 1] = -10.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with mean of exp(lambda score) = 1 over clean tokens."""
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if float((shares * np.exp(np.minimum(mid * scores, 500))).sum()) < 1:
            lo = mid
        else:
            hi = mid
    return lo


def _law_scale(scores: np.ndarray, shares: np.ndarray, grid: float = GRID, steps: int = 1000) -> float:
    """K of the extreme-value law (Karlin and Altschul) for token scores rounded to multiples of ``grid``."""
    places = np.rint(scores / grid).astype(np.int64)
    low, high = int(places.min()), int(places.max())
    step = np.bincount(places - low, weights=shares, minlength=high - low + 1)
    at = np.arange(low, high + 1)
    if step @ at >= 0:
        return 1.0  # no drift downwards, so no law
    rate = _rate(at.astype(float), step)
    total, walk = 0.0, np.ones(1)
    for k in range(1, steps + 1):
        walk = np.convolve(walk, step)
        walk = walk[: np.flatnonzero(walk > 1e-18)[-1] + 1]
        sums = np.arange(len(walk)) + k * low
        below = sums < 0
        term = float((walk[below] * np.exp(rate * sums[below])).sum() + walk[~below].sum()) / k
        total += term
        if term < 1e-7:
            break
    lean = float((step * at * np.exp(rate * at)).sum())
    unit = np.gcd.reduce(at[step > 0])  # scores on a coarser grid
    return float(unit * math.exp(-2 * total) / (lean * -math.expm1(-rate * unit)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on the labelled rows outside the held-out fifth; ids and labels serve only to choose rows."""
    chosen = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = stored(joined.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("h"), "toxicity-sample")
    size = texts.groupBy("toxic").count().collect()
    n1, n0 = sum(r["count"] for r in size if r["toxic"] == 1), sum(r["count"] for r in size if r["toxic"] != 1)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), 1.0, np.array([math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -5.0, 0.0, 0.0]))
    if not n1 or not n0:
        return empty
    counts = texts.mapInArrow(rows(_per_document, "text"), "feature long, head long, y1 long, y0 long").groupBy("feature").agg(
        F.min("head").alias("head"), F.max("head").alias("other"), F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    seen = counts.filter("y1 >= 3 and head = other").select("feature", "head", "y1", "y0").toPandas()  # features of at most train_rows texts
    if not len(seen):
        return empty
    seen = seen.iloc[np.argsort(seen["feature"].to_numpy(np.int64).view(np.uint64))]
    wanted = seen["feature"].to_numpy(np.int64).view(np.uint64)
    spread = docs.select("text").mapInArrow(_background(wanted), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    known = spread.filter(spread["feature"].is_valid())
    everywhere = float(spread.filter(spread["feature"].is_null())["n"][0].as_py())
    held = np.zeros(len(wanted))
    held[np.searchsorted(wanted, known["feature"].to_numpy().view(np.uint64))] = known["n"].to_numpy()
    usual = held < everywhere  # a feature of every document tells nothing
    seen, wanted, share = seen[usual], wanted[usual], held[usual] / everywhere
    prior = PRIOR_SHARE * (n1 + n0)
    a1, a0 = seen["y1"].to_numpy(float) + prior * share, seen["y0"].to_numpy(float) + prior * share
    weight = np.log(a1 / (n1 + prior - a1)) - np.log(a0 / (n0 + prior - a0))
    z = weight / np.sqrt(1 / a1 + 1 / a0)
    good = np.flatnonzero((z >= Z_LEAST) & (weight >= WEIGHT_LEAST))
    good = np.sort(good[np.lexsort((wanted[good], -z[good]))[:features]])
    if not len(good):
        return empty
    weights = np.clip(weight[good], DRIFT, CLIP)
    model = Model(wanted[good], weights, np.unique(seen["head"].to_numpy(np.int64)[good].view(np.uint64)), 1.0, np.zeros(3))

    def token_scores(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, _, best = _scored_tokens(model, b["text"])
        score, n = np.unique(best, return_counts=True)
        return pa.record_batch({"score": np.append(score, -DRIFT), "n": np.append(n, offsets[-1] - len(best)).astype(np.int64)})

    clean = texts.filter("toxic != 1").mapInArrow(rows(token_scores, "text"), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()  # at most a row per weight
    scores, n = np.append(clean["score"].to_numpy(float), weights.max()), np.append(clean["n"].to_numpy(float), 0.5)
    model = model._replace(rate=_rate(scores, n / n.sum()), scale=_law_scale(scores, n / n.sum()))

    def evidence(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _evidence(model, *_findings(model, b["text"]))
        return pa.record_batch({"x1": x[:, 1], "x2": x[:, 2], "y": b["toxic"].cast(pa.float64())})

    fitted = texts.mapInArrow(rows(evidence, "text"), "x1 double, x2 double, y double").toPandas()  # at most train_rows rows
    x = np.stack([np.ones(len(fitted)), fitted["x1"], fitted["x2"]], axis=1)
    return model._replace(curve=_fit_curve(x, fitted["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row: ``carry`` (default the id), score (0 to 1), predicted (0 or 1), passages
    (first and last token, score, expected count), the significant segments in order."""
    carry = [id_col] if carry is None else carry

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n, found = _findings(model, b["_text"])
        p = _sigmoid(_evidence(model, n, found) @ model.curve)
        passages = [
            [{"first": a, "last": z, "score": s, "expected": e} for a, z, s in segs if (e := model.scale * int(k) * math.exp(-min(model.rate * s, 500.0))) < SIGNIFICANT]
            for k, segs in zip(n, found)
        ]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        out = {c: b[c] for c in b.schema.names if c != "_text"}
        return pa.record_batch(out | {"score": p, "predicted": (p >= 0.5).astype(np.int32), "passages": pa.array(passages, kind)})

    before, schema, after = carried(docs, carry, "score double, predicted int, passages array<struct<first:bigint,last:bigint,score:double,expected:double>>")
    return docs.select(*before, F.col(text_col).alias("_text")).mapInArrow(rows(batch, "_text"), schema).select(*after)


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    whole = docs.select(F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = score(whole, model, text_col="_text", carry=["_row"])
    return scored.filter("predicted = 0").select(*[F.col(f"_row.`{c}`") for c in docs.columns])
