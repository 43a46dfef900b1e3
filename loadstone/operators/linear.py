"""Pooled linear arm: least squares from additive moments, folds by row position.

Rows are dealt to ``n_splits + 1`` blocks by their position inside each key: block 0 is what
every fold trains on, block k the test rows of fold k - 1. One aggregate gives each block's
count, means and co-moments; the training moments of a fold are the blocks before its test
block added up, so all folds cost one pass over the table, however many there are. What
reaches the driver is one row per block, a size set by the arguments alone.

Defined cases: rows with a null input or label take no part; keys with fewer than
``n_splits + 1`` rows lie in block 0 (the reference's splitter refuses them); constant or
collinear inputs get the least-norm coefficients; a fold without training rows has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.series import with_position


class Moments(NamedTuple):
    n: float
    mean: np.ndarray
    comoment: np.ndarray  # sums of products about the mean


class Fit(NamedTuple):
    intercept: float
    weights: np.ndarray
    n: int


def complete(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.na.drop(subset=[*features, label])


def fold_spans(df: DataFrame, keys: Sequence[str], n_splits: int) -> DataFrame:
    """Per key: rows ``n``, test rows a fold ``size``, and the position ``start`` of the first test row."""
    size = F.floor(F.col("n") / (n_splits + 1))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("size", size).withColumn("start", F.col("n") - n_splits * F.col("size"))


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, n_splits: int) -> DataFrame:
    """``block`` of every row: 0 before the first test row, then 1 to ``n_splits``; ``order`` is a distinct number per key."""
    spans = fold_spans(df, keys, n_splits).select(*keys, "size", "start")
    placed = with_position(df, keys, order, "_pos").join(spans, list(keys))
    past = F.col("_pos") - F.col("start")
    block = F.when((F.col("size") == 0) | (past < 0), 0).otherwise(F.floor(past / F.col("size")) + 1)
    return placed.withColumn("block", block.cast("int")).drop("_pos", "size", "start")


def moments(df: DataFrame, columns: Sequence[str], by: str) -> dict[int, Moments]:
    """Moments of ``columns`` for every value of ``by`` (few), from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    wide = [F.col(f"`{c}`").cast("double") for c in columns]
    rows = df.groupBy(by).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(wide)],
        *[F.covar_pop(wide[i], wide[j]).alias(f"_c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        c = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"_c{i}_{j}"] * r["_n"]
        out[r[by]] = Moments(r["_n"], np.array([r[f"_m{i}"] for i in range(len(columns))]), c)
    return out


def added(a: Moments | None, b: Moments | None) -> Moments | None:
    """Moments of two sets of rows together."""
    if a is None or b is None:
        return a or b
    n, gap = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + gap * (b.n / n), a.comoment + b.comoment + np.outer(gap, gap) * (a.n * b.n / n))


def solved(m: Moments) -> Fit:
    """Least squares of the last column on the others, on inputs scaled to unit spread."""
    xx, xy = m.comoment[:-1, :-1], m.comoment[:-1, -1]
    scale = np.sqrt(np.diag(xx))
    scale[scale == 0] = 1.0
    weights = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale
    return Fit(float(m.mean[-1] - weights @ m.mean[:-1]), weights, int(m.n))


def predicted(fit: Fit, features: Sequence[str]) -> Column:
    out = F.lit(fit.intercept)
    for f, w in zip(features, fit.weights.tolist()):
        out = out + F.col(f"`{f}`") * F.lit(w)
    return out


def fit(df: DataFrame, features: Sequence[str], label: str = "target") -> Fit | None:
    """One pooled fit over all rows; none without a complete row."""
    found = moments(complete(df, features, label).withColumn("_all", F.lit(0)), [*features, label], "_all")
    return solved(found[0]) if found else None


def cross_validate(df: DataFrame, features: Sequence[str], order: str, n_splits: int = 5, label: str = "target", keys: Sequence[str] = ("region",)) -> DataFrame:
    """One row per fold: n_train, n_test, intercept, a weight per feature (``w_<feature>``), mape, mae and rmse.

    Folds run side by side through the keys; each is fitted over all keys on rows before its own test rows.
    """
    placed = with_blocks(complete(df, features, label).select(*keys, order, *features, label), keys, order, n_splits)
    by_block = moments(placed, [*features, label], "block")
    fits: dict[int, Fit] = {}
    total = by_block.get(0)
    for block in range(1, n_splits + 1):
        if total is not None and block in by_block:
            fits[block] = solved(total)
        total = added(total, by_block.get(block))
    kinds = {"fold": "int", "n_train": "bigint", "intercept": "double"} | {f"w_{f}": "double" for f in features}
    values = [(b - 1, f.n, f.intercept, *f.weights.tolist()) for b, f in fits.items()]
    models = df.sparkSession.createDataFrame(values, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    guess = F.lit(None).cast("double")
    for block, f in fits.items():
        guess = F.when(F.col("block") == block, predicted(f, features)).otherwise(guess)
    graded = placed.filter("block > 0").withColumn("_guess", guess).groupBy((F.col("block") - 1).alias("fold")).agg(
        F.count("*").alias("n_test"), mt.mape(label, "_guess").alias("mape"), mt.mae(label, "_guess").alias("mae"), mt.rmse(label, "_guess").alias("rmse"))
    return models.join(graded, "fold")
