"""Downsampling for display: largest triangle per bucket, and bucket extremes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.operators.series import CHUNK_ROWS, with_position


HULL_FANIN = 1024


def _corners(xs: np.ndarray, ys: np.ndarray) -> list[int]:
    """Positions of the convex hull of points sorted by x (monotone chain)."""
    keep: set[int] = set()
    for sign in (1, -1):
        line: list[int] = []
        for i in range(len(xs)):
            while len(line) > 1:
                a, b = line[-2], line[-1]
                turn = (xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a])
                if sign * turn >= 0:
                    break
                line.pop()
            line.append(i)
        keep.update(line)
    return sorted(keep)


def _hulls(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hull points of every bucket in a chunk of rows."""
    p = pdf.sort_values("i", ignore_index=True)
    b, xs, ys = (p[c].to_numpy() for c in ("b", "x", "y"))
    cuts = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
    return p.iloc[[lo + k for lo, hi in zip(cuts, cuts[1:]) for k in _corners(xs[lo:hi], ys[lo:hi])]]


def lttb(df: DataFrame, keys: Sequence[str], x: str, y: str, threshold: int = 720, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Largest-triangle-three-buckets: about ``threshold`` rows a series, ends kept.

    The area of a triangle over a fixed base is largest at a corner of the
    bucket's convex hull, so hulls are taken chunk by chunk and bucket by bucket
    first; the dependent choice then walks at most ``threshold`` small hulls.
    """
    keys, k = list(keys), threshold - 2
    base = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pos = with_position(base.withColumn("_o", F.col("x").cast("long")), keys, "_o", "i").drop("_o")
    n = base.groupBy(*keys).agg(F.count("*").alias("n"))
    p = pos.join(n, keys)
    short = p.filter(F.col("n") <= threshold).select(*keys, "x", "y")
    size = (F.col("n") - 2) / F.lit(k)
    # Bucket b holds positions floor(b*size)+1 .. floor((b+1)*size).
    guess = F.floor((F.col("i") - 1) / size)
    b = F.when(F.floor(guess * size) + 1 > F.col("i"), guess - 1).when(F.floor((guess + 1) * size) + 1 <= F.col("i"), guess + 1).otherwise(guess)
    big = p.filter(F.col("n") > threshold)
    inner = big.filter((F.col("i") > 0) & (F.col("i") < F.col("n") - 1)).withColumn("b", F.least(b, F.lit(k - 1)))
    ends = big.filter((F.col("i") == 0) | (F.col("i") == F.col("n") - 1))
    mean = inner.groupBy(*keys, "b").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("c"))
    schema = inner.select(*keys, "b", "i", "x", "y").schema
    rows = inner.select(*keys, "b", "i", "x", "y")
    # Hulls of chunks, then of chunks of chunk hulls: no group grows with the bucket.
    hull = rows
    for span in (chunk, chunk * HULL_FANIN):
        hull = hull.withColumn("_c", F.floor(F.col("i") / span)).groupBy(*keys, "_c").applyInPandas(lambda g: _hulls(g)[schema.names], schema)
    after = mean.select(*keys, (F.col("b") - 1).alias("b"), "sx", "sy", "c")
    last = ends.filter(F.col("i") == F.col("n") - 1).select(*keys, F.col("x").alias("lx"), F.col("y").alias("ly"))
    first = ends.filter(F.col("i") == 0).select(*keys, F.col("x").alias("fx"), F.col("y").alias("fy"))
    j = hull.join(after, [*keys, "b"], "left").join(last, keys).join(first, keys)
    # The last bucket's third corner is the end point itself.
    j = j.select(*keys, "b", "i", "x", "y", F.coalesce(F.col("sx") / F.col("c"), F.col("lx")).alias("ax"), F.coalesce(F.col("sy") / F.col("c"), F.col("ly")).alias("ay"), "fx", "fy")
    out = base.select(*keys, "x", "y").schema

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        px, py = g["fx"].iloc[0], g["fy"].iloc[0]
        p = g.sort_values(["b", "i"], ignore_index=True)
        b, x, y, ax, ay = (p[c].to_numpy() for c in ("b", "x", "y", "ax", "ay"))
        picked, cuts = [], [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            area = np.abs((px - ax[lo]) * (y[lo:hi] - py) - (px - x[lo:hi]) * (ay[lo] - py))
            at = lo + int(np.argmax(area))
            picked.append(at)
            px, py = x[at], y[at]
        return p.iloc[picked][out.names]

    chosen = j.groupBy(*keys).applyInPandas(walk, out)
    return chosen.unionByName(ends.select(*keys, "x", "y")).unionByName(short)


def m4(df: DataFrame, keys: Sequence[str], x: str, y: str, buckets: int) -> DataFrame:
    """First, last, lowest and highest value of equal-count buckets, native."""
    keys = list(keys)
    pos = with_position(df.withColumn("_o", F.col(x).cast("long")), keys, "_o", "_i").drop("_o")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    g = pos.join(n, keys).withColumn("bucket", F.floor(F.col("_i") * buckets / F.col("_n")))
    return g.groupBy(*keys, "bucket").agg(
        F.min_by(y, "_i").alias("first"), F.max_by(y, "_i").alias("last"), F.min(y).alias("low"), F.max(y).alias("high"),
        F.min_by(x, F.struct(F.col(y), F.col("_i"))).alias("low_at"), F.max_by(x, F.struct(F.col(y), -F.col("_i"))).alias("high_at"))
