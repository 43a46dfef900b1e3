"""Scans over a series as mergeable chunk summaries.

A ``Fold`` says how the rows of a series are decided in order: by window columns inside a chunk,
an aggregate of the chunk, and what a chunk takes over from all chunks before it. The last is worked out on one row a
chunk, so no task holds a series; and since summaries combine in any grouping, the same fold serves batch tables
(``scan``) and streams that get rows late (``streaming.late``).

Order columns are integers; rows of one series with the same order value are one row to a fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.operators.series import CHUNK_ROWS

CHUNK = "_chunk"
LOG_RANGE = 500.0  # weights are kept between exp(-500) and exp(500)


class Fold(NamedTuple):
    inside: Sequence[dict[str, Callable[[list[str], str], Column]]]  # window columns of a chunk, stage by stage, given keys and order
    summary: Callable[[str], dict[str, Column]]  # aggregates of a chunk, given the order
    carry: Callable[[DataFrame, list[str]], DataFrame]  # adds the ``carried`` columns to one row a chunk
    carried: tuple[str, ...]
    decide: dict[str, Column]  # the result, row by row


def _rows(keys: list[str], order: str, *more: Column | str):
    return Window.partitionBy(*keys, CHUNK, *more).orderBy(order)


def _upto(keys: list[str], order: str, *more: Column | str):
    return _rows(keys, order, *more).rowsBetween(Window.unboundedPreceding, 0)


def _chunks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _earlier(keys: list[str]):
    return _chunks(keys).rowsBetween(Window.unboundedPreceding, -1)


def inside(df: DataFrame, keys: Sequence[str], order: str, fold: Fold) -> DataFrame:
    """Rows with their window columns; ``df`` has a chunk column."""
    out = df.repartition(*keys, CHUNK)
    for stage in fold.inside:
        out = out.select("*", *[fn(list(keys), order).alias(n) for n, fn in stage.items()])
    return out


def summarise(rows: DataFrame, keys: Sequence[str], order: str, fold: Fold) -> DataFrame:
    return rows.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in fold.summary(order).items()])


def scan(df: DataFrame, keys: Sequence[str], order: str, fold: Fold, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the fold's results; chunks are ``chunk`` units of the integer column ``order``."""
    keys = list(keys)
    rows = inside(df.withColumn(CHUNK, F.floor(F.col(order) / chunk)), keys, order, fold)
    carried = fold.carry(summarise(rows, keys, order, fold), keys).select(*keys, CHUNK, *fold.carried)
    return rows.join(carried, [*keys, CHUNK]).select(*df.columns, *[c.alias(n) for n, c in fold.decide.items()])


def monotone(value: str, name: str = "served") -> Fold:
    """Whether a row's value is not below any value before it. A null value never is."""
    return Fold(
        [{"_most": lambda k, o: F.max(value).over(_upto(k, o))}],
        lambda o: {"_top": F.max(value)},
        lambda c, k: c.withColumn("_in", F.max("_top").over(_earlier(k))),
        ("_in",),
        {name: F.coalesce(F.col(value) >= F.greatest("_most", "_in"), F.lit(False))})


def streaks(breached: str, alert_at: int = 3) -> Fold:
    """Consecutive true rows up to each row, and whether they are ``alert_at`` or more. Null is false.

    A chunk is summed up by its length, its trailing run and whether all of it is true: a run of chunks that are
    true throughout adds its length to the trailing run before it.
    """
    b = F.coalesce(F.col(breached), F.lit(False))

    def carry(chunks: DataFrame, keys: list[str]) -> DataFrame:
        before = F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0))
        c = chunks.withColumn("_before", before).withColumn("_broken", F.when(~F.col("_all"), F.col("_trail") - F.col("_before") - F.col("_n")))
        return c.withColumn("_in", F.coalesce(F.last("_broken", True).over(_earlier(keys)), F.lit(0)) + F.col("_before")).drop("_before", "_broken")

    run = F.col("_place") - F.coalesce("_off", F.lit(0))
    streak = F.when(b, run + F.when(F.col("_off").isNull(), F.col("_in")).otherwise(0)).otherwise(0).cast("long")
    return Fold(
        [{"_place": lambda k, o: F.row_number().over(_rows(k, o))}, {"_off": lambda k, o: F.max(F.when(~b, F.col("_place"))).over(_upto(k, o))}],
        lambda o: {"_n": F.count("*"), "_trail": F.max_by(run, o), "_all": F.every(b)},
        carry, ("_in",), {"streak": streak, "alert": streak >= alert_at})


def changes(value: str, name: str = "kept") -> Fold:
    """Whether a row's value differs from that of the row before (the first one does). Two chunks meet at their border values."""
    first = F.col("_place") == 1
    same = F.when(first, F.col("_any") & F.col("_in").eqNullSafe(F.col(value))).otherwise(F.col("_prev").eqNullSafe(F.col(value)))
    return Fold(
        [{"_place": lambda k, o: F.row_number().over(_rows(k, o)), "_prev": lambda k, o: F.lag(value).over(_rows(k, o))}],
        lambda o: {"_end": F.max_by(F.struct(F.col(value).alias("v")), o)},
        lambda c, k: c.withColumn("_in", F.last("_end").over(_earlier(k))).withColumn("_any", F.col("_in").isNotNull()).withColumn("_in", F.col("_in.v")),
        ("_in", "_any"), {name: ~same})


def smoothing(value: str, usable: Column, alpha: float, name: str = "ewma") -> Fold:
    """Exponential smoothing over the usable rows, the others keep the last value; null before the first.

    A chunk is an affine map of what enters it: of n usable rows, s becomes keep^n s + b. Maps are combined in blocks of
    so many rows that no weight leaves the range of a double, and what lies more than a block back weighs
    nothing (exp(-500)), so two levels are enough for any ``alpha``.
    """
    keep = 1.0 - alpha
    span = max(1, math.floor(LOG_RANGE / -math.log(keep))) if 0 < keep < 1 else (1 if keep <= 0 else 1 << 40)
    power = lambda n: F.pow(F.lit(keep), n)
    block = F.floor(F.col("_k") / span)
    at = F.col("_k") - block * span  # place in its block

    def carry(chunks: DataFrame, keys: list[str]) -> DataFrame:
        w = _chunks(keys)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        c = chunks.withColumn("_sum", F.sum("_n").over(upto)).withColumn("_v0", F.first("_first", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        c = c.withColumn("_blk", F.floor(F.col("_sum") / span)).withColumn("_d", F.col("_sum") - F.col("_blk") * span)
        wb = Window.partitionBy(*keys, "_blk").orderBy(CHUNK)
        c = c.withColumn("_val", F.sum(F.coalesce("_b", F.lit(0.0)) * power(-F.col("_d"))).over(wb.rowsBetween(Window.unboundedPreceding, 0)) * power(F.col("_d")))
        c = c.withColumn("_left", F.lag(F.struct("_val", "_sum")).over(w)).withColumn("_left", F.first("_left").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
        older = F.coalesce(F.col("_left._val") * power(F.col("_sum") - F.col("_left._sum")), F.lit(0.0))
        c = c.withColumn("_out", F.col("_val") + older + power(F.col("_sum")) * F.col("_v0"))
        c = c.withColumn("_in", F.coalesce(F.lag("_out").over(w), F.col("_v0"))).withColumn("_cum", F.col("_sum") - F.col("_n"))
        return c.drop("_sum", "_v0", "_blk", "_d", "_val", "_left", "_out")

    own = F.coalesce("_p", F.lit(0.0)) + F.coalesce(F.col("_e") * power(at + 1), F.lit(0.0))
    return Fold(
        [{"_k": lambda k, o: F.sum(usable.cast("long")).over(_upto(k, o)) - 1},
         {"_p": lambda k, o: F.sum(F.when(usable, alpha * F.col(value) * power(-at))).over(_upto(k, o, block)) * power(at)},
         {"_e": lambda k, o: F.last(F.when(at == span - 1, F.col("_p")), True).over(_rows(k, o).rowsBetween(Window.unboundedPreceding, -1))}],
        lambda o: {"_n": F.coalesce(F.sum(usable.cast("long")), F.lit(0)), "_b": F.max_by(own, o), "_first": F.min_by(value, F.when(usable, F.col(o)))},
        carry, ("_in", "_cum"),
        {name: F.when(F.col("_k") + 1 + F.col("_cum") > 0, own + power(F.col("_k") + 1) * F.col("_in"))})
