"""Exact interpolated percentiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the
values are counted per monotone magnitude bucket, the buckets holding the wanted
ranks are found from that small histogram, and such a bucket is cut again by its
own range, so that values of a narrow range do not end in one task. Only the cells that hold
the ranks are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 512
WHOLE = 1024  # distinct values a bucket may have without being cut again
CELLS = 1 << 18


def _bucket(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BUCKETS_PER_E_FOLD)).cast("long")


def _histogram(counts: DataFrame, group: list[str], cell: str) -> DataFrame:
    """Per group and cell: values, those in lower cells, the cell's range and distinct values."""
    hist = counts.groupBy(*group, cell).agg(F.sum("count").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = Window.partitionBy(*group).orderBy(cell)
    return hist.withColumn("below", F.sum("n").over(w) - F.col("n"))


def _cells(counts: DataFrame, group: list[str], quantile: Column, whole: int = WHOLE, cells: int = CELLS) -> DataFrame:
    """The values of the cells that hold the wanted ranks: group, rank, r, v, count, below (values in lower cells), b and cell."""
    hist = _histogram(counts.withColumn("b", _bucket(F.col("v"))), group, "b").withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    rank = quantile * (F.col("total") - 1)
    wanted = (
        hist.select("*", rank.alias("rank"), F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("r"))
        .filter("r >= below AND r < below + n")
    )
    hit = counts.withColumn("b", _bucket(F.col("v"))).join(wanted.drop("n", "total"), [*group, "b"])
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    cell = F.when(F.col("distinct") > whole, F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(0).cast("int")
    hit = hit.withColumn("cell", cell).drop("lo", "hi", "distinct").withColumnRenamed("below", "under")
    at = [*group, "b", "r"]
    # At most CELLS rows a bucket here; the rows of a bucket are spread over its cells.
    inner = _histogram(hit, [*at, "under"], "cell").withColumn("below", F.col("under") + F.col("below")).filter("r >= below AND r < below + n")
    return hit.drop("under").join(inner.select(*at, "cell", "below"), [*at, "cell"])


def percentiles(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[Column, float]], counted: str | None = None
) -> DataFrame:
    """One row per key with ``name -> percentile(column, q)`` (linear interpolation).

    Keys whose values are all null are left out; join back with a left join. With
    ``counted`` the rows are already distinct per key and value (of the one
    column asked for) and that column holds how often each occurs.
    """
    keys = list(keys)
    entries = F.array(*[
        F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, (c, _) in specs.items()
    ])
    quantile = F.create_map(*[x for n, (_, q) in specs.items() for x in (F.lit(n), F.lit(float(q)))])
    extra = [F.col(counted).alias("count")] if counted else []
    long = df.select(*keys, *extra, F.inline(entries)).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    group = [*keys, "name"]
    counts = long if counted else long.groupBy(*group, "v").count()
    hit = _cells(counts, group, quantile[F.col("name")])
    wb = Window.partitionBy(*group, "b", "r", "cell").orderBy("v")
    at = (
        hit.withColumn("upto", F.col("below") + F.sum("count").over(wb))
        .filter("r < upto AND r >= upto - count")
    )
    frac = F.col("rank") - F.floor("rank")

    def pick(name: str) -> Column:
        mine = F.col("name") == name
        low, high = F.min(F.when(mine, F.col("v"))), F.max(F.when(mine, F.col("v")))
        return (low + (high - low) * F.max(F.when(mine, frac))).alias(name)

    return at.groupBy(*keys).agg(*[pick(n) for n in specs])


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank of each non-null value in its group, ties broken by columns.

    Values are numbered inside magnitude buckets and offset by the buckets below,
    so a large group is not sorted in one task.
    """
    keys = list(keys)
    x = df.filter(F.col(value).isNotNull()).withColumn("_b", _bucket(F.col(value).cast("double"))).repartition(*keys, "_b")
    sizes = x.groupBy(*keys, "_b").count()
    w = Window.partitionBy(*keys)
    below = sizes.select(*keys, "_b", (F.sum("count").over(w.orderBy("_b")) - F.col("count")).alias("_off"), F.sum("count").over(w).alias("_total"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value, *ties)
    return x.withColumn("_rn", F.row_number().over(inside)).join(below, [*keys, "_b"]).withColumn(
        name, F.col("_off") + F.col("_rn")).withColumnRenamed("_total", "rank_of").drop("_b", "_rn", "_off")
