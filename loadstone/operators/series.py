"""Series primitives that keep every task bounded, whatever the key skew.

A window partitioned only by series key puts one whole series in one task. The
helpers below cut a series into chunks of an integer order column (hour number
or row position) and either copy a halo of neighbouring rows (fixed frames) or
combine one summary row per chunk (cumulative frames), so a hot series is spread
over many tasks and the result stays exact. Rows are dealt out by key *and* chunk
explicitly: a window by both is also satisfied by an earlier dealing by key alone,
which would leave all chunks of a series in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


def hour_number(ts: str | Column) -> Column:
    """Hours since the epoch, the integer order of an hourly series."""
    return F.floor(F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts) / 3600)


def hours(n: int | Column) -> Column:
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def lead_hours(later: str | Column, earlier: str | Column) -> Column:
    """Signed difference in hours between two timestamps."""
    def sec(c):
        return F.unix_micros(F.col(c) if isinstance(c, str) else c)
    return (sec(later) - sec(earlier)) / 3.6e9


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    exprs: dict[str, Callable],
    before: int = 0,
    after: int = 0,
    chunk: int = CHUNK_ROWS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Evaluate fixed-frame window expressions on haloed chunks.

    ``exprs`` maps a new column to a function of the window spec; frames may
    reach ``before`` units of ``order`` back and ``after`` units ahead. With
    ``keep_chunk`` the ``_chunk`` column stays, so ``running`` can go on without
    another shuffle.
    """
    spread = F.sequence(
        F.floor((F.col(order) - after) / chunk), F.floor((F.col(order) + before) / chunk)
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = (
        df.select("*", F.floor(F.col(order) / chunk).alias("_home"), F.explode(spread).alias("_chunk"))
        .repartition(*keys, "_chunk")
        .select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
        .filter("_chunk = _home")
    )
    return out.drop("_home") if keep_chunk else out.drop("_home", "_chunk")


def rolling_mean(v: str, w, first: int, last: int) -> Column:
    """Mean of the non-null values of rows ``first`` to ``last`` around each row.

    The difference of two growing sums, so a wide frame costs no more per row than
    a narrow one.
    """
    upto, before = w.rowsBetween(Window.unboundedPreceding, last), w.rowsBetween(Window.unboundedPreceding, first - 1)
    total = F.coalesce(F.sum(v).over(upto), F.lit(0.0)) - F.coalesce(F.sum(v).over(before), F.lit(0.0))
    n = F.count(v).over(upto) - F.count(v).over(before)
    return F.when(n > 0, total / n)


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", span: int = CHUNK_ROWS
) -> DataFrame:
    """0-based row position per key: in-chunk row number plus the rows before."""
    keys = list(keys)
    cut = df.withColumn("_part", F.floor(F.col(order) / span)).repartition(*keys, "_part")
    w = Window.partitionBy(*keys, "_part").orderBy(order)
    local = cut.withColumn("_rn", F.row_number().over(w))
    sizes = cut.groupBy(*keys, "_part").count()
    offsets = sizes.select(
        *keys,
        "_part",
        (F.sum("count").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("count")).alias("_off"),
    )
    return (
        local.join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_part", "_rn", "_off")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Cumulative columns over a whole series, combined from chunk summaries.

    Kinds: ``sum``/``min``/``max`` up to and including the row, ``last`` the
    newest non-null so far, ``next`` the first non-null from the row onward.
    """
    keys = list(keys)
    made = [] if "_chunk" in df.columns else [F.floor(F.col(order) / chunk).alias("_chunk")]
    cut = df.select("*", *made, *[c.alias(f"_v_{n}") for n, (_, c) in specs.items()])
    if made:
        cut = cut.repartition(*keys, "_chunk")
    rows = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto, onward = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(0, Window.unboundedFollowing)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    earlier, later = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(1, Window.unboundedFollowing)
    inside, summary, carried, result = [], [], [], []
    for n, (kind, _) in specs.items():
        v, s, c, i = (F.col(f"_{p}_{n}") for p in "vsci")
        if kind in ("sum", "min", "max"):
            agg = getattr(F, kind)
            inside.append(agg(v).over(upto).alias(f"_i_{n}"))
            summary.append(agg(v).alias(f"_s_{n}"))
            carried.append(agg(s).over(earlier).alias(f"_c_{n}"))
            both = {"sum": lambda i=i, c=c: F.when(i.isNotNull() | c.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))),
                    "min": lambda i=i, c=c: F.least(i, c), "max": lambda i=i, c=c: F.greatest(i, c)}[kind]()
            result.append(both.alias(n))
        elif kind == "last":
            inside.append(F.last(v, True).over(upto).alias(f"_i_{n}"))
            summary.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"_s_{n}"))
            carried.append(F.last(s, True).over(earlier).alias(f"_c_{n}"))
            result.append(F.coalesce(i, c).alias(n))
        elif kind == "next":
            inside.append(F.first(v, True).over(onward).alias(f"_i_{n}"))
            summary.append(F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"_s_{n}"))
            carried.append(F.first(s, True).over(later).alias(f"_c_{n}"))
            result.append(F.coalesce(i, c).alias(n))
        else:
            raise ValueError(kind)
    sums = cut.groupBy(*keys, "_chunk").agg(*summary).select(*keys, "_chunk", *carried)
    return (
        cut.select("*", *inside)
        .join(sums, [*keys, "_chunk"])
        .select(*[c for c in df.columns if c != "_chunk"], *result)
    )


def previous(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Columns of the row before, on sparse rows: in its chunk, or the last one of
    the chunk before."""
    keys = list(keys)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).repartition(*keys, "_chunk")
    row = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    inside = F.lag(row, 1).over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    last = cut.groupBy(*keys, "_chunk").agg(F.max_by(row, order).alias("_end"))
    carry = last.select(*keys, "_chunk", F.lag("_end", 1).over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_in"))
    out = cut.withColumn("_p", inside).join(carry, [*keys, "_chunk"]).withColumn("_p", F.coalesce("_p", "_in"))
    return out.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in cols])


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int | Column, rank: str | None = None) -> DataFrame:
    """The newest ``n`` rows of every key (Spark prunes per task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def newest_counted(df: DataFrame, keys: Sequence[str], order: Column, n: int | Column, rank: str | None = None, span: int = CHUNK_ROWS) -> DataFrame:
    """``newest`` for an ``n`` of thousands, or one that differs by key.

    Chunks of the integer ``order`` are counted from the newest backwards; only chunks
    that hold wanted rows are ranked, each by itself, so no key is sorted in one task.
    Rows without an order value are left out.
    """
    keys = list(keys)
    cut = df.withColumn("_o", order).withColumn("_part", F.floor(F.col("_o") / span)).repartition(*keys, "_part")
    backwards = Window.partitionBy(*keys).orderBy(F.desc("_part"))
    sizes = cut.groupBy(*keys, "_part").count()
    wanted = sizes.select(*keys, "_part", (F.sum("count").over(backwards) - F.col("count")).alias("_after")).filter(F.col("_after") < n)
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.desc("_o")))
    name = rank or "_rn"
    out = cut.join(wanted, [*keys, "_part"]).withColumn(name, F.col("_after") + inside).filter(F.col(name) <= n)
    return out.select(*df.columns, *([name] if rank else []))


def keep_one(df: DataFrame, keys: Sequence[str], *orders: Column) -> DataFrame:
    """First row per key under an explicit order (never an arbitrary duplicate)."""
    w = Window.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def hour_spine(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Every hour between the first and last of each series; absent hours are null."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    # Spans are cut into chunks first, so no row carries a whole series as an array and the chunks are made in many tasks.
    cuts = span.select(*keys, "_b", F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {CHUNK_ROWS} HOURS"))).alias("_a")).repartition(*keys, "_a")
    stop = F.least(F.col("_b"), F.col("_a") + hours(CHUNK_ROWS - 1))
    grid = cuts.select(*keys, F.explode(F.sequence(F.col("_a"), stop, F.expr("INTERVAL 1 HOUR"))).alias(ts))
    return grid.join(df, [*keys, ts], "left")
