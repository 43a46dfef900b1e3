"""Rolling error of a stream of graded forecasts whose actuals are revised later.

Three logs lie below ``path``, one folder a batch: ``revisions`` (newest positive actual of an hour), ``records`` (graded forecasts
as they stand) and ``sums`` (what a batch changes in the sums of a region, model, day and magnitude of the
actual). A revision takes the old contribution of its records out and puts the new one in, so a window is a few
sums, whatever was revised; the work of a batch follows the hours it touches. A batch reads earlier folders only and overwrites
its own: replays change nothing.

The result does not depend on the order of arrival: the newest capture of an hour or record counts (ties: the greatest), a
revision that came before its record applies to it, an older one that comes late does not. Not positive
revisions and those equal at two decimals change nothing.

Windows need the median of their actuals (low ones are left out). The sums tell in which magnitude it
lies; only that magnitude, the one of the threshold and the window's first, partial day are read as records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.cleaning import LOW_ACTUAL_FRACTION, keep_lead
from loadstone.operators.drift import HEADLINE_LEAD, WINDOW_7D, WINDOW_30D
from loadstone.streaming.late import earlier, latest, write_batch

HOUR = ["region", "ts"]
KEYS = ["region", "model"]
RECORD = ["captured_at", "predicted", "first_actual", "lead_hours", "placeholder"]
SUMS = ["n_all", "n", "ape", "smape", "far", "unknown", "placeholder", "placeholder_unknown"]
MAGNITUDES = 8  # to a doubling
DAY = 86400


def magnitude(v: Column) -> Column:
    return F.when(F.abs(v) > 0, F.floor(F.log2(F.abs(v)) * MAGNITUDES)).otherwise(-100_000).cast("int")


def _day() -> Column:
    return F.floor(F.unix_timestamp("ts") / DAY)


def _contributions(records: DataFrame, max_lead: int | None, *by: str) -> DataFrame:
    """Sums over records, those of the kept lead apart."""
    ok = keep_lead(max_lead) if max_lead is not None else F.lit(True)
    one = lambda c: F.sum(F.col("_sign") * c.cast("long"))
    return records.groupBy(*KEYS, *by, magnitude(F.col("actual")).alias("magnitude")).agg(
        F.sum("_sign").cast("long").alias("n_all"), one(ok).alias("n"),
        F.sum(F.when(ok, F.col("_sign") * mt.ape())).alias("ape"), F.sum(F.when(ok, F.col("_sign") * mt.smape_row())).alias("smape"),
        one(~ok).alias("far"), one(F.col("lead_hours").isNull()).alias("unknown"),
        one(ok & F.coalesce("placeholder", F.lit(False))).alias("placeholder"), one(ok & F.col("placeholder").isNull()).alias("placeholder_unknown"))


def regrade_batch(path: str, max_lead: int | None = HEADLINE_LEAD) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for rows (region, model, ts, predicted, actual, lead_hours, placeholder, captured_at);
    a row without a model revises the actual of its hour."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        number_column = F.lit(0).cast("long").alias("batch_id")
        revised = batch.filter(F.col("model").isNull() & (F.col("actual") > 0)).groupBy(*HOUR).agg(F.max(F.struct("captured_at", "actual")).alias("r")).select(*HOUR, "r.*")
        revised_before = earlier(spark, f"{path}/revisions", number, revised.select("*", number_column)).drop("batch_id")
        revised = write_batch(revised, f"{path}/revisions", number)
        came = batch.filter(F.col("model").isNotNull()).withColumnRenamed("actual", "first_actual")
        came = came.select(*KEYS, "ts", F.struct(*RECORD).alias("r"))
        touched = revised.select(*HOUR).unionByName(came.select(*HOUR)).distinct()

        shape = came.select(*KEYS, "ts", "r.*").select("*", F.col("first_actual").alias("actual"), F.lit(None).cast("double").alias("shift_pct"), number_column)
        old = latest(earlier(spark, f"{path}/records", number, shape).join(touched, HOUR, "left_semi"), [*KEYS, "ts"])
        view = revised_before.join(touched, HOUR, "left_semi").unionByName(revised).groupBy(*HOUR).agg(F.max(F.struct("captured_at", "actual")).alias("v"))
        one = old.select(*KEYS, "ts", F.struct(*RECORD).alias("r")).unionByName(came).groupBy(*KEYS, "ts").agg(F.max("r").alias("r")).select(*KEYS, "ts", "r.*")
        new = F.col("v.actual")
        moved = F.coalesce(F.round(new, 2) != F.round("first_actual", 2), F.lit(False))
        graded = one.join(view, HOUR, "left").select(
            *KEYS, "ts", *RECORD, F.when(moved, new).otherwise(F.col("first_actual")).alias("actual"), F.when(moved, F.abs(new - F.col("first_actual")) / new * 100).alias("shift_pct"))
        was = old.select(*KEYS, "ts", F.struct(*RECORD, "actual", "shift_pct").alias("_was"))
        fresh = graded.join(was, [*KEYS, "ts"], "left").filter(~F.struct(*RECORD, "actual", "shift_pct").eqNullSafe(F.col("_was")))
        fresh = write_batch(fresh.drop("_was"), f"{path}/records", number)
        gone = old.join(fresh.select(*KEYS, "ts"), [*KEYS, "ts"], "left_semi")
        signed = fresh.withColumn("_sign", F.lit(1)).unionByName(gone.select(*fresh.columns).withColumn("_sign", F.lit(-1)))
        write_batch(_contributions(signed.withColumn("day", _day()), max_lead, "day"), f"{path}/sums", number)

    return run


def regrade_stream(rows: DataFrame, path: str, max_lead: int | None = HEADLINE_LEAD) -> str:
    """Run a stream over what is available."""
    q = rows.writeStream.foreachBatch(regrade_batch(path, max_lead)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Graded forecasts as they stand, with the shift of those a revision moved."""
    return latest(spark.read.parquet(f"{path}/records"), [*KEYS, "ts"])


def regraded_stats(records: DataFrame) -> DataFrame:
    return records.groupBy(*KEYS).agg(F.count("shift_pct").alias("n_regraded"), F.avg("shift_pct").alias("mean_abs_shift_pct"), F.max("shift_pct").alias("max_abs_shift_pct"))


def rolling_sums(spark: SparkSession, path: str, now: Column, max_lead: int | None = HEADLINE_LEAD, fraction: float = LOW_ACTUAL_FRACTION) -> DataFrame:
    """7- and 30-day error per region and model: the columns of ``drift.rolling_block``, from the sums."""
    spans = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(h).alias("hours")) for n, h in (("7d", WINDOW_7D), ("30d", WINDOW_30D))])
    start = F.unix_timestamp(now) - F.col("hours") * 3600
    whole_from = F.ceil(start / DAY)  # first day that lies in the window from its start
    at = [*KEYS, "span"]
    sums, records = spark.read.parquet(f"{path}/sums"), read_records(spark, path)
    days = sums.select("*", F.inline(spans)).filter(F.col("day") >= whole_from)
    window = records.select("*", F.inline(spans), _day().alias("day")).filter(F.unix_timestamp("ts") >= start)
    edge = _contributions(window.filter(F.col("day") < whole_from).withColumn("_sign", F.lit(1)), max_lead, "span")
    add = [F.sum(c).alias(c) for c in SUMS]
    totals = days.select(*at, "magnitude", *SUMS).unionByName(edge.select(*at, "magnitude", *SUMS)).groupBy(*at, "magnitude").agg(*add)

    # The median: the magnitudes that hold the middle ranks, then their records in order.
    ok = keep_lead(max_lead) if max_lead is not None else F.lit(True)
    up = Window.partitionBy(*at).orderBy("magnitude")  # a row a magnitude
    ranked = totals.withColumn("_upto", F.sum("n").over(up)).withColumn("_m", F.sum("n").over(Window.partitionBy(*at)))
    low, high = F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1  # the middle ranks, from 1
    middle = ranked.filter((F.col("n") > 0) & (F.col("_upto") >= low) & (F.col("_upto") - F.col("n") < high)).select(*at, "magnitude", (F.col("_upto") - F.col("n")).alias("_before"), low.alias("_low"), high.alias("_high"))
    near = window.filter(ok).select(*at, F.abs("actual").alias("v"), magnitude(F.col("actual")).alias("magnitude")).join(middle, [*at, "magnitude"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*at, "magnitude").orderBy("v"))
    median = near.select(*at, "v", "_low", "_high", place.alias("_r")).filter("_r IN (_low, _high)").groupBy(*at).agg((F.avg("v") * fraction).alias("least"))

    # Magnitudes beside the threshold's count whole, that one record by record.
    split = totals.join(median, at, "left").withColumn("_t", magnitude(F.col("least")))
    beside = split.filter(F.col("_t").isNull() | (F.col("magnitude") != F.col("_t"))).withColumn("_ok", F.coalesce(F.col("magnitude") > F.col("_t"), F.lit(False)))
    cut = window.join(median, at).filter(magnitude(F.col("actual")) == magnitude(F.col("least"))).withColumn("_ok", F.abs("actual") >= F.col("least")).withColumn("_sign", F.lit(1))
    parts = beside.select(*at, "_ok", *SUMS).unionByName(_contributions(cut, max_lead, "span", "_ok").select(*at, "_ok", *SUMS))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("_ok"), F.col(c))), F.lit(0))
    per = parts.groupBy(*at).agg(
        F.try_divide(F.sum(F.when(F.col("_ok"), F.col("ape"))), kept("n")).alias("mape"), F.try_divide(F.sum(F.when(F.col("_ok"), F.col("smape"))), kept("n")).alias("smape"),
        kept("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("n"))), F.lit(0)).alias("low_actual_excluded"), F.sum("far").alias("lead_excluded"),
        F.sum("unknown").alias("lead_unknown"), kept("placeholder").alias("anchor_placeholder"), kept("placeholder_unknown").alias("anchor_unknown"))

    def pick(c, span):
        return F.max(F.when(F.col("span") == span, F.col(c)))

    wide = per.groupBy(*KEYS).agg(
        *[pick(m, s).alias(f"rolling_{m}_{s}") for m in ("smape", "mape") for s in ("7d", "30d")],
        *[F.coalesce(pick("n", s), F.lit(0)).alias(f"n_{s}") for s in ("7d", "30d")],
        *[F.coalesce(pick(c, "7d"), F.lit(0)).alias(f"n_{c}_7d") for c in ("low_actual_excluded", "lead_excluded", "lead_unknown", "anchor_placeholder", "anchor_unknown")])
    return sums.groupBy(*KEYS).agg(F.sum("n_all").alias("n_records")).join(wide, KEYS, "left")
