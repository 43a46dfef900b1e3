"""Keyed streams whose result does not depend on the order or the cut of their batches.

Every batch adds its rows to the chunks they belong to. Summaries of those chunks are made anew, what each chunk of the
touched keys takes over is worked out on the summaries (one row a chunk), and decided anew are only the rows of
chunks that got rows or take over something else than before. A late row so re-decides what comes after it, as far as it
changes anything; a decision that no longer holds is logged as retracted.

Four logs lie below ``path``: ``rows``, ``chunks``, ``decided`` and ``retracted``, each with one folder a batch. A batch reads folders
of earlier batches only and overwrites its own, so one replayed after a failure changes nothing. Chunks are dealt out
by key and chunk: a hot key is spread over tasks. No Python runs in the tasks.

Rows are known by keys and time; of several with the same, the greatest by its other columns counts, whenever it comes.
Rows without a time are not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.operators import scans
from loadstone.operators.ensemble import EWMA_ALPHA, usable
from loadstone.operators.scans import CHUNK, Fold
from loadstone.operators.series import newest
from loadstone.session import scratch_path

CHUNK_SECONDS = 30 * 86400
SPAN = 8  # chunks to a folder of rows
FOLDERS = 1000
ORDER = "_t"
MAX_SNAPSHOTS = 30


def earlier(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame:
    """What batches before ``number`` wrote; nothing yet at the first one. A later batch without it has lost its history and fails."""
    if number == 0:
        return like.limit(0)
    fields = [f for f in like.schema.fields if f.name != "batch_id"]
    schema = T.StructType([*fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch_id") < number)


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key what the newest batch wrote."""
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def write_batch(df: DataFrame, path: str, number: int, *by: str) -> DataFrame:
    """The batch's own folder, written anew and read back."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={number}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch_id={number}")


def fold_batch(path: str, keys: Sequence[str], time: str, fold: Fold, chunk_seconds: int = CHUNK_SECONDS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that folds a batch into the logs below ``path``."""
    keys, micros = list(keys), chunk_seconds * 1_000_000

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        payload = [c for c in batch.columns if c not in (*keys, time)]
        results, ids = list(fold.decide), [*keys, ORDER, CHUNK]

        def one_a_time(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*ids).agg(F.max(F.struct(*[F.col(c) for c in payload])).alias("r")).select(*ids, F.col("r.*")) if payload else rows.select(*ids).distinct()

        came = batch.filter(F.col(time).isNotNull()).withColumn(ORDER, F.unix_micros(time)).withColumn(CHUNK, F.floor(F.col(ORDER) / micros)).select(*ids, *payload)
        came = one_a_time(came).withColumn("_span", F.floor(F.col(CHUNK) / SPAN))
        known = earlier(spark, f"{path}/rows", number, came.withColumn("batch_id", F.lit(0).cast("long"))).drop("batch_id")
        came = write_batch(came, f"{path}/rows", number, "_span")
        touched = came.select(*keys, CHUNK).distinct()

        def rows_of(chunks: DataFrame) -> DataFrame:
            """All rows of some chunks, earlier and new; only their folders are read where they are few."""
            spans = [r[0] for r in chunks.select(F.floor(F.col(CHUNK) / SPAN)).distinct().limit(FOLDERS + 1).collect()]
            some = known.filter(F.col("_span").isin(spans)) if len(spans) <= FOLDERS else known
            both = some.join(chunks.select(*keys, CHUNK), [*keys, CHUNK], "left_semi").unionByName(came.join(chunks.select(*keys, CHUNK), [*keys, CHUNK], "left_semi"))
            return scans.inside(one_a_time(both.drop("_span")), keys, ORDER, fold)

        summaries = scans.summarise(rows_of(touched), keys, ORDER, fold)
        carried = F.struct(*[F.col(c) for c in fold.carried]).alias("carried")
        empty = fold.carry(summaries, keys).select(*summaries.columns, carried)
        before = latest(earlier(spark, f"{path}/chunks", number, empty.withColumn("batch_id", F.lit(0).cast("long"))), [*keys, CHUNK])
        before = before.join(touched.select(*keys).distinct(), keys, "left_semi")
        sums = before.drop("carried").join(touched, [*keys, CHUNK], "left_anti").unionByName(summaries)
        now = fold.carry(sums, keys).select(*sums.columns, carried)
        was = before.select(*keys, CHUNK, F.col("carried").alias("_was"), F.lit(True).alias("_stored"))
        new = now.join(was, [*keys, CHUNK], "left").join(touched.withColumn("_new", F.lit(True)), [*keys, CHUNK], "left")
        changed = new.filter(F.col("_new").isNotNull() | F.col("_stored").isNull() | ~F.col("carried").eqNullSafe(F.col("_was"))).drop("_was", "_stored", "_new")
        chunks = write_batch(changed.select(empty.columns), f"{path}/chunks", number)

        carry = chunks.select(*keys, CHUNK, "carried.*")
        out = rows_of(chunks).join(carry, [*keys, CHUNK]).select(*ids, *payload, *[c.alias(n) for n, c in fold.decide.items()])
        old = earlier(spark, f"{path}/decided", number, out.withColumn("batch_id", F.lit(0).cast("long"))).join(chunks.select(*keys, CHUNK), [*keys, CHUNK], "left_semi")
        old = latest(old, ids).select(*ids, F.struct(*payload, *results).alias("_was"))
        fresh = out.join(old, ids, "left").filter(F.col("_was").isNull() | ~F.struct(*payload, *results).eqNullSafe(F.col("_was")))
        decided = write_batch(fresh.select(out.columns), f"{path}/decided", number)
        gone = decided.select(*ids).join(old, ids).select(*ids, F.col("_was.*"))
        write_batch(gone, f"{path}/retracted", number)

    return run


def read_decided(spark: SparkSession, path: str, keys: Sequence[str], time: str, log: str = "decided") -> DataFrame:
    """The decisions that hold: every row once, with its newest result. ``log="retracted"``: all that were taken back."""
    rows = spark.read.parquet(f"{path}/{log}")
    if log == "decided":
        rows = latest(rows, [*keys, ORDER, CHUNK])
    return rows.select(*keys, F.timestamp_micros(ORDER).alias(time), *[c for c in rows.columns if c not in (*keys, ORDER, CHUNK)])


def fold_stream(stream: DataFrame, keys: Sequence[str], time: str, fold: Fold, name: str, chunk_seconds: int = CHUNK_SECONDS, path: str | None = None) -> str:
    """Run a stream over what is available; the path of its logs."""
    path = path or scratch_path(stream.sparkSession, name)
    write = stream.writeStream.foreachBatch(fold_batch(path, keys, time, fold, chunk_seconds)).option("checkpointLocation", f"{path}-state")
    write.trigger(availableNow=True).start().awaitTermination()
    return path


def _folded(stream: DataFrame, keys: list[str], time: str, fold: Fold, name: str, chunk_seconds: int, path: str | None) -> DataFrame:
    return read_decided(stream.sparkSession, fold_stream(stream, keys, time, fold, name, chunk_seconds, path), keys, time)


def monotone_origins(forecasts: DataFrame, chunk_seconds: int = CHUNK_SECONDS, path: str | None = None) -> DataFrame:
    """Forecasts (region, made_at, origin) served: their origin is not before one made earlier."""
    out = _folded(forecasts.select("region", "made_at", "origin"), ["region"], "made_at", scans.monotone("origin"), "origins", chunk_seconds, path)
    return out.filter("served").select("region", "made_at", "origin")


def snapshot_fifo(snaps: DataFrame, cap: int = MAX_SNAPSHOTS, chunk_seconds: int = CHUNK_SECONDS, path: str | None = None) -> DataFrame:
    """The newest ``cap`` snapshots (series, scored_at, hash) of every series, one equal to the one before it left out."""
    out = _folded(snaps.select("series", "scored_at", "hash"), ["series"], "scored_at", scans.changes("hash"), "fifo", chunk_seconds, path)
    kept = newest(out.filter("kept").drop("kept"), ["series"], "scored_at", cap)
    entries = F.sort_array(F.collect_list(F.struct("scored_at", "hash")))  # at most cap
    return kept.groupBy("series").agg(entries.alias("e")).select("series", F.col("e.scored_at").alias("scored_at"), F.col("e.hash").alias("hashes"))


def carried_ewma(scores: DataFrame, alpha: float = EWMA_ALPHA, chunk_seconds: int = CHUNK_SECONDS, path: str | None = None) -> DataFrame:
    """Scores (series, trained_at, mape) with the smoothed error up to each."""
    return _folded(scores.select("series", "trained_at", "mape"), ["series"], "trained_at", scans.smoothing("mape", usable("mape"), alpha), "ewma", chunk_seconds, path)


def breach_streaks(runs: DataFrame, alert_at: int = 3, chunk_seconds: int = CHUNK_SECONDS, path: str | None = None) -> DataFrame:
    """Runs (series, run_at, breached) with the consecutive breaches up to each, and the alert."""
    return _folded(runs.select("series", "run_at", "breached"), ["series"], "run_at", scans.streaks("breached", alert_at), "streaks", chunk_seconds, path)
