"""Sinks shared by the streaming operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadstone.session import scratch_path


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream over a parquet folder (or one parquet file)."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def update_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every batch's changed rows with its batch number.

    A batch replayed after a failure overwrites its own folder, so the log stays
    exactly-once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """Newest logged row per key."""
    log = spark.read.parquet(path)
    rest = [c for c in schema.names if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def drain(stream: DataFrame, name: str, keys: Sequence[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over what is available and return its final table."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    q = update_log(stream, out, check, mode)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if keys is None:
        return spark.read.parquet(out).select(*stream.columns)
    return read_latest(spark, out, stream.schema, keys)


def staged(df: DataFrame, name: str) -> str:
    """Write a batch table to the shared folder, as the input of a file stream."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def dead_letters(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Two sinks of one stream: rows whose ``rejected`` is null go to ``path/good``, the others with their reason to ``path/rejected``.

    Each batch overwrites its own folders, so a replay changes nothing and both sides always add up.
    """
    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.filter("rejected IS NULL").drop("rejected").write.mode("overwrite").parquet(f"{path}/good/batch_id={number}")
        held.filter("rejected IS NOT NULL").write.mode("overwrite").parquet(f"{path}/rejected/batch_id={number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
