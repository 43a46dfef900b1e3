"""Vintage table kept up to date by a stream of readings.

The state is a table partitioned by target period (a week unless said otherwise).
A batch folds its readings into the periods it touches and writes them as a new
version of those only, so the work follows the batch and all of it stays in the
JVM. A replayed batch overwrites its own version; older versions are removed by
``drop_superseded``, and a stream that starts anew over an old table is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadstone.operators.vintage import COLUMNS, KEYS, RETENTION_HOURS, vintages

SCHEMA = ("region STRING, target_ts TIMESTAMP, first_seen_d DOUBLE, first_seen_df DOUBLE, captured_at TIMESTAMP, last_d DOUBLE, "
          "n_updates BIGINT, df_at TIMESTAMP, period BIGINT, version BIGINT")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of every period, from the folder names; one name a period and kept version."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/period=*/version=*")
    found: dict[int, list[int]] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        period, version = (int(part.split("=")[1]) for part in status.getPath().toString().split("/")[-2:])
        found.setdefault(period, []).append(version)
    return found


def read_vintages(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Newest version of every period (only versions below ``before`` if given).

    Only the files of those versions are listed and read.
    """
    live = {p: [v for v in vs if before is None or v < before] for p, vs in _versions(spark, path).items()}
    folders = [f"{path}/period={p}/version={max(vs)}" for p, vs in sorted(live.items()) if vs]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(*folders)


def drop_superseded(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions of every period (the second serves a replay of the last batch)."""
    gone = [f"{path}/period={p}/version={v}" for p, vs in _versions(spark, path).items() for v in sorted(vs)[:-keep]]
    for folder in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def _period(days: int):
    return F.floor(F.unix_timestamp("target_ts") / (86400 * days))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fold_batch(path: str, days: int = 7, marker: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that folds a batch into the table.

    A batch numbered below a version already there means that the stream's checkpoint was lost:
    folding it would pin today's values as first-seen, so it is refused. ``marker`` is a path kept
    apart from the table, written once the table holds a version; while it is there, a table
    without versions means the history was lost, and the batch is refused as well. A batch that
    ends between table and marker is replayed, which writes the same version and then the marker.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = max((v for vs in _versions(spark, path).values() for v in vs), default=-1)
        if newest < 0 and marker is not None and _exists(spark, marker):
            raise RuntimeError(f"{path} has no version although {marker} says it was written; refusing to reseed")
        if newest > number:
            raise RuntimeError(f"batch {number} is older than version {newest} of {path}: the stream has lost its checkpoint")
        touched = batch.select(_period(days).alias("period")).distinct()
        prior = read_vintages(spark, path, number).join(touched, "period", "left_semi").select(*KEYS, *COLUMNS)
        out = vintages(batch, prior).withColumn("period", _period(days)).withColumn("version", F.lit(number).cast("long"))
        # Rebalanced by size: a heavy period is split over tasks, light ones share one.
        out.hint("rebalance", "period").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("period", "version").parquet(path)
        if marker is not None and not _exists(spark, marker) and _versions(spark, path):
            spark.range(1).write.mode("overwrite").parquet(marker)

    return run


def live_window(spark: SparkSession, path: str, now, retention_hours: int = RETENTION_HOURS) -> DataFrame:
    """Vintages whose target hour is inside the retention window."""
    return read_vintages(spark, path).filter(F.col("target_ts") >= now - F.make_dt_interval(F.lit(0), F.lit(retention_hours))).select(*KEYS, *COLUMNS)


def vintage_stream(readings: DataFrame, path: str, checkpoint: str, days: int = 7, marker: str | None = None) -> StreamingQuery:
    return readings.writeStream.foreachBatch(fold_batch(path, days, marker)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
