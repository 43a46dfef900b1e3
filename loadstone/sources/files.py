"""Partitioned parquet, JSON and CSV readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEMAND = "region STRING, ts TIMESTAMP, demand_mw DOUBLE, forecast_mw DOUBLE"
METADATA = "region STRING, model STRING, version STRING, trained_at TIMESTAMP, mape DOUBLE, train_rows BIGINT"
TICKS = "tick TIMESTAMP, elapsed_s DOUBLE, phases MAP<STRING, STRUCT<total_s: DOUBLE, n: BIGINT>>"


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ("region",), mode: str = "overwrite") -> None:
    """One folder per region; rows of a hot region may fill several files."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, regions: Sequence[str] | None = None) -> DataFrame:
    """Typed scan; a region list prunes partitions, a missing table is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path).select(*T.StructType.fromDDL(schema).names)
    return df.filter(F.col("region").isin(list(regions))) if regions is not None else df


def json_rows(reader, schema: str, required: Sequence[str], path: str) -> DataFrame:
    """Every JSON document below ``path`` with ``rejected``: null, or why it is no row (``unreadable``, ``missing <column>``).

    ``reader`` is ``spark.read`` or ``spark.readStream`` with its options. The text of an unreadable one is in
    ``raw``, the file in ``source``; nothing is dropped.
    """
    fields = T.StructType.fromDDL(schema)
    df = reader.schema(T.StructType([*fields, T.StructField("raw", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").json(path)
    why = F.coalesce(F.when(F.col("raw").isNotNull(), "unreadable"), *[F.when(F.col(c).isNull(), f"missing {c}") for c in required])
    return df.select(*fields.names, "raw", F.col("_metadata.file_path").alias("source"), why.alias("rejected"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("rejected IS NULL").drop("rejected", "raw", "source")


def rejections(rows: DataFrame) -> DataFrame:
    """Dead letters by reason."""
    return rows.filter("rejected IS NOT NULL").groupBy(F.col("rejected").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("files"))


def scan_metadata(spark: SparkSession, path: str, names: str = "*.meta.json", lines: bool = False) -> DataFrame:
    """All metadata documents below ``path``, one a file or (``lines``) one a line; see ``json_rows`` for what is no row."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("multiLine", str(not lines).lower())
    return json_rows(reader, METADATA, ["region", "model"], path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The readable metadata files below ``path``."""
    return accepted(scan_metadata(spark, path))


def scan_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Timing log lines below ``path``; see ``json_rows``."""
    return json_rows(spark.read, TICKS, ["tick", "phases"], path)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return accepted(scan_ticks(spark, path))


def metrics_long(wide: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("region", "model")) -> DataFrame:
    """One row per region, model and metric; absent metrics are left out."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value").filter("value IS NOT NULL")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)
