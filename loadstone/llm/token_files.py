"""Token ids as Parquet list columns, and selective reads of them.

Documents are range-partitioned by id and sorted, so file k holds ids before file k + 1 and a
document's place in the whole token stream follows from small columns alone. ``ids`` is a
dictionary-encoded list column (a row group has far fewer distinct ids than ids); ``doc_id`` and
``n_tokens`` are delta-encoded by the version 2 writer. Row groups are kept small and pages
are cut by rows, so the page index lets a reader skip to a few documents, and readers of
counts never touch the ids.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal id
stay apart and follow each other in file order; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadstone.llm.common import rows
from loadstone.llm.tokens import encoder, text_groups

END_ID = 2
ROW_GROUP_BYTES = 8 << 20
PAGE_ROWS = 512
WRITE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "compression": "zstd",
}


def _encode(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for first, texts in text_groups(b["text"]):
                parts = [x + end for x in enc.encode(texts)]
                sizes = np.array([len(x) // 4 for x in parts])
                flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                yield pa.record_batch({"doc_id": b["doc_id"].slice(first, len(texts)), "n_tokens": pa.array(sizes.astype(np.int64)), "ids": ids})

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write (doc_id, n_tokens, ids) in ascending id order."""
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode(tokenizer, end_id), f"doc_id {kind}, n_tokens long, ids array<int>").write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The written rows; filters on ``doc_id`` reach the page index, and only chosen columns are read."""
    return spark.read.schema(f"doc_id {kind}, n_tokens long, ids array<int>").parquet(path)


def _checksums(b: pa.RecordBatch) -> pa.RecordBatch:
    ids = b["ids"]
    offsets = ids.offsets.to_numpy()
    flat = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4"))).cast("B")
    crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(offsets[:-1], offsets[1:])]
    sizes = np.diff(offsets).astype(np.int64)
    return pa.record_batch({"doc_id": b["doc_id"], "file": b["file"], "row": b["row"], "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})


def file_order(column: str) -> list[Column]:
    """Order of written files: by part number, which outgrows its five padded digits, then by name."""
    return [F.regexp_extract(column, r"^part-(\d+)", 1).cast("long"), F.col(column)]


def token_index(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Starts are running sums inside a file plus the totals of the files before it; the totals are one row a file.
    """
    files = read_tokens(spark, path, kind)
    read = files.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    light = read.mapInArrow(rows(_checksums), f"doc_id {kind}, file string, row long, n_tokens long, ids_crc32 long")
    totals = files.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy(*file_order("file"))) - F.col("total")).alias("before"))
    inside = light.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")))
    return inside.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
