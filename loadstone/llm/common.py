"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.session import scratch_path

WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there.

    Parquet rather than ``checkpoint()``: it is compressed, and later reads take
    only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit row key of id and text; identical rows share it, and every result of one holds for the other."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str | None = None, size: int = BLOCK_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function as a mapInArrow function; empty batches are passed over.

    With ``column`` the function sees slices of about ``size`` bytes of that text column, as it holds
    several numbers for each byte or word; only a single longer text makes a larger slice.
    """

    def run(batches):
        for b in batches:
            for part in blocks(b, column, BLOCK_ROWS, size) if column else [b]:
                if part.num_rows:
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out

    return run


def carried(docs: DataFrame, columns: list[str], made: str) -> tuple[list[Column], T.StructType, list[Column]]:
    """Columns taken through a mapInArrow function under names that cannot clash: what to select
    before it, its schema with the columns ``made`` (DDL) after them, and what to select after it.
    A carried column named like a made one gives way."""
    made_fields = T.StructType.fromDDL(made).fields
    names = {f.name for f in made_fields}
    fields = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
    after = [F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c not in names]
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)], T.StructType(fields + made_fields), after + [F.col(f.name) for f in made_fields]


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and the concatenated UTF-8 bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def blocks(batch: pa.RecordBatch, column: str, rows_: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows_`` rows and, but for a single longer text, ``size`` bytes of a string column."""
    offsets, _ = flat_bytes(batch[column])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), at + rows_, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def binary_array(raw: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column over one buffer."""
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(raw))])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shards_for(rows_: int, per_shard: int, least: int) -> int:
    """Partitions so that each holds about ``per_shard`` rows."""
    return max(least, math.ceil(rows_ / per_shard))


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
