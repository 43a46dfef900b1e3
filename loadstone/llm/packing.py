"""Harmonic packing of documents into sequences of fixed capacity.

A piece of length n belongs to class k = capacity // n, the reciprocal-capacity class
(capacity / (k + 1), capacity / k]; a bin of class k takes exactly k pieces. Every task fills
its own bins, one open bin a class, with nothing to agree on between tasks and no
shuffle. A document first fills whole sequences by itself; its rest is cut at multiples of
``GRAIN`` into powers of two, whose bins have no waste, and one short tail, whose bin wastes less
than a tail. When a task ends, the pieces of its open bins are laid end to end and cut at
the capacity and then at powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.llm.tokens import encoder, text_groups

CAPACITY = 2048
GRAIN = 64
END_ID = 1
TASK_BITS = 33


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    bit = capacity >> 1
    while bit >= GRAIN:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    if rest & (GRAIN - 1):
        out.append(rest & (GRAIN - 1))
    return out


def end_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths that hold ``total`` tokens with no padding."""
    return [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if (total % capacity) >> b & 1]


class Packer:
    """Open bins of one task; pieces are (row, start, length, ids)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = {}
        self.sequence = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for row, start, ids in pieces:
            n = len(ids) // 4
            self.done.append((*row, start, n, ids, self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, row: tuple, ids: bytes) -> None:
        start = 0
        for n in cuts(len(ids) // 4, self.capacity):
            piece = (row, start, ids[4 * start : 4 * (start + n)])
            start += n
            k = self.capacity // n
            if k == 1:
                self._close([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self._close(held)
                self.open[k] = []

    def finish(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        for size in end_lengths(sum(len(p[2]) // 4 for p in left), self.capacity):
            taken: list = []
            while size:
                row, start, ids = left.pop(0)
                n = min(size, len(ids) // 4)
                taken.append((row, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.insert(0, (row, start + n, ids[4 * n :]))
                size -= n
            self._close(taken)
        self.open = {}


def _pack(tokenizer: str, end_id: int, capacity: int, id_type: pa.DataType):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, packer = encoder(tokenizer), Packer(capacity)
        base = TaskContext.get().partitionId() << TASK_BITS

        def ready():
            d, total, start, n, ids, seq, at = zip(*packer.done)
            packer.done = []
            return pa.record_batch({
                "doc_id": pa.array(d, id_type), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()),
                "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(np.array(seq, np.int64) + base), "offset": pa.array(at, pa.int64()),
            })

        for b in batches:
            for first, texts in text_groups(b["text"]):
                keys = b["doc_id"].slice(first, len(texts)).to_pylist()
                for key, ids in zip(keys, enc.encode(texts)):
                    ids += end
                    packer.add((key, len(ids) // 4), ids)
                if packer.done:
                    yield ready()
        packer.finish()
        if packer.done:
            yield ready()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    import pyspark.sql.pandas.types as at

    id_type = at.to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pack(tokenizer, end_id, capacity, id_type),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
