"""Suffix-array dedup: remove bytes of strings that also start elsewhere.

The suffixes that can matter are gathered in shards (``repeats``) and each shard is sorted by
bucket-pointer refinement: suffixes start in buckets of their first ``Q`` bytes, and a bucket
is split by the bucket pointers of its suffixes ``h`` bytes on, so each round doubles the
length the pointers stand for. A sub-bucket takes its place inside the parent bucket, which
leaves all other pointers valid; the next round reads the updated pointers. Suffixes alone in
their bucket are never sorted again. Refinement stops at ``length``: suffixes then sharing a
bucket are equal windows.

Defined cases: a null text is empty; texts shorter than ``length`` bytes lose nothing; overlapping
repeats (a run of one letter) count; rows that are copies of each other lose all they
share, as every string of them starts elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.llm import grams, repeats
from loadstone.llm.common import carried, flat_bytes, rows, text_key

LENGTH = 200
GRAM = 64
Q = 8
SHARD_BYTES = 1 << 19
EXTRACT_BYTES = 1 << 18  # of texts whose pieces, which overlap, are cut out at once


def refine(pointer: np.ndarray, members: np.ndarray, ahead: int) -> np.ndarray:
    """Split the buckets of ``members`` by the pointers ``ahead`` further on, in place; those still in company."""
    own, later = pointer[members], pointer[members + ahead]
    order = np.lexsort((later, own))
    m, own, later = members[order], own[order], later[order]
    new_bucket = np.ones(len(m), bool)
    new_bucket[1:] = own[1:] != own[:-1]
    new_part = new_bucket.copy()
    new_part[1:] |= later[1:] != later[:-1]
    place = np.arange(len(m))
    bucket_at = np.maximum.accumulate(np.where(new_bucket, place, 0))
    part_at = np.maximum.accumulate(np.where(new_part, place, 0))
    pointer[m] = own + (part_at - bucket_at)
    alone = new_part & np.append(new_part[1:], True)
    return m[~alone]


def equal_windows(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(all starts of windows inside a piece, whether the window starts twice) of one shard."""
    n = len(text)
    piece_end = np.repeat(ends, ends - begins)
    room = piece_end - np.arange(n)
    h = min(Q, length)
    key = np.zeros(max(n - h + 1, 0), np.uint64)
    for k in range(h):
        key = (key << np.uint64(8)) | text[k : k + len(key)].astype(np.uint64)
    at = np.flatnonzero(room[: len(key)] >= h)
    order = np.argsort(key[at], kind="stable")
    at, sorted_key = at[order], key[at][order]
    new = np.ones(len(at), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    pointer = np.full(n, -1, np.int64)
    pointer[at] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    members = at[~(new & np.append(new[1:], True))] if len(at) else at
    while h < length and len(members):
        ahead = min(h, length - h)
        members = refine(pointer, members[room[members] >= h + ahead], ahead)
        h += ahead
    twice = np.zeros(n, bool)
    twice[members[room[members] >= length]] = True
    starts = np.flatnonzero(room >= length)
    return starts, twice[starts]


def _cut(length: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["text"])
        return repeats.cell_batch(grams.cells(raw, offsets, length, min(GRAM, length), grams.BYTE_VALUES), b["rid"])

    return rows(batch, "text")


def _extract(length: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["text"])
        return repeats.piece_batch(b["wanted"], b["rid"], offsets[:-1], raw, length, grams.BYTE_VALUES)

    return rows(batch, "text", EXTRACT_BYTES)


def _index(length: int):
    def shard(batches):
        for t in repeats.whole_anchors(batches, SHARD_BYTES):
            t = t.combine_chunks()
            offsets, text = flat_bytes(t["symbols"])
            starts, twice = equal_windows(text, offsets[:-1], offsets[1:], length)
            piece = np.searchsorted(offsets, starts, "right") - 1
            twice &= t["copies"].to_numpy()[piece] == 1
            out = repeats.run_batch(twice, piece, starts - offsets[piece], t["rid"].to_numpy(), t["first"].to_numpy())
            if out is not None:
                yield out

    return shard


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, runs): starts of windows of ``length`` bytes that also start elsewhere, per document that has any."""
    return repeats.runs_by_row(repeats.repeated_runs(repeats.keyed(docs, id_col, text_col), _cut(length), _extract(length), _index(length)))


def covered(runs: pa.ListArray, begins: np.ndarray, length: int, total: int) -> np.ndarray:
    """Symbols of a batch covered by the windows of the runs."""
    counts = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten()
    if not len(flat):
        return np.zeros(total, bool)
    base = np.repeat(begins, counts)
    first, last = flat.field("first").to_numpy() + base, flat.field("last").to_numpy() + base + length
    depth = np.zeros(total + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    return np.cumsum(depth[:-1]) > 0


def _remove(length: int, decoded: bool = False):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["_text"])
        gone = covered(b["runs"].fill_null([]), offsets[:-1], length, len(raw))
        kept_to = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept = np.ascontiguousarray(raw[~gone])
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        spans_to = np.concatenate([[0], np.cumsum(gone & (edge[:-1] | ~np.append(False, gone[:-1])[: len(gone)]))])[offsets]
        view = memoryview(kept)
        out = {c: b[c] for c in b.schema.names if c not in ("runs", "_text")}
        out["n_bytes"] = np.diff(offsets)
        out["n_removed"] = np.diff(offsets) - np.diff(kept_to)
        out["n_spans"] = np.diff(spans_to)
        left = [bytes(view[a:z]) for a, z in zip(kept_to[:-1], kept_to[1:])]
        out |= {"kept_text": pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())} if decoded else {"kept": pa.array(left, pa.binary())}
        return pa.record_batch(out)

    return rows(batch, "_text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its remaining bytes.

    Returns ``carry`` (default the id) and n_bytes, n_removed, n_spans (long) and kept (binary:
    what is left may cut a character).
    """
    return _removed(docs, length, id_col, text_col, [id_col] if carry is None else carry, False)


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, carry: list[str], decoded: bool) -> DataFrame:
    """As ``remove_repeats``; ``decoded``: with kept_text (string), what is left of whole characters, in place of kept."""
    runs = repeated_windows(docs, length, id_col, text_col)
    before, schema, after = carried(docs, carry, f"n_bytes long, n_removed long, n_spans long, {'kept_text string' if decoded else 'kept binary'}")
    texts = docs.select(*before, F.col(text_col).alias("_text"), text_key(id_col, text_col).alias("rid"))
    return texts.join(runs, "rid", "left").drop("rid").mapInArrow(_remove(length, decoded), schema).select(*after)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts less repeated bytes; a character that lost a byte goes whole. Other columns stay."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = _removed(whole, length, "_id", "_text", ["_row"], True)
    return out.select(*[(F.col("kept_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
