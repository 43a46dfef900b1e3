"""Substring dedup by matching statistics over compressed FM-indexes.

Documents are routed to shards by the anchors of their windows (``repeats``), so a streamed
piece meets only the shard that can hold its repeats. A shard's index is the Burrows-Wheeler
transform of its pieces in a wavelet matrix of packed bits with block counts: about
1.5 bits per symbol and level. Every piece is streamed backwards; its matching statistic at a
word is the length of the longest match ending there that occurs twice, found by
extending to the left while the interval keeps two suffixes. A statistic of ``length`` or more
reports its interval, and covers all earlier ends it reaches, so those are not searched.

Words are compared as 64-bit fingerprints. Defined cases: a null text has no words; texts under
``length`` words lose nothing; repeats inside one document and overlapping ones count; copied
rows lose all they share; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.llm import grams, repeats
from loadstone.llm.common import carried, flat_bytes, rows, spread_ranges, text_key
from loadstone.llm.suffix_array import covered, refine

LENGTH = 35
GRAM = 12
SHARD_BYTES = 1 << 21
EXTRACT_BYTES = 1 << 18  # of text at once; overlapping cells make several times as many bytes of symbols


class Bits:
    """A bit vector with constant-time rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class FMIndex:
    """Backward search over a text of symbols 1..k in which 0 ends each piece."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        ends = text == 0
        first = np.where(ends, np.cumsum(ends), ends.sum() + text.astype(np.int64))  # piece ends differ, so sorting stops there
        order = np.argsort(first, kind="stable")
        new = np.ones(n, bool)
        new[1:] = first[order][1:] != first[order][:-1]
        pointer = np.empty(n, np.int64)
        pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        members, h = order[~(new & np.append(new[1:], True))], 1
        while len(members):
            members = refine(pointer, members, h)
            h *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[pointer] = np.arange(n)
        bwt = text[suffixes - 1]
        counts = np.bincount(text, minlength=symbols + 1)
        start = np.zeros(symbols + 1, np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(int(symbols).bit_length() - 1, -1, -1):
            bit = (bwt >> shift & 1).astype(bool)
            level = Bits(bit)
            zeros = n - int(bit.sum())
            self.levels.append((shift, level, zeros))
            ones = level.rank(start)
            start = np.where(np.arange(symbols + 1) >> shift & 1, zeros + ones, start - ones)
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.base = np.cumsum(counts) - counts - start
        self.size = n

    def extend(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Interval bounds after putting symbol ``c`` before the match."""
        for shift, level, zeros in self.levels:
            ones = level.rank(at)
            at = np.where(c >> shift & 1, zeros + ones, at - ones)
        return self.base[c] + at


def shared_windows(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For pieces of a text of symbols (each followed by 0): which places start a window that occurs twice."""
    index = FMIndex(text, int(text.max()))
    twice = np.zeros(len(text), bool)
    piece = np.flatnonzero(ends - begins >= length)
    begin = begins[piece]
    stop = ends[piece].copy()
    at = stop.copy()
    lo, hi = np.zeros(len(piece), np.int64), np.full(len(piece), index.size, np.int64)
    while len(stop):
        c = text[np.maximum(at - 1, 0)]
        both = index.extend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        new_lo, new_hi = both[: len(c)], both[len(c) :]
        goes_on = (at > begin) & (new_hi - new_lo >= 2)
        lo, hi, at = np.where(goes_on, new_lo, 0), np.where(goes_on, new_hi, index.size), at - goes_on
        over = ~goes_on
        if over.any():
            extra = stop - at - length
            hit = over & (extra >= 0)
            twice[spread_ranges(at[hit], extra[hit] + 1)] = True
            stop = np.where(over, stop - np.maximum(extra, 0) - 1, stop)
            at = np.where(over, stop, at)
            left = stop - begin >= length
            if not left.all():
                begin, stop, at, lo, hi = begin[left], stop[left], at[left], lo[left], hi[left]
    return twice


def _cut(length: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["text"])
        w = grams.words(raw, offsets)
        return repeats.cell_batch(grams.cells(w.hash, w.offsets, length, min(GRAM, length)), b["rid"])

    return rows(batch, "text")


def _extract(length: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["text"])
        w = grams.words(raw, offsets)
        return repeats.piece_batch(b["wanted"], b["rid"], w.offsets[:-1], w.hash, length)

    return rows(batch, "text", EXTRACT_BYTES)


def _index(length: int):
    def shard(batches):
        for t in repeats.whole_anchors(batches, SHARD_BYTES):
            t = t.combine_chunks()
            offsets, raw = flat_bytes(t["symbols"])
            _, ids = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
            sizes = np.diff(offsets) // 8
            begins = np.cumsum(sizes + 1) - sizes - 1
            text = np.zeros(int((sizes + 1).sum()), np.int64)
            text[spread_ranges(begins, sizes)] = ids + 1
            twice = shared_windows(text, begins, begins + sizes, length)
            room = np.maximum(sizes - length + 1, 0)
            starts = spread_ranges(begins, room)
            piece = np.repeat(np.arange(len(sizes)), room)
            hit = twice[starts] & (t["copies"].to_numpy()[piece] == 1)
            out = repeats.run_batch(hit, piece, starts - begins[piece], t["rid"].to_numpy(), t["first"].to_numpy())
            if out is not None:
                yield out

    return shard


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, runs): starts of windows of ``length`` words that also start elsewhere, per document that has any."""
    return repeats.runs_by_row(repeats.repeated_runs(repeats.keyed(docs, id_col, text_col), _cut(length), _extract(length), _index(length)))


def _remove(length: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = flat_bytes(b["_text"])
        w = grams.words(raw, offsets)
        gone = covered(b["runs"].fill_null([]), w.offsets[:-1], length, len(w.start))
        kept_to = np.concatenate([[0], np.cumsum(~gone)])[w.offsets]
        s, e = w.start[~gone], w.end[~gone]
        sizes = e - s + 1  # each kept word with one space after it
        ends = np.cumsum(sizes)
        joined = np.append(raw, np.uint8(32))[spread_ranges(s, sizes)] if len(s) else np.zeros(0, np.uint8)
        joined[ends - 1] = 32
        upto = np.concatenate([[0], ends])
        a, z = upto[kept_to[:-1]], upto[kept_to[1:]]
        z = np.maximum(z - 1, a)
        out = {c: b[c] for c in b.schema.names if c not in ("runs", "_text")}
        out["n_words"] = np.diff(w.offsets)
        out["n_removed"] = np.diff(w.offsets) - np.diff(kept_to)
        view = memoryview(joined)
        out["kept"] = pa.array([bytes(view[i:j]) for i, j in zip(a, z)], pa.binary())
        return pa.record_batch(out)

    return rows(batch, "_text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs``: ``carry`` (default the id), n_words, n_removed (long), kept (string: words joined by a space)."""
    carry = [id_col] if carry is None else carry
    runs = repeated_windows(docs, length, id_col, text_col)
    before, schema, after = carried(docs, carry, "n_words long, n_removed long, kept binary")
    texts = docs.select(*before, F.col(text_col).alias("_text"), text_key(id_col, text_col).alias("rid"))
    out = texts.join(runs, "rid", "left").drop("rid").mapInArrow(_remove(length), schema).select(*after)
    return out.withColumn("kept", F.col("kept").cast("string"))
