"""Fingerprints over long sequences, and their division into cells of equal windows.

A *window* is ``length`` consecutive symbols of one document. The *anchor* of a window is
the least of the fingerprints of its ``gram``-symbol grams (the first one on ties), so equal
windows have the same anchor at the same place. The windows of a document that share one
anchor are consecutive starts; they form a *cell*. Equal windows therefore always lie in cells
of equal anchor fingerprint, whatever document they are in, and a cell stands for many
windows: this is what is shuffled in place of single windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from loadstone.llm.common import WORD_BREAKS, mix, spread_ranges

ODD = np.uint64(0x5851F42D4C957F2D)
ODD_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
BLOCK = 1 << 18
PLACE_BITS = 24
LONGEST_BLOCK = 1 << 22
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", ODD), ("down", ODD_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


BYTE_VALUES = _byte_values()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``out[j] - out[i]`` is the polynomial hash of ``values[i:j]``, times a power of its start."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Cells(NamedTuple):
    anchor: np.ndarray  # fingerprint of the anchor gram
    content: np.ndarray  # fingerprint of the cell's symbols and of the anchor's place in it
    place: np.ndarray  # of the anchor, counted from the cell's first window start
    doc: np.ndarray  # row number in the batch
    first: np.ndarray  # first and last window start, counted from the document's start
    last: np.ndarray


def _blocks(offsets: np.ndarray, halo: int):
    """(first doc, past last doc, first symbol, past last window start, past last symbol) of each block."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + BLOCK, "right")) - 1)
        lo, hi = int(offsets[d]), int(offsets[e])
        if hi - lo <= LONGEST_BLOCK:
            yield d, e, lo, hi, hi
        else:
            for at in range(lo, hi, LONGEST_BLOCK - halo):
                stop = min(hi, at + LONGEST_BLOCK - halo)
                yield d, e, at, stop, min(hi, stop + halo)
        d = e


def cells(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int, values: np.ndarray | None = None) -> Cells:
    """Cells of every document; ``symbols`` are bytes with a value table, or 64-bit hashes."""
    width = length - gram + 1
    parts: list[Cells] = []
    for d, e, lo, starts_end, hi in _blocks(offsets, length):
        if hi - lo < length:
            continue
        v = symbols[lo:hi] if values is None else values[symbols[lo:hi]]
        sums = prefix_sums(v)
        _, down = _powers(len(sums))
        f = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        g = (f & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(f), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            g = np.minimum(g[:-reach], g[reach:])
            reach *= 2
        if reach < width:
            g = np.minimum(g[: len(g) - (width - reach)], g[width - reach :])
        place = (g & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        ends = np.clip(offsets[d + 1 : e + 1], lo, hi) - lo
        begins = np.clip(offsets[d:e], lo, hi) - lo
        inside = np.minimum(np.maximum(ends - begins - length + 1, 0), np.maximum(starts_end - lo - begins, 0))
        valid = np.zeros(len(place) + 2, bool)
        valid[spread_ranges(begins, inside) + 1] = True
        change = np.ones(len(place) + 1, bool)
        np.not_equal(place[1:], place[:-1], out=change[1:-1])
        change |= valid[1:] != valid[:-1]
        cut = np.flatnonzero(change)
        first, last = cut[:-1], cut[1:] - 1
        keep = valid[first + 1]
        first, last = first[keep], last[keep]
        if not len(first):
            continue
        a = place[first]
        content = mix(range_hash(sums, first, last + length) + (a - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        doc = np.searchsorted(offsets[d + 1 : e + 1] - lo, first, "right") + d
        parts.append(Cells(f[a], content, a - first, doc, first + lo - offsets[doc], last + lo - offsets[doc]))
    if not parts:
        z = np.zeros(0, np.int64)
        return Cells(z.astype(np.uint64), z.astype(np.uint64), z, z, z, z)
    return Cells(*[np.concatenate(x) for x in zip(*parts)])


_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS)] = True


class Words(NamedTuple):
    start: np.ndarray  # byte range of each word in the batch's buffer
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray  # words before each document, and all


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _BREAK) -> Words:
    """Maximal runs of bytes that are no breaks (space and U+0009 to U+000D), document by document."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(z, z, z.astype(np.uint64), np.zeros(len(offsets), np.int64))
    solid = ~breaks[raw]
    edge = np.zeros(len(raw), bool)
    begins = offsets[:-1]
    edge[begins[begins < len(raw)]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    values = BYTE_VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    h = np.empty(len(s), np.uint64)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + BLOCK, "right")))
        lo, hi = int(s[at]), int(e[to - 1])
        h[at:to] = range_hash(prefix_sums(values[raw[lo:hi]]), s[at:to] - lo, e[at:to] - lo)
        at = to
    return Words(s, e, h, np.searchsorted(s, offsets))
