"""Which windows of a corpus start more than once: routing shared by both substring operators.

Cells (``grams``) are counted by anchor and by content. An anchor seen once has no repeat; a
content seen twice is a repeat of all its windows. Only what is left, cells that share an
anchor but differ somewhere, goes as text to a *shard*, where an operator's own index decides
window by window. Equal contents are merged before that, so a group of copies costs one piece.

An anchor with very many contents (the edge of a passage that many documents share) would
make one large group. Its cells are cut into runs of windows, keyed by the symbols that all
windows at those places have in common, so equal windows still meet. The runs are counted by key
and content like whole cells: equal ones (the inside of the passage) are repeats of all their
windows, and one of each content goes on. Keys that still have very many contents (surroundings
that differ beside one core) are cut again, down to single windows, which are their own key. No
key in a shard has more than ``HOT_CONTENTS`` pieces. A key with one content is done: the
windows of a cell have their anchor at different places, so no two of them are equal.

Counts are pre-aggregated in each task. Cells go back to the counts by a sort-merge join,
which adaptive execution splits where one anchor is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.llm.common import binary_array, flat_bytes, mix, spread_ranges, stored, text_key
from loadstone.llm.grams import prefix_sums, range_hash

CELL = "anchor long, content long, rid long, first long, last long, place int"
RUN = "rid long, first long, last long"
PIECE = "anchor long, content long, rid long, first long, last long, place int, copies long, symbols binary"
PIECES_PER_SHARD = 20_000
HOT_CONTENTS = 2_000
ROW_MARKS = 1 << 20  # rows of documents fall into as many classes; those that hold a wanted one are a bounded broadcast
HOT_RUNS = (8, 1)  # windows of a run; the last is a single one


def repeated_runs(docs: DataFrame, cut: Callable, extract: Callable, index: Callable) -> DataFrame:
    """Rows (rid, first, last): runs of window starts whose window also starts elsewhere.

    ``docs`` has ``rid`` and ``text``, one row per occurrence. ``cut`` maps texts to cells, ``extract`` rows of text and
    wanted cells to pieces, and ``index`` the pieces of a shard (sorted by anchor) to runs;
    all three are mapInArrow functions.
    """
    cells = docs.mapInArrow(cut, CELL)
    counted = cells.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("n > 1")
    # Written first: a join straight from its shuffle can be split where an anchor is hot, one from an aggregate cannot.
    seen = stored(counted.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "shared-anchors")
    shared = stored(cells.join(seen, "anchor"), "shared-cells")
    same = shared.filter("not mixed").select("rid", "first", "last")
    mixed = shared.filter("mixed").drop("mixed")
    contents = stored(mixed.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "first", "last", "place")).alias("one")), "cell-contents")
    copied = mixed.join(contents.filter("copies > 1").select("anchor", "content"), ["anchor", "content"]).select("rid", "first", "last")
    decided, kept = [same, copied], []
    groups = contents.select("anchor", "content", "copies", "one.*")
    for step in HOT_RUNS:
        hot = stored(groups.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CONTENTS).select("anchor"), "hot-anchors")
        if hot.isEmpty():
            kept.append(groups)
            break
        kept.append(groups.join(hot, "anchor", "left_anti"))
        runs = stored(_pieces(docs, groups.join(hot, "anchor", "left_semi"), extract, step).drop("symbols"), "hot-runs")
        merged = stored(runs.groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min(F.struct("rid", "first", "last", "place")).alias("one")), "run-contents")
        decided.append(runs.join(merged.filter("n > 1").select("anchor", "content"), ["anchor", "content"]).select("rid", "first", "last"))
        several = merged.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo != hi").select("anchor")
        groups = merged.select("anchor", "content", "copies", "one.*").join(several, "anchor", "left_semi")
    each = reduce(DataFrame.unionByName, kept)
    pieces = _pieces(docs, each, extract).select("anchor", "rid", "first", "copies", "symbols")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), contents.count() // PIECES_PER_SHARD + 1)
    found = pieces.repartition(shards, "anchor").sortWithinPartitions("anchor").mapInArrow(index, RUN)
    return reduce(DataFrame.unionByName, [*decided, found])


def _pieces(docs: DataFrame, cells: DataFrame, extract: Callable, step: int = 0) -> DataFrame:
    """The cells' pieces with their symbols, or (``step``) their runs of ``step`` windows without symbols."""
    cell = F.struct("anchor", "content", "first", "last", "place", "copies", F.lit(step).alias("step"))
    mark = F.pmod("rid", F.lit(ROW_MARKS)).alias("mark")
    marks = cells.select(mark).distinct()
    near = docs.select("*", mark).join(F.broadcast(marks), "mark", "left_semi").drop("mark")  # few texts are shuffled where few are wanted
    return near.join(cells.groupBy("rid").agg(F.collect_list(cell).alias("wanted")), "rid").mapInArrow(extract, PIECE)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with a row key; rows equal in id and text share one."""
    return docs.select(text_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))


def runs_by_row(runs: DataFrame) -> DataFrame:
    """One row per document: its runs as an array, in order; as long as the document at most."""
    return runs.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))


def cell_batch(found, rid: pa.Array) -> pa.RecordBatch:
    """Cells of one batch as Arrow columns."""
    return pa.record_batch({
        "anchor": found.anchor.view(np.int64), "content": found.content.view(np.int64), "rid": rid.take(pa.array(found.doc)),
        "first": found.first, "last": found.last, "place": found.place.astype(np.int32),
    })


def piece_batch(wanted: pa.ListArray, rid: pa.Array, begins: np.ndarray, symbols: np.ndarray, length: int, values: np.ndarray | None = None) -> pa.RecordBatch:
    """Pieces of one batch: the symbols [first, last + length) of every wanted cell, or the runs of cells to be cut."""
    counts = np.diff(wanted.offsets.to_numpy())
    flat = wanted.flatten()
    anchor, content, first, last, place, copies, step = (flat.field(c).to_numpy() for c in ("anchor", "content", "first", "last", "place", "copies", "step"))
    row = np.repeat(np.arange(len(wanted)), counts)
    sizes = last + length - first
    picked = symbols[spread_ranges(begins[row] + first, sizes)]
    if len(step) and step[0]:  # the same for all cells of a pass
        at = first + place  # of the anchor
        low, high = (at - last) // step, (at - first) // step
        of = np.repeat(np.arange(len(first)), high - low + 1)
        run = spread_ranges(low, high - low + 1)
        at, step, row, copies = at[of], step[of], row[of], copies[of]
        begin, end = at - (run + 1) * step + 1, at - run * step  # window starts of a whole run
        sums = prefix_sums(picked if values is None else values[picked])
        base = (np.cumsum(sizes) - sizes - first)[of]
        core = range_hash(sums, base + end, base + begin + length)
        anchor = mix(core + run.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + anchor[of].view(np.uint64)).view(np.int64)
        first, last = np.maximum(begin, first[of]), np.minimum(end, last[of])
        place = (at - first).astype(np.int32)
        content = mix(range_hash(sums, base + first, base + last + length) + place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)
        sizes, picked = np.zeros(len(first), np.int64), picked[:0]
    width = symbols.dtype.itemsize
    return pa.record_batch({
        "anchor": anchor, "content": content, "rid": rid.take(pa.array(row)), "first": first, "last": last, "place": place, "copies": copies,
        "symbols": binary_array(picked.view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * width),
    })


def whole_anchors(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.Table]:
    """Consecutive rows of about ``budget`` symbol bytes, never cut inside an anchor."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        at = 0
        anchor = b["anchor"].to_numpy()
        offsets, _ = flat_bytes(b["symbols"])
        ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        if held and len(anchor) and held[-1]["anchor"][-1].as_py() != anchor[0] and size >= budget:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        for end in ends[:-1]:
            if size + offsets[end] - offsets[at] >= budget:
                held.append(b.slice(at, end - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, int(end)
        if at < len(anchor):
            held.append(b.slice(at))
            size += int(offsets[-1] - offsets[at])
    if held:
        yield pa.Table.from_batches(held)


def run_batch(repeated: np.ndarray, piece: np.ndarray, start: np.ndarray, rid: np.ndarray, first: np.ndarray) -> pa.RecordBatch | None:
    """Maximal runs among window starts given by piece and place in it (sorted)."""
    piece, start = piece[repeated], start[repeated]
    if not len(piece):
        return None
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(piece)) - 1
    return pa.record_batch({"rid": rid[piece[a]], "first": first[piece[a]] + start[a], "last": first[piece[a]] + start[b]})
