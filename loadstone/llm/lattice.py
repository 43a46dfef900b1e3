"""SentencePiece encoding and decoding as a lattice over units of text.

A text is normalised as the model says (a dummy space before it, spaces as U+2581) and cut into
*units* where no piece of the vocabulary reaches across: before a run of U+2581, at line feeds,
and after letters (with their marks). The best segmentation of a text is the best of its units,
joined. Normalising and cutting are column expressions.

A unit's lattice has a node before and after every character and an edge for every piece that
lies there; a character without a piece is an edge of its own (the unknown penalty below the
least score) and becomes byte pieces. One pass over the nodes keeps the best score and last edge
of each, then the path is walked back. Ties go to the longer last piece. Units of all lengths
take this one pass, whose time grows with their length.

Texts share very many units and are never shuffled for them: a task finds the path once for each
distinct unit of an Arrow batch, remembers those of ``FREQUENT`` units from batch to batch, and
puts the ids of whole texts together by array lookups, block by block. Decoding looks up every
id of a row in the vocabulary in the same way, so neither moves a row.

Defined cases: a null or empty text has no units and no pieces; U+2581 in a text decodes as a
space, as in the model itself; copied rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.llm.common import binary_array, carried, flat_bytes, spread_ranges, text_key

SPACE = "▁"
FREQUENT = 1 << 16  # units of at most LONGEST_KEPT characters whose ids a task remembers
LONGEST_KEPT = 64
BLOCK_ITEMS = 1 << 18  # units or ids worked on at once; only a single longer text has more
PATHS = 1 << 15  # distinct units whose paths are Python lists at once
UNKNOWN_PENALTY = 10.0
_L = "\\p{L}\\p{M}"
UNIT = f"\\n|{SPACE}*[{_L}]+|{SPACE}*[^{_L}{SPACE}\\n]+[{_L}]*|{SPACE}+"


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, int, float]]  # ordinary pieces with id and score
    first_byte: int  # id of the piece of byte 0, the others follow
    longest: int
    unknown_score: float


def vocabulary(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    ordinary = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    pieces = [(m.id_to_piece(i), i, m.get_score(i)) for i in ordinary]
    for p, _, _ in pieces:
        if len(regex.findall(UNIT, p)) != 1:
            raise ValueError(f"piece {p!r} reaches across a unit's end")
    return Vocabulary(pieces, m.piece_to_id("<0x00>"), max(len(p) for p, _, _ in pieces), min(s for _, _, s in pieces) - UNKNOWN_PENALTY)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def normalised(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise(F.lit(""))


def units(text: Column) -> Column:
    return F.regexp_extract_all(normalised(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))


def _best_path(v: Vocabulary) -> Callable[[str], list[int]]:
    """The ids of a unit's best path."""
    none, longest, unknown = float("-inf"), v.longest, v.unknown_score
    root: dict = {}  # nodes by character: children, score and id of the edge that ends there
    for p, i, score in sorted(v.pieces, key=lambda x: len(x[0])):
        children = root
        for k, c in enumerate(p[:-1]):  # what only begins a piece is no edge, but for a single character
            children = children.setdefault(c, ({}, none if k else unknown, -1))[0]
        children[p[-1]] = ({}, score, i)

    def ids(unit: str) -> list[int]:
        n = len(unit)
        best, back, last = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            so_far, end, children = best[start], start, root
            for c in unit[start : start + longest]:
                node = children.get(c)
                if node is None:
                    break
                children, score, i = node
                score += so_far
                end += 1
                if score > best[end]:  # starts come in order, so the longer last piece stays
                    best[end] = score
                    back[end] = start
                    last[end] = i
            if end == start and so_far + unknown > best[end + 1]:
                best[end + 1] = so_far + unknown
                back[end + 1] = start
                last[end + 1] = -1
        out = []
        while n:
            start, i = back[n], last[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(v.first_byte + x for x in reversed(unit[start:n].encode()))
            n = start
        out.reverse()
        return out

    return ids


def _remembered(ids: Callable[[str], list[int]], most: int) -> Callable[[list[str]], list[list[int]]]:
    """The ids of units; at most ``most`` short ones are kept for the next call."""
    kept: dict[str, list[int]] = {}

    def of(distinct: list[str]) -> list[list[int]]:
        out = []
        for u in distinct:
            found = kept.get(u)
            if found is None:
                found = ids(u)
                if len(u) <= LONGEST_KEPT and len(kept) < most:
                    kept[u] = found
            out.append(found)
        return out

    return of


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of about ``BLOCK_ITEMS`` items of a list column (no nulls): slice, offsets and items."""
    for b in batches:
        offsets = b[column].offsets.to_numpy().astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_ITEMS, "right")) - 1)
            part = b.slice(at, to - at)
            yield part, offsets[at : to + 1] - offsets[at], part[column].flatten()
            at = to


def _by_number(batch: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, pa.Array]:
    """The batch with units replaced by their numbers, and its distinct units."""
    offsets = batch[column].offsets.to_numpy()
    coded = batch[column].flatten().dictionary_encode()
    lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), coded.indices)
    return batch.set_column(batch.schema.get_field_index(column), column, lists), coded.dictionary


class Paths(NamedTuple):
    """The ids of distinct units, one after another."""

    starts: np.ndarray
    sizes: np.ndarray
    pool: np.ndarray

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of every unit's ids (units + 1), and the ids of all units."""
        counts = self.sizes[numbers]
        return np.concatenate([[0], np.cumsum(counts)]), self.pool[spread_ranges(self.starts[numbers], counts)]


def _paths(distinct: pa.Array, of: Callable[[list[str]], list[list[int]]]) -> Paths:
    sizes, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(distinct), PATHS):
        found = of(distinct.slice(at, PATHS).to_pylist())
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        pool.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
    all_sizes = np.concatenate(sizes)
    return Paths(np.cumsum(all_sizes) - all_sizes, all_sizes, np.concatenate(pool))


def _lists(ends: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def _encode(v: Vocabulary, most: int):
    def run(batches):
        of = _remembered(_best_path(v), most)
        for b in batches:
            numbered, distinct = _by_number(b, "_units")
            paths = _paths(distinct, of)
            for part, offsets, items in _parts(iter([numbered]), "_units"):
                ends, ids = paths.of(items.to_numpy())
                yield pa.record_batch({**{c: part[c] for c in part.schema.names if c != "_units"}, "ids": _lists(ends[offsets], ids)})

    return run


def _occurrences(v: Vocabulary, most: int):
    def run(batches):
        of = _remembered(_best_path(v), most)
        for b in batches:
            numbered, distinct = _by_number(b, "units")
            paths = _paths(distinct, of)
            for part, offsets, items in _parts(iter([numbered]), "units"):
                if len(items):
                    ends, ids = paths.of(items.to_numpy())
                    n = np.diff(offsets)
                    at = spread_ranges(np.zeros(len(n), np.int64), n).astype(np.int32)
                    yield pa.record_batch({"rid": part["rid"].take(pa.array(np.repeat(np.arange(len(n)), n))), "at": at, "unit": distinct.take(items), "ids": _lists(ends, ids)})

    return run


def occurrences(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of every text: rid (row key), at (place of the unit), unit, ids (array of int)."""
    texts = docs.select(text_key(id_col, text_col).alias("rid"), units(F.col(text_col)).alias("units"))
    return texts.mapInArrow(_occurrences(v, FREQUENT), "rid long, at int, unit string, ids array<int>")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and its whole ``ids`` sequence."""
    before, schema, after = carried(docs, [id_col], "ids array<int>")
    return docs.select(*before, units(F.col(text_col)).alias("_units")).mapInArrow(_encode(vocabulary(model), FREQUENT), schema).select(*after)


def _shown(v: Vocabulary):
    """Bytes of every row's ids; an id that is no piece and no byte gives none."""
    codes = {i: p.encode() for p, i, _ in v.pieces} | {v.first_byte + i: bytes([i]) for i in range(256)}
    none = max(codes) + 1
    starts, table = flat_bytes(pa.array([codes.get(i, b"") for i in range(none + 1)], pa.binary()))
    sizes = np.diff(starts)

    def run(batches):
        for part, offsets, items in _parts(batches, "_ids"):
            ids = items.fill_null(none).to_numpy()
            ids = np.where((ids >= 0) & (ids < none), ids, none)
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[offsets]
            shown = binary_array(table[spread_ranges(starts[ids], sizes[ids])], ends)
            yield pa.record_batch({**{c: part[c] for c in part.schema.names if c != "_ids"}, "shown": shown})

    return run


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """The text of every row's ``ids``: the bytes of pieces and byte pieces, in order."""
    before, schema, after = carried(encoded, [key], "shown binary")
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("_ids")
    shown = encoded.select(*before, ids).mapInArrow(_shown(vocabulary(model)), schema).select(*after).withColumn("shown", F.decode("shown", "UTF-8"))
    text = F.substring(F.replace("shown", F.lit(SPACE), F.lit(" ")), F.lit(2), F.length("shown"))  # without the dummy space
    return shown.select(key, text.alias("text"))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_units, n_pieces, checksum (sum over units of a 32-bit hash of place and ids)."""
    parts = occurrences(docs, vocabulary(model), id_col, text_col)
    check = F.xxhash64("at", "ids").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    # Rows equal in id and text share a key; each has one first unit, which counts them.
    sums = parts.groupBy("rid").agg(F.sum((F.col("at") == 0).cast("long")).alias("c"), F.count("*").alias("u"), F.sum(F.size("ids")).alias("p"), F.sum(check).alias("s"))
    rows = docs.select(F.col(id_col), text_key(id_col, text_col).alias("rid")).join(sums, "rid", "left")

    def per_row(name):
        return F.coalesce(F.floor(F.col(name) / F.col("c")) if name != "s" else F.expr("s div c"), F.lit(0).cast("long"))

    return rows.select(id_col, per_row("u").alias("n_units"), per_row("p").alias("n_pieces"), per_row("s").alias("checksum"))
