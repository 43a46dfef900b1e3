"""Ranked lexical search by branch and bound over trees of restricted document vectors.

Only the terms of the searched items matter, so a document is its *restricted vector*: those terms
with their counts, most frequent term of the corpus first. Documents of a shard (``SHARD`` of them)
are put in the order of these term sequences; equal beginnings are shared paths of a trie. A node is
a run of neighbours with one shared path; it holds the greatest count of every term and the
least length measure m in its subtree, which bound the score of all its documents. Every item walks
the tree depth first, best bound first, and leaves out what cannot reach its ``TOP`` best;
what has ``BLOCK`` documents or fewer is scored document by document. Bounds carry over from
shard to shard of a task.

Items are taken in blocks whose terms together stay under ``BLOCK_TERMS``, so neither the broadcast terms nor a
tree's maxima grow with the items; every block reads the texts once.

Terms, weights and scores are those of ``search``; fingerprints of terms have 64 bits. Defined cases: null and empty
texts have no terms and are in no result; an item without terms, or with terms no document has, gets no rows; repeated items are
answered each for itself; repeated documents are ranked each for itself; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.llm import grams
from loadstone.llm.common import blocks, flat_bytes, stored

TOP = 10
SHARD = 8192
BLOCK = 64
BLOCK_TERMS = 1 << 15

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(col: pa.Array) -> grams.Words:
    offsets, raw = flat_bytes(col)
    return grams.words(raw, offsets, lower=True, breaks=_BREAKS)


def _vectors(vocabulary: np.ndarray):
    """Restricted vectors: terms as places in the sorted ``vocabulary``, ascending, with their counts, and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "_text", 4096):
                w = _terms(b["_text"])
                doc = np.repeat(np.arange(b.num_rows), np.diff(w.offsets))
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == w.hash if len(vocabulary) else np.zeros(len(at), bool)
                key, n = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
                cut = np.searchsorted(key, np.arange(b.num_rows + 1) * max(len(vocabulary), 1)).astype(np.int32)
                yield pa.record_batch({
                    "_id": b["_id"], "n": np.diff(w.offsets).astype(np.int64),
                    "terms": pa.ListArray.from_arrays(cut, pa.array((key % max(len(vocabulary), 1)).astype(np.int32))),
                    "tfs": pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))),
                })

    return run


class Tree(NamedTuple):
    most: np.ndarray  # node x term: greatest count in the subtree
    least: np.ndarray  # node: least m in the subtree
    first: np.ndarray  # node: its documents, as a range in trie order
    last: np.ndarray
    children: list[np.ndarray]  # none for a block


def _shape(common: np.ndarray, block: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Nodes over neighbours in trie order, parents first; ``common[i]`` is the shared path of documents i-1 and i.

    A child that leaves fewer than a block behind is opened in place, so there are at most
    about two nodes a block, however the paths fall.
    """
    first, last, children = [0], [len(common)], [[]]
    at = 0
    while at < len(first):
        if last[at] - first[at] > block:
            runs, opened = [(first[at], last[at])], []
            while runs:
                lo, hi = runs.pop()
                if hi - lo <= block or (hi - lo < last[at] - first[at] and hi - lo <= last[at] - first[at] - block):
                    opened.append((lo, hi))
                    continue
                inner = common[lo + 1 : hi]
                edges = np.concatenate([[lo], np.flatnonzero(inner == inner.min()) + lo + 1, [hi]])
                runs += zip(edges[:-1].tolist(), edges[1:].tolist())
            opened.sort()
            joined: list[tuple[int, int]] = []
            for lo, hi in opened:  # small neighbours share a block
                if joined and hi - joined[-1][0] <= block:
                    joined[-1] = (joined[-1][0], hi)
                else:
                    joined.append((lo, hi))
            children[at] = list(range(len(first), len(first) + len(joined)))
            first += [lo for lo, _ in joined]
            last += [hi for _, hi in joined]
            children += [[] for _ in joined]
        at += 1
    return first, last, children


def grow(offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, n_terms: int, block: int = BLOCK) -> tuple[Tree, np.ndarray]:
    """The tree of a shard, and its documents in trie order. ``ranks`` ascend within a document: 0 is the most frequent term."""
    path = ranks.astype(">u4").tobytes()
    keys = [path[4 * a : 4 * z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    common = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        a, b = keys[order[i - 1]], keys[order[i]]
        size = min(len(a), len(b))
        if a[:size] == b[:size]:
            common[i] = size // 4
        else:
            x, y = np.frombuffer(a[:size], ">u4"), np.frombuffer(b[:size], ">u4")
            common[i] = int(np.argmax(x != y))
    first, last, children = _shape(common, block)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    most = np.zeros((len(first), n_terms), np.int32)
    least = np.zeros(len(first), np.int64)
    leaf = np.array([k for k, c in enumerate(children) if not c])
    leaf = leaf[np.argsort(np.array(first)[leaf])]
    owner = leaf[np.searchsorted(np.array(first)[leaf], place, "right") - 1]
    np.maximum.at(most, (np.repeat(owner, np.diff(offsets)), ranks), tfs)
    for k in range(len(first) - 1, -1, -1):  # children follow their parents
        if children[k]:
            most[k], least[k] = most[children[k]].max(0), least[children[k]].min()
        else:
            least[k] = m[order[first[k] : last[k]]].min()
    return Tree(most, least, np.array(first), np.array(last), [np.array(c, np.int64) for c in children]), order


def _gain(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Documents of a task under one tree; ``best`` answers one item."""

    def __init__(self, ids: pa.Array, n: np.ndarray, m: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, n_terms: int, block: int = BLOCK):
        self.ids = ids
        self.tree, order = grow(offsets, ranks, tfs, m, n_terms, block)
        sizes = np.diff(offsets)[order]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(offsets[:-1][order] - self.offsets[:-1], sizes) + np.arange(self.offsets[-1])
        self.ranks, self.tfs, self.m, self.order = ranks[take], tfs[take], m[order], order
        by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        standing = np.empty(len(ids), np.int64)
        standing[by_id] = np.arange(len(ids))
        self.standing = standing[order]  # place of each document among the ids
        self.n_terms = n_terms

    def best(self, terms: np.ndarray, weights: np.ndarray, floor: int, top: int = TOP) -> list[tuple[int, int, int]]:
        """Up to ``top`` documents as (score, minus standing, row), scores of at least ``floor`` and above 0; order of a heap."""
        tree, heap = self.tree, []
        wide = np.zeros(self.n_terms, np.int64)
        wide[terms] = weights
        stack = [(1 << 62, 0)]
        while stack:
            bound, node = stack.pop()
            if bound < max(floor, heap[0][0] if len(heap) == top else 1):
                continue
            if len(tree.children[node]):
                kids = tree.children[node]
                bounds = _gain(weights, tree.most[np.ix_(kids, terms)], tree.least[kids][:, None]).sum(1)
                up = np.argsort(bounds, kind="stable")
                stack += zip(bounds[up].tolist(), kids[up].tolist())
                continue
            lo, hi = int(tree.first[node]), int(tree.last[node])
            a, z = self.offsets[lo], self.offsets[hi]
            doc = np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1]))
            w = wide[self.ranks[a:z]]
            live = w > 0
            scores = np.zeros(hi - lo, np.int64)
            np.add.at(scores, doc[live], _gain(w[live], self.tfs[a:z][live], self.m[lo:hi][doc[live]]))
            for d in np.flatnonzero(scores >= max(floor, 1)).tolist():
                entry = (int(scores[d]), -int(self.standing[lo + d]), int(self.order[lo + d]))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        return heap


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], rank: np.ndarray, n_docs: int, n_all: int, shard: int, block: int, top: int):
    """Best documents of every item among the rows of a task: item, _id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {item: [] for item, _, _ in items}  # scores of the best documents of earlier shards
        held: list[pa.RecordBatch] = []

        def search() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not t.num_rows:
                return None
            n = t["n"].to_numpy()
            lists, counts = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
            offsets = lists.offsets.to_numpy().astype(np.int64)
            terms, tfs = rank[lists.values.to_numpy()[offsets[0] : offsets[-1]]], counts.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            doc = np.repeat(np.arange(len(n)), np.diff(offsets))
            sort = np.lexsort((terms, doc))
            s = Shard(t["_id"].combine_chunks(), n, 10 + (90 * n * n_docs) // n_all, offsets, terms[sort], tfs[sort], len(rank), block)
            out_item, out_row, out_score = [], [], []
            for item, which, weights in items:
                seen = floors[item]
                found = s.best(which, weights, seen[0] if len(seen) == top else 1, top)
                for score, _, row in found:
                    out_item.append(item)
                    out_row.append(row)
                    out_score.append(score)
                    if len(seen) < top:
                        heapq.heappush(seen, score)
                    elif score > seen[0]:
                        heapq.heapreplace(seen, score)
            return pa.record_batch({"item": pa.array(out_item, pa.int64()), "_id": s.ids.take(pa.array(out_row, pa.int64())), "score": pa.array(out_score, pa.int64())})

        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == shard:
                    out, size = search(), 0
                    if out is not None and out.num_rows:
                        yield out
        if size:
            out = search()
            if out is not None and out.num_rows:
                yield out

    return run


def _item_blocks(items: DataFrame, most_terms: int) -> list[DataFrame]:
    """Items numbered, in blocks of about ``most_terms`` terms at most (a longer item is a block of its own)."""
    def sized(batches):
        for b in batches:
            w = _terms(b["text"])
            doc = np.repeat(np.arange(b.num_rows), np.diff(w.offsets))
            pairs = np.unique(np.stack([doc, w.hash.view(np.int64)]), axis=1)
            cut = np.searchsorted(pairs[0], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({"item_id": b["item_id"], "terms": pa.ListArray.from_arrays(cut, pa.array(pairs[1]))})

    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.ArrayType(T.LongType()))])
    known = stored(items.mapInArrow(sized, schema).filter(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    # Items of a file stand together; whole files are split by the running count of their terms.
    w = Window.partitionBy(F.shiftright("item", 33)).orderBy("item")
    numbered = stored(known.withColumn("block", F.concat_ws("-", F.shiftright("item", 33), F.floor(F.sum(F.size("terms")).over(w) / most_terms))), "item-blocks")
    keys = numbered.groupBy("block").agg(F.sum(F.size("terms")).alias("n")).orderBy("block").collect()  # a row a block
    out, group, size = [], [], 0
    for k in keys:  # neighbours that fit together share a pass
        if group and size + k["n"] > most_terms:
            out.append(group)
            group, size = [], 0
        group.append(k["block"])
        size += k["n"]
    return [numbered.filter(F.col("block").isin(g)) for g in [*out, *([group] if group else [])]]


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shard: int = SHARD, block: int = BLOCK, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score (names as in ``item_col``, ``id_col``).

    Terms are runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased. A term of df documents weighs
    floor(1000 ln((2N+2)/(2df+1))); a document of n terms has m = 10 + 90nN div L, N documents with
    terms holding L in all; tf occurrences of a term add its weight times (1000000000 tf) div (1000 tf + 8 m).
    Equal scores stand by ascending id, null first.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    kinds = texts.schema["_id"].dataType, asked.schema["item_id"].dataType
    vector = T.StructType([T.StructField("_id", kinds[0])]).add("n", T.LongType()).add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.IntegerType()))
    found = T.StructType([T.StructField("item", T.LongType()), T.StructField("_id", kinds[0]), T.StructField("score", T.LongType())])
    parts = []
    for part in _item_blocks(asked, block_terms):
        wanted = part.select("item", "item_id", "terms").collect()  # at most block_terms terms
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(np.uint64) for r in wanted]))
        held = stored(texts.mapInArrow(_vectors(vocabulary), vector), "term-vectors")
        sizes = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("all")).first()
        n_docs, n_all = sizes["docs"], sizes["all"] or 0
        df = np.zeros(len(vocabulary), np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most block_terms rows
            df[r["t"]] = r["count"]
        order = np.lexsort((vocabulary, -df))
        rank = np.empty(len(vocabulary), np.int64)
        rank[order] = np.arange(len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        lines = []
        for r in wanted:
            at = np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64))
            at = at[(df[at] > 0) & (weight[at] > 0)]
            if len(at):
                lines.append((r["item"], rank[at], weight[at]))
        hits = held.filter(F.size("terms") > 0).mapInArrow(_searched(lines, rank, n_docs, n_all, shard, block, top), found)
        names = spark.createDataFrame([(r["item"], r["item_id"]) for r in wanted], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kinds[1])]))
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("_id"))
        best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
        parts.append(best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("_id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(item_col, kinds[1]), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kinds[0]), T.StructField("score", T.LongType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
