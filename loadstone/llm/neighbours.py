"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest pivots in order. A shard of vectors posts
itself in one inverted file per pivot (who lists this pivot, and where); a query reads the
files of its own pivots, adds up what each posting saves of the footrule distance between the
two orders, and the best ``RERANK_SHARE`` of the shard (``RERANK_LEAST`` at least) is ranked
again by inner product in double precision. The best of all shards follow from one window.

The pivots are a bounded sample (``PIVOTS`` distinct vectors of least hash); every row is
indexed. Vectors get one more coordinate that makes their lengths equal, which turns the
largest inner product into the nearest vector. Equal vectors are one entry with its smallest
ids: no query can need more of them than it returns, and one.

Every query meets every shard, so the work is queries times postings read; nothing but
a block of queries and one shard is held by a task.

Defined cases: null vectors, zero vectors, those with null or non-finite components and those of another
length than most take no part; ties go to the smaller id; copies of a query's vector are
neighbours, rows of its own id are not; with fewer candidates than asked all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.llm.common import shards_for, stored

PIVOTS = 256
PREFIX = 64
RERANK_SHARE = 0.15
RERANK_LEAST = 500
SHARD_ROWS = 4096
QUERY_BLOCK = 256


def usable(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def orders(vectors: np.ndarray, pivots: np.ndarray, longest: float | None) -> np.ndarray:
    """The nearest pivots of each vector, in order; ``longest`` completes data vectors, queries have none."""
    near = vectors @ pivots[:, :-1].T
    if longest is not None:
        near += np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, : min(PREFIX, len(pivots))].astype(np.int32)


class Shard:
    """Inverted files of one shard: for each pivot the entries that list it, and the place."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, longest: float):
        self.vectors, self.ids = vectors, ids
        order = orders(vectors, pivots, longest)
        self.prefix = order.shape[1]
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.entry, self.place = by_pivot // self.prefix, by_pivot % self.prefix
        self.ends = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.keep = max(RERANK_LEAST, int(RERANK_SHARE * len(vectors)))

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """Entries of least footrule distance; a pivot listed by one side only counts as its distance to the end."""
        if self.keep >= len(self.vectors):
            return np.arange(len(self.vectors))
        runs = [slice(self.ends[p], self.ends[p + 1]) for p in order]
        own = np.repeat(np.arange(self.prefix), [r.stop - r.start for r in runs])
        place = np.concatenate([self.place[r] for r in runs])
        saved = 2 * self.prefix - own - place - np.abs(own - place)
        total = np.bincount(np.concatenate([self.entry[r] for r in runs]), weights=saved, minlength=len(self.vectors))
        return np.argpartition(-total, self.keep - 1)[: self.keep]

    def nearest(self, query_id: int, vector: np.ndarray, order: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        found = np.sort(self.candidates(order))
        scores = (self.vectors[found] * vector).sum(axis=1)
        if len(found) > 4 * k:  # all entries that tie with the last one stay
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            found, scores = found[scores >= least], scores[scores >= least]
        rows = [(-s, i) for e, s in zip(found.tolist(), scores.tolist()) for i in self.ids[e] if i != query_id]
        return [(query_id, i, -s) for s, i in sorted(rows)[:k]]


def _search(pivots: np.ndarray, longest: float, k: int):
    width = pivots.shape[1] - 1

    def run(batches):
        shard_id, shard, vectors, ids = None, None, [], []
        for b in batches:
            shards, kinds = b["shard"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, z in zip(cuts, np.append(cuts[1:], len(shards))):
                if shards[a] != shard_id:
                    shard_id, shard, vectors, ids = shards[a], None, [], []
                part = b.slice(a, z - a)
                if kinds[a] == 0:
                    vectors.append(_matrix(part["vector"], width))
                    ids.extend(part["ids"].to_pylist())
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(vectors), ids, pivots, longest)
                if shard is None:
                    continue
                for at in range(0, z - a, QUERY_BLOCK):
                    block = part.slice(at, QUERY_BLOCK)
                    q = _matrix(block["vector"], width)
                    out = [r for i, v, o in zip(block["ids"].to_pylist(), q, orders(q, pivots, None)) for r in shard.nearest(i[0], v, o, k)]
                    if out:
                        a1, a2, a3 = zip(*out)
                        yield pa.record_batch({"query_id": pa.array(a1, pa.int64()), "vec_id": pa.array(a2, pa.int64()), "score": pa.array(a3, pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every query, by inner product.

    ``queries`` has the same two columns; a candidate of a query's own id is left out.
    """
    spark = vectors.sparkSession

    def clean(df):
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(usable("vector") & F.col("id").isNotNull())

    data = clean(vectors)
    width = data.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.size("vector") == width[0]["n"]
    few = data.filter(same).dropDuplicates(["id", "vector"]).withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_n") <= k + 1)
    entries = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = entries.agg(F.count("*"), F.max(length)).first()
    sample = np.array([r["vector"] for r in entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()])
    completed = np.concatenate([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))[:, None]], axis=1)
    shards = shards_for(n, SHARD_ROWS, 1)
    left = entries.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "ids", "vector")
    right = clean(queries).filter(same).dropDuplicates(["id", "vector"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.array("id").alias("ids"), "vector")
    met = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_search(completed, float(longest), k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
