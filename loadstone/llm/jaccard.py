"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are the distinct word shingles of a text. Under any one order of all tokens, two sets
that link must share tokens among the first ``|S| - ceil(t |S|) + 1`` of each, and as many
as ``_shares_prefixes`` says. The orders here put tokens of many documents last (a bounded table of the
most frequent ones) and are otherwise different hashes, so a chance meeting under one is seldom
repeated under the next; a pair is verified on whole texts only if it passes all of them.

Before any text moves, candidate pairs meet the *signatures* of their sets: for each of as many classes
of tokens as the set has (in a power of two), whether their number is odd. Two signatures differ in no more
places than the sets have tokens not in common, so a pair whose signatures differ in more than linked sets may is no link.
Only texts of the pairs that are left are shuffled.

Pairs inside groups of near copies would grow with the square of the group, and most of them
tell nothing new, so the join has two rounds. First every set is verified against ``HUBS`` hubs:
of a posting list the hub is the set with the largest share of its prefix in company, which among
edited copies is the text they come from. The links give components. Then all pairs *between*
components that share enough prefix tokens are verified. They are found under a second order, in
which the tokens of long lists of the first come last as well, and must pass the filters of all
other orders before their sets are compared. No pair between components is left out, so the
components are exact; links inside a component need not be listed.

Equal sets are one node from the start. Shingles are compared as 64-bit fingerprints.

Defined cases: a null, empty or blank text has an empty set, links with nothing and is its own component;
a text with fewer words than a shingle has its whole sequence as the one token; rows of equal
text are one node; a row without id belongs to the component of its text, whose number is the
least id in it (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.llm import grams
from loadstone.llm.common import BLOCK_BYTES, binary_array, blocks, flat_bytes, mix, spread_ranges, stored
from loadstone.llm.components import components

SHINGLE = 5
PERCENT = 75
ORDERS = 2
FREQUENT = 1 << 18
FREQUENT_IN_TASK = 2
COUNTED = 1 << 21
MERGED = 1 << 19
POSTED = 1 << 17
LONG_LIST = 8
HUBS = 2
JOINED_LIST = 24
MATRIX_ROWS = 1000
BLOCK_ROWS = 2000
HUB_MEMBERS = 1000
LEAST_BITS = 64
MOST_BITS = 1 << 15
TEXT_MARKS = 1 << 20  # rows fall into as many classes; those that hold a wanted text are a bounded broadcast
_SALTS = tuple(np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(8))


class Sets:
    """The token sets of a batch, one after another, each sorted and distinct."""

    def __init__(self, col: pa.Array, shingle: int):
        offsets, raw = flat_bytes(col)
        w = grams.words(raw, offsets, lower=True)
        n = np.diff(w.offsets)
        count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
        start = spread_ranges(w.offsets[:-1], count)
        row = np.repeat(np.arange(len(n)), count)
        stop = np.minimum(start + shingle, w.offsets[1:][row]) if len(row) else start
        h = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            to = min(len(start), at + grams.BLOCK)
            lo, hi = int(start[at]), int(stop[to - 1])
            h[at:to] = grams.range_hash(grams.prefix_sums(w.hash[lo:hi]), start[at:to] - lo, stop[at:to] - lo)
            at = to
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.tokens, self.row = h[once], row[once]
        self.ends = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.sizes = np.diff(self.ends)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.tokens), dtype=np.uint64)])
        self.ids = (mix(sums[self.ends[1:]] - sums[self.ends[:-1]] + self.sizes.astype(np.uint64) * _SALTS[7])).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def prefixes(sets: Sets, keep: np.ndarray, order: int, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the prefix of every kept set under one order."""
    row, tokens = sets.row[keep[sets.row]], sets.tokens[keep[sets.row]]
    rank = mix(tokens ^ _SALTS[order])
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        rank = (rank >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    by = np.lexsort((rank, row))
    row, tokens = row[by], tokens[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    inside = place < prefix_length(sets.sizes, percent)[row]
    return row[inside], tokens[inside]


def signatures(sets: Sets) -> pa.Array:
    """Each set's parities of token counts by class, a bit a class; an empty set has no odd class."""
    bits = np.full(len(sets.sizes), LEAST_BITS, np.int64)
    while (more := (bits < sets.sizes) & (bits < MOST_BITS)).any():
        bits[more] *= 2
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = (mix(sets.tokens ^ _SALTS[6]) & (bits[sets.row] - 1).astype(np.uint64)).astype(np.int64) + ends[sets.row]
    odd = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return binary_array(np.packbits(odd, bitorder="little"), ends // 8)


def _unlike_places(one: bytes, two: bytes) -> int:
    """Classes in which two signatures differ; the longer is folded to the classes of the shorter."""
    if len(one) < len(two):
        one, two = two, one
    a, b, bits = int.from_bytes(one, "little"), int.from_bytes(two, "little"), 8 * len(one)
    while bits > 8 * len(two):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def _alike(percent: int):
    """The pairs whose sets may link by their sizes and signatures."""

    def run(batches):
        for b in batches:
            total = b["hub_n"].to_numpy() + b["node_n"].to_numpy()
            unshared = total - 2 * -(-percent * total // (100 + percent))  # of linked sets, at most
            differ = np.array([_unlike_places(x, y) for x, y in zip(b["hub_sign"].to_pylist(), b["node_sign"].to_pylist())], np.int64)
            found = pa.array(differ <= unshared)
            yield pa.record_batch({"hub": b["hub"].filter(found), "node": b["node"].filter(found)})

    return run


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (hub, node) that may link by the signatures of their nodes (node, n, sign)."""
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    signs = nodes.select("node", "n", "sign").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    one, two = (signs.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sign").alias(f"{c}_sign")) for c in ("hub", "node"))
    return pairs.join(one, "hub").join(two, "node").mapInArrow(rows_of(_alike(percent)), "hub long, node long")


def _close_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _summed(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, with the sums of their counts."""
    token, count = np.concatenate(tokens), np.concatenate(counts)
    order = np.argsort(token, kind="stable")  # a few sorted runs
    token, count = token[order], count[order]
    first = np.ones(len(token), bool)
    np.not_equal(token[1:], token[:-1], out=first[1:])
    return token[first], np.add.reduceat(count, np.flatnonzero(first)) if len(token) else count


def _sketch(shingle: int):
    """Rows (kind 0: id, key, size, set, signature; kind 1: token, count) of a task.

    Token counts are kept for up to ``COUNTED`` distinct tokens at a time; what was met once is not sent.
    """

    def often(tokens, count):
        keep = count >= FREQUENT_IN_TASK
        size = int(keep.sum())
        return pa.record_batch({"kind": pa.array(np.ones(size, np.int32)), "id": pa.nulls(size, id_type), "key": pa.nulls(size, pa.int64()), "n": count[keep], "node": tokens[keep].view(np.int64), "sign": pa.nulls(size, pa.binary())})

    id_type = pa.int64()

    def run(batches):
        nonlocal id_type
        held, counts, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        tokens_, counts_ = [held], [counts]
        for b in batches:
            id_type = b["id"].type
            for part in blocks(b, "text", BLOCK_ROWS, BLOCK_BYTES):
                s = Sets(part["text"], shingle)
                yield pa.record_batch({"kind": pa.array(np.zeros(len(s.sizes), np.int32)), "id": part["id"], "key": part["key"], "n": s.sizes.astype(np.int64), "node": s.ids, "sign": signatures(s)})
                _, first = np.unique(s.ids, return_index=True)
                keep = np.zeros(len(s.sizes), bool)
                keep[first] = True
                tokens, count = np.unique(s.tokens[keep[s.row]], return_counts=True)
                tokens_.append(tokens)
                counts_.append(count)
                fresh += len(tokens)
                if fresh > MERGED:
                    held, counts = _summed(tokens_, counts_)
                    if len(held) > COUNTED:
                        yield often(held, counts)
                        held, counts = held[:0], counts[:0]
                    tokens_, counts_, fresh = [held], [counts], 0
        held, counts = _summed(tokens_, counts_)
        if len(held):
            yield often(held, counts)

    return run


def _post(shingle: int, percent: int, order: int, frequent: np.ndarray):
    """Prefix postings of the distinct sets of a task; of many sets, those met lately are told from new ones."""

    def run(batches):
        posted: set[int] = set()
        for b in batches:
            for part in blocks(b, "text", BLOCK_ROWS, BLOCK_BYTES):
                s = Sets(part["text"], shingle)
                ids, first = np.unique(s.ids, return_index=True)
                ids = ids.tolist()
                keep = np.zeros(len(s.sizes), bool)
                keep[first[[i not in posted for i in ids]]] = True
                if len(posted) > POSTED:
                    posted.clear()
                posted.update(ids)
                row, token = prefixes(s, keep & (s.sizes > 0), order, frequent, percent)
                yield pa.record_batch({"token": token.view(np.int64), "node": s.ids[row], "n": s.sizes[row].astype(np.int64)})

    return run


def _lists(batches):
    """From postings sorted by token and node: the rows of lists with two nodes or more.

    Only the last row is carried from batch to batch, whatever a list's length.
    """
    held = None  # token, node, n, whether it was sent
    for b in batches:
        token, node, n = (b[c].to_numpy() for c in ("token", "node", "n"))
        if held is not None:
            token, node, n = np.append(held[0], token), np.append(held[1], node), np.append(held[2], n)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        sent = np.zeros(len(token), bool)
        if held is not None:
            sent[0] = held[3]
        token, node, n, sent = token[new], node[new], n[new], sent[new]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        in_company = ~first
        in_company[:-1] |= ~first[1:]
        out = in_company & ~sent
        yield pa.record_batch({"token": token[out], "node": node[out], "n": n[out]})
        held = (token[-1], node[-1], n[-1], bool(sent[-1] or in_company[-1]))


LISTED = "token long, node long, n long"


def _listed(texts: DataFrame, shingle: int, percent: int, order: int, frequent: np.ndarray) -> DataFrame:
    posted = texts.mapInArrow(_post(shingle, percent, order, frequent), "token long, node long, n long")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posted.repartition(parts, "token").sortWithinPartitions("token", "node").mapInArrow(rows_of(_lists), LISTED)


def rows_of(fn):
    """Empty batches are left out before and after."""

    def run(batches):
        yield from (b for b in fn(b for b in batches if b.num_rows) if b.num_rows)

    return run


def _shares_prefixes(one: np.ndarray, two: np.ndarray, percent: int, orders: tuple[int, ...]) -> bool:
    """Whether two sets share enough prefix tokens under every one of some orders by hash."""
    a, b = len(one), len(two)
    need = max(1, -(-percent * (a + b) // (100 + percent)) - (-(-percent * max(a, b) // 100) - 1))
    for k in orders:
        cut = [np.partition(h, p - 1)[:p] if p < len(h) else h for h, p in ((mix(x ^ _SALTS[k]), int(prefix_length(np.int64(len(x)), percent))) for x in (one, two))]
        if len(np.intersect1d(*cut, assume_unique=True)) < need:
            return False
    return True


def _verify(shingle: int, percent: int, orders: tuple[int, ...] = ()):
    """Rows sorted by hub, the hub's own first: links of the members whose sets are near the hub's."""

    def run(batches):
        hub, hub_set = None, np.zeros(0, np.uint64)
        for b in batches:
            for part in blocks(b, "text", BLOCK_ROWS, BLOCK_BYTES):
                s = Sets(part["text"], shingle)
                hubs, own = part["hub"].to_numpy(), part["node"].to_numpy()
                found = np.zeros(len(hubs), bool)
                for i in range(len(hubs)):
                    mine = s.tokens[s.ends[i] : s.ends[i + 1]]
                    if own[i] == hubs[i]:
                        hub, hub_set = hubs[i], mine
                    elif hub == hubs[i] and len(mine) and len(hub_set) and _shares_prefixes(hub_set, mine, percent, orders):
                        at_hub = np.minimum(np.searchsorted(hub_set, mine), len(hub_set) - 1)
                        shared = int((hub_set[at_hub] == mine).sum())
                        found[i] = 100 * shared >= percent * (len(mine) + len(hub_set) - shared)
                yield pa.record_batch({"a": hubs[found], "b": own[found]})

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int, orders: tuple[int, ...] = ()) -> DataFrame:
    """Links among ``pairs`` (hub, node), decided on one text (id, key, text) of each of their nodes (id, key, node)."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(HUB_MEMBERS)).alias("salts"))
    salted = pairs.join(salts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
    hubs = salts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    members = salted.unionByName(hubs)
    # Rows of one set may differ in text; one of them stands for it.
    heads = nodes.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "id")).alias("row"))
    rid = F.xxhash64("id", "key").alias("rid")
    placed = stored(members.join(heads.select("node", "row.*").select("node", rid), "node").select("hub", "salt", "node", (F.col("node") != F.col("hub")).alias("member"), "rid"), "met-rows")
    mark = F.pmod("rid", F.lit(TEXT_MARKS)).alias("mark")
    marks = placed.select(mark).distinct()
    near = texts.select(rid, "text").select("*", mark).join(F.broadcast(marks), "mark", "left_semi").drop("mark").dropDuplicates(["rid"])
    met = placed.join(near, "rid").repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return met.select("hub", "node", "text").mapInArrow(rows_of(_verify(shingle, percent, orders)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, node and key (fingerprints of set and text), component_id (least id reachable)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    sketch = stored(texts.mapInArrow(_sketch(shingle), f"kind int, id {kind}, key long, n long, node long, sign binary"), "sketch")
    marks = sketch.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT)
    frequent = np.sort(marks.select("node").toPandas()["node"].to_numpy(np.int64).view(np.uint64))  # at most FREQUENT of 8 bytes
    nodes = sketch.filter("kind = 0").select("id", "n", "node", "key", "sign")

    listed = stored(_listed(texts, shingle, percent, 0, frequent), "posting-lists")
    first = stored(_possible(stored(_hubs(listed, percent), "hub-pairs"), nodes, percent), "pairs")
    links = stored(_linked(first, nodes, texts, shingle, percent), "links")
    grouped = components(links)

    longer = listed.groupBy("token").count().filter(F.col("count") > LONG_LIST).orderBy(F.desc("count"), "token").limit(FREQUENT)
    late = np.union1d(frequent, longer.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))  # at most twice FREQUENT
    second = stored(_listed(texts, shingle, percent, 1, late), "posting-lists")
    pairs = stored(_possible(stored(_between(second, grouped, percent), "met-pairs"), nodes, percent), "pairs")
    more = stored(_linked(pairs, nodes, texts, shingle, percent, tuple(k for k in range(orders + 1) if k != 1)), "links")
    root = components(links.unionByName(more))
    joined = nodes.select("id", "n", "node", "key").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", "key", component.alias("component_id"))


def _hubs(listed: DataFrame, percent: int) -> DataFrame:
    """(hub, node): for every listed node the hubs it meets in most lists and could link with."""
    n = F.col("n")
    prefix = n - F.ceil(F.lit(percent) * n / 100.0) + 1
    central = listed.groupBy("node", "n").agg(F.count("*").alias("c")).select("node", (F.col("c") / prefix).alias("share"))
    rows_ = listed.select("token", "node", "n").join(central, "node")
    hub = F.max_by(F.struct("node", "n"), F.struct("share", "node")).alias("h")
    met = rows_.join(rows_.groupBy("token").agg(hub), "token").select("node", "n", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    close = met.filter((F.col("node") != F.col("hub")) & _close_sizes(F.col("n"), F.col("hub_n"), percent)).groupBy("node", "hub").agg(F.count("*").alias("c"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "hub"))
    return close.withColumn("_n", best).filter(F.col("_n") <= HUBS).select("hub", "node")


def _between(listed: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) of different components that meet in a list of the second order.

    Lists of up to ``JOINED_LIST`` nodes are joined. Longer ones, where near copies crowd, are compared
    inside tasks, in square blocks, and only pairs that share enough prefix tokens come out.
    """
    placed = listed.select("token", "node", "n").join(grouped.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token", "size")
    rows_ = stored(placed.join(sizes, "token"), "mixed-lists")
    short = rows_.filter(F.col("size") <= JOINED_LIST)
    other = short.select("token", *[F.col(c).alias(f"l_{c}") for c in ("node", "n", "comp")])
    met = short.join(other, "token").filter((F.col("l_node") < F.col("node")) & (F.col("comp") != F.col("l_comp")) & _close_sizes(F.col("n"), F.col("l_n"), percent))
    joined = met.select(F.col("l_node").alias("hub"), "node").distinct()

    crowded = rows_.filter(F.col("size") > JOINED_LIST)
    # Prefix tokens in no company are shared by no pair.
    prefixes_ = listed.join(crowded.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("prefix"))
    blocks_ = F.ceil(F.col("size") / F.lit(MATRIX_ROWS))
    own = F.pmod(F.xxhash64("node"), blocks_)
    spread = crowded.select("token", "node", "n", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks_ - 1)).alias("other"))
    keyed = spread.join(prefixes_, "node").select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "comp", "prefix")
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "own", "node")
    compared = ordered.mapInArrow(_crowds(percent), "hub long, node long")
    return joined.unionByName(compared).distinct()


def _crowds(percent: int):
    """Rows of one block pair of a list together: the pairs of different components with enough common prefix tokens."""

    def compare(table: pa.Table):
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        own, node, n, comp = (table[c].to_numpy() for c in ("own", "node", "n", "comp"))
        prefix = table["prefix"].combine_chunks()
        offsets, tokens = prefix.offsets.to_numpy(), prefix.values.to_numpy().view(np.uint64)
        sets = [np.sort(tokens[a:z]) for a, z in zip(offsets[:-1], offsets[1:])]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(p) for p in sets])
        shared = np.bincount(ids)[ids] > 1
        used, column = np.unique(ids[shared], return_inverse=True)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(used), 2048):  # a strip of tokens at a time
            strip = np.zeros((len(sets), min(2048, len(used) - at)), np.float32)
            inside = (column >= at) & (column < at + 2048)
            strip[row[shared][inside], column[inside] - at] = 1
            common += strip[left] @ strip[right].T
        a, b = n[left][:, None], n[right][None, :]
        big, small = np.maximum(a, b), np.minimum(a, b)
        need = np.maximum(1, -(-percent * (a + b) // (100 + percent)) - (-(-percent * big // 100) - 1))
        hit = (common >= need) & (100 * small >= percent * big) & (comp[left][:, None] != comp[right][None, :]) & (node[left][:, None] != node[right][None, :])
        # A pair that meets in several lists comes out of the one of its least common token.
        token = np.int64(table["token"][0].as_py()).view(np.uint64)
        met = [(i, j) for i, j in zip(*np.nonzero(hit)) if np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)[0] == token]
        if not met:
            return pa.record_batch({"hub": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        i, j = np.array(met).T
        one, two = node[left[i]], node[right[j]]
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
        return pa.record_batch({"hub": pairs[:, 0], "node": pairs[:, 1]})

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = np.stack([b[c].to_numpy() for c in ("token", "x", "y")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, z in zip(cuts, np.append(cuts[1:], len(keys))):
                if key is not None and tuple(keys[a]) != key:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                key = tuple(keys[a])
                held.append(b.slice(a, z - a))
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows_of(run)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of every component the row of its least id, of repeated rows one."""
    row = F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)))
    found = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col)
    stays = found.filter(F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")))
    first = stays.groupBy("node", id_col).agg(F.min("key").alias("key")).select(F.col(id_col).alias("_id"), F.col("key").alias("_key"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row.alias("_k"))
    chosen = stored(first.select(F.xxhash64("_id", "_key").alias("_k")).distinct(), "kept-rows")
    once = marked.join(chosen, "_k", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("_k"))).filter("_n = 1")
    return once.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
