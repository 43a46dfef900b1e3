"""Collocations: phrases whose words meet far more often than alone, counted by tries.

Candidates come from the Apriori rule with hashed counts (Park, Chen and Yu): a phrase can only be
frequent if the phrases without its first and without its last word are, and if the
bucket its fingerprint falls in is. One pass counts the buckets of the pairs of frequent words, a second those of all longer
phrases made of frequent pairs; a bucket table is a bit map of fixed size (``BUCKET_BITS``). Buckets that
share phrases let too many through, never too few. What passes all maps is listed, as
text in order, and cut into tries of at most ``TRIE_PHRASES`` phrases. It is listed from a small share of the texts first, then
from larger ones and from all, each time without what is known by then (``SHARES``): a phrase comes from about as many tasks
as its first share has places of it, so the rows grow with the text and not with tasks times phrases.

A trie is a double array (base, check) over the words of its phrases. Up to ``PASS_TRIES`` of them are broadcast; numpy sets every text
position to the root and moves all their states one word on, level by level; the accepting states are counted with
``bincount`` and the counts of all tasks summed by Spark. Only these counts decide what is frequent.

Memory: bit maps, the tries of a pass and a block of text (a longer text in slices of ``STEP`` words). A corpus with more candidates
takes more passes. Word fingerprints are 64 bits, mixed with the language.

Defined cases: a null text has no words, a null language is ``und``; repeated rows count each time; texts without a
frequent phrase and empty tables give nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadstone.llm import grams
from loadstone.llm.common import binary_array, blocks, flat_bytes, mix, spread_ranges, stored

LONGEST = 5
LEAST = 100
TOP = 2000
BUCKET_BITS = 26
TRIE_PHRASES = 1 << 18
PASS_TRIES = 12
COUNT_TASKS = 8
STEP = 1 << 20
HELD = 1 << 20
KNOWN = 1 << 22
SHARES = (64, 8, 1)
BLOCK_BYTES = 3 << 19

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_BREAKS = _PIECE_ENDS.copy()
_BREAKS[[9, 32]] = True


class Line(NamedTuple):
    """Words in a row; windows may begin at the first ``begins`` of them."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # fingerprint of language and word
    piece: np.ndarray  # words of one piece share a number
    lang: np.ndarray  # number of the word's language in ``langs``
    langs: list[str]
    begins: int


def _lines(batches: Iterator[pa.RecordBatch], longest: int, step: int) -> Iterator[Line]:
    for batch in batches:
        for b in blocks(batch, "_text", 4096, BLOCK_BYTES):
            offsets, raw = flat_bytes(b["_text"])
            w = grams.words(raw, offsets, lower=True, breaks=_BREAKS)
            if not len(w.start):
                continue
            named = b["_lang"].dictionary_encode()
            langs = named.dictionary.to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(w.offsets))
            lang = named.indices.to_numpy()[doc]
            ends = np.flatnonzero(_PIECE_ENDS[raw])
            piece = np.searchsorted(ends, w.start) + doc  # grows at every end of a piece or text
            word = mix(w.hash ^ seeds[lang])
            for lo in range(0, len(word), step):
                to = min(len(word), lo + step + longest - 1)
                yield Line(raw, w.start[lo:to], w.end[lo:to], word[lo:to], piece[lo:to], lang[lo:to], langs, min(step, len(word) - lo))


def _word_counts(longest: int, step: int):
    def run(batches):
        for x in _lines(batches, longest, step):
            word, at, n = np.unique(x.word[: x.begins], return_index=True, return_counts=True)
            yield pa.record_batch({"lang": pa.DictionaryArray.from_arrays(pa.array(x.lang[at], pa.int32()), pa.array(x.langs)).cast(pa.string()), "word": _phrases(x, at, 1), "mark": word.view(np.int64), "n": n})

    return run


def _phrases(x: Line, at: np.ndarray, length: int) -> pa.Array:
    """The phrases of ``length`` words that begin at the places ``at``, lower-cased, one space between words."""
    which = (at[:, None] + np.arange(length)).ravel()
    sizes = x.end[which] - x.start[which]
    gaps = np.ones(len(which), np.int64)
    gaps[length - 1 :: length] = 0
    source = spread_ranges(x.start[which], sizes + gaps)
    out = x.raw[np.minimum(source, max(len(x.raw) - 1, 0))]
    stops = np.cumsum(sizes + gaps)
    out[stops[gaps == 1] - 1] = 32
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return binary_array(out, np.concatenate([[0], stops[length - 1 :: length]]), pa.string())


def _buckets(marks: np.ndarray, bits: int) -> np.ndarray:
    return (marks >> np.uint64(64 - bits)).astype(np.int64)


def _in_map(bit_map: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bit_map[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _live(x: Line, maps: list[np.ndarray], bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length from 2: that length, the places of phrases whose shorter parts lie in frequent
    buckets as far as the maps go, and the fingerprints of these phrases."""
    places = np.flatnonzero(_in_map(maps[0], _buckets(x.word, bits)))
    mark = x.word[places]
    for length in range(2, longest + 1):
        both = np.flatnonzero(places[1:] == places[:-1] + 1) if len(places) else places  # the next place lives, too
        at = places[both]
        inside = x.piece[at + length - 1] == x.piece[at]  # the last of the next place's words is inside
        places, mark = at[inside], mark[both][inside]
        mark = mix(mark * grams.ODD + x.word[places + length - 1])
        yield length, places, mark
        if length <= len(maps):
            kept = _in_map(maps[length - 1], _buckets(mark, bits))
            places, mark = places[kept], mark[kept]


def _bucket_counts(maps: list[np.ndarray], lengths: range, bits: int, longest: int, step: int):
    """Counts of the buckets of phrases of ``lengths`` words, a table of ``1 << bits`` to a length."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        for x in _lines(batches, longest, step):
            for length, at, mark in _live(x, maps, bits, lengths[-1]):
                if length in lengths:
                    held.append(np.unique(_buckets(mark[at < x.begins], bits) + (lengths.index(length) << bits), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                keys, n = merged()
                held[:] = [(keys, n)]
                if len(keys) > HELD // 2:
                    yield pa.record_batch({"bucket": keys, "n": n})
                    held.clear()
        if held:
            keys, n = merged()
            yield pa.record_batch({"bucket": keys, "n": n})

    return run


def _without(known: np.ndarray, mark: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of the fingerprints ``mark`` and their places is not in ``known`` (sorted)."""
    if not len(known):
        return mark, first
    new = known[np.minimum(np.searchsorted(known, mark), len(known) - 1)] != mark
    return mark[new], first[new]


def _candidates(sent: Broadcast, bits: int, longest: int, step: int, given: np.ndarray):
    """The phrases that lie in frequent buckets with all their parts, but for those of the fingerprints ``given``: once a task, while ``HELD`` fingerprints are enough to remember."""

    def run(batches):
        maps = sent.value
        known = np.zeros(0, np.uint64)
        for x in _lines(batches, longest, step):
            for length, at, mark in _live(x, maps, bits, longest):
                kept = (at < x.begins) & _in_map(maps[length - 1], _buckets(mark, bits))
                mark, first = np.unique(mark[kept], return_index=True)
                mark, first = _without(given, mark, first)
                mark, first = _without(known, mark, first)
                if not len(mark):
                    continue
                known = np.sort(np.concatenate([known, mark])) if len(known) <= HELD else np.zeros(0, np.uint64)
                at = at[kept][first]
                lang = pa.DictionaryArray.from_arrays(pa.array(x.lang[at], pa.int32()), pa.array(x.langs)).cast(pa.string())
                yield pa.record_batch({"lang": lang, "phrase": _phrases(x, at, length), "mark": mark.view(np.int64)})

    return run


def _listed(texts: DataFrame, maps: list[np.ndarray], bits: int, longest: int, step: int) -> DataFrame:
    """(lang, phrase) of all candidates. Up to ``KNOWN`` fingerprints of what earlier shares gave are told to the tasks; the rest comes again and is merged."""
    given, found = np.zeros(0, np.uint64), []
    sent = texts.sparkSession.sparkContext.broadcast(maps)  # once for all shares
    for share in SHARES:
        some = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(share)) == 0) if share > 1 else texts
        rows = some.mapInArrow(_candidates(sent, bits, longest, step, given), "lang string, phrase string, mark long").distinct()
        if share > 1:
            rows = stored(rows, "listed")
            fresh = rows.select("mark").limit(KNOWN - len(given)).toArrow()["mark"].to_numpy().view(np.uint64)
            given = np.union1d(given, fresh)
        found.append(rows.select("lang", "phrase"))
    return reduce(DataFrame.unionByName, found).distinct()


class Trie(NamedTuple):
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray  # number of the phrase that ends in a state, -1 without one


class Alphabet(NamedTuple):
    words: np.ndarray  # sorted fingerprints
    codes: np.ndarray  # from 1; frequent words have small codes, so families of states are dense


def alphabet(words: np.ndarray) -> Alphabet:
    words, n = np.unique(words, return_counts=True)
    codes = np.empty(len(words), np.int32)
    codes[np.argsort(-n, kind="stable")] = np.arange(1, len(words) + 1)
    return Alphabet(words, codes)


def coded(letters: Alphabet, word: np.ndarray) -> np.ndarray:
    """Codes of words, 0 outside the alphabet."""
    at = np.minimum(np.searchsorted(letters.words, word), len(letters.words) - 1)
    return np.where(letters.words[at] == word, letters.codes[at], 0).astype(np.int64)


def double_array(code: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> Trie:
    """Double-array trie of phrases, given as the codes of all their words and their lengths, accepting ``numbers``."""
    ends = np.cumsum(sizes)
    table = np.zeros((len(sizes), int(sizes.max())), np.int64)
    table[np.repeat(np.arange(len(sizes)), sizes), spread_ranges(np.zeros(len(sizes), np.int64), sizes)] = code
    order = np.lexsort(table.T[::-1])
    table, sizes, numbers = table[order], sizes[order], numbers[order]
    room = 2 * int(ends[-1]) + int(code.max()) + 1024
    free = np.ones(room, bool)
    base, check, accepts = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int64)
    free[0] = False
    state = np.zeros(len(table), np.int64)  # of the phrase's beginning so far
    top = 0  # last place taken
    for level in range(table.shape[1]):
        live = np.flatnonzero(sizes > level)
        parent, code = state[live], table[live, level]
        new = np.ones(len(live), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])  # equal beginnings stand together
        family, child = parent[new], code[new]
        edges = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
        edges = np.append(edges, len(family))
        width = np.diff(edges)
        slots = np.empty(len(family), np.int64)
        lowest = 1
        for k in np.argsort(-width, kind="stable")[: int((width > 1).sum())]:
            mine = slice(edges[k], edges[k + 1])
            shape = np.sort(child[mine])
            shape = shape - shape[0]
            # First fit among the lowest free places, then where the last families' places thin out; behind all at the latest.
            tail = max(lowest, top + 1 - int(shape[-1]))
            spot = top + 1
            for at in [*range(lowest, lowest + 1024, 256), *range(tail, top + 1, 256)]:
                if at + 256 + shape[-1] >= len(free):
                    break
                fits = np.flatnonzero(free[at + np.arange(256)[:, None] + shape[None, :]].all(1))
                if len(fits):
                    spot = at + int(fits[0])
                    break
            while spot + shape[-1] >= len(free):
                free, base = np.append(free, np.ones(len(free), bool)), np.append(base, np.zeros(len(base), np.int32))
                check, accepts = (np.append(a, np.full(len(a), -1, a.dtype)) for a in (check, accepts))
            slots[mine] = spot - child[mine].min() + child[mine]
            free[slots[mine]] = False
            top = max(top, int(spot + shape[-1]))
            while not free[lowest]:
                lowest += 1
        single = edges[:-1][width == 1]
        open_ = np.flatnonzero(free[1:])[: len(single)] + 1
        while len(open_) < len(single):
            free, base = np.append(free, np.ones(len(free), bool)), np.append(base, np.zeros(len(base), np.int32))
            check, accepts = (np.append(a, np.full(len(a), -1, a.dtype)) for a in (check, accepts))
            open_ = np.flatnonzero(free[1:])[: len(single)] + 1
        slots[single] = open_
        free[open_] = False
        top = max(top, int(open_[-1]) if len(open_) else 0)
        base[family] = slots - child
        check[slots] = family
        state[live] = slots[np.cumsum(new) - 1]
        done = sizes == level + 1
        accepts[state[done]] = numbers[done]
    used = int(np.flatnonzero(~free)[-1]) + 1
    return Trie(base[:used].copy(), check[:used].copy(), accepts[:used].copy())


def advance(trie: Trie, code: np.ndarray, piece: np.ndarray, begins: int) -> np.ndarray:
    """How often each state is reached from the root by phrases that begin at the first ``begins`` words."""
    counts = np.zeros(len(trie.base), np.int64)
    place = np.flatnonzero(code[:begins])
    state, level = np.zeros(len(place), np.int64), 0
    while len(place):
        c = code[place + level]
        to = trie.base[state] + c
        good = (c > 0) & (to >= 0) & (to < len(trie.base))
        place, state, to = place[good], state[good], to[good]
        good = trie.check[to] == state
        place, state = place[good], to[good]
        counts += np.bincount(state, minlength=len(counts))
        level += 1
        more = place + level < len(code)
        place, state = place[more], state[more]
        same = piece[place + level] == piece[place]
        place, state = place[same], state[same]
    return counts


def _counted(letters: Alphabet, tries: list[Trie], longest: int, step: int):
    def run(batches):
        totals = [np.zeros(len(t.base), np.int64) for t in tries]
        for x in _lines(batches, longest, step):
            code = coded(letters, x.word)
            for t, total in zip(tries, totals):
                total += advance(t, code, x.piece, x.begins)
        for t, total in zip(tries, totals):
            found = np.flatnonzero((t.accepts >= 0) & (total > 0))
            yield pa.record_batch({"id": t.accepts[found], "a": total[found]})

    return run


def _bit_maps(marked: DataFrame, bits: int, n: int) -> list[np.ndarray]:
    """``bucket`` values as ``n`` bit maps of ``bits`` bits to a power of two: 8 MB each at 26."""
    bit = F.col("bucket") + 1  # these functions count from 1
    slices = marked.groupBy(F.bitmap_bucket_number(bit).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((n << bits) // 8, np.uint8)
    for r in slices:
        at = (r["slice"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return np.split(out, n)


def _ranges(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Ranges [low, high) that hold ``size`` ids of ascending ``spans`` each, the last one fewer; a range may go over many spans."""
    cuts, low, high, room = [], 0, 0, 0
    for at, end in spans:
        while at < end:
            if not room:
                low, room = at, size
            high = min(at + room, end)
            room -= high - at
            at = high
            if not room:
                cuts.append((low, high))
    return cuts + [(low, high)] if room else cuts


def _passes(listed: DataFrame, words: DataFrame, size: int, tries: int) -> Iterator[tuple[Alphabet, list[Trie]]]:
    """The candidates as tries of ``size`` phrases, the last one fewer, up to ``tries`` at a time with one alphabet."""
    spans = listed.groupBy(F.shiftright("id", 33).alias("file")).agg(F.max("id").alias("last")).orderBy("file").collect()
    cuts = _ranges([(s["file"] << 33, s["last"] + 1) for s in spans], size)
    for k in range(0, len(cuts), tries):
        parts = []
        for lo, hi in cuts[k : k + tries]:
            part = listed.filter((F.col("id") >= lo) & (F.col("id") < hi))
            rows = part.select("id", "lang", F.posexplode(F.split("phrase", " ")).alias("place", "word")).join(words, ["lang", "word"])
            got = rows.select("id", "place", "mark").toArrow()  # at most LONGEST rows a phrase
            ids, place, mark = (got[c].to_numpy() for c in ("id", "place", "mark"))
            order = np.lexsort((place, ids))
            numbers, sizes = np.unique(ids, return_counts=True)
            parts.append((mark[order].view(np.uint64), sizes, numbers))
        letters = alphabet(np.concatenate([m for m, _, _ in parts]))
        yield letters, [double_array(coded(letters, m), sizes, numbers) for m, sizes, numbers in parts]


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", bits: int = BUCKET_BITS, trie_phrases: int = TRIE_PHRASES, pass_tries: int = PASS_TRIES, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, word, n of all words; lang, phrase, a of all phrases of 2 to ``longest`` words found ``least`` times or more."""
    texts = docs.select(F.col(f"`{text_col}`").alias("_text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("_lang"))
    seen = texts.mapInArrow(_word_counts(longest, step), "lang string, word string, mark long, n long")
    words = stored(seen.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("mark").alias("mark")), "words")
    frequent = words.filter(F.col("n") >= least)
    maps = _bit_maps(frequent.select(F.shiftrightunsigned("mark", 64 - bits).alias("bucket")), bits, 1)
    for lengths in [range(2, 3), range(3, longest + 1)]:
        if len(lengths) and longest > 1:
            counts = texts.mapInArrow(_bucket_counts(list(maps), lengths, bits, longest, step), "bucket long, n long")
            maps += _bit_maps(counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), bits, len(lengths))
    listed = stored(_listed(texts, list(maps), bits, longest, step).orderBy("lang", "phrase").withColumn("id", F.monotonically_increasing_id()), "candidates")
    # Every task sends a row for each phrase it met, so there are as many tasks as run at once, however many files there are.
    few = texts.coalesce(max(COUNT_TASKS, texts.sparkSession.sparkContext.defaultParallelism))
    counted = None
    for letters, tries in _passes(listed, frequent.select("lang", "word", "mark"), trie_phrases, pass_tries):
        part = stored(few.mapInArrow(_counted(letters, tries, longest, step), "id long, a long").groupBy("id").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "phrase-counts")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = listed.select("id", F.lit(0).cast("long").alias("a")).limit(0)
    return words.select("lang", "word", "n"), listed.join(counted, "id").select("lang", "phrase", "a")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """The first ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its worst cut in two, floor(1000 a n / (l r)), ties to the earliest cut; all arithmetic is exact
    (decimals of 38 digits). Phrases inside a longer one of the same count are left out.
    """
    words, phrases = count_phrases(docs, least, longest, text_col, lang_col, **sizes)
    phrases = stored(phrases, "phrases")
    known = phrases.withColumnRenamed("a", "f").unionByName(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    part = F.split("phrase", " ")
    # Every cut of every phrase, its parts looked up in one shuffle by language and part.
    cuts = phrases.select("lang", "phrase", "a", part.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(False).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("part")))).alias("s"))
    counted = sides.select("lang", "phrase", "a", "k", "s.left", F.col("s.part").alias("part")).join(known.withColumnRenamed("phrase", "part"), ["lang", "part"])
    both = counted.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    scored = both.join(totals, "lang").withColumn("_p", wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("_q", wide["l"] * wide["r"]).withColumn("score", F.expr("_p div _q"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # A longer phrase of the same count hides all it contains.
    inner = phrases.withColumn("w", part).filter(F.size("w") > 2).select("lang", "a", F.explode(F.expr(
        "filter(flatten(transform(sequence(1, size(w) - 1), i -> transform(sequence(2, size(w)), z -> CASE WHEN i + z - 1 <= size(w) AND z < size(w) THEN array_join(slice(w, i, z), ' ') END))), p -> p IS NOT NULL)")).alias("phrase"))
    hiding = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    open_ = worst.join(hiding, ["lang", "phrase"], "left").filter(F.col("_most").isNull() | (F.col("_most") < F.col("a")))
    ranked = open_.select("lang", F.col("c.score").alias("score"), "a", "phrase", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
