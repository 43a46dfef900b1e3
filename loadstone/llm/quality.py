"""Quality rules as a ledger of failure bits, built with DataFrame functions only.

``measure`` computes each document's counts once; ``ledger`` turns them into one long in which
bit k is set when rule k fails; a policy is a versioned set of rules, applied later by a bitwise
and. ``ablation`` needs no second look at the texts: it adds up the distinct bit patterns
(at most 2^rules) and asks, for every rule of a policy, how many documents it rejects at all,
rejects alone, and rejects in company.

Defined cases: a null or empty text has no words, fails the word-count rule and is rejected by
every policy that holds it; repeated rows are judged one by one; extra columns are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"


class Rule(NamedTuple):
    name: str
    fails: str  # SQL over the measures


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]


# The order gives the bits.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_shouts > 3 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "shouting"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts"]


def _repeated_words(words: Column, n: Column) -> tuple[Column, Column, Column]:
    """Steps to the words covered by 3-word windows that occur twice in the text.

    Each window is one long: a hash of its words with the low bits replaced by its place, so one
    sort of a primitive array brings equal windows together. Neighbours are compared by
    hash and then word by word.
    """
    places = F.length(F.bin(n))
    low = F.expr("shiftleft(1L, _bits) - 1L")

    def window(i):
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long"))

    keys = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n.cast("int") - 3), window))).otherwise(F.array().cast("array<long>"))
    return places, low, keys


def _same_window(words: Column, a: Column, b: Column) -> Column:
    low = F.col("_low")
    i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
    texts = (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))
    return F.coalesce(a.bitwiseOR(low) == b.bitwiseOR(low), F.lit(False)) & texts


def _row(docs: DataFrame, *left_out: str) -> Column:
    """All other columns as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in left_out]).alias("_row")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row`` (the other columns as a struct) and the measures as long columns prefixed ``_m_``."""
    others = [F.col("_row")]
    words, keys = F.col("_words"), F.col("_keys")
    split = docs.select(_row(docs, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_words", F.array_remove(F.split("_t", WORD_BREAK), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = split.select(
        *others, words,
        F.size(words).cast("long").alias("_m_n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("_m_word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("_m_n_symbols"),
        ((F.length("_t") - F.length(F.replace("_t", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("_m_n_shouts"),
        lines.alias("_lines"),
    )
    n = F.col("_m_n_words")
    bits, low, window_keys = _repeated_words(words, n)
    keyed = counted.withColumn("_m_n_lines", F.size("_lines").cast("long")).withColumn("_m_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    keyed = keyed.withColumn("_bits", bits).withColumn("_low", low).withColumn("_keys", window_keys)
    found = F.filter(keys, lambda x, k: _same_window(words, x, F.get(keys, k + 1)) | _same_window(words, x, F.get(keys, k - 1)))
    placed = keyed.withColumn("_at", F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.col("_low"))))).drop("_keys", "_words")
    fresh = F.aggregate(
        "_at", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return placed.withColumn("_m_n_repeat_words", fresh).select(*others, *[F.col(f"_m_{m}") for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``measures`` (struct of long) and ``failed`` (rule bits).

    A column of ``docs`` with one of these two names gives way."""
    m = measure(docs, text_col)
    # Exploding one element keeps a later filter above: pushed below, it would repeat the work for every use of a measure.
    packed = m.select("_row", F.explode(F.array(F.struct(*[F.col(f"_m_{x}").alias(x) for x in MEASURES]))).alias("measures"))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        sql = rule.fails
        for x in MEASURES:
            sql = sql.replace(x, f"measures.{x}")
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    others = [c for c in docs.columns if c not in (text_col, "measures", "failed")]
    return packed.select(*[F.col(f"_row.`{c}`") for c in others], "measures", bits.alias("failed"))


def mask(policy: Policy) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in policy.rules)


def rejects(policy: Policy, failed: str | Column = "failed") -> Column:
    c = F.col(failed) if isinstance(failed, str) else failed
    return c.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row per policy and rule: documents the rule fails, those it alone rejects, and those kept without it."""
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask"))
        for p in policies for k, r in enumerate(RULES) if r.name in p.rules
    ])
    c = patterns.select("failed", "n", F.explode(cases).alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = F.col("failed").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not(F.col("bit")))

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return c.groupBy("policy", "version", "rule").agg(
        total(hit).alias("n_failed"), total(hit & (others == 0)).alias("n_only_this"), total(others == 0).alias("n_kept_without"), F.sum("n").alias("n_documents"))


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy accepts, all columns as they were."""
    entries = ledger(docs.select(_row(docs).alias("_all"), F.col(text_col).alias("_text")), "_text")
    return entries.filter(~rejects(policy)).select(*[F.col(f"_all.`{c}`") for c in docs.columns])
