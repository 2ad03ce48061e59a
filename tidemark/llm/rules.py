"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
a policy is a named, versioned mask over those bits, and an ablation of a policy is a sum over distinct
bitmasks. Changing a policy never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows each get their own
ledger row; an empty table gives an empty ledger; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import NOT_SPACE, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits are never reused; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule(4, "shouting", "2 * n_upper > word_chars"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "stuttering", "10 * n_stutters > 4 * n_words"),
)
BIT = {r.name: 1 << r.bit for r in RULES}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


def policy(name: str, version: int, *rules: str) -> Policy:
    return Policy(name, version, sum(BIT[r] for r in rules))


BASE = policy("base", 1, "few_words", "repeated_windows")
WEB = policy("web", 1, *(r.name for r in RULES))


def _repeat_words() -> Column:
    """Words inside windows that occur at least twice; column ``h`` has the hash of the window at each start."""
    at = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = F.zip_with(at, F.slice(at, 2, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    start = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    return F.aggregate(
        start,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
    )["n"]


def measure(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key`` and the measurements of every text: one pass over its words, no shuffle."""
    d = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("t"), words(text).alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    d = d.select(
        "key", "t", "w", F.array_join("w", "").alias("chars"),
        F.when(F.size("w") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("h"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    following = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length("chars"),
        "n_symbols": F.length(F.regexp_replace("chars", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeat_words()).otherwise(F.lit(0)),
        "n_upper": F.length(F.regexp_replace("chars", r"[^\p{Lu}]+", "")),
        "n_stutters": F.size(F.filter(F.zip_with("w", following, lambda a, b: a == b), lambda x: x)),
    }
    return d.select("key", *(c.cast("long").alias(n) for n, c in counts.items()))


def ledger(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, the measurements and ``failed_bits``, the sum of the bits of the rules that a document fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, key, text).withColumn("failed_bits", bits)


def fails(chosen: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(chosen.mask).cast("long")) != 0


def ablation(table: DataFrame, chosen: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that are kept once it is left out.

    Documents are counted by distinct bitmask first, so at most 2^rules rows leave the ledger's tasks.
    """
    def masked(mask: int) -> Column:
        return F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))

    n = table.groupBy(masked(chosen.mask).alias("failed_bits")).agg(F.count(F.lit(1)).alias("docs"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).cast("long")
    out = [F.struct(F.lit(r.name).alias("rule"), count(masked(1 << r.bit) != 0).alias("fails"), count(masked(chosen.mask) == 1 << r.bit).alias("only_this"),
                    count(masked(chosen.mask & ~(1 << r.bit)) == 0).alias("kept_without")) for r in rules if chosen.mask >> r.bit & 1]
    return n.agg(F.array(*out).alias("r")).select(F.inline("r")).select(F.lit(chosen.name).alias("policy"), F.lit(chosen.version).alias("version"), "*")


def keep(docs: DataFrame, text: str = "text", chosen: Policy = WEB) -> DataFrame:
    """The documents that a policy keeps, with all their columns; judged within the row, nothing is joined.

    The row number is always true of its condition. It keeps the filter above the ledger: pushed below, each rule would
    work out its measurements, and the words, anew.
    """
    judged = ledger(docs, F.struct(*(docs[c] for c in docs.columns)), docs[text]).withColumn("row", F.monotonically_increasing_id())
    return judged.where(~fails(chosen) & (F.col("row") >= 0)).select("key.*")
