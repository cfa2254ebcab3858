"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; a policy is a
named, versioned set of rules, so a verdict is one bitwise AND, and ablations (how many documents a rule removes, and
how many it alone removes) are aggregates over the bits, without a second look at the texts.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import SPACES, words_of

WINDOW = 5
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule's bit and the condition, over measurements, under which a document fails it."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 10 * F.col("word_chars")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
    Rule(4, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        """The bits of the rules."""
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words"))


def _repeat_words(words: Column) -> Column:
    """Words inside windows whose word sequence occurs at least twice in the document."""
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    side_by_side = F.arrays_zip(*(F.slice(words, k + 1, n) for k in range(WINDOW)))
    hashed = F.transform(side_by_side, lambda x, i: F.struct(
        F.xxhash64(*(x.getField(str(k)) for k in range(WINDOW))).alias("h"), i.alias("i")))
    return F.sort_array(hashed)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``
    (those equal to an earlier line) and ``n_repeat_words`` (words in windows of five found twice or more). Null and
    empty texts measure 0. Windows are told apart by a 64-bit hash. Columns of these names, and those the work goes by
    (``_words``, ``_lines``, ``_sorted``, ``_hashes``, ``_at``), are replaced or left out; all others pass through.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    read = read.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": _repeat_words(F.col("_words")),
    })
    # Windows with an equal neighbour in hash order, then their places in text order.
    m = F.size("_sorted")
    none = F.array(F.lit(None).cast("bigint"))
    hashes = F.transform("_sorted", lambda x: x["h"])
    read = read.withColumn("_hashes", hashes)
    before = F.concat(none, F.slice("_hashes", 1, F.greatest(m - 1, F.lit(0))))
    after = F.concat(F.slice("_hashes", 2, F.greatest(m - 1, F.lit(0))), none)
    triples = F.arrays_zip(F.col("_sorted").alias("own"), before.alias("before"), after.alias("after"))
    twice = F.filter(triples, lambda x: (x["own"]["h"] == x["before"]) | (x["own"]["h"] == x["after"]))
    read = read.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["own"]["i"])))
    k = F.size("_at")
    following = F.concat(F.slice("_at", 2, F.greatest(k - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
    covered = F.zip_with("_at", F.slice(following, 1, k), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
    counted = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return read.withColumn("n_repeat_words", counted).drop("_words", "_lines", "_sorted", "_hashes", "_at")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failed``, the bits of the rules each document fails."""
    bits = [F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, text).withColumn("failed", failed)


def apply_policy(book: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """Add the policy's verdict: true for documents that fail none of its rules."""
    return book.withColumn(into, F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were dropped.

    One aggregate over the bits; the texts are not read again. A table without rows gives counts of 0.
    """
    own = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    chosen = [r for r in RULES if r.name in policy.rules]
    sums = [F.count(F.when(own == 0, 1)).alias("kept")]
    for r in chosen:
        sums += [F.count(F.when(own.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, 1)).alias(f"{r.name}_failed"),
                 F.count(F.when(own == (1 << r.bit), 1)).alias(f"{r.name}_alone")]
    one = book.agg(*sums)
    rows = F.array(*(F.struct(
        F.lit(f"{policy.name}/{policy.version}").alias("policy"), F.lit(r.name).alias("rule"), F.col(f"{r.name}_failed").alias("failed"),
        F.col(f"{r.name}_alone").alias("alone"), (F.col("kept") + F.col(f"{r.name}_alone")).alias("kept_without")) for r in chosen))
    return one.select(F.explode(rows).alias("r")).select("r.*")
