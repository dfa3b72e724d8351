"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule next to the
measurements; a policy is a named, versioned set of rules, applied afterwards with one bitwise
`and`. Ablations need no second look at the texts: equal masks are counted first, and the few
distinct masks answer "what would rule r alone reject" for every policy.

Only column expressions run here. Cases: a null text counts as an empty one (no words, fails
`few_words`); rows that repeat are judged one by one; an empty table gives an empty ledger; other
columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

# Fixed order: a rule's place is its bit, so rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_or_long_words": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "100 * n_capitals > 40 * word_chars",
    "exclamations": "100 * n_exclamations > 10 * n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", tuple(RULES)),
}


def _count(chars: str) -> Column:
    return F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("bigint")


def _repeat_words() -> Column:
    """Words in three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Sorting (hash, place) pairs puts equal windows side by
    side, so the work is n log n for any text; a text without equal windows skips the sort.
    """
    covered = F.expr(
        """aggregate(
             sort_array(transform(
               filter(pairs, (e, j) -> e.h = get(pairs, j - 1).h or e.h = get(pairs, j + 1).h), e -> e.i)),
             named_struct('n', 0L, 'last', -3),
             (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i),
             a -> a.n)"""
    )
    return F.when(F.col("pairs").isNull(), F.lit(0).cast("bigint")).otherwise(covered)


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Measurements of every whole text."""
    clean = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    split = clean.withColumn("trimmed", F.btrim("text", F.lit(BLANKS))).withColumn(
        "words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE))
    )
    lined = split.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    windows = lined.withColumn(
        "hashes",
        F.when(
            F.size("words") >= 3,
            F.expr("transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))"),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    paired = windows.withColumn(
        "pairs",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.expr("sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))"),
        ),
    )
    return paired.select(
        key,
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _count("A-Z").alias("n_capitals"),
        _count("!").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Measurements and `failed_bits`, one bit per rule in the order of RULES."""
    bits = [F.when(F.expr(rule), F.lit(1 << place)).otherwise(F.lit(0)) for place, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, key).withColumn("failed_bits", total.cast("bigint"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """`base_failed`, `kept` and the policy's version for every row of a ledger."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask).cast("bigint")) != 0
    return rows.withColumns(
        {
            "base_failed": hit(POLICIES["base"].mask),
            "kept": ~hit(policy.mask | POLICIES["base"].mask),
            "policy": F.lit(policy.version),
        }
    )


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that no other rule would reject.

    Documents are counted by mask before anything else, so at most 2^rules rows go further.
    """
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    places = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).cast("bigint").alias("bit")) for rule in policy.rules])
    each = masks.select("bits", "n", F.explode(places).alias("r"))
    own = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )
