"""Quality rules as a bitmask ledger (operator 7), DataFrame functions only.

``ledger`` evaluates every rule once per document and stores its measurements and one
bit per failed rule. Policies are named bit masks: ``apply_policy`` keeps the rows whose
bits do not meet the mask, and ``ablation`` counts, by bitwise aggregation over the same
ledger, what each rule rejects, what it alone rejects, and what a policy without it keeps.
Nothing is shuffled for the ledger: it is one narrow pass.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; a null text has none. Measurements are those of ``MEASURES``.
Repeated 5-word windows are compared by a 64-bit hash within their document.

Cases: null and empty texts fail ``few_words``; repeated rows are judged alike; other
columns are returned unchanged (``ledger`` packs its own into one struct column, whose
name is a parameter); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters")

# (rule, it fails when ...) over the measurements m; the bit is the place in this list.
RULES: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("few_words", lambda m: m("n_words") < 10),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 5 * m("word_chars")),
    ("repeated_lines", lambda m: 100 * m("n_dup_lines") > 60 * m("n_lines")),
    ("shouting", lambda m: (100 * m("n_upper") > 70 * m("n_letters")) & (m("n_letters") > 0)),
    ("few_letters", lambda m: 100 * m("n_letters") < 40 * m("word_chars")),
    ("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "v1": BASE,
    "v2": BASE + ("symbols", "repeated_lines", "shouting", "few_letters", "long_words"),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once (a lambda variable, so Catalyst cannot copy the expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, k: int = 5) -> Column:
    """Words inside k-word windows that stand twice or more."""
    last = F.size(words) - k

    def covered(hashes: Column) -> Column:
        def spread(order: Column) -> Column:  # order: sorted (hash, place)
            n = F.size(order)
            h = lambda j: F.get(order, j)["h"]
            again = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ((j > 0) & (h(j) == h(j - 1))) | ((j < n - 1) & (h(j) == h(j + 1))))
            places = F.sort_array(F.transform(again, lambda j: F.get(order, j)["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
            return F.aggregate(places, zero, lambda s, p: F.struct((s["n"] + k - F.greatest(F.lit(0), s["upto"] - p)).alias("n"), (p + k).alias("upto")), lambda s: s["n"])

        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, spread))

    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(last < 1, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def measurements(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    size = lambda c: F.char_length(c).cast("long")
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), size(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    only = lambda chars: size(F.regexp_replace(text, f"[^{chars}]+", ""))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l"), only(SYMBOLS).alias("s"), only("\\p{Lu}").alias("u"), only("\\p{L}").alias("a")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["s"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["l"]["n_lines"].alias("n_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), m["u"].alias("n_upper"), m["a"].alias("n_letters")))


def judged(text: Column) -> Column:
    """Struct of all measurements and ``failed``, the rule bits."""
    def bits(m: Column) -> Column:
        failed = F.lit(0).cast("long")
        for k, (_, fails) in enumerate(RULES):
            failed = failed.bitwiseOR(F.when(fails(lambda n: m[n]), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(*(m[n].alias(n) for n in MEASURES), failed.alias("failed"))

    return let(measurements(text), bits)


def ledger(docs: DataFrame, text_col: str = "text", ledger_col: str = "quality_ledger") -> DataFrame:
    """``docs`` with one more struct column: every measurement and the failure bits."""
    return docs.withColumn(ledger_col, judged(F.col(text_col)))


def passes(ledger_col: str = "quality_ledger", policy: str = CURRENT) -> Column:
    return F.col(ledger_col)["failed"].bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(docs: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows a policy keeps, with the columns they came with."""
    return docs.filter(judged(F.col(text_col))["failed"].bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(ledgers: DataFrame, ledger_col: str = "quality_ledger", policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, rows kept without it."""
    whole = mask(POLICIES[policy])
    per_bits = ledgers.groupBy(F.col(ledger_col)["failed"].bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]))
    x = per_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("rule", "bit").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"))
