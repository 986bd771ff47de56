"""A ledger of quality rules: measure once, keep failure bits, judge by versioned policy.

Every rule is evaluated once per text and sets one bit. A policy is a mask of bits that
reject, so policies can be compared, and rules ablated, from the ledger alone without
reading a text again. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

# Name and failure test over the measures; the place in the list is the bit. Only add at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


POLICIES: dict[str, int] = {
    "v1": mask("few_words", "repeated_windows"),
    "v2": mask("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals"),
}
LATEST = "v2"


def _repeated(df: DataFrame, words: str) -> DataFrame:
    """Add ``n_repeat_words``: words in windows that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' hashes, within one text. Only
    texts that have a window twice are sorted; the covered words are then counted from
    the places of those windows in order.
    """
    last = F.size(words) - WINDOW
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.when(
        last > 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))),
    )
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = F.when(
        twice, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    )
    same = lambda e, k: F.coalesce(F.get("_sorted", k)["x"] == e["x"], F.lit(False))
    places = F.sort_array(
        F.transform(F.filter("_sorted", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])
    )
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda had, p: F.struct(p.alias("last"), (had["n"] + F.least(F.lit(WINDOW), p - had["last"])).alias("n")),
        lambda had: had["n"],
    )
    for name, c in (("_hashes", hashed), ("_windows", windows), ("_sorted", sorted_), ("_places", places)):
        df = df.withColumn(name, c)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_hashes", "_windows", "_sorted", "_places"
    )


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures and ``fail_bits``, one bit per rule that fails.

    Null counts as the empty text: no words, so ``few_words`` fails. Texts are measured
    whole. Columns with these names are replaced; repeated rows are kept.
    """
    made = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    made = made.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
    made = made.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    made = made.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)).cast("long"),
            "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    made = _repeated(made, "_words").drop("_words", "_lines", "_text")
    bits = sum((F.when(F.expr(test), F.lit(1 << k)).otherwise(0) for k, (_, test) in enumerate(RULES)), F.lit(0))
    return made.withColumn("fail_bits", bits.cast("long"))


def rejects(version: str = LATEST) -> Column:
    """Whether a row of the ledger fails any rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) != 0


def ablations(rows: DataFrame, version: str = LATEST) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects.

    Rows are first counted per combination of bits, at most ``2 ** len(RULES)`` of them.
    An empty ledger gives zeros.
    """
    held = POLICIES[version]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(held)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & held))
    zero = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("n"))
    each = counts.union(zero).select("bits", "n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
    )
