"""Judge URLs by fixed rules, and those that no rule fits by mined ones.

Fixed rules name a host and a path prefix; the longest that fits decides. The URLs they
decide are the labelled ones. From these Spark's FP-growth mines which combinations of
URL tokens go with which verdict; rules of too little support or confidence are cut,
and so is a rule when a part of its tokens already says the same as surely. The rest
are found by an inverted index: each rule stands under its rarest token, so a URL is
compared only with rules whose rarest token it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stage, with_row_key

SUPPORT = 0.002
CONFIDENCE = 0.8
MOST_TOKENS = 3
VERDICT = "verdict="


@dataclass(frozen=True)
class FixedRule:
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed(rules: list[FixedRule]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct, else null.

    A rule fits the host itself and its subdomains, where the path begins with the
    rule's, which begins with a slash; so none fits a URL without a path. Of two rules of one length the
    one with the longer host, then the first by name.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith("/" + r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, parts of the host, of the path with their depth, keys of the query.

    Numbers are one token, so that ids do not make every URL its own.
    """
    flat = lambda part: F.regexp_replace(part, r"\d+", "0")
    parts = F.split(F.col("host"), r"\.")
    n = F.size(parts)
    host = F.transform(parts, lambda p, i: F.concat(F.lit("h"), (n - i).cast("string"), F.lit("="), flat(p)))
    path = F.transform(
        F.filter(F.split(F.col("path"), "/"), lambda p: p != ""),
        lambda p, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), flat(p)),
    )
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(tail, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("q="), F.regexp_extract(p, "^[^=]*", 0))
    )
    scheme = F.array(F.concat(F.lit("s="), F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z]*", 0)))
    return F.array_distinct(F.concat(scheme, host, path, keys))


def mine(
    labelled: DataFrame,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """(tokens, verdict, confidence, support) from rows of (tokens, verdict).

    Every labelled row takes part. Rules have up to ``most_tokens`` tokens; one is cut
    if a proper part of its tokens has the same verdict with at least its confidence.
    """
    baskets = labelled.select(
        F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), F.col("verdict"))))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(VERDICT)).filter(F.size("antecedent") <= most_tokens)
    return rules.select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], len(VERDICT) + 1, 1 << 30).alias("verdict"),
        "confidence",
        "support",
    )


def prune(rules: DataFrame) -> DataFrame:
    """Cut each rule that a part of it makes needless; parts are looked up by equality.

    A rule has at most ``2 ** MOST_TOKENS - 2`` proper parts, so no rules are compared
    in pairs.
    """
    parts = F.array(
        F.transform("tokens", lambda t: F.array(t)),
        F.flatten(
            F.transform("tokens", lambda a: F.transform(F.filter("tokens", lambda b: b > a), lambda b: F.array(a, b)))
        ),
    )
    each = rules.select("tokens", "verdict", "confidence", F.explode(F.flatten(parts)).alias("part")).filter(
        F.size("part") < F.size("tokens")
    )
    surer = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("by_part"))
    needless = each.join(surer, ["part", "verdict"]).filter("by_part >= confidence").select("tokens", "verdict").distinct()
    return rules.join(needless, ["tokens", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(_row, verdict, confidence): per URL its surest rule; ties by support, tokens, verdict."""
    counts = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("used"))
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = counts.join(seen, "token")
    rarest = (
        rules.withColumn("token", F.explode("tokens"))
        .join(known, "token")
        .groupBy("tokens", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    )
    # One row per token: what its rules are. A URL then meets each of its tokens once.
    index = rarest.groupBy("token").agg(
        F.collect_list(F.struct("confidence", "support", "tokens", "verdict")).alias("rules")
    )
    best = F.aggregate(
        F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0),
        F.lit(None).cast("struct<confidence:double,support:double,tokens:array<string>,verdict:string>"),
        lambda had, r: F.greatest(had, r),
    )
    return (
        urls.select("_row", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .select("_row", best.alias("best"))
        .filter("best is not null")
        .groupBy("_row")
        .agg(F.max("best").alias("best"))
        .select("_row", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("mined_confidence"))
    )


def judge(
    df: DataFrame,
    rules: list[FixedRule],
    url: str = "url",
    default: str = "allow",
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``mined_confidence``.

    A URL that no fixed rule fits gets the verdict of its surest mined rule, and
    ``default`` if none fits. Null and what has no ``://`` have an empty host and path and
    meet mined rules by their other tokens. Without labelled URLs nothing is mined.
    Columns of these names are replaced; repeated rows are kept and judged alike.
    """
    stage = Stage(df.sparkSession, "urls")
    made = ("host", "path", "rule", "verdict", "mined_confidence", "_row")
    kept = [c for c in df.columns if c not in made]
    rows = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({"_fixed": fixed(rules), "_tokens": tokens(F.col(url))})
    rows = stage.keep(with_row_key(rows, "_row"), "urls")
    labelled = rows.filter("_fixed is not null").select(F.col("_tokens").alias("tokens"), F.col("_fixed.verdict").alias("verdict"))
    if labelled.isEmpty():
        found = df.sparkSession.createDataFrame([], "_row long, mined string, mined_confidence double")
    else:
        mined = stage.keep(mine(labelled, support, confidence), "mined")
        open_ = rows.filter("_fixed is null").select("_row", F.col("_tokens").alias("tokens"))
        found = match(open_, stage.keep(prune(mined), "rules"))
    return (
        rows.join(found, "_row", "left")
        .withColumns(
            {
                "rule": F.col("_fixed.rule"),
                "verdict": F.coalesce("_fixed.verdict", "mined", F.lit(default)),
            }
        )
        .select(*kept, "host", "path", "rule", "verdict", "mined_confidence")
    )
