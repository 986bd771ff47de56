"""Mix sources to target weights by a low-discrepancy schedule.

Slots of equally many words are numbered; slot ``j`` has the golden-ratio point
``j * 2654435769 mod 2**32`` (a permutation of the 32-bit numbers), and the source
whose stretch of the cumulated targets holds the point gets the slot. The k-th slot of
a source takes the k-th block of its documents, laid end to end in hashed order and
begun again after the last. A source's slots stop at its target, the last block cut
short; a source that its points left short of its target gets the missing slots at the
end of the schedule. Built from DataFrame functions only.

Sources may be very uneven: documents are summed per (source, stretch of the hash
range) and slots counted per (source, chunk of slots); running totals go over these
short tables, so no window holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import carry, explode_range, join_summary
from .staging import Stage, with_row_key

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2**32 over the golden ratio, odd
POINTS = 2.0**32
SLOTS = 1 << 20  # slots in a mix, unless blocks reach MOST_WORDS
MOST_WORDS = 4_096
CHUNK_SLOTS = 1 << 14
STRETCH_ROWS = 20_000
BUCKET_SHIFT = 22  # points are dealt to 1024 tasks by their leading bits


@dataclass
class Mix:
    """Rows with ``taken``; the slots of the schedule; and what each slot holds."""

    rows: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def _running(df: DataFrame, block: str, order: Sequence[Column], value: Column, name: str, key: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``value`` over the rows before, in order of (block, order)."""
    on = [*key, block]
    sums = df.groupBy(*on).agg(F.sum(value).alias("_sum"))
    sums = carry(sums, key, block, before={"_before": F.sum("_sum")}).drop("_sum")
    local = F.sum(value).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        join_summary(df.withColumn("_local", local), sums, on)
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_local", F.lit(0)))
        .drop("_local", "_before")
    )


def targets(sources: DataFrame, weights: Sequence[int], most: int, stage: Stage) -> DataFrame:
    """Per source its rank by code point (null last), size, weight and target.

    All sizes together are shared by weight; a target stops at ``most`` times the
    source's size and what is over is shared again, until none is above. One sum comes
    back to the driver per round.
    """
    by = F.col("source").asc_nulls_last()
    # Written with its partition, so that the rank is that of one and the same order.
    dealt = stage.keep(sources.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "sources")
    ranked = _running(dealt, "_part", [by], F.lit(1), "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = stage.keep(ranked.withColumn("weight", weight), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full = most * F.col("source_size")
    share, capped = 0.0, F.lit(False)
    held = -1
    while True:
        r = ranked.agg(
            F.sum(F.when(capped, full).otherwise(0)).alias("full"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if r.n == held or not r.weight:
            break
        held, share = r.n, (total - r.full) / r.weight
        capped = full <= F.col("weight") * share
    return ranked.withColumn("target", F.when(capped, full.cast("double")).otherwise(F.col("weight") * share))


def _points(spark: SparkSession, n: int) -> DataFrame:
    """Slots 0 to n - 1 with their golden-ratio points, in 32 bits at a time."""
    low, high = F.col("slot").bitwiseAND(F.lit(0xFFFF)), F.shiftright(F.col("slot"), 16).bitwiseAND(F.lit(0xFFFF))
    word = F.lit(0xFFFFFFFF)
    upper = F.shiftleft((high * GOLDEN).bitwiseAND(F.lit(0xFFFF)), 16)
    return spark.range(n).withColumnRenamed("id", "slot").withColumn(
        "point", (upper + (low * GOLDEN).bitwiseAND(word)).bitwiseAND(word)
    )


def _schedule(sources: DataFrame, total: int, words: int, stage: Stage) -> DataFrame:
    """(slot, rank, block, words): which block of which source each slot takes."""
    slots = _points(sources.sparkSession, -(-total // words))
    # Targets in 1024ths of a word, so that running sums are exact in any order.
    fine = F.round(F.col("target") * 1024).cast("long")
    laid = _running(sources, "_part", [F.col("rank")], fine, "_low")
    whole = laid.agg(F.sum(fine)).first()[0] or 1
    ends = laid.select(
        "rank",
        F.floor(F.col("_low") / whole * POINTS).cast("long").alias("low"),
        F.floor((F.col("_low") + fine) / whole * POINTS).cast("long").alias("high"),
    ).filter("low < high")
    bucket = lambda c: F.shiftright(c, BUCKET_SHIFT)
    starts = ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high") - 1)))).select(
        "bucket",
        F.greatest("low", F.shiftleft("bucket", BUCKET_SHIFT)).alias("point"),
        F.lit(None).cast("long").alias("slot"),
        "rank",
    )
    marked = slots.select(bucket(F.col("point")).alias("bucket"), "point", "slot", F.lit(None).cast("long").alias("rank")).unionByName(
        starts.withColumn("rank", F.col("rank").cast("long"))
    )
    # Of a start and a slot at the same point the start comes first.
    order = Window.partitionBy("bucket").orderBy("point", F.col("slot").asc_nulls_first())
    given = (
        marked.withColumn("rank", F.last("rank", ignorenulls=True).over(order))
        .filter("slot is not null")
        .select("slot", "rank", F.shiftright("slot", CHUNK_SLOTS.bit_length() - 1).alias("chunk"))
    )
    given = stage.keep(_running(given, "chunk", [F.col("slot")], F.lit(1), "block", key=["rank"]), "slots")
    quota = F.floor("target").cast("long")
    wanted = sources.select("rank", quota.alias("quota"))
    counts = given.groupBy("rank").agg(F.count("*").alias("got"))
    missing = wanted.join(counts, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    need = F.ceil(F.col("quota") / words) - F.col("got")
    more = explode_range(missing, need, "_k").select(
        F.lit(-(-total // words)).cast("long").alias("slot"), "rank", (F.col("got") + F.col("_k")).alias("block"), "quota"
    )
    schedule = given.join(wanted, "rank").select("slot", "rank", "block", "quota").unionByName(more)
    left = F.col("quota") - F.col("block") * words
    return schedule.filter(left > 0).select("slot", "rank", "block", F.least(left, F.lit(words)).cast("long").alias("words"))


def mix(
    df: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> Mix:
    """Mix all rows of ``df``; see the module for the method.

    ``rows`` has every row and column of ``df`` with ``size`` (words of the text, null
    0), ``source_size``, ``target`` (its source's) and ``taken``, the words of it in the mix with
    repeats, at most ``most * size``. Columns of these names are replaced. A null source is a
    source of its own, the last. Repeated rows are documents of their own. Rows that
    differ in neither key nor size are exchangeable, else the result is the same in each run.
    An empty table, or one without words, takes nothing.
    """
    spark = df.sparkSession
    stage = Stage(spark, "mixing")
    made = ("size", "source_size", "target", "taken", "_row")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    whole = df.withColumn("size", size).select("size", *(c for c in df.columns if c not in made))
    whole = stage.keep(with_row_key(whole, "_row"), "rows")
    light = whole.select("_row", F.col(key).alias("_key"), F.col(source).alias("source"), "size")
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = stage.keep(targets(sources, weights, most, stage), "targets")
    r = sources.agg(F.sum("source_size").alias("words"), F.sum("_rows").alias("rows")).first()
    total, n_rows = r.words or 0, r.rows or 0
    words = max(1, min(MOST_WORDS, total // SLOTS))
    schedule = stage.keep(_schedule(sources, total, words, stage), "schedule")

    of = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    placed = light.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    draw = F.xxhash64("_key")
    placed = placed.withColumns({"_draw": draw, "_stretch": F.pmod(draw, F.lit(1 + n_rows // STRETCH_ROWS))})
    order = [F.col("_draw"), F.col("_key"), F.col("size"), F.col("_row")]
    placed = stage.keep(_running(placed, "_stretch", order, F.col("size"), "_begin", key=["rank"]).drop("_draw", "_stretch", "_key"), "placed")
    # A document as often as its source may begin again, cut where blocks end.
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.floor("target") / F.col("source_size")) - 1))
    laid = placed.filter("size > 0 AND target >= 1").withColumn("_again", again)
    laid = laid.withColumn("_from", F.col("_begin") + F.col("_again") * F.col("source_size"))
    laid = laid.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.floor("target").cast("long"))).filter("_from < _to")
    cut = explode_range(laid, F.floor((F.col("_to") - 1) / words) - F.floor(F.col("_from") / words) + 1, "_k")
    cut = cut.withColumn("block", (F.floor(F.col("_from") / words) + F.col("_k")).cast("long"))
    begin = F.greatest(F.col("_from"), F.col("block") * words)
    cut = cut.select(
        "_row",
        "rank",
        "block",
        (begin - F.col("_from")).alias("first_word"),
        (F.least(F.col("_to"), (F.col("block") + 1) * words) - begin).alias("piece"),
    )
    pieces = cut.join(schedule.select("slot", "rank", "block"), ["rank", "block"])
    taken = pieces.groupBy("_row").agg(F.sum("piece").alias("taken"))
    rows = (
        whole.join(placed.select("_row", "source_size", "target"), "_row")
        .join(taken, "_row", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
    )
    return Mix(rows.drop("_row"), sources, schedule, pieces)
