"""Exact order statistics for groups too large to sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 2
CUTS = 65_536


def middle_values(
    df: DataFrame, key: Sequence[str], value: str, width: float = 0.25
) -> DataFrame:
    """The two middle values per key: ``lower`` and ``upper`` (equal for odd counts).

    Counts per distinct value come first (partial counts before the shuffle, which
    is by key and value). Cells of ``width`` tell where the middle lies; that cell is cut
    into 65,536 and searched in the same way. So what is put in order at a time is
    the cells of one level, and at last the few distinct values of one finest cell.
    """
    counts = (
        df.select(*key, F.col(value).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*key, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.col("n")
    ranks = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    # One row per key and middle rank, with the rows known to stand before its cell.
    found = counts.groupBy(*key).agg(F.sum("_n").alias("n")).select(
        *key, "n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_skip")
    )
    outer: list[str] = []
    for level in range(LEVELS):
        cell = f"_cell{level}"
        found = _advance(counts, found, key, outer, cell, _cell(width, level), width).select(
            *key, "n", "_rank", "_skip", cell
        )
        outer = [cell]
    ranked = _advance(counts, found, key, outer, "_at", F.col("_v"), width)
    return ranked.groupBy(*key).agg(F.max("n").alias("n"), F.min("_at").alias("lower"), F.max("_at").alias("upper"))


def _cell(width: float, level: int) -> Column:
    return F.floor(F.col("_v") / (width / CUTS**level))


def _advance(
    counts: DataFrame, found: DataFrame, key: Sequence[str], outer: Sequence[str], name: str, part: Column, width: float
) -> DataFrame:
    """The part of each rank's cell that holds the rank, and the rows before that part."""
    rows = counts
    for cell in outer:
        rows = rows.withColumn(cell, _cell(width, int(cell.removeprefix("_cell"))))
    on = [*key, *outer]
    sums = rows.join(found, on).groupBy(*on, "_rank", "n", "_skip", part.alias(name)).agg(F.sum("_n").alias("_n"))
    run = Window.partitionBy(*on, "_rank").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_skip") + F.sum("_n").over(run)
    return (
        sums.withColumn("_to", upto)
        .filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
        .withColumn("_skip", F.col("_to") - F.col("_n"))
    )


def exact_median(df: DataFrame, key: Sequence[str], value: str, width: float = 0.25) -> DataFrame:
    """Median with the mean of the two middle values, as ``median``."""
    m = middle_values(df, key, value, width)
    return m.select(*key, ((F.col("lower") + F.col("upper")) / 2).alias("median"))


def error_summary(errors: DataFrame, value: str, good: float = 25.0, ok: float = 50.0) -> DataFrame:
    """One row: count, mean, upper median, maximum and band counts of absolute errors."""
    e = F.col(value)
    one = errors.select(F.lit(1).alias("_k"), e)
    middle = middle_values(one, ["_k"], value, width=1.0).select("_k", "upper")
    sums = one.groupBy("_k").agg(
        F.count(e).alias("n"),
        F.avg(e).alias("mean_abs"),
        F.max(e).alias("max_abs"),
        F.count_if(e <= good).alias("n_good"),
        F.count_if(e <= ok).alias("n_ok"),
        F.count_if(e > ok).alias("n_broken"),
    )
    return sums.join(middle, "_k").select(
        "n", "mean_abs", F.col("upper").alias("median_abs"), "max_abs", "n_good", "n_ok", "n_broken"
    )
