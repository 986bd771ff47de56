"""Ordered computation over recordings of any length.

A recording may be arbitrarily long, so no operator here sorts or collects a
whole recording in one task. Rows carry a ``block``: any integer that never
decreases along the recording and bounds the rows that share it, usually
``floor(ts / block_s)``. Rows are shuffled by ``(recording, block)``; windows run
inside a block; what a block needs to know about the rest of its recording is
carried through a table with one row per block.

Every such summary is built from the same shuffled rows it is joined back to, so
the rows stay where they are and only the summary moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds per block. At a 4.4 ms frame step this is about 136,000 frames.
BLOCK_S = 600.0


def time_block(ts: Column, block_s: float = BLOCK_S) -> Column:
    return F.floor(ts / block_s).cast("long")


def explode_range(df: DataFrame, n: Column, name: str, chunk: int = 4096) -> DataFrame:
    """One row per integer in ``[0, n)``, without ever building an array of ``n``."""
    rows = df.withColumn("_n", n.cast("long")).filter(F.col("_n") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))
    rows = rows.withColumn("_c", F.explode(starts))
    stop = F.least(F.col("_c") + (chunk - 1), F.col("_n") - 1)
    return rows.withColumn(name, F.explode(F.sequence(F.col("_c"), stop))).drop("_n", "_c")


def carry(
    summary: DataFrame,
    key: Sequence[str],
    block: str,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    whole: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add aggregates over the earlier, the later or all blocks of each recording.

    ``summary`` has one row per ``(key, block)``. The aggregates must be
    associative (sum, min, max): that is what makes the split into blocks exact.
    """
    rows = Window.partitionBy(*key).orderBy(F.col(block))
    back = Window.partitionBy(*key).orderBy(F.col(block).desc())
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    # Reversed rather than "to unbounded following", which is quadratic.
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*key)
    cols = {n: c.over(earlier) for n, c in (before or {}).items()}
    cols |= {n: c.over(every) for n, c in (whole or {}).items()}
    out = summary.withColumns(cols) if cols else summary
    tail = {n: c.over(later) for n, c in (after or {}).items()}
    return out.withColumns(tail) if tail else out


def agg_reading(
    df: DataFrame, by: Sequence[str], aggs: Sequence[Column], also: Sequence[str] = ()
) -> DataFrame:
    """``groupBy(by).agg(aggs)`` that reads the columns in ``also`` as well.

    Two branches over the same rows share one shuffle only when both read the same
    columns. The extra aggregate is a hash that is never null, filtered on so that
    column pruning cannot drop it; hashing a column is cheaper than a second scan
    and shuffle of all frames.
    """
    if not also:
        return df.groupBy(*by).agg(*aggs)
    seen = F.bit_xor(F.xxhash64(*also)).alias("_read")
    return df.groupBy(*by).agg(*aggs, seen).filter("_read is not null").drop("_read")


def join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join a per-block table back to rows that are already shuffled by ``on``.

    A shuffled hash join keeps the order of the rows and builds its table from
    one small row per block.
    """
    return rows.join(summary.hint("shuffle_hash"), list(on))


def spread(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Shuffle by ``key`` into the session's number of partitions, all of which stay.

    For rows that multiply after their shuffle: adaptive execution merges partitions by what
    they hold before, and a task's memory would grow with the merged ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key)


def dense_index(
    df: DataFrame,
    key: Sequence[str],
    block: str,
    order: Sequence[Column | str],
    name: str = "frame_idx",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its recording, and optionally its length."""
    on = [*key, block]
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    whole = {total: F.sum("_rows")} if total else None
    offsets = carry(counts, key, block, before={"_before": F.sum("_rows")}, whole=whole).drop("_rows")
    local = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return (
        join_summary(df.withColumn("_rn", local), offsets, on)
        .withColumn(name, F.col("_rn") - 1 + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_rn", "_before")
    )


def running_max(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[Column | str], value: str, name: str
) -> DataFrame:
    """Largest ``value`` among the strictly earlier rows of the recording."""
    on = [*key, block]
    peaks = df.groupBy(*on).agg(F.max(value).alias("_peak"))
    carried = carry(peaks, key, block, before={"_carried": F.max("_peak")}).drop("_peak")
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.max(value).over(w)
    return (
        join_summary(df.withColumn("_local", local), carried, on)
        .withColumn(name, F.greatest("_local", "_carried"))
        .drop("_local", "_carried")
    )


def spread_blocks(
    df: DataFrame, key: Sequence[str], position: Column, rows_per_block: int, name: str = "block"
) -> DataFrame:
    """Block rows by a timestamp-like ``position`` when no regular time step exists.

    The width is the same for all recordings and follows the longest one, so a
    recording of ordinary length stays in one block and a huge one is split. One
    pass over the key and position columns finds it; a single row comes back, as
    a scalar subquery.
    """
    spans = (
        df.select(*key, position.cast("double").alias("_p"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    )
    stats = spans.agg(
        F.struct(
            F.min("_lo").alias("lo"),
            F.greatest(
                (F.max("_hi") - F.min("_lo")) / F.ceil(F.max("_n") / F.lit(float(rows_per_block))),
                F.lit(1e-6),
            ).alias("width"),
        ).alias("s")
    ).scalar()
    return df.withColumn(
        name, F.floor((position.cast("double") - stats["lo"]) / stats["width"]).cast("long")
    )
