"""Blocks of bounded size for rows in any order and spread, however uneven.

Blocks by time hold as many rows as fall into their stretch: a burst fills one. Here a
recording is cut by rank. Counts per cell give every cell its first rank; cells that
hold too many rows are cut again, by the range of values that they really have, and by
the next ordering column where all rows of a cell are equal in this one. Ranks of cells
then make blocks, so a block never holds more rows than asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder, stored

#: Pieces that a cell is cut into. Its table has one number for each.
PIECES = 256
FRACTIONS = (T.FloatType, T.DoubleType)
FINITE = sys.float_info.max


def equi_depth(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], rows_per_block: int, name: str = "block", rank: str | None = None
) -> DataFrame:
    """Add ``name``: a block number that never falls along ``order`` within ``key``.

    A block holds at most ``rows_per_block`` rows, except that rows equal in all of
    ``order`` stay together. ``rank`` names a further column: how many rows of the key lie
    before the row's cell, see :func:`position`. ``order`` are numbers, nulls come first.
    Rows with a null in ``key`` are left out.

    One pass over the key and order columns counts keys; where none is larger than a
    block, that is all. Otherwise each further pass reads the rows of over-full cells only
    and divides them by up to ``PIECES``. Cells meet the rows by equi joins on tables with
    one row per over-full cell.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "depth")

    half = max(1, rows_per_block // 2)
    given = df.dropna(subset=list(key))
    ranked = [r for f, c in zip(given.select(*order).schema, order) for r in _ranked(c, f.dataType)]
    columns = [f"_o{k}" for k in range(len(ranked))]
    whole = given.withColumns(dict(zip(columns, ranked)))
    rows = whole.withColumn("_at", F.lit(0).cast("long"))
    narrow = rows.select(*key, "_at", *columns)
    on = [*key, "_at"]
    ends = [f(c).alias(f"{n}{c}") for c in columns for n, f in (("_lo", F.min), ("_hi", F.max))]
    cells = stored(narrow.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *ends).filter(F.col("_n") > half), folder, "cells")
    # Columns by which a cell can be cut, the first one counts.
    which = F.coalesce(*[F.when(F.col(f"_lo{c}") < F.col(f"_hi{c}"), F.lit(k)) for k, c in enumerate(columns)])
    level = 0
    while True:
        full = cells.withColumn("_which", which).filter("_which is not null")
        full = full.select(*on, "_which", *[F.col(f"{n}{c}") for c in columns for n in ("_lo", "_hi")])
        if full.isEmpty():
            break
        if level == 0:
            # Each pass reads what the one before left, instead of making it anew.
            narrow = stored(narrow, folder, "rows")
        parts = _cut(narrow.join(full, on), columns).groupBy(*on, "_piece").agg(F.count(F.lit(1)).alias("_n"), *ends)
        before = F.sum("_n").over(Window.partitionBy(*on).orderBy("_piece")) - F.col("_n")
        parts = stored(parts.withColumn("_start", F.col("_at") + before), folder, f"parts-{level}")
        starts = parts.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_piece", "_start"))).alias("_starts"))
        # As an array, so that a row looks its piece up at once.
        starts = starts.withColumn(
            "_starts", F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda p: F.try_element_at("_starts", p))
        )
        table = stored(full.join(starts, on), folder, f"starts-{level}")
        narrow = stored(_moved(narrow, table, on, columns, "inner"), folder, f"rows-{level}")
        rows = _moved(rows, table, on, columns, "left")
        cells = parts.filter(F.col("_n") > half).drop("_at", "_piece").withColumnRenamed("_start", "_at")
        level += 1
    out = rows.withColumn(name, F.floor(F.col("_at") / half).cast("long"))
    return (out.withColumnRenamed("_at", rank) if rank else out.drop("_at")).drop(*columns)


def _ranked(c: Column, kind: T.DataType) -> list[Column]:
    """Columns without NaN or infinities that sort as ``c`` does: its kind of value, then the value."""
    if not isinstance(kind, FRACTIONS):
        return [c.isNotNull().cast("int"), c]
    c = c.cast("double")
    place = F.when(c.isNull(), 0).when(F.isnan(c), 4).when(c > FINITE, 3).when(c < -FINITE, 1).otherwise(2)
    return [place, F.when(place == 2, c)]


def _cut(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_piece``: the part of its cell's range that a row lies in."""

    def share(c: str) -> Column:
        x, low, high = F.col(c), F.col(f"_lo{c}"), F.col(f"_hi{c}")
        if isinstance(rows.schema[c].dataType, FRACTIONS):
            # A range may be wider than the type; then halves are taken.
            return F.when(high - low <= FINITE, (x - low) / (high - low)).otherwise((x / 2 - low / 2) / (high / 2 - low / 2))
        x, low, high = (v.cast("decimal(20,0)") for v in (x, low, high))
        return (x - low).cast("double") / ((high - low).cast("double") + 1)

    found = F.coalesce(*[F.when(F.col("_which") == k, share(c)) for k, c in enumerate(columns)], F.lit(0.0))
    piece = F.floor(F.least(found * PIECES, F.lit(PIECES - 1.0))).cast("int")
    return rows.withColumn("_piece", F.greatest(piece, F.lit(0)))


def _moved(rows: DataFrame, table: DataFrame, on: Sequence[str], columns: Sequence[str], how: str) -> DataFrame:
    """Rows of cut cells go to their piece; with ``how`` ``inner`` all others are left out."""
    kept = rows.columns
    out = _cut(rows.join(table, list(on), how), columns)
    return out.withColumn("_at", F.coalesce(F.get("_starts", F.col("_piece")), "_at")).select(*kept)


def position(df: DataFrame, key: Sequence[str], block: str, rank: str, order: Sequence[Column | str], name: str = "frame_idx") -> DataFrame:
    """Zero-based position of each row in its key, from the ranks of :func:`equi_depth`.

    The first cell of a block starts where the block does, so no table of counts is needed.
    """
    own = Window.partitionBy(*key, block).orderBy(*order)
    # In the one order, so that a block is sorted once.
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.min(rank).over(every) + F.row_number().over(own) - 1).drop(rank)
