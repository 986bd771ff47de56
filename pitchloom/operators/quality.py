"""Checks over feature sets: class balance, broken values, channel statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def filled_class_counts(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class of the class list, 0 for classes without rows."""
    counts = class_counts(df, label)
    return classes.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def imbalance(counts: DataFrame) -> DataFrame:
    """Summary of the counts of present classes; the median is truncated.

    Works on one row per class.
    """
    return counts.filter("n > 0").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
        (F.max("n") / F.min("n")).alias("ratio"),
        F.floor(F.median("n")).cast("long").alias("median_n"),
        F.avg("n").alias("mean_n"),
    )


def constancy(df: DataFrame, key: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Is ``value`` the same, after rounding, over all rows of a key?"""
    distinct = F.count_distinct(F.round(value, digits))
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_values"), (distinct == 1).alias("consistent")
    )


def broken_values(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: vectors with any NaN, and with any infinity."""
    x = F.col(features)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(vectors.has_nan(x)).alias("nan_rows"),
        F.count_if(vectors.has_inf(x)).alias("inf_rows"),
    )


def long_channels(
    df: DataFrame, keep: Sequence[str], width: int = vectors.BINS, names: Sequence[str] = vectors.CHANNELS,
    features: str = "features",
) -> DataFrame:
    """``keep, channel, values``: one row per vector and channel."""
    return df.select(*keep, F.inline(vectors.channels(F.col(features), width, names)))


def zero_channels(channels: DataFrame) -> DataFrame:
    """Per channel: rows whose sum is 0, and rows that are 0 throughout."""
    v = F.col("values")
    return channels.groupBy("channel").agg(
        F.count_if(vectors.sums_to_zero(v)).alias("zero_sum_rows"),
        F.count_if(vectors.all_zero(v)).alias("all_zero_rows"),
    )


def channel_statistics(channels: DataFrame) -> DataFrame:
    """Mean and population deviation per channel over all rows and bins, and overall.

    The overall row is combined from the channel moments, not from a second scan.
    """
    per = (
        channels.select("channel", F.explode("values").alias("v"))
        .groupBy("channel")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    )
    n, m, s = F.col("n"), F.col("mean"), F.col("std")
    whole = per.agg(
        F.sum("n").alias("n"),
        (F.sum(n * m) / F.sum("n")).alias("mean"),
        (F.sum(n * (s * s + m * m)) / F.sum("n")).alias("_square"),
    ).select(
        F.lit("overall").alias("channel"),
        "n",
        "mean",
        F.sqrt(F.greatest(F.col("_square") - m * m, F.lit(0.0))).alias("std"),
    )
    return per.unionByName(whole)


def channel_summary(
    df: DataFrame, width: int = vectors.BINS, names: Sequence[str] = vectors.CHANNELS,
    features: str = "features",
) -> DataFrame:
    """Broken rows, zero rows, mean and deviation per channel in one pass.

    The same numbers as :func:`broken_values`, :func:`zero_channels` and
    :func:`channel_statistics`, from sums per row instead of one row per bin.
    ``nan_rows`` and ``inf_rows`` are on the ``overall`` line, which is combined
    from the channel lines.
    """
    x, v = F.col(features), F.col("values")
    flags = df.select(
        vectors.has_nan(x).alias("_nan"),
        vectors.has_inf(x).alias("_inf"),
        F.inline(vectors.channels(x, width, names)),
    )
    # Every row has each channel once, so one of them counts the rows.
    first = F.col("channel") == names[0]
    per = flags.groupBy("channel").agg(
        F.count_if(first & F.col("_nan")).alias("nan_rows"),
        F.count_if(first & F.col("_inf")).alias("inf_rows"),
        F.count_if(vectors.sums_to_zero(v)).alias("zero_sum_rows"),
        F.sum(F.size(v)).alias("_n"),
        F.sum(vectors.total(v)).alias("_s"),
        F.sum(vectors.dot(v, v)).alias("_ss"),
    )
    sums = ["nan_rows", "inf_rows", "zero_sum_rows", "_n", "_s", "_ss"]
    overall = per.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit("overall").alias("channel"), *sums)
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    spread = F.col("_ss") / F.nullif(F.col("_n"), F.lit(0)) - mean * mean
    return per.unionByName(overall).select(
        "channel",
        "nan_rows",
        "inf_rows",
        "zero_sum_rows",
        mean.alias("mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"),
    )


def mean_vector(
    df: DataFrame,
    key: Sequence[str],
    features: str = "features",
    name: str = "mean_vector",
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Element-wise mean per key; averages per position combine before the shuffle.

    ``keep`` names further aggregates over the vectors of a key that must not
    depend on how often a row is seen (``max``, ``min``, ``bool_or``).
    """
    extra = {f"_x{i}": (n, c) for i, (n, c) in enumerate((keep or {}).items())}
    per_pos = (
        df.select("*", F.posexplode(features).alias("_p", "_v"))
        .groupBy(*key, "_p")
        .agg(
            F.avg("_v").alias("_v"),
            F.count("_v").alias("_n"),
            *[c.alias(x) for x, (_, c) in extra.items()],
        )
    )
    return (
        per_pos.groupBy(*key)
        .agg(
            F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_e"),
            F.max("_n").alias("n_vectors"),
            *[F.max(x).alias(n) for x, (n, _) in extra.items()],
        )
        .withColumn(name, F.transform("_e", lambda e: e["_v"]))
        .drop("_e")
    )


def channel_report(channels: DataFrame) -> DataFrame:
    """Per vector and channel: broken values, first peak, non-zero bins, pass or fail."""
    v = F.col("values")
    return (
        channels.withColumns(
            {
                "any_nan": vectors.has_nan(v),
                "any_inf": vectors.has_inf(v),
                "all_zero": vectors.all_zero(v),
                "peak_bin": vectors.argmax(v),
                "peak_value": F.array_max(v),
                "nonzero_bins": vectors.nonzero_count(v),
            }
        )
        .withColumn("peak_cents", F.col("peak_bin") * 10)
        .withColumn(
            "passed",
            ~(F.col("any_nan") | F.col("any_inf") | F.col("all_zero")) & (F.col("peak_value") > 0),
        )
        .drop("values")
    )


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
    """Counts of keys found on both sides, on one side, or with different labels.

    Both sides have one row per key.
    """
    a = left.select(*on, F.col(label).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*on, F.col(label).alias("_b"), F.lit(True).alias("_in_b"))
    status: Column = (
        F.when(F.col("_in_b").isNull(), "left_only")
        .when(F.col("_in_a").isNull(), "right_only")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "matched")
        .otherwise("label_mismatch")
    )
    return a.join(b, list(on), "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
