"""Picks, running best, labels, samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import dense_index, running_max


def top_classes(scores: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most probable classes per key from long-form ``key, label, prob``.

    A key has one row per class, so its window is bounded by the class list. On
    ties the higher label comes first.
    """
    w = Window.partitionBy(*key).orderBy(F.desc("prob"), F.desc("label"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def representatives(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[str]
) -> DataFrame:
    """First, middle (element ``n // 2``) and last row of each group, as ``pick``.

    ``order`` is unique within a group; a group of one row gives that row three
    times. Positions are found on the key and order columns alone; the few picked
    rows are then looked up, so wide rows are not sorted.
    """
    i, n = F.col("_i"), F.col("_n")
    picks = F.array_compact(
        F.array(
            F.when(i == 0, "first"),
            F.when(i == F.floor(n / 2), "middle"),
            F.when(i == n - 1, "last"),
        )
    )
    on = [*key, *order]
    narrow = df.select(*dict.fromkeys([*on, block]))
    found = (
        dense_index(narrow, key, block, order, name="_i", total="_n")
        .filter((i == 0) | (i == F.floor(n / 2)) | (i == n - 1))
        .select(*on, F.explode(picks).alias("pick"))
    )
    return df.join(found, on)


def running_best(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], value: str, start: float = 0.0
) -> DataFrame:
    """Flag rows that beat every earlier one strictly: ``best_before``, ``is_best``."""
    out = running_max(df, key, block, order, value, "best_before")
    return out.withColumn("best_before", F.greatest("best_before", F.lit(start))).withColumn(
        "is_best", F.col(value) > F.col("best_before")
    )


def first_match(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``, by a combinable aggregate."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_m")).select(*key, "_m.*")


def digest(seed: int, *cols: Column) -> Column:
    """A hash of seed and key that any engine reproduces, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_percent(seed: int, *cols: Column) -> Column:
    """A repeatable pseudo-random integer from 0 to 99."""
    return (F.conv(F.substring(digest(seed, *cols), 1, 8), 16, 10).cast("long") % 100).cast("int")


def train_test_split(
    df: DataFrame, by: Sequence[str], seed: int = 42, train_percent: int = 80, name: str = "is_train"
) -> DataFrame:
    """Mark the training side by a hash of ``by``.

    The whole row key gives the plain random split; the recording id keeps all
    clips of a recording on one side. A row's side never changes on a re-run,
    which ``randomSplit`` does not promise.
    """
    return df.withColumn(name, hash_percent(seed, *[F.col(c) for c in by]) < train_percent)


def two_stage_sample(
    df: DataFrame, group: str, item: str, groups: int = 5, seed: int = 42
) -> DataFrame:
    """One item from each of ``groups`` groups, drawn by hash.

    The draw per group is a minimum, so a huge group is combined, not collected.
    """
    drawn = df.groupBy(group).agg(
        F.min_by(item, F.struct(digest(seed, F.col(group), F.col(item)), F.col(item))).alias(item)
    )
    return drawn.orderBy(digest(seed, F.col(group)), group).limit(groups)


def dense_labels(classes: DataFrame, class_id: str) -> DataFrame:
    """``class_id, label``: position in sorted order.

    For class lists only: the distinct ids, some tens of rows, meet in one task.
    """
    ids = classes.select(class_id).distinct()
    label = F.row_number().over(Window.orderBy(class_id)) - 1
    return ids.withColumn("label", label.cast("int"))
