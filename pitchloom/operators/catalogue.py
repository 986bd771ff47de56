"""Class lists, catalogues, knowledge bases and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

# Tags of a similar link that resolves, and of one that does not.
SIZE_TAG, PLAIN_TAG = " swaras", "Related raga"
# Scales of up to this many tokens are listed under all subsets of them.
SUBSET_TOKENS = 7


class IncompleteError(RuntimeError):
    """Items without a required counterpart; ``exit_code`` as a batch job reports it."""

    exit_code = 2


def known_items(items: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    return items.join(classes.select(on).distinct(), on, "left_semi")


def unknown_items(items: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """Items per class name that the class list does not have."""
    return (
        items.groupBy(on)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(classes.select(on).distinct(), on, "left_anti")
    )


def labelled(items: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """Join the class list (one row per class) to items; a class may hold most of them.

    A plain join reads the items once: Spark broadcasts a list that is small by its
    measured size, and splits the partition of a hot class otherwise.
    """
    return items.join(classes, on)


def missing_counterparts(items: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    # Distinct first: a key repeated in ``other`` shrinks before the shuffle.
    return items.join(other.select(*on).distinct(), list(on), "left_anti")


def require_complete(items: DataFrame, other: DataFrame, on: Sequence[str], show: int = 5) -> None:
    """Raise when any item has no counterpart, naming the first few."""
    seen = Observation()
    missing = missing_counterparts(items, other, on).select(*on)
    # Counted on the way to the first few, in one pass.
    first = missing.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*on).limit(show).collect()
    if first:
        names = ["/".join(str(v) for v in r) for r in first]
        raise IncompleteError(f"{seen.get['n']} items without counterpart. First {len(names)}: {names}")


def with_knowledge(predictions: DataFrame, knowledge: DataFrame, on: str) -> DataFrame:
    """Left outer: a class without an entry, or a null class, keeps its predictions."""
    return predictions.join(knowledge, on, "left")


def similar_links(knowledge: DataFrame) -> DataFrame:
    """One row per listed link: ``class_name, similar_name, position, tag``.

    A link to a known class tells its scale length, any other is just related.
    """
    links = knowledge.select("class_name", F.posexplode("similar").alias("position", "similar_name"))
    sizes = knowledge.select(
        F.col("class_name").alias("similar_name"), F.size("ascending").alias("_n")
    )
    tag = F.coalesce(F.concat(F.col("_n"), F.lit(SIZE_TAG)), F.lit(PLAIN_TAG))
    return links.join(sizes, "similar_name", "left").withColumn("tag", tag).drop("_n")


def link_overlap(knowledge: DataFrame) -> DataFrame:
    """Shared-token similarity along the listed links that resolve."""
    links = knowledge.select(
        "class_name", "ascending", F.explode("similar").alias("similar_name")
    )
    other = knowledge.select(
        F.col("class_name").alias("similar_name"), F.col("ascending").alias("_other")
    )
    shared = F.size(F.array_intersect("ascending", "_other"))
    return links.join(other, "similar_name").select(
        "class_name",
        "similar_name",
        shared.alias("shared"),
        (shared / F.size(F.array_union("ascending", "_other"))).alias("jaccard"),
    )


def _shared_subsets(scales: DataFrame, k: int) -> DataFrame:
    """``_scale, _n, _other, _m, shared`` of scales of few tokens: for each, the ``k`` most alike and more.

    A scale that is not among the first of a subset may be met at a smaller one only, with
    too low a count, but then ``k`` others come before it.
    """
    mask_end = F.shiftleft(F.lit(1), SUBSET_TOKENS) - 1
    masks = F.filter(F.sequence(F.lit(1), mask_end), lambda m: m < F.pow(F.lit(2), F.col("_n")))

    def subset(mask):
        part = F.filter("_tokens", lambda _, i: F.getbit(mask, i) == 1)
        return F.struct(F.xxhash64(part).alias("_subset"), F.size(part).alias("shared"))

    few = scales.filter(F.col("_n") <= SUBSET_TOKENS)
    listed = few.select("_scale", "_n", "class_name", F.inline(F.transform(masks, subset)))
    by_name = Window.partitionBy("_subset", "_n").orderBy("class_name")
    tops = listed.withColumn("_r", F.row_number().over(by_name)).filter(F.col("_r") <= k + 1)
    tops = tops.select("_subset", F.col("_scale").alias("_other"), F.col("_n").alias("_m"))
    met = listed.drop("class_name").join(tops, "_subset").filter("_scale <> _other")
    return met.groupBy("_scale", "_n", "_other", "_m").agg(F.max("shared").alias("shared"))


def _shared_tokens(scales: DataFrame) -> DataFrame:
    """:func:`_shared_subsets` of all pairs in which a scale has many tokens."""
    index = scales.select("_scale", "_n", F.explode("_tokens").alias("_token"))
    many = index.filter(F.col("_n") > SUBSET_TOKENS)
    other = index.select(F.col("_scale").alias("_other"), F.col("_n").alias("_m"), "_token")
    shared = (
        many.join(other, "_token")
        .filter((F.col("_scale") < F.col("_other")) | (F.col("_m") <= SUBSET_TOKENS))
        .groupBy("_scale", "_n", "_other", "_m")
        .agg(F.count(F.lit(1)).cast("int").alias("shared"))
    )
    turned = shared.select(
        F.col("_other").alias("_scale"), F.col("_m").alias("_n"), F.col("_scale").alias("_other"), F.col("_n").alias("_m"), "shared"
    )
    return shared.unionByName(turned)


def similar_scales(knowledge: DataFrame, k: int = 3) -> DataFrame:
    """``class_name, rank, similar_name, shared, jaccard``: the ``k`` scales most alike per class.

    All classes count. Two scales meet at the set of tokens they share: each scale is listed
    under every subset of its tokens, and of a subset and a number of tokens the first
    ``k + 1`` scales by name stay, since those come before the others for whoever looks there.
    So work grows with the classes, not with their pairs. Scales of more than ``SUBSET_TOKENS``
    tokens have too many subsets; they meet all others at single tokens. Classes with the same
    tokens are one scale there, of which the first ``k + 1`` names go on. Ties go by name.
    Classes without tokens, and those that share none with another, have no row; null names
    and tokens are left out.
    """
    tokens = F.array_sort(F.array_distinct(F.filter("ascending", lambda t: t.isNotNull())))
    own = knowledge.select("class_name", tokens.alias("_tokens")).filter("class_name IS NOT NULL AND size(_tokens) > 0")
    own = own.withColumn("_scale", F.xxhash64("_tokens")).distinct()
    by_name = Window.partitionBy("_scale").orderBy("class_name")
    names = own.withColumn("_place", F.row_number().over(by_name)).filter(F.col("_place") <= k + 1)
    first = names.filter("_place = 1")
    sized = first.withColumn("_n", F.size("_tokens"))
    both = _shared_subsets(sized, k).unionByName(_shared_tokens(sized)).select(
        "_scale", "_other", "shared", (F.col("shared") / (F.col("_n") + F.col("_m") - F.col("shared"))).alias("jaccard")
    )
    # Of scales that are equally alike those with the first names hold the first classes.
    leads = first.select(F.col("_scale").alias("_other"), F.col("class_name").alias("_lead"))
    best = Window.partitionBy("_scale").orderBy(F.desc("jaccard"), "_lead")
    near = both.join(leads, "_other").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r", "_lead")
    same = first.select("_scale", F.col("_scale").alias("_other"), F.size("_tokens").alias("shared"), F.lit(1.0).alias("jaccard"))
    offered = near.select("_scale", "_other", "shared", "jaccard").union(same).join(
        names.select(F.col("_scale").alias("_other"), F.col("class_name").alias("similar_name")), "_other"
    )
    rank = Window.partitionBy("class_name", "_scale").orderBy(F.desc("jaccard"), "similar_name")
    return (
        own.join(offered, "_scale")
        .filter("class_name <> similar_name")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k)
        .select("class_name", "rank", "similar_name", "shared", "jaccard")
    )


def duplicate_ids(catalogue: DataFrame, id_: str = "id", class_name: str = "class_name") -> DataFrame:
    """Repeated ids, and whether they stand under different classes."""
    return (
        catalogue.groupBy(id_)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(class_name).alias("n_classes"))
        .filter("n_rows > 1")
        .withColumn("conflict", F.col("n_classes") > 1)
    )


def shared_basenames(paths: DataFrame, basename: str, key: str) -> DataFrame:
    """Basenames that stand for several recordings."""
    return (
        paths.groupBy(basename).agg(F.count_distinct(key).alias("n_recordings")).filter("n_recordings > 1")
    )


def success_rates(outcomes: DataFrame, class_name: str, ok: str) -> DataFrame:
    return outcomes.groupBy(class_name).agg(
        F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n_total")
    )


def feedback_rollup(feedback: DataFrame, actual: str = "actual_class", threshold: int = 50) -> DataFrame:
    """Corrections per actual class, and whether there are enough to retrain."""
    return (
        feedback.groupBy(actual)
        .agg(F.count(F.lit(1)).alias("n_feedback"), F.count_if(~F.col("was_correct")).alias("n_corrections"))
        .withColumn("retrain_ready", F.col("n_corrections") >= threshold)
    )


def confusion(
    feedback: DataFrame, predicted: str = "predicted_class", actual: str = "actual_class"
) -> DataFrame:
    return feedback.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))
