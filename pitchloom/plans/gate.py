"""The quality gate between feature extraction and training."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import quality, ranking
from ..session import exists, scratch_folder


class GateFailed(RuntimeError):
    """The earlier features could not be aligned, so the comparison did not run."""

    exit_code = 1


def match_earlier(rows: DataFrame, earlier: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join one earlier vector per recording to its clips, however many those are."""
    return rows.join(earlier, list(key))


def compare_channels(
    earlier: DataFrame,
    picks: DataFrame,
    key: Sequence[str],
    width: int = vectors.BINS,
    names: Sequence[str] = vectors.CHANNELS,
    k: int = 5,
) -> DataFrame:
    """Compare an earlier vector with the picked clips of its recording.

    ``key, channel, pick, peaks, cosine`` per channel and pick, one line per channel for
    the ``earlier`` vector itself (without a cosine), and one ``full`` line with the
    cosine against the mean of the picks. At most three picks meet per recording, in
    one row, so vectors are read once on either side.
    """
    met = picks.groupBy(*key).agg(F.collect_list(F.struct("pick", "features")).alias("_picks")).join(earlier, list(key))
    old = F.col("old_features")
    own = F.concat(F.col("_picks"), F.array(F.struct(F.lit("earlier").alias("pick"), old.alias("features"))))
    parts = F.flatten(
        F.transform(
            own,
            lambda p: F.zip_with(
                vectors.channels(p["features"], width, names),
                vectors.channels(old, width, names),
                lambda new, was: F.struct(
                    new["channel"].alias("channel"), p["pick"].alias("pick"), new["values"].alias("values"), was["values"].alias("old")
                ),
            ),
        )
    )
    mean = F.transform(
        old, lambda _, i: F.aggregate("_picks", F.lit(0.0), lambda s, p: s + F.get(p["features"], i)) / F.size("_picks")
    )
    whole = F.struct(F.lit("full").alias("channel"), F.lit("mean").alias("pick"), mean.alias("values"), old.alias("old"))
    rows = met.select(*key, F.inline(F.concat(parts, F.array(whole))))
    return rows.select(
        *key,
        "channel",
        "pick",
        vectors.top_k(F.col("values"), k).alias("peaks"),
        F.when(F.col("pick") != "earlier", vectors.cosine(F.col("old"), F.col("values"))).alias("cosine"),
    )


def _sums(rows: DataFrame, by: Sequence[str], features: str, width: int, names: Sequence[str]) -> DataFrame:
    """Per ``by`` and channel all sums that the report needs, in one combinable aggregate."""
    x, v = F.col(features), F.col("values")
    flagged = rows.select(
        *by, vectors.has_nan(x).alias("_nan"), vectors.has_inf(x).alias("_inf"), F.inline(vectors.channels(x, width, names))
    )
    return flagged.groupBy(*by, "channel").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_nan").alias("nan_rows"),
        F.count_if("_inf").alias("inf_rows"),
        F.count_if(vectors.sums_to_zero(v)).alias("zero_rows"),
        F.sum(F.size(v)).alias("n"),
        F.sum(vectors.total(v)).alias("s"),
        F.sum(vectors.dot(v, v)).alias("ss"),
    )


def _moments(sums: DataFrame, section: str) -> DataFrame:
    """Mean and population deviation per channel and overall."""
    per = sums.groupBy("channel").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    whole = per.agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).select(F.lit("overall").alias("channel"), "n", "s", "ss")
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    spread = F.col("ss") / F.nullif(F.col("n"), F.lit(0)) - mean * mean
    return _lines(
        per.union(whole), section, {"mean": mean, "std": F.sqrt(F.greatest(spread, F.lit(0.0)))}, F.col("channel")
    )


def _lines(df: DataFrame, section: str, metrics: dict[str, Column], key: Column | None = None) -> DataFrame:
    entries = [
        F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()
    ]
    key = F.lit("") if key is None else key.cast("string")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(F.array(*entries))).select(
        "section", "metric", "key", "value"
    )


def gate_report(
    rows: DataFrame,
    earlier: DataFrame,
    classes: DataFrame,
    key: Sequence[str],
    block: str,
    order: Sequence[str],
    width: int = vectors.BINS,
    names: Sequence[str] = vectors.CHANNELS,
    strict: bool = False,
    store: str | None = None,
) -> DataFrame:
    """``section, metric, key, value`` lines of the whole gate.

    Sections: ``summary`` (counts and balance), ``tonic`` (tonic and clips per
    recording), ``sanity`` (broken values, channel statistics), ``earlier`` (statistics of
    the earlier features), ``alignment`` (keys and labels on both sides) and ``cross``
    (comparison with the earlier features). With ``strict`` the job stops where keys or
    labels do not align, see :func:`require_aligned`; the comparison is then not made.

    The vectors are read once for all sums, which are written per recording, label and
    channel, and once for the picks; all other lines come from those small tables.
    ``earlier`` has one row per key, with ``label`` (which may be a key) and ``old_features``.

    With ``store``, sums and picks of each run stay there, and a later run reads only the
    rows of keys that no run has seen; the report covers all of them. A key's rows have to
    come in one run. A run that failed leaves nothing that counts.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark, "gate")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    by = list(dict.fromkeys([*key, "label", "_tonic"]))
    rows = rows.withColumn("_tonic", F.round("expert_tonic_hz", 6))
    if store:
        sums, picks = _stored_parts(rows, key, by, block, order, width, names, store)
    else:
        sums = keep(_sums(rows, by, "features", width, names), "sums")
        picks = ranking.representatives(rows, key, block, order)
    # Every vector has each channel once, so one of them counts the rows.
    once = sums.filter(F.col("channel") == names[0])
    counts = once.groupBy("label").agg(F.sum("rows").alias("n"))
    recording = F.concat_ws("/", *key)
    tonics = once.groupBy(*key).agg(
        F.count_distinct("_tonic").alias("values"), F.max("_tonic").alias("tonic"), F.sum("rows").alias("clips")
    )
    ours = once.groupBy(*key).agg(F.max("label").alias("_label")).withColumnRenamed("_label", "label_of")
    theirs = earlier.select(*key, F.col("label").alias("label_of"))
    aligned = keep(quality.reconcile(ours, theirs, key, "label_of"), "aligned")
    if strict:
        require_aligned(aligned)
    cross = compare_channels(earlier.select(*key, "old_features"), picks, key, width, names)
    peaks = F.flatten(
        F.transform(
            "peaks",
            lambda p, i: F.array(
                F.struct(F.concat(F.lit("peak_bin_"), i + 1).alias("metric"), p["bin"].cast("double").alias("value")),
                F.struct(F.concat(F.lit("peak_value_"), i + 1).alias("metric"), p["value"].alias("value")),
            ),
        )
    )
    cosine = F.when(F.col("pick") != "earlier", F.array(F.struct(F.lit("cosine").alias("metric"), F.col("cosine").alias("value"))))
    compared = cross.select(
        F.lit("cross").alias("section"),
        F.concat_ws("/", *key, "channel", "pick").alias("key"),
        F.inline(F.concat(F.coalesce(cosine, F.array_repeat(F.struct(F.lit("").alias("metric"), F.lit(0.0).alias("value")), 0)), peaks)),
    ).select("section", "metric", "key", "value")
    sections = [
        _lines(once.agg(F.sum("rows").alias("n"), F.count_distinct("label").alias("k")), "summary",
               {"rows": F.col("n"), "labels_present": F.col("k")}),
        _lines(classes.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0))), "summary",
               {"class_rows": F.col("n")}, F.col("label")),
        _lines(quality.imbalance(counts), "summary",
               {"max_over_min": F.col("ratio"), "max_rows": F.col("max_n"), "min_rows": F.col("min_n"),
                "median_rows": F.col("median_n"), "mean_rows": F.col("mean_n")}),
        _lines(tonics, "tonic",
               {"distinct_values": F.col("values"), "tonic_hz": F.col("tonic"), "clips": F.col("clips")}, recording),
        _lines(once.agg(F.sum("nan_rows").alias("nan_rows"), F.sum("inf_rows").alias("inf_rows")), "sanity",
               {"nan_rows": F.col("nan_rows"), "inf_rows": F.col("inf_rows")}),
        _lines(sums.groupBy("channel").agg(F.sum("zero_rows").alias("n")), "sanity", {"zero_rows": F.col("n")}, F.col("channel")),
        _lines(sums.agg(F.sum("zero_rows").alias("n")), "sanity", {"zero_channels": F.col("n")}),
        _moments(sums, "sanity"),
        _moments(keep(_sums(earlier, [], "old_features", width, names), "earlier"), "earlier"),
        _lines(aligned, "alignment", {"keys": F.col("n")}, F.col("status")),
        compared,
    ]
    report = sections[0]
    for s in sections[1:]:
        report = report.unionByName(s)
    return report


def _stored_parts(
    rows: DataFrame, key: Sequence[str], by: Sequence[str], block: str, order: Sequence[str], width: int, names: Sequence[str], store: str
) -> tuple[DataFrame, DataFrame]:
    """Sums and picks of all runs below ``store``, after adding those of the keys not seen yet.

    The sums are the manifest: they are written last, and picks of a run without sums do not count.
    """
    spark = rows.sparkSession
    run = uuid.uuid4().hex
    if exists(spark, f"{store}/sums"):
        seen = spark.read.parquet(f"{store}/sums").select(*[F.col(k).alias(f"_seen_{k}") for k in key]).distinct()
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in key])
        rows = rows.join(seen, same, "left_anti")
    picks = ranking.representatives(rows, key, block, order).select(*key, "pick", "features")
    sums = _sums(rows, by, "features", width, names)
    schemas = {"picks": picks.schema, "sums": sums.schema}
    for name, part in (("picks", picks), ("sums", sums)):
        part.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{store}/{name}")
    every = {n: spark.read.schema(s.add("run", "string")).parquet(f"{store}/{n}") for n, s in schemas.items()}
    runs = every["sums"].select("run").distinct()
    return every["sums"].drop("run"), every["picks"].join(runs, "run", "left_semi").drop("run")


def require_aligned(reconciliation: DataFrame) -> None:
    """Raise unless every key was found on both sides with the same label."""
    off = reconciliation.filter("status <> 'matched' and n > 0").orderBy("status").collect()
    if off:
        raise GateFailed("; ".join(f"{r['n']} {r['status']}" for r in off))
