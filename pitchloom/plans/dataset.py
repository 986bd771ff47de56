"""Dataset jobs: from annotation files to stored, labelled features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalogue as cat, quality, ranking
from ..session import scratch_folder
from ..sources import contours
from . import features


def class_labels(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """``class_id, class_name, label`` of the mapped classes that have a folder.

    Labels follow the sorted ids, so a class without usable rows keeps its number.
    """
    present = cat.known_items(found.select("class_id").distinct(), mapping, "class_id")
    return ranking.dense_labels(present, "class_id").join(mapping, "class_id")


def annotated_dataset(
    spark: SparkSession, root: str, mapping: DataFrame, strict: bool = False, scanned: contours.Scan | None = None, **options
) -> DataFrame:
    """Labelled features of all annotated recordings below ``root/<class_id>/``.

    The files are scanned once, see :func:`contours.scan`; a caller that wants the rejects
    as well hands its own scan in. With ``strict`` any rejected line stops the job.
    """
    scanned = scanned or contours.scan(spark, root, scratch_folder(spark, "scan"))
    if strict:
        scanned.require_readable()
    feats = features.annotated_features(scanned.frames, scanned.tonics, scanned.segments, **options)
    found = contours.discover(spark, root, contours.CONTOUR_EXT)
    labels = class_labels(found, mapping)
    return (
        feats.withColumn("class_id", F.substring_index("recording_id", "/", 1))
        .join(labels, "class_id")
        .select(
            "recording_id",
            F.lit("annotated").alias("method"),
            F.lit("recordings").alias("source"),
            "class_id",
            "class_name",
            "label",
            "features",
        )
    )


def clip_dataset(
    frames: DataFrame, recordings: DataFrame, tonics: DataFrame, classes: DataFrame, **options
) -> DataFrame:
    """Labelled clip features; stops when any recording of a known class has no tonic.

    ``recordings`` carries ``recording_id, class_name, duration_s, audio_path``,
    ``classes`` has ``class_id, class_name, label``; classes that the class list does not
    know are left out. Every clip tells its class id and the file it comes from.
    """
    known = cat.known_items(recordings, classes, "class_name")
    cat.require_complete(known, tonics, ["recording_id"])
    work = known.join(tonics.withColumnRenamed("tonic_hz", "expert_tonic_hz"), "recording_id").join(
        classes.select("class_name", "class_id", "label"), "class_name"
    )
    rows = features.clip_features(frames, work, keep=["label", "class_name", "class_id", "audio_path"], **options)
    return rows.select(
        "*", F.lit("detected").alias("method"), F.lit("clips").alias("source")
    ).withColumns({c: F.round(c, 2) for c in ("clip_start", "clip_dur")})


def rows_per_class(dataset: DataFrame, classes: DataFrame) -> DataFrame:
    return quality.filled_class_counts(dataset, classes).orderBy("label")


def ingest_plan(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Catalogue items to fetch: label and the excerpt to take of each.

    Items of unknown classes are left out (:func:`catalogue.unknown_items` names
    them).
    """
    return cat.labelled(items, classes, "class_name").select(
        "class_name",
        "label",
        "id",
        "duration_s",
        text.excerpt_start(F.col("duration_s")).alias("excerpt_start"),
        text.excerpt_length(F.col("duration_s")).alias("excerpt_length"),
    )
