"""Annotation files: one contour, tonic and segment file per recording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.blocks import BLOCK_S, dense_index, time_block
from . import files

# File extensions of the annotation set.
CONTOUR_EXT = ".pitchSilIntrpPP"
TONIC_EXT = ".tonicFine"
SEGMENT_EXTS = {"nyas": ".flatSegNyas", "tani": ".taniSegKNN"}
SOURCES = {"contour": CONTOUR_EXT, "tonic": TONIC_EXT, **SEGMENT_EXTS}


def _lines(spark: SparkSession, root: str, ext: str, whole: bool = False, found: DataFrame | None = None) -> DataFrame:
    """``recording_id, value`` of the files with ``ext``; ``found`` is the listing, if there is one already."""
    found = files.listing(spark, root, [ext]) if found is None else found
    if found is not None:
        return files.read_lines(spark, root, found, ext, whole)
    df = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{ext}")
        .text(root, wholetext=whole)
    )
    return df.select(text.file_key(F.col("_metadata.file_path"), root, ext).alias("recording_id"), "value")


def _field(i: int) -> Column:
    return F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(i)).try_cast("double")


def _is_content() -> Column:
    """Not a blank line and not a comment."""
    return ~F.trim("value").startswith("#") & (F.trim("value") != "")


def tagged_contour(lines: DataFrame) -> DataFrame:
    """``recording_id, ts, f0_hz, reason`` of content lines; ``reason`` tells why one gives no frame."""
    rows = lines.filter(_is_content()).select("recording_id", _field(1).alias("ts"), _field(2).alias("f0_hz"))
    return rows.withColumn("reason", F.when(F.col("ts").isNull(), "no time").when(F.col("f0_hz").isNull(), "no frequency"))


def parse_contour(lines: DataFrame) -> DataFrame:
    """``recording_id, ts, f0_hz`` from lines of ``seconds hertz``.

    Lines that cannot be read are left out; :func:`dropped_lines` counts them.
    """
    return tagged_contour(lines).filter("reason is null").drop("reason")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """``recording_id, reason, n``: content lines of contours that give no frame."""
    bad = tagged_contour(lines).filter("reason is not null")
    return bad.groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_contours(spark: SparkSession, root: str) -> DataFrame:
    return parse_contour(_lines(spark, root, CONTOUR_EXT))


def with_frame_index(contour: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Add ``block`` and the position of each frame in its recording."""
    blocked = contour.withColumn("block", time_block(F.col("ts"), block_s))
    return dense_index(blocked, ["recording_id"], "block", ["ts"])


def tagged_tonics(files: DataFrame) -> DataFrame:
    """``recording_id, tonic_hz, reason`` from whole one-number files."""
    content = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = files.select("recording_id", content.try_cast("double").alias("tonic_hz"), (content == "").alias("_empty"))
    reason = F.when(F.col("_empty"), "empty").when(F.col("tonic_hz").isNull(), "not a number")
    return rows.withColumn("reason", reason).drop("_empty")


def parse_tonics(files: DataFrame) -> DataFrame:
    """``recording_id, tonic_hz`` from whole one-number files.

    Files that cannot be read are left out; :func:`dropped_tonics` names them.
    """
    return tagged_tonics(files).filter("reason is null").drop("reason")


def dropped_tonics(files: DataFrame) -> DataFrame:
    """``recording_id, reason``: tonic files that are empty or hold no single number."""
    return tagged_tonics(files).filter("reason is not null").select("recording_id", "reason")


def read_tonics(spark: SparkSession, root: str) -> DataFrame:
    return parse_tonics(_lines(spark, root, TONIC_EXT, whole=True))


def tagged_segments(lines: DataFrame, kind: str) -> DataFrame:
    """``recording_id, kind, start_s, end_s, reason`` of content lines."""
    rows = lines.filter(_is_content()).select(
        "recording_id", F.lit(kind).alias("kind"), _field(1).alias("start_s"), _field(2).alias("end_s")
    )
    bad = F.col("start_s").isNull() | F.col("end_s").isNull()
    return rows.withColumn("reason", F.when(bad, "not two numbers"))


def parse_segments(lines: DataFrame, kind: str) -> DataFrame:
    """``recording_id, kind, start_s, end_s`` from lines of two numbers.

    A file with any unreadable line gives no segment at all.
    """
    rows = tagged_segments(lines, kind).drop("reason")
    return rows.join(unreadable(rows), "recording_id", "left_anti")


def unreadable(rows: DataFrame) -> DataFrame:
    """Recordings whose segment file has a line that is not two numbers."""
    bad = F.col("start_s").isNull() | F.col("end_s").isNull()
    return rows.filter(bad).select("recording_id").distinct()


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    parts = [parse_segments(_lines(spark, root, ext), kind) for kind, ext in SEGMENT_EXTS.items()]
    return parts[0].unionByName(parts[1])


class UnreadableError(RuntimeError):
    """Annotation files hold lines that cannot be read; ``exit_code`` as a batch job reports it."""

    exit_code = 1


@dataclass
class Scan:
    """What one pass over the annotation files found, stored with its rejects."""

    frames: DataFrame
    tonics: DataFrame
    segments: DataFrame
    #: ``recording_id, source, reason, n``
    rejects: DataFrame

    def require_readable(self, examples: int = 5) -> None:
        """Stop if any line was rejected, naming some."""
        found = self.rejects.orderBy("recording_id", "source", "reason").limit(examples).collect()
        if found:
            names = [f"{r.recording_id} ({r.source}: {r.reason}, {r.n} lines)" for r in found]
            raise UnreadableError(f"unreadable annotations, first of them: {names}")


def scan(spark: SparkSession, root: str, folder: str) -> Scan:
    """Read contours, tonics and segments below ``root`` once, good lines and rejects alike.

    Each source is one table below ``folder``, in two partitions by whether the line was
    read; the counts of rejects come from there, so files are not read again for them. A
    segment file with any unreadable line gives no segment.
    """
    found = files.listing(spark, root, list(SOURCES.values()))
    whole = {
        "contour": tagged_contour(_lines(spark, root, CONTOUR_EXT, found=found)),
        "tonic": tagged_tonics(_lines(spark, root, TONIC_EXT, whole=True, found=found)),
    }
    parts = [tagged_segments(_lines(spark, root, ext, found=found), kind) for kind, ext in SEGMENT_EXTS.items()]
    whole["segment"] = parts[0].unionByName(parts[1])
    good, bad = {}, []
    for source, rows in whole.items():
        tagged = rows.withColumn("ok", F.col("reason").isNull())
        tagged.write.partitionBy("ok").parquet(f"{folder}/{source}")
        back = spark.read.schema(tagged.schema).parquet(f"{folder}/{source}")
        good[source] = back.filter("ok").drop("ok", "reason")
        name = F.col("kind") if source == "segment" else F.lit(source)
        bad.append(back.filter("NOT ok").select("recording_id", name.alias("source"), "reason"))
    rejects = bad[0].unionByName(bad[1]).unionByName(bad[2])
    rejects = rejects.groupBy("recording_id", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    broken = bad[2].select("recording_id", F.col("source").alias("kind")).distinct()
    segments = good["segment"].join(broken, ["recording_id", "kind"], "left_anti")
    return Scan(good["contour"], good["tonic"], segments, rejects)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``recording_id, source, length`` of all annotation files, those of no bytes too; their content is not read.

    Tasks list the files. Where they cannot open ``root``, Spark's driver does.
    """
    found = files.listing(spark, root, list(SOURCES.values()))
    if found is None:
        found = _listed_by_driver(spark, root)
        path, key = F.col("path"), lambda ext: text.file_key(F.col("path"), root, ext)
    else:
        path, key = F.col("name"), lambda ext: F.substring("name", F.lit(1), F.length("name") - len(ext))
    kinds = [
        F.when(text.has_extension(path, [ext]), F.struct(key(ext).alias("recording_id"), F.lit(source).alias("source")))
        for source, ext in SOURCES.items()
    ]
    found = found.select(F.coalesce(*kinds).alias("_of"), "length").filter("_of IS NOT NULL")
    return found.groupBy("_of.recording_id", "_of.source").agg(F.max("length").alias("length"))


def _listed_by_driver(spark: SparkSession, root: str) -> DataFrame:
    """``path, length``; the list that Spark's driver makes also names files of no bytes, which a scan leaves out."""
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = spark.createDataFrame([(n,) for n in files_.inputFiles()], "path string")
    sizes = files_.select(F.col("_metadata.file_path").alias("path"), "length")
    return names.withColumn("length", F.lit(0).cast("long")).unionByName(sizes)


def segment_status(spark: SparkSession, root: str, scanned: Scan) -> DataFrame:
    """``class_id, recording_id, kind, status, n`` for every recording that has a contour.

    ``status`` is ``absent`` without a file, ``empty`` for one of no bytes (a recording
    without segments), ``unreadable`` for one that was rejected as a whole, else ``read``.
    """
    there = listed(spark, root)
    kinds = F.explode(F.array(*[F.lit(k) for k in SEGMENT_EXTS]))
    wanted = there.filter("source = 'contour'").select("recording_id", kinds.alias("kind"))
    found = there.select("recording_id", F.col("source").alias("kind"), "length")
    broken = scanned.rejects.select("recording_id", F.col("source").alias("kind"), F.lit(True).alias("broken")).distinct()
    counts = scanned.segments.groupBy("recording_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    on = ["recording_id", "kind"]
    rows = wanted.join(found, on, "left").join(broken, on, "left").join(counts, on, "left")
    status = (
        F.when(F.col("length").isNull(), "absent").when(F.col("length") == 0, "empty").when(F.col("broken"), "unreadable").otherwise("read")
    )
    return rows.select(
        F.substring_index("recording_id", "/", 1).alias("class_id"), *on, status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def discover(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """Files below the class folders: ``class_id, recording_id, path``.

    Lists files only; their content is not read, and those of no bytes are left out. The first
    folder is the class.
    """
    path = F.col("path")
    found = files.listing(spark, root, [ext])
    if found is not None:
        key = F.substring("name", F.lit(1), F.length("name") - len(ext))
        found = found.filter(text.has_extension(F.col("name"), [ext]) & (F.col("length") > 0))
        return paths_to_recordings(found.withColumn("recording_id", key))
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("_metadata.file_path").alias("path"))
        .filter(text.has_extension(path, [ext]))
    )
    return paths_to_recordings(found.withColumn("recording_id", text.file_key(path, root, ext)))


def paths_to_recordings(found: DataFrame) -> DataFrame:
    return found.select(
        F.substring_index("recording_id", "/", 1).alias("class_id"), "recording_id", "path"
    )
