"""The driver's tables in the roles the operators need.

Recordings are users of ``events``, frames are their events in time order on a
mappings. Used by the registered queries and by the tests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.depth import equi_depth, position
from .session import stored
from .sources import contours

# Rows of one recording that may share a block; blocks are this many frames long.
BLOCK_ROWS = 131_072


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def block_seconds(hop: float) -> float:
    return BLOCK_ROWS * hop


def frames(
    spark: SparkSession, sf: str, hop: float = 0.25, silent_zero: bool = False,
) -> DataFrame:
    """``recording_id, frame_idx, ts, f0_hz, voiced, voiced_prob, event_type``."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        "event_type",
        "value",
        "props",
    )
    order = ["at", "event_id"]
    blocked = equi_depth(ev, ["recording_id"], [F.col(c) for c in order], BLOCK_ROWS, "_cell", rank="_rank")
    indexed = position(blocked, ["recording_id"], "_cell", "_rank", order)
    voiced = F.col("event_type") != "error"
    f0 = F.lit(60.0) + F.col("value")
    return indexed.select(
        "recording_id",
        "frame_idx",
        (F.col("frame_idx") * F.lit(hop)).alias("ts"),
        (F.when(voiced, f0).otherwise(F.lit(0.0)) if silent_zero else f0).alias("f0_hz"),
        voiced.alias("voiced"),
        (F.from_json("props", "k int")["k"] / 100.0).alias("voiced_prob"),
        "event_type",
    )


def tonic_of(recording_id: Column) -> Column:
    return (F.lit(120) + recording_id.cast("long") % 60).cast("double")


def tonics(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("recording_id"))
    return ids.distinct().withColumn("tonic_hz", tonic_of(F.col("recording_id")))


def segments(frames_: DataFrame) -> DataFrame:
    """``nyas`` for one second from each purchase, ``tani`` for half from each signup."""
    nyas = F.col("event_type") == "purchase"
    return frames_.filter(F.col("event_type").isin("purchase", "signup")).select(
        "recording_id",
        F.when(nyas, "nyas").otherwise("tani").alias("kind"),
        F.col("ts").alias("start_s"),
        (F.col("ts") + F.when(nyas, 1.0).otherwise(0.5)).alias("end_s"),
    )


def recordings(frames_: DataFrame, hop: float) -> DataFrame:
    """``recording_id, duration_s, label, expert_tonic_hz`` of frames with a hop."""
    return frames_.groupBy("recording_id").agg((F.max("ts") + hop).alias("duration_s")).select(
        "recording_id",
        "duration_s",
        (F.col("recording_id").cast("long") % 5).cast("int").alias("label"),
        tonic_of(F.col("recording_id")).alias("expert_tonic_hz"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, label, features`` with four channels of 16 values."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features")
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as catalogue items: class = language, duration = length."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("class_name"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("n_chars").alias("duration_s"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of documents as feedback: predicted = quality, actual = 1 - toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rated = table(spark, sf, "labels").join(docs, "doc_id")
    good = F.col("quality") == 1 - F.col("toxic")
    return rated.select(
        "doc_id",
        F.concat("lang", F.lit("-"), F.col("quality")).alias("predicted_class"),
        F.concat("lang", F.lit("-"), 1 - F.col("toxic")).alias("actual_class"),
        F.col("lang"),
        good.alias("was_correct"),
    )


def annotation_files(spark: SparkSession, sf: str, root: str, hop: float = 0.25) -> None:
    """The frames, tonics and segments as files ``root/<class>/<recording><extension>``.

    By the last digit of the recording: 1 has a nyas file of no bytes, 2 one with an unreadable
    line, 3 none; 4 has unreadable lines in its contour; 5 a tonic that is no number, 6 none.
    """
    number = F.col("recording_id").cast("long")
    digit, class_id = number % 10, (number % 5).cast("string")
    f = stored(frames(spark, sf, hop, silent_zero=True), f"{root}-parts", "frames")
    ids = f.select("recording_id").distinct()
    segs = segments(f)
    spans = segs.select("recording_id", "kind", F.concat_ws(" ", "start_s", "end_s").alias("line"))
    texts = {
        contours.CONTOUR_EXT: f.select("recording_id", F.concat_ws("\t", "ts", "f0_hz").alias("line"))
        .union(ids.select("recording_id", F.explode(F.array(F.lit("# a contour"), F.lit(""))).alias("line")))
        .union(ids.filter(digit == 4).select("recording_id", F.explode(F.array(F.lit("oops 1.0"), F.lit("12.0"))).alias("line"))),
        contours.TONIC_EXT: ids.filter(digit != 6).select(
            "recording_id", F.when(digit == 5, "n/a").otherwise(tonic_of(F.col("recording_id")).cast("string")).alias("line")
        ),
        contours.SEGMENT_EXTS["tani"]: spans.filter("kind = 'tani'").drop("kind"),
        contours.SEGMENT_EXTS["nyas"]: spans.filter((F.col("kind") == "nyas") & ~digit.isin(1, 3))
        .drop("kind")
        .union(ids.filter(digit == 2).select("recording_id", F.lit("12.5 oops").alias("line"))),
    }
    # A null line opens the file and adds nothing to it.
    texts[contours.SEGMENT_EXTS["nyas"]] = texts[contours.SEGMENT_EXTS["nyas"]].union(
        ids.filter(digit == 1).select("recording_id", F.lit(None).cast("string").alias("line"))
    )
    out = None
    for ext, rows in texts.items():
        named = rows.select(F.concat(class_id, F.lit("/"), "recording_id", F.lit(ext)).alias("name"), "line")
        out = named if out is None else out.union(named)
    write_text_files(out, root)


def write_text_files(lines: DataFrame, root: str) -> None:
    """Each ``name`` of ``lines`` becomes the file ``root/<name>`` of its lines; a null line adds nothing.

    Tasks write the files themselves, one after the other and line by line. A file gets its
    name once it is whole, so a task that is run again or twice does no harm.
    """

    def run(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs as pfs
        from pyspark import TaskContext

        files, base = pfs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        folders, name, sink, n = set(), None, None, 0

        def part(of: str) -> str:
            folder, file = posixpath.split(of)
            return f"{base}/{folder}/_{file}-{attempt}"

        def close() -> None:
            sink.close()
            files.move(part(name), f"{base}/{name}")

        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != name:
                    if sink is not None:
                        close()
                    folder = posixpath.dirname(at)
                    if folder not in folders:
                        files.create_dir(f"{base}/{folder}", recursive=True)
                        folders.add(folder)
                    name, n = at, n + 1
                    sink = files.open_output_stream(part(at), buffer_size=65_536)
                if line is not None:
                    sink.write(f"{line}\n".encode())
        if sink is not None:
            close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    whole = lines.repartition("name").sortWithinPartitions("name")
    whole.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
