import datetime
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pitchloom.queries import live
from pitchloom.streaming import clips, feedback

SCHEMA = "recording_id string, started_at timestamp, ts double, f0_hz double, tonic_hz double"


def frames(spark):
    rng = np.random.default_rng(3)
    rows = []
    for rec, start, n in [("a", "2024-01-01 00:00:07", 400), ("b", "2024-01-01 00:02:00", 300)]:
        for i in range(n):
            hz = 0.0 if rng.random() < 0.1 else float(rng.uniform(100, 400))
            rows.append((rec, pd.Timestamp(start).to_pydatetime(), i * 0.25, hz, 150.0))
    return spark.createDataFrame(rows, SCHEMA)


def key(r):
    return (r.recording_id, r.clip_start, r.clip_end, r.bin, r.n)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "frames")
    # Files in time order, as a stream would bring them.
    for lo in range(0, 100, 20):
        part = frames(spark).filter((F.col("ts") >= lo) & (F.col("ts") < lo + 20))
        part.coalesce(1).write.mode("append").parquet(src)
    # A last frame far ahead closes every clip before it.
    end = [("z", pd.Timestamp("2024-01-02").to_pydatetime(), 0.0, 200.0, 150.0)]
    spark.createDataFrame(end, SCHEMA).write.mode("append").parquet(src)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
    run = (
        clips.stream_clip_histogram(stream, lateness_s=600.0)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(key, clips.clip_histogram(clips.clip_bins(frames(spark))).collect()))
    assert got == want
    starts = {r[1] for r in got}
    assert min(starts) == 0.0 and all(s % 10 == 0 for s in starts)


def test_running_corrections(spark, tmp_path):
    src = str(tmp_path / "fb")
    schema = "actual_class string, was_correct boolean"
    for wrong in (30, 25):
        rows = [("A", False)] * wrong + [("B", True)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    feedback.running_corrections(stream, out, str(tmp_path / "cp")).awaitTermination()
    states = spark.read.parquet(out).orderBy("actual_class", "n_feedback").collect()
    a = [(r.n_corrections, r.retrain_ready) for r in states if r.actual_class == "A"]
    assert len(a) == 2 and a[-1] == (55, True) and not a[0][1]
    assert [r.n_corrections for r in states if r.actual_class == "B"] == [0, 0]


def test_partial_counts_in_any_order_and_negative_times(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    early = [("a", pd.Timestamp("2024-01-01").to_pydatetime(), t, 200.0, 150.0) for t in (-5.0, -15.0, -0.1)]
    whole = frames(spark).union(spark.createDataFrame(early, SCHEMA))
    whole.orderBy(F.col("ts").desc()).repartition(5).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    clips.write_partial_counts(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(key, clips.summed_counts(spark.read.parquet(out)).collect()))
    assert got == sorted(map(key, clips.clip_histogram(clips.clip_bins(frames(spark))).collect()))
    assert clips.clip_bins(spark.createDataFrame(early, SCHEMA)).count() == 0


def test_streams_read_a_file_or_a_folder_of_part_files(spark, tmp_path):
    for name, parts in (("one", 1), ("many", 4)):
        sf = tmp_path / name
        sf.mkdir()
        spark.range(1000).repartition(parts).write.parquet(str(sf / "events.parquet"))
        if parts == 1:
            (part,) = (sf / "events.parquet").glob("part-*.parquet")
            part.rename(sf / "single")
            (sf / "events.parquet").rename(sf / "folder")
            (sf / "single").rename(sf / "events.parquet")
        out = str(tmp_path / f"out-{name}")
        run = (
            live.stream_table(spark, str(sf), "events")
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        assert spark.read.parquet(out).count() == 1000


def test_late_counts_go_to_the_side(spark, tmp_path):
    """Closed clips and late counts together are the counts of all frames of closed clips."""
    def frame_rows(times):
        start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
        return spark.createDataFrame([("r", start, float(t), 150.0, 110.0) for t in times], "recording_id string, started_at timestamp, ts double, f0_hz double, tonic_hz double")

    path, batches = str(tmp_path / "in"), [range(0, 300, 2), range(1, 300, 20), range(300, 420, 2), [5, 415]]
    schema = frame_rows([0]).schema
    for k, times in enumerate(batches):
        frame_rows(times).coalesce(1).write.mode("append").parquet(path)
        frames = spark.readStream.schema(schema).parquet(path)
        clips.write_closed_and_late(frames, str(tmp_path / "out"), str(tmp_path / "check"), 60.0).awaitTermination()
    # A batch that runs again writes what it wrote.
    closed = {(r.clip_start, r.bin): r.n for r in clips.closed_counts(spark, str(tmp_path / "out")).collect()}
    late = {(r.clip_start, r.bin): r.n for r in clips.late_counts(spark, str(tmp_path / "out")).collect()}
    whole = {(r.clip_start, r.bin): r.n for r in clips.clip_histogram(clips.clip_bins(frame_rows([t for b in batches for t in b]))).collect()}
    last = max(s for s, _ in whole) + 30 - 90
    assert late and all(s + 30 <= last for s, _ in closed)
    both = {k: closed.get(k, 0) + late.get(k, 0) for k in closed.keys() | late.keys()}
    assert both == {k: n for k, n in whole.items() if k[0] + 30 <= last}
    # Frame 5 lies in three clips that were closed long before.
    assert late[(0.0, next(iter(late))[1])] >= 1
