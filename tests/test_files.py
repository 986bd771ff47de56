"""Annotation files as tasks write them, and their listing."""

import glob
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from pitchloom import fixtures as fx
from pitchloom.plans import dataset
from pitchloom.sources import contours, files as sources

SF = "/root/testdata/sf0."


def test_lines_become_files(spark, tmp_path):
    root = str(tmp_path / "files")
    lines = spark.createDataFrame(
        [("0/a.pitchSilIntrpPP", f"{i} 1.0") for i in range(300)]
        + [("0/a.flatSegNyas", None), ("1/b c.tonicFine", "140.0"), ("1/b c.pitchSilIntrpPP", "")],
        "name string, line string",
    )
    for _ in range(2):  # as by a task that was run again
        fx.write_text_files(lines.repartition(5), root)
    found = {os.path.relpath(p, root): open(p).read() for p in glob.glob(f"{root}/*/*")}
    assert set(found) == {"0/a.pitchSilIntrpPP", "0/a.flatSegNyas", "1/b c.tonicFine", "1/b c.pitchSilIntrpPP"}
    assert sorted(found.pop("0/a.pitchSilIntrpPP").splitlines()) == sorted(f"{i} 1.0" for i in range(300))
    assert found == {"0/a.flatSegNyas": "", "1/b c.tonicFine": "140.0\n", "1/b c.pitchSilIntrpPP": "\n"}
    listed = {(r.recording_id, r.source): r.length for r in contours.listed(spark, root).collect()}
    assert listed.pop(("0/a", "contour")) > 0
    assert listed == {("0/a", "nyas"): 0, ("1/b c", "tonic"): 6, ("1/b c", "contour"): 1}


@pytest.mark.skipif(not os.path.isdir(SF + "01"), reason="driver tables not present")
def test_driver_does_no_work_per_file(spark, tmp_path, monkeypatch):
    client = type(spark._jvm._gateway_client)
    send, calls = client.send_command, []

    def counted(self, command, *args, **kwargs):
        if not command.startswith("m\n"):  # objects let go
            calls.append(command)
        return send(self, command, *args, **kwargs)

    monkeypatch.setattr(client, "send_command", counted)
    n, files = [], []
    for sf in ("001", "01"):
        calls.clear()
        root = str(tmp_path / sf)
        fx.annotation_files(spark, SF + sf, root)
        n.append(len(calls))
        files.append(len(glob.glob(f"{root}/*/*")))
    assert files[1] > files[0] + 100
    assert n[1] < n[0] + 100


def test_driver_keeps_no_list_of_files(spark, tmp_path):
    """Spark's driver holds every file of a table it reads; tasks list and read the annotation files."""
    root = tmp_path / "in"
    for k in range(300):
        for ext, content in zip(contours.SOURCES.values(), ("0.0 110.0\n0.5 x\n", "110.0", "0.0 0.4\n", "" if k % 2 else "0 1\n")):
            path = root / str(k % 3) / f"{k}{ext}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content)
    scanned = contours.scan(spark, str(root), str(tmp_path / "scan"))
    status = contours.segment_status(spark, str(root), scanned)
    assert {(r.kind, r.status, r.n): r["count"] for r in status.groupBy("kind", "status", "n").count().collect()} == {
        ("nyas", "read", 1): 300, ("tani", "read", 1): 150, ("tani", "empty", 0): 150
    }
    assert {(r.source, r.reason): r["count"] for r in scanned.rejects.groupBy("source", "reason").count().collect()} == {
        ("contour", "no frequency"): 300
    }
    found = contours.discover(spark, str(root), contours.CONTOUR_EXT)
    assert found.count() == found.select("recording_id", "path").distinct().count() == 300
    for rows in (contours.read_contours(spark, str(root)), found, contours.listed(spark, str(root)), status):
        assert not any(p.endswith(tuple(contours.SOURCES.values())) for p in rows.inputFiles())


@pytest.mark.parametrize("seed", range(20))
def test_ranges_of_a_file_hold_each_line_once(seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"a", b"bc" * 9, b"\n", b"\r", b"\r\n", b"\r\r\n"]) for _ in range(60))
    for size in (1, 2, 3, 7, 1000):
        for chunk in (1, 2, 5, 1000):
            got = []
            for start in range(0, len(data), size):
                for some in sources.lines_from(io.BytesIO(data), start, min(start + size, len(data)), chunk):
                    got += some
            assert got == data.splitlines()


def test_files_are_found_and_read_as_by_spark(spark, tmp_path, monkeypatch):
    """Hidden files and folders, empty files, extensions in capitals, signs in names, odd bytes, line ends and ranges."""
    root = tmp_path / "my data" / "a+b"
    ext = contours.CONTOUR_EXT
    contents = {
        f"1/x{ext}": b"\xef\xbb\xbf0 1\r2 3\r\n\n4 5", f"1/deep/er/é #%41[1]{ext}": b"a\xffb 1\n" * 50, f"top{ext}": b"6 7\n",
        f"1/empty{ext}": b"", f"1/_part{ext}": b"8 9\n", f"1/.dot{ext}": b"8 9\n", f"_tmp/y{ext}": b"8 9\n", f"_k=1/y{ext}": b"8 9\n",
        f"_metadata/z{ext}": b"1 1\n", f"1/capital{ext.upper()}": b"8 9\n", f"1/other{ext}.txt": b"8 9\n",
    }
    for name, content in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "1" / f"gone{ext}").symlink_to(root / "nowhere")
    monkeypatch.setattr(sources, "TASK_BYTES", 16)

    def everything():
        lines = [contours._lines(spark, str(root), ext, whole).select("recording_id", F.hex("value")) for whole in (False, True)]
        tables = [*lines, contours.discover(spark, str(root), ext), contours.listed(spark, str(root))]
        return [sorted(map(tuple, t.collect())) for t in tables]

    by_tasks = everything()
    monkeypatch.setattr(sources, "location", lambda *_: None)
    by_spark = everything()
    assert len(by_tasks[0]) == 57
    assert by_tasks == by_spark


def test_labels_of_a_dataset_need_no_list_of_files(spark, tmp_path):
    lines = [(f"{k % 2}/{k}{contours.CONTOUR_EXT}", f"{k} 110.0") for k in range(6)]
    fx.write_text_files(spark.createDataFrame(lines, "name string, line string"), str(tmp_path / "in"))
    mapping = spark.createDataFrame([("0", "none"), ("1", "one"), ("2", "two")], "class_id string, class_name string")
    found = contours.discover(spark, str(tmp_path / "in"), contours.CONTOUR_EXT)
    labels = dataset.class_labels(found, mapping)
    assert sorted(map(tuple, labels.select("class_id", "class_name", "label").collect())) == [("0", "none", 0), ("1", "one", 1)]
    assert not any(p.endswith(contours.CONTOUR_EXT) for p in labels.inputFiles())


def test_rejects_are_found_without_sparks_text_reader(spark, tmp_path, monkeypatch):
    """That reader keeps a list of all files in the driver."""
    lines = [(f"0/{k}{contours.CONTOUR_EXT}", line) for k in range(4) for line in ("0.0 110.0", "oops 1.0", "12.0")]
    fx.write_text_files(spark.createDataFrame(lines, "name string, line string"), str(tmp_path / "in"))
    monkeypatch.setattr(type(spark.read), "text", None)
    rejects = contours.scan(spark, str(tmp_path / "in"), str(tmp_path / "scan")).rejects
    assert {tuple(r) for r in rejects.collect()} == {(f"0/{k}", "contour", why, 1) for k in range(4) for why in ("no time", "no frequency")}
