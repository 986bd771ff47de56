import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import catalogue as cat, quality, ranking
from pitchloom.plans import dataset, gate, model
from pitchloom.sources import contours, documents, tables


def test_joins_with_hot_and_null_classes(spark):
    big = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 500).cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.createDataFrame([("hot", 1)] + [(str(k), k) for k in range(0, 480)], "k string, w int")
    known = {r.k: r.w for r in small.collect()}
    rows = [(r.k, r.v) for r in big.collect()]
    got = {(r.k, r.v, r.w) for r in cat.labelled(big, small, "k").collect()}
    assert got == {(k, v, known[k]) for k, v in rows if k in known}
    got = {(r.k, r.v, r.w) for r in cat.with_knowledge(big, small, "k").collect()}
    assert got == {(k, v, known.get(k)) for k, v in rows}


def test_unlisted_labels_and_listed_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0])], "label int, features array<double>")
    near = model.NearestCentroid.fit(df, [0, 1, 2])
    assert near.labels == [0, 1]
    assert {(r.label, r.n) for r in model.unlisted(df, [0, 1, 2]).collect()} == {(7, 2), (None, 1)}


def test_completeness_gate(spark):
    items = spark.createDataFrame([(f"r{i}",) for i in range(9)], "recording_id string")
    some = items.filter("recording_id >= 'r6'")
    with pytest.raises(cat.IncompleteError, match=r"6 items.*First 5.*r0") as e:
        cat.require_complete(items, some, ["recording_id"])
    assert e.value.exit_code == 2
    cat.require_complete(some, items, ["recording_id"])


def test_knowledge_links(spark):
    kb = {
        "A": {"arohanam": "S R G", "avarohanam": "G R S", "similar": ["B", "Nowhere"]},
        "B": {"arohanam": "S R M P", "avarohanam": "P M R S", "similar": ["A"]},
    }
    k = documents.parse_knowledge(spark.createDataFrame([(json.dumps(kb),)], "value string"))
    tags = {(r.class_name, r.similar_name): r.tag for r in cat.similar_links(k).collect()}
    assert tags == {("A", "B"): "4 swaras", ("A", "Nowhere"): "Related raga", ("B", "A"): "3 swaras"}
    over = {(r.class_name, r.similar_name): (r.shared, r.jaccard) for r in cat.link_overlap(k).collect()}
    assert over == {("A", "B"): (2, 0.4), ("B", "A"): (2, 0.4)}
    preds = spark.createDataFrame([("A", 1), ("Z", 2)], "class_name string, n int")
    rows = {r.class_name: r.ascending for r in cat.with_knowledge(preds, k, "class_name").collect()}
    assert rows == {"A": ["S", "R", "G"], "Z": None}


def test_duplicates_and_basenames(spark):
    items = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "id string, class_name string"
    )
    got = {r.id: (r.n_rows, r.n_classes, r.conflict) for r in cat.duplicate_ids(items).collect()}
    assert got == {"a": (2, 1, False), "b": (2, 2, True)}
    paths = spark.createDataFrame([("song", "r1/song"), ("song", "r2/song"), ("solo", "r1/solo")], "b string, k string")
    assert [tuple(r) for r in cat.shared_basenames(paths, "b", "k").collect()] == [("song", 2)]


def test_feedback_threshold(spark):
    rows = [("p", "A", False)] * 50 + [("p", "B", False)] * 49 + [("B", "B", True)] * 9
    fb = spark.createDataFrame(rows, "predicted_class string, actual_class string, was_correct boolean")
    got = {r.actual_class: (r.n_feedback, r.n_corrections, r.retrain_ready) for r in cat.feedback_rollup(fb).collect()}
    assert got == {"A": (50, 50, True), "B": (58, 49, False)}


def test_class_counts_and_balance(spark):
    rows = spark.createDataFrame([(0,)] * 5 + [(2,)] * 2, "label int")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, class_name string")
    assert {r.class_name: r.n for r in quality.filled_class_counts(rows, classes).collect()} == {"a": 5, "b": 0, "c": 2}
    r = quality.imbalance(quality.class_counts(rows)).first()
    assert (r.n_classes, r.max_n, r.min_n, r.ratio, r.median_n, r.mean_n) == (2, 5, 2, 2.5, 3, 3.5)


def test_picks_of_small_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "k string, t int")
    df = df.withColumn("block", F.col("t").cast("long"))
    got = sorted((r.k, r.pick, r.t) for r in ranking.representatives(df, ["k"], "block", ["t"]).collect())
    assert got == [("a", "first", 0), ("a", "last", 3), ("a", "middle", 2), ("b", "first", 0), ("b", "last", 0), ("b", "middle", 0)]


def test_running_best_is_strict(spark):
    vals = [0.0, 0.5, 0.5, 0.4, 0.9]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "k string, e int, v double")
    df = df.withColumn("block", F.floor(F.col("e") / 2))
    got = ranking.running_best(df, ["k"], "block", ["e"], "v").filter("is_best").orderBy("e").collect()
    assert [r.e for r in got] == [1, 4]


def test_splits_keep_groups_together(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("recording_id"), F.col("id").alias("clip"))
    grouped = ranking.train_test_split(df, ["recording_id"])
    assert grouped.groupBy("recording_id").agg(F.count_distinct("is_train").alias("n")).filter("n > 1").count() == 0
    share = ranking.train_test_split(df, ["recording_id", "clip"]).agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.76 < share < 0.84
    assert ranking.two_stage_sample(df.withColumn("g", F.col("recording_id") % 9), "g", "clip").count() == 5


def test_reconciliation_and_gate(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "k string, label int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("w", 3)], "k string, label int")
    rec = quality.reconcile(a, b, ["k"])
    assert {r.status: r.n for r in rec.collect()} == {"matched": 1, "label_mismatch": 1, "left_only": 1, "right_only": 1}
    with pytest.raises(gate.GateFailed) as e:
        gate.require_aligned(rec)
    assert e.value.exit_code == 1
    gate.require_aligned(quality.reconcile(a, a, ["k"]))


def test_scaler_network_and_storage(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 2, (3, 12))
    rows = [(int(i), int(i % 3), [float(x) for x in centres[i % 3] + rng.normal(0, 1, 12)] + [4.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    scaled = np.array([r.scaled for r in model.standardise(df).orderBy("id").collect()])
    x = np.array([r[2] for r in rows])
    want = np.divide(x - x.mean(0), x.std(0), out=np.zeros_like(x), where=x.std(0) > 0)
    assert np.allclose(scaled, want, atol=1e-9)

    split = ranking.train_test_split(df, ["id"])
    net = model.fit_network(split.filter("is_train"), 3, hidden=(8,), max_iter=60)
    path = str(tmp_path / "net")
    tables.save_model(net, path)
    scored = model.score_network(tables.load_model(path), split.filter("not is_train"))
    assert model.accuracy(scored).first().accuracy > 0.8
    assert all(abs(sum(r.probability) - 1) < 1e-6 for r in scored.collect())

    near = model.NearestCentroid.fit(split.filter("is_train"), range(3)).score(split.filter("not is_train"))
    assert model.accuracy(near).first().accuracy > 0.8
    zero = model.NearestCentroid([0, 1], np.array([[1.0, 0.0], [0.0, 0.0]]))
    one = spark.createDataFrame([([2.0, 0.0],)], "features array<double>")
    sims = one.select(zero.similarity(F.col("features"))).first()[0]
    assert sims[0] == 1.0 and sims[1] is None


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def plateau(seed):
    """Text of a contour that holds notes long enough to be stable."""
    rng = np.random.default_rng(seed)
    notes = np.repeat(150 * 2 ** (rng.choice([0, 200, 500, 700, 1200], 12) / 1200), 60)
    return "".join(f"{i * 0.0044:.4f} {hz:.3f}\n" for i, hz in enumerate(notes))


def test_files_to_labelled_dataset(spark, tmp_path):
    root = tmp_path / "features"
    for rid, song in [("id1", "a/song"), ("id1", "b/song"), ("id3", "a/other"), ("unmapped", "x/y")]:
        write(root / rid / f"{song}.pitchSilIntrpPP", plateau(len(song)))
        write(root / rid / f"{song}.tonicFine", " 150.5 \n")
    write(root / "id1/a/song.flatSegNyas", "0.1 0.9\n1.0 1.2\n")
    write(root / "id1/b/song.flatSegNyas", "0.1 0.9\nbroken\n")
    write(root / "id1/a/song.taniSegKNN", "")
    write(root / "id3/a/other.taniSegKNN", "0.0\t0.5\n")
    write(root / "id2/a/no_tonic.pitchSilIntrpPP", plateau(3))
    write(root / "id3/a/bad.pitchSilIntrpPP", "0.0 100.0\n")
    write(root / "id3/a/bad.tonicFine", "none\n")

    base = str(root)
    frames = contours.read_contours(spark, base)
    assert frames.select("recording_id").distinct().count() == 6
    indexed = contours.with_frame_index(frames, block_s=0.5).groupBy("recording_id").agg(F.max("frame_idx").alias("m"))
    assert {r.recording_id: r.m for r in indexed.collect()}["id1/a/song"] == 719
    assert {r.recording_id for r in contours.read_tonics(spark, base).collect()} == {
        "id1/a/song", "id1/b/song", "id3/a/other", "unmapped/x/y"
    }
    segs = {(r.recording_id, r.kind): r.end_s for r in contours.read_segments(spark, base).orderBy("end_s").collect()}
    assert segs == {("id1/a/song", "nyas"): 1.2, ("id3/a/other", "tani"): 0.5}
    found = contours.discover(spark, base, contours.CONTOUR_EXT)
    assert {r.class_id for r in found.collect()} == {"id1", "id2", "id3", "unmapped"}

    write(tmp_path / "map.json", json.dumps({"id1": "One", "id2": "Two", "id3": "Three", "id9": "Nine"}))
    mapping = documents.read_class_mapping(spark, str(tmp_path / "map.json"))
    data = dataset.annotated_dataset(spark, base, mapping)
    got = {r.recording_id: r for r in data.collect()}
    # id2 has no usable recording and keeps label 1; unmapped classes are left out.
    assert {k: (r.class_name, r.label) for k, r in got.items()} == {
        "id1/a/song": ("One", 0), "id1/b/song": ("One", 0), "id3/a/other": ("Three", 2)
    }
    assert all(len(r.features) == 360 and abs(sum(r.features) - 0.3) < 1e-9 for r in got.values())

    out = str(tmp_path / "stored")
    tables.write_features(data, out)
    tables.write_features(data.withColumn("source", F.lit("clips")), out)
    assert tables.read_features(spark, out).count() == 6
    assert tables.read_features(spark, out, "clips").count() == 3
    labels = dataset.class_labels(found, mapping)
    assert [r.n for r in dataset.rows_per_class(data, labels).collect()] == [2, 0, 1]


def test_file_names_with_special_characters(spark, tmp_path):
    root = tmp_path / "my data" / "feat+ures"
    song = "id1/Śrī artist/a+b 100%/Kalyāṇi (live).v2"
    write(root / f"{song}.pitchSilIntrpPP", plateau(1))
    write(root / f"{song}.tonicFine", "150.0")
    base = str(root)
    assert contours.read_tonics(spark, base).first().recording_id == song
    assert contours.read_contours(spark, "file:" + base).first().recording_id == song
    assert contours.discover(spark, base, contours.CONTOUR_EXT).first().recording_id == song


def test_summary_in_one_pass_equals_the_single_checks(spark):
    rng = np.random.default_rng(8)
    x = rng.random((60, 9))
    x[3, 4], x[5, 0], x[7, 3:6] = np.nan, np.inf, 0.0
    for rows in (x, np.delete(x, [3, 5], axis=0)):
        df = spark.createDataFrame([([float(v) for v in r],) for r in rows], "features array<double>")
        names = ("a", "b", "c")
        got = {r.channel: r for r in quality.channel_summary(df, 3, names).collect()}
        long = quality.long_channels(df, [], 3, names)
        broken = quality.broken_values(df).first()
        assert (got["overall"].nan_rows, got["overall"].inf_rows) == (broken.nan_rows, broken.inf_rows)
        for r in quality.zero_channels(long).collect():
            assert got[r.channel].zero_sum_rows == r.zero_sum_rows
        for r in quality.channel_statistics(long).collect():
            same = lambda a, b: a == pytest.approx(b, rel=1e-9, nan_ok=True)
            assert same(got[r.channel]["mean"], r["mean"]) and (same(got[r.channel]["std"], r["std"]) or not np.isfinite(r["std"]))


def test_clip_dataset_stops_without_tonics(spark):
    frames = spark.createDataFrame(
        [("r", i * 0.5, 150.0 + i % 7, True, 0.9) for i in range(100)],
        "recording_id string, ts double, f0_hz double, voiced boolean, voiced_prob double",
    )
    rec = spark.createDataFrame(
        [("r", "A", 50.0, "a/r.wav"), ("u", "Unknown", 50.0, "u.wav")],
        "recording_id string, class_name string, duration_s double, audio_path string",
    )
    classes = spark.createDataFrame([("A", "id-a", 4)], "class_name string, class_id string, label int")
    tonics = spark.createDataFrame([("r", 150.0)], "recording_id string, tonic_hz double")
    rows = dataset.clip_dataset(frames, rec, tonics, classes, hop=0.5).collect()
    assert sorted(r.clip_start for r in rows) == [0.0, 10.0, 20.0, 30.0]
    seen = {(r.label, r.class_id, r.audio_path, r.method, r.source, r.expert_tonic_hz) for r in rows}
    assert seen == {(4, "id-a", "a/r.wav", "detected", "clips", 150.0)}
    with pytest.raises(cat.IncompleteError):
        dataset.clip_dataset(frames, rec, tonics.filter("false"), classes)


def test_json_documents_and_reports(spark, tmp_path):
    write(tmp_path / "classes.json", json.dumps(["B", "A"]))
    labels = documents.read_class_list(spark, str(tmp_path / "classes.json"))
    assert {r.class_name: r.label for r in labels.collect()} == {"B": 0, "A": 1}
    items = {"A": [{"id": "v1", "duration": 200, "title": "t"}, {"id": "v2", "duration": 100, "title": "u"}], "Q": []}
    write(tmp_path / "items.json", json.dumps(items))
    rows = documents.read_catalogue(spark, str(tmp_path / "items.json"))
    plan = dataset.ingest_plan(rows, labels).orderBy("id").collect()
    assert [(r.id, r.label, r.excerpt_start, r.excerpt_length) for r in plan] == [("v1", 1, 66, 90), ("v2", 1, 0, 100)]
    write(tmp_path / "kb.json", json.dumps({"A": {"arohanam": "S R", "avarohanam": "R S", "similar": ["B"]}}))
    assert documents.read_knowledge(spark, str(tmp_path / "kb.json")).first().ascending == ["S", "R"]

    report = spark.createDataFrame([("b", "m", "", 1.0), ("a", "m", "k", 2.0)], "section string, metric string, key string, value double")
    tables.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    fb = spark.createDataFrame(
        [("A", "B", False, 81.5, "x.wav")],
        "predicted_class string, actual_class string, was_correct boolean, confidence double, audio_filename string",
    )
    for _ in range(2):
        tables.append_feedback(fb, str(tmp_path / "feedback"))
    assert spark.read.parquet(str(tmp_path / "feedback")).count() == 2


def test_unreadable_lines_and_files_are_counted(spark):
    lines = spark.createDataFrame(
        [("a", "0.0 100.0"), ("a", "x 1"), ("a", "1.0"), ("a", "2.0 y"), ("a", "# note"), ("a", " "), ("b", "1 2 3")],
        "recording_id string, value string",
    )
    assert {(r.recording_id, r.reason, r.n) for r in contours.dropped_lines(lines).collect()} == {("a", "no time", 1), ("a", "no frequency", 2)}
    assert contours.parse_contour(lines).count() == 2
    files = spark.createDataFrame([("a", " 150.5\n"), ("b", ""), ("c", "1 2"), ("d", "\n \t")], "recording_id string, value string")
    assert {(r.recording_id, r.reason) for r in contours.dropped_tonics(files).collect()} == {("b", "empty"), ("c", "not a number"), ("d", "empty")}
    assert [r.tonic_hz for r in contours.parse_tonics(files).collect()] == [150.5]


def test_similar_scales_against_all_pairs(spark):
    """Copies of scales, ties, null names and tokens, and scales that share nothing."""
    rng = np.random.default_rng(11)
    scales = {f"c{k:02}": sorted(rng.choice(list("abcdefghijkl"), rng.integers(1, 6), replace=False).tolist()) for k in range(40)}
    scales |= {f"copy{k}": ["a", "b", "c"] for k in range(9)} | {"lone": ["z"], "empty": [], "twice": ["a", "a", None, "b"]}
    rows = [*scales.items(), (None, ["a"]), ("nothing", None)]
    df = spark.createDataFrame(rows, "class_name string, ascending array<string>")
    got = {(r.class_name, r["rank"]): (r.similar_name, r.shared, round(r.jaccard, 9)) for r in cat.similar_scales(df).collect()}
    sets = {c: {t for t in ts if t} for c, ts in scales.items()}
    want = {}
    for c, own in sets.items():
        near = sorted((-len(own & o) / len(own | o), d) for d, o in sets.items() if d != c and own & o)
        want |= {(c, n + 1): (d, len(own & sets[d]), round(-j, 9)) for n, (j, d) in enumerate(near[:3])}
    assert got == want and not any(c in ("lone", "empty") for c, _ in got)
    # Scales meet at shared tokens only.
    plan = cat.similar_scales(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan


def test_similar_scales_of_few_and_many_tokens(spark):
    """Half of the scales have more tokens than are listed under subsets; all meet all."""
    rng = np.random.default_rng(5)
    sets = {f"s{k:03}": set(rng.choice(list("abcdefghijklmn"), rng.integers(1, 12), replace=False).tolist()) for k in range(120)}
    df = spark.createDataFrame([(c, sorted(t)) for c, t in sets.items()], "class_name string, ascending array<string>")
    want = {}
    for c, own in sets.items():
        near = sorted((-len(own & o) / len(own | o), d) for d, o in sets.items() if d != c and own & o)
        want |= {(c, n + 1): (d, len(own & sets[d])) for n, (_, d) in enumerate(near[:4])}
    assert {(r.class_name, r["rank"]): (r.similar_name, r.shared) for r in cat.similar_scales(df, k=4).collect()} == want


def test_scales_that_share_a_token_do_not_all_meet(spark):
    """Every scale holds one token: pairs would be 1,999,000, and are a few per scale."""
    df = spark.range(2000).selectExpr("'c' || id AS class_name", "array('all', 'a' || id % 50, 'b' || id div 50) AS ascending")
    sized = df.select("class_name", F.array_sort("ascending").alias("_tokens"), F.xxhash64("class_name").alias("_scale"), F.lit(3).alias("_n"))
    assert cat._shared_subsets(sized, 3).unionByName(cat._shared_tokens(sized)).count() < 2000 * 7 * 4


def test_scan_keeps_rejects_and_stops_if_asked(spark, tmp_path):
    files = {
        "k/good": ["0.0 110.0\n0.5 0\n", "110.0", "0.0 0.4\n", ""],
        "k/odd": ["# note\n\n0.0 x\nfoo 1\n1.0 120.0\n0.5\n", "n/a", "0 1\n2\n", "0 1\n"],
        "k/bare": ["0.0 100.0\n", " \n", None, None],
    }
    for name, texts in files.items():
        for ext, content in zip((contours.CONTOUR_EXT, contours.TONIC_EXT, *contours.SEGMENT_EXTS.values()), texts):
            if content is not None:
                (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / "in" / f"{name}{ext}").write_text(content)
    root = str(tmp_path / "in")
    got = contours.scan(spark, root, str(tmp_path / "scan"))
    assert {tuple(r) for r in got.frames.collect()} == {("k/good", 0.0, 110.0), ("k/good", 0.5, 0.0), ("k/odd", 1.0, 120.0), ("k/bare", 0.0, 100.0)}
    assert [tuple(r) for r in got.tonics.collect()] == [("k/good", 110.0)]
    assert {tuple(r) for r in got.segments.select("recording_id", "kind", "start_s").collect()} == {("k/good", "nyas", 0.0), ("k/odd", "tani", 0.0)}
    assert {tuple(r) for r in got.rejects.collect()} == {
        ("k/odd", "contour", "no frequency", 2),
        ("k/odd", "contour", "no time", 1),
        ("k/odd", "tonic", "not a number", 1),
        ("k/bare", "tonic", "empty", 1),
        ("k/odd", "nyas", "not two numbers", 1),
    }
    status = {(r.recording_id, r.kind): (r.status, r.n) for r in contours.segment_status(spark, root, got).collect()}
    assert status == {
        ("k/good", "nyas"): ("read", 1),
        ("k/good", "tani"): ("empty", 0),
        ("k/odd", "nyas"): ("unreadable", 0),
        ("k/odd", "tani"): ("read", 1),
        ("k/bare", "nyas"): ("absent", 0),
        ("k/bare", "tani"): ("absent", 0),
    }
    with pytest.raises(contours.UnreadableError, match="k/bare .tonic: empty"):
        got.require_readable()
    mapping = spark.createDataFrame([("k", "K")], "class_id string, class_name string")
    with pytest.raises(contours.UnreadableError):
        dataset.annotated_dataset(spark, root, mapping, strict=True)
    assert dataset.annotated_dataset(spark, root, mapping).collect() == []


def test_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "id int, v string"

    def rows():
        return sorted(((r.id, r.v, r.batch) for r in spark.read.parquet(path).collect()), key=repr)

    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "x"), (None, "x")], schema)
    for _ in range(2):
        tables.append_once(first, path, "one", ["id"])
        assert rows() == sorted([(1, "a", "one"), (2, "b", "one"), (None, "x", "one"), (None, "x", "one")], key=repr)
    second = spark.createDataFrame([(2, "again"), (3, "c")], schema)
    for _ in range(3):
        tables.append_once(second, path, "two", ["id"])
        assert [r for r in rows() if r[2] == "two"] == [(3, "c", "two")] and len(rows()) == 5


def test_bucketed_features_meet_without_a_shuffle(spark):
    from pitchloom.queries import stored

    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        earlier, later = stored.bucketed(spark, "/root/testdata/sf0.001")
        both = earlier.join(later.select("vec_id", F.col("features").alias("new")), "vec_id").groupBy("vec_id").agg(F.count("*"))
        both.collect()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_a_second_gate_run_reads_new_keys_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(k % 6, k, 0, 100.0 + k % 6, rng.random(6).tolist()) for k in range(60)]
    schema = "label int, vec_id int, block int, expert_tonic_hz double, features array<double>"
    whole = spark.createDataFrame(data, schema)
    # Vectors of the keys seen before are broken; nobody looks at them again.
    spoiled = spark.createDataFrame([(a, b, c, d, [float("nan")] * 6 if a < 4 else v) for a, b, c, d, v in data], schema)
    earlier = whole.groupBy("label").agg(F.min_by("features", "vec_id").alias("old_features"))
    classes = whole.select("label").distinct()

    def report(rows, **options):
        out = gate.gate_report(rows, earlier, classes, ["label"], "block", ["vec_id"], 2, ("a", "b", "c"), **options)
        return {(r.section, r.metric, r.key): round(r.value, 9) if r.value is not None else None for r in out.collect()}

    store = str(tmp_path / "store")
    first = report(whole.filter("label < 4"), store=store)
    assert first["summary", "rows", ""] == 40
    assert report(spoiled, store=store) == report(whole) == report(spoiled, store=store)
