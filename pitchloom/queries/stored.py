"""Queries that store a result in the scratch folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import catalogue as cat, quality, ranking
from ..plans import dataset, model
from ..session import scratch_folder
from ..sources import contours, tables
from .contours import FEAT1_SQL, HOP, feat1
from .gates import ELEMS
from .registry import q6, query, r6, swapped


@query(
    "feat4_labelled_dataset",
    FEAT1_SQL + """, k AS (SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS class_id FROM events WHERE user_id % 5 <> 3),
    l AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS label FROM k),
    d AS (SELECT DISTINCT recording_id, CAST(CAST(recording_id AS BIGINT) % 5 AS VARCHAR) AS class_id FROM complete)
    SELECT class_id, label, count(recording_id) AS n FROM l LEFT JOIN d USING (class_id) GROUP BY ALL""",
)
def labelled_dataset(spark, sf):
    """Annotated features with labels from the sorted ids of the mapped classes."""
    feats = feat1(spark, sf).withColumn("class_id", (F.col("recording_id").cast("long") % 5).cast("string"))
    ids = fx.table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("class_id"))
    mapping = ids.distinct().filter("class_id <> '3'")
    labels = ranking.dense_labels(cat.known_items(ids.distinct(), mapping, "class_id"), "class_id")
    return dataset.rows_per_class(feats.join(labels, "class_id"), labels).select("class_id", "label", "n")


def scanned_files(spark, sf):
    root = scratch_folder(spark, "annotations")
    fx.annotation_files(spark, sf, root, HOP)
    return root, contours.scan(spark, root, scratch_folder(spark, "scan"))


@query(
    "feat4_src1_src2_src3_annotated_files",
    swapped(FEAT1_SQL, "event_type = 'purchase')", "event_type = 'purchase' AND CAST(recording_id AS BIGINT) % 10 NOT IN (1, 2, 3))")
    + f""", l AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS label
              FROM (SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS class_id FROM events WHERE user_id % 5 <> 3)),
    d AS (SELECT *, CAST(CAST(recording_id AS BIGINT) % 5 AS VARCHAR) AS class_id FROM complete
          WHERE CAST(recording_id AS BIGINT) % 10 NOT IN (5, 6)),
    v AS (SELECT recording_id, class_id, nyas / 10e0 / n_nyas AS v FROM d UNION ALL
          SELECT recording_id, class_id, duration / 10e0 / n_duration FROM d UNION ALL
          SELECT recording_id, class_id, stable / 10e0 / n_stable FROM d)
    SELECT class_id || '/' || recording_id AS recording_id, class_id, 'class ' || class_id AS class_name, label, 'annotated' AS method,
      'recordings' AS source, CAST(count(*) FILTER (v > 0) AS INTEGER) AS n_filled, {q6('sum(v * v)')} AS total
    FROM v JOIN l USING (class_id) GROUP BY recording_id, class_id, label""",
)
def annotated_files(spark, sf):
    """The whole job over annotation files, some of which are broken, empty or missing."""
    root, scanned = scanned_files(spark, sf)
    ids = fx.table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("class_id")).distinct()
    mapping = ids.filter("class_id <> '3'").withColumn("class_name", F.concat(F.lit("class "), "class_id"))
    out = dataset.annotated_dataset(spark, root, mapping, scanned=scanned, ttime=1.5)
    return out.select(
        *("recording_id", "class_id", "class_name", "label", "method", "source"),
        F.size(F.filter("features", lambda v: v > 0)).alias("n_filled"),
        r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)).alias("total"),
    )


@query(
    "src1_src2_src3_rejects",
    """WITH ids AS (SELECT DISTINCT user_id % 5 || '/' || user_id AS recording_id, user_id % 10 AS digit FROM events),
    bad(digit, source, reason) AS (VALUES (4, 'contour', 'no time'), (4, 'contour', 'no frequency'),
                                          (5, 'tonic', 'not a number'), (2, 'nyas', 'not two numbers'))
    SELECT recording_id, source, reason, 1::BIGINT AS n FROM ids JOIN bad USING (digit)""",
)
def file_rejects(spark, sf):
    """Lines of the annotation files that could not be read, from the pass that reads them."""
    return scanned_files(spark, sf)[1].rejects


@query(
    "src3_src7_segment_files",
    """WITH ids AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS nyas, count(*) FILTER (event_type = 'signup') AS tani
                     FROM events GROUP BY 1)
    SELECT CAST(user_id % 5 AS VARCHAR) AS class_id, user_id % 5 || '/' || user_id AS recording_id, 'nyas' AS kind,
      CASE user_id % 10 WHEN 1 THEN 'empty' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'absent'
                        ELSE CASE WHEN nyas > 0 THEN 'read' ELSE 'absent' END END AS status,
      CASE WHEN user_id % 10 IN (1, 2, 3) THEN 0 ELSE nyas END AS n FROM ids
    UNION ALL
    SELECT CAST(user_id % 5 AS VARCHAR), user_id % 5 || '/' || user_id, 'tani', CASE WHEN tani > 0 THEN 'read' ELSE 'absent' END, tani FROM ids""",
)
def segment_files(spark, sf):
    """The listing of files on the left, what was read of them on the right."""
    root, scanned = scanned_files(spark, sf)
    return contours.segment_status(spark, root, scanned)


@query(
    "snk1_src8_feature_store",
    ELEMS + f"""SELECT 'odd' AS source, label, count(DISTINCT vec_id) AS n, {q6('sum(v)')} AS total
      FROM e WHERE label % 2 = 1 GROUP BY label""",
)
def feature_store(spark, sf):
    """All vectors stored by source; one source read back, the other partition skipped."""
    path = scratch_folder(spark, "features")
    source = F.when(F.col("label") % 2 == 1, "odd").otherwise("even")
    tables.write_features(fx.vectors(spark, sf).withColumn("source", source), path)
    back = tables.read_features(spark, path, "odd")
    return (
        back.select("source", "label", "vec_id", F.explode("features").alias("v"))
        .groupBy("source", "label")
        .agg(F.count_distinct("vec_id").alias("n"), r6(F.sum("v")).alias("total"))
    )


@query(
    "snk2_repeated_feedback_batches",
    """WITH f AS (SELECT l.doc_id, d.lang || '-' || (1 - toxic) AS actual_class FROM labels l JOIN documents d USING (doc_id))
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'third' END AS batch, actual_class, count(*) AS n
    FROM f WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY ALL""",
)
def repeated_batches(spark, sf):
    """Two overlapping batches, each appended twice as by a job that was run again: every event counts once."""
    path = scratch_folder(spark, "feedback")
    rows = fx.feedback(spark, sf).select("doc_id", "predicted_class", "actual_class", "was_correct")
    for batch, divisor in (("even", 2), ("even", 2), ("third", 3), ("third", 3)):
        tables.append_once(rows.filter(F.col("doc_id") % divisor == 0), path, batch, ["doc_id"])
    return spark.read.parquet(path).groupBy("batch", "actual_class").agg(F.count(F.lit(1)).alias("n"))


def bucketed(spark, sf):
    """Two feature sets of the same vectors as tables with the same buckets."""
    names = []
    v = fx.vectors(spark, sf)
    for name, rows in {
        "earlier": v.filter("vec_id % 3 <> 0"),
        "later": v.withColumn("features", F.transform("features", lambda x, i: x + i)),
    }.items():
        path = scratch_folder(spark, name)
        names.append("f_" + path.rsplit("-", 1)[1])
        tables.write_bucketed(rows, names[-1], "vec_id", 16, path)
    return [spark.table(n) for n in names]


@query(
    "snk1_jn7_bucketed_features",
    ELEMS + f"""SELECT vec_id, label, {q6('sum(v * (v + pos))')} AS product FROM e WHERE vec_id % 3 <> 0 GROUP BY ALL""",
)
def bucketed_features(spark, sf):
    """Feature sets joined with feature sets by key, bucket by bucket."""
    earlier, later = bucketed(spark, sf)
    both = earlier.join(later.select("vec_id", F.col("features").alias("new")), "vec_id")
    product = F.aggregate(F.zip_with("features", "new", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", "label", r6(product).alias("product"))


@query(
    "snk3_report_store",
    ELEMS + f"""SELECT 'sanity' AS section, m AS metric, channel AS key, {q6('x')} AS value FROM (
      SELECT channel, 'mean' AS m, avg(v) AS x FROM ch GROUP BY 1 UNION ALL
      SELECT channel, 'std', stddev_pop(v) FROM ch GROUP BY 1)""",
)
def report_store(spark, sf):
    """Channel statistics written as a JSON report and read back."""
    path = scratch_folder(spark, "report")
    long = quality.long_channels(fx.vectors(spark, sf), [], 16, ("c0", "c1", "c2", "c3"))
    stats = quality.channel_statistics(long).filter("channel <> 'overall'")
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean", "std")]
    )
    lines = stats.select(F.lit("sanity").alias("section"), F.col("channel").alias("key"), F.inline(entries))
    tables.write_report(lines, path)
    back = spark.read.schema("section string, metric string, key string, value double").json(path)
    return back.withColumn("value", r6("value"))


@query(
    "snk4_scaler_store",
    ELEMS + f""", s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY 1)
    SELECT label, CAST(pos AS INTEGER) AS pos, {q6('sum((v - m) / s)')} AS v FROM e JOIN s USING (pos) GROUP BY ALL""",
)
def scaler_store(spark, sf):
    """A fitted scaler saved, loaded and applied."""
    path = scratch_folder(spark, "scaler")
    rows = model.with_vector(fx.vectors(spark, sf))
    tables.save_model(model.fit_scaler(rows), path)
    scaled = model.vector_to_array(F.col("_scaled"))
    return (
        tables.load_model(path)
        .transform(rows)
        .select("label", F.posexplode(scaled).alias("pos", "v"))
        .groupBy("label", "pos")
        .agg(r6(F.sum("v")).alias("v"))
    )
