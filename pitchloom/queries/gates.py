"""Queries over feature vectors: peaks, similarity, balance, the gate report."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text, vectors
from ..operators import quality, ranking
from ..operators.blocks import time_block
from ..plans import gate
from ..session import scratch_folder
from .contours import HOP
from .registry import frames_sql, q6, query, r6

# The fixture's vectors have four channels of 16 values.
WIDTH, NAMES = 16, ("c0", "c1", "c2", "c3")
BLOCK_IDS = 65_536

ELEMS = """WITH e AS (SELECT vec_id, label, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings, range(1, 65) AS r(i)),
  ch AS (SELECT vec_id, label, 'c' || (pos // 16) AS channel, CAST(pos % 16 AS INTEGER) AS bin, v FROM e)
"""


def channels(spark, sf, keep=("vec_id", "label")):
    return quality.long_channels(fx.vectors(spark, sf), keep, WIDTH, NAMES)


@query(
    "vec1_vec2_channel_slices",
    ELEMS + f"SELECT vec_id, channel, count(*) AS n, {q6('sum(v)')} AS total, {q6('sum(v * v)')} AS energy FROM ch GROUP BY ALL",
)
def channel_slices(spark, sf):
    v = F.col("values")
    return channels(spark, sf).select(
        "vec_id",
        "channel",
        F.size(v).cast("long").alias("n"),
        r6(vectors.total(v)).alias("total"),
        r6(vectors.dot(v, v)).alias("energy"),
    )


@query(
    "top1_top_classes",
    ELEMS + f"""SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, {q6('v')} AS prob FROM (
      SELECT vec_id, CAST(pos AS INTEGER) AS label, v,
             row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos DESC) AS rank FROM e) WHERE rank <= 5""",
)
def top_classes(spark, sf):
    """Each vector as class probabilities in long form; the five highest."""
    scores = fx.vectors(spark, sf).select("vec_id", F.posexplode("features").alias("label", "prob"))
    return ranking.top_classes(scores, ["vec_id"]).select("vec_id", "rank", "label", r6("prob").alias("prob"))


@query(
    "top2_channel_peaks",
    ELEMS + f"""SELECT vec_id, channel, CAST(rank - 1 AS INTEGER) AS rank, bin, {q6('v')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY v DESC, bin DESC) AS rank FROM ch) WHERE rank <= 5""",
)
def channel_peaks(spark, sf):
    peaks = vectors.top_k(F.col("values"), 5)
    return channels(spark, sf).select("vec_id", "channel", F.posexplode(peaks).alias("rank", "p")).select(
        "vec_id", "channel", "rank", F.col("p.bin").alias("bin"), r6("p.value").alias("value")
    )


@query(
    "top5_vec5_channel_report",
    ELEMS + f"""SELECT vec_id, channel, bool_or(isnan(v)) AS any_nan, bool_or(isinf(v)) AS any_inf, bool_and(v = 0) AS all_zero,
      CAST(arg_min(bin, (-v, bin)) AS INTEGER) AS peak_bin, CAST(arg_min(bin, (-v, bin)) AS INTEGER) * 10 AS peak_cents,
      {q6('max(v)')} AS peak_value, CAST(count(*) FILTER (v > 0) AS INTEGER) AS nonzero_bins,
      max(v) > 0 AS passed FROM ch GROUP BY ALL""",
)
def channel_report(spark, sf):
    out = quality.channel_report(channels(spark, sf, keep=("vec_id",)))
    return out.withColumn("peak_value", r6("peak_value"))


@query("agg8_class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def class_counts(spark, sf):
    return quality.class_counts(fx.vectors(spark, sf))


def class_list(spark, sf):
    """Nations as the class list of the fixture's labels."""
    return fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("label"), F.col("n_name").alias("class_name")
    )


@query(
    "agg9_filled_class_counts",
    """SELECT n_nationkey AS label, n_name AS class_name, count(vec_id) AS n
       FROM nation LEFT JOIN embeddings ON label = n_nationkey GROUP BY ALL""",
)
def filled_class_counts(spark, sf):
    return quality.filled_class_counts(fx.vectors(spark, sf), class_list(spark, sf))


@query(
    "agg10_agg11_imbalance",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT count(*) AS n_classes, max(n) AS max_n, min(n) AS min_n, {q6('max(n) / min(n)')} AS ratio,
      CAST(floor(median(n)) AS BIGINT) AS median_n, {q6('avg(n)')} AS mean_n FROM c""",
)
def imbalance(spark, sf):
    out = quality.imbalance(quality.class_counts(fx.vectors(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("ratio", "mean_n")})


@query(
    "agg12_set3_constancy",
    """SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT round(l_tax, 6)) AS n_values,
         count(DISTINCT round(l_tax, 6)) = 1 AS consistent FROM lineitem GROUP BY 1""",
)
def constancy(spark, sf):
    return quality.constancy(fx.table(spark, sf, "lineitem"), ["l_orderkey"], "l_tax")


# Negative values stand in for broken ones: the fixture's own vectors are clean.
DAMAGED = """WITH d AS (SELECT vec_id, label, i - 1 AS pos,
      CASE WHEN embedding[i] < -0.3 THEN 'nan'::DOUBLE WHEN embedding[i] > 0.3 THEN 'inf'::DOUBLE
           WHEN (i - 1) // 16 = label THEN 0e0 ELSE CAST(embedding[i] AS DOUBLE) END AS v
    FROM embeddings, range(1, 65) AS r(i))"""


def damaged(spark, sf):
    def spoil(x, i):
        return (
            F.when(x < F.lit(-0.3).cast("float"), F.lit(float("nan")))
            .when(x > F.lit(0.3).cast("float"), F.lit(float("inf")))
            .when(F.floor(i / 16) == F.col("label"), F.lit(0.0))
            .otherwise(x.cast("double"))
        )

    emb = fx.table(spark, sf, "embeddings")
    return emb.select("vec_id", "label", F.transform("embedding", spoil).alias("features"))


@query(
    "agg13_broken_values",
    DAMAGED + """, f AS (SELECT vec_id, bool_or(isnan(v)) AS n, bool_or(isinf(v)) AS i FROM d GROUP BY 1)
    SELECT count(*) AS n_rows, count(*) FILTER (n) AS nan_rows, count(*) FILTER (i) AS inf_rows FROM f""",
)
def broken_values(spark, sf):
    return quality.broken_values(damaged(spark, sf))


@query(
    "agg14_zero_channels",
    DAMAGED + """, c AS (SELECT vec_id, 'c' || (pos // 16) AS channel, bool_and(v = 0) AS z, bool_or(isnan(v)) AS bad FROM d GROUP BY ALL)
    SELECT channel, count(*) FILTER (z) AS zero_sum_rows, count(*) FILTER (z) AS all_zero_rows FROM c GROUP BY 1""",
)
def zero_channels(spark, sf):
    return quality.zero_channels(quality.long_channels(damaged(spark, sf), ["vec_id"], WIDTH, NAMES))


@query(
    "agg15_channel_statistics",
    ELEMS + f"""SELECT channel, count(*) AS n, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS std FROM ch GROUP BY 1
      UNION ALL SELECT 'overall', count(*), {q6('avg(v)')}, {q6('stddev_pop(v)')} FROM ch""",
)
def channel_statistics(spark, sf):
    out = quality.channel_statistics(channels(spark, sf))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "agg16_mean_vectors",
    ELEMS + f"SELECT label, CAST(pos AS INTEGER) AS pos, {q6('avg(v)')} AS v FROM e GROUP BY ALL",
)
def mean_vectors(spark, sf):
    m = quality.mean_vector(fx.vectors(spark, sf), ["label"])
    return m.select("label", F.posexplode("mean_vector").alias("pos", "v")).withColumn("v", r6("v"))


def blocked_vectors(spark, sf):
    return fx.vectors(spark, sf).withColumn("block", F.floor(F.col("vec_id") / BLOCK_IDS))


PICKS = """, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i,
      count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  picks AS (SELECT label, 'first' AS pick, vec_id FROM o WHERE i = 0 UNION ALL
            SELECT label, 'middle', vec_id FROM o WHERE i = n // 2 UNION ALL
            SELECT label, 'last', vec_id FROM o WHERE i = n - 1)
"""


@query("win4_representatives", ELEMS + PICKS + "SELECT * FROM picks")
def representatives(spark, sf):
    return ranking.representatives(blocked_vectors(spark, sf), ["label"], "block", ["vec_id"]).select(
        "label", "pick", "vec_id"
    )


@query(
    "win5_running_best",
    f"""WITH frames AS ({frames_sql(HOP)}), b AS (SELECT recording_id, frame_idx, f0_hz,
      coalesce(max(f0_hz) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS p
      FROM frames)
    SELECT recording_id, frame_idx, {q6('f0_hz')} AS f0_hz, {q6('p')} AS best_before FROM b WHERE f0_hz > p""",
)
def running_best(spark, sf):
    """Frames higher than all earlier ones of their recording."""
    f = fx.frames(spark, sf, HOP).withColumn("block", time_block(F.col("ts"), fx.block_seconds(HOP)))
    out = ranking.running_best(f, ["recording_id"], "block", ["frame_idx"], "f0_hz").filter("is_best")
    return out.select("recording_id", "frame_idx", r6("f0_hz").alias("f0_hz"), r6("best_before").alias("best_before"))


@query(
    "win6_first_match",
    """SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
       FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
)
def first_match(spark, sf):
    """First order of each customer that has lines."""
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    both = fx.table(spark, sf, "orders").join(lines, "o_orderkey", "left_semi")
    return ranking.first_match(both, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"]).withColumnRenamed(
        "o_orderkey", "first_order"
    )


# Per label, the vector with the lowest id plays the recording's earlier features.
OLD = """, old AS (SELECT label AS l, arg_min(vec_id, vec_id) AS old_id FROM embeddings GROUP BY 1),
  pairs AS (SELECT e.vec_id, e.label, e.pos, e.v, o.v AS w FROM e JOIN old ON l = e.label JOIN e o ON o.vec_id = old_id AND o.pos = e.pos)
"""


def old_features(spark, sf):
    return ranking.first_match(fx.vectors(spark, sf), ["label"], ["vec_id"], ["features"]).withColumnRenamed(
        "features", "old_features"
    )


@query(
    "jn6_vec3_cosine_to_earlier",
    ELEMS + OLD + f"SELECT vec_id, label, {q6('sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w)))')} AS cosine FROM pairs GROUP BY ALL",
)
def cosine_to_earlier(spark, sf):
    joined = gate.match_earlier(fx.vectors(spark, sf), old_features(spark, sf), ["label"])
    return joined.select(
        "vec_id", "label", r6(vectors.cosine(F.col("features"), F.col("old_features"))).alias("cosine")
    )


COMPARE_SQL = ELEMS + OLD + PICKS + f""",
  chosen AS (SELECT label, pick, pos, v, w FROM picks p JOIN pairs USING (vec_id, label)),
  means AS (SELECT label, pos, avg(v) AS m, any_value(w) AS w FROM chosen GROUP BY ALL),
  sides AS (SELECT label, 'c' || (pos // 16) AS channel, pick, pos % 16 AS bin, v, w FROM chosen
            UNION ALL SELECT label, 'c' || (pos // 16), 'earlier', pos % 16, w, w FROM means
            UNION ALL SELECT label, 'full', 'mean', pos, m, w FROM means),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY label, channel, pick ORDER BY v DESC, bin DESC) AS r FROM sides),
  compared AS (SELECT label, channel, pick,
      CASE WHEN pick <> 'earlier' THEN sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) END AS cosine,
      string_agg(CASE WHEN r <= 5 THEN bin END, ',' ORDER BY r) AS peak_bins FROM ranked GROUP BY label, channel, pick)
"""


@query("vec4_channel_comparison", COMPARE_SQL + f"SELECT label, channel, pick, peak_bins, {q6('cosine')} AS cosine FROM compared")
def channel_comparison(spark, sf):
    picks = ranking.representatives(blocked_vectors(spark, sf), ["label"], "block", ["vec_id"])
    out = gate.compare_channels(old_features(spark, sf), picks, ["label"], WIDTH, NAMES)
    bins = F.array_join(F.transform("peaks", lambda p: p["bin"].cast("string")), ",")
    return out.select("label", "channel", "pick", bins.alias("peak_bins"), r6("cosine").alias("cosine"))


@query(
    "fn17_peak_text",
    ELEMS + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY v DESC, bin DESC) AS rank FROM ch)
    SELECT vec_id, channel, string_agg(printf('bin%3d (%4d¢)=%.4f', bin, bin * 10, v), ', ' ORDER BY rank) AS peaks
    FROM r WHERE rank <= 5 GROUP BY ALL""",
)
def peak_text(spark, sf):
    return channels(spark, sf).select(
        "vec_id", "channel", text.peaks_text(vectors.top_k(F.col("values"), 5)).alias("peaks")
    )


@query(
    "jn7_key_reconciliation",
    """WITH b AS (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
    j AS (SELECT CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only'
                      WHEN o_orderstatus IS NOT DISTINCT FROM s THEN 'matched' ELSE 'label_mismatch' END AS status
          FROM orders FULL JOIN b ON o_orderkey = l_orderkey)
    SELECT status, count(*) AS n FROM j GROUP BY 1""",
)
def key_reconciliation(spark, sf):
    left = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("label")
    )
    right = (
        fx.table(spark, sf, "lineitem")
        .filter("l_quantity > 25")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.min("l_linestatus").alias("label"))
    )
    return quality.reconcile(left, right, ["key"])


@query(
    "smp1_two_stage_sample",
    """WITH d AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || vec_id), vec_id) AS r
                FROM embeddings)
    SELECT label, vec_id FROM d WHERE r = 1 ORDER BY md5('42:' || label), label LIMIT 5""",
)
def two_stage_sample(spark, sf):
    """Five classes by hash, one vector of each."""
    return ranking.two_stage_sample(fx.vectors(spark, sf), "label", "vec_id")


GATE_SQL = COMPARE_SQL + """,
  cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  f AS (SELECT vec_id, bool_or(isnan(v)) AS bad, bool_or(isinf(v)) AS inf FROM e GROUP BY 1),
  z AS (SELECT vec_id, channel, sum(v) = 0 AS zero FROM ch GROUP BY ALL),
  lines AS (
    SELECT 'summary' AS section, 'rows' AS metric, '' AS key, count(*)::DOUBLE AS value FROM embeddings
    UNION ALL SELECT 'summary', 'labels_present', '', count(DISTINCT label) FROM embeddings
    UNION ALL SELECT 'summary', 'class_rows', CAST(n_nationkey AS VARCHAR), coalesce(n, 0) FROM nation LEFT JOIN cnt ON label = n_nationkey
    UNION ALL SELECT 'summary', 'max_over_min', '', max(n) / min(n) FROM cnt
    UNION ALL SELECT 'summary', 'max_rows', '', max(n) FROM cnt
    UNION ALL SELECT 'summary', 'min_rows', '', min(n) FROM cnt
    UNION ALL SELECT 'summary', 'median_rows', '', floor(median(n)) FROM cnt
    UNION ALL SELECT 'summary', 'mean_rows', '', avg(n) FROM cnt
    UNION ALL SELECT 'tonic', 'distinct_values', CAST(label AS VARCHAR), count(DISTINCT round(120e0 + label, 6)) FROM embeddings GROUP BY label
    UNION ALL SELECT 'tonic', 'tonic_hz', CAST(label AS VARCHAR), 120e0 + label FROM cnt
    UNION ALL SELECT 'tonic', 'clips', CAST(label AS VARCHAR), n FROM cnt
    UNION ALL SELECT 'sanity', 'nan_rows', '', count(*) FILTER (bad) FROM f
    UNION ALL SELECT 'sanity', 'inf_rows', '', count(*) FILTER (inf) FROM f
    UNION ALL SELECT 'sanity', 'zero_rows', channel, count(*) FILTER (zero) FROM z GROUP BY channel
    UNION ALL SELECT 'sanity', 'mean', channel, avg(v) FROM ch GROUP BY channel
    UNION ALL SELECT 'sanity', 'std', channel, stddev_pop(v) FROM ch GROUP BY channel
    UNION ALL SELECT 'sanity', 'mean', 'overall', avg(v) FROM ch
    UNION ALL SELECT 'sanity', 'std', 'overall', stddev_pop(v) FROM ch
    UNION ALL SELECT 'sanity', 'zero_channels', '', count(*) FILTER (zero) FROM z
    UNION ALL SELECT 'earlier', 'mean', 'c' || (pos // 16), avg(w) FROM means GROUP BY ALL
    UNION ALL SELECT 'earlier', 'std', 'c' || (pos // 16), stddev_pop(w) FROM means GROUP BY ALL
    UNION ALL SELECT 'earlier', 'mean', 'overall', avg(w) FROM means
    UNION ALL SELECT 'earlier', 'std', 'overall', stddev_pop(w) FROM means
    UNION ALL SELECT 'alignment', 'keys', 'matched', count(*) FROM cnt
    UNION ALL SELECT 'cross', 'cosine', label || '/' || channel || '/' || pick, cosine FROM compared WHERE pick <> 'earlier'
    UNION ALL SELECT 'cross', 'peak_bin_' || r, label || '/' || channel || '/' || pick, bin FROM ranked WHERE r <= 5
    UNION ALL SELECT 'cross', 'peak_value_' || r, label || '/' || channel || '/' || pick, v FROM ranked WHERE r <= 5)
"""


@query("qa1_gate_report", GATE_SQL + f"SELECT section, metric, key, {q6('value')} AS value FROM lines")
def gate_report(spark, sf):
    """All sections of the gate as one long table."""
    rows = blocked_vectors(spark, sf).withColumn("expert_tonic_hz", F.lit(120.0) + F.col("label"))
    out = gate.gate_report(
        rows, old_features(spark, sf), class_list(spark, sf), ["label"], "block", ["vec_id"], WIDTH, NAMES, strict=True
    )
    return out.withColumn("value", r6("value"))


@query("qa1_gate_report_in_two_runs", GATE_SQL + f"SELECT section, metric, key, {q6('value')} AS value FROM lines")
def gate_report_in_two_runs(spark, sf):
    """A first run over some of the keys, a second over all; the second reads the new ones only."""
    rows = blocked_vectors(spark, sf).withColumn("expert_tonic_hz", F.lit(120.0) + F.col("label"))
    store = scratch_folder(spark, "gate-store")
    for some in (rows.filter("label % 3 <> 1"), rows):
        out = gate.gate_report(
            some, old_features(spark, sf), class_list(spark, sf), ["label"], "block", ["vec_id"], WIDTH, NAMES, store=store
        )
    return out.withColumn("value", r6("value"))
