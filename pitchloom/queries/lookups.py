"""Queries over class lists, catalogues, paths, feedback and parsed inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import pitch, text
from ..operators import catalogue as cat, ranking
from ..plans import dataset
from ..sources import contours, documents, tables
from .contours import HOP
from .registry import frames_sql, q6, query, r6

# ---- parsers, on text that Spark derives from the tables -------------------


@query(
    "src1_contour_lines",
    f"""WITH frames AS ({frames_sql(HOP, True)})
    SELECT recording_id, count(*) AS n, {q6('sum(ts)')} AS ts_sum, {q6('sum(f0_hz)')} AS f0_sum,
      count(*) FILTER (f0_hz > 0) AS n_voiced FROM frames GROUP BY 1""",
)
def contour_lines(spark, sf):
    """Every frame written as a text line and parsed again."""
    lines = fx.frames(spark, sf, HOP, silent_zero=True).select(
        "recording_id", F.concat_ws(" ", "ts", "f0_hz").alias("value")
    )
    return contours.parse_contour(lines).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.sum("ts")).alias("ts_sum"),
        r6(F.sum("f0_hz")).alias("f0_sum"),
        F.count_if(F.col("f0_hz") > 0).alias("n_voiced"),
    )


@query(
    "src2_tonic_files",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS recording_id, {q6('c_acctbal')} AS tonic_hz
        FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def tonic_files(spark, sf):
    """One number per file; the files of one market segment are unreadable."""
    bad = F.col("c_mktsegment") == "BUILDING"
    files = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("recording_id"),
        F.concat(F.lit(" "), F.when(bad, "n/a").otherwise(F.col("c_acctbal").cast("string")), F.lit("\n")).alias("value"),
    )
    return contours.parse_tonics(files).withColumn("tonic_hz", r6("tonic_hz"))


@query(
    "src3_segment_files",
    f"""WITH frames AS ({frames_sql(HOP)}),
    bad AS (SELECT DISTINCT recording_id FROM frames WHERE event_type = 'error' AND f0_hz < 70)
    SELECT recording_id, 'nyas' AS kind, count(*) AS n, min(ts) AS first_start, max(ts) + 1 AS last_end
    FROM frames WHERE event_type IN ('purchase', 'error') AND recording_id NOT IN (SELECT * FROM bad) GROUP BY ALL""",
)
def segment_files(spark, sf):
    """A recording with one broken line loses all its segments."""
    f = fx.frames(spark, sf, HOP).filter(F.col("event_type").isin("purchase", "error"))
    broken = (F.col("event_type") == "error") & (F.col("f0_hz") < 70)
    end = F.when(broken, F.lit("?")).otherwise((F.col("ts") + 1).cast("string"))
    lines = f.select("recording_id", F.concat_ws("\t", F.col("ts").cast("string"), end).alias("value"))
    return contours.parse_segments(lines, "nyas").groupBy("recording_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_s").alias("first_start"), F.max("end_s").alias("last_end")
    )


@query(
    "src4_class_documents",
    """SELECT CAST(n_nationkey AS VARCHAR) AS class_id, n_name AS class_name FROM nation""",
)
def class_documents(spark, sf):
    docs = fx.table(spark, sf, "nation").select(
        F.to_json(F.create_map(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("value")
    )
    return documents.parse_class_mapping(docs)


@query(
    "src5_catalogue_documents",
    """SELECT lang AS class_name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total_s, count(DISTINCT doc_id) AS n_ids
       FROM documents GROUP BY 1""",
)
def catalogue_documents(spark, sf):
    """Catalogue entries as nested JSON, one document per item."""
    item = F.struct("id", F.col("duration_s").alias("duration"), "title")
    docs = fx.catalogue(spark, sf).select(
        F.to_json(F.create_map("class_name", F.array(item))).alias("value")
    )
    return documents.parse_catalogue(docs).groupBy("class_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("total_s"), F.count_distinct("id").alias("n_ids")
    )


def knowledge(spark, sf):
    """Part names as classes: tokens as scale, three links of which one is unknown."""
    names = fx.table(spark, sf, "part").select("p_name").distinct()
    tok = F.split("p_name", " ")
    entry = F.struct(
        F.col("p_name").alias("arohanam"),
        F.concat_ws(" ", F.reverse(tok)).alias("avarohanam"),
        F.array(
            F.concat(tok[0], F.lit(" bolt")), F.concat(F.lit("red "), tok[1]), F.concat(tok[0], F.lit(" none"))
        ).alias("similar"),
    )
    docs = names.select(F.to_json(F.create_map("p_name", entry)).alias("value"))
    return documents.parse_knowledge(docs)


KB = """WITH kb AS (SELECT DISTINCT p_name AS class_name, string_split(p_name, ' ') AS t FROM part),
  links AS (SELECT class_name, t, CAST(i AS INTEGER) AS position,
    CASE i WHEN 0 THEN t[1] || ' bolt' WHEN 1 THEN 'red ' || t[2] ELSE t[1] || ' none' END AS similar_name
    FROM kb, range(3) AS r(i))
"""


@query(
    "src6_knowledge_documents",
    KB + "SELECT class_name, array_to_string(t, ' ') AS ascending, t[2] || ' ' || t[1] AS descending, CAST(3 AS INTEGER) AS n_similar FROM kb",
)
def knowledge_documents(spark, sf):
    return knowledge(spark, sf).select(
        "class_name",
        F.concat_ws(" ", "ascending").alias("ascending"),
        F.concat_ws(" ", "descending").alias("descending"),
        F.size("similar").alias("n_similar"),
    )


@query(
    "src7_fn13_paths",
    """WITH p AS (SELECT url, regexp_replace(url, '^.*?/en/', '') AS rel FROM pages),
    k AS (SELECT url, regexp_replace(rel, '([^/.][^/]*)\\.[^./]*$', '\\1') AS recording_id FROM p)
    SELECT split_part(recording_id, '/', 1) AS class_id, recording_id, url AS path,
      '/features/' || recording_id || '.tonicFine' AS sibling FROM k""",
)
def paths(spark, sf):
    """Page urls as media paths below ``/en``."""
    url = F.col("url")
    files = fx.table(spark, sf, "pages").select(
        url.alias("path"), text.recording_key(url, "/en").alias("recording_id")
    )
    return contours.paths_to_recordings(files).withColumn(
        "sibling", text.sibling_path(F.col("path"), "/en", "/features", contours.TONIC_EXT)
    )


@query(
    "src8_set1_feature_union",
    f"""SELECT source, count(*) AS n, {q6('sum(x)')} AS first_sum FROM (
      SELECT 'recordings' AS source, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings UNION ALL
      SELECT 'clips', CAST(embedding[2] AS DOUBLE) FROM embeddings) GROUP BY 1""",
)
def feature_union(spark, sf):
    v = fx.vectors(spark, sf)
    a = v.select("label", F.col("features")[0].alias("x"), F.lit("recordings").alias("source"))
    b = v.select(F.lit("clips").alias("source"), F.col("features")[1].alias("x"), "label")
    return tables.union_sources(a, b, None).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("first_sum")
    )


# ---- filters ---------------------------------------------------------------


def customers(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("class_id"))


def nations(spark, sf):
    return fx.table(spark, sf, "nation").filter("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name")
    )


@query(
    "flt7_known_classes",
    """SELECT c_custkey, c_nationkey AS class_id FROM customer
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)""",
)
def known_classes(spark, sf):
    return cat.known_items(customers(spark, sf), nations(spark, sf), "class_id").select("c_custkey", "class_id")


@query(
    "flt7_unknown_classes",
    """SELECT c_nationkey AS class_id, count(*) AS n FROM customer
       WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY 1""",
)
def unknown_classes(spark, sf):
    return cat.unknown_items(customers(spark, sf), nations(spark, sf), "class_id")


@query("flt8_extensions", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '[^/.][^/]*\\.html$')")
def extensions(spark, sf):
    return fx.table(spark, sf, "pages").filter(text.has_extension(F.col("url"), [".HTML"])).select("page_id", "url")


@query(
    "flt9_hosts",
    "SELECT page_id, url FROM pages WHERE contains(url, 'example.com') OR contains(url, 'example.net')",
)
def hosts(spark, sf):
    hit = text.mentions_host(F.col("url"), ["example.com", "example.net"])
    return fx.table(spark, sf, "pages").filter(hit).select("page_id", "url")


@query(
    "flt10_positive_override",
    f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {q6('c_acctbal')} END AS override_hz FROM customer",
)
def positive_override(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", r6(pitch.positive_or_null(F.col("c_acctbal"))).alias("override_hz")
    )


@query("flt11_name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def name_search(spark, sf):
    return fx.table(spark, sf, "part").filter(text.name_matches(F.col("p_name"), "RED")).select("p_partkey", "p_name")


@query("fn14_token_count", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def token_count(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", text.token_count(F.col("p_name")).alias("n"))


@query(
    "fn15_excerpts",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars > 180 THEN greatest(60, n_chars // 3) ELSE 0 END AS start,
       CASE WHEN n_chars > 180 THEN 90::BIGINT ELSE n_chars END AS length FROM documents""",
)
def excerpts(spark, sf):
    d = F.col("duration_s")
    return fx.catalogue(spark, sf).select(
        "id", text.excerpt_start(d).alias("start"), text.excerpt_length(d).alias("length")
    )


@query(
    "fn12_confidence_percent",
    f"""SELECT event_id, {q6('round_even(value / 512e0 * 100, 1)')} AS confidence,
      repeat('█', CAST(floor(value / 512e0 * 50) AS INTEGER)) AS bar FROM events""",
)
def confidence_percent(spark, sf):
    p = F.col("value") / 512.0
    return fx.table(spark, sf, "events").select(
        "event_id", r6(text.percent(p)).alias("confidence"), text.bar_text(p).alias("bar")
    )


# ---- joins and sets --------------------------------------------------------


@query(
    "jn4_missing_counterparts",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def missing_counterparts(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return cat.missing_counterparts(fx.table(spark, sf, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query(
    "jn5_prj1_label_lookup",
    """SELECT c_custkey, n_name AS class_name, c_nationkey AS class_id FROM customer
       JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2""",
)
def label_lookup(spark, sf):
    return cat.labelled(customers(spark, sf), nations(spark, sf), "class_id").select(
        "c_custkey", "class_name", "class_id"
    )


@query(
    "jn8_prediction_knowledge",
    """SELECT p_brand AS info, count(*) AS n FROM lineitem
       LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1""",
)
def prediction_knowledge(spark, sf):
    """Predicted classes without an entry keep their rows."""
    predictions = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("class_id"), "l_orderkey", "l_linenumber")
    info = fx.table(spark, sf, "part").filter("p_size <= 40").select(
        F.col("p_partkey").alias("class_id"), F.col("p_brand").alias("info")
    )
    joined = cat.with_knowledge(predictions, info, "class_id")
    return joined.groupBy("info").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn9_similar_links",
    KB + """SELECT l.class_name, similar_name, position,
      coalesce(len(o.t) || ' swaras', 'Related raga') AS tag FROM links l LEFT JOIN kb o ON o.class_name = similar_name""",
)
def similar_links(spark, sf):
    return cat.similar_links(knowledge(spark, sf)).select("class_name", "similar_name", "position", "tag")


@query(
    "vec6_link_overlap",
    KB + f"""SELECT l.class_name, similar_name, CAST(len(list_intersect(l.t, o.t)) AS INTEGER) AS shared,
      {q6('len(list_intersect(l.t, o.t))::DOUBLE / len(list_distinct(list_concat(l.t, o.t)))')} AS jaccard
      FROM links l JOIN kb o ON o.class_name = similar_name""",
)
def link_overlap(spark, sf):
    """Shared tokens along the links a class lists, not over all pairs."""
    return cat.link_overlap(knowledge(spark, sf)).withColumn("jaccard", r6("jaccard"))


@query(
    "vec6_similar_scales",
    """WITH c AS (SELECT p_partkey AS k, 'part ' || p_partkey AS class_name,
                 list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type, 'size ' || p_size])) AS t FROM part),
    i AS (SELECT class_name, len(t) AS n, unnest(t) AS token FROM c),
    s AS (SELECT a.class_name, b.class_name AS similar_name, CAST(count(*) AS INTEGER) AS shared,
                 count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j
          FROM i a JOIN i b USING (token) WHERE a.class_name <> b.class_name GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY j DESC, similar_name) AS rank FROM s)
    SELECT class_name, CAST(rank AS INTEGER) AS rank, similar_name, shared, round(j, 6) + 0e0 AS jaccard FROM r WHERE rank <= 3""",
)
def similar_scales(spark, sf):
    """Parts as classes, the words of their names, brands, types and sizes as tokens."""
    words = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.concat(F.lit("size "), "p_size")))
    parts = fx.table(spark, sf, "part").select(F.concat(F.lit("part "), "p_partkey").alias("class_name"), words.alias("ascending"))
    return cat.similar_scales(parts).withColumn("jaccard", r6("jaccard"))


@query(
    "set4_duplicate_ids",
    """SELECT l_orderkey AS id, count(*) AS n_rows, count(DISTINCT l_linestatus) AS n_classes,
       count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf):
    items = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("class_name")
    )
    return cat.duplicate_ids(items)


@query(
    "set5_shared_basenames",
    """WITH b AS (SELECT url, split_part(url, '/', -1) AS basename FROM pages)
    SELECT basename, count(DISTINCT url) AS n_recordings FROM b GROUP BY 1 HAVING count(DISTINCT url) > 1""",
)
def shared_basenames(spark, sf):
    p = fx.table(spark, sf, "pages").select("url", text.basename(F.col("url")).alias("basename"))
    return cat.shared_basenames(p, "basename", "url")


@query(
    "top7_top6_dense_labels",
    """WITH k AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#3'),
    l AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label FROM k)
    SELECT p_brand AS class_id, label, count(p_partkey) FILTER (p_size > 45) AS n FROM l JOIN part USING (p_brand)
    GROUP BY ALL ORDER BY label""",
)
def dense_labels(spark, sf):
    """Labels follow the class list, also for classes that end up without rows."""
    part = fx.table(spark, sf, "part").withColumnRenamed("p_brand", "class_id")
    labels = ranking.dense_labels(part.filter("class_id <> 'Brand#3'"), "class_id")
    rows = part.filter("p_size > 45").join(labels, "class_id")
    return dataset.rows_per_class(rows, labels).select("class_id", "label", "n")


# ---- accounting and feedback ----------------------------------------------


@query(
    "agg18_success_rates",
    """SELECT lang AS class_name, count(*) FILTER (quality = 1) AS n_ok, count(*) AS n_total
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def success_rates(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("class_name"))
    done = docs.join(fx.table(spark, sf, "labels"), "doc_id", "left")
    return cat.success_rates(done.withColumn("ok", F.col("quality") == 1), "class_name", "ok")


FEEDBACK = """WITH f AS (SELECT doc_id, lang, lang || '-' || quality AS predicted_class,
    lang || '-' || (1 - toxic) AS actual_class, quality = 1 - toxic AS was_correct FROM labels JOIN documents USING (doc_id))
"""


@query(
    "agg21_feedback_rollup",
    FEEDBACK + """SELECT lang, count(*) AS n_feedback, count(*) FILTER (NOT was_correct) AS n_corrections,
      count(*) FILTER (NOT was_correct) >= 50 AS retrain_ready FROM f GROUP BY 1""",
)
def feedback_rollup(spark, sf):
    return cat.feedback_rollup(fx.feedback(spark, sf), "lang")


@query(
    "agg21_feedback_confusion",
    FEEDBACK + "SELECT predicted_class, actual_class, count(*) AS n FROM f GROUP BY ALL",
)
def feedback_confusion(spark, sf):
    return cat.confusion(fx.feedback(spark, sf))


@query(
    "feat6_ingest_plan",
    """WITH k AS (SELECT DISTINCT lang FROM documents WHERE lang <> 'es'),
    l AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM k)
    SELECT lang AS class_name, label, CAST(doc_id AS VARCHAR) AS id, n_chars AS duration_s,
      CASE WHEN n_chars > 180 THEN greatest(60, n_chars // 3) ELSE 0 END AS excerpt_start,
      CASE WHEN n_chars > 180 THEN 90::BIGINT ELSE n_chars END AS excerpt_length
    FROM documents JOIN l USING (lang)""",
)
def ingest_plan(spark, sf):
    items = fx.catalogue(spark, sf)
    classes = ranking.dense_labels(items.filter("class_name <> 'es'"), "class_name")
    return dataset.ingest_plan(items, classes)
