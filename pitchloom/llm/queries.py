"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, hard_negatives, hmm, langid, mixing, ngram_join, quality, repeats, spelling, toxicity, url_rules, vector_dedup, warc
from .staging import Stage, id_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


@query("op10_bpe_encoding")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = bpe.encode_texts(table(spark, sf, "documents", "doc_id", "text"), bpe.public_vocabulary())
    return docs.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def learning_rows(df: DataFrame, modulus: int, held_out: int):
    return F.pmod(F.crc32(F.encode(id_text("doc_id"), "utf-8")), F.lit(modulus)) != held_out


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    sample = langid.draw_sample(docs.filter(learning_rows(docs, 4, 2)))
    held_out = (~learning_rows(docs, 4, 2)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), sample).drop("text")


@query("op2_hidden_markov_score")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    held_out = ~learning_rows(docs, 10, 0)
    return hmm.score(docs.withColumn("held_out", held_out), ~held_out)


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = ngram_join.similar(table(spark, sf, "documents", "doc_id", "text"), n=3, percent=90)
    return docs.select(F.col("_key").alias("doc_id"), "n_shingles", "component_id")


@query("op4_source_mixing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = mixing.mix(table(spark, sf, "documents", "doc_id", "source", "text")).rows
    return docs.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT r, i, ws[i + 1 : i + 5] AS g FROM w, unnest(range(0, greatest(len(ws) - 4, 0))) AS u(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS v(k) WHERE c > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 50 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words
            OR 100 * n_upper > 50 * word_chars) AS kept
FROM m"""


@query("op9_quality_ledger", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        quality.rejects("v1").alias("base_failed"),
        (~quality.rejects()).alias("kept"),
    )


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = repeats.remove_repeats(table(spark, sf, "documents", "doc_id", "text"))
    return docs.select(
        F.col("_key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


URL_RULES = [
    url_rules.FixedRule("allow", "org"),
    url_rules.FixedRule("block", "example.org", "es/"),
    url_rules.FixedRule("block", "example.org", "en/1"),
    url_rules.FixedRule("allow", "com", "fr/"),
    url_rules.FixedRule("block", "com", "de/"),
]


@query("op8_url_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = url_rules.judge(table(spark, sf, "pages", "page_id", "url"), URL_RULES)
    return pages.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""


@query("op1_warc_bundles", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    stage = Stage(spark, "warc")
    records = warc.read(warc.write(table(spark, sf, "pages", "page_id", "url", "html"), stage))
    return records.select(
        warc.key_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"),
    )


@query("op5_vector_graph_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_dedup.link_vectors(table(spark, sf, "embeddings", "vec_id", "embedding"))
    return rows.select("vec_id", "n_links", "component_id", "kept")


@query("op11_toxicity")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    labels = table(spark, sf, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(learning_rows(labels, 3, 1)))
    rows = toxicity.score(docs, model).withColumn("held_out", ~learning_rows(docs, 3, 1))
    return rows.select("doc_id", "held_out", "score", "predicted")


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE k <= 3"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf, "documents", "doc_id", "text"), mislay=31)
    return spelling.variants(words)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
