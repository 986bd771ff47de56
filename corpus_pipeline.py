"""A training corpus in five stages, each of which works on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each result as Parquet to the folder the
cluster shares and reads it again as the next one's ``docs``.

The stages learn and compare on their whole input. They handle null ids and texts,
repeated rows, empty tables and further columns; each docstring says how.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.llm import bpe, langid, mixing, ngram_join, repeats
from pitchloom.llm.staging import Stage, tidy_driver, with_row_key

ROW = "_row"


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns out of the way of those a stage makes, and how to get them back."""
    renamed = {c: f"_docs_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in docs.columns]


def _keyed(spark: SparkSession, docs: DataFrame, name: str, *made: str) -> tuple[DataFrame, list[Column]]:
    """:func:`_aside` with a key per row, written so that the key stays."""
    rows, columns = _aside(docs, ROW, *made)
    return Stage(spark, name).keep(with_row_key(rows, ROW), "rows"), columns


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised.

    Rejected are null texts and texts without a letter (``und``), and all documents if
    none has a label to learn from. ``lang`` is left as it is.
    """
    tidy_driver(spark)
    sample = langid.draw_sample(docs)
    rows, columns = _aside(docs, "lang_pred", "score")
    return langid.identify(rows, sample).filter(F.col("lang_pred") != langid.UNKNOWN).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of similar texts connect.

    Sets of five-word n-grams with a Jaccard similarity of 0.8 or more link. The row
    with the smallest id stays (null last), of rows with that id the first one read.
    Groups that hold the same ids, or none, are still groups of their own. Texts without
    words link with nothing and stay.
    """
    tidy_driver(spark)
    rows, columns = _keyed(spark, docs, "near")
    stage = Stage(spark, "ngrams")
    found = ngram_join.similar(rows, stage=stage)
    # Without words each row is a group of its own.
    alone = F.when(F.col("_group").isNull(), F.col(ROW))
    first = found.groupBy("_group", alone.alias("alone")).agg(
        F.min(F.struct(F.col("_key").isNull(), "_key", ROW)).alias("kept")
    )
    # Once it is known which rows stay, the tables that told are not needed.
    kept = Stage(spark, "near").keep(first.select(F.col(f"kept.{ROW}").alias(ROW)), "kept")
    stage.drop()
    return rows.join(kept, ROW).select(*columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte under a 100-byte string that occurs earlier.

    ``n_chars`` follows the text. A document of which nothing is left goes; one that
    was empty or null before stays as it was. Parts of characters at a cut are dropped.
    """
    tidy_driver(spark)
    rows, columns = _keyed(spark, docs, "passages", "n_removed", "n_bytes", "kept", "_had_text")
    cut = repeats.remove_repeats(rows).select(ROW, "n_removed", "n_bytes", "kept")
    # Texts come back from the operator, so those of ``rows`` need not meet them.
    rest = rows.withColumn("_had_text", F.col("text").isNotNull()).drop("text")
    out = rest.join(cut.filter("n_removed = 0 OR n_removed < n_bytes"), ROW)
    out = out.withColumn("text", F.when(F.col("_had_text"), _decoded(F.col("kept"))))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def _decoded(kept: Column) -> Column:
    """UTF-8 bytes as text without the halves of characters that a cut left."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in column.to_pylist()], pa.string())

    return decode(kept)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents as the mix of their sources takes them.

    A document is there as often as the mix takes its words, to the nearest whole
    number: 0 to 3 times. Documents without words stay once.
    """
    tidy_driver(spark)
    rows, columns = _aside(docs, "size", "source_size", "target", "taken", "times", ROW)
    mixed = mixing.mix(rows).rows
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    return (
        mixed.withColumn("times", times)
        .filter("times > 0")
        .withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*columns)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests that show that they decode as they should."""
    tidy_driver(spark)
    rows = bpe.encode_texts(docs, bpe.public_vocabulary())
    return rows.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("bpe", encoded),
]

#: The stages on n-grams, suffixes and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.keep(step(spark, docs, sf_dir), name)
    return docs
