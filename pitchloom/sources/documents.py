"""JSON inputs: class mapping, class list, catalogue, knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "map<string,array<struct<id:string,duration:bigint,title:string>>>"
KNOWLEDGE = "map<string,struct<arohanam:string,avarohanam:string,similar:array<string>>>"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``value``, one row per file."""
    return spark.read.text(path, wholetext=True)


def parse_class_mapping(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("class_id", "class_name"))


def parse_class_list(docs: DataFrame) -> DataFrame:
    """``label, class_name``: the position in the list is the label."""
    return docs.select(F.posexplode(F.from_json("value", "array<string>")).alias("label", "class_name"))


def parse_catalogue(docs: DataFrame) -> DataFrame:
    """``class_name, id, duration_s, title``."""
    return docs.select(F.explode(F.from_json("value", CATALOGUE)).alias("class_name", "_items")).select(
        "class_name", F.inline("_items").alias("id", "duration_s", "title")
    )


def parse_knowledge(docs: DataFrame) -> DataFrame:
    """``class_name, ascending, descending, similar`` with scales as token arrays."""
    rows = docs.select(F.explode(F.from_json("value", KNOWLEDGE)).alias("class_name", "k"))
    return rows.select(
        "class_name",
        F.split("k.arohanam", " ").alias("ascending"),
        F.split("k.avarohanam", " ").alias("descending"),
        F.col("k.similar").alias("similar"),
    )


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    return parse_class_mapping(read_document(spark, path))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_class_list(read_document(spark, path))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalogue(read_document(spark, path))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return parse_knowledge(read_document(spark, path))
