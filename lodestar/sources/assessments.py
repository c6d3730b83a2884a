"""Readers of relevance assessments: ``topic, subtopic, docid, rel, rel_chars, doc_length``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, F.Column]:
    return spark.read.text(path).filter(F.trim("value") != ""), F.split(F.trim("value"), r"\s+")


def _shaped(rows: DataFrame, topic, subtopic, docid, rel, chars, length) -> DataFrame:
    return rows.select(topic.cast("long").alias("topic"), subtopic.alias("subtopic"), docid.alias("docid"), rel.alias("rel"), chars.alias("rel_chars"), length.alias("doc_length"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``topic docid`` lines: relevant documents."""
    rows, p = _parts(spark, path)
    return _shaped(rows, p[0], F.lit("0"), p[1], F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long"))


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """``topic subtopic docno relevance`` lines."""
    rows, p = _parts(spark, path)
    return _shaped(rows, p[0], p[1], p[2], p[3].cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"))


def read_inex(spark: SparkSession, path: str) -> DataFrame:
    """``topic Q0 docid relevant-characters length ...`` lines."""
    rows, p = _parts(spark, path)
    return _shaped(rows, p[0], F.lit("0"), p[2], (p[3].cast("long") > 0).cast("int"), p[3].cast("long"), F.try_element_at(p, F.lit(5)).cast("long"))
