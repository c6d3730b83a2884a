"""Filters over documents, by lists of ids and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")


def include(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return docs.join(ids.select(key), key, "left_semi")


def without_spam(docs: DataFrame, scores: DataFrame, key: str, threshold: int = 70) -> DataFrame:
    """Documents at or over the threshold percentile; one without a score is kept only for thresholds under 50."""
    if threshold >= 50:
        return include(docs, scores.filter(F.col("score") >= threshold), key)
    return exclude(docs, scores.filter(F.col("score") < threshold), key)


def read_spam(spark, path: str, key: str = "name") -> DataFrame:
    """``score id`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[1].alias(key), parts[0].cast("int").alias("score"))


def textual(docs: DataFrame, body: str = "body") -> DataFrame:
    """Documents whose Content-Type header is missing or begins with text."""
    kind = F.lower(F.regexp_extract(F.col(body), r"(?im)^Content-Type:\s*(\S*)", 1))
    return docs.filter((kind == "") | kind.startswith("text"))
