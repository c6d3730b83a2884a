"""Static per-document scores from fields of the documents, for use as sort keys.

Numbers keep their value (at least 1); strings are cleaned as sort keys are (lower case, leading and repeated
spaces dropped, characters outside the alphabet dropped) and give their dense rank. A document without the
field scores 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.storage import global_rank

#: Characters that a key of each kind keeps.
ALPHABETS = {"base32": "a-z ", "base36": "a-z0-9", "base37": "a-z0-9 ", "base40": "a-z0-9 .,'", "printable": " -~"}


def integer(value: Column) -> Column:
    return F.greatest(F.coalesce(value.cast("long"), F.lit(1)), F.lit(1))


def recent_date(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(1))


def leading_bytes(value: Column, n: int = 4) -> Column:
    """The first bytes as a big-endian number, left-aligned."""
    hexed = F.rpad(F.hex(F.substring(value.cast("binary"), 1, n)), 2 * n, "0")
    return F.coalesce(F.conv(hexed, 16, 10).cast("long"), F.lit(1))


def cleaned(value: Column, alphabet: str = "base37") -> Column:
    kept = F.regexp_replace(F.lower(value), f"[^{ALPHABETS[alphabet]}]", "")
    return F.ltrim(F.regexp_replace(kept, " +", " "))


def exact_string(docs: DataFrame, key: str, value: Column, alphabet: str = "base37") -> DataFrame:
    """``docid, pregen``: dense rank from 1 of the cleaned value; distinct values are ranked by ranges, never in one task."""
    rows = docs.select(F.col(key).alias("docid"), F.coalesce(cleaned(value, alphabet), F.lit("")).alias("_v"))
    ranked = global_rank(rows.select("_v").distinct(), [F.col("_v").asc()], "pregen")
    return rows.join(ranked, "_v").select("docid", F.col("pregen").cast("long").alias("pregen"))


def exact_integer(docs: DataFrame, key: str, value: Column) -> DataFrame:
    """``docid, pregen``: place from 1 in ascending order of (value, docid)."""
    rows = docs.select(F.col(key).alias("docid"), integer(value).alias("_v"))
    return global_rank(rows, [F.col("_v").asc(), F.col("docid").asc()], "pregen").select("docid", F.col("pregen").cast("long").alias("pregen"))


def from_ranks(ranks: DataFrame, names: DataFrame) -> DataFrame:
    """``docid, pregen`` from a table of (name, rank), joined by name; unranked documents score 1."""
    return names.join(ranks, "name", "left").select("docid", F.coalesce("rank", F.lit(1.0)).alias("pregen"))


def ordering_check(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: neighbours in the base order that the other key puts in the wrong order, and that it can't tell apart."""
    both = base.select("docid", F.col("pregen").alias("a")).join(other.select("docid", F.col("pregen").alias("b")), "docid")
    ranked = global_rank(both, [F.col("a").asc(), F.col("b").asc(), F.col("docid").asc()], "place")
    before = ranked.select((F.col("place") + 1).alias("place"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    pairs = ranked.join(before, "place")
    return pairs.agg(F.sum((F.col("a") > F.col("a0")).cast("long") * (F.col("b") < F.col("b0")).cast("long")).alias("misordered"), F.sum((F.col("a") > F.col("a0")).cast("long") * (F.col("b") == F.col("b0")).cast("long")).alias("conflated"))
