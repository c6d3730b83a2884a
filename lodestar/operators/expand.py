"""Term expansion: conflation of a query term with related vocabulary into one postings list, or extra query terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stem import STEMMERS, stem
from lodestar.operators.index import TF_CAP, Index, dictionary_of, restricted_to, vocabulary
from lodestar.operators.rankers import Ranker
from lodestar.operators.search import query_table, score, top
from lodestar.storage import checkpointed

RELATIONSHIPS = ("synonym", "antonym", "holonym", "meronym", "hypernym", "hyponym")
#: Variants of the query's terms up to which they are broadcast; beyond that the join is a shuffle.
BROADCAST_VARIANTS = 100_000


def variants_by_stem(index: Index, terms: list[str], stemmer: str) -> DataFrame:
    """``qterm, term``: vocabulary with the stem of a query term and its first characters; numbers and tags stand alone.

    Terms that can't match by their first characters go before they are stemmed. A stem that could be null would be asked
    for below the distinct terms, and every token be stemmed.
    """
    asked = index.spark.createDataFrame([(t,) for t in sorted(set(terms))], "qterm string")
    asked = asked.withColumn("stem", stem(F.col("qterm"), stemmer))
    n = STEMMERS[stemmer].prefix
    stems = [r.stem for r in asked.select("stem").distinct().collect()]
    likely = F.substring("term", 1, n).isin([s[:n] for s in stems]) | F.col("term").isin(sorted(set(terms)))
    known = vocabulary(index)
    if not any(re.match("[A-Z0-9]", s) for s in stems):
        known = known.filter(likely)
    known = known.withColumn("stem", F.coalesce(stem(F.col("term"), stemmer), F.lit("")))
    both = known.join(F.broadcast(asked), "stem")
    return both.filter((F.substring("term", 1, n) == F.substring("stem", 1, n)) | (F.col("term") == F.col("qterm")) | F.col("stem").rlike("^[A-Z0-9]")).select("qterm", "term")


def variants_by_thesaurus(index: Index, terms: list[str], thesaurus: DataFrame, relationships: tuple[str, ...] = ("synonym",)) -> DataFrame:
    """``qterm, term``: the query term itself and the terms it is related to."""
    asked = index.spark.createDataFrame([(t,) for t in sorted(set(terms))], "qterm string")
    related = thesaurus.filter(F.col("relationship").isin(*relationships)).join(F.broadcast(asked), F.col("term") == F.col("qterm")).select("qterm", F.col("related").alias("term"))
    return asked.select("qterm", F.col("qterm").alias("term")).unionByName(related).distinct()


def conflated(index: Index, variants: DataFrame, weight: str | None = None) -> Index:
    """An index whose terms are the query terms: counts of all variants added in each document, capped, with their own df and cf.

    ``weight`` names a column of ``variants`` that multiplies counts (rounded down, at least 1).
    """
    variants = checkpointed(variants)
    few = variants.count() <= BROADCAST_VARIANTS
    held = restricted_to(index, variants.select("term").distinct()).postings if few else index.postings
    raw = F.col("raw") if weight is None else F.greatest(F.floor(F.col("raw") * F.col(weight)), F.lit(1))
    merged = held.join(F.broadcast(variants) if few else variants, "term").groupBy(F.col("qterm").alias("term"), "docid", "dl").agg(F.sum(raw).alias("raw"))
    postings = merged.withColumn("tf", F.least("raw", F.lit(TF_CAP)))
    return Index(index.docs, postings, dictionary_of(postings), index.stats)


def search_conflated(index: Index, topics: dict[int, list[str]], variants: DataFrame, ranker: Ranker, k: int = 20, weight: str | None = None) -> DataFrame:
    """A run in which each query term stands for all of its variants."""
    own = conflated(index, variants, weight)
    matches = own.postings.join(F.broadcast(query_table(index, topics)), "term").join(F.broadcast(own.dictionary.select("term", "cf", "df")), "term").crossJoin(F.broadcast(index.stats))
    return top(score(matches, ranker), k)


def thesaurus_terms(topics: dict[int, list[str]], thesaurus: list[tuple[str, str, str]], relationships: tuple[str, ...] = ("synonym",)) -> dict[int, list[str]]:
    """Every topic with the terms related to its own added after them."""
    related: dict[str, list[str]] = {}
    for term, kind, other in thesaurus:
        if kind in relationships:
            related.setdefault(term, []).append(other)
    return {topic: [x for t in terms for x in (t, *related.get(t, []))] for topic, terms in topics.items()}


def term_similarity(index: Index, pairs: DataFrame) -> DataFrame:
    """``qterm, term, similarity``: cosine of the terms' tf.idf vectors over documents.

    Both vectors of a pair meet on docid by a join of postings; no pair of documents is formed. Only the pairs' own terms are
    counted.
    """
    pairs = checkpointed(pairs)
    small = restricted_to(index, pairs.select("term").unionByName(pairs.select(F.col("qterm").alias("term"))).distinct())
    weighed = small.postings.join(F.broadcast(small.dictionary.select("term", "df")), "term").crossJoin(F.broadcast(index.stats.select("n"))).select("term", "docid", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w"))
    named = F.broadcast(pairs.select("qterm", "term"))
    own = weighed.join(named, "term").select("qterm", "term", "docid", F.col("w").alias("b"))
    query = weighed.withColumnRenamed("term", "qterm").join(F.broadcast(pairs.select("qterm").distinct()), "qterm").select("qterm", "docid", F.col("w").alias("a"))
    dot = own.join(query, ["qterm", "docid"]).groupBy("qterm", "term").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    left = query.groupBy("qterm").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("qnorm"))
    right = own.groupBy("qterm", "term").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("norm"))
    out = right.join(left, "qterm").join(dot, ["qterm", "term"], "left")
    return out.select("qterm", "term", F.round(F.coalesce(F.col("dot") / (F.col("norm") * F.col("qnorm")), F.lit(0.0)), 6).alias("similarity"))


def similar_variants(index: Index, terms: list[str], stemmer: str, threshold: float) -> DataFrame:
    """Variants by stem that are at least so similar to the query term, with their similarity."""
    found = variants_by_stem(index, terms, stemmer)
    near = term_similarity(index, found).filter(F.col("similarity") >= threshold)
    return near.select("qterm", "term", "similarity")
