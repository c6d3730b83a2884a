"""Index maintenance: pruning, culling, quantisation, merging and sharding, as transforms of the tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.index import TF_CAP, Index, dictionary_of, looked_up, restricted, stats_of
from lodestar.operators.rankers import Ranker, finite


def with_postings(index: Index, postings: DataFrame) -> Index:
    return replace(index, postings=postings, dictionary=dictionary_of(postings), exploded=None, sized=None)


def static_prune(index: Index, k: int) -> DataFrame:
    """The first ``k`` postings of every term by descending count; equal counts in order of docid.

    A rank filter on the window keeps ``k`` rows of a term in every task before the shuffle, so frequent terms
    aren't gathered whole.
    """
    w = Window.partitionBy("term").orderBy(F.desc("tf"), "docid")
    return index.postings.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def quantum_prune(index: Index, k: int) -> DataFrame:
    """Whole groups of equal counts until ``k`` postings are reached."""
    w = Window.partitionBy("term").orderBy(F.desc("tf"))
    return index.postings.withColumn("_place", F.rank().over(w)).filter(F.col("_place") <= k).drop("_place")


def cull_singletons(index: Index) -> DataFrame:
    """Dictionary without terms that occur once in the collection."""
    return index.dictionary.filter("cf > 1")


def cull_rare(index: Index, n: int) -> DataFrame:
    """Dictionary without terms of at most ``n`` documents."""
    return index.dictionary.filter(F.col("df") > n)


def cull_frequent(index: Index, share: float) -> DataFrame:
    """Dictionary without terms of at least this share of the documents."""
    return index.dictionary.crossJoin(F.broadcast(index.stats.select("n"))).filter(F.col("df") / F.col("n") < share).drop("n")


def cull_stopped(index: Index, stop: DataFrame) -> DataFrame:
    return index.dictionary.join(stop.select("term"), "term", "left_anti")


def keep_listed(index: Index, terms: DataFrame) -> DataFrame:
    return index.dictionary.join(terms.select("term"), "term", "left_semi")


def culled(index: Index, dictionary: DataFrame) -> Index:
    """The index with the postings of a culled dictionary; document lengths stay as they are."""
    return replace(index, postings=index.postings.join(dictionary.select("term"), "term", "left_semi"), dictionary=dictionary, exploded=None, sized=None)


def impacts(index: Index, ranker: Ranker, bits: int | None = 8, terms: list[str] | None = None) -> DataFrame:
    """``term, docid, dl, rsv, impact``: every posting's score as an integer from 1 to 2^bits - 1.

    The smallest and largest score come from one global aggregate. Without ``bits`` their number follows the
    collection: 5.4 + 5.4e-4 times the square root of the number of documents. With ``terms``, the rows of those only, on
    the scale of all.
    """
    if not ranker.quantable:
        raise ValueError(f"{ranker.name} can't be stored as impacts")
    score = lambda of: looked_up(of).crossJoin(F.broadcast(index.stats)).withColumn("qlen", F.lit(1.0)).select("term", "docid", "dl", finite(ranker.term()).alias("rsv"))
    scored = score(index)
    ends = scored.agg(F.min("rsv").alias("low"), F.max("rsv").alias("high"))
    if bits is None:
        ends = ends.crossJoin(index.stats.select(F.floor(5.4 + 5.4e-4 * F.sqrt("n")).alias("bits")))
    else:
        ends = ends.withColumn("bits", F.lit(bits))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    scaled = (F.col("rsv") - F.col("low")) / span * (F.pow(F.lit(2.0), F.col("bits")) - 2) + 1
    shown = scored if terms is None else score(restricted(index, terms))
    return shown.crossJoin(F.broadcast(ends)).select("term", "docid", "dl", "rsv", scaled.cast("long").alias("impact"))


def quantised(index: Index, ranker: Ranker, bits: int | None = 8, terms: list[str] | None = None) -> Index:
    """An index whose counts are impacts, for the impact ranker; of ``terms`` only, if they are known before."""
    rows = impacts(index, ranker, bits, terms)
    postings = rows.select("term", "docid", "dl", F.col("impact").alias("raw"), F.col("impact").alias("tf"))
    known = index.dictionary if terms is None else restricted(index, terms).dictionary
    return replace(index, postings=postings, dictionary=known, exploded=None, sized=None)


def impact_ordered(index: Index, partitions: int) -> DataFrame:
    """Postings laid out by term, then descending count, then docid."""
    return index.postings.repartition(partitions, "term").sortWithinPartitions("term", F.desc("tf"), "docid")


def merge(indexes: list[Index]) -> Index:
    """Union of indexes over different documents, with counts added up."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    docs, postings = union([i.docs for i in indexes]), union([i.postings for i in indexes])
    known = union([i.dictionary for i in indexes]).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))
    return Index(docs, postings, known, stats_of(docs))


def shifted(index: Index, offset: int) -> Index:
    """The index with docids moved up, for merging collections that number their documents alike."""
    move = lambda df: df.withColumn("docid", F.col("docid") + offset)
    return replace(index, docs=move(index.docs), postings=move(index.postings), exploded=index.exploded and move(index.exploded), sized=index.sized and move(index.sized))


def shards(index: Index, n: int) -> list[Index]:
    """Parts by docid, each with its own dictionary and statistics."""
    out = []
    for k in range(n):
        own = F.pmod(F.col("docid"), F.lit(n)) == k
        docs, postings = index.docs.filter(own), index.postings.filter(own)
        out.append(Index(docs, postings, dictionary_of(postings), stats_of(docs)))
    return out


def capped(raw: str = "raw"):
    return F.least(raw, F.lit(TF_CAP))
