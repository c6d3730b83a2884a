"""Inverted index as DataFrames: postings, dictionary, document lengths and collection statistics.

Everything is one declarative plan over the documents. A document's postings are counted in its own row, without a
shuffle. A filter on terms is put on the exploded tokens, so a query counts and shuffles only its own terms. For repeated
use, :func:`write_index` stores the tables bucketed and sorted by term, and :func:`load_index` reads them back without any
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text as T
from lodestar.functions.stem import STEMMERS, stem

TF_CAP = 255


@dataclass(frozen=True)
class Index:
    """``docs``: docid, dl, tokens; ``postings``: term, docid, dl, raw, tf; ``dictionary``: term, cf, df, max_tf; ``stats``: n, l, adl (one row).

    ``exploded``: docid, dl, term of every token, where postings and dictionary are those tokens counted; ``sized``: these
    postings with uniq, the number of their document's terms.
    """

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    exploded: DataFrame | None = None
    sized: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, numbers: bool = True, words: Column | None = None) -> DataFrame:
    """``docid, tokens, dl`` of the documents that hold a token; empty and null texts and null ids are dropped.

    The filter asks the text for a first letter or number: on ``dl`` it would have every text tokenised once more.
    """
    if words is None:
        held = docs.filter(F.col(text_col).rlike(T.FIRST[numbers]) & F.col(id_col).isNotNull())
        return held.select(F.col(id_col).alias("docid"), T.tokens(F.col(text_col), numbers).alias("tokens")).withColumn("dl", F.size("tokens"))
    return docs.select(F.col(id_col).alias("docid"), words.alias("tokens")).withColumn("dl", F.size("tokens")).filter("dl > 0 and docid is not null")


def _counted(rows: DataFrame) -> DataFrame:
    """``docid, dl, uniq, term, raw`` of rows (docid, dl, tokens), each counted on its own: equal tokens are runs of the sorted array.

    No row is without tokens. Here and in :func:`build_index` the outer generator is used as Spark gives the other a filter
    on the array's size, which has every text tokenised once more.
    """
    ordered = rows.select("docid", "dl", F.sort_array("tokens").alias("_s")).withColumn("_n", F.size("_s"))
    ends = ordered.withColumn("_e", F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: (i == F.col("_n")) | (F.get("_s", i - 1) != F.get("_s", i))))
    run = lambda e, i: F.struct(F.get("_s", e - 1).alias("term"), (e - F.coalesce(F.get("_e", i - 1), F.lit(0))).cast("long").alias("raw"))
    return ends.select("docid", "dl", F.size("_e").alias("uniq"), F.inline_outer(F.transform("_e", run)))


def _capped(counted: DataFrame) -> DataFrame:
    return counted.select("term", "docid", "dl", "raw", F.least("raw", F.lit(TF_CAP)).alias("tf"))


def _postings(exploded: DataFrame) -> DataFrame:
    return _capped(exploded.groupBy("term", "docid", "dl").agg(F.count("*").alias("raw")))


def _repeated(ids: DataFrame) -> bool:
    """Whether an id comes twice."""
    return not ids.filter("docid is not null").groupBy("docid").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()


def dictionary_of(postings: DataFrame) -> DataFrame:
    """Collection frequency from uncapped counts, document frequency and largest count of each term."""
    return postings.groupBy("term").agg(F.sum("raw").alias("cf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


def stats_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").cast("double").alias("n"), F.sum("dl").cast("double").alias("l"), F.avg("dl").alias("adl"))


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    numbers: bool = True,
    stemmer: str = "none",
    stop: DataFrame | None = None,
    tags: Column | None = None,
) -> Index:
    """Index of a table of documents.

    ``numbers=False`` neither indexes nor counts numbers. Terms of ``stop`` are not indexed but still count in
    a document's length. ``tags`` (an array of tag names) are indexed in upper case and not counted.
    """
    rows = tokenise(docs, id_col, text_col, numbers=numbers)
    held = rows.select("docid", "dl", "tokens")
    plain = STEMMERS[stemmer].expression
    if stemmer != "none" and plain:
        held = held.withColumn("tokens", F.transform("tokens", lambda t: stem(t, stemmer)))
    exploded = held.select("docid", "dl", F.explode_outer("tokens").alias("term"))
    repeated = _repeated(docs.select(F.col(id_col).alias("docid")))
    if repeated:  # rows of equal docid and length are one document
        held = held.groupBy("docid", "dl").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    counted = _counted(held)
    sized = None if repeated or stop is not None or tags is not None or not plain else counted.withColumn("tf", F.least("raw", F.lit(TF_CAP)))
    if stop is not None:
        exploded, counted = (x.join(stop.select("term"), "term", "left_anti") for x in (exploded, counted))
    if not plain:
        counted = counted.withColumn("term", stem(F.col("term"), stemmer)).groupBy("term", "docid", "dl").agg(F.sum("raw").alias("raw"))
    if tags is not None:
        named = docs.select(F.col(id_col).alias("docid"), F.explode(tags).alias("term")).join(rows.select("docid", "dl"), "docid").select("docid", "dl", "term")
        exploded = exploded.unionByName(named)
        both = counted.select("docid", "dl", "term", "raw").unionByName(named.withColumn("raw", F.lit(1).cast("long")))
        counted = both.groupBy("term", "docid", "dl").agg(F.sum("raw").alias("raw"))
    postings = _capped(counted)
    return Index(rows, postings, dictionary_of(postings), stats_of(rows), exploded if plain else None, sized)


def restricted(index: Index, terms: list[str]) -> Index:
    """The index with the postings and dictionary entries of ``terms`` only; statistics stay those of the collection."""
    return _kept(index, lambda rows: rows.filter(F.col("term").isin(sorted(set(terms))) if terms else F.lit(False)))


def restricted_to(index: Index, terms: DataFrame) -> Index:
    """The same for a table of distinct terms, small enough to be broadcast."""
    return _kept(index, lambda rows: rows.join(F.broadcast(terms.select("term")), "term", "left_semi"))


def _kept(index: Index, keep: Callable[[DataFrame], DataFrame]) -> Index:
    if index.exploded is None:
        return replace(index, postings=keep(index.postings), dictionary=keep(index.dictionary), sized=None)
    exploded = keep(index.exploded)
    postings = _postings(exploded)
    return replace(index, postings=postings, dictionary=dictionary_of(postings), exploded=exploded, sized=None)


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """``term, cf`` of a table of distinct terms, small enough to be broadcast; tokens are counted without their documents."""
    named = F.broadcast(terms.select("term"))
    if index.exploded is None:
        return index.dictionary.join(named, "term", "left_semi").select("term", "cf")
    return index.exploded.join(named, "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf"))


def vocabulary(index: Index) -> DataFrame:
    """``term``: the distinct terms."""
    return index.dictionary.select("term") if index.exploded is None else index.exploded.select("term").distinct()


def looked_up(index: Index, postings: DataFrame | None = None) -> DataFrame:
    """All postings with their terms' cf and df (``postings``: those of the index with more columns).

    Where the dictionary is that of the postings, they are dealt by term once and counted where they arrive.
    """
    postings = index.postings if postings is None else postings
    if index.exploded is None:
        return postings.join(index.dictionary.select("term", "cf", "df"), "term")
    w = Window.partitionBy("term")
    counted = postings.drop("tf").withColumns({"cf": F.sum("raw").over(w), "df": F.count("*").over(w)})
    return counted.withColumn("tf", F.least("raw", F.lit(TF_CAP)))


def write_index(index: Index, name: str, buckets: int = 64) -> None:
    """Store the tables under ``name``; postings are bucketed and sorted by term, which makes joins on terms local.

    A bucket is written by several tasks where there are more shuffle partitions than buckets, so that each can sort its
    part in memory. A dictionary that is the postings' own is counted from what was stored, without another shuffle.
    """
    spark = index.spark
    parts = buckets * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    index.postings.repartition(parts, "term").write.bucketBy(buckets, "term").sortBy("term", "docid").mode("overwrite").saveAsTable(f"{name}_postings")
    known = index.dictionary.repartition(buckets, "term") if index.exploded is None else dictionary_of(spark.table(f"{name}_postings"))
    known.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(f"{name}_dictionary")
    index.docs.select("docid", "dl", "tokens").write.mode("overwrite").saveAsTable(f"{name}_docs")
    (stats_of(spark.table(f"{name}_docs")) if index.exploded is not None else index.stats).write.mode("overwrite").saveAsTable(f"{name}_stats")


def load_index(spark: SparkSession, name: str) -> Index:
    return Index(*(spark.table(f"{name}_{t}") for t in ("docs", "postings", "dictionary", "stats")))


def describe(index: Index) -> DataFrame:
    """One row: documents, terms, distinct terms, longest document and mean length."""
    sizes = index.docs.agg(F.count("*").alias("documents"), F.sum("dl").cast("long").alias("terms"), F.max("dl").cast("long").alias("longest"), F.round(F.avg("dl"), 6).alias("mean_length"))
    return sizes.crossJoin(F.broadcast(index.dictionary.agg(F.count("*").alias("unique_terms"))))


def dictionary_range(index: Index, low: str, high: str) -> DataFrame:
    """Dictionary entries from ``low`` up to but not including ``high``."""
    return index.dictionary.filter((F.col("term") >= low) & (F.col("term") < high)).select("term", "cf", "df")


def list_terms(index: Index, after: str, n: int) -> DataFrame:
    """The next ``n`` terms from ``after`` on, in order."""
    return index.dictionary.filter(F.col("term") >= after).orderBy("term").limit(n).select("term", "cf", "df")


def zipf(index: Index, n: int) -> DataFrame:
    """The ``n`` most frequent terms with rank, and rank times frequency over the collection's length."""
    top = index.dictionary.orderBy(F.desc("cf"), "term").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "term")).cast("long"))
    return ranked.crossJoin(F.broadcast(index.stats)).select("rank", "term", "cf", F.round(F.col("rank") * F.col("cf") / F.col("l"), 6).alias("zipf"))
