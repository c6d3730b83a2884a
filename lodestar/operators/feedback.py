"""Relevance feedback, more-like-this and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.index import TF_CAP, Index, dictionary_of, frequencies, restricted, stats_of
from lodestar.operators.rankers import Ranker
from lodestar.operators.search import candidates, query_table, score, search, top
from lodestar.storage import checkpointed

#: Chosen documents up to which they reach the scan as a filter, so that no other text is tokenised.
LISTED = 10_000
ALPHABETIC = r"^\p{L}+$"


def _kl(p: Column, q: Column) -> Column:
    return p * F.log(p / q)


def divergent_terms(index: Index, chosen: DataFrame, n: int, by: str = "topic") -> DataFrame:
    """``topic, term, kl``: the ``n`` alphabetic terms of each topic's documents that most tell them from the collection.

    ``chosen`` has (topic, docid); its documents are read as one text. p is a term's share of that text, q its
    share of the collection; of equal values the smaller term comes first. Only the chosen documents are counted, and of
    the collection only their terms.
    """
    chosen = checkpointed(chosen)
    rows, n_of = (index.postings, F.sum("raw")) if index.exploded is None else (index.exploded, F.count("*"))
    ids = [r.docid for r in chosen.select("docid").distinct().limit(LISTED + 1).collect()]
    own = rows.filter(F.col("docid").isin(ids)) if len(ids) <= LISTED else rows.join(F.broadcast(chosen.select("docid").distinct()), "docid", "left_semi")
    counts = checkpointed(own.join(F.broadcast(chosen), "docid").groupBy(by, "term").agg(n_of.alias("n")))
    known = frequencies(index, counts.select("term").distinct())
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    words = counts.filter(F.col("term").rlike(ALPHABETIC)).join(total, by).join(known, "term", "left").crossJoin(F.broadcast(index.stats.select("l")))
    value = F.round(_kl(F.col("n") / F.col("total"), F.coalesce("cf", F.lit(1)) / F.col("l")), 9)
    w = Window.partitionBy(by).orderBy(F.desc("kl"), "term")
    return words.withColumn("kl", value).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(by, "term", "kl")


def blind_kl(index: Index, topics: dict[int, list[str]], ranker: Ranker, k: int = 20, documents: int = 17, terms: int = 5, second: Ranker | None = None) -> DataFrame:
    """Search, add the best terms of the top documents with their divergence as weight, and search again."""
    first = search(index, topics, ranker, documents).select("topic", "docid")
    extra = checkpointed(divergent_terms(index, first, terms))
    query = query_table(index, topics)
    sizes = query.select("topic", "qlen").distinct()
    more = extra.join(sizes, "topic").select("topic", "term", F.lit(1).cast("long").alias("times"), "qlen", F.lit(1.0).alias("prescalar"), F.col("kl").alias("postscalar"))
    both = query.unionByName(more)
    added = extra.groupBy("topic").agg(F.count("*").alias("added"))
    both = both.join(F.broadcast(added), "topic", "left").withColumn("qlen", F.col("qlen") + F.coalesce("added", F.lit(0))).drop("added")
    asked = [t for ts in topics.values() for t in ts] + [r.term for r in extra.select("term").distinct().collect()]
    return top(score(candidates(index, both, asked), second or ranker), k)


def relevance_model(index: Index, topics: dict[int, list[str]], k: int = 20, documents: int = 10, mu: float = 2500.0, lam: float = 0.5) -> DataFrame:
    """Weights of the query's own terms from the feedback documents, mixed with even weights by ``lam``.

    A document's weight is its query likelihood (Dirichlet-smoothed) as a share over the feedback documents; a
    term's weight is the sum of that times its smoothed share of the document.
    """
    from lodestar.operators.rankers import lmds

    ranker = lmds(mu)
    first = search(index, topics, ranker, documents)
    share = F.exp(F.col("rsv") - F.max("rsv").over(Window.partitionBy("topic")))
    likely = first.withColumn("e", share).withColumn("likely", F.col("e") / F.sum("e").over(Window.partitionBy("topic"))).select("topic", "docid", "likely")
    query = query_table(index, topics)
    terms = sorted({t for ts in topics.values() for t in ts})
    small = restricted(index, terms)
    own, known = small.postings, small.dictionary.select("term", "cf")
    pairs = F.broadcast(likely).join(query.select("topic", "term").distinct(), "topic").join(F.broadcast(known), "term")
    tf = pairs.join(own.select("docid", "term", "tf"), ["docid", "term"], "left").join(index.docs.select("docid", "dl"), "docid").crossJoin(F.broadcast(index.stats.select("l")))
    p = (F.coalesce("tf", F.lit(0)) + mu * F.col("cf") / F.col("l")) / (F.col("dl") + mu)
    weights = tf.groupBy("topic", "term").agg(F.sum(F.col("likely") * p).alias("w"))
    scaled = weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("topic"))).withColumn("even", 1 / F.count("*").over(Window.partitionBy("topic")))
    mixed = scaled.select("topic", "term", (lam * F.col("w") + (1 - lam) * F.col("even")).alias("mixed"))
    weighted = query.join(F.broadcast(mixed), ["topic", "term"], "left").withColumn("postscalar", F.coalesce("mixed", F.lit(0.0))).drop("mixed")
    return top(score(candidates(index, weighted, terms), ranker), k)


def more_like_this(index: Index, docids: list[int], n: int = 10) -> DataFrame:
    """``docid, term, kl``: the terms that best tell each document from the collection."""
    chosen = index.spark.createDataFrame([(d, d) for d in docids], "topic long, docid long")
    return divergent_terms(index, chosen, n).select(F.col("topic").alias("docid"), "term", "kl")


def rerank(index: Index, run: DataFrame, topics: dict[int, list[str]], ranker: Ranker, k: int) -> DataFrame:
    """Order the ``k`` best documents of each topic anew, with the statistics of those documents alone."""
    pool = run.filter(F.col("rank") <= k).select("topic", "docid")
    held = index.docs.select("docid", "dl").join(F.broadcast(pool), "docid")
    stats = held.groupBy("topic").agg(F.count("*").cast("double").alias("n"), F.sum("dl").cast("double").alias("l"), F.avg("dl").alias("adl"))
    terms = sorted({t for ts in topics.values() for t in ts})
    postings = restricted(index, terms).postings.join(F.broadcast(pool), "docid")
    known = postings.groupBy("topic", "term").agg(F.sum("raw").alias("cf"), F.count("*").alias("df"))
    matches = postings.join(F.broadcast(query_table(index, topics)), ["topic", "term"]).join(F.broadcast(known), ["topic", "term"]).join(F.broadcast(stats), "topic")
    return top(score(matches, ranker), k)


def one_document_index(index: Index, docids: DataFrame) -> Index:
    """An index of a set of documents only, with its own dictionary and statistics."""
    docs = index.docs.join(F.broadcast(docids), "docid", "left_semi")
    postings = index.postings.join(F.broadcast(docids), "docid", "left_semi").withColumn("tf", F.least("raw", F.lit(TF_CAP)))
    return Index(docs, postings, dictionary_of(postings), stats_of(docs))
