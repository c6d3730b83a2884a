"""Streams of documents: index maintenance by merging, and standing queries.

Beyond what a batch engine needs: each micro-batch is indexed on its own and appended, which is the merge
operator; the dictionary and the statistics are aggregates over the appended tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions import text as T
from lodestar.operators.index import Index, build_index, dictionary_of, stats_of


def ingest(stream: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Append the postings and lengths of a stream's documents under ``folder``.

    A micro-batch writes into folders named by its id, so that one that is run again overwrites what it wrote.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        part = build_index(batch, id_col, text_col)
        part.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
        part.docs.select("docid", "dl").write.mode("overwrite").parquet(f"{folder}/docs/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark, folder: str) -> Index:
    """The index of everything appended so far."""
    postings = spark.read.parquet(f"{folder}/postings").drop("batch")
    docs = spark.read.parquet(f"{folder}/docs").drop("batch")
    return Index(docs, postings, dictionary_of(postings), stats_of(docs))


def standing_queries(stream: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``topic, docid, matched`` for each arriving document that holds all terms of a standing query.

    ``queries`` has (topic, term); it is the static side. Counting runs inside the document's own row, so no
    state is kept.
    """
    grouped = queries.groupBy("topic").agg(F.collect_set("term").alias("terms"))
    docs = stream.select(F.col(id_col).alias("docid"), F.array_distinct(T.tokens(F.col(text_col))).alias("ws"))
    keyed = docs.select("docid", "ws", F.explode("ws").alias("word"))
    first = grouped.withColumn("word", F.array_min("terms"))
    hit = keyed.join(first, "word").filter(F.size(F.array_except("terms", "ws")) == 0)
    return hit.select("topic", "docid", F.size("terms").alias("matched"))


def windowed_terms(stream: DataFrame, time_col: str, text_col: str, window: str, late: str) -> DataFrame:
    """``window, term, n``: term counts of event-time windows, with late documents up to the watermark."""
    words = stream.withWatermark(time_col, late).select(F.window(time_col, window).alias("window"), F.explode(T.tokens(F.col(text_col))).alias("term"))
    return words.groupBy("window", "term").agg(F.count("*").alias("n"))
