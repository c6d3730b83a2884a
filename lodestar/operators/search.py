"""Ranked retrieval of many topics in one plan, and its shapes of results."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestar.functions.text import WORD_OR_NUMBER
from lodestar.operators.index import Index, restricted
from lodestar.operators.rankers import Ranker, finite

#: Query terms up to which a query table is inlined and broadcast; it comes from the driver and is counted there.
MAX_TERMS = 1024
#: Rows (topic, term) of a table of topics up to which the driver takes them, and scores that a task keeps at once.
MAX_TABLE = 200_000
SCORES_AT_ONCE = 1_000_000
SCALE = 6
_QUERY = "topic long, term string, times long, qlen long, prescalar double, postscalar double"


def query_rows(topics: dict[int, list[str]], weights: dict[tuple[int, str], float] | None = None) -> list[tuple]:
    """(topic, term, times, qlen, prescalar, postscalar); a repeated term is scored as often as it is asked for."""
    out = []
    for topic, terms in topics.items():
        for term, times in Counter(terms).items():
            out.append((topic, term, times, len(terms), 1.0, (weights or {}).get((topic, term), 1.0)))
    if len(out) > MAX_TERMS * max(1, len(topics)):
        raise ValueError("too many query terms")
    return out


def query_table(index: Index, topics: dict[int, list[str]], weights: dict[tuple[int, str], float] | None = None) -> DataFrame:
    return index.spark.createDataFrame(query_rows(topics, weights), _QUERY)


def candidates(index: Index, query: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """A row for each match of a query term in a document, with the statistics that rankers use.

    With ``terms`` known to the driver, they reach the scan as a filter and the query is broadcast; a query
    that is itself a large table is joined by term.
    """
    small = restricted(index, terms) if terms is not None else index
    asked = F.broadcast(query) if terms is not None else query
    found = small.postings.join(asked, "term")
    known = small.dictionary.select("term", "cf", "df")
    matched = found.join(F.broadcast(known) if terms is not None else known, "term")
    return matched.crossJoin(F.broadcast(index.stats))


def score(matches: DataFrame, ranker: Ranker, carry: tuple[str, ...] = ()) -> DataFrame:
    """``topic, docid, rsv, terms`` of all matching documents."""
    with_tf = matches.withColumn("tf", F.col("tf") * F.col("prescalar"))
    own = with_tf.withColumn("_s", finite(ranker.term()) * F.col("postscalar") * F.col("times")).withColumn("_m", F.col("times"))
    keys = ["topic", "docid", "dl", "qlen", "n", "l", "adl", *carry, *(x for x in ranker.needs if x not in ("k1", "gain") and x in matches.columns)]
    summed = own.groupBy(*dict.fromkeys(keys)).agg(F.sum("_s").alias("_s"), F.sum("_m").alias("terms"))
    total = F.col("_s") + finite(ranker.doc()) if ranker.doc else F.col("_s")
    return summed.select("topic", "docid", F.round(total, SCALE).alias("rsv"), "terms", "qlen", *carry)


def top(scored: DataFrame, k: int, first_docid_last: bool = True) -> DataFrame:
    """The ``k`` best of each topic; of equal scores, the higher docid comes first (or the lower, as brokers have it).

    The rank filter on the window lets every task keep ``k`` rows for a topic before the shuffle.
    """
    tie = F.desc("docid") if first_docid_last else F.asc("docid")
    w = Window.partitionBy("topic").orderBy(F.desc("rsv"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("topic", F.col("rank").cast("long").alias("rank"), "docid", "rsv")


def search(index: Index, topics: dict[int, list[str]], ranker: Ranker, k: int = 20, weights: dict[tuple[int, str], float] | None = None, doc_values: DataFrame | None = None, term_values: DataFrame | None = None, all_terms: bool = False) -> DataFrame:
    """``topic, rank, docid, rsv``: a run over all topics.

    ``doc_values`` (docid and more) and ``term_values`` (term and more) bring columns that the ranker needs.
    """
    terms = [t for ts in topics.values() for t in ts]
    matches = candidates(index, query_table(index, topics, weights), terms)
    if term_values is not None:
        matches = matches.join(term_values, "term")
    if doc_values is not None:
        matches = matches.join(doc_values, "docid")
    scored = score(matches, ranker)
    if all_terms:
        scored = scored.filter(F.col("terms") >= F.col("qlen"))
    return top(scored, k)


def search_table(index: Index, topics: DataFrame, ranker: Ranker, k: int = 20) -> DataFrame:
    """The same for a large table of topics (topic, text).

    A match for each topic, term and document is more than can be shuffled where topics have frequent terms. So documents
    are scored where their postings are counted, and only each task's ``k`` best of a topic leave it. Query terms of tables
    over ``MAX_TABLE`` rows, and those of rankers that look at the query, are joined by a shuffle.
    """
    exploded = topics.select("topic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_OR_NUMBER), F.lit(1))).alias("term"))
    counted = exploded.groupBy("topic", "term").agg(F.count("*").alias("times"))
    kinds = dict(index.docs.dtypes)["docid"], dict(topics.dtypes)["topic"]
    if index.sized is not None and set(kinds) <= {"int", "bigint"} and not ranker.doc and not ranker.needs and "qlen" not in str(ranker.term()):
        rows = counted.limit(MAX_TABLE + 1).collect()
        if len(rows) <= MAX_TABLE:
            return top(_scored_in_place(index, rows, ranker, k, topics.schema["topic"]), k)
    sizes = exploded.groupBy("topic").agg(F.count("*").alias("qlen"))
    query = counted.join(sizes, "topic").withColumn("prescalar", F.lit(1.0)).withColumn("postscalar", F.lit(1.0))
    return top(score(candidates(index, query), ranker), k)


def _scored_in_place(index: Index, asked: list, ranker: Ranker, k: int, topic: StructField) -> DataFrame:
    """``topic, docid, rsv``: of each task's documents, the ``k`` best of every topic. ``asked`` has (topic, term, times)."""
    asked = [r for r in asked if r.topic is not None]
    terms, names = sorted({r.term for r in asked}), np.array(sorted({r.topic for r in asked}), np.int64)
    code, place = {t: i for i, t in enumerate(terms)}, {t: i for i, t in enumerate(names.tolist())}
    rows = sorted((code[r.term], place[r.topic], r.times) for r in asked)
    first = np.searchsorted([r[0] for r in rows], np.arange(len(terms) + 1))
    whose, times = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)
    named = index.spark.createDataFrame(list(code.items()), "term string, code int")
    known = index.dictionary.join(F.broadcast(named), "term").select("term", "code", "df", "cf")
    held = index.postings.join(F.broadcast(known), "term").crossJoin(F.broadcast(index.stats))
    scored = held.select("docid", "code", finite(ranker.term()).alias("s"))
    docs_at_once = max(1, SCORES_AT_ONCE // max(1, len(names)))

    def best(ids: np.ndarray, of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((-ids, -np.floor(value * 10**SCALE + 0.5), of))
        ids, of, value = ids[order], of[order], value[order]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        keep = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of)))) < k
        return ids[keep], of[keep], value[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(names), -np.inf)

        def add(ids: np.ndarray, codes: np.ndarray, s: np.ndarray) -> None:
            nonlocal kept
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            start = np.append(np.flatnonzero(new), len(ids))
            for i in range(0, len(start) - 1, docs_at_once):
                own = start[i : i + docs_at_once + 1]
                a, b, n = own[0], own[-1], len(own) - 1
                doc = np.repeat(np.arange(n), np.diff(own))
                many = first[codes[a:b] + 1] - first[codes[a:b]]
                at = np.repeat(first[codes[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(doc, many) * len(names) + whose[at]
                sums = np.bincount(cell, np.repeat(s[a:b], many) * times[at], n * len(names))
                met = np.zeros(n * len(names), bool)
                met[cell] = True
                row, of = np.nonzero((met & (sums >= np.tile(least, n))).reshape(n, -1))
                if len(row):
                    kept = best(*(np.concatenate(x) for x in zip(kept, (ids[own[:-1]][row], of, sums.reshape(n, -1)[row, of]))))
                    full = np.bincount(kept[1], minlength=len(names)) == k
                    low = np.full(len(names), np.inf)
                    np.minimum.at(low, kept[1], kept[2])
                    least[full] = low[full] - 10.0**-SCALE

        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            part = tuple(batch.column(i).to_numpy() for i in range(3))
            part = part if rest is None else tuple(np.concatenate(x) for x in zip(rest, part))
            if len(part[0]):
                cut = np.flatnonzero(part[0] != part[0][-1])
                cut = cut[-1] + 1 if len(cut) else 0
                if cut:
                    add(*(x[:cut] for x in part))
                rest = tuple(x[cut:] for x in part)
        if rest is not None and len(rest[0]):
            add(*rest)
        ids, of, value = kept
        yield pa.RecordBatch.from_arrays([pa.array(names[of]).cast(whole), pa.array(ids), pa.array(value)], ["topic", "docid", "rsv"])

    whole = pa.int32() if topic.dataType.typeName() == "integer" else pa.int64()
    found = scored.withColumn("docid", F.col("docid").cast("long")).mapInArrow(run, StructType([topic, StructField("docid", LongType()), StructField("rsv", DoubleType())]))
    return found.select("topic", F.col("docid").cast(index.docs.schema["docid"].dataType).alias("docid"), F.round("rsv", SCALE).alias("rsv"))


def page(run: DataFrame, first: int, last: int) -> DataFrame:
    """Ranks ``first`` to ``last`` of every topic."""
    return run.filter(F.col("rank").between(first, last))


def hits(index: Index, topics: dict[int, list[str]]) -> DataFrame:
    """Number of documents that match any term of each topic."""
    terms = [t for ts in topics.values() for t in ts]
    matches = restricted(index, terms).postings.join(F.broadcast(query_table(index, topics)), "term")
    return matches.groupBy("topic").agg(F.count_distinct("docid").alias("hits"))


def blend(scored: DataFrame, static: DataFrame, ratio: float) -> DataFrame:
    """Scores times ``ratio`` plus ln(static value) times the rest less 0.01."""
    both = scored.join(static.select("docid", "pregen"), "docid")
    return both.withColumn("rsv", F.round(F.col("rsv") * ratio + F.log("pregen") * (1 - ratio) - 0.01, SCALE))


def broker(runs: Iterable[DataFrame], k: int) -> DataFrame:
    """Runs of shards, each scored by its own statistics, in one order; of equal scores the lower docid comes first."""
    both = None
    for run in runs:
        both = run if both is None else both.unionByName(run)
    return top(both.drop("rank"), k, first_docid_last=False)
