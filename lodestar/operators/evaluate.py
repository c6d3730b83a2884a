"""Effectiveness of runs against assessments.

A run has (topic, rank, docid); assessments have (topic, subtopic, docid, rel) and, for passage metrics, rel_chars
and doc_length. Judged documents that no run or collection holds still count as relevant. A metric is a row
per topic; topics without a relevant document have none. :func:`mean` averages over topics.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6


def _above():
    return Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)


def judgements(qrels: DataFrame) -> DataFrame:
    """``topic, docid, rel``: the best grade over subtopics."""
    return qrels.groupBy("topic", "docid").agg(F.max("rel").alias("rel"))


def totals(qrels: DataFrame) -> DataFrame:
    """``topic, relevant, nonrelevant`` of topics with a relevant document."""
    rel = (F.col("rel") > 0).cast("long")
    return judgements(qrels).groupBy("topic").agg(F.sum(rel).alias("relevant"), F.sum(1 - rel).alias("nonrelevant")).filter("relevant > 0")


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.select("topic", "rank", "docid").join(judgements(qrels), ["topic", "docid"], "left").withColumn("hit", F.when(F.col("rel") > 0, 1).otherwise(0)).withColumn("miss", F.when(F.col("rel") <= 0, 1).otherwise(0))


def _finish(summed: DataFrame, qrels: DataFrame, value) -> DataFrame:
    """Topics of the assessments, those that the run lacks with 0."""
    return totals(qrels).join(summed, "topic", "left").select("topic", F.round(F.coalesce(value, F.lit(0.0)), DIGITS).alias("value"))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    rows = _judged(run, qrels).withColumn("found", F.sum("hit").over(_so_far())).filter("hit = 1")
    return _finish(rows.groupBy("topic").agg(F.sum(F.col("found") / F.col("rank")).alias("s")), qrels, F.col("s") / F.col("relevant"))


def generalised_precision(run: DataFrame, qrels: DataFrame, beta: float = 0.25) -> DataFrame:
    """Average of the F-measure of relevant characters (recall is whole for a whole document)."""
    best = qrels.groupBy("topic", "docid").agg(F.max(F.col("rel_chars") / F.col("doc_length")).alias("p"), F.max("rel").alias("rel"))
    f = (1 + beta * beta) * F.col("p") / (beta * beta * F.col("p") + 1)
    rows = run.select("topic", "rank", "docid").join(best, ["topic", "docid"], "left").withColumn("f", F.when(F.col("rel") > 0, f).otherwise(0.0))
    rows = rows.withColumn("so_far", F.sum("f").over(_so_far())).filter("rel > 0")
    return _finish(rows.groupBy("topic").agg(F.sum(F.col("so_far") / F.col("rank")).alias("s")), qrels, F.col("s") / F.col("relevant"))


def precision_at(run: DataFrame, qrels: DataFrame, n: int = 10) -> DataFrame:
    """Over the smaller of ``n`` and the number of documents retrieved."""
    rows = _judged(run, qrels).filter(F.col("rank") <= n).groupBy("topic").agg(F.sum("hit").alias("hits"), F.count("*").alias("got"))
    return _finish(rows, qrels, F.col("hits") / F.col("got"))


def success_at(run: DataFrame, qrels: DataFrame, n: int = 10) -> DataFrame:
    rows = _judged(run, qrels).filter(F.col("rank") <= n).groupBy("topic").agg(F.max("hit").cast("double").alias("s"))
    return _finish(rows, qrels, F.col("s"))


def rank_effectiveness(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Unjudged documents are skipped; 1 for a found document where nothing is judged non-relevant."""
    rows = _judged(run, qrels).withColumn("above", F.coalesce(F.sum("miss").over(_above()), F.lit(0))).filter("hit = 1").join(totals(qrels), "topic")
    part = F.when(F.col("nonrelevant") == 0, 1.0).otherwise(1 - F.col("above") / F.col("nonrelevant"))
    return _finish(rows.groupBy("topic").agg(F.sum(part).alias("s")), qrels, F.col("s") / F.col("relevant"))


def bpref(run: DataFrame, qrels: DataFrame, m: int = 0) -> DataFrame:
    rows = _judged(run, qrels).withColumn("above", F.coalesce(F.sum("miss").over(_above()), F.lit(0))).filter("hit = 1").join(totals(qrels), "topic")
    bottom = m + F.least("relevant", "nonrelevant")
    part = F.when(bottom == 0, 1.0).otherwise(1 - (m + F.least("above", "relevant")) / bottom)
    return _finish(rows.groupBy("topic").agg(F.sum(part).alias("s")), qrels, F.col("s") / F.col("relevant"))


def _gain(rel, exponential: bool):
    return F.pow(F.lit(2.0), rel) - 1 if exponential else rel.cast("double")


def dcg(run: DataFrame, qrels: DataFrame, n: int = 10, exponential: bool = False, damping: float = 0.0) -> DataFrame:
    """Gain over log2(1 + rank); ``damping`` takes a share off for every rank."""
    rows = _judged(run, qrels).filter((F.col("rank") <= n) & (F.col("hit") == 1))
    part = _gain(F.col("rel"), exponential) * F.pow(F.lit(1 - damping), F.col("rank") - 1) / F.log2(F.col("rank") + 1)
    return _finish(rows.groupBy("topic").agg(F.sum(part).alias("s")), qrels, F.col("s"))


def ndcg(run: DataFrame, qrels: DataFrame, n: int = 10, exponential: bool = False, damping: float = 0.0) -> DataFrame:
    """Over the gain of the best order of the first subtopic's judgements."""
    first = qrels.join(qrels.groupBy("topic").agg(F.min("subtopic").alias("subtopic")), ["topic", "subtopic"], "left_semi")
    w = Window.partitionBy("topic").orderBy(F.desc("rel"), "docid")
    best = judgements(first).filter("rel > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    part = _gain(F.col("rel"), exponential) * F.pow(F.lit(1 - damping), F.col("rank") - 1) / F.log2(F.col("rank") + 1)
    ideal = best.groupBy("topic").agg(F.sum(part).alias("ideal"))
    rows = _judged(run, first).filter((F.col("rank") <= n) & (F.col("hit") == 1)).groupBy("topic").agg(F.sum(part).alias("s"))
    return _finish(rows.join(ideal, "topic"), qrels, F.col("s") / F.col("ideal"))


def err(run: DataFrame, qrels: DataFrame, n: int = 10, grades: int = 4) -> DataFrame:
    """Expected reciprocal rank; the product over earlier documents is the exponential of a running sum."""
    r = F.when(F.col("hit") == 1, (F.pow(F.lit(2.0), F.col("rel")) - 1) / 2.0**grades).otherwise(0.0)
    rows = _judged(run, qrels).filter(F.col("rank") <= n).withColumn("r", r).withColumn("pass", F.exp(F.coalesce(F.sum(F.log(1 - F.col("r"))).over(_above()), F.lit(0.0))))
    return _finish(rows.groupBy("topic").agg(F.sum(F.col("r") * F.col("pass") / F.col("rank")).alias("s")), qrels, F.col("s"))


def _over_subtopics(metric: Callable[..., DataFrame], run: DataFrame, qrels: DataFrame, **kw) -> DataFrame:
    """Mean of a metric over the subtopics that have a relevant document."""
    key = F.struct("topic", "subtopic")
    split = qrels.withColumn("topic", key)
    pairs = qrels.select("topic", "subtopic").distinct()
    own = run.select("topic", "rank", "docid").join(pairs, "topic").withColumn("topic", key)
    values = metric(own, split, **kw)
    return values.groupBy(F.col("topic.topic").alias("topic")).agg(F.round(F.avg("value"), DIGITS).alias("value"))


def intent_aware_map(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return _over_subtopics(average_precision, run, qrels)


def intent_aware_precision(run: DataFrame, qrels: DataFrame, n: int = 10) -> DataFrame:
    return _over_subtopics(precision_at, run, qrels, n=n)


def novelty(docs: list[frozenset], alpha: float, weight: Callable[[int], float]) -> float:
    """Sum over ranks of what each document's subtopics are still worth."""
    seen: dict = {}
    total = 0.0
    for rank, subtopics in enumerate(docs, 1):
        total += weight(rank) * sum((1 - alpha) ** seen.get(s, 0) for s in subtopics)
        for s in subtopics:
            seen[s] = seen.get(s, 0) + 1
    return total


def greedy_ideal(docs: dict, n: int, alpha: float) -> list[frozenset]:
    """At each rank the document worth most; of equal ones the smallest id."""
    left, seen, out = dict(docs), {}, []
    while left and len(out) < n:
        best = max(sorted(left), key=lambda d: sum((1 - alpha) ** seen.get(s, 0) for s in left[d]))
        out.append(left.pop(best))
        for s in out[-1]:
            seen[s] = seen.get(s, 0) + 1
    return out


def _per_topic(run: DataFrame, qrels: DataFrame, n: int, value: Callable[[list[frozenset], dict, int], float]) -> DataFrame:
    """A topic's first ``n`` documents and its relevant judgements meet in one group; both are lists of one topic."""
    subtopics = qrels.filter("rel > 0").select("topic", "subtopic", "docid")
    ranked = run.filter(F.col("rank") <= n).select("topic", "rank", "docid")

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {d: frozenset(g) for d, g in right.groupby("docid")["subtopic"]}
        if not known:
            return pd.DataFrame({"topic": [], "value": []}).astype({"topic": "int64", "value": "float64"})
        docs = [known.get(d, frozenset()) for d in left.sort_values("rank")["docid"]]
        return pd.DataFrame({"topic": [int(key[0])], "value": [round(value(docs, known, len(set(right["subtopic"]))), DIGITS)]})

    return ranked.groupBy("topic").cogroup(subtopics.groupBy("topic")).applyInPandas(work, "topic long, value double")


def intent_aware_err(run: DataFrame, qrels: DataFrame, n: int = 10, alpha: float = 0.5) -> DataFrame:
    """Cascade over subtopics, over what a list would get whose documents all had every subtopic."""

    def value(docs: list[frozenset], known: dict, subtopics: int) -> float:
        best = novelty([frozenset(range(subtopics))] * n, alpha, lambda r: 1 / r)
        return novelty(docs, alpha, lambda r: 1 / r) / best

    return _per_topic(run, qrels, n, value)


def intent_aware_ndcg(run: DataFrame, qrels: DataFrame, n: int = 10, alpha: float = 0.5) -> DataFrame:
    """Novelty-biased gain over that of a greedily chosen list (the exact best one is NP-hard)."""
    import math

    def value(docs: list[frozenset], known: dict, subtopics: int) -> float:
        weight = lambda r: 1 / math.log2(1 + r)
        return novelty(docs, alpha, weight) / novelty(greedy_ideal(known, n, alpha), alpha, weight)

    return _per_topic(run, qrels, n, value)


def mean(values: DataFrame) -> DataFrame:
    return values.agg(F.round(F.avg("value"), DIGITS).alias("value"), F.count("*").alias("topics"))


METRICS: dict[str, Callable[..., DataFrame]] = {
    "map": average_precision,
    "magp": generalised_precision,
    "p": precision_at,
    "s": success_at,
    "rankeff": rank_effectiveness,
    "bpref": bpref,
    "dcg": dcg,
    "ndcg": ndcg,
    "err": err,
    "ia-map": intent_aware_map,
    "ia-p": intent_aware_precision,
    "ia-err": intent_aware_err,
    "ia-ndcg": intent_aware_ndcg,
}


def register(name: str, metric: Callable[..., DataFrame]) -> None:
    METRICS[name] = metric


def bundle(run: DataFrame, qrels: DataFrame, names: list[str]) -> DataFrame:
    """``metric, value, topics``: means of several metrics."""
    out = None
    for name in names:
        part = mean(METRICS[name](run, qrels)).select(F.lit(name).alias("metric"), "value", "topics")
        out = part if out is None else out.unionByName(part)
    return out


def concordance(a: list, b: list) -> tuple[int, int, int, int]:
    """(concordant less discordant pairs, pairs, pairs equal in a, pairs equal in b) in n log n steps."""
    from bisect import bisect_left, bisect_right, insort

    n = len(a)
    order = sorted(range(n), key=lambda i: (a[i], b[i]))
    met: list = []
    block: list = []
    score, last = 0, None
    for i in order:
        if a[i] != last:
            for x in block:
                insort(met, x)
            block, last = [], a[i]
        score += bisect_left(met, b[i]) - (len(met) - bisect_right(met, b[i]))
        block.append(b[i])
    ties = lambda xs: sum(m * (m - 1) // 2 for m in pd.Series(xs).value_counts())
    return score, n * (n - 1) // 2, ties(a), ties(b)


def kendall_tau(a: list, b: list) -> float:
    """tau-b of two lists of values of the same items."""
    score, pairs, in_a, in_b = concordance(a, b)
    bottom = ((pairs - in_a) * (pairs - in_b)) ** 0.5
    return score / bottom if bottom else 0.0


def run_correlation(first: DataFrame, second: DataFrame) -> DataFrame:
    """tau-b of every topic over the documents that both runs hold; a topic's group is no longer than a run is deep."""
    both = first.select("topic", "docid", F.col("rsv").alias("a")).join(second.select("topic", "docid", F.col("rsv").alias("b")), ["topic", "docid"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"topic": [int(pdf["topic"].iloc[0])], "pairs": [len(pdf) * (len(pdf) - 1) // 2], "tau": [round(kendall_tau(pdf["a"].tolist(), pdf["b"].tolist()), DIGITS)]})

    return both.groupBy("topic").applyInPandas(work, "topic long, pairs long, tau double")


def perfect_run(qrels: DataFrame, k: int) -> DataFrame:
    """The best run that the assessments allow."""
    w = Window.partitionBy("topic").orderBy(F.desc("rel"), F.desc("docid"))
    return judgements(qrels).filter("rel > 0").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("topic", "rank", "docid", F.col("rel").cast("double").alias("rsv"))
