"""Per-term parameters of the BM25 variants that fit k1 to each term's own counts.

A term's histogram or mean is aggregated in Spark; only one row a term reaches the vectorised root finding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.index import Index, looked_up, restricted, vocabulary


def _shape(k1: float) -> float:
    return 1.0 if k1 == 1 else k1 / (k1 - 1) * math.log(k1)


def secant_k1(mean_log: float, steps: int = 60) -> float:
    """k1 with g(k1) = ``mean_log``, g(k) = k / (k - 1) ln k, by the secant method from 1.0 and 1.1; k1 stays positive."""
    f = lambda k: _shape(k) - mean_log
    a, b = 1.0, 1.1
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fb == fa or abs(fb) < 1e-12:
            break
        a, b, fa = b, max(1e-6, b - fb * (b - a) / (fb - fa)), fb
        fb = f(b)
    return b


def bm25t_k1(index: Index, terms: list[str] | None = None, b: float = 0.2) -> DataFrame:
    """``term, k1`` from the mean of ln(c' + 1) over the term's documents."""
    postings = (index if terms is None else restricted(index, terms)).postings
    part = postings.crossJoin(F.broadcast(index.stats)).withColumn("t", F.col("tf") / ((1 - b) + b * F.col("dl") / F.col("adl")))
    means = part.groupBy("term").agg(F.avg(F.log(F.col("t") + 1)).alias("m"))

    @F.pandas_udf("double")
    def root(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(secant_k1)

    return means.select("term", root("m").alias("k1"))


def fit_adaptive(counts: dict[int, int], n: int) -> tuple[float, float]:
    """(k1, gain) of a term from the number of documents at each rounded normalised count.

    gain(r) = log2((df_{r+1} + 0.5) / (df_r + 1)) - log2((df_1 + 0.5) / (N + 1)), df_r: documents at r or more.
    k1 makes (k1 + 1) r / (k1 + r) fit gain(r) / gain(1) best in squares, searched from 0.001 to 10.
    """
    top = max(counts) if counts else 0
    at_least = np.zeros(top + 3)
    for r, d in counts.items():
        at_least[max(r, 1)] += d
    at_least = np.cumsum(at_least[::-1])[::-1]
    df = [n, *at_least[1:].tolist()]
    start = math.log2((df[1] + 0.5) / (n + 1))
    gains = []
    for r in range(1, top + 1):
        if df[r] < 1:
            break
        gains.append(math.log2((df[r + 1] + 0.5) / (df[r] + 1)) - start)
    if not gains or gains[0] <= 0:
        return 0.001, max(gains[0], 0.0) if gains else 0.0
    want = np.array(gains) / gains[0]
    r = np.arange(1, len(want) + 1)
    loss = lambda k: float((((k + 1) * r / (k + r) - want) ** 2).sum())
    low, high = 0.001, 10.0
    for _ in range(60):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        if loss(x) <= loss(y):
            high = y
        else:
            low = x
    return (low + high) / 2, gains[0]


def bm25adpt_k1(index: Index, terms: list[str] | None = None, b: float = 0.3) -> DataFrame:
    """``term, k1, gain`` from each term's histogram of rounded normalised counts."""
    postings = (index if terms is None else restricted(index, terms)).postings
    part = postings.crossJoin(F.broadcast(index.stats)).withColumn("r", F.round(F.col("tf") / ((1 - b) + b * F.col("dl") / F.col("adl"))).cast("int"))
    histogram = part.groupBy("term", "r", "n").agg(F.count("*").alias("d")).groupBy("term", "n").agg(F.map_from_entries(F.collect_list(F.struct("r", "d"))).alias("counts"))

    @F.pandas_udf("k1 double, gain double")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for counts, n in batches:
            yield pd.DataFrame([fit_adaptive(dict(x), int(m)) for x, m in zip(counts, n)], columns=["k1", "gain"])

    return histogram.select("term", fit("counts", "n").alias("x")).select("term", "x.k1", "x.gain")


def discounted_lengths(index: Index, g: float = 0.5) -> DataFrame:
    """``docid, disc``: sums of max(tf - g tf^g, 0)."""
    from lodestar.operators.rankers import discounted

    return index.postings.groupBy("docid").agg(F.sum(discounted(F.col("tf").cast("double"), g)).alias("disc"))


def tfidf_lengths(index: Index, g: float = 0.5) -> DataFrame:
    """``docid, uniq, tfidf_len, tfidf_disc, v``: the vectors of the tf.idf Pitman-Yor ranker."""
    from lodestar.operators.rankers import discounted

    size = vocabulary(index).agg(F.count("*").cast("double").alias("v"))
    if index.sized is not None:
        held = looked_up(index, index.sized.withColumn("uniq", F.col("uniq").cast("long")))
    else:
        held = looked_up(index).join(index.postings.groupBy("docid").agg(F.count("*").alias("uniq")), "docid")
    rows = held.crossJoin(F.broadcast(index.stats.select("n")))
    w = F.log(1 + F.col("tf") / F.col("uniq")) * F.log(F.col("n") / F.col("df"))
    summed = rows.groupBy("docid", "uniq").agg(F.sum(w).alias("tfidf_len"), F.sum(discounted(w, g)).alias("tfidf_disc"))
    return summed.crossJoin(F.broadcast(size))
