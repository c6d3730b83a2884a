"""Presentation of results: snippets, focus ranges, word clouds, run files."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.feedback import more_like_this  # noqa: F401

LENGTH = 300
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TAGS = re.compile(r"<[^>]*>")


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def tag_snippet(source: Column, tag: str, length: int = LENGTH) -> Column:
    """Text of the first element of that name."""
    return F.substring(_squeeze(F.regexp_extract(source, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)), 1, length)


def beginning_snippet(source: Column, tag: str, length: int = LENGTH) -> Column:
    """Text after the first end of that element, or from the start if there is none."""
    after = F.regexp_extract(source, f"(?is)</{tag}>(.*)", 1)
    return F.substring(_squeeze(F.when(after == "", source).otherwise(after)), 1, length)


def best_window(text: str, weights: dict[str, float], length: int = LENGTH) -> str:
    """The stretch of at most ``length`` characters with the greatest weight of query words, centred on them.

    The first of equal stretches is taken; a text without query words gives its beginning.
    """
    plain = " ".join(_TAGS.sub(" ", text).split())
    hits = [(m.start(), m.end(), weights[w]) for m in _WORD.finditer(plain) if (w := m[0].lower()) in weights]
    if not hits:
        return plain[:length]
    best, at, total, left = -1.0, (0, 0), 0.0, 0
    for right, (_, end, w) in enumerate(hits):
        total += w
        while end - hits[left][0] > length and left < right:
            total -= hits[left][2]
            left += 1
        if total > best + 1e-12:
            best, at = total, (hits[left][0], end)
    start = max(0, min(at[0] - (length - (at[1] - at[0])) // 2, len(plain) - length))
    return plain[start : start + length]


def best_element(source: str, tag: str, weights: dict[str, float], length: int = LENGTH) -> str:
    """Text of the element of that name with the greatest weight of query words; the first of equal ones."""
    best, out = -1.0, ""
    for m in re.finditer(f"<{tag}\\b[^>]*>(.*?)</{tag}>", source, re.S | re.I):
        plain = " ".join(_TAGS.sub(" ", m[1]).split())
        score = sum(weights.get(w.lower(), 0.0) for w in _WORD.findall(plain))
        if score > best:
            best, out = score, plain[:length]
    return out


def focus_range(source: str, terms: set[str]) -> tuple[int, int] | None:
    """Offsets from the nearest tag open around the first query word to the first close tag after the last one."""
    hits = [(m.start(), m.end()) for m in _WORD.finditer(_TAGS.sub(lambda t: " " * len(t[0]), source)) if m[0].lower() in terms]
    if not hits:
        return None
    stack: list[int] = []
    for m in re.finditer(r"<(/?)([A-Za-z][\w.:-]*)[^>]*?(/?)>", source):
        if m.start() >= hits[0][0]:
            break
        if m[1]:
            if stack:
                stack.pop()
        elif not m[3]:
            stack.append(m.start())
    start = stack[-1] if stack else 0
    close = re.compile(r"</[^>]*>").search(source, hits[-1][1])
    return start, close.end() if close else len(source)


def query_weights(dictionary: DataFrame, stats: DataFrame, terms: list[str], icf: bool) -> dict[str, float]:
    """Weight of each query word: 1, or ln(L / cf). Bounded by the number of query words."""
    if not icf:
        return dict.fromkeys(terms, 1.0)
    rows = dictionary.filter(F.col("term").isin(terms)).crossJoin(F.broadcast(stats.select("l"))).select("term", "cf", "l").collect()
    return {r.term: math.log(r.l / r.cf) for r in rows}


def window_snippets(top: DataFrame, weights: dict[str, float], text: str = "text", length: int = LENGTH) -> DataFrame:
    """``top`` (the few rows that are shown) with a snippet of its text column."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: best_window(t or "", weights, length))

    return top.withColumn("snippet", cut(text))


def element_snippets(top: DataFrame, tag: str, weights: dict[str, float], source: str = "html", length: int = LENGTH) -> DataFrame:
    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: best_element(t or "", tag, weights, length))

    return top.withColumn("snippet", cut(source))


def focused(top: DataFrame, terms: list[str], source: str = "html") -> DataFrame:
    """``top`` with the first offset and the end of its focus range (null where no query word is met)."""
    wanted = set(terms)

    @F.pandas_udf("first int, last int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [focus_range(t or "", wanted) or (None, None) for t in s]
            yield pd.DataFrame(rows, columns=["first", "last"]).astype("Int32")

    return top.withColumn("_f", find(source)).withColumns({"focus_start": F.col("_f.first"), "focus_end": F.col("_f.last")}).drop("_f")


def word_cloud(terms: DataFrame) -> DataFrame:
    """``docid, cloud``: a document's terms (docid, term, kl) in order of weight, joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("kl")).alias("k"), "term")))
    return terms.groupBy("docid").agg(F.array_join(F.transform(ordered, lambda x: x["term"]), " ").alias("cloud"))


def named(run: DataFrame, docs: DataFrame, name: str = "name") -> DataFrame:
    """A run with the documents' names; only the run's rows are looked up."""
    return run.join(docs.select("docid", name), "docid")


def trec_lines(run: DataFrame, run_id: str, name: str = "docid") -> DataFrame:
    """``line``: topic Q0 name rank score run, ready for :func:`write_run`."""
    return run.select(F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), F.col(name).cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("rsv")), F.lit(run_id)).alias("line"))


def inex_lines(run: DataFrame, run_id: str) -> DataFrame:
    """``topic, line``: hits as elements of a topic."""
    hit = F.concat(F.lit("<result><file>"), F.col("docid").cast("string"), F.lit("</file><path>/article[1]</path><rank>"), F.col("rank").cast("string"), F.lit("</rank><rsv>"), F.format_string("%.6f", F.col("rsv")), F.lit("</rsv></result>"))
    hits = run.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda x: x["hit"]), "").alias("hits"))
    return hits.select("topic", F.concat(F.lit('<topic topic-id="'), F.col("topic").cast("string"), F.lit(f'" run-id="{run_id}">'), "hits", F.lit("</topic>")).alias("line"))


def best_entry_points(focused_run: DataFrame, run_id: str) -> DataFrame:
    """``line``: topic Q0 name rank score run and the offset to begin reading at."""
    return focused_run.select(F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), F.col("docid").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("rsv")), F.lit(run_id), F.coalesce(F.col("focus_start").cast("string"), F.lit("0"))).alias("line"))


def hit_elements(run: DataFrame) -> DataFrame:
    """``line``: hits as ``<hit>`` elements."""
    part = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x.cast("string"), F.lit(f"</{tag}>"))
    return run.select("topic", "rank", F.concat(F.lit("<hit>"), part("rank", F.col("rank")), part("id", F.col("docid")), part("rsv", F.format_string("%.2f", F.col("rsv"))), F.lit("</hit>")).alias("line"))


def write_run(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
