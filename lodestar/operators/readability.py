"""Readability of documents and weighting of tagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

# The start of a list of familiar words; the full list of the published measure is a parameter.
FAMILIAR = tuple("a about after all and are as at be but by can come day do for from get go good had has have he her him his how i if in is it just know like little look make man many me more most my new no not now of off old on one or other our out over people say see she so some take than that the their them then there they thing think this time to two up us use very want was way we well were what when which who will with work would year you your".split())


def sentences(text: Column) -> Column:
    """Runs of sentence ends, at least one."""
    return F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"([.!?]+)"), F.lit(1))), F.lit(1))


def dale_chall(docs: DataFrame, familiar: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docid, words, unfamiliar, sentences, readability`` (thousandths).

    0.049 words a sentence + 15.79 times the share of unfamiliar words + 3.6365. The default list is a literal
    and stays inside the scan; a table of familiar words is joined by word.
    """
    words = docs.select(F.col(id_col).alias("docid"), T.tokens(F.col(text_col), numbers=False).alias("ws"), sentences(F.col(text_col)).alias("sentences")).filter("size(ws) > 0")
    if familiar is None:
        known = F.array(*(F.lit(w) for w in FAMILIAR))
        counted = words.select("docid", F.size("ws").alias("words"), F.size(F.filter("ws", lambda w: ~F.array_contains(known, w))).alias("unfamiliar"), "sentences")
    else:
        flat = words.select("docid", "sentences", F.explode("ws").alias("term")).join(familiar.select("term", F.lit(0).alias("new")), "term", "left")
        counted = flat.groupBy("docid", "sentences").agg(F.count("*").alias("words"), F.sum(F.coalesce("new", F.lit(1))).alias("unfamiliar"))
    score = 1000 * (0.049 * F.col("words") / F.col("sentences") + 15.79 * F.col("unfamiliar") / F.col("words") + 3.6365)
    return counted.select("docid", F.col("words").cast("long").alias("words"), F.col("unfamiliar").cast("long").alias("unfamiliar"), F.col("sentences").cast("long").alias("sentences"), F.round(score, 6).alias("readability"))


def weighted_tags(pages: DataFrame, tags: dict[str, int], id_col: str = "page_id", html: str = "html") -> DataFrame:
    """``docid, term, extra``: counts to add for words inside the named elements; a tag's weight for each occurrence."""
    def weighed(tag: str, weight: int) -> Column:
        inside = F.regexp_extract_all(F.col(html), F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1))
        return F.transform(T.tokens(F.array_join(inside, " ")), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    parts = [weighed(tag, weight) for tag, weight in tags.items()]
    flat = pages.select(F.col(id_col).alias("docid"), F.explode(F.concat(*parts)).alias("x"))
    return flat.groupBy("docid", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("extra"))


def title_terms(pages: DataFrame, id_col: str = "page_id", html: str = "html", weight: int = 99) -> DataFrame:
    """``docid, term, extra``: one term for the whole title, for exact title search."""
    title = F.trim(F.regexp_replace(F.lower(F.regexp_extract(F.col(html), "(?is)<title>(.*?)</title>", 1)), r"\s+", " "))
    return pages.select(F.col(id_col).alias("docid"), F.concat(F.lit("tf:"), title).alias("term"), F.lit(weight).alias("extra")).filter("term <> 'tf:'")
