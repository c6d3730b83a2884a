"""Tokenising and cleaning expressions; all of them stay in the JVM unless the name says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Runs of letters and runs of digits; a word and a number never join.
WORD_OR_NUMBER = r"(\p{L}+|\p{N}+)"
#: The same without a group and without going back, which is faster, and what a text with a token holds; by whether numbers are tokens.
_RUNS = {True: r"\p{L}++|\p{N}++", False: r"\p{L}++"}
FIRST = {True: r"[\p{L}\p{N}]", False: r"\p{L}"}
#: A facet term: U+0080 followed by letters, digits, "-" or ":".
SPECIAL = "(\u0080[\\p{L}\\p{N}:-]+|\\p{L}+|\\p{N}+)"
_SILENT = r"(?s)<!--.*?-->|<\?.*?\?>"
_TAG_NAME = r"<([A-Za-z_][\w.:-]*)"


def tokens(text: Column, numbers: bool = True, special: bool = False) -> Column:
    """Lower-cased words and numbers of a text, in order."""
    if special:
        return F.regexp_extract_all(F.lower(text), F.lit(SPECIAL), F.lit(1))
    return F.regexp_extract_all(F.lower(text), F.lit(_RUNS[numbers]), F.lit(0))


def markup_text(source: Column) -> Column:
    """Text of a marked-up document: comments, processing instructions and tags become spaces."""
    return F.regexp_replace(F.regexp_replace(source, _SILENT, " "), r"<[^>]*>", " ")


def tag_terms(source: Column) -> Column:
    """Names of the opening tags, in upper case, in order; attributes are skipped."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(source, _SILENT, " "), F.lit(_TAG_NAME), F.lit(1)), F.upper)


def scrub_non_ascii(text: Column) -> Column:
    """NUL and characters outside ASCII become one space each."""
    return F.regexp_replace(text, r"[^\x01-\x7F]", " ")


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of neighbouring ideographs, and lone ones as they are."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+)"), F.lit(1))
    pair = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pair))


@F.pandas_udf(StringType())
def fold_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, lower-cased; Spark has no such built-in."""
    for s in batches:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())
