"""Plans whose figures must grow no faster than the documents, and the cases that their shortcuts could get wrong."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import queries as q
from lodestar.operators import expand, feedback, index as ix, maintain, rankers, search as se, term_models, topsig

TEXTS = [(1, "ponies pony pony red Éa 12"), (2, "pony the the cats 12a"), (3, "red cat the of"), (4, "..."), (5, None), (None, "red")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.fixture(scope="module")
def small(docs):
    return ix.build_index(docs)


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def physical(df):
    return plan(df, "executedPlan").split("== Initial Plan ==")[-1]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_texts_are_tokenised_once_and_postings_stay_in_place(small):
    for df in (small.postings, small.dictionary, small.stats, small.exploded, ix.restricted(small, ["the"]).dictionary):
        assert plan(df).count("regexp_extract_all") == 1
    assert "Exchange" not in physical(small.postings)
    assert physical(small.dictionary).count("Exchange") == 1


def test_counting_in_place_keeps_repeated_ids_and_stems(spark, small):
    assert {(r.term, r.docid, r.raw) for r in small.postings.collect()} == {("12", 1, 1), ("pony", 1, 2), ("ponies", 1, 1), ("red", 1, 1), ("éa", 1, 1), ("pony", 2, 1), ("the", 2, 2), ("cats", 2, 1), ("12", 2, 1), ("a", 2, 1), ("red", 3, 1), ("cat", 3, 1), ("the", 3, 1), ("of", 3, 1)}
    twice = ix.build_index(spark.createDataFrame([(1, "b a"), (1, "a b"), (1, "a a a")], "doc_id long, text string"))
    assert rows(twice.postings.select("term", "docid", "dl", "raw")) == [("a", 1, 2, 2), ("a", 1, 3, 3), ("b", 1, 2, 2)]
    assert twice.stats.first().n == 3 and twice.sized is None
    assert rows(term_models.tfidf_lengths(twice).select("docid", "uniq")) == [(1, 3)]
    stemmed = ix.build_index(spark.createDataFrame([(1, "ponies pony pony cats")], "doc_id long, text string"), stemmer="s")
    assert rows(stemmed.dictionary) == [("cat", 1, 1, 1), ("pony", 3, 1, 3)]


def test_statistics_of_all_postings_take_one_shuffle(small):
    """Impacts and document vectors: F8, F9, F12, F17."""
    joined = small.postings.join(small.dictionary.select("term", "cf", "df"), "term")
    held = ix.looked_up(small)
    assert rows(held.select("term", "docid", "tf", "cf", "df")) == rows(joined.select("term", "docid", "tf", "cf", "df"))
    assert physical(held).count("Exchange") == 1
    assert plan(term_models.tfidf_lengths(small)).count("Join Inner") <= 3
    whole = maintain.impacts(small, rankers.bm25())
    assert rows(maintain.impacts(small, rankers.bm25(), terms=["the"])) == rows(whole.filter("term = 'the'"))


def test_signature_bits_are_drawn_at_the_document(spark, small):
    """a posting isn't multiplied by its 52 bits before the shuffle."""
    assert "explode" not in plan(topsig.signed(small)).split("MapInArrow")[0] and "MapInArrow" in plan(topsig.signed(small))
    i = F.explode(F.sequence(F.lit(0), F.lit(51)))
    for width in (256, 192):
        want = spark.createDataFrame([("the",), ("éa",)], "t string").select("t", F.xxhash64("t").alias("h"), i.alias("i")).withColumn("bit", F.pmod(F.xxhash64("t", "i"), F.lit(width))).orderBy("t", "i").collect()
        got = topsig._draws(np.array([want[0].h, want[52].h], np.int64), 52, width)
        assert got.ravel().tolist() == [r.bit for r in want]


def test_variants_are_stemmed_once_and_only_if_likely(small):
    """F3, F6, F7, F11, F16, F22."""
    variants = expand.variants_by_stem(small, ["ponies", "the"], "porter")
    assert "substring" in plan(variants)
    assert "EvalPython" not in plan(variants).split("Aggregate", 1)[1].split("Generate", 1)[0]
    assert rows(variants) == [("ponies", "ponies"), ("ponies", "pony"), ("the", "the")]
    run = expand.search_conflated(small, {1: ["ponies"]}, variants, rankers.bm25())
    assert "EvalPython" not in plan(run) and {r.docid for r in run.collect()} == {1, 2}
    near = plan(expand.term_similarity(small, variants))
    assert "LeftSemi" in near and "sort_array" not in near


def test_feedback_counts_chosen_documents_only(small):
    """F5, F13, F15, F20."""
    terms = feedback.more_like_this(small, [1], 2)
    assert "sort_array" not in plan(terms) and plan(terms).count("regexp_extract_all") <= 2
    again = feedback.blind_kl(small, {1: ["pony"]}, rankers.bm25(), documents=1, terms=1)
    assert plan(again).count("regexp_extract_all") <= 3


def test_topic_tables_are_scored_in_place(spark, small, monkeypatch):
    """no row for each topic, term and document is shuffled; k, ties and repeated terms as by the join."""
    topics = spark.createDataFrame([(7, "the the of pony"), (9, "THE red"), (8, "absent"), (11, "12 pony red cat")], "topic long, text string")
    monkeypatch.setattr(se, "SCORES_AT_ONCE", 4)
    for k in (1, 2, 20):
        monkeypatch.setattr(se, "MAX_TABLE", 1000)
        found = se.search_table(small, topics, rankers.bm25(), k)
        assert "MapInArrow" in plan(found)
        monkeypatch.setattr(se, "MAX_TABLE", 0)
        joined = se.search_table(small, topics, rankers.bm25(), k)
        assert "MapInArrow" not in plan(joined) and rows(found) == rows(joined)
    assert "MapInArrow" not in plan(se.search_table(small, topics, rankers.lmds(), 2))


def test_stored_dictionary_is_counted_from_the_stored_postings(spark, small, tmp_path):
    """F10."""
    spark.sql("DROP DATABASE IF EXISTS grown CASCADE")
    spark.sql(f"CREATE DATABASE grown LOCATION '{tmp_path}/grown'")
    ix.write_index(small, "grown.one", 2)
    again = ix.load_index(spark, "grown.one")
    assert "Exchange" not in physical(ix.dictionary_of(again.postings))
    assert rows(again.dictionary) == rows(small.dictionary) and rows(again.stats) == rows(small.stats)
    spark.sql("DROP DATABASE grown CASCADE")


def test_plain_queries_read_the_texts_thrice(spark, sf_dir):
    """statistics, postings and dictionary."""
    for name in ("thesaurus_expand", "cull_frequent", "index_s_stemmed", "eval_magp"):
        assert plan(q.queries()[name](spark, sf_dir)).count("regexp_extract_all") <= 3, name
