"""Rankers and operators on a toy corpus by hand, and properties that must hold."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import boolean, evaluate, expand, feedback, graph, index as ix, maintain, pregen, present, rankers, readability, search as se, term_models, topsig
from lodestar.plans.boolean_query import Leaf, Node, disjunctive, parse
from lodestar.storage import global_rank

TOY = [(0, "a b b c"), (1, "a c c c"), (2, "a d"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def toy(spark):
    return ix.build_index(spark.createDataFrame(TOY, "doc_id long, text string"))


def scores(run):
    return {(r.topic, r.docid): r.rsv for r in run.collect()}


def test_index_of_the_toy_corpus(toy):
    assert {(r.term, r.cf, r.df) for r in toy.dictionary.collect()} == {("a", 3, 3), ("b", 2, 1), ("c", 4, 2), ("d", 1, 1)}
    s = toy.stats.first()
    assert (s.n, s.l) == (3, 10) and s.adl == pytest.approx(10 / 3)
    d = ix.describe(toy).first()
    assert (d.documents, d.terms, d.longest, d.unique_terms) == (3, 10, 4, 4)


def test_counts_are_capped_and_frequencies_are_not(spark):
    i = ix.build_index(spark.createDataFrame([(1, "z " * 300)], "doc_id long, text string"))
    assert i.postings.first().tf == 255 and i.dictionary.first().cf == 300


def test_bm25_by_hand(toy):
    got = scores(se.search(toy, {1: ["b", "c"]}, rankers.bm25()))
    adl = 10 / 3
    w = lambda tf, dl, df: math.log(3 / df) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / adl))
    assert got == {(1, 0): round(w(2, 4, 1) + w(1, 4, 2), 6), (1, 1): round(w(3, 4, 2), 6)}
    assert set(scores(se.search(toy, {1: ["a"]}, rankers.bm25())).values()) == {0.0}


def test_language_models_by_hand(toy):
    got = scores(se.search(toy, {1: ["b", "c"]}, rankers.lmds()))
    w = lambda tf, cf: math.log(tf / 2500 * 10 / cf + 1)
    assert got[1, 0] == pytest.approx(w(2, 2) + w(1, 4) + 2 * math.log(2500 / 2504), abs=1e-6)
    got = scores(se.search(toy, {1: ["b", "c"]}, rankers.lmd()))
    one = lambda tf, cf, dl: math.log(1 + tf / 6750 * 10 / cf) - 2 * math.log(1 + dl / 6750)
    assert got[1, 0] == pytest.approx(one(2, 2, 4) + one(1, 4, 4), abs=1e-6)


def test_repeated_terms_count_again_and_ties_go_to_the_higher_id(toy):
    once, twice = scores(se.search(toy, {1: ["c"]}, rankers.bm25())), scores(se.search(toy, {1: ["c", "c"]}, rankers.bm25()))
    assert twice[1, 1] == pytest.approx(2 * once[1, 1], abs=2e-6)
    assert [r.docid for r in se.search(toy, {1: ["a"]}, rankers.term_count()).orderBy("rank").collect()] == [2, 1, 0]


def test_every_ranker_gives_finite_scores(toy):
    values = {"pregen": F.lit(3.0), "readability": F.lit(5000.0)}
    for name, make in rankers.RANKERS.items():
        r = make()
        docs, terms = None, None
        if name in ("pregen", "readable"):
            docs = toy.docs.select("docid", *(v.alias(k) for k, v in values.items()))
        if name == "lmp":
            docs = term_models.discounted_lengths(toy)
        if name == "lmptfidf":
            docs = term_models.tfidf_lengths(toy)
        if name == "bm25t":
            terms = term_models.bm25t_k1(toy)
        if name == "bm25adpt":
            terms = term_models.bm25adpt_k1(toy)
        got = scores(se.search(toy, {1: ["a", "b", "c", "d"]}, r, doc_values=docs, term_values=terms))
        assert len(got) == 3 and all(math.isfinite(v) for v in got.values()), name
    assert rankers.ranker("BM25:1.1:0.3").parameters == {"k1": 1.1, "b": 0.3}


def test_secant_finds_the_root():
    for k1 in (0.2, 0.7, 1.0, 1.6, 3.0):
        want = 1.0 if k1 == 1 else k1 / (k1 - 1) * math.log(k1)
        assert term_models.secant_k1(want) == pytest.approx(k1, abs=1e-4)
    k1, gain = term_models.fit_adaptive({1: 50, 2: 20, 3: 8, 5: 2}, 1000)
    assert 0.001 <= k1 <= 10 and gain > 0
    assert term_models.fit_adaptive({}, 10) == (0.001, 0.0)


def test_top_is_a_prefix_and_all_terms_a_subset(spark, sf_dir):
    i = ix.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    topics = {1: ["the", "of"]}
    full = [r.docid for r in se.search(i, topics, rankers.bm25(), 10**6).orderBy("rank").collect()]
    assert [r.docid for r in se.search(i, topics, rankers.bm25(), 7).orderBy("rank").collect()] == full[:7]
    every = {r.docid for r in se.search(i, topics, rankers.term_count(), 10**6, all_terms=True).collect()}
    assert every < set(full)
    assert every == {r.docid for r in boolean.matching(i, "the and of").collect()}
    either, one = ({r.docid for r in boolean.matching(i, q).collect()} for q in ("the or of", "the xor of"))
    assert one == either - every and either == set(full)
    impacts = maintain.impacts(i, rankers.bm25()).agg(F.min("impact"), F.max("impact")).first()
    assert tuple(impacts) == (1, 255)


def test_filter_on_terms_reaches_the_exploded_tokens(toy):
    plan = ix.restricted(toy, ["b"]).dictionary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") < plan.index("Generate")


def test_pruning_culling_merging(spark, toy):
    assert maintain.static_prune(toy, 1).count() == 4 and maintain.static_prune(toy, 3).count() == toy.postings.count()
    assert {r.term for r in maintain.quantum_prune(toy, 1).filter("term = 'a'").collect()} == {"a"} and maintain.quantum_prune(toy, 1).filter("term = 'a'").count() == 3
    assert {r.term for r in maintain.cull_singletons(toy).collect()} == {"a", "b", "c"}
    assert {r.term for r in maintain.cull_frequent(toy, 0.6).collect()} == {"b", "d"}
    whole = maintain.merge(maintain.shards(toy, 2))
    assert sorted(map(tuple, whole.dictionary.collect())) == sorted(map(tuple, toy.dictionary.collect()))
    assert whole.stats.first() == toy.stats.first()
    assert maintain.shifted(toy, 100).docs.agg(F.min("docid")).first()[0] == 100
    with pytest.raises(ValueError):
        maintain.impacts(toy, rankers.bm25l())


def test_stored_index_answers_alike(spark, toy, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS kept CASCADE")
    spark.sql(f"CREATE DATABASE kept LOCATION '{tmp_path}/kept'")
    ix.write_index(toy, "kept.toy", 4)
    again = ix.load_index(spark, "kept.toy")
    assert scores(se.search(again, {1: ["b", "c"]}, rankers.divergence())) == scores(se.search(toy, {1: ["b", "c"]}, rankers.divergence()))
    plan = again.postings.join(again.dictionary, "term")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    spark.sql("DROP DATABASE kept CASCADE")


def test_boolean_parser():
    assert parse("a and b or c") == Node("or", Node("and", Leaf("a"), Leaf("b")), Leaf("c"))
    assert parse("(a or b) xor c") == Node("xor", Node("or", Leaf("a"), Leaf("b")), Leaf("c"))
    assert parse("a b", "and") == Node("and", Leaf("a"), Leaf("b")) and parse("And x") == Node("or", Leaf("and"), Leaf("x"))
    assert disjunctive(parse("a or (b or c)")) and not disjunctive(parse("a and b"))
    for wrong in ("", "a and", "(a", "a)", "not b", "a and or b", "()"):
        with pytest.raises(ValueError):
            parse(wrong)


def test_conflation_recomputes_frequencies(spark):
    i = ix.build_index(spark.createDataFrame([(1, "cats cat cat"), (2, "cats dog"), (3, "dogs")], "doc_id long, text string"))
    one = expand.conflated(i, expand.variants_by_stem(i, ["cats"], "s"))
    assert {(r.docid, r.tf) for r in one.postings.collect()} == {(1, 3), (2, 1)}
    assert tuple(one.dictionary.first())[:3] == ("cats", 4, 2)
    same = expand.term_similarity(i, expand.variants_by_stem(i, ["cats"], "s")).collect()
    assert {r.term: r.similarity for r in same}["cats"] == 1.0
    words = spark.createDataFrame([("cat", "synonym", "dog"), ("cat", "antonym", "dogs")], "term string, relationship string, related string")
    assert {r.term for r in expand.variants_by_thesaurus(i, ["cat"], words).collect()} == {"cat", "dog"}
    assert expand.thesaurus_terms({1: ["cat", "x"]}, [("cat", "synonym", "dog")]) == {1: ["cat", "dog", "x"]}


def test_feedback_and_reranking(toy):
    best = {r.term: r.kl for r in feedback.more_like_this(toy, [0], 5).collect()}
    assert best["b"] == pytest.approx(0.5 * math.log(0.5 / 0.2), abs=1e-6) and max(best, key=best.get) == "b"
    run = feedback.blind_kl(toy, {1: ["c"]}, rankers.bm25(), documents=1, terms=1)
    assert run.count() >= 2
    again = feedback.rerank(toy, se.search(toy, {1: ["c"]}, rankers.bm25(), 2), {1: ["c"]}, rankers.bm25(), 2)
    assert {r.rsv for r in again.collect()} == {0.0}
    assert feedback.relevance_model(toy, {1: ["b", "c"]}, 5, 2).count() == 2


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, r, d, 1.0 / r) for r, d in enumerate([9, 1, 5, 2, 6], 1)], "topic long, rank long, docid long, rsv double")
    q = [(1, 0, 1, 1, 50, 100), (1, 0, 2, 2, 100, 100), (1, 0, 5, 0, 0, 100), (1, 0, 6, 0, 0, 100), (1, 0, 77, 1, 10, 100), (2, 0, 3, 1, 10, 100), (3, 0, 4, 0, 0, 10)]
    qrels = spark.createDataFrame(q, "topic long, subtopic int, docid long, rel int, rel_chars long, doc_length long")
    value = lambda name, **kw: {r.topic: r.value for r in evaluate.METRICS[name](run, qrels, **kw).collect()}
    assert value("map") == {1: round((1 / 2 + 2 / 4) / 3, 6), 2: 0.0}
    assert value("p", n=10)[1] == 0.4 and value("p", n=2)[1] == 0.5 and value("s", n=1)[1] == 0.0 and value("s", n=2)[1] == 1.0
    assert value("rankeff")[1] == round((1 + (1 - 1 / 2)) / 3, 6)
    assert value("bpref")[1] == round((1 + (1 - 1 / 2)) / 3, 6)
    ideal = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert value("ndcg")[1] == round((1 / math.log2(3) + 2 / math.log2(5)) / ideal, 6)
    r1, r2 = 1 / 16, 3 / 16
    assert value("err")[1] == round(r1 / 2 + (1 - r1) * r2 / 4, 6)
    f = lambda p: 1.0625 * p / (0.0625 * p + 1)
    assert value("magp")[1] == round((f(0.5) / 2 + (f(0.5) + f(1.0)) / 4) / 3, 6)
    assert evaluate.average_precision(evaluate.perfect_run(qrels, 10), qrels).collect() == [(1, 1.0), (2, 1.0)] or {r.value for r in evaluate.average_precision(evaluate.perfect_run(qrels, 10), qrels).collect()} == {1.0}


def test_intent_aware_metrics(spark):
    qrels = spark.createDataFrame([(1, s, d, 1, 1, 1) for s, d in ((0, 1), (0, 2), (1, 3))], "topic long, subtopic int, docid long, rel int, rel_chars long, doc_length long")
    best = spark.createDataFrame([(1, r, d, 1.0) for r, d in enumerate([1, 3, 2], 1)], "topic long, rank long, docid long, rsv double")
    poor = spark.createDataFrame([(1, r, d, 1.0) for r, d in enumerate([1, 2, 3], 1)], "topic long, rank long, docid long, rsv double")
    value = lambda run, name: evaluate.METRICS[name](run, qrels).first().value
    assert value(best, "ia-ndcg") == 1.0 and value(poor, "ia-ndcg") < 1
    assert value(best, "ia-err") > value(poor, "ia-err") > 0
    assert value(best, "ia-map") == round(((1 + 2 / 3) / 2 + 1 / 2) / 2, 6)
    assert value(best, "ia-p") == 0.5


def test_kendall_tau():
    assert evaluate.kendall_tau([1, 2, 3, 4, 5, 6, 7, 8], [2, 1, 4, 3, 6, 5, 8, 7]) == pytest.approx(0.714285714)
    assert evaluate.kendall_tau(list(range(20)), list(range(20))) == 1 and evaluate.kendall_tau(list(range(20)), list(range(20))[::-1]) == -1
    a, b = [1, 1, 2, 3, 3, 4], [2, 1, 1, 3, 4, 4]
    pairs = [(i, j) for i in range(6) for j in range(i)]
    sign = lambda x: (x > 0) - (x < 0)
    s = sum(sign(a[i] - a[j]) * sign(b[i] - b[j]) for i, j in pairs)
    assert evaluate.kendall_tau(a, b) == pytest.approx(s / math.sqrt(13 * 13))


def test_graph_and_ranks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    got = {r.node: r.rank for r in graph.pagerank(edges, 30).collect()}
    assert got["a"] > got["b"] > got["c"] == pytest.approx(0.05)
    x = {"c": 0.05}
    a = b = 1 / 3
    for _ in range(200):
        a, b = 0.05 + 0.85 * (b + x["c"]), 0.05 + 0.85 * a
    assert got["a"] == pytest.approx(a, abs=5e-3)
    frame = spark.range(1000).repartition(7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(300)))
    ranked = global_rank(frame, [F.col("k").asc(), F.col("id").asc()], "place").collect()
    assert [r.place for r in sorted(ranked, key=lambda r: (r.k, r.id))] == list(range(1, 1001))


def test_sort_keys(spark):
    frame = spark.createDataFrame([(1, "  The  Cat"), (2, "the cat!"), (3, None), (4, "Zebra"), (5, "apple 9")], "docid long, s string")
    got = {r.docid: r.pregen for r in pregen.exact_string(frame, "docid", F.col("s")).collect()}
    assert got == {3: 1, 5: 2, 1: 3, 2: 3, 4: 4}
    assert frame.select(pregen.leading_bytes(F.lit("AB"))).first()[0] == 0x41420000


def test_snippets_and_focus():
    text = "x " * 200 + "the cat sat on the mat" + " y" * 200
    assert "the cat sat on the mat" in present.best_window(text, {"cat": 1.0, "mat": 1.0}, 60)
    assert len(present.best_window(text, {"cat": 1.0}, 60)) == 60 and present.best_window("short", {"zzz": 1.0}) == "short"
    page = "<doc><p>one</p><sec><p>two cat</p><p>three cat here</p></sec></doc>"
    assert present.best_element(page, "p", {"cat": 1.0, "here": 1.0}) == "three cat here"
    a, b = present.focus_range(page, {"cat"})
    assert page[a:b] == "<p>two cat</p><p>three cat here</p>"
    assert present.focus_range(page, {"none"}) is None


def test_readability(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran!"), (2, None)], "doc_id long, text string")
    r = readability.dale_chall(docs).first()
    assert (r.words, r.sentences) == (6, 2) and r.readability == pytest.approx(1000 * (0.049 * 3 + 15.79 * r.unfamiliar / 6 + 3.6365))
    words = spark.createDataFrame([("the",), ("cat",)], "term string")
    assert readability.dale_chall(docs, words).first().unfamiliar == 3


def test_signatures_prefer_the_same_text(spark):
    docs = spark.createDataFrame([(1, "red green blue red green"), (2, "one two three four five"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    run = topsig.search_signatures(ix.build_index(docs), {1: "one two three four five".split()}, 3)
    rows = run.orderBy("rank").collect()
    assert rows[0].docid == 2 and rows[0].rsv == topsig.WIDTH


def test_topic_table_equals_listed_topics(spark, toy):
    topics = spark.createDataFrame([(1, "b c"), (2, "a d")], "topic long, text string")
    assert scores(se.search_table(toy, topics, rankers.bm25())) == scores(se.search(toy, {1: ["b", "c"], 2: ["a", "d"]}, rankers.bm25()))
