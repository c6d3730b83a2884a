"""The session answers as the operators that it stands for."""

from __future__ import annotations

import pytest

from lodestar.operators import index as ix, rankers, search as se
from lodestar.session import SearchSession

TEXTS = [(0, "red cat red"), (1, "cats and dogs"), (2, "blue dog"), (3, "red dog cat"), (4, "feline blue")]


@pytest.fixture
def session(spark):
    return SearchSession(ix.build_index(spark.createDataFrame(TEXTS, "doc_id long, text string")))


def found(run):
    return [(r.topic, r.docid) for r in run.orderBy("topic", "rank").collect()]


def test_modes(session):
    assert found(session.search("red cat")) == [(1, r.docid) for r in se.search(session.index, {1: ["red", "cat"]}, rankers.divergence(), 10).orderBy("rank").collect()]
    assert {d for _, d in found(session.search("red AND dog", mode="boolean"))} == {3}
    assert {d for _, d in found(session.search("red or dog", mode="boolean"))} == {0, 2, 3}
    assert {d for _, d in found(session.search("red dog", mode="all"))} == {3}
    assert len(found(session.search({1: "red", 2: "dog"}, k=1))) == 2
    assert found(session.search("blue dog", mode="topsig"))[0][1] == 2


def test_settings(session, tmp_path):
    session.stemmer = "s"
    assert {d for _, d in found(session.search("cat"))} == {0, 1, 3}
    session.stemmer, session.thesaurus = "none", [("cat", "synonym", "feline")]
    assert {d for _, d in found(session.search("cat"))} == {0, 3, 4}
    session.expand_query = True
    assert session.parse("cat") == ["cat", "feline"]
    session.thesaurus, session.expand_query, session.stop_words = [], False, ("and",)
    assert session.parse("cats AND and dogs") == ["cats", "AND", "dogs"]
    session.ranker = rankers.ranker("bm25:1.1:0.3")
    for kind in ("kl", "rm", "topsig"):
        session.feedback, session.feedback_documents, session.feedback_terms = kind, 2, 1
        assert found(session.search("red"))
    session.feedback, session.prune_k = None, 1
    assert len(found(session.search("dog"))) == 1


def test_other_requests(session, spark, tmp_path):
    run = session.search({1: "red dog"}, k=4)
    session.qrels = spark.createDataFrame([(1, 0, 3, 1)], "topic long, subtopic int, docid long, rel int")
    assert {r.metric: r.topics for r in session.evaluate(run, ["map", "p"]).collect()} == {"map": 1, "p": 1}
    assert session.rerank(run, {1: "red dog"}, 2).count() == 2
    assert session.document(2).first().dl == 2 and session.describe().first().documents == 5
    assert [r.term for r in session.terms("d", 2).orderBy("term").collect()] == ["dog", "dogs"]
    assert session.more_like(4, 1).first().docid == 4 and session.normalise("Red  CATS") == "red CATS"
    session.write_run(run, f"{tmp_path}/run", "me")
    assert spark.read.text(f"{tmp_path}/run").count() == run.count()
    session.qrels = None
    with pytest.raises(ValueError):
        session.evaluate(run, ["map"])
