"""A search session over one index: choose rankers, stemming, feedback and stop words, and ask queries as texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import boolean, evaluate, expand, feedback, index as ix, maintain, present, rankers, search as se, topsig
from lodestar.plans import boolean_query, nexi, topics as tp


@dataclass
class SearchSession:
    """Settings are plain attributes; every answer is a DataFrame ``topic, rank, docid, rsv``.

    ``feedback`` is None, "kl", "rm" or "topsig"; ``thesaurus`` holds (term, relationship, related) and is used in
    place of a term's own postings, or as extra query terms with ``expand_query``.
    """

    index: ix.Index
    ranker: rankers.Ranker = field(default_factory=rankers.divergence)
    feedback: str | None = None
    feedback_ranker: rankers.Ranker | None = None
    feedback_documents: int = 10
    feedback_terms: int = 10
    feedback_lambda: float = 0.5
    stemmer: str = "none"
    thesaurus: list[tuple[str, str, str]] = field(default_factory=list)
    relationships: tuple[str, ...] = ("synonym",)
    expand_query: bool = False
    stop_words: tuple[str, ...] = ()
    prune_k: int | None = None
    doc_values: DataFrame | None = None
    qrels: DataFrame | None = None

    @classmethod
    def load(cls, spark, name: str, **settings) -> SearchSession:
        """A session over a stored index."""
        return cls(ix.load_index(spark, name), **settings)

    def normalise(self, query: str) -> str:
        """The query as its terms are looked up."""
        return " ".join(t.text for t in nexi.parse(query))

    def parse(self, query: str) -> list[str]:
        terms = [t.text for t in nexi.parse(query)]
        if self.stop_words:
            terms = tp.stop(terms, self.stop_words)
        if self.expand_query:
            terms = expand.thesaurus_terms({0: terms}, self.thesaurus, self.relationships)[0]
        return terms

    def _index(self) -> ix.Index:
        return self.index if self.prune_k is None else maintain.with_postings(self.index, maintain.static_prune(self.index, self.prune_k))

    def search(self, queries: str | dict[int, str], k: int = 10, mode: str = "ranked") -> DataFrame:
        """One query, or many by topic; ``mode`` is "ranked", "boolean", "all" (every term) or "topsig"."""
        asked = {1: queries} if isinstance(queries, str) else queries
        index = self._index()
        if mode == "boolean":
            trees = {t: boolean_query.parse(q) for t, q in asked.items()}
            if not all(boolean_query.disjunctive(t) for t in trees.values()):
                return boolean.search_boolean(index, asked, self.ranker, k)
            return self._ranked(index, {t: boolean_query.leaves(tree) for t, tree in trees.items()}, k)
        terms = {t: self.parse(q) for t, q in asked.items()}
        if mode == "topsig":
            return topsig.search_signatures(index, terms, k)
        if mode == "all":
            return se.search(index, terms, self.ranker, k, doc_values=self.doc_values, all_terms=True)
        return self._ranked(index, terms, k)

    def _ranked(self, index: ix.Index, terms: dict[int, list[str]], k: int) -> DataFrame:
        flat = [t for ts in terms.values() for t in ts]
        if self.stemmer != "none":
            return expand.search_conflated(index, terms, expand.variants_by_stem(index, flat, self.stemmer), self.ranker, k)
        if self.thesaurus and not self.expand_query:
            table = index.spark.createDataFrame(self.thesaurus, "term string, relationship string, related string")
            return expand.search_conflated(index, terms, expand.variants_by_thesaurus(index, flat, table, self.relationships), self.ranker, k)
        if self.feedback == "kl":
            return feedback.blind_kl(index, terms, self.ranker, k, self.feedback_documents, self.feedback_terms, self.feedback_ranker)
        if self.feedback == "rm":
            return feedback.relevance_model(index, terms, k, self.feedback_documents, lam=self.feedback_lambda)
        run = se.search(index, terms, self.ranker, max(k, self.feedback_documents), doc_values=self.doc_values)
        if self.feedback == "topsig":
            return topsig.feedback_signatures(index, run, self.feedback_documents, k)
        return run.filter(F.col("rank") <= k)

    def rerank(self, run: DataFrame, queries: dict[int, str], k: int) -> DataFrame:
        return feedback.rerank(self.index, run, {t: self.parse(q) for t, q in queries.items()}, self.ranker, k)

    def evaluate(self, run: DataFrame, metrics: list[str]) -> DataFrame:
        """Means of metrics against the session's assessments."""
        if self.qrels is None:
            raise ValueError("the session has no assessments")
        return evaluate.bundle(run, self.qrels, metrics)

    def document(self, docid) -> DataFrame:
        return self.index.docs.filter(F.col("docid") == docid)

    def more_like(self, docid: int, n: int = 10) -> DataFrame:
        return feedback.more_like_this(self.index, [docid], n)

    def describe(self) -> DataFrame:
        return ix.describe(self.index)

    def terms(self, after: str, n: int = 10) -> DataFrame:
        return ix.list_terms(self.index, after, n)

    def write_run(self, run: DataFrame, path: str, run_id: str) -> None:
        present.write_run(present.trec_lines(run, run_id), path)
