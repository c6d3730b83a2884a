"""Registered queries: every operator over the given tables, with fixed topics and parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.stem import stem
from lodestar.operators import boolean, evaluate, expand, feedback, graph, index as ix, maintain, pregen, present, rankers, readability, search as se, term_models, topsig
from lodestar.plans import nexi, topics as tp
from lodestar.sources import filters, readers
from lodestar.storage import checkpointed, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TOPICS: dict[int, list[str]] = {
    1: ["the", "und", "que"],
    2: ["par", "qui", "rent"],
    3: ["mentan", "lele", "euxeux"],
    5: ["the", "the", "of"],
    6: ["aeoifaev", "the"],
}
JUDGED = {1: TOPICS[1], 2: TOPICS[2]}
STOP = ["the", "of", "and", "de", "und", "que"]
THESAURUS = [("rent", "synonym", "par"), ("rent", "antonym", "the"), ("qui", "synonym", "und"), ("lele", "hypernym", "of"), ("mentan", "synonym", "euxeux")]
BOOLEAN = {1: "the and of", 2: "the or und", 3: "the not de", 4: "the xor of", 5: "(of AND the NOT de) or (par and qui)"}
K, DEPTH = 20, 100
PRUNE, QUANTUM, SHARDS = 10, 5, 4


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build_index(_docs(spark, sf_dir))


def _page_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    pages = _pages(spark, sf_dir).select("page_id", T.markup_text(F.col("html")).alias("text"))
    return ix.build_index(pages, "page_id")


def _terms(spark: SparkSession, terms: list[str], name: str = "term") -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], f"{name} string")


def _rank(make: Callable[[], rankers.Ranker], **kw) -> Query:
    return lambda spark, d: se.search(_index(spark, d), TOPICS, make(), K, **kw)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments from the labels: topic 1 is about quality, topic 2 about toxicity, each with two subtopics."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    grades = F.array(
        F.struct(F.lit(1).alias("topic"), F.lit(0).alias("subtopic"), (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("rel")),
        F.struct(F.lit(1).alias("topic"), F.lit(1).alias("subtopic"), F.coalesce("toxic", F.lit(0)).alias("rel")),
        F.struct(F.lit(2).alias("topic"), F.lit(0).alias("subtopic"), F.coalesce("toxic", F.lit(0)).alias("rel")),
        F.struct(F.lit(2).alias("topic"), F.lit(1).alias("subtopic"), F.coalesce("quality", F.lit(0)).alias("rel")),
    )
    rows = labels.join(docs, "doc_id", "left").withColumn("g", F.explode(grades))
    length = F.greatest(F.coalesce("n_chars", F.lit(1)), F.lit(1))
    return rows.select(F.col("g.topic").cast("long").alias("topic"), "g.subtopic", F.col("doc_id").alias("docid"), "g.rel", F.floor(length * F.col("g.rel") / 2).alias("rel_chars"), length.alias("doc_length"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(_index(spark, sf_dir), JUDGED, rankers.bm25(), DEPTH)


def _metric(name: str, **kw) -> Query:
    return lambda spark, d: evaluate.METRICS[name](_run(spark, d), qrels(spark, d), **kw)


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.tokenise(_docs(spark, sf_dir)).select(F.explode("tokens").alias("term"))
    kind = F.when(F.col("term").rlike(r"^\p{N}"), "number").otherwise("word")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.tokenise(_docs(spark, sf_dir)).select("docid", F.col("dl").cast("long").alias("dl"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.select("term", "docid", "raw", "tf")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("n", "l", F.round("adl", 6).alias("adl"))


def tag_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", F.explode(T.tag_terms(F.col("html"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("cf"), F.count_distinct("page_id").alias("df"))


def _whole(index: ix.Index) -> DataFrame:
    return index.dictionary.select("term", "cf", "df")


def page_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(_page_index(spark, sf_dir))


def index_without_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.describe(ix.build_index(_docs(spark, sf_dir), numbers=False))


def index_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.describe(ix.build_index(_docs(spark, sf_dir), stop=_terms(spark, STOP)))


def index_s_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(ix.build_index(_docs(spark, sf_dir), stemmer="s"))


def index_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("text", T.markup_text(F.col("html")))
    return _whole(ix.build_index(pages, "page_id", tags=T.tag_terms(F.col("html"))))


def facet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.lit("\u0080role:"), F.coalesce("role", F.lit("none")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = turns.select(F.explode(T.tokens(text, special=True)).alias("term")).filter(F.col("term").startswith("\u0080"))
    return rows.groupBy("term").agg(F.count("*").alias("cf"))


def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.scrub_non_ascii(F.col("text"))).alias("scrubbed"))


def filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filters.exclude(_docs(spark, sf_dir), labels.filter("toxic = 1"), "doc_id").select("doc_id", "lang")


def filter_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filters.include(_docs(spark, sf_dir), labels.filter("quality = 1"), "doc_id").select("doc_id", "lang")


def _spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.coalesce("quality", F.lit(0)) * 60 + 20 - F.coalesce("toxic", F.lit(0)) * 15).alias("score"))


def spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_spam(_docs(spark, sf_dir), _spam(spark, sf_dir), "doc_id", 70).select("doc_id")


def ham_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_spam(_docs(spark, sf_dir), _spam(spark, sf_dir), "doc_id", 30).select("doc_id")


def mime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit(""), F.lit("Content-Type: text/html\n\n"), F.lit("Server: x\nContent-type: image/png\n\n")), F.pmod(F.col("page_id"), F.lit(3)).cast("int") + 1)
    return filters.textual(_pages(spark, sf_dir).withColumn("body", F.concat(kinds, "html"))).select("page_id")


def rank_lmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return se.search(i, TOPICS, rankers.lmp(), K, doc_values=term_models.discounted_lengths(i))


def rank_lmptfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return se.search(i, TOPICS, rankers.lmptfidf(), K, doc_values=term_models.tfidf_lengths(i))


def rank_bm25t(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    terms = sorted({t for ts in TOPICS.values() for t in ts})
    return se.search(i, TOPICS, rankers.bm25t(), K, term_values=F.broadcast(term_models.bm25t_k1(i, terms)))


def rank_bm25adpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    terms = sorted({t for ts in TOPICS.values() for t in ts})
    return se.search(i, TOPICS, rankers.bm25adpt(), K, term_values=F.broadcast(term_models.bm25adpt_k1(i, terms)))


def rank_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = readability.dale_chall(_docs(spark, sf_dir)).select("docid", "readability")
    return se.search(_index(spark, sf_dir), TOPICS, rankers.readable(), K, doc_values=values)


def rank_pregen(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _docs(spark, sf_dir).select(F.col("doc_id").alias("docid"), pregen.integer(F.col("n_chars")).cast("double").alias("pregen"))
    return se.search(_index(spark, sf_dir), TOPICS, rankers.pregen(), K, doc_values=values)


def rank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [t for ts in TOPICS.values() for t in ts]
    return se.search(maintain.quantised(_index(spark, sf_dir), rankers.bm25(), terms=terms), TOPICS, rankers.impact(), K)


def rank_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    terms = [t for ts in TOPICS.values() for t in ts]
    scored = se.score(se.candidates(i, se.query_table(i, TOPICS), terms), rankers.bm25())
    static = _docs(spark, sf_dir).select(F.col("doc_id").alias("docid"), pregen.integer(F.col("n_chars")).cast("double").alias("pregen"))
    return se.top(se.blend(scored, static, 0.7), K)


def topk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.page(se.search(_index(spark, sf_dir), TOPICS, rankers.divergence(), K), 6, 15)


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.hits(_index(spark, sf_dir), TOPICS)


def topic_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query: topics that no driver list holds."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("topic"), "text")
    return se.search_table(_index(spark, sf_dir), items, rankers.bm25(), 5)


def nexi_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = nexi.parse("//article[about(.//p, the +und -que) and .//year > 2000]//p[about(., rent)]")
    return se.search(_index(spark, sf_dir), {1: [t.text for t in terms]}, rankers.divergence(), K)


def stop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stopped = {k: tp.stop(v, tuple(STOP), numbers=True, short=True) for k, v in TOPICS.items()}
    return se.search(_index(spark, sf_dir), stopped, rankers.bm25(), K)


def _boolean(topic: int) -> Query:
    return lambda spark, d: boolean.matching(_index(spark, d), BOOLEAN[topic])


def boolean_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_boolean(_index(spark, sf_dir), BOOLEAN, rankers.bm25(), K)


def static_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.static_prune(_index(spark, sf_dir), PRUNE).select("term", "docid", "tf")


def quantum_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.quantum_prune(_index(spark, sf_dir), QUANTUM).select("term", "docid", "tf")


def search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return se.search(maintain.with_postings(i, maintain.static_prune(i, DEPTH)), TOPICS, rankers.bm25(), K)


def cull_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.cull_singletons(_index(spark, sf_dir))


def cull_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.cull_rare(_index(spark, sf_dir), 5)


def cull_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.cull_frequent(_index(spark, sf_dir), 0.1)


def cull_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.cull_stopped(_index(spark, sf_dir), _terms(spark, STOP))


def quantize_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.impacts(_index(spark, sf_dir), rankers.bm25()).select("term", "docid", "impact")


def quantize_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maintain.impacts(_index(spark, sf_dir), rankers.divergence(), None)
    return rows.groupBy("impact").agg(F.count("*").alias("postings"))


def merge_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.merge(maintain.shards(_index(spark, sf_dir), SHARDS)).dictionary


def broker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.broker([se.search(s, TOPICS, rankers.bm25(), K) for s in maintain.shards(_index(spark, sf_dir), SHARDS)], K)


def stem_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary.select("term", stem(F.col("term"), "s").alias("stem"))


def _stemmed(name: str) -> Query:
    return lambda spark, d: _index(spark, d).dictionary.select("term", stem(F.col("term"), name).alias("stem"))


def _conflate(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = _index(spark, sf_dir)
        return expand.search_conflated(i, TOPICS, expand.variants_by_stem(i, [t for ts in TOPICS.values() for t in ts], name), rankers.bm25(), K)

    return run


def _thesaurus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THESAURUS, "term string, relationship string, related string")


def thesaurus_inplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    variants = expand.variants_by_thesaurus(i, [t for ts in TOPICS.values() for t in ts], _thesaurus(spark))
    return expand.search_conflated(i, TOPICS, variants, rankers.bm25(), K)


def thesaurus_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(_index(spark, sf_dir), expand.thesaurus_terms(TOPICS, THESAURUS), rankers.bm25(), K)


def term_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return expand.term_similarity(i, expand.variants_by_stem(i, ["rent", "mentan", "lele", "qui"], "s"))


def similarity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    near = expand.similar_variants(i, [t for ts in TOPICS.values() for t in ts], "s", 0.02)
    return expand.search_conflated(i, TOPICS, near, rankers.bm25(), K)


def similarity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    near = expand.similar_variants(i, [t for ts in TOPICS.values() for t in ts], "s", 0.0)
    return expand.search_conflated(i, TOPICS, near, rankers.bm25(), K, weight="similarity")


def feedback_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.blind_kl(_index(spark, sf_dir), JUDGED, rankers.bm25(), K)


def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return feedback.divergent_terms(i, se.search(i, TOPICS, rankers.bm25(), 17).select("topic", "docid"), 5)


def feedback_rm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.relevance_model(_index(spark, sf_dir), JUDGED, K)


def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.more_like_this(_index(spark, sf_dir), [0, 1, 2, 3, 4], 10)


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return feedback.rerank(i, se.search(i, TOPICS, rankers.bm25(), 50), TOPICS, rankers.lmds(), 50)


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return evaluate.run_correlation(se.search(i, JUDGED, rankers.bm25(), DEPTH), se.search(i, JUDGED, rankers.divergence(), DEPTH))


def eval_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bundle(_run(spark, sf_dir), qrels(spark, sf_dir), ["map", "p", "s", "bpref", "ndcg"])


def perfect_run_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qrels(spark, sf_dir)
    return evaluate.average_precision(evaluate.perfect_run(q, 100_000_000), q)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links(_pages(spark, sf_dir)).select("src", "place", "dst")


def inlink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inlinks(graph.neighbour_links(_pages(spark, sf_dir)))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(graph.neighbour_links(_pages(spark, sf_dir)), 3)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


def pregen_exact_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pregen.exact_string(_pages(spark, sf_dir), "page_id", F.col("url"))


def pregen_exact_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pregen.exact_integer(_docs(spark, sf_dir), "doc_id", F.col("n_chars"))


def pregen_leading_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("docid"), pregen.leading_bytes(F.col("text")).alias("pregen"))


def pregen_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    base = docs.select(F.col("doc_id").alias("docid"), pregen.integer(F.col("n_chars")).alias("pregen"))
    return pregen.ordering_check(base, base.select("docid", F.floor(F.col("pregen") / 10).alias("pregen")))


def readability_dale_chall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.dale_chall(_docs(spark, sf_dir))


def weighted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.weighted_tags(_pages(spark, sf_dir), {"title": 5, "h1": 3})


def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.title_terms(_pages(spark, sf_dir))


def snippet_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", present.tag_snippet(F.col("html"), "title").alias("snippet"))


def snippet_beginning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", present.beginning_snippet(F.col("html"), "h1").alias("snippet"))


def _shown(spark: SparkSession, sf_dir: str, column: str) -> tuple[ix.Index, DataFrame]:
    if column == "html":
        i, rows = _page_index(spark, sf_dir), _pages(spark, sf_dir).select(F.col("page_id").alias("docid"), "html")
    else:
        i, rows = _index(spark, sf_dir), _docs(spark, sf_dir).select(F.col("doc_id").alias("docid"), "text")
    run = se.search(i, {1: ["the", "of", "that"]}, rankers.bm25(), K)
    return i, present.named(run, rows, column)


def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, top = _shown(spark, sf_dir, "text")
    weights = present.query_weights(i.dictionary, i.stats, ["the", "of", "that"], icf=True)
    return present.window_snippets(top, weights).select("topic", "rank", "docid", "snippet")


def snippet_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, top = _shown(spark, sf_dir, "html")
    return present.element_snippets(top, "p", dict.fromkeys(["the", "of", "that"], 1.0)).select("topic", "rank", "docid", "snippet")


def focus_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, top = _shown(spark, sf_dir, "html")
    return present.focused(top, ["the", "of", "that"]).select("topic", "rank", "docid", "focus_start", "focus_end")


def word_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.word_cloud(feedback.more_like_this(_index(spark, sf_dir), [0, 1, 2, 3, 4], 20))


def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.trec_lines(se.search(_index(spark, sf_dir), TOPICS, rankers.bm25(), K), "lodestar")


def inex_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.inex_lines(se.search(_index(spark, sf_dir), TOPICS, rankers.bm25(), 5), "lodestar")


def hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.hit_elements(se.search(_index(spark, sf_dir), TOPICS, rankers.bm25(), 5))


def topsig_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topsig.search_signatures(_index(spark, sf_dir), TOPICS, K)


def topsig_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    stored = checkpointed(topsig.signed(i))
    return topsig.feedback_signatures(i, topsig.search_signatures(i, JUDGED, K, stored=stored), 5, K, stored=stored)


RANKED: dict[str, Callable[[], rankers.Ranker]] = {
    "bm25": rankers.bm25,
    "bm25l": rankers.bm25l,
    "bm25plus": rankers.bm25plus,
    "tflodop": rankers.tflodop,
    "lmd": rankers.lmd,
    "lmds": rankers.lmds,
    "lmjm": rankers.lmjm,
    "divergence": rankers.divergence,
    "be": rankers.bose_einstein,
    "dlh13": rankers.dlh13,
    "dph": rankers.dph,
    "dfree": rankers.dfree,
    "dfi": rankers.dfi,
    "dfiw": rankers.dfiw,
    "dfi_idf": rankers.dfi_idf,
    "dfiw_idf": rankers.dfiw_idf,
    "tfidf": rankers.tfidf,
    "kbtfidf": rankers.kbtfidf,
    "termcount": rankers.term_count,
    "docid": rankers.docid,
}


def _written(lines: DataFrame, name: str, **options: str) -> str:
    """Folder of text files with the one column of ``lines``, written where driver and executors share it."""
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.options(**options).text(path)
    return path


def _one_line(text: str = "text"):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\r]", " ")


def _digests(read: DataFrame) -> DataFrame:
    return read.select("name", F.md5("body").alias("body_md5"))


def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as lines of name, tab and text, written and read back scrubbed."""
    lines = _docs(spark, sf_dir).filter("doc_id is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), _one_line()))
    return _digests(readers.read_tsv(spark, _written(lines, "tsv")))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as lines, compressed; each line is its own name."""
    lines = readers.read_lines(spark, _written(_docs(spark, sf_dir).select(_one_line()), "lines", compression="gzip"))
    return lines.select(F.md5("name").alias("name_md5"), F.md5("body").alias("body_md5"))


def read_trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in tags, written and read back record by record."""
    tagged = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), F.coalesce("text", F.lit("")), F.lit("\n</DOC>"))
    return _digests(readers.read_trec(spark, _written(_docs(spark, sf_dir).filter("doc_id is not null").select(tagged), "trec")))


def read_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as response records of compressed web archives."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://host/"), F.col("page_id").cast("string"), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    records = _pages(spark, sf_dir).filter("page_id is not null").select(F.concat(head, html, F.lit("\r\n\r\n")))
    return _digests(readers.read_warc(spark, _written(records, "warc", compression="gzip")))


def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that was written as tables bucketed by term and loaded again."""
    name = f"stored_{uuid.uuid4().hex}"
    ix.write_index(_index(spark, sf_dir), name, 16)
    return se.search(ix.load_index(spark, name), TOPICS, rankers.bm25(), K)


def queries() -> dict[str, Query]:
    plain = [
        read_tsv, read_lines, read_trec, read_warc, search_stored,
        tokenize, doc_lengths, postings, dictionary, collection_stats, tag_terms, page_dictionary, index_without_numbers, index_stopped, index_s_stemmed, index_tagged, facet_terms, scrub, filter_exclude, filter_include, spam_filter, ham_filter, mime_filter,
        rank_lmp, rank_lmptfidf, rank_bm25t, rank_bm25adpt, rank_readable, rank_pregen, rank_impact, rank_blended, topk_page, hit_counts, topic_table_search, nexi_cas, stop_query, boolean_ranked, static_prune, quantum_prune, search_pruned, cull_singletons, cull_rare, cull_frequent, cull_stopped,
        quantize_bm25, quantize_by_size, merge_indexes, broker_merge, stem_s, thesaurus_inplace, thesaurus_expand, term_similarity, similarity_threshold, similarity_weighted, feedback_kl, feedback_terms, feedback_rm, more_like_this, rerank_topk, kendall_tau, eval_bundle, perfect_run_map, page_links, inlink_count, pagerank,
        pregen_exact_string, pregen_exact_integer, pregen_leading_bytes, pregen_ordering, readability_dale_chall, weighted_tags, title_terms, snippet_title, snippet_beginning, snippet_window, snippet_element, focus_range, word_cloud, trec_run, inex_run, hit_list, topsig_search, topsig_feedback,
    ]
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {f"rank_{name}": _rank(make) for name, make in RANKED.items()}
    out["rank_allterms"] = _rank(rankers.term_count, all_terms=True)
    out |= {f"boolean_{name}": _boolean(topic) for topic, name in enumerate(("and", "or", "not", "xor", "nested"), 1)}
    out |= {"eval_map": _metric("map"), "eval_magp": _metric("magp"), "eval_p_at_10": _metric("p"), "eval_s_at_10": _metric("s"), "eval_rankeff": _metric("rankeff"), "eval_bpref": _metric("bpref"), "eval_bpref10": _metric("bpref", m=10), "eval_dcg": _metric("dcg"), "eval_ndcg": _metric("ndcg"), "eval_ndcg_exponential": _metric("ndcg", exponential=True), "eval_err": _metric("err")}
    out |= {"eval_ia_map": _metric("ia-map"), "eval_ia_p": _metric("ia-p"), "eval_ia_err": _metric("ia-err"), "eval_ia_ndcg": _metric("ia-ndcg")}
    out |= {f"stem_{name}": _stemmed(name) for name in ("porter", "english", "german", "lancaster", "soundex", "metaphone")}
    out |= {f"conflate_{name}": _conflate(name) for name in ("s", "porter", "soundex")}
    out["dictionary_range"] = lambda spark, d: ix.dictionary_range(_index(spark, d), "m", "n")
    out["list_terms"] = lambda spark, d: ix.list_terms(_index(spark, d), "par", 25)
    out["zipf"] = lambda spark, d: ix.zipf(_index(spark, d), 100)
    out["describe_index"] = lambda spark, d: ix.describe(_index(spark, d))
    return out
