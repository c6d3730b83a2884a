"""Document-set algebra in one pass: flags of a document's terms, then one Boolean expression over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.index import Index, restricted
from lodestar.operators.rankers import Ranker
from lodestar.operators.search import candidates, query_table, score, top
from lodestar.plans.boolean_query import Leaf, Tree, leaves, parse


def _expression(tree: Tree, flags: dict[str, Column]) -> Column:
    if isinstance(tree, Leaf):
        return flags[tree.term]
    a, b = _expression(tree.left, flags), _expression(tree.right, flags)
    return {"and": a & b, "or": a | b, "not": a & ~b, "xor": a != b}[tree.operator]


def matching(index: Index, query: str | Tree, default: str = "or") -> DataFrame:
    """``docid`` of the documents that satisfy the query; each of them holds at least one of its terms."""
    tree = parse(query, default) if isinstance(query, str) else query
    names = sorted(set(leaves(tree)))
    flags = {t: F.col(f"_t{i}") for i, t in enumerate(names)}
    found = restricted(index, names).postings.groupBy("docid").agg(*(F.max(F.col("term") == t).alias(f"_t{i}") for i, t in enumerate(names)))
    return found.filter(_expression(tree, flags)).select("docid")


def search_boolean(index: Index, topics: dict[int, str], ranker: Ranker, k: int = 20, default: str = "or") -> DataFrame:
    """Documents of each topic's query ranked by all of its terms, those under "not" included."""
    trees = {topic: parse(q, default) for topic, q in topics.items()}
    terms = {topic: leaves(t) for topic, t in trees.items()}
    scored = score(candidates(index, query_table(index, terms), [t for ts in terms.values() for t in ts]), ranker)
    valid = reduce(DataFrame.unionByName, (matching(index, t).withColumn("topic", F.lit(topic).cast("long")) for topic, t in trees.items()))
    return top(scored.join(valid, ["topic", "docid"], "left_semi"), k)
