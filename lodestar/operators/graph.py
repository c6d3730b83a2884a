"""Link graphs: extraction, in-link counts and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import checkpointed

DAMPING = 0.85
#: Iterations after which lineage is cut.
CUT = 5


def links(pages: DataFrame, source: str = "page_id", html: str = "html") -> DataFrame:
    """``src, dst``: targets of the anchors of every page, in the order of the page, repeated ones kept."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return pages.select(F.col(source).alias("src"), F.posexplode(found).alias("place", "dst"))


def neighbour_links(pages: DataFrame) -> DataFrame:
    """``src, dst`` distinct: a page stands for the first address it links to, and links to its others."""
    named = links(pages)
    home = named.filter("place = 0").select(F.col("src").alias("page"), F.col("dst").alias("home"))
    return named.filter("place > 0").join(home, F.col("src") == F.col("page")).filter("home <> dst").select(F.col("home").alias("src"), "dst").distinct()


def inlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("inlinks"))


def pagerank(edges: DataFrame, iterations: int, damping: float = DAMPING) -> DataFrame:
    """``node, rank`` after a number of iterations from an even start; what nodes without out-links hold is lost.

    Every iteration is a join on the source and an aggregate with partial sums on the destination; hot
    destinations are summed map-side and hot sources' out-link rows are split by adaptive skew joins.
    """
    nodes = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    total = nodes.agg(F.count("*").cast("double").alias("total"))
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = checkpointed(edges.join(degree, "src").select("src", "dst", "out"))
    ranks = nodes.crossJoin(F.broadcast(total)).select("node", (1 / F.col("total")).alias("rank"))
    for i in range(iterations):
        given = weighted.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        ranks = nodes.join(given, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(total)).select("node", ((1 - damping) / F.col("total") + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if (i + 1) % CUT == 0 and i + 1 < iterations:
            ranks = checkpointed(ranks)
    return ranks
