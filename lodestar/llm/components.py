"""Connected components by alternating large-star and small-star steps; every step is a join and an aggregate.

Up to ONE_TASK links, a counted bound of 16 MB, are joined by one task instead of in rounds of shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch

ONE_TASK = 1 << 20


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = [x for x in parent if root(x) != x]
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every node of ``edges`` (u, v: long) but the roots; root is the smallest id reachable.

    Links stay distributed; the driver sees a count and a checksum of each round. Rounds grow with the
    logarithm of a component's size.
    """
    cur = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if cur.count() <= ONE_TASK:
        out = scratch.table(cur.coalesce(1).mapInArrow(_joined, "id long, root long"), "roots")
        scratch.drop(cur)
        return out
    return in_rounds(cur)


def in_rounds(cur: DataFrame) -> DataFrame:
    """The same for links in a table, each once and with u > v, however many there are."""
    before = None
    while (now := _signature(cur)) != before:
        if not now[0]:
            break
        before = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        done, cur = cur, scratch.table(small, "links")
        scratch.drop(done)
        scratch.release(cur.sparkSession)
    roots = scratch.table(cur.select(F.col("u").alias("id"), F.col("v").alias("root")), "roots")
    scratch.drop(cur)
    return roots
