"""Links between the rows of hash buckets, without all pairs of a bucket.

A row is (key, node, n, sketch). Each row is first compared with its bucket's first row and with the one
before it in order of n. Links that are confirmed are joined into components; then the rows of buckets
that still hold several components are compared across components by their sketches. Where a block has few likely
pairs for its rows (``few``), these pairs come out and are confirmed one by one. Elsewhere it is
not the likely pairs but a forest that spans them, first of a share of the buckets, block by block, and then
of all, where nodes of one tree are joined no more; so a group that many buckets or blocks hold comes out
few times. Its trees are clusters, and the contents of a cluster's
nodes meet once, a large cluster in pairs of blocks dealt to different tasks, to be compared in full.
Rows of the commonest component or tree of a key have nothing to find among themselves: their blocks meet only
those of the other rows. A task gives only links that join what it had not joined yet. No pair that could join
two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.components import components
from lodestar.llm.textcore import returning

#: Rows of a bucket or cluster that one task compares at once on one side, and bytes of their contents.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: One bucket in so many is spanned first.
FIRST = 8
#: (n1, sketch1, n2, sketch2) to whether a pair is worth confirming.
Likely = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Whether two nodes' contents make a link.
Agrees = Callable[[bytes, bytes], bool]
#: Nodes (one column ``node``) to ``node, content binary``; a node may have several contents.
Fetch = Callable[[DataFrame], DataFrame]
#: What is known of contents at a glance, and whether one of them could agree with others by that.
Glance = Callable[[list[bytes]], np.ndarray]
May = Callable[[np.ndarray, int, np.ndarray], np.ndarray]
#: Which pairs of two lists of contents make links.
Every = Callable[[list[bytes], list[bytes]], np.ndarray]
#: Pairs that are confirmed at once, and bytes of their contents.
AT_ONCE, AT_ONCE_BYTES = 8192, 12 << 20
ROWS = "key long, node long, n int, sketch long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has too; rows come in order of key."""
    tail: pa.RecordBatch | None = None
    tail_met = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[:-1] | same[1:]
        joins = tail is not None and tail.column(0)[0].as_py() == key[0]
        if joins:
            keep[0] = True
        if tail is not None and (joins or tail_met):
            yield tail
        last = len(key) - 1
        tail, tail_met = batch.slice(last), bool(keep[last])
        keep[last] = False
        yield batch.filter(pa.array(keep))
    if tail is not None and tail_met:
        yield tail


def _neighbours(likely: Likely, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row to its bucket's first row and to the row before; rows come in order of key, n, node."""
    last = first = None
    for batch in batches:
        key, node, n, sketch = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(key):
            continue
        if last is not None:
            key, node, n, sketch = (np.concatenate([[a, b], c]) for a, b, c in zip(first, last, (key, node, n, sketch)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        hub = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        me = np.arange(len(key))
        u, v = [], []
        for other in (hub, np.maximum(me - 1, hub)):
            at = np.flatnonzero((other < me) & (node[other] != node))
            at = at[likely(n[at], sketch[at], n[other[at]], sketch[other[at]])]
            u.append(np.maximum(node[at], node[other[at]]))
            v.append(np.minimum(node[at], node[other[at]]))
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
        first = tuple(x[hub[-1]] for x in (key, node, n, sketch))
        last = tuple(x[-1] for x in (key, node, n, sketch))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Stretches of rows that agree in ``names``; rows come in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ident = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names])
        edges = [0, *(np.flatnonzero((ident[:, 1:] != ident[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(ident[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _pairs(u: list[int], v: list[int]) -> pa.RecordBatch:
    a, b = np.array(u, np.int64), np.array(v, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def _across(likely: Likely, batches: Iterator[pa.RecordBatch], few: int = 0) -> Iterator[pa.RecordBatch]:
    """The likely links between different components and trees of a block pair, if ``few`` for each row at most; else, marked ``dense``, a forest over them.

    ``tree`` names the tree that a node is in already; one that is in none has a tree of its own.
    """

    def found(u: np.ndarray, v: np.ndarray, dense: bool) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(pairs.shape[1], dense))], names=["u", "v", "dense"])

    for rows in _groups(batches, ("key", "i", "j")):
        node, n, sketch, comp, side = (rows[c].to_numpy() for c in ("node", "n", "sketch", "comp", "side"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        tree = np.unique(rows["tree"].to_numpy(), return_inverse=True)[1]

        def met(at: int) -> np.ndarray:
            i, j = left[at : at + 256, None], right[None, :]
            return (comp[i] != comp[j]) & (tree[i] != tree[j]) & likely(n[i], sketch[i], n[j], sketch[j])

        u, v, pairs = [], [], 0
        for at in range(0, len(left) if few else 0, 256):
            a, b = np.nonzero(met(at))
            a, b = left[at + a], right[b]
            once = (side[a] != side[b]) | (b > a)
            u.append(node[a[once]])
            v.append(node[b[once]])
            pairs += len(u[-1])
            if pairs > few * len(node):
                break
        if pairs <= few * len(node) and few:
            if pairs:
                yield found(np.concatenate(u), np.concatenate(v), False)
            continue
        u, v = [], []
        for at in range(0, len(left), 256):
            ok = met(at)
            for row in np.flatnonzero(ok.any(axis=1)).tolist():
                a = left[at + row]
                others = right[ok[row]]
                trees, first = np.unique(tree[others], return_index=True)
                new = trees != tree[a]
                if new.any():
                    u += [node[a]] * int(new.sum())
                    v += node[others[first[new]]].tolist()
                    tree[np.isin(tree, trees[new])] = tree[a]
        yield found(np.array(u, np.int64), np.array(v, np.int64), True)


def _settle(likely: Likely, agrees: Agrees, glance: Glance | None, may: May | None, every: Every | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components of a block pair of a cluster, the likeliest pairs tried first.

    With ``every``, ``agrees`` may say no where it isn't sure; then a row's pairs from the first such on wait to be compared with those of other rows and blocks.
    """
    waiting: list[tuple[np.ndarray, np.ndarray, list[bytes], int, int]] = []
    size = 0

    def together() -> pa.RecordBatch:
        open_ = [x for x in waiting if x[1][x[3]] != x[1][x[4]]]
        waiting.clear()
        u, v = [], []
        for (node, comp, _, a, b), ok in zip(open_, every([x[2][x[3]] for x in open_], [x[2][x[4]] for x in open_])):
            if ok and comp[a] != comp[b]:
                u.append(node[a])
                v.append(node[b])
                comp[comp == comp[b]] = comp[a]
        return _pairs(u, v)

    for rows in _groups(batches, ("key", "i", "j")):
        node, n, sketch, comp, side = (rows[c].to_numpy() for c in ("node", "n", "sketch", "comp", "side"))
        content = rows["content"].to_pylist()
        seen = glance(content) if glance else None
        comp, u, v = comp.copy(), [], []
        right = np.flatnonzero(side != 0)
        for a in np.flatnonzero(side != 1).tolist():
            other = right[(comp[right] != comp[a]) & ((side[right] != side[a]) | (right > a))]
            other = other[likely(n[a : a + 1], sketch[a : a + 1], n[other], sketch[other])]
            if may and len(other):
                other = other[may(seen, a, other)]
            other = other[np.argsort(np.bitwise_count((sketch[other] ^ sketch[a]).view(np.uint64)), kind="stable")].tolist()
            for k, b in enumerate(other):
                if comp[a] == comp[b]:
                    continue
                if agrees(content[a], content[b]):
                    u.append(node[a])
                    v.append(node[b])
                    comp[comp == comp[b]] = comp[a]
                elif every:
                    later = [x for x in other[k:] if comp[x] != comp[a]]
                    waiting += [(node, comp, content, a, x) for x in later]
                    size += sum(len(content[a]) + len(content[x]) for x in later)
                    break
            if len(waiting) >= AT_ONCE or size >= AT_ONCE_BYTES:
                yield together()
                size = 0
        yield _pairs(u, v)
    if waiting:
        yield together()


def _confirmed(agrees: Agrees, every: Every | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.array([agrees(x, y) for x, y in zip(a, b)], bool)
            if every:
                open_ = np.flatnonzero(~keep).tolist()
                keep[open_] = every([a[k] for k in open_], [b[k] for k in open_])
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _links(pairs: DataFrame, fetch: Fetch, agrees: Agrees, every: Every | None) -> DataFrame:
    """The pairs whose contents agree, written."""
    content = scratch.table(fetch(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "bucket-contents")
    both = pairs.join(content.select(F.col("node").alias("v"), F.col("content").alias("b")), "v").join(content.select(F.col("node").alias("u"), F.col("content").alias("a")), "u")
    links = scratch.table(both.select("u", "v", "a", "b").mapInArrow(returning(partial(_confirmed, agrees, every)), "u long, v long").distinct(), "bucket-links")
    scratch.drop(content)
    return links


def _sized(rows: DataFrame, sizes: DataFrame, label: str, weight: Column) -> DataFrame:
    """``key, main, blocks, less`` of the keys in ``sizes``, whose rows are placed in several blocks (their ``size`` counts blocks).

    ``main`` is the commonest label of a key, with so many blocks; all other rows are in ``less`` blocks.
    """
    large = rows.join(sizes.filter("size > 1").select("key"), "key", "left_semi").groupBy("key", label).agg(F.count("*").alias("n"), weight.alias("size"))
    parted = large.groupBy("key").agg(F.max(F.struct("n", "size", F.col(label).alias("main"))).alias("top"), F.sum("size").alias("size"))
    blocks = lambda size: F.greatest(F.ceil(size), F.lit(1)).cast("int")
    parted = parted.select("key", F.col("top.main").alias("main"), blocks(F.col("top.size")).alias("blocks"), blocks(F.col("size") - F.col("top.size")).alias("less"))
    return sizes.filter("size <= 1").select("key", F.lit(None).cast("long").alias("main"), F.lit(0).alias("blocks"), F.lit(1).alias("less")).unionByName(parted)


def _dealt(rows: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """Rows in block pairs (i, j) of their key, by ``sizes`` of :func:`_sized`; blocks of the main label have numbers below 0 and don't meet each other."""
    placed = rows.join(sizes, "key").withColumn("own", F.xxhash64("node", F.lit(5)))
    main = F.coalesce(F.col("main") == F.col(label), F.lit(False))
    placed = placed.withColumn("own", F.when(main, -1 - F.pmod("own", F.greatest("blocks", F.lit(1)))).otherwise(F.pmod("own", "less")).cast("int"))
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = F.col("own")
    others = F.transform(F.sequence(F.lit(0), F.col("less") - 1), lambda x: F.when(own < 0, pair(own, x, 0)).when(x == own, pair(own, own, 2)).when(x < own, pair(x, own, 1)).otherwise(pair(own, x, 0)))
    mains = F.when((own < 0) | (F.col("blocks") == 0), F.array().cast("array<struct<i:int,j:int,side:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest("blocks", F.lit(1))), lambda x: pair(-x, own, 1)))
    return placed.withColumn("p", F.explode(F.concat(others, mains))).select("p.i", "p.j", "p.side", *rows.columns)


def _mixed(rows: DataFrame) -> DataFrame:
    """``key, size`` in blocks of the buckets that hold several components and trees; of buckets with the same rows one.

    Of up to three rows the first comparison has met all pairs.
    """
    seen = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("tree").alias("least"), F.max("tree").alias("most"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("low <> high and least <> most and rows > 3")
    return seen.groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key", (F.col("rows") / BLOCK).alias("size"))


def _spanned(labelled: DataFrame, likely: Likely, few: int) -> DataFrame:
    """The likely links between different components that share a bucket, or a forest over them where they are ``dense``, written."""
    spark = labelled.sparkSession

    def across(rows: DataFrame, own: bool) -> DataFrame:
        sizes = _mixed(rows)
        if own:
            dealt = rows.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil("size")).cast("int")).drop("size").withColumn("j", F.col("i")).withColumn("side", F.lit(2))
        else:
            sizes = scratch.table(sizes, "bucket-sizes")
            dealt = _dealt(rows, _sized(rows, sizes, "tree", F.count("*") / BLOCK), "tree")
        spread = dealt.repartition(scratch.shuffle_partitions(spark), F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
        out = scratch.table(spread.mapInArrow(returning(partial(_across, likely, few=few)), "u long, v long, dense boolean").distinct(), "bucket-forest")
        if not own:
            scratch.drop(sizes)
        scratch.release(spark)
        return out

    alone = labelled.withColumn("tree", F.col("node"))
    first = across(alone.filter(F.pmod(F.xxhash64("key", F.lit(6)), F.lit(FIRST)) == 0), True)
    dense = first.filter("dense")
    if dense.isEmpty():
        scratch.drop(first)
        return across(alone, False)
    trees = components(dense.select("u", "v"))
    rest = across(labelled.join(trees.select(F.col("id").alias("node"), F.col("root").alias("tree")), "node", "left").withColumn("tree", F.coalesce("tree", "node")), False)
    forest = scratch.table(dense.unionByName(rest).distinct(), "bucket-forest")
    scratch.drop(first, rest, trees)
    return forest


def shared_rows(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, node and more) whose key another row has too, written."""
    schema = keyed.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    out = scratch.table(keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_shared, schema), "buckets")
    scratch.release(keyed.sparkSession)
    return out


def link(keyed: DataFrame, likely: Likely, fetch: Fetch, agrees: Agrees) -> DataFrame:
    """(id, root) of the nodes that are not roots of their component. ``keyed`` has the columns of ROWS."""
    shared = shared_rows(keyed)
    roots = link_shared(shared, likely, fetch, agrees)
    scratch.drop(shared)
    return roots


def link_shared(shared: DataFrame, likely: Likely, fetch: Fetch, agrees: Agrees, glance: Glance | None = None, may: May | None = None, few: int = 0, every: Every | None = None, more: DataFrame | None = None) -> DataFrame:
    """The same for rows of buckets that hold several, in a table, and the likely pairs (u, v) of ``more``, whose buckets hold nothing else."""
    spark = shared.sparkSession
    order = shared.repartition(F.col("key")).sortWithinPartitions("key", "n", "node")
    pairs = order.mapInArrow(returning(partial(_neighbours, likely)), "u long, v long")
    pairs = scratch.table((pairs if more is None else pairs.unionByName(more)).distinct(), "bucket-pairs")
    links = _links(pairs, fetch, agrees, every)
    scratch.drop(pairs)
    scratch.release(spark)
    roots = components(links)
    labelled = shared.join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "n", "sketch", F.coalesce("root", "node").alias("comp"))
    labelled = scratch.table(labelled, "bucket-labels")
    found = _spanned(labelled, likely, few)
    parts = [links]

    def joined(more: DataFrame) -> None:
        nonlocal roots
        parts.append(more)
        if not more.isEmpty():
            scratch.drop(roots)
            roots = components(reduce(DataFrame.unionByName, parts))

    forest = found.select("u", "v")
    if few and not found.isEmpty():
        # a cluster of one block is compared in full; what is not dense of larger ones goes pair by pair
        trees = components(forest)
        whole = trees.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") < BLOCK)
        inside = trees.join(whole, "root").select(F.col("id").alias("u"))  # u > v, so that u is not a root
        loose = found.filter("not dense").join(inside, "u", "left_anti").select("u", "v")
        loose = scratch.table(loose.join(found.filter("dense"), ["u", "v"], "left_anti"), "bucket-loose")  # without such pairs a tree would fall apart
        forest = scratch.table(forest.join(loose, ["u", "v"], "left_anti"), "bucket-forest")
        scratch.drop(trees)
        if not loose.isEmpty():
            joined(_links(loose, fetch, agrees, every))
    if not forest.isEmpty():
        named = forest.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        trees = components(forest)
        clusters = named.join(trees.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("key"))
        about = labelled.select("node", "n", "sketch").join(named, "node", "left_semi").distinct()
        about = about.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "n", "sketch", F.coalesce("root", "node").alias("comp"))
        rows = scratch.table(clusters.join(about, "node").join(fetch(named), "node").select("key", "node", "n", "sketch", "comp", "content"), "bucket-clusters")
        weight = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("content")) / BLOCK_BYTES)
        sizes = scratch.table(rows.groupBy("key").agg(weight.alias("size")), "bucket-sizes")
        spread = _dealt(rows, _sized(rows, sizes, "comp", weight), "comp").repartition(scratch.shuffle_partitions(spark), F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
        joined(scratch.table(spread.mapInArrow(returning(partial(_settle, likely, agrees, glance, may, every)), "u long, v long").distinct(), "bucket-links"))
        scratch.drop(trees, rows, sizes)
    scratch.drop(*parts, labelled, found)
    scratch.release(spark)
    return roots
