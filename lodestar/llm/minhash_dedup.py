"""Near-duplicate documents by MinHash with tensored banding.

Two collections of M short bands of Q hashes are computed; the key of table (i, j) combines band i of the
first with band j of the second, so M * M tables of 2 Q hashes cost 2 M Q hashes. Texts with one shingle
set are one node. In each bucket a node is compared with the bucket's first node and with the one before
it; once the verified links have been joined into components, what buckets still hold in different
components is gathered into clusters and compared in full. Every link is confirmed on whole shingle sets; links inside a component
that is joined already add nothing and are not looked up.

The least likeness is a parameter: 0.85 in the query, 0.80 in the pipeline. Two sets of just that likeness
s are missed with a chance of about 2 * (1 - s**Q)**M (6e-7 at 0.85, 9e-6 at 0.80), and by the 64-bit
sketch that spares comparisons with at most 1e-6.

Nulls: a null text has no words, an empty set, and is linked with nothing; a null doc_id is reported with
a null component and kept. Rows with one doc_id are one node if their texts agree. Empty tables give no
rows. Columns of any name are carried through by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.buckets import ROWS, link
from lodestar.llm.textcore import U, mix, rolling, split_groups, within

Q, M = 2, 12
SHINGLE, NUMERATOR, DENOMINATOR = 5, 85, 100
#: Chance at which sketches may differ too much at the least likeness.
SKETCH_MISS = 1e-6
#: Nodes whose ids are broadcast to the document scan (8 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(71))
_FACTORS = _RNG.integers(0, 2**63, 2 * M * Q, dtype=np.uint64) * U(2) + U(1)
_SKETCH = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SETS = "doc long, n long, set1 long, set2 long, sketch long, bands binary"


def shingle_sets(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first document, sorted distinct shingle hashes of each document) for stretches of documents."""
    for lo, hi, h, w in split_groups(texts, lower):
        grams = rolling(h, SHINGLE)
        out = []
        for a, b in zip(w[:-1].tolist(), w[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix(rolling(h[a:b], b - a, 0x71D67FFFEDA60001) + U(b - a)))
            else:
                out.append(np.zeros(0, U))
        yield lo, out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(0)
        for lo, sets in shingle_sets(batch.column(1)):
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, U)
            edge = np.concatenate([[0], np.cumsum(n[full])])[:-1]
            k = len(full)
            set1, set2, sketch = np.zeros(len(sets), U), np.zeros(len(sets), U), np.zeros(len(sets), U)
            hashes = np.zeros((k, 2 * M * Q), U)
            if k:
                set1[full] = np.add.reduceat(mix(flat + U(1)), edge)
                set2[full] = np.add.reduceat(mix(flat ^ U(0xA5A5A5A5A5A5A5A5)), edge)
                for t, f in enumerate(_FACTORS):
                    hashes[:, t] = np.minimum.reduceat(flat * f, edge)
                bits = np.zeros(k, U)
                for t, f in enumerate(_SKETCH):
                    bits |= (mix(np.minimum.reduceat(flat * f, edge)) & U(1)) << U(t)
                sketch[full] = bits
            bands = np.zeros((k, 2 * M), U)
            for q in range(Q):
                bands = mix(bands * U(0xD1342543DE82EF95) + hashes[:, q::Q])
            blobs: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full.tolist(), bands):
                blobs[i] = row.tobytes()
            cols = [docs.slice(lo, len(sets)), pa.array(n), *(pa.array(x.view(np.int64)) for x in (set1, set2, sketch)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "set1", "set2", "sketch", "bands"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = (np.arange(M * M, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            if not batch.num_rows:
                continue
            bands = np.frombuffer(b"".join(batch.column(3).to_pylist()), U).reshape(-1, 2 * M)
            keys = mix(bands[:, :M, None] * U(0xBF58476D1CE4E5B9) + (bands[:, None, M:] ^ (bands[:, None, M:] >> U(29))) + table.reshape(1, M, M))
            node, n, sketch = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), M * M) for k in (0, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(sketch)], names=["key", "node", "n", "sketch"])


@cache
def sketch_equal(numerator: int) -> int:
    """Least number of equal sketch bits, of 64, that sets of the least likeness fall below with a chance of SKETCH_MISS at most."""
    p = (1 + numerator / DENOMINATOR) / 2
    below, k = 0.0, 0
    while k < 64 and below + comb(64, k) * p**k * (1 - p) ** (64 - k) <= SKETCH_MISS:
        below += comb(64, k) * p**k * (1 - p) ** (64 - k)
        k += 1
    return k


def _likely(numerator: int, n1, s1, n2, s2) -> np.ndarray:
    """Whether sizes allow the likeness, and sketches make it likely."""
    small, large = np.minimum(n1, n2).astype(np.int64), np.maximum(n1, n2).astype(np.int64)
    return (DENOMINATOR * small >= numerator * large) & (np.bitwise_count(~(s1 ^ s2).view(U)) >= sketch_equal(numerator))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0)
        for lo, sets in shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([nodes.slice(lo, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "content"])


def _agrees(numerator: int, a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= numerator * (len(x) + len(y) - both)


def _contents(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Whole shingle sets of the named nodes; rows that share an id but differ give several sets, each of which counts."""
    named = scratch.table(named, "minhash-named")
    few = named.count() <= BROADCAST_NODES
    own = rows.join(F.broadcast(named) if few else named, "node", "left_semi")
    return own.mapInArrow(_sets, "node long, content binary").distinct()


def classes(rows: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """(doc, n, root) of every row with a set, written: its size and the smallest doc of its component.

    ``rows`` has doc (long) and text. A node is the smallest doc with its set. Sets are linked at a likeness
    of ``numerator`` hundredths.
    """
    found = scratch.table(rows.filter("doc is not null").select("doc", "text").mapInArrow(_describe, _SETS), "minhash-described")
    full = found.filter("n > 0")
    nodes = full.groupBy("set1", "set2", "n").agg(F.min("doc").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes, "minhash-nodes")
    members = full.select("doc", "n", "set1", "set2").join(nodes.select("set1", "set2", "n", "node"), ["set1", "set2", "n"]).select("doc", "n", "node")
    keyed = nodes.select("node", "n", "sketch", "bands").mapInArrow(_keys, ROWS)
    texts = rows.select(F.col("doc").alias("node"), "text")
    roots = link(keyed, partial(_likely, numerator), lambda named: _contents(texts, named), partial(_agrees, numerator))
    labelled = scratch.table(members.join(roots.withColumnRenamed("id", "node"), "node", "left").select("doc", "n", F.coalesce("root", "node").alias("root")).distinct(), "minhash-classes")
    scratch.drop(found, nodes, roots)
    scratch.release(rows.sparkSession)
    return labelled


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size, component and verdict of every document."""
    rows = _rows(docs)
    best = classes(rows).groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("root").alias("component_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """The document with the smallest doc_id of each component, in the columns they came with."""
    gone = classes(_rows(docs), numerator).filter("doc <> root").select(F.col("doc").alias("_gone")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return rows.join(gone.hint("merge"), F.col("_doc") == F.col("_gone"), "left_anti").select("_row.*")
