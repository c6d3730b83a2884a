"""Packing of tokenised documents into fixed-length sequences.

First-fit decreasing over a tournament tree of bin capacities, run independently in randomised groups.
A document is cut at every full sequence; of every ``filler``-th document the rest is cut further into
short pieces, which first-fit decreasing places last and so fills gaps with. Only piece descriptions
are shuffled, never ids.

Nulls: a null text is empty and gives the end id alone; a null doc_id is kept as null. Equal rows are
packed each on their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.token_cache import encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents in a randomised group.
GROUP_DOCUMENTS = 4096
FILLER_TOKENS = 48
#: Stretches of text that a worker holds with their ids; it keeps them while it works on other stages.
CACHE_ENTRIES = 400_000
SLICE = 256


class Tournament:
    """Largest free capacity over bins, with the leftmost bin that holds an item in O(log bins)."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Bin taken and free capacity it had before."""
        tree, at, size = self.tree, 1, self.size
        while at < size:
            at *= 2
            if tree[at] < length:
                at += 1
        had = tree[at]
        tree[at] = had - length
        bin_ = at - size
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            big = a if a > b else b
            if tree[at] == big:
                break
            tree[at] = big
            at >>= 1
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; ties keep their given order. Every length is at most ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), capacity)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        b, had = tree.place(n)
        bins[i], offsets[i] = b, capacity - had
    return bins, offsets


def _cuts(n: int, length: int, fine: bool) -> Iterator[tuple[int, int]]:
    full = n // length * length
    for at in range(0, full, length):
        yield at, length
    step = FILLER_TOKENS if fine else length
    for at in range(full, n, step):
        yield at, min(step, n - at)


def _pieces(tokenizer: str, kind: str, end_id: int, length: int, filler: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, slot = encoder(tokenizer, kind, CACHE_ENTRIES), np.random.Generator(np.random.PCG64(TaskContext.get().partitionId()))
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                rows: list[list] = [[] for _ in range(6)]
                ids = batch.column(0).to_pylist()
                slots = slot.integers(0, 2**62, len(ids)).tolist()
                for doc, data, s in zip(ids, enc.encode(batch.column(1).to_pylist()), slots):
                    data += tail
                    n, view = len(data) // 4, memoryview(data)
                    for at, size in _cuts(n, length, s % filler == 0):
                        for col, v in zip(rows, (doc, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n, s // 64)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"])

    return run


def _pack_group(length: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("slot", "ascending"), ("start", "ascending"), ("doc_id", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        seq = (key[0].as_py() << 32) + bins
        return pa.table([*(group[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(offsets)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, length: int = 4096, filler: int = 16) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A group holds about GROUP_DOCUMENTS documents whatever the input: the number of groups follows the
    number of rows, and a piece's group is drawn at random in its scan task, so repeated rows spread.
    """
    groups = max(1, math.ceil(docs.count() / GROUP_DOCUMENTS))
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, kind, end_id, length, filler), _PIECES)
    grouped = pieces.withColumn("grp", F.pmod(F.col("slot"), F.lit(groups)))
    return grouped.groupBy("grp").applyInArrow(_pack_group(length), _PACKED)
