"""Token ids in binary shard files of patched frame-of-reference blocks.

Shard file (little endian): segments of a bounded number of ids, each with magic, counts, document table (doc_id int64, null flag, token count), block
headers, block starts (the index), then blocks. A block of 1024 ids keeps its minimum; differences are
packed at the width that holds the chosen percentile of them; the rest are patched from an exception
list of positions and values. Any block is found through the index and decoded alone.

Nulls: a null text is empty and gives the end id alone; null doc_ids come first in the order. Equal ids
are ordered by text. An empty table gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.token_cache import encoder

BLOCK = 1024
LANES = 32
PERCENTILE = 92
MAGIC = b"PFORTOK1"
SLICE = 256
#: Ids after which a writer closes a segment, which bounds what it holds.
SEGMENT_IDS = 4_000_000
_MANIFEST = "shard long, path string, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 1024) differences of w bits as (blocks, 32 w) words, in 32 interleaved lanes."""
    n = len(v)
    v = v.reshape(n, BLOCK // LANES, LANES)
    out = np.zeros((n, w + 1, LANES), np.uint32)
    for r in range(BLOCK // LANES):
        word, shift = divmod(r * w, 32)
        out[:, word] |= v[:, r] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= v[:, r] >> np.uint32(32 - shift)
    return out[:, :w].reshape(n, w * LANES)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    n = len(words)
    out = np.zeros((n, BLOCK // LANES, LANES), np.uint32)
    if w:
        words = words.reshape(n, w, LANES)
        mask = np.uint32((1 << w) - 1)
        for r in range(BLOCK // LANES):
            word, shift = divmod(r * w, 32)
            x = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                x = x | (words[:, word + 1] << np.uint32(32 - shift))
            out[:, r] = x & mask
    return out.reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Block bytes, int64 block starts and headers (minimum, width, exceptions) of uint32 ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n % BLOCK:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v -= low[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    limit = np.partition(v, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    over = (v >> np.minimum(width, 31).astype(np.uint32)[:, None]) > 0
    over &= (width < 32)[:, None]
    n_over = over.sum(axis=1).astype(np.uint16)
    row, pos = np.nonzero(over)
    exc_pos, exc_val = pos.astype(np.uint16), v[row, pos]
    exc_at = np.concatenate([[0], np.cumsum(n_over, dtype=np.int64)])
    packed: list[np.ndarray | None] = [None] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            mask = np.uint32(0xFFFFFFFF if w == 32 else (1 << w) - 1)
            for i, words in zip(at.tolist(), _pack(v[at] & mask, w)):
                packed[i] = words
    starts, out, here = np.empty(blocks + 1, np.int64), io.BytesIO(), 0
    for i in range(blocks):
        starts[i] = here
        a, b = exc_at[i], exc_at[i + 1]
        body = b"" if packed[i] is None else packed[i].tobytes()
        here += out.write(body) + out.write(exc_pos[a:b].tobytes()) + out.write(exc_val[a:b].tobytes())
    starts[blocks] = here
    head = np.zeros(blocks, [("low", "<u4"), ("over", "<u2"), ("width", "u1")])
    head["low"], head["over"], head["width"] = low, n_over, width
    return out.getvalue(), starts, head


def decode_blocks(body: bytes | memoryview, starts: np.ndarray, head: np.ndarray, first: int, last: int, base: int = 0) -> np.ndarray:
    """Ids of blocks first..last-1; ``body`` begins at byte ``base`` of the block area."""
    out = np.zeros((last - first, BLOCK), np.uint32)
    width, over = head["width"][first:last], head["over"][first:last].astype(np.int64)
    at = starts[first:last] - base
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = 4 * LANES * w
        words = np.frombuffer(b"".join(body[at[i] : at[i] + size] for i in own.tolist()), "<u4").reshape(len(own), LANES * w)
        out[own] = _unpack(words, w)
    for i in np.flatnonzero(over).tolist():
        a = at[i] + 4 * LANES * int(width[i])
        pos = np.frombuffer(body[a : a + 2 * over[i]], "<u2")
        out[i, pos] = np.frombuffer(body[a + 2 * over[i] : a + 6 * over[i]], "<u4")
    out += head["low"][first:last, None]
    return out.reshape(-1)


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    body, starts, head = encode_blocks(ids)
    yield MAGIC + struct.pack("<qqq", len(doc_ids), len(ids), len(head))
    yield np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    yield np.array([d is None for d in doc_ids], "u1").tobytes()
    yield counts.astype("<i8").tobytes()
    yield head.tobytes()
    yield starts.astype("<i8").tobytes()
    yield body


def read_shard(f) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, first id's place in the shard, little-endian ids) of each document, a stretch of blocks at a time."""
    base = 0
    while (magic := f.read(8)) == MAGIC:
        for doc, place, data in _read_segment(f):
            yield doc, base + place, data
            end = place + len(data) // 4
        base += end
    if magic:
        raise ValueError("a segment does not begin with its mark")


def _read_segment(f) -> Iterator[tuple[int | None, int, bytes]]:
    n_docs, n_ids, blocks = struct.unpack("<qqq", f.read(24))
    docs = np.frombuffer(f.read(8 * n_docs), "<i8").tolist()
    null = np.frombuffer(f.read(n_docs), "u1").tolist()
    counts = np.frombuffer(f.read(8 * n_docs), "<i8")
    head = np.frombuffer(f.read(7 * blocks), [("low", "<u4"), ("over", "<u2"), ("width", "u1")])
    starts = np.frombuffer(f.read(8 * (blocks + 1)), "<i8")
    held, place, k = np.zeros(0, np.uint32), 0, 0
    for first in range(0, blocks, 1024):
        last = min(blocks, first + 1024)
        body = f.read(int(starts[last] - starts[first]))
        ids = decode_blocks(memoryview(body), starts, head, first, last, int(starts[first]))
        if last == blocks:
            ids = ids[: n_ids - first * BLOCK]
        held, at = np.concatenate([held, ids]), 0
        while k < n_docs and at + counts[k] <= len(held):
            n = int(counts[k])
            yield (None if null[k] else docs[k]), place, held[at : at + n].astype("<u4").tobytes()
            at, place, k = at + n, place + n, k + 1
        held = held[at:]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(tokenizer: str, kind: str, end_id: int, folder: str):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer, kind), TaskContext.get().partitionId()
        store, top = _filesystem(folder)
        path = f"{top}/shard-{shard:06d}-{uuid.uuid4().hex}.pfor"  # an attempt's own name; the manifest names the one that counts
        docs: list[int | None] = []
        counts: list[int] = []
        stream: list[bytes] = []
        n_docs = n_tokens = held = 0
        out = None

        def close_segment():
            ids = np.frombuffer(b"".join(stream), "<u4")
            for part in shard_bytes(docs, np.array(counts), ids):
                out.write(part)
            docs.clear(), counts.clear(), stream.clear()

        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path)
                docs += batch.column(0).to_pylist()
                for data in enc.encode(batch.column(1).to_pylist()):
                    stream += [data, tail]
                    counts.append(len(data) // 4 + 1)
                    held += counts[-1]
                n_docs += batch.num_rows
                if held >= SEGMENT_IDS:
                    close_segment()
                    n_tokens, held = n_tokens + held, 0
        if out is not None:
            if docs:
                close_segment()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens + held]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, kind: str, end_id: int, folder: str, shards: int | None = None) -> DataFrame:
    """Write shards in ascending doc_id order; the manifest (shard, path, n_docs, n_tokens) names the committed files."""
    n = shards or scratch.shuffle_partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return scratch.table(ordered.mapInArrow(_write(tokenizer, kind, end_id, folder), _MANIFEST), "token-manifest")


def _read(folder: str, bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as f:
                    rows = [(d, bases[shard] + at, len(data) // 4, zlib.crc32(data)) for d, at, data in read_shard(f)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document with the place, number and checksum of the ids read back.

    The driver holds one number per shard; shards are as many as shuffle partitions.
    """
    total, bases = 0, {}
    for shard, n in sorted((r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").collect()):
        bases[shard] = total
        total += n
    spread = manifest.select("shard", "path").repartition(max(1, len(bases)), "shard") if bases else manifest.select("shard", "path")
    return spread.mapInArrow(_read(folder, bases), _READ)
