"""Document signatures by random indexing.

A term's weight in a document is tf ln((tf / dl)(L / cf)), and terms under a least weight are left out. A hash of
the term and a counter picks ``width * density / 200`` bits that the weight is added to and as many that it is
taken from; the signs make the signature, stored as 64-bit words. A posting travels to its document as one hash and one
weight; its positions are drawn where the document's sums are kept, a batch of postings at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.operators.index import Index, looked_up, restricted
from lodestar.operators.search import top
from lodestar.storage import checkpointed

WIDTH, DENSITY, LEAST = 256, 21, 1.0
#: Sums are rounded to six digits before their sign is taken.
_OVER = 5e-7
#: Terms whose positions are drawn together, in arrays that a core's cache holds.
_AT_ONCE = 512
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _weigh(rows: DataFrame) -> DataFrame:
    w = F.col("tf") * F.log((F.col("tf") / F.col("dl")) * (F.col("l") / F.col("cf")))
    return rows.withColumn("w", w).filter(F.col("w") >= LEAST)


def _draws(hashes: np.ndarray, draws: int, width: int) -> np.ndarray:
    """Positions of each term, drawn as by ``pmod(xxhash64(term, i), width)`` for i below ``draws`` from ``xxhash64(term)``."""
    u = np.uint64
    out = np.empty((len(hashes), draws), np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        x = (hashes[i : i + _AT_ONCE].view(u) + _P5 + u(4))[:, None] ^ (np.arange(draws, dtype=u) * _P1)
        high = x >> u(41)
        x <<= u(23)
        x |= high
        x *= _P2
        x += _P3
        for shift, by in ((33, _P2), (29, _P3), (32, None)):
            np.right_shift(x, u(shift), out=high)
            x ^= high
            if by is not None:
                x *= by
        out[i : i + _AT_ONCE] = x & u(width - 1) if width & (width - 1) == 0 else np.mod(x.view(np.int64), width)
    return out


def _signed(weighed: DataFrame, key: str, width: int, density: int) -> DataFrame:
    """``key`` and a column of 64 bits for each word, of those that have a bit set."""
    each, words = max(1, width * density // 200), width // 64
    names = [str(i) for i in range(words)]

    def packed(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(sums >= _OVER, axis=1, bitorder="little").view("<i8")
        some = bits.any(axis=1)
        return pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), *(pa.array(bits[some, i]) for i in range(words))], [key, *names])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.where(np.arange(2 * each) < each, 1.0, -1.0)
        last = kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            new = np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
            row, first = np.cumsum(new) - 1, np.flatnonzero(new)
            at = row[:, None] * width + _draws(batch.column(1).to_numpy(), 2 * each, width)
            sums = np.bincount(at.ravel(), (batch.column(2).to_numpy()[:, None] * signs).ravel(), len(first) * width).reshape(-1, width)
            if kept is not None:
                if keys[0] == last[0]:
                    sums[0] += kept[0]
                else:
                    yield packed(last, kept)
            if len(first) > 1:
                yield packed(keys.take(pa.array(first[:-1])), sums[:-1])
            last, kept = keys[-1:], sums[-1:]
        if kept is not None:
            yield packed(last, kept)

    rows = weighed.select(key, F.xxhash64("term").alias("h"), F.col("w").cast("double").alias("w")).repartition(key).sortWithinPartitions(key)
    return rows.mapInArrow(sign, StructType([weighed.schema[key], *(StructField(n, LongType()) for n in names)]))


def signed(index: Index, width: int = WIDTH, density: int = DENSITY) -> DataFrame:
    """``docid`` and the words of its signature, of documents that have a bit set."""
    return _signed(_weigh(looked_up(index).crossJoin(F.broadcast(index.stats.select("l")))), "docid", width, density)


def signatures(index: Index, width: int = WIDTH, density: int = DENSITY) -> DataFrame:
    """``docid, word, bits`` of words that have a bit set."""
    return _long(signed(index, width, density), "docid", width)


def query_signatures(index: Index, topics: dict[int, list[str]], width: int = WIDTH, density: int = DENSITY) -> DataFrame:
    """``topic, word, bits`` of query texts, weighed as documents of their own."""
    return _long(_asked(index, topics, width, density), "topic", width)


def _asked(index: Index, topics: dict[int, list[str]], width: int, density: int) -> DataFrame:
    rows = [(topic, t, n, len(ts)) for topic, ts in topics.items() for t, n in Counter(ts).items()]
    query = index.spark.createDataFrame(rows, "topic long, term string, tf long, dl long")
    known = restricted(index, [r[1] for r in rows]).dictionary.select("term", "cf")
    return _signed(_weigh(query.join(known, "term").crossJoin(F.broadcast(index.stats.select("l")))), "topic", width, density)


def _long(held: DataFrame, key: str, width: int) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(i).alias("word"), F.col(str(i)).alias("bits")) for i in range(width // 64)))
    return held.select(key, F.inline(pairs)).filter("bits <> 0")


def _wide(stored: DataFrame, key: str, width: int) -> DataFrame:
    """Signatures of either layout with a column for each word."""
    return stored.groupBy(key).pivot("word", list(range(width // 64))).agg(F.first("bits")).na.fill(0) if "word" in stored.columns else stored


def _nearest(held: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """A few query rows meet all documents."""
    words = range(width // 64)
    asked = asked.select("topic", *(F.col(str(i)).alias(f"q{i}") for i in words))
    differ = sum((F.bit_count(F.col(str(i)).bitwiseXOR(F.col(f"q{i}"))) for i in words), F.lit(0))
    return top(held.crossJoin(F.broadcast(asked)).select("topic", "docid", agreement(differ, width).cast("double").alias("rsv")), k)


def agreement(common: Column, width: int) -> Column:
    return F.lit(width) - common


def search_signatures(index: Index, topics: dict[int, list[str]], k: int = 20, width: int = WIDTH, density: int = DENSITY, stored: DataFrame | None = None) -> DataFrame:
    """Documents by the number of bits that agree with the query's signature.

    ``stored`` are signatures made before, by :func:`signed` or :func:`signatures`.
    """
    held = signed(index, width, density) if stored is None else _wide(stored, "docid", width)
    return _nearest(held, _asked(index, topics, width, density), k, width)


def feedback_signatures(index: Index, run: DataFrame, documents: int, k: int, width: int = WIDTH, density: int = DENSITY, stored: DataFrame | None = None) -> DataFrame:
    """Search with the bits that at least half have of the first documents' signatures of each topic."""
    all_ = checkpointed(signed(index, width, density)) if stored is None else _wide(stored, "docid", width)
    chosen = checkpointed(run.filter(F.col("rank") <= documents).select("topic", "docid"))
    own = _long(all_.join(F.broadcast(chosen), "docid"), "topic", width)
    bit = own.select("topic", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).filter(F.expr("getbit(bits, b) = 1"))
    counts = bit.groupBy("topic", "word", "b").agg(F.count("*").alias("c")).join(F.broadcast(chosen.groupBy("topic").agg(F.count("*").alias("d"))), "topic").filter("2 * c >= d")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))
    asked = counts.groupBy("topic", "word").agg(F.bit_or(one).alias("bits"))
    return _nearest(all_, _wide(asked, "topic", width), k, width)
