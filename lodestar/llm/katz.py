"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

Tokens are words, lower-cased in A-Z, then one end per document. With c the count of an n-gram in the
training documents,

    P(w | ctx) = d(c) * c(ctx w) / c(ctx)              if the n-gram was seen
               = alpha(ctx) * P(w | shorter ctx)       if not, and the context was
               = P(w | shorter ctx)                    otherwise
    alpha(ctx) = (1 - sum of P(w | ctx) over seen w) / (1 - sum of P(w | shorter ctx) over seen w)

d(r) is Katz's Good-Turing factor for r <= K; a larger count gives up LARGE of itself, so that no context is
left without mass to back off with. At the lowest order the mass given up is the probability of the one
unknown token, so the probabilities of the known tokens and the unknown one sum to one in every context.

Counts of n-grams live in hash buckets, as many as the input needs to keep a bucket's size. A chunk of
documents sends each bucket its distinct keys with training counts, in sorted delta-coded arrays, and gets
the counts over all documents back. One chunk owns each seen n-gram; the owner adds its discounted count
and lower-order probability to its context's sums, from which a bucket of contexts computes alpha for the
chunks that back off there (a context that one chunk holds all of is weighed there, and no sums are sent for
a context that no held-out document has). Nothing but counts of counts reaches the driver. :func:`tables` writes the model
as tables partitioned by order.

Nulls: a null text is empty (one end token); a null doc_id is a training document and stays null. Repeated
rows count and are scored each on their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.textcore import U, buffers, give_back, giving_back, groups, mix, split_groups

ORDER, K, LARGE = 3, 5, 0.05
#: Bytes of text in a chunk (a longer document is a chunk of its own) and for each bucket.
CHUNK_BYTES, BUCKET_BYTES = 1 << 22, 10 << 20
#: Bytes of a chunk whose words are hashed at once.
HASH_BYTES = 1 << 20
#: Shares of the chunks that are scored one after another.
ROUNDS = 3
END, START = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)
_STEP = U(0x9E3779B97F4A7C15)
_CHUNKS = "part long, docs binary, nulls binary, sizes binary, held binary, words array<binary>, tokens binary"
_COUNTS = "bucket int, ord int, part long, keys binary, counts binary, held binary"
_ANSWERS = "bucket int, ord int, part long, counts binary, owned binary, wanted binary, " + ", ".join(f"n{r} long" for r in range(1, K + 2)) + ", types long, total long"
_SUMS = "bucket int, ord int, part long, keys binary, seen binary, lower binary, total binary, docs binary, times binary"
_DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PARTIAL = "part long, docs binary, logs binary"
_GRAMS = "bucket int, ord int, key long, n long"

Hold = Callable[[int | None], bool]


def every_seventh(doc_id: int | None) -> bool:
    """Held out: CRC-32 of the decimal doc_id leaves 2 when divided by 7."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the first and differences of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    width, n = blob[0], (len(blob) - 9) // blob[0]
    wide = np.zeros((n + 1, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8, 1)
    wide[1:, :width] = np.frombuffer(blob, np.uint8, n * width, 9).reshape(n, width)
    return np.cumsum(wide.reshape(-1).view(U), dtype=U)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers, non-negative ones in the narrowest type; first bytes, then second ones and so on, compressed."""
    if x.dtype.kind in "iub":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return f"{x.dtype.str:4}{len(raw):12}".encode() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_numbers(blob: bytes) -> np.ndarray:
    kind = np.dtype(blob[:4].decode().strip())
    raw = np.frombuffer(pa.decompress(blob[16:], int(blob[4:16]), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack_numbers(blob), count=n).astype(bool)


@dataclass
class Chunk:
    """Documents of one row of the chunk table, with every order's distinct keys over their events."""

    part: int
    docs: np.ndarray
    nulls: np.ndarray
    sizes: np.ndarray
    held: np.ndarray
    hashes: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table, i: int) -> Chunk:
        get = lambda name: batch[name][i].as_py()
        vocabulary = np.concatenate([unpack_sorted(b) for b in get("words")] or [np.zeros(0, U)])
        return cls(get("part"), *(np.frombuffer(get(n), t) for n, t in (("docs", np.int64), ("nulls", bool), ("sizes", np.int64), ("held", bool))), vocabulary[unpack_numbers(get("tokens"))])

    def events(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct keys, place of each event's key among them) of the orders 1 to ``order``; an event is a token or an end."""
        for key in self.keys(order):
            yield np.unique(key, return_inverse=True)

    def keys(self, order: int) -> Iterator[np.ndarray]:
        """Key of every event, for the orders 1 to ``order``."""
        pad, docs = order - 1, len(self.sizes)
        whole = self.sizes + 1 + pad
        edge = np.concatenate([[0], np.cumsum(whole)])
        h = np.full(int(edge[-1]), START)
        pads = (np.repeat(edge[:-1], pad).reshape(docs, pad) + np.arange(pad)).reshape(-1) if pad else np.zeros(0, np.int64)
        event = np.ones(len(h), bool)
        event[pads] = False
        ends = edge[1:] - 1
        word = event.copy()
        word[ends] = False
        h[word], h[ends] = self.hashes, END
        key = h
        for n in range(1, order + 1):
            if n > 1:
                longer = h.copy()
                longer[1:] = mix(key[:-1] * _STEP + h[1:])
                key = longer
            yield key[event]

    @property
    def first(self) -> np.ndarray:
        """Each document's first event."""
        return np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes + 1)


def _chunks(hold: Hold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            nonlocal part
            ids = rows.column(0).to_pylist()
            parts = [(h, np.diff(w)) for _, _, h, w in split_groups(rows.column(1), True, HASH_BYTES)]
            h, size = (np.concatenate(x) for x in zip(*parts))
            vocabulary, at, times = np.unique(h, return_inverse=True, return_counts=True)
            often = -np.log2(times).astype(np.int64)  # words of about one frequency stand together, frequent ones first
            order = np.argsort(often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            runs = np.split(vocabulary[order], np.flatnonzero(np.diff(often[order])) + 1)
            cols = [np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids]), size.astype(np.int64), np.array([hold(d) for d in ids])]
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), pa.array([[pack_sorted(r) for r in runs]], pa.list_(pa.binary())), pa.array([pack_numbers(place[at])], pa.binary())], names=["part", "docs", "nulls", "sizes", "held", "words", "tokens"])
            part += 1
            return out

        waiting, size = [], 0
        for batch in batches:
            _, offs = buffers(batch.column(1))
            for lo, hi in groups(offs, CHUNK_BYTES // 8):
                waiting.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                if size >= CHUNK_BYTES:
                    yield chunk(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if waiting:
            yield chunk(pa.Table.from_batches(waiting))
        give_back()

    return run


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending keys; a bucket is a range of keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _requests(n: int, buckets: int):
    """Distinct keys of order ``n`` of every chunk with their training counts, and whether a held-out document has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.read(batch, i)
                train = chunk.train()
                *_, key = chunk.keys(n)
                keys, at = np.unique(key, return_inverse=True)
                counts, cut = np.bincount(at[train], minlength=len(keys)), _cuts(keys, buckets)
                held = np.zeros(len(keys), bool)
                held[at[~train]] = True
                own = np.flatnonzero(np.diff(cut))
                spans = [(cut[b], cut[b + 1]) for b in own.tolist()]
                arrays = [pa.array(own, pa.int32()), pa.array([n] * len(own), pa.int32()), pa.array([chunk.part] * len(own), pa.int64()), pa.array([pack_sorted(keys[a:z]) for a, z in spans], pa.binary()), pa.array([pack_numbers(counts[a:z]) for a, z in spans], pa.binary()), pa.array([pack_numbers(np.packbits(held[a:z])) for a, z in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "ord", "part", "keys", "counts", "held"])
        give_back()

    return run


def _merge(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many keys each row has, distinct keys, place of each row's keys among them, summed and single counts, of one bucket and order."""
    keys = [unpack_sorted(b) for b in group["keys"].to_pylist()]
    sizes, keys = [len(k) for k in keys], np.concatenate(keys)
    distinct, at = np.unique(keys, return_inverse=True)
    del keys
    counts = np.concatenate([unpack_numbers(b) for b in group["counts"].to_pylist()]).astype(np.int64)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, counts)
    return sizes, distinct, at, total, counts


@giving_back
def _answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Counts over all chunks for every row of a bucket, and what the bucket adds to the counts of counts."""
    group = group.sort_by("part")
    sizes, distinct, at, total, counts = _merge(group)
    held = np.concatenate([_bits(b, k) for b, k in zip(group["held"].to_pylist(), sizes)])
    wanted = np.zeros(len(distinct), bool)
    wanted[at[held]] = True
    owner = np.full(len(distinct), -1)
    trained = np.flatnonzero(counts)[::-1]
    owner[at[trained]] = trained
    owned = np.zeros(len(at), bool)
    owned[owner[owner >= 0]] = True
    edge = np.concatenate([[0], np.cumsum(sizes)])
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    seen = total[total > 0]
    histogram = np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1 : K + 2]
    stats = [*histogram.tolist(), len(seen), int(seen.sum())]
    rows = group.num_rows
    cols = [
        pa.array([key[0].as_py()] * (rows + 1), pa.int32()),
        pa.array([key[1].as_py()] * (rows + 1), pa.int32()),
        pa.array([*group["part"].to_pylist(), None], pa.int64()),
        pa.array([*(pack_numbers(total[at[a:z]]) for a, z in spans), None], pa.binary()),
        pa.array([*(pack_numbers(np.packbits(owned[a:z])) for a, z in spans), None], pa.binary()),
        pa.array([*(pack_numbers(np.packbits(wanted[at[a:z]])) for a, z in spans), None], pa.binary()),
        *(pa.array([None] * rows + [s], pa.int64()) for s in stats),
    ]
    return pa.table(cols, names=[x.split()[0] for x in _ANSWERS.split(", ")])


@dataclass
class Statistics:
    """Discounts by count (0 to K) of every order, tokens and distinct tokens of training, training documents."""

    discounts: dict[int, np.ndarray]
    tokens: int
    types: int
    unknown: float
    documents: int

    def kept(self, order: int, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        d = self.discounts[order]
        return np.where(count <= K, d[np.minimum(count, K)] * count, count - LARGE)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.kept(1, count) / max(self.tokens, 1), self.unknown)


def good_turing(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 (unused) to K from the numbers of n-grams seen 1 to K + 1 times.

    Where those numbers give no factor between 0 and 1 (small or duplicated corpora), absolute discounting
    from the first two stands in.
    """
    y = min(max(n[0] / (n[0] + 2 * n[1]), 0.05), 0.95) if n[0] else 0.5
    out = [1.0]
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - y / r)
    return np.array(out)


def statistics(answers: DataFrame, documents: int) -> Statistics:
    sums = [F.sum(f"n{r}").alias(f"n{r}") for r in range(1, K + 2)]
    rows = {r.ord: r for r in answers.filter("part is null").groupBy("ord").agg(*sums, F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    discounts = {n: good_turing([r[f"n{k}"] for k in range(1, K + 2)]) for n, r in rows.items()}
    if not rows or not rows[1].total:
        return Statistics(discounts, 0, 0, 1.0, documents)
    r = rows[1]
    small = [r[f"n{k}"] for k in range(1, K + 1)]
    low = sum(k * n for k, n in enumerate(small, 1))
    kept = sum(k * n * discounts[1][k] for k, n in enumerate(small, 1)) + (r.total - low) - LARGE * (r.types - sum(small))
    return Statistics(discounts, r.total, r.types, 1 - kept / r.total, documents)


def _score(order: int, buckets: int, stats: Statistics):
    """Scores of a chunk's documents as far as the chunk knows them, its sums for contexts, and what it asks of them."""

    def blob_rows(n: int, part: int, keys: np.ndarray, cols: dict[str, np.ndarray]) -> pa.Table:
        cut = _cuts(keys, buckets)
        own = np.flatnonzero(np.diff(cut))
        spans = [(cut[b], cut[b + 1]) for b in own.tolist()]
        arrays = [pa.array(own, pa.int32()), pa.array([n] * len(own), pa.int32()), pa.array([part] * len(own), pa.int64()), pa.array([pack_sorted(keys[a:z]) for a, z in spans], pa.binary())]
        for name in ("seen", "lower", "total", "docs", "times"):
            arrays.append(pa.array([pack_numbers(cols[name][a:z]) if name in cols else None for a, z in spans], pa.binary()))
        return pa.table(arrays, names=[x.split()[0] for x in _SUMS.split(", ")])

    @giving_back
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk.read(left, 0)
        train, first = chunk.train(), chunk.first
        events, right = chunk.events(order), right.sort_by([("ord", "ascending"), ("bucket", "ascending")])
        orders = right["ord"].to_numpy()
        doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes + 1)
        prev = np.arange(len(doc)) - 1
        is_first = np.zeros(len(doc), bool)
        is_first[first] = True
        out: list[pa.Table] = []
        log = np.zeros(len(doc))
        probability = count = local = keys = at = wanted = None
        for n in range(1, order + 1):
            rows = right.filter(pa.array(orders == n))
            lower_keys, lower_at, lower_count, lower_local, lower_wanted = keys, at, count, local, wanted
            keys, at = next(events)
            types = np.concatenate([unpack_numbers(b).astype(np.int64) for b in rows["counts"].to_pylist()])
            sizes = np.diff(_cuts(keys, buckets))
            owned, asked_for = (np.concatenate([_bits(b, m) for b, m in zip(rows[c].to_pylist(), sizes[sizes > 0].tolist())]) for c in ("owned", "wanted"))
            count, wanted = types[at], asked_for
            local = np.bincount(at[train], minlength=len(keys))[at] == count
            if n == 1:
                known = count
                probability = stats.unigram(count)
                log += np.log10(probability)
                continue
            context = np.where(is_first, stats.documents, lower_count[prev])
            where = np.where(is_first, len(lower_keys), lower_at[prev])
            all_here = np.where(is_first, int((~chunk.held).sum()) == stats.documents, lower_local[prev])
            names = np.append(lower_keys, mix(np.array([START ^ U(n)])))
            # sums of the owned n-grams for their contexts
            event = np.zeros(len(keys), np.int64)
            event[at[train]] = np.flatnonzero(train)
            e = event[owned]
            ctx, group = np.unique(where[e], return_inverse=True)
            seen = np.bincount(group, stats.kept(n, count[e]), len(ctx))
            lower = np.bincount(group, probability[e], len(ctx))
            total, here = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), bool)
            total[group], here[group] = context[e], all_here[e]
            alpha = np.full(len(names), np.nan)
            alpha[ctx[here]] = _log_alpha(seen[here], lower[here], total[here])
            far = np.flatnonzero(np.append(lower_wanted, True)[ctx])
            far = far[np.argsort(names[ctx[far]])]
            out.append(blob_rows(n, chunk.part, names[ctx[far]], {"seen": seen[far], "lower": lower[far], "total": total[far]}))
            # probabilities: seen here, or backed off through the context
            met = count > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                probability = np.where(met, stats.kept(n, count) / np.maximum(context, 1), probability)
            log = np.where(met, np.log10(probability), log)
            back = np.flatnonzero(~met & (context > 0))
            inside = back[all_here[back]]
            log[inside] += alpha[where[inside]]
            asked = back[~all_here[back]]
            if len(asked):
                name, own = names[where[asked]], doc[asked]
                by = np.lexsort((own, name))
                name, own = name[by], own[by]
                new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])))
                out.append(blob_rows(n, chunk.part, name[new], {"docs": own[new], "times": np.diff(np.append(new, len(own)))}))
        # one more row holds the documents: ids, base, score, known and all tokens, and two flags
        held, n_tokens = chunk.held, chunk.sizes + 1
        base = np.log10((known + 1) / (stats.tokens + stats.types + 1))
        own = [chunk.docs, chunk.nulls, held, n_tokens, np.bincount(doc, known > 0, len(held)).astype(np.int64), np.bincount(doc, base, len(held)), np.bincount(doc, log, len(held))]
        state = pa.table([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([chunk.part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (own[0], own[5], own[6], own[4], own[3])), pa.array([own[1].tobytes() + own[2].tobytes()], pa.binary())], names=[x.split()[0] for x in _SUMS.split(", ")])
        return pa.concat_tables([state, *out])

    return run


def _log_alpha(seen: np.ndarray, lower: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10((1 - seen / total) / np.maximum(1 - lower, 1e-12))


def _context(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending context keys and log10 alpha from the rows of sums."""
    sums = group.filter(group["seen"].is_valid())
    if not sums.num_rows:
        return np.zeros(0, U), np.zeros(0)
    sums = sums.sort_by("part")
    keys, at = np.unique(np.concatenate([unpack_sorted(b) for b in sums["keys"].to_pylist()]), return_inverse=True)
    col = lambda name: np.concatenate([unpack_numbers(b) for b in sums[name].to_pylist()])
    total = np.zeros(len(keys), np.int64)
    total[at] = col("total")
    return keys, _log_alpha(np.bincount(at, col("seen"), len(keys)), np.bincount(at, col("lower"), len(keys)), total)


def _weigh(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """log10 alpha of a bucket's contexts, added up for each document that backs off there."""
    keys, alpha = _context(group)
    asked = group.filter(group["docs"].is_valid())
    parts, docs, logs = [], [], []
    for part, blob, doc, times in zip(*(asked[c].to_pylist() for c in ("part", "keys", "docs", "times"))):
        own, at = np.unique(unpack_numbers(doc).astype(np.int64), return_inverse=True)
        value = alpha[np.searchsorted(keys, unpack_sorted(blob))] * unpack_numbers(times)
        parts.append(part)
        docs.append(own.tobytes())
        logs.append(np.bincount(at, value, len(own)).tobytes())
    return pa.table([pa.array(parts, pa.int64()), pa.array(docs, pa.binary()), pa.array(logs, pa.binary())], names=["part", "docs", "logs"])


def _finish(stats: Statistics):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda name, kind: np.frombuffer(left[name][0].as_py(), kind)
        docs, base, score, known, tokens = (get(*x) for x in (("keys", np.int64), ("seen", float), ("lower", float), ("total", np.int64), ("docs", np.int64)))
        nulls, held = get("times", bool).reshape(2, -1)
        score = score.copy()
        right = right.sort_by("bucket")
        for d, v in zip(right["docs"].to_pylist(), right["logs"].to_pylist()):
            score[np.frombuffer(d, np.int64)] += np.frombuffer(v)
        cols = [pa.array(docs, mask=nulls), pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(len(docs), stats.tokens)), pa.array(base), pa.array(score)]
        return pa.table(cols, names=[x.split()[0] for x in _DOCS.split(", ")])

    return run


@dataclass
class Model:
    """Written tables: chunks of token ids, answered counts; buckets, order and statistics.

    :meth:`drop` deletes the tables; scores that :func:`score` has returned don't need them.
    """

    chunks: DataFrame
    answers: DataFrame
    parts: list[DataFrame]
    buckets: int
    order: int
    stats: Statistics

    def drop(self) -> None:
        scratch.drop(self.chunks, *self.parts)


def fit(docs: DataFrame, order: int = ORDER, hold: Hold = every_seventh) -> Model:
    """Count the n-grams of the documents that ``hold`` doesn't hold out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(scratch.shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    chunks = scratch.table(rows.mapInArrow(_chunks(hold), _CHUNKS), "katz-chunks")
    answers, parts = None, []
    for n in range(1, order + 1):  # one order after another: only one order's keys are in shuffle files at a time
        part = scratch.table(chunks.mapInArrow(_requests(n, buckets), _COUNTS).groupBy("bucket", "ord").applyInArrow(_answer, _ANSWERS), "katz-answers")
        scratch.release(spark)
        parts.append(part)
        answers = part if answers is None else answers.unionByName(part)
    trained = chunks.select("held").mapInArrow(_trained, "n long").agg(F.sum("n")).first()[0] or 0
    return Model(chunks, answers, parts, buckets, order, statistics(answers, trained))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int((~np.frombuffer(b, bool)).sum()) for b in batch.column(0).to_pylist()], pa.int64())], names=["n"])


def score(model: Model) -> DataFrame:
    """Counts, unigram base score and log10 probability of every document of the model's table."""
    answered = model.answers.filter("part is not null").select("part", "ord", "bucket", "counts", "owned", "wanted")
    states = None
    for k in range(ROUNDS):  # only a share of the chunks and their answers is in shuffle files at a time
        own = F.pmod(F.xxhash64("part"), F.lit(ROUNDS)) == k
        both = model.chunks.filter(own).groupBy("part").cogroup(answered.filter(own).groupBy("part"))
        part = scratch.table(both.applyInArrow(_score(model.order, model.buckets, model.stats), _SUMS), "katz-states")
        scratch.release(model.chunks.sparkSession)
        states = part if states is None else states.unionByName(part)
    weighed = states.filter("bucket >= 0").groupBy("bucket", "ord").applyInArrow(_weigh_row, "bucket int, " + _PARTIAL)
    return states.filter("bucket < 0").groupBy("part").cogroup(weighed.groupBy("part")).applyInArrow(_finish(model.stats), _DOCS)


def _weigh_row(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    out = _weigh(key, group)
    return out.add_column(0, "bucket", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))


def _grams(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    _, distinct, _, total, _ = _merge(group.sort_by("part"))
    seen = total > 0
    n = int(seen.sum())
    return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(distinct[seen].view(np.int64)), pa.array(total[seen])], names=["bucket", "ord", "key", "n"])


def tables(docs: DataFrame, path: str, order: int = ORDER, hold: Hold = every_seventh) -> Model:
    """Fit, and write the counts as ``bucket, key, n`` partitioned by order, sorted within buckets."""
    model = fit(docs, order, hold)
    for n in range(1, order + 1):
        grams = model.chunks.mapInArrow(_requests(n, model.buckets), _COUNTS).groupBy("bucket", "ord").applyInArrow(_grams, _GRAMS)
        grams.drop("ord").write.option("compression", "zstd").parquet(f"{path}/ord={n}")
    return model
