"""Removal of long word sequences that an earlier document holds, by suffix automata of reference shards.

A window is ``min_words`` consecutive words of one document. A word goes if a window covers it whose word
sequence also starts in a document with a smaller doc_id; windows are judged on the input.

1. Every window is filed under its smallest half-length word-run hash (its anchor); equal windows have
   equal anchors, and consecutive windows with one anchor form a run. Only anchors met twice go on.
2. A run that a smaller document holds word for word goes whole.
3. Runs that share an anchor but differ form a reference shard. Its suffix automaton is built from the
   runs in ascending doc_id, and every run streams through it first: matching statistics of at least
   ``min_words`` mark the spans to go. Shards are routed by anchor instead of being broadcast to all
   documents, as broadcasting all shards to all documents costs the square of the corpus.
4. A shard of over MAX_SHARD_RUNS runs is settled window by window with partial aggregation instead, so
   that no task holds a shard without bound.

Nulls: a null text has no words; a null doc_id counts as smaller than all others. Rows with equal doc_id
don't remove each other's words. Texts under ``min_words`` are left whole. Empty tables give no rows.
Columns of any name are carried through by :func:`strip_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.textcore import U, buffers, hash_spans, mix, rolling, spans, split_groups, within

#: Windows of a run, and runs and words of a shard that one automaton takes.
MAX_RUN, MAX_SHARD_RUNS, MAX_SHARD_WORDS = 4096, 512, 1 << 18
_RUNS = "doc long, tie long, anchor long, run long, at int, n int"
_REGIONS = "doc long, tie long, anchor long, at int, n int, large boolean, words binary"
_SPANS = "doc long, tie long, at int, n int"
_LOW = -(2**63)


class SuffixAutomaton:
    """Of several word sequences; ``match`` gives matching statistics against all sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length, last = self.next, self.link, self.len, 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def match(self, words: list[int]) -> list[int]:
        """Length of the longest suffix ending at each word that occurs in an added sequence."""
        nxt, link, length = self.next, self.link, self.len
        state, held, out = 0, 0, []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                held = length[state]
            to = nxt[state].get(c)
            if to is None:
                held = 0
            else:
                state, held = to, held + 1
            out.append(held)
        return out


def _window_min(g: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    step, m = 1, g
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _runs(min_words: int):
    half = min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, h, w in split_groups(batch.column(2), False):
                at = within(w, min_words)
                if not len(at):
                    continue
                own = np.searchsorted(w, at, "right") - 1
                anchor = _window_min(rolling(h, half), min_words - half + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                place %= MAX_RUN
                first = np.flatnonzero(place == 0)
                n = np.diff(np.append(first, len(at)))
                windows = rolling(h, min_words, 0x9E6C63D0676A9A99)[at]
                whole = mix(np.add.reduceat(mix(windows + place.astype(U)), first) + n.astype(U))
                rows = own[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[lo:hi][rows]), pa.array(tie[lo:hi][rows]), _signed(anchor[first]), _signed(whole), pa.array((at[first] - w[rows]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc", "tie", "anchor", "run", "at", "n"],
                )

    return run


def _regions(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties, texts, lists = (batch.column(k) for k in range(4))
            rows: list[list] = [[] for _ in range(7)]
            done = 0
            for lo, hi, h, w in split_groups(texts, False):
                for k in range(lo, hi):
                    doc, tie = docs[k].as_py(), ties[k].as_py()
                    for x in lists[k].as_py():
                        a = w[k - lo] + x["at"]
                        for col, v in zip(rows, (doc, tie, x["anchor"], x["at"], x["n"], x["large"], h[a : a + x["n"] + min_words - 1].tobytes())):
                            col.append(v)
                done = hi
            assert done == batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.binary())], names=["doc", "tie", "anchor", "at", "n", "large", "words"])

    return run


def _match(min_words: int):
    """Shards arrive whole, in order of anchor, then doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, pending, pending_doc = None, None, [], None
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(4)]
            for doc, tie, anchor, at, n, words in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if anchor != shard:
                    shard, automaton, pending, pending_doc = anchor, SuffixAutomaton(), [], doc
                elif doc != pending_doc:
                    for seq in pending:
                        automaton.add(seq)
                    pending, pending_doc = [], doc
                seq = np.frombuffer(words, np.int64).tolist()
                pending.append(seq)
                if len(automaton.next) == 1:
                    continue
                found = np.array(automaton.match(seq)[min_words - 1 :]) >= min_words
                edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for col, v in zip(rows, (doc, tie, at + a, b - a)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], names=["doc", "tie", "at", "n"])

    return run


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, tie, anchor, at, n, words in zip(*(batch.column(k).to_pylist() for k in range(6))):
                h = rolling(np.frombuffer(words, U), min_words, 0x9E6C63D0676A9A99).view(np.int64)
                for col, v in zip(cols, (np.full(n, doc), np.full(n, tie), np.full(n, anchor), h, np.arange(at, at + n))):
                    col.append(v)
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "tie", "anchor", "window", "at"])

    return run


def repeated_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """``doc, tie, items``: first words and numbers of the windows to remove, one row per document that has any.

    ``rows`` has doc (its id, not null), tie (a hash of its text) and text.
    """
    runs = rows.select("doc", "tie", "text").mapInArrow(_runs(min_words), _RUNS)
    twice = runs.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    met = scratch.table(runs.join(twice, "anchor", "left_semi"), "substring-runs")
    scratch.release(rows.sparkSession)
    distinct = met.groupBy("anchor", "run").agg(F.min("doc").alias("first"), F.min("n").alias("n"))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (min_words - 1)).alias("words")).filter("kinds > 1")
    judged = scratch.table(met.join(distinct.drop("n"), ["anchor", "run"]).join(several, "anchor", "left").filter("doc > first or kinds is not null"), "substring-judged")
    scratch.drop(met)
    scratch.release(rows.sparkSession)
    gone = judged.filter("doc > first").select("doc", "tie", "at", "n")
    # A flag of each run, not a join with the large anchors: Spark takes a join on the anchor for the shuffle by anchor
    # and, once it has broadcast the anchors instead, leaves shards spread over tasks.
    open_ = judged.filter("doc = first").withColumn("large", (F.col("kinds") > MAX_SHARD_RUNS) | (F.col("words") > MAX_SHARD_WORDS))
    lists = scratch.table(open_.groupBy("doc", "tie").agg(F.collect_set(F.struct("anchor", "at", "n", "large")).alias("items")), "substring-open")
    regions = scratch.table(rows.select("doc", "tie", "text").join(lists.hint("merge"), ["doc", "tie"]).dropDuplicates(["doc", "tie"]).select("doc", "tie", "text", "items").mapInArrow(_regions(min_words), _REGIONS), "substring-regions")
    scratch.release(rows.sparkSession)
    small = regions.filter("not large").select("doc", "tie", "anchor", "at", "n", "words")
    matched = small.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc", "tie", "at").mapInArrow(_match(min_words), _SPANS)
    windows = regions.filter("large").select("doc", "tie", "anchor", "at", "n", "words").mapInArrow(_windows(min_words), "doc long, tie long, anchor long, window long, at long")
    earliest = windows.groupBy("anchor", "window").agg(F.min("doc").alias("first"))
    late = windows.join(earliest, ["anchor", "window"]).filter("doc > first").select("doc", "tie", F.col("at").cast("int").alias("at"), F.lit(1).alias("n"))
    spans_ = scratch.table(gone.unionByName(matched).unionByName(late).groupBy("doc", "tie").agg(F.collect_set(F.struct("at", "n")).alias("items")), "substring-spans")
    scratch.drop(judged, lists, regions)
    scratch.release(rows.sparkSession)
    return spans_


def _covered(n_words: int, items: list[dict] | None, min_words: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for x in items or ():
        edge[x["at"]] += 1
        edge[x["at"] + x["n"] + min_words - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _keyed(docs: DataFrame, others: list[str]) -> DataFrame:
    """doc, tie, text, and a struct of the other columns."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))


def _digest(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, items in zip(batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist()):
                ws = text.encode().split()
                n.append(len(ws))
                if items:
                    out = _covered(len(ws), items, min_words)
                    gone.append(int(out.sum()))
                    ws = [ws[i] for i in np.flatnonzero(~out).tolist()]
                else:
                    gone.append(0)
                sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def removal_digests(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Words, removed words and checksum of the kept words of every document."""
    rows = _keyed(docs, ["doc_id"])
    joined = rows.join(repeated_spans(rows, min_words).hint("merge"), ["doc", "tie"], "left")
    return joined.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "items").mapInArrow(_digest(min_words), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _without(text: str, items: list[dict], min_words: int) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = spans(raw, np.array([0, len(raw)]))
    gone = _covered(len(start), items, min_words)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        kept.append(raw[at : start[a]].tobytes())
        at = end[b - 1]
    return (b"".join(kept) + raw[at:].tobytes()).decode().strip(" \t\n\r\x0b\x0c")


def _strip(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            hit = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                out = texts.to_pylist()
                for i in hit.tolist():
                    out[i] = _without(out[i], batch.column(2)[i].as_py(), min_words)
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2).is_valid()], names=["row", "text", "hit"])

    return run


def strip_documents(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents without the spans, in the columns they came with; ``n_chars`` follows a changed text."""
    rows = _keyed(docs, [c for c in docs.columns if c != "text"])
    return scratch.restored(docs, rows, repeated_spans(rows, min_words), _strip(min_words))
