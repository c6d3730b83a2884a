"""Offset-preserving sub-word encoding and decoding for BPE piece models with byte fallback.

A model file is read here: pieces with scores, and the compiled character map (a double-array trie of
source strings with a pool of replacements). Normalising takes the longest prefix in the trie at each
place and records for every normalised byte the source byte it came from, so that every piece projects
to a span of original bytes. Merging takes the highest-scored pair, the leftmost among equals. No piece
holds a space mark after another character, so a text is encoded stretch by stretch and stretches are
held in a bounded cache, words with their ids, the spans of these and the bytes that these decode to.
The query decodes its ids and checks that their spans cover the text without a gap. A stretch of any length is
encoded whole, in time n log n.

Nulls: a null text is empty (no ids, empty decoded text); a null doc_id stays null. Repeated rows give
equal rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_ENTRIES = 600_000
SLICE = 256
#: Characters of a stretch up to which all pairs are looked through for each merge.
SHORT_STRETCH = 48
NEVER = float("-inf")
_STRETCH = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SPANS = "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        c = b[i]
        i += 1
        v |= (c & 127) << shift
        if c < 128:
            return v, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = struct.unpack("<f" if n == 4 else "<d", b[i : i + n])[0], i + n
        yield key >> 3, v


class CharMap:
    """Longest-prefix replacement through the compiled trie; without a map every character stands for itself."""

    def __init__(self, blob: bytes = b""):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack("<I", blob[:4])
            self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
            self.pool = blob[4 + size :]

    def longest(self, src: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest entry that begins at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(src)):
            c = src[i]
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.pieces: list[str] = []
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.unknown, self.prefix, self.squeeze = 0, True, True
        charsmap = b""
        for number, value in _fields(blob):
            if number == 1:
                d = dict(_fields(value))
                piece, kind, at = d[1].decode(), d.get(3, 1), len(self.pieces)
                self.pieces.append(piece)
                if kind == 1:
                    self.ids[piece], self.scores[piece] = at, d.get(2, 0.0)
                elif kind == 2:
                    self.unknown = at
                elif kind == 6:
                    self.byte_ids[int(piece[3:5], 16)] = at
                    self.byte_of[at] = int(piece[3:5], 16)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a space; stretches are not independent")
        self.map = CharMap(charsmap)
        self.cache: dict[str, tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = {}
        self.words: dict[str, tuple[str, bytes, bytes, int, int] | None] = {}
        self.names, self.path, self.library = [str(i) for i in range(len(self.pieces))], path, None
        self.sizes = self._sizes()
        self.spelled: tuple[list[str], list[bytes]] | None = None
        self.plain = not charsmap and self.prefix and not self.squeeze

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte it begins at."""
        src = text.encode()
        out, align, at, lead = bytearray(), [], 0, self.squeeze
        mark = MARK.encode()
        space = False
        while at < len(src):
            hit = self.map.longest(src, at)
            if hit is None:
                c = src[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                hit = n, src[at : at + n]
            n, piece = hit
            for ch in piece.decode(errors="replace"):
                if ch == " " and self.squeeze:
                    space = not lead
                    continue
                if space:
                    out += mark
                    align += [at] * len(mark)
                    space = False
                b = mark if ch == " " else ch.encode()
                out += b
                align += [at] * len(b)
                lead = False
            at += n
        if out and self.prefix:
            out[:0] = mark
            align[:0] = [0] * len(mark)
        align.append(len(src))
        return out.decode(), np.array(align, np.int64)

    def merge(self, stretch: str) -> list[str]:
        """Pieces of one stretch: highest-scored pair first, leftmost among equals."""
        if len(stretch) > SHORT_STRETCH:
            return self._merge_long(stretch)
        syms, get = list(stretch), self.scores.get
        pairs = [get(a + b, NEVER) for a, b in zip(syms, syms[1:])]
        while pairs and (best := max(pairs)) != NEVER:
            at = pairs.index(best)
            syms[at : at + 2] = [syms[at] + syms[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(syms[at - 1] + syms[at], NEVER)
            if at < len(pairs):
                pairs[at] = get(syms[at] + syms[at + 1], NEVER)
        return syms

    def _merge_long(self, stretch: str) -> list[str]:
        """The same by a heap over a linked list, for stretches of any length."""
        syms, scores = list(stretch), self.scores
        n = len(syms)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(syms, syms[1:])) if (s := scores.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if syms[i] else -1
            if j < 0 or syms[i] + syms[j] != piece:
                continue  # one of the two has been merged since
            syms[i], syms[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (s := scores.get(syms[a] + syms[b])) is not None:
                    heapq.heappush(heap, (-s, a, syms[a] + syms[b]))
        return [s for s in syms if s]

    def stretch(self, stretch: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
        """Ids of one stretch and the span of each in its bytes; the bytes of a fallback character share its span."""
        got = self.cache.get(stretch)
        if got is None:
            ids, begins, ends, at = [], [], [], 0
            for p in self.merge(stretch):
                n, i = len(p.encode()), self.ids.get(p)
                own = [i] if i is not None else [self.byte_ids[b] for b in p.encode()]
                ids += own
                begins += [at] * len(own)
                ends += [at + n] * len(own)
                at += n
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            got = self.cache[stretch] = tuple(ids), tuple(begins), tuple(ends)
        return got

    def encode(self, text: str) -> list[int]:
        norm, _ = self.normalize(text)
        return [i for s in _STRETCH.findall(norm) for i in self.stretch(s)[0]]

    def encode_spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the original byte span of each; the bytes of a fallback character share its span."""
        norm, align = self.normalize(text)
        ids, begins, ends, at = [], [], [], 0
        for s in _STRETCH.findall(norm):
            own, first, last = self.stretch(s)
            ids += own
            begins += [at + k for k in first]
            ends += [at + k for k in last]
            at += len(s.encode())
        return ids, align[np.array(begins, np.int64)].tolist(), align[np.array(ends, np.int64)].tolist()

    def _spelling(self) -> list[bytes]:
        """What each id decodes to."""
        if self.spelled is None or self.spelled[0] is not self.pieces:
            normal = set(self.ids.values())
            self.spelled = self.pieces, [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() if i in normal else b"" for i, p in enumerate(self.pieces)]
        return self.spelled[1]

    def _bytes(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self._spelling().__getitem__, ids))

    def _text(self, raw: bytes, first: int | None) -> str:
        text = raw.decode(errors="replace")
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(MARK) else text

    def decode(self, ids: list[int]) -> str:
        return self._text(self._bytes(ids), ids[0] if ids else None)

    def _fill(self, missing: list[str]) -> None:
        """Ids, what they decode to, their spans from the space before the word on, the first id and the word's bytes.

        The library splits the words, many in one call; :meth:`merge` gives the same pieces. Spans are laid out from
        the pieces' lengths, the space mark being three bytes in a piece and one in the source.
        """
        whole = [w for w in missing if w and w[-1] != MARK]
        # any other can join the next stretch: the whole text is taken apart instead
        self.words.update(dict.fromkeys((w for w in missing if not w or w[-1] == MARK), None))
        if not whole:
            return
        if self.library is None:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_file=self.path)
        found = self.library.encode(whole)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(n.sum()))
        size = self.sizes[flat]
        lead = np.maximum.accumulate(np.where(size > 0, np.arange(len(flat)), 0))  # later bytes of a fallback character share its span
        edge = np.concatenate([[0], np.cumsum(n)])
        end = np.cumsum(size)
        base = np.repeat(np.concatenate([[0], end])[edge[:-1]], n) + 2
        spans = np.stack([np.maximum((end - size)[lead] - base, 0), end[lead] - base], axis=1).astype(np.int32).tobytes()
        bytes_ = (np.add.reduceat(size, edge[:-1]) - 3).tolist()
        name, spelled = self.names.__getitem__, self._spelling().__getitem__
        for k, (w, ids) in enumerate(zip(whole, found)):
            self.words[w] = ",".join(map(name, ids)), b"".join(map(spelled, ids)), spans[8 * edge[k] : 8 * edge[k + 1]], ids[0], bytes_[k]

    def _sizes(self) -> np.ndarray:
        """Bytes that each id stands for in a normalised text; those of a fallback character stand with its first byte."""
        out = np.array([len(p.encode()) for p in self.pieces])
        for i, b in self.byte_of.items():
            out[i] = 0 if b & 0xC0 == 0x80 else 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return out

    def encoded(self, texts: list[str | None]) -> list[tuple[str, str, np.ndarray, np.ndarray]]:
        """(decimal ids joined by commas, text decoded from them, first and end source byte of each) of each text."""
        split = [t.split(" ") if t and self.plain else None for t in texts]
        new: set[str] = set()
        for ws in split:
            if ws:
                new.update(ws)
        missing = [w for w in new if w not in self.words]
        if missing:
            if len(self.words) + len(missing) > CACHE_ENTRIES:
                self.words.clear()
                missing = list(new)
            self._fill(missing)
        get, out = self.words.__getitem__, []
        for t, ws in zip(texts, split):
            got = list(map(get, ws)) if ws else [None]
            if None in got:
                ids, begins, ends = self.encode_spans(t or "")
                out.append((",".join(map(str, ids)), self.decode(ids), np.array(begins, np.int64), np.array(ends, np.int64)))
                continue
            names, raws, blobs, firsts, sizes = zip(*got)
            spans = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2)
            size = np.array(sizes, np.int64) + 1
            at = np.repeat(np.cumsum(size) - size - 1, np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 3)
            out.append((",".join(names), self._text(b"".join(raws), firsts[0]), np.maximum(spans[:, 0] + at, 0), spans[:, 1] + at))
        return out

    def id_strings(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each text."""
        return [x[:2] for x in self.encoded(texts)]

    def check(self, text: str, begins: np.ndarray, ends: np.ndarray) -> None:
        """Spans of a model that keeps every character cover the text in order, without a gap."""
        if not self.plain or not text:
            return
        same = (begins[1:] == begins[:-1]) & (ends[1:] == ends[:-1])
        if not len(begins) or begins[0] or ends[-1] != len(text.encode()) or not (same | (begins[1:] == ends[:-1])).all():
            raise ValueError("spans do not cover the text")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                texts = batch.column(1).to_pylist()
                got = m.encoded(texts)
                for t, x in zip(texts, got):
                    m.check(t or "", x[2], x[3])
                n = [len(x[2]) for x in got]
                sha = [[hashlib.sha256(x[k].encode()).hexdigest() for x in got] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number and checksum of the ids, and checksum of the decoded text, of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest(path), _DIGEST)


def _spans(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = [(*m.encode_spans(t or ""),) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)), pa.array([m.decode(r[0]) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "begins", "ends", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every text with their original byte spans, and the decoded text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_spans(path), _SPANS)
