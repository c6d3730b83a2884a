"""Tokenizer-library ids through a bounded cache of words.

Both public vocabularies split text before merging, and no merge crosses that split. Ids of a
white-space-bounded stretch therefore do not depend on its neighbours, and a dictionary of stretches
gives the library's ids for a text. Stretches that the split could join with a neighbour (white space
at an edge) send the whole text to the library, and so do strings of added tokens, which it finds before it splits.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Stretches held by one Python worker besides those of one batch; the cache is emptied when it is full.
CACHE_ENTRIES = 1_000_000

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CONTROL = "\x1c\x1d\x1e\x1f"
_LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: A run of Latin letters, and punctuation after it.
_WORD = re.compile(f"({_LETTERS.pattern})([{re.escape(_MARKS)}]*)")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: a printable byte is its own character, the others follow from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_SPACE = chr(_BYTE_LETTERS[32])


class WordIds:
    """``encode(texts)`` gives one little-endian uint32 byte string of ids per text."""

    def __init__(self, path: str, kind: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.kind, self.entries = kind, entries
        self.cache: dict[str, bytes | None] = {}
        self.first: dict[str, bytes | None] = {}
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids[0] if kind == "byte" else None
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        if kind != "byte":
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def _fill(self, cache: dict, missing: list[str], lead: str) -> None:
        """Encode stretches not held yet, in parts that the split keeps apart.

        Letters with punctuation after them are two parts, and a lone line break is one of its own.
        """
        alone, parts, ended = [], {}, []
        word, held, known_tail, letters = _WORD.fullmatch, cache.get, self.first.get, self._letters
        for w in missing:
            if m := word(w):
                core, tail = m.groups()
                if (ids := held(core)) is None:
                    cache[core] = ids = letters(core, lead)
                if tail:
                    if (after := known_tail(tail)) is None:
                        ended.append((w, ids, tail))
                    else:
                        cache[w] = ids + after
            elif self.newline is not None and (not w or w[0].isspace() or w[-1].isspace()):
                cache[w] = None
            elif self.newline is not None and "\n" in w:
                rows = w.split("\n")
                if all(p and not (p[0].isspace() or p[-1].isspace()) for p in rows):
                    parts[w] = rows
                else:
                    cache[w] = self.whole(lead + w)
            elif (core := w.rstrip(_MARKS)) and len(core) < len(w) and core.isalpha() and core.lower().isalpha():
                parts[w] = [core, w[len(core) :]]
            else:
                alone.append(w)
        known, heads, tails = frozenset(alone), dict.fromkeys(alone), {tail for *_, tail in ended}
        for p in parts.values():
            if p[0] not in cache:
                heads[p[0]] = None
            tails.update(p[1:])
        if nested := [p for p in heads if p not in cache and p[-1:] in _MARKS and p not in known]:
            for p in nested:
                del heads[p]
            self._fill(cache, nested, lead)
        self._encode(cache, list(heads), lead)
        if tails := [p for p in tails if p not in self.first]:
            self._fill(self.first, tails, "")
        first = self.first
        for w, ids, tail in ended:
            cache[w] = ids + first[tail]
        gap = b"" if self.newline is None else np.array([self.newline], "<u4").tobytes()
        for w, p in parts.items():
            got = [cache[p[0]], *(self.first[x] for x in p[1:])]
            cache[w] = self.whole(lead + w) if None in got else (gap if "\n" in w else b"").join(got)

    def _letters(self, w: str, lead: str) -> bytes:
        """A run of Latin letters is one part of the split, so the library's merges can be asked for directly."""
        if w.isascii():
            text = w.lower() if self.newline is None else _SPACE + w if lead else w
        else:
            text = (lead + w if self.newline is not None else w.lower()).encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _encode(self, cache: dict, stretches: list[str], lead: str) -> None:
        letters, others = _LETTERS.fullmatch, []
        for w in stretches:
            if letters(w):
                cache[w] = self._letters(w, lead)
            else:
                others.append(w)
        stretches = others
        if self.newline is not None:
            together, rest, gap = stretches, [], f"\n{lead}"
        else:
            together = [w for w in stretches if w.isalpha() and w.lower().isalpha()]
            rest, gap = [w for w in stretches if not (w.isalpha() and w.lower().isalpha())], " "
        for at in range(0, len(together), 64):
            part = together[at : at + 64]
            ids = np.array(self.tok.encode_batch_fast([lead + gap.join(part)], add_special_tokens=False)[0].ids, "<u4")
            if self.newline is not None:
                cuts, skip = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)], 1
            else:
                cuts, skip = (np.flatnonzero(self.ends[ids]) + 1).tolist(), 0
            if len(cuts) != len(part):
                rest += part
                continue
            raw, left = ids.tobytes(), 0
            for w, cut in zip(part, cuts):
                cache[w] = raw[4 * left : 4 * cut]
                left = cut + skip
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast([lead + w for w in part], add_special_tokens=False)):
                cache[w] = np.array(e.ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) + (len(self.first) if self.first is not self.cache else 0) > self.entries:
            self.cache.clear()
            self.first.clear()
        whole = {i: self.whole(t) for i, t in enumerate(texts) if t and any(x in t for x in self.added)}
        if whole:
            texts = ["" if i in whole else t for i, t in enumerate(texts)]
        out = self._bytes(texts) if self.kind == "byte" else self._words(texts)
        return [whole.get(i, ids) for i, ids in enumerate(out)] if whole else out

    def _words(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split() if t else [] for t in texts]
        cache = self.first = self.cache
        if missing := set().union(*split).difference(cache):
            self._fill(cache, list(missing), "")
        get = cache.__getitem__
        return [self.whole(t) if t and any(c in t for c in _CONTROL) else b"".join(map(get, ws)) for t, ws in zip(texts, split)]

    def _bytes(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split(" ") if t else None for t in texts]
        heads = {ws[0] for ws in split if ws}
        new = set().union(*filter(None, split))
        for cache, seen, lead in ((self.first, heads, ""), (self.cache, new, " ")):
            if missing := seen.difference(cache):
                self._fill(cache, list(missing), lead)
        get, out = self.cache.__getitem__, []
        for t, ws in zip(texts, split):
            if not ws:
                out.append(b"")
                continue
            ids = [*map(get, ws)]
            ids[0] = self.first[ws[0]]
            try:
                out.append(b"".join(ids))
            except TypeError:  # a stretch that the split could join with a neighbour has no ids of its own
                out.append(self.whole(t))
        return out


_held: dict[tuple[str, str, int], WordIds] = {}


def encoder(path: str, kind: str, entries: int = CACHE_ENTRIES) -> WordIds:
    """One encoder per worker process, vocabulary and size of cache."""
    key = (path, kind, entries)
    if key not in _held:
        _held[key] = WordIds(*key)
    return _held[key]
