"""Packing, binary ids and piece encoding against the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestar.llm import packing, pieces, token_binary
from lodestar.llm.token_cache import WordIds
from tests.llm.fixtures import SCHEMA, documents, with_clashes

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a", "a ", " a", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "a\tb", "a\r\nb", "it's we'll I'M don't's", "x'", "'s", "''ll", "3.14 1,000 a1b2", "éÀß naïve", "日本語 テキスト", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467",
    "<|endoftext|> <|startoftext|>", "</w> a</w>", " nbsp x", " sep ", "\x1c\x1f ctl \x00 nul", "a\x0bb\x0cc\x85d", "...!!! ?!", "!!!a", "a!!!b", "(x) [y] {z}", "#*$%&|<>", "-- a-b_c", "ǅ ŉ İ ſ", "é combining", "▁ x ▁▁y▁", "word▁mark", "a.b\nc.d\n", "Wort,\nnext", "'\n'", "a'\n'b", "tab\t\t\tx", " lead\n trail ", "﻿bom", "x​y", "²³½ Ⅷ",
]


def texts():
    rng = random.Random(12)
    alphabet = "ab é\n  .,'!1\t-#ß日\U0001f600 ▁ST"
    out = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    return out + [r[1] or "" for r in documents()]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_strings_of_added_tokens_and_long_stretches(path, kind):
    tok, enc = Tokenizer.from_file(path), WordIds(path, kind)
    end, start = "<|endoftext|>", "<|startoftext|>"
    rng = random.Random(8)
    solid = "".join(rng.choice("abcdefgh0123日本") for _ in range(100_000))
    part = [f"hello {end} world", f"{end}hello", f"hello{end}", f"{start} a{end}{end}b \n{start}", "plain <|endoftext |> text", end, f"a {end.upper()} b", "", None, solid, f"{solid} {end}"]
    for t, got in zip(part, enc.encode(part)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_cached_ids_are_the_library_s(path, kind):
    tok = Tokenizer.from_file(path)
    enc, all_ = WordIds(path, kind, entries=3000), texts()
    for lo in range(0, len(all_), 37):
        part = all_[lo : lo + 37]
        for t, got, want in zip(part, enc.encode(part), tok.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)


def library_ids(path, rows, end):
    tok = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in tok.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_binary_ids_come_back_in_order(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    folder = f"file://{tmp_path}/shards"
    manifest = token_binary.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE, "byte", 0, folder, 5)
    got = {r.doc_id: r for r in token_binary.read_tokens(manifest, folder).collect()}
    start = 0
    for (doc, _), ids in sorted(zip(rows, library_ids(BYTE, rows, 0)), key=lambda x: x[0][0]):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["small", "outliers", "wide", "equal"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    x = {"small": rng.integers(5, 900, n), "outliers": np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.integers(0, 16, n)), "wide": rng.integers(0, 2**32, n), "equal": np.full(n, 2**32 - 1)}[kind].astype(np.uint32)
    body, starts, head = token_binary.encode_blocks(x)
    assert (token_binary.decode_blocks(body, starts, head, 0, len(head))[:n] == x).all()
    if len(head) > 1:
        k = len(head) - 2
        assert (token_binary.decode_blocks(body[starts[k] :], starts, head, k, k + 1, int(starts[k])) == x[k * 1024 : (k + 1) * 1024]).all()


def test_segments_of_a_shard(monkeypatch):
    counts = np.array([3, 0, 2000, 1])
    ids = np.arange(2004, dtype=np.uint32)
    one = b"".join(token_binary.shard_bytes([7, None, -2, 9], counts, ids))
    got = list(token_binary.read_shard(io.BytesIO(one + one)))
    assert [g[0] for g in got] == [7, None, -2, 9] * 2
    assert [g[1] for g in got] == [0, 3, 3, 2003, 2004, 2007, 2007, 4007]
    assert np.frombuffer(got[6][2], "<u4").tolist() == list(range(3, 2003))


def test_binary_nulls_ties_and_empty_tables(spark, tmp_path):
    docs = with_clashes(spark, documents())
    folder = f"file://{tmp_path}/s"
    out = token_binary.read_tokens(token_binary.write_tokens(docs, BYTE, "byte", 0, folder), folder).collect()
    assert len(out) == docs.count() and min(out, key=lambda r: r.start).doc_id is None
    end = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    assert token_binary.read_tokens(token_binary.write_tokens(docs.limit(0), BYTE, "byte", 0, folder), folder).collect() == []


@pytest.mark.parametrize("length", [16, 256, 4096])
def test_packed_pieces_hold_every_id_once(spark, length):
    rows = documents()
    ids = {r[0]: x for r, x in zip(rows, library_ids(WORD, rows, 2))}
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), WORD, "word", 2, length).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, own in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == crc(own[at : at + r.length])
            at += r.length
        assert at == len(own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= total / length * 1.05 + 1


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 50, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free: list[int] = []
        for i in np.argsort(-lengths, kind="stable").tolist():
            b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= lengths[i]


def test_packing_takes_nulls_and_empty_tables(spark):
    docs = with_clashes(spark, documents())
    assert packing.pack(docs, WORD, "word", 2).filter("start = 0").count() == docs.count()
    assert packing.pack(docs.limit(0), WORD, "word", 2).collect() == []


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_pieces_are_the_library_s(library):
    model = pieces.PieceModel(PIECE)
    for t in texts():
        ids = library.encode(t)
        assert model.encode(t) == ids, repr(t)
        assert model.decode(ids) == library.decode(ids), repr(t)
    all_ = texts()
    for t, (ids, decoded) in zip(all_, model.id_strings(all_)):
        own = library.encode(t)
        assert ids == ",".join(map(str, own)) and decoded == library.decode(own), repr(t)


def test_spans_project_to_the_source(library):
    model = pieces.PieceModel(PIECE)
    for t in texts():
        ids, begins, ends = model.encode_spans(t)
        raw = t.encode()
        assert ids == library.encode(t)
        assert all(0 <= a <= b <= len(raw) for a, b in zip(begins, ends))
        covered = bytearray()
        last = (-1, -1)
        for a, b in zip(begins, ends):
            if (a, b) != last:
                covered += raw[max(a, last[1]) : b]
            last = (a, b)
        assert bytes(covered) == raw


def test_character_map_takes_the_longest_prefix():
    def unit(label, offset, leaf):
        return label | (1 << 8 if leaf else 0) | offset << 10

    # a trie of "a" -> "X" and "ab" -> "YY", laid out by hand
    units = [0] * 1024
    units[0] = 512 >> 6 << 10
    node = 0 ^ (units[0] >> 10)
    at_a = node ^ ord("a")
    units[at_a] = unit(ord("a"), 256, True)
    below = at_a ^ 256
    units[below] = 1 << 31 | 0
    at_b = below ^ ord("b")
    units[at_b] = unit(ord("b"), 128, True)
    units[at_b ^ 128] = 1 << 31 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"X\0YY\0"
    m = pieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"YY") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"xab", 0) is None and m.longest(b"xab", 1) == (2, b"YY")


def test_piece_digests(spark, library):
    rows = documents()
    got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(rows, SCHEMA), PIECE).collect()}
    for r in rows:
        ids = library.encode(r[1] or "")
        assert (got[r[0]].n_tokens, got[r[0]].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r[0]].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    docs = with_clashes(spark, rows)
    assert pieces.digests(docs, PIECE).count() == docs.count() and pieces.digests(docs.limit(0), PIECE).collect() == []
    assert pieces.encode(docs, PIECE).count() == docs.count()


def test_digests_come_from_ids_and_spans(library):
    model, all_ = pieces.PieceModel(PIECE), texts()
    for t, (ids, decoded, begins, ends) in zip(all_, model.encoded(all_)):
        want = model.encode_spans(t)
        assert (ids, begins.tolist(), ends.tolist()) == (",".join(map(str, want[0])), *want[1:]), repr(t)
        assert decoded == model.decode(want[0])
        model.check(t, begins, ends)
    wrong = pieces.PieceModel(PIECE)
    wrong.pieces[wrong.encode("one house")[-1]] = "▁mouse"
    assert wrong.id_strings(["one house"])[0][1] != "one house"


def test_long_stretches_merge_by_the_heap(library, monkeypatch):
    rng, model = random.Random(5), pieces.PieceModel(PIECE)
    for bound in (0, 48):
        monkeypatch.setattr(pieces, "SHORT_STRETCH", bound)
        model.cache.clear()
        for _ in range(300):
            t = "".join(rng.choice("abcdeiou stнд日,.1") for _ in range(rng.randrange(150)))
            assert model.encode(t) == library.encode(t)
    solid = "".join(rng.choice("abcdefgh日") for _ in range(100_000))
    assert model.encode(solid) == library.encode(solid)
