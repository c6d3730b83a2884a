"""The distributed model against a plain recursive one, and its normalisation."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import katz
from lodestar.llm.textcore import buffers, words
from tests.llm.fixtures import SCHEMA, documents, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


class Plain:
    """Katz backoff over dictionaries, evaluated recursively."""

    def __init__(self, texts, order):
        self.order, self.count = order, [None, *(Counter() for _ in range(order))]
        self.context, self.after = defaultdict(int), defaultdict(set)
        for t in texts:
            ws = [0] * (order - 1) + tokens(t)
            for i in range(order - 1, len(ws)):
                for n in range(1, order + 1):
                    g = tuple(ws[i - n + 1 : i + 1])
                    self.count[n][g] += 1
                    self.context[g[:-1]] += 1
                    self.after[g[:-1]].add(g[-1])
        self.total = sum(self.count[1].values())
        self.factor = {}
        for n in range(1, order + 1):
            seen = Counter(self.count[n].values())
            self.factor[n] = katz.good_turing([seen[r] for r in range(1, katz.K + 2)])

    def kept(self, n, c):
        return self.factor[n][c] * c if c <= katz.K else c - katz.LARGE

    def unknown(self):
        return 1 - sum(self.kept(1, c) for c in self.count[1].values()) / self.total if self.total else 1.0

    def p(self, ctx, w):
        n = len(ctx) + 1
        c = self.count[n][*ctx, w]
        if c:
            return self.kept(n, c) / self.context[ctx]
        if n == 1:
            return self.unknown()
        return self.alpha(ctx) * self.p(ctx[1:], w)

    def alpha(self, ctx):
        if not self.context[ctx]:
            return 1.0
        seen = self.after[ctx]
        return (1 - sum(self.p(ctx, w) for w in seen)) / (1 - sum(self.p(ctx[1:], w) for w in seen))

    def score(self, text):
        ws = [0] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(ws[i - self.order + 1 : i]), ws[i])) for i in range(self.order - 1, len(ws)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_a_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 4000)
    rows = documents()
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2}
    plain = Plain([r[1] for r in rows if r[0] not in held], order)
    got = katz.score(katz.fit(spark.createDataFrame(rows, SCHEMA).repartition(5), order)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    types = len(plain.count[1])
    for r in got:
        ws = tokens(text[r.doc_id])
        assert r.held_out == (r.doc_id in held) and r.n_tokens == len(ws) and r.train_tokens == plain.total
        counts = [plain.count[1][w,] for w in ws]
        assert r.n_known == sum(c > 0 for c in counts)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (plain.total + types + 1)) for c in counts))
        assert r.score == pytest.approx(plain.score(text[r.doc_id]), abs=1e-6)
    assert held


def test_every_context_sums_to_one():
    plain = Plain([r[1] for r in documents()[:20]], 3)
    vocabulary = [g[0] for g in plain.count[1]] + ["never-seen"]
    for ctx in [(), (0,), (0, 0), *list(plain.after)[:40]]:
        if len(ctx) < 3:
            assert sum(plain.p(ctx, w) for w in vocabulary) == pytest.approx(1)


def test_held_out_text_is_likelier_than_by_the_base(spark, sf_dir):
    model = katz.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scores = katz.score(model)
    model.drop()
    rows = scores.filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = with_clashes(spark, documents())
    out = katz.score(katz.fit(docs)).collect()
    assert len(out) == docs.count() and all(math.isfinite(r.score) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert katz.score(katz.fit(docs.limit(0))).collect() == []
    assert katz.score(katz.fit(docs, hold=lambda d: True)).select("score").distinct().collect()[0].score == 0
    model = katz.tables(docs, str(tmp_path / "model"))
    table = spark.read.parquet(str(tmp_path / "model"))
    assert table.filter("ord = 1").agg({"n": "sum"}).first()[0] == model.stats.tokens
    assert {r.ord for r in table.select("ord").distinct().collect()} == {1, 2, 3}


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), np.array([5, 5, 5, 2**63], np.uint64)):
        assert (katz.unpack_sorted(katz.pack_sorted(x)) == x).all()
    for x in (np.array([0, 300, 70000]), np.zeros(0, int), np.array([1.5, -2.0])):
        assert (katz.unpack_numbers(katz.pack_numbers(x)) == x).all()


def test_a_chunk_s_words_are_hashed_in_parts(monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
    sizes, hashed = [], katz.split_groups
    monkeypatch.setattr(katz, "HASH_BYTES", 1 << 10)
    monkeypatch.setattr(katz, "split_groups", lambda col, lower, size: (sizes.append(len(x[2])) or x for x in hashed(col, lower, size)))
    texts = [" ".join(f"W{k * j % 97}" for j in range(60)) for k in range(50)] + ["", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(52)], "text": pa.array(texts, pa.string())})
    rows = list(katz._chunks(katz.every_seventh)(iter([batch])))
    chunk = katz.Chunk.read(rows[0], 0)
    assert len(rows) == 1 and len(sizes) > 5 and chunk.sizes.tolist() == [60] * 50 + [0, 0]
    assert (chunk.hashes == words(*buffers(batch.column(1)), True)[0]).all()
