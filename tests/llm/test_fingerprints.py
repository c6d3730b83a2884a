"""Closed syncmers: edits, equal texts, the next document and context freedom."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from lodestar.llm import fingerprints
from tests.llm.fixtures import SCHEMA, documents, sentence, with_clashes


def test_edits_and_neighbours(spark):
    rows = documents()
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    assert sorted(got) == sorted(order)
    prints = {}
    for k, doc in enumerate(order):
        t, nxt = text[doc], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[doc]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if nxt == t:
            assert r.near_next == 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    long = [d for d in order if len(text[d]) > 2000]
    assert sum(got[d].near_edited for d in long) / len(long) > 0.25


def test_anchors_are_context_free(spark):
    rng = random.Random(4)
    core = sentence(rng, 120)
    a, b = sentence(rng, 50) + " " + core + " " + sentence(rng, 50), sentence(rng, 9) + " " + core
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(a, core), (b, core)], "t string, c string")
    rows = frame.select(fingerprints.anchors(F.col("t"))["hash"].alias("t"), fingerprints.anchors(F.col("c"))["hash"].alias("c")).collect()
    for r in rows:
        assert set(r.c) <= set(r.t) and len(r.c) >= 20


def test_plan_has_no_python(spark):
    out = fingerprints.fingerprint_pairs(spark.createDataFrame(documents(), SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    rows = spark.createDataFrame([(5, "a b c"), (9, None)][:n], "doc_id long, text string")
    got = fingerprints.fingerprint_pairs(rows).collect()
    assert len(got) == n and (n != 1 or got[0].near_next == 1)


def test_nulls_and_ties(spark):
    docs = with_clashes(spark, documents())
    assert fingerprints.fingerprint_pairs(docs).count() == docs.count()


def test_positional_likeness(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("0:a 4:b", "0:a 5:b")], "x string, y string")
    assert frame.select(fingerprints.positional_likeness(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3)


def signed_hash(*values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(text):
    """Positions and hashes by the definition, one run of five units after another."""
    wide = "\u0e00-\u0eff\u2e80-\U0010ffff"
    units = []
    for w in re.split("[\x20\x09-\x0d]+", text.strip(" \t\n\x0b\x0c\r")):
        units += re.findall(f"[{wide}]|[^{wide}]{{0,7}}?[aeiouAEIOU0-4]|[^{wide}]{{1,8}}", w) if len(w) > 16 else [w]
    h = [signed_hash(u) for u in units]
    pairs = [signed_hash(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(pairs) - 3):
        run = pairs[i : i + 4]
        if min(run) in (run[0], run[3]):
            out.append((i, (signed_hash(*run) % 2**64) >> 32))
    return out or [(0, (signed_hash(*h) % 2**64) >> 32)]


def plain_likeness(a, b):
    x, y = ({(h, p - q) for (p, h), (q, _) in zip(f, f[:1] + f)} for f in (a, b))
    return len(x & y) / len(x | y)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(2)
    solid = "".join(rng.choice("abcdefgh019") for _ in range(700))
    chinese = "".join(rng.choice("今天气很好我们一起去公园散步") for _ in range(300))
    rows = documents() + [(500, solid, "", "", 0), (501, solid[:400] + "x" + solid[400:], "", "", 0), (502, chinese, "", "", 0), (503, chinese[:150] + chinese[155:], "", "", 0)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    spelled = lambda f: " ".join(f"{p}:{h:x}" for p, h in f)
    for k, doc in enumerate(order):
        t, nxt = text[doc], text[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, other, changed = (plain_anchors(x) for x in (t, nxt, edited))
        r = got[doc]
        assert (r.fingerprint, r.edited_fingerprint) == (spelled(own), spelled(changed))
        assert r.near_next == pytest.approx(plain_likeness(own, other)) and r.near_edited == pytest.approx(plain_likeness(own, changed))
    assert got[501].near_next > 0.5 and got[503].near_next > 0.5


@pytest.mark.parametrize("n", [253, 255, 256, 257, 300])
def test_texts_of_nearly_equal_length_are_alike(spark, n):
    t = sentence(random.Random(n), 200)[:n]
    frame = spark.createDataFrame([(2, t), (1, t[:-3])], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in fingerprints.fingerprint_pairs(frame).collect()}[2] > 0.5
