"""Near-duplicate documents, repeated spans and fuzzy lines against brute force."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import buckets, line_dedup, minhash_dedup, substring_dedup
from tests.llm.fixtures import SCHEMA, WORDS, documents, sentence, with_clashes

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = documents()
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(ids, linked)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert len(linked) > 10


def test_near_duplicate_chains_join_through_every_link(spark):
    rng = random.Random(3)
    words, rows = sentence(rng, 400).split(), []
    for k in range(40):
        rows.append((1000 - k, " ".join(words), "en", "s", 1))
        words = [*words[8:], *(f"w{k}x{j}" for j in range(8))]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in out} == {961}


def test_hot_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    words = sentence(rng, 120).split()
    rows = []
    for k in range(3000):
        own = list(words)
        own[rng.randrange(120)] = f"v{k}"
        rows.append((k, " ".join(own), "en", "s", 1))
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 3000


@pytest.mark.parametrize("trees, links", [([7] * 6, 0), ([7, 7, 7, 8, 8, 8], 1), ([1, 2, 3, 4, 5, 6], 5)])
def test_nodes_of_one_tree_are_not_spanned_again(trees, links):
    n = len(trees)
    rows = pa.RecordBatch.from_pydict({"i": [0] * n, "j": [0] * n, "side": [2] * n, "key": [3] * n, "node": [*range(1, n + 1)], "n": [9] * n, "sketch": [0] * n, "comp": [*range(1, n + 1)], "tree": trees})
    out = list(buckets._across(lambda a, b, c, d: np.ones(np.broadcast(a, c).shape, bool), iter([rows])))
    assert sum(b.num_rows for b in out) == links


def test_rows_of_the_commonest_label_are_dealt_to_the_others_only(spark):
    own = [(1, k, 7 if k < 1500 else k) for k in range(1540)] + [(2, k, k) for k in range(1100)] + [(3, k, k) for k in range(40)]
    rows = spark.createDataFrame(own, "key long, node long, comp long")
    weight = F.count("*") / buckets.BLOCK
    sizes = rows.groupBy("key").agg(weight.alias("size"))
    blocks = {}
    out = buckets._dealt(rows, buckets._sized(rows, sizes, "comp", weight), "comp").collect()
    for r in out:
        for side in {0: (0,), 1: (1,), 2: (0, 1)}[r.side]:
            blocks.setdefault((r.key, r.i, r.j), ([], []))[side].append(r.node)
    for key, comps in ((k, {n: c for kk, n, c in own if kk == k}) for k in (1, 2, 3)):
        met = np.zeros((len(comps), len(comps)), bool)
        for (k, *_), (a, b) in blocks.items():
            if k == key:
                met[np.ix_(a, b)] = True
        apart = np.array([*comps.values()])[:, None] != np.array([*comps.values()])
        assert not (apart & ~(met | met.T)).any()
    made = [sum(r.key == k for r in out) for k in (1, 2, 3)]
    assert made[0] < 1.2 * 1540 and made[2] == 40


@pytest.mark.parametrize("few, dense, links", [(8, False, 15), (2, True, 5), (0, True, 5)])
def test_few_likely_pairs_come_out_one_by_one(few, dense, links):
    n = 6
    rows = pa.RecordBatch.from_pydict({"i": [0] * n, "j": [0] * n, "side": [2] * n, "key": [3] * n, "node": [*range(1, n + 1)], "n": [9] * n, "sketch": [0] * n, "comp": [*range(1, n + 1)], "tree": [*range(1, n + 1)]})
    out = pa.Table.from_batches(buckets._across(lambda a, b, c, d: np.ones(np.broadcast(a, c).shape, bool), iter([rows]), few))
    assert out.num_rows == links and set(out["dense"].to_pylist()) == {dense}


@pytest.mark.parametrize("few", [0, 1, 8])
def test_links_don_t_depend_on_how_pairs_come_out(spark, monkeypatch, few):
    monkeypatch.setattr(buckets, "BLOCK", 8)
    rng = random.Random(4)
    at = {node: rng.randrange(3000) for node in range(400)}
    rows = [(node % 3 if node % 5 else 9, node, 9, 0) for node in at] + [(9, node, 9, 0) for node in range(1, 400, 7) if node % 5]
    content = spark.createDataFrame([(n, str(v).encode()) for n, v in at.items()], "node long, content binary")
    likely = lambda a, b, c, d: np.ones(np.broadcast(a, c).shape, bool)
    agrees = lambda a, b: abs(int(a) - int(b)) <= 3
    roots = {r.id: r.root for r in buckets.link_shared(spark.createDataFrame(rows, buckets.ROWS), likely, lambda named: content.join(named, "node", "left_semi"), agrees, few=few).collect()}
    keys = {}
    for key, node, *_ in rows:
        keys.setdefault(key, []).append(node)
    for nodes in keys.values():
        for a in nodes:
            for b in nodes:
                assert abs(at[a] - at[b]) > 3 or roots.get(a, a) == roots.get(b, b)


def brute_spans(rows, k=50):
    first = {}
    words = {i: SPLIT.findall(t or "") for i, t in rows}
    for i, ws in words.items():
        for at in range(len(ws) - k + 1):
            g = tuple(ws[at : at + k])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for at in range(len(ws) - k + 1):
            if first[tuple(ws[at : at + k])] < i:
                gone |= set(range(at, at + k))
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in gone).encode()).hexdigest())
    return out


def test_repeated_spans_match_brute_force(spark):
    rows = documents(seed=8, n=80)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digests(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert got == brute_spans([(r[0], r[1]) for r in rows])
    assert sum(x[1] for x in got.values()) > 500


@pytest.mark.parametrize("most", [2, 512])
def test_overlapping_shards_and_periods(spark, monkeypatch, most):
    """Texts with few different words share anchors in many ways; large shards are settled without an automaton."""
    monkeypatch.setattr(substring_dedup, "MAX_SHARD_RUNS", most)
    rng = random.Random(21)
    base = [rng.choice("ab") for _ in range(300)]
    rows = []
    for k in range(60):
        at, n = rng.randrange(200), rng.randrange(40, 100)
        rows.append((k, " ".join([*(rng.choice("cd") for _ in range(rng.randrange(9))), *base[at : at + n], *["z"] * rng.randrange(0, 120)])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows)


def test_shards_stay_whole_where_spark_broadcasts_small_tables(spark, monkeypatch):
    """Many shards of runs that differ and some large ones, under settings that turn joins into broadcasts as they run."""
    monkeypatch.setattr(substring_dedup, "MAX_SHARD_RUNS", 8)
    rng = random.Random(33)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(600):
        passage = [rng.choice(words) for _ in range(80)] if k % 6 == 0 and k < 560 else passage
        head, tail = rng.randrange(20), rng.randrange(60, 80)
        rows.append((k, " ".join([*(rng.choice(words) for _ in range(60)), *passage[head:tail], *(rng.choice(words) for _ in range(60))])))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "8k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_spans(rows)


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        auto = substring_dedup.SuffixAutomaton()
        for t in texts:
            auto.add(t)
        probe = [rng.randrange(4) for _ in range(40)]
        inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [next((n for n in range(e, 0, -1) if tuple(probe[e - n : e]) in inside), 0) for e in range(1, 41)]
        assert auto.match(probe) == want


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_matches_the_table():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(30))) for _ in range(2))
        assert line_dedup.edits(a, b) == lev(a, b)
        most = rng.randrange(12)
        assert min(line_dedup.edits(a, b, most), most + 1) == min(lev(a, b), most + 1)
    long = "".join(rng.choice("abcdef ") for _ in range(900))
    assert line_dedup.edits(long, long[:400] + "zz" + long[405:]) == lev(long, long[:400] + "zz" + long[405:])


def brute_lines(rows):
    """Every pair of lines by edit similarity, without keys or sketches."""
    table = {b: 32 for b in range(128) if (not chr(b).isalnum() and b >= 32) or 9 <= b <= 13} | {b: b + 32 for b in range(65, 91)}
    lines = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, x in enumerate((t or "").split("\n") if t else []):
            ws = [w for w in re.split("[ ]+", x.translate(table)) if w]
            if ws:
                lines.append((i, k, " ".join(ws)))
    names = sorted({x[2] for x in lines})
    linked = [(a, b) for a in names for b in names if a < b and min(len(a), len(b)) >= line_dedup.MIN_CHARS and max(len(a), len(b)) - lev(a, b) >= 0.8 * max(len(a), len(b))]
    root = components(names, linked)
    met, gone = set(), Counter()
    for i, k, name in lines:
        if root[name] in met:
            gone[i, k] = 1
        met.add(root[name])
    out = {}
    for i, t in rows:
        own = (t or "").split("\n") if t else []
        out[i] = (len(own), sum(gone[i, k] for k in range(len(own))), hashlib.sha256("\n".join(x for k, x in enumerate(own) if not gone[i, k]).encode()).hexdigest())
    return out, len(linked)


def test_fuzzy_lines_match_brute_force(spark):
    rng, base = random.Random(6), random.Random(1)
    stock = [sentence(base, n) for n in (5, 14, 14, 30, 60, 90, 120)]
    rows = []
    for k in range(70):
        own = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(stock) if rng.random() < 0.5 else sentence(rng, rng.randrange(2, 9))
            own.append(rng.choice([x, x.upper(), f"* {x}!", x.replace("a", "o", 1), x + " s", x]))
        rows.append((k, "\n".join(own)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "ä ö ü ß\nÄ ö ü ß")]
    want, linked = brute_lines(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] <= want[k][1] for k in want)
    assert all(got[k][2] == want[k][2] for k in want if got[k][1] == want[k][1])
    assert sum(x[1] for x in got.values()) >= 0.98 * sum(x[1] for x in want.values()) > 60 and linked > 10


def test_a_megabyte_line_is_compared_whole(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(130_000))
    other = long[:300_000] + " changed here " + long[300_020:-7] + "tail"
    solid = "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(100_000))
    assert gram_removals(spark, [long, other, solid, solid[:50_000] + "zzz" + solid[50_003:], "x" * 100_000]) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


@pytest.mark.parametrize("keep", [minhash_dedup.keep_first, substring_dedup.strip_documents, line_dedup.strip_lines])
def test_stages_keep_columns_and_take_nulls_and_empty_tables(spark, keep):
    docs = with_clashes(spark, documents())
    out = keep(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert 0 < len(rows) <= docs.count()
    if keep is not minhash_dedup.keep_first:
        assert len(rows) == docs.count()
    assert any(r.doc_id is None for r in rows)
    empty = docs.limit(0)
    assert keep(empty).collect() == []


@pytest.mark.parametrize("digest", [minhash_dedup.near_duplicates, substring_dedup.removal_digests, line_dedup.removal_digests])
def test_digests_take_nulls_and_empty_tables(spark, digest):
    docs = with_clashes(spark, documents())
    assert digest(docs).count() == docs.count()
    assert digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, bound):
    from lodestar.llm import components as C

    monkeypatch.setattr(C, "ONE_TASK", bound)
    rng = random.Random(7)
    linked = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(900, 900), (5, 901), (901, 5)]
    want = components(sorted({x for e in linked for x in e}), linked)
    got = {r.id: r.root for r in C.components(spark.createDataFrame(linked, "u long, v long").repartition(4)).collect()}
    assert got == {i: r for i, r in want.items() if i != r}


def gram_removals(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    out = line_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return {r.doc_id: r.n_removed for r in out.collect()}


@pytest.mark.parametrize(("n", "changed", "least"), [(10, 1, 0.9), (15, 1, 0.95), (20, 1, 0.95), (30, 1, 0.95), (50, 1, 0.95), (20, 3, 0.85)])
def test_lines_with_changed_words_are_recalled(spark, n, changed, least):
    """Against every pair at edit similarity 0.8, without a sketch."""
    rng = random.Random(n + changed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randrange(2, 10)))
    texts = []
    for _ in range(150):
        ws = [word() for _ in range(n)]
        other = list(ws)
        for i in rng.sample(range(n), changed):
            other[i] = word()
        texts += [" ".join(ws), " ".join(other)]
    near = [k for k in range(0, len(texts), 2) if max(map(len, texts[k : k + 2])) - lev(*texts[k : k + 2]) >= 0.8 * max(map(len, texts[k : k + 2]))]
    gone = gram_removals(spark, texts)
    assert len(near) > 80 and sum(gone[k] for k in range(0, len(texts), 2)) == 0
    assert sum(gone[k + 1] for k in near) >= least * len(near)
    assert sum(gone.values()) == sum(gone[k + 1] for k in near)


def test_short_and_unspaced_lines_take_part(spark):
    long = "今天天气很好我们一起去公园散步然后回家吃饭看电视"
    texts = ["Ok", "ok!", "one two three", "One, two three", "今天", "今天", long, long, long.replace("公园", "海边"), "--", "--", "no", "one two there"]
    gone = gram_removals(spark, texts)
    assert gone == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0, 10: 0, 11: 0, 12: 1}


def test_stage_links_from_four_fifths_and_query_from_85(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(204)]
    rows = []
    for k, at in enumerate(([], [30, 70, 110, 150], [*range(20, 180, 20)])):
        own = list(words)
        for i in at:
            own[i] = f"v{k}x{i}"
        rows.append((k, " ".join(own), "en", "s", 1))
    a, b, c = (shingles(r[1]) for r in rows)
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b) and 100 * len(a & c) < 80 * len(a | c) and 100 * len(b & c) < 80 * len(b | c)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2}
    assert {r.doc_id for r in minhash_dedup.near_duplicates(docs).collect() if r.kept} == {0, 1, 2}


@pytest.mark.parametrize(("pairs", "least"), [(2048, 8), (64, 1)])
def test_batches_of_pairs_agree_with_edit_distance(monkeypatch, pairs, least):
    """At lengths around the words of a batch, mixed alphabets, and edits around those allowed."""
    from lodestar.llm import edit_batches

    monkeypatch.setattr(edit_batches, "PAIRS", pairs)
    monkeypatch.setattr(edit_batches, "LEAST", least)
    rng = random.Random(pairs)
    a, b = [], []
    for _ in range(600):
        s = [rng.choice("abcdefgh é日") for _ in range(rng.choice([5, 20, 63, 64, 65, 100, 128, 129, 200, 300]))]
        o = list(s)
        for _ in range(int(len(s) * rng.choice([0, 0.1, 0.18, 0.2, 0.22, 0.25, 0.4]))):
            i = rng.randrange(len(o))
            o[i : i + rng.choice([0, 1, 1])] = rng.choice([[], ["x"], ["a"]]) if len(o) > 2 else ["x"]
        a.append("".join(s))
        b.append("".join(o))
    want = [lev(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    got = line_dedup._agree([x.encode() for x in a], [x.encode() for x in b])
    assert got.tolist() == want and 100 < sum(want) < 500


def test_equal_lines_are_joined_in_arrays():
    """Of every task's equal lines one comes on, so a common line gives no long group; the first place and all occurrences count."""
    texts = [f"the one common line\nown line {k % 7} of document number {k}" for k in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([5] * 300, pa.int64()), pa.array(texts)], names=["doc", "tie", "text"])
    lines = pa.Table.from_batches(line_dedup._lines(iter([rows]))).to_batches(max_chunksize=97)
    dealt = [x for part in (lines[3:], lines[:3]) for x in line_dedup._dealt_lines(4, iter(part))]
    assert sum(len(v) // 8 for x in dealt for v in x.column(1).to_pylist()) == 302
    kinds = pa.Table.from_batches(line_dedup._kinds(iter(dealt))).to_pylist()
    known = {(r["node"], r["twin"]): r for x in lines for r in x.to_pylist()[::-1]}
    assert len(kinds) == 301 and sorted(x["times"] for x in kinds) == [1] * 300 + [300]
    common = next(x for x in kinds if x["times"] == 300)
    assert common["first"] == {"doc": 0, "line": 0, "tie": 5}
    assert all(x[c] == known[x["node"], x["twin"]][c] for x in kinds for c in line_dedup._KEYS)


def test_lines_move_in_cells():
    """One row of Spark stands for many lines, and gives them all back."""
    from lodestar.llm import scratch

    rows = pa.RecordBatch.from_arrays([pa.array(range(2500), pa.int64()), pa.array([None if k % 3 else f"line {k}".encode() for k in range(2500)], pa.binary())], names=["node", "raw"])
    cells = list(scratch.packed(iter([rows]), ["node"], ["raw", "node"]))
    assert [x["n"].to_pylist() for x in cells] == [[1024], [1024], [452]]
    assert pa.Table.from_batches(scratch.unpacked(x.select(["cell1"]) for x in cells)).equals(pa.Table.from_batches([rows.select(["raw", "node"])]))


def test_rows_of_small_buckets_come_as_pairs():
    """All pairs of two or three rows; rows of larger buckets, and of keys met within a task, stay."""
    key, node = np.array([1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 5], np.uint64), np.array([7, 8, 1, 2, 3, 1, 2, 3, 4, 9, 6], np.int64)
    alone = np.packbits(np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1], bool)).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), *(pa.array(x, pa.binary()) for x in ([key.tobytes(), key[9:10].tobytes()], [node.tobytes(), np.array([5], np.int64).tobytes()], [alone, b""]))], names=["bucket", "keys", "nodes", "alone"])
    out = pa.Table.from_batches(line_dedup._met(iter([batch]))).to_pylist()
    assert sorted((x["node"], x["other"]) for x in out if x["other"] is not None) == [(2, 1), (3, 1), (3, 2), (8, 7)]
    assert sorted((x["key"], x["node"]) for x in out if x["other"] is None) == [(3, 1), (3, 2), (3, 3), (3, 4), (4, 5), (4, 9)]


def test_filter_holds_all_nodes_and_few_others():
    rng = np.random.default_rng(5)
    nodes, others = rng.integers(-(2**63), 2**63, (2, 40_000))
    size = 1 << 19
    rows = pa.RecordBatch.from_arrays([pa.array(nodes[:30_000]), pa.array(np.append(nodes[30_000:], nodes[:20_000]), mask=np.arange(30_000) >= 10_000)], names=["node", "other"])
    slices = {r["slice"]: r["slots"] for r in pa.Table.from_batches(line_dedup._sliced(size, line_dedup._slotted(size, iter([rows])))).to_pylist()}
    bits = np.frombuffer(b"".join(slices[k] for k in range(line_dedup.SLICES)), np.uint8)
    assert len(bits) * 8 == size and line_dedup._maybe(bits, nodes).all() and line_dedup._maybe(bits, others).mean() < 0.05


def test_pairs_that_span_a_dense_block_stay_in_its_tree(spark, monkeypatch):
    """Also where a sparse block has them too, so that all likely pairs of the dense block are compared."""
    monkeypatch.setattr(buckets, "BLOCK", 8)
    monkeypatch.setattr(buckets, "FIRST", 1)
    rows, content, key = [], [], 0
    for g in range(8):
        core, fill = [100 * g + k for k in range(8)], [100 * g + 50 + k for k in range(9)]
        groups = [core, *([core[0], *fill[k : k + 3]] for k in (0, 3, 6)), *(list(x) for x in combinations(core, 4) if not {core[3], core[6]} <= set(x))]
        for group in groups:
            key += 1
            rows += [(key, x, 10, 0) for x in group]
        content += [(x, f"{g} {'both' if x in (core[3], core[6]) else x}".encode()) for x in core + fill]
    likely = lambda a, b, c, d: np.ones(np.broadcast(a, c).shape, bool)
    table = spark.createDataFrame(content, "node long, content binary")
    roots = buckets.link_shared(spark.createDataFrame(rows, buckets.ROWS), likely, lambda named: table.join(named, "node", "left_semi"), lambda a, b: a == b, few=2)
    assert sorted((r.id, r.root) for r in roots.collect()) == [(100 * g + 6, 100 * g + 3) for g in range(8)]


def test_workers_give_back_memory_after_a_task(monkeypatch):
    from lodestar.llm import textcore

    given = []
    monkeypatch.setattr(textcore, "give_back", lambda: given.append(1))
    assert list(textcore.returning(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and given == [1]
