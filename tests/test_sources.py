"""Readers, filters, parsers, sinks and streams on small files."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.operators import present, rankers, search as se
from lodestar.operators.index import build_index
from lodestar.plans import nexi, topics
from lodestar.sources import assessments, filters, readers
from lodestar.streaming import ingest

TREC = "<DOC>\n<DOCNO> d1 </DOCNO>\n<TITLE>One</TITLE>first text</DOC>\n<DOC><DOCNO>d2</DOCNO>second\ntext</DOC>\n"


def pairs(df):
    return sorted((r.name, r.body) for r in df.collect())


def test_files_lines_and_tables(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("alpha\nbeta")
    with gzip.open(tmp_path / "in" / "sub" / "b.txt.gz", "wt") as f:
        f.write("gamma")
    with bz2.open(tmp_path / "in" / "sub" / "c.txt.bz2", "wt") as f:
        f.write("delta")
    assert [b for _, b in pairs(readers.read_files(spark, f"{tmp_path}/in", recursive=True))] == ["alpha\nbeta", "gamma", "delta"]
    assert pairs(readers.read_lines(spark, f"{tmp_path}/in/a.txt")) == [("alpha", "alpha"), ("beta", "beta")]
    (tmp_path / "x.tsv").write_text("id1\tcafé x\ty\nid2\n", encoding="utf-8")
    assert pairs(readers.read_tsv(spark, f"{tmp_path}/x.tsv")) == [("id1", "caf  x\ty"), ("id2", "")]
    assert pairs(readers.from_pairs(spark, [("n", "b")])) == [("n", "b")]


def test_tagged_documents(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.trec").write_text(TREC)
    got = pairs(readers.read_trec(spark, f"{tmp_path}/t"))
    assert [n for n, _ in got] == ["d1", "d2"] and "first text" in got[0][1] and "second\ntext" in got[1][1]
    assert pairs(readers.merged(readers.read_trec(spark, f"{tmp_path}/t"), readers.read_trec(spark, f"{tmp_path}/t")))[1][0] == "d1"


def test_archives_and_web_archives(spark, tmp_path):
    data = {"m/a.txt": b"alpha", "m/b.txt": b"beta \xff"}
    for mode, name in (("w", "x.tar"), ("w:gz", "x.tgz"), ("w:bz2", "x.tbz2")):
        (tmp_path / "arc").mkdir(exist_ok=True)
        with tarfile.open(tmp_path / "arc" / name, mode) as t:
            for n, b in data.items():
                info = tarfile.TarInfo(n)
                info.size = len(b)
                t.addfile(info, io.BytesIO(b))
    with zipfile.ZipFile(tmp_path / "arc" / "x.zip", "w") as z:
        for n, b in data.items():
            z.writestr(n, b)
    got = pairs(readers.read_archives(spark, f"{tmp_path}/arc"))
    assert got == sorted([("m/a.txt", "alpha"), ("m/b.txt", "beta �")] * 4)
    record = lambda uri, body, kind=b"response": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: " + uri + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(gzip.compress(record(b"http://a/", b"hello")) + gzip.compress(record(b"http://b/", b"skip", b"request")) + gzip.compress(record(b"http://c/", b"bye")))
    assert pairs(readers.read_warc(spark, f"{tmp_path}/w")) == [("http://a/", "hello"), ("http://c/", "bye")]


def test_filters(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Content-Type: text/html\n\nx"), ("b", "Content-Type: image/png\n\nx"), ("c", "no header")], "name string, body string")
    ids = spark.createDataFrame([("a",), ("z",)], "name string")
    assert [r.name for r in filters.exclude(docs, ids, "name").orderBy("name").collect()] == ["b", "c"] and [r.name for r in filters.include(docs, ids, "name").collect()] == ["a"]
    assert [r.name for r in filters.textual(docs).orderBy("name").collect()] == ["a", "c"]
    (tmp_path / "spam").write_text("80 a\n10 b\n")
    spam = filters.read_spam(spark, f"{tmp_path}/spam")
    assert [r.name for r in filters.without_spam(docs, spam, "name", 70).collect()] == ["a"]
    assert [r.name for r in filters.without_spam(docs, spam, "name", 30).orderBy("name").collect()] == ["a", "c"]


def test_assessments(spark, tmp_path):
    (tmp_path / "p").write_text("1 d1\n")
    (tmp_path / "t").write_text("1 0 d1 2\n1 1 d2 0\n")
    (tmp_path / "i").write_text("1 Q0 d1 120 400 10 10:120\n1 Q0 d2 0 90\n")
    assert tuple(assessments.read_pairs(spark, f"{tmp_path}/p").first())[:4] == (1, "0", "d1", 1)
    assert [tuple(r)[:4] for r in assessments.read_trec(spark, f"{tmp_path}/t").orderBy("docid").collect()] == [(1, "0", "d1", 2), (1, "1", "d2", 0)]
    assert [tuple(r) for r in assessments.read_inex(spark, f"{tmp_path}/i").orderBy("docid").collect()] == [(1, "0", "d1", 1, 120, 400), (1, "0", "d2", 0, 0, 90)]


def test_content_queries():
    words = lambda q: [(t.text, t.sign, t.phrase) for t in nexi.parse(q)]
    assert words('Cats +dogs -mice "Big Red" well-known TITLE') == [("cats", "", False), ("dogs", "+", False), ("mice", "-", False), ("big red", "", True), ("well-known", "", False), ("TITLE", "", False)]
    terms = nexi.parse("//article[about(.//p, red cats) and .//year > 2000]//sec[about(., dogs)]")
    assert [(t.text, t.path) for t in terms] == [("red", "//article//p"), ("cats", "//article//p"), ("dogs", "//article//sec")]
    assert [t.text for t in nexi.expand(nexi.parse("a b"), {"a": ["x"]})] == ["a", "x", "b"]
    for wrong in ('a "open', "//a[about(.//p x)]", "//a[about(., x)", "//a]"):
        with pytest.raises(ValueError):
            nexi.parse(wrong)
    assert nexi.parse("") == []


def test_topics():
    assert topics.batch_line("301 some words here\n") == ("301", "some words here")
    trec = "<top>\n<num> Number: 301\n<title> Big cats\n\n<desc> Description:\nAbout cats.\n<narr> Narrative:\nMore.\n</top>"
    assert topics.trec_topics(trec) == [("301", "Big cats")] and topics.trec_topics(trec, "td") == [("301", "Big cats About cats.")]
    inex = '<inex_topic topic_id="7"><title>red</title><castitle>//a[about(., red)]</castitle><description>d</description></inex_topic>'
    assert topics.inex_topics(inex, "c") == [("7", "//a[about(., red)]")]
    assert topics.stop(["the", "cat", "12", "of"], numbers=True) == ["cat"] and topics.stop(["the", "of"]) == ["the", "of"]
    assert topics.words("The abc123") == ["the", "abc", "123"]


def test_run_files(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"))
    run = se.search(index, {7: ["a"]}, rankers.divergence())
    present.write_run(present.trec_lines(run, "me"), f"{tmp_path}/run")
    line = spark.read.text(f"{tmp_path}/run").first()[0].split()
    assert line[:4] == ["7", "Q0", "1", "1"] and line[5] == "me"
    assert present.inex_lines(run, "me").first().line.startswith('<topic topic-id="7" run-id="me"><result><file>1</file>')
    assert "<hit><rank>1</rank><id>1</id>" in present.hit_elements(run).first().line
    shown = present.focused(present.named(run, spark.createDataFrame([(1, "<p>a</p>")], "docid long, html string"), "html"), ["a"])
    assert present.best_entry_points(shown, "me").first().line.endswith(" me 0")


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string"
    for k, rows in enumerate([[(1, "red cat"), (2, "blue dog")], [(3, "red dog dog")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest.ingest(stream, f"{tmp_path}/index", f"{tmp_path}/cp")
    query.awaitTermination(120)
    grown = ingest.ingested(spark, f"{tmp_path}/index")
    whole = build_index(spark.read.schema(schema).parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, grown.dictionary.collect())) == sorted(map(tuple, whole.dictionary.collect()))
    assert grown.stats.first() == whole.stats.first()
    asked = spark.createDataFrame([(1, "red"), (1, "dog"), (2, "cat")], "topic long, term string")
    static = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert sorted((r.topic, r.docid) for r in ingest.standing_queries(static, asked).collect()) == [(1, 3), (2, 1)]
    live = ingest.standing_queries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), asked).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    live.awaitTermination(120)
    assert sorted((r.topic, r.docid) for r in spark.table("hits").collect()) == [(1, 3), (2, 1)]
    timed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds(F.col("doc_id") * 100))
    counted = ingest.windowed_terms(timed, "at", "text", "150 seconds", "1 minute").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp3").start()
    counted.awaitTermination(120)
    assert spark.table("counts").filter("term = 'dog'").agg({"n": "sum"}).first()[0] == 3
