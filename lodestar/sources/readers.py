"""Document sources: every reader returns ``name, body`` and stays distributed over files or splits."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCS = "name string, body string"


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Each file is a document named by its path; gzip and bzip2 files are inflated by their suffix."""
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("body"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line is a document named by the line itself."""
    return spark.read.text(path).select(F.col("value").alias("name"), F.col("value").alias("body"))


def read_tsv(spark: SparkSession, path: str, scrub: bool = True) -> DataFrame:
    """``name <tab> text`` lines; with ``scrub``, characters outside ASCII become spaces."""
    from lodestar.functions.text import scrub_non_ascii

    parts = F.split("value", "\t", 2)
    body = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return spark.read.text(path).select(parts[0].alias("name"), (scrub_non_ascii(body) if scrub else body).alias("body"))


def trec_documents(source: DataFrame, column: str = "value", doc: str = "DOC", docno: str = "DOCNO") -> DataFrame:
    """Documents of pieces that end at the closing document tag; pieces without a name are dropped."""
    body = F.regexp_extract(column, f"(?s)<{doc}>(.*)", 1)
    name = F.trim(F.regexp_extract(column, f"(?s)<{docno}>(.*?)</{docno}>", 1))
    return source.select(name.alias("name"), body.alias("body")).filter("name <> ''")


def read_trec(spark: SparkSession, path: str, doc: str = "DOC", docno: str = "DOCNO", recursive: bool = False) -> DataFrame:
    """Files of ``<DOC> ... <DOCNO>``; the closing tag is the record separator, so large files are split."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", f"</{doc}>").text(path)
    return trec_documents(lines, doc=doc, docno=docno)


def _inflated(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(data)
    return data


def archive_members(data: bytes, path: str) -> Iterator[tuple[str, bytes]]:
    """(member name, bytes) of a tar (plain, gzip, bzip2, xz) or zip archive."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for member in t:
                if member.isfile():
                    yield member.name, t.extractfile(member).read()


def warc_records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(target address, content) of the response records of a web archive, each gzip member or plain."""
    stream = io.BytesIO(_inflated(data))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline().strip()) != b"":
            key, _, value = line.partition(b":")
            headers[key.strip().lower()] = value.strip()
        content = stream.read(int(headers.get(b"content-length", b"0")))
        if headers.get(b"warc-type", b"response") in (b"response", b"resource", b"conversion"):
            yield headers.get(b"warc-target-uri", headers.get(b"warc-record-id", b"")).decode(errors="replace"), content


def _each(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, bodies = [], []
                for name, body in parts(data, path):
                    names.append(name)
                    bodies.append(body.decode("utf-8", errors="replace"))
                    if len(names) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["name", "body"])
                        names, bodies = [], []
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["name", "body"])

    return run


def _binary(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Members of tar and zip archives; an archive is read by one task, its members a few at a time."""
    return _binary(spark, path, recursive).mapInArrow(_each(archive_members), _DOCS)


def read_warc(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return _binary(spark, path, recursive).mapInArrow(_each(lambda data, _: warc_records(data)), _DOCS)


def read_jdbc(spark: SparkSession, url: str, query: str, name: str, body: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Rows of a database query; with (column, low, high, parts) it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, low, high, n = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    else:
        reader = reader.option("query", query)
    return reader.load().select(F.col(name).cast("string").alias("name"), F.col(body).cast("string").alias("body"))


def from_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Documents handed over by a program."""
    return spark.createDataFrame(pairs, _DOCS)


def merged(*sources: DataFrame) -> DataFrame:
    """Several sources as one."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
