"""Written tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a cell of :func:`packed`; a hundred cells, which Spark writes at least at once, stay small.
CELL_ROWS = 1024
#: Bytes after which a table of cells begins a row group, of which a task reads one at once.
CELLS_AT_ONCE = 8 << 20


def packed(batches: Iterator[pa.RecordBatch], *parts: list[str]) -> Iterator[pa.RecordBatch]:
    """``n`` and, for each list of columns, a cell that holds them as bytes, so that Spark moves one row for many; :func:`unpacked` gives them back."""
    for batch in batches:
        for at in range(0, batch.num_rows, CELL_ROWS):
            some = batch.slice(at, CELL_ROWS)
            cells = []
            for names in parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (columns := some.select(names)).schema) as out:
                    out.write_batch(columns)
                cells.append(pa.array([sink.getvalue().to_pybytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([some.num_rows], pa.int32()), *cells], names=["n", *(f"cell{k}" for k in range(len(parts)))])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the cells in the first column."""
    for batch in batches:
        for cell in batch.column(0):
            with pa.ipc.open_stream(cell.as_buffer()) as rows:
                yield from rows


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one is set only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd", cells: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back; ``cells`` says that it holds some.

    A lost executor loses nothing: later stages read committed files.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if cells:
        writer = writer.option("parquet.block.size", CELLS_AT_ONCE).option("parquet.enable.dictionary", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`table` has written, when nothing is to be read from it again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def restored(docs: DataFrame, rows: DataFrame, items: DataFrame, strip) -> DataFrame:
    """The columns of ``docs`` with the texts that ``strip`` leaves; ``n_chars`` follows a text that is changed.

    ``rows`` has doc, tie, text and row (the other columns), ``items`` what to take from the text by doc and tie.
    ``strip`` maps batches of row, text and items to row, text and whether there were items. A null text stays null
    where nothing is taken from it.
    """
    joined = rows.join(items.hint("merge"), ["doc", "tie"], "left").select("row", "text", "items")
    out = joined.mapInArrow(strip, f"row {rows.schema['row'].dataType.simpleString()}, text string, hit boolean")
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which on a quiet driver may be long after a table
    that ends a plan was written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
