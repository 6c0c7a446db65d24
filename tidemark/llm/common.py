"""Shared plumbing of the corpus operators: column picking, staged tables, batched text maps."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time; a longer text is a step of its own.
STEP_BYTES = 2 << 20
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts make batches large otherwise.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in smaller batches, unless the session says how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return this worker's freed memory to the system; idle workers stay alive and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns only, as ``new=old``; other columns may clash with anything, even by case alone."""
    at = {c: i for i, c in enumerate(df.columns)}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{at[old]}").alias(new) for new, old in names.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all of Spark is this process (tests).

    On a cluster without that setting this is an error: other machines couldn't read a folder of the driver's.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        set_to = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(set_to)
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the session's file system closes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet, read it back.

    A lost executor costs only the tasks that ran on it, never what was written. The folder goes when the
    session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def steps(sizes: list[int], most: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to ``most`` at the most (or one item)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_steps(batch: pa.RecordBatch, most: int | None = None, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices, each with the UTF-8 of its texts; a null text counts as empty."""
    texts = batch.column(column)
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    for part in steps(sizes, most or STEP_BYTES):
        n = part.stop - part.start
        yield batch.slice(part.start, n), [x or b"" for x in texts.slice(part.start, n).cast(pa.large_binary()).to_pylist()]
    give_back()


def filter_texts(df: DataFrame, column: str, work: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows of ``df`` for whose texts in ``column`` (bytes, step by step) the function of ``work()`` says so."""
    small_batches(df.sparkSession)
    schema = df.schema

    def run(batches):
        fn = work()
        for batch in batches:
            for part, texts in text_steps(batch, column=column):
                yield part.filter(pa.array(fn(texts), pa.bool_()))

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, work: Callable[[], Callable[[list[bytes]], dict]], schema: str) -> DataFrame:
    """Add columns computed from ``text`` (bytes, step by step) to the other columns of ``df``.

    ``work()`` runs once a task and returns the function from a list of texts to columns.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != "text"]
    kinds = {name: _ARROW[kind] for name, kind in (x.split() for x in schema.split(", "))}
    out = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), schema])

    def run(batches):
        fn = work()
        for batch in batches:
            for part, texts in text_steps(batch):
                got = fn(texts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(got[c], kind) for c, kind in kinds.items()], names=[*rest, *kinds])

    return df.mapInArrow(run, out)
