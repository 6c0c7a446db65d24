"""Token files: ids as flat unsigned integers beside 64-bit offsets of documents, to be mapped into memory.

A folder holds shards of consecutive documents in ascending order of their ids. For each shard there are

* ``tokens-NNNNNN.u16`` or ``.u32``: all ids one after another, little-endian, without a header;
* ``offsets-NNNNNN.i64``: little-endian, where each document begins in the shard, and the shard's length;
* ``ids-NNNNNN.arrow``: the documents' ids, an Arrow file;

and ``manifest`` (Parquet) has a row for each: shard, n_docs, n_tokens, and first_doc and base, the documents and
tokens before it, from prefix sums over the shards' totals. A document's first token is at base + offset.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_at_end, give_back, pick, shared_dir, small_batches, staged, text_steps
from .packing import default_tokenizer, encoder, vocabulary_size

#: The id that ends a document here.
STOP = 2
#: Bytes of text a shard aims at (its ids take less, as a rule), and bytes of ids that a reader hands on at a time.
SHARD_BYTES = 256 << 20
READ_BYTES = 8 << 20
_NAMES = {"tokens": "tokens-{:06d}.{}", "offsets": "offsets-{:06d}.i64", "ids": "ids-{:06d}.arrow"}


def width(vocabulary: int) -> str:
    return "u16" if vocabulary <= 1 << 16 else "u32"


def _dtype(kind: str) -> str:
    return {"u16": "<u2", "u32": "<u4"}[kind]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; files of the machine (or of a mount that all share) are mapped into memory."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(fs, pafs.LocalFileSystem) else fs), path


class _Shard:
    """Writes one shard under names of its own and gives the files their names at the end, so that a task can run again."""

    def __init__(self, folder: str, shard: int, kind: str, id_type: pa.DataType):
        self.fs, self.path = _open(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.final = {k: f"{self.path}/{n.format(shard, kind)}" for k, n in _NAMES.items()}
        self.draft = {k: f"{n}.{uuid.uuid4().hex}" for k, n in self.final.items()}
        self.files = {k: self.fs.open_output_stream(n) for k, n in self.draft.items()}
        self.schema = pa.schema([("doc_id", id_type)])
        self.ids = pa.ipc.new_file(self.files["ids"], self.schema)
        self.kind, self.shard, self.n_docs, self.n_tokens = _dtype(kind), shard, 0, 0
        self.files["offsets"].write(np.array([0], "<i8").tobytes())

    def add(self, doc_ids: pa.Array, pieces: list[np.ndarray]) -> None:
        """Documents, each of two pieces: its own ids and the one that ends it."""
        self.files["tokens"].write(np.concatenate(pieces).astype(self.kind).tobytes())
        ends = self.n_tokens + np.cumsum([len(x) for x in pieces], dtype=np.int64)[1::2]
        self.files["offsets"].write(ends.astype("<i8").tobytes())
        self.ids.write_batch(pa.RecordBatch.from_arrays([doc_ids], schema=self.schema))
        self.n_docs, self.n_tokens = self.n_docs + len(ends), int(ends[-1])

    def close(self) -> None:
        self.ids.close()
        for k, f in self.files.items():
            f.close()
            self.fs.move(self.draft[k], self.final[k])

    def drop(self) -> None:
        for k, f in self.files.items():
            f.close()
            self.fs.delete_file(self.draft[k])


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, stop: int = STOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the documents' ids, each document ended by ``stop``; returns the manifest.

    ``folder`` is one that all machines share. Null and empty texts are documents of one id. Documents ascend by id, null
    first; those of equal ids by a hash of their texts. Equal rows are documents of their own. A document never
    spans shards, so a long one makes a long shard; it's written as it comes. No rows: no shards.
    """
    path = tokenizer or default_tokenizer()
    kind = width(max(vocabulary_size(path), stop + 1))
    flat = pick(docs, doc_id=id_col, text=text_col)
    size = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    # Rows of one id and text are told apart by their place, so that no group of them has to be one shard. Texts travel, as
    # their ids take as much room; a shard's task encodes and writes them as they come.
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    keyed = flat.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    id_type = _arrow_type(docs, id_col)
    small_batches(docs.sparkSession)

    def run(batches):
        shard, encode, end = None, encoder(path), np.array([stop], np.uint32)
        try:
            for batch in batches:
                for part, texts in text_steps(batch):
                    shard = shard or _Shard(folder, TaskContext.get().partitionId(), kind, id_type)
                    shard.add(part.column("doc_id").cast(id_type), [x for t in texts for x in (encode(t.decode("utf-8", "replace")), end)])
        except BaseException:
            if shard:
                shard.drop()
            raise
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard.shard, shard.n_docs, shard.n_tokens)], names=["shard", "n_docs", "n_tokens"])

    shards = staged(dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias
    shards = shards.select("shard", "n_docs", "n_tokens", total("n_docs")("first_doc"), total("n_tokens")("base"), F.lit(kind).alias("kind"))
    shards.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class TokenShard:
    """One shard mapped into memory: ``shard[i]`` has the ids of its i-th document, ``offsets`` and ``doc_ids`` the rest.

    On a file system that can't be mapped, ids are fetched as they are asked for.
    """

    def __init__(self, folder: str, shard: int, kind: str):
        self.fs, path = _open(folder)
        at = {k: f"{path}/{n.format(shard, kind)}" for k, n in _NAMES.items()}
        self.dtype = np.dtype(_dtype(kind))
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.offsets = np.memmap(at["offsets"], "<i8", "r") if local else np.frombuffer(self.fs.open_input_file(at["offsets"]).read(), "<i8")
        self.doc_ids = pa.ipc.open_file(self.fs.open_input_file(at["ids"])).read_all().column("doc_id")
        self.tokens = np.memmap(at["tokens"], self.dtype, "r") if local else None
        self.file = None if local else self.fs.open_input_file(at["tokens"])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slice(self, start: int, end: int) -> np.ndarray:
        if self.tokens is not None:
            return self.tokens[start:end]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * size, start * size), self.dtype)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.slice(int(self.offsets[i]), int(self.offsets[i + 1]))


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of each document, read from the files."""
    shards = spark.read.parquet(f"{folder}/manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for shard, base, kind in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "kind")), strict=True):
                s = TokenShard(folder, shard, kind)
                i = 0
                while i < len(s):
                    j = max(i + 1, int(np.searchsorted(s.offsets, s.offsets[i] + READ_BYTES // s.dtype.itemsize, "right")) - 1)
                    at = np.array(s.offsets[i : j + 1], np.int64)
                    ids = s.slice(int(at[0]), int(at[-1])).astype("<u4")
                    texts = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([s.doc_ids.slice(i, j - i).combine_chunks(), pa.array(base + at[:-1]), pa.array(np.diff(at)), texts], names=["doc_id", "start", "n_tokens", "ids"])
                    i = j
                give_back()

    return shards.repartitionByRange(n, "shard").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from files written to the shared folder."""
    spark = docs.sparkSession
    folder = delete_at_end(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    write_tokens(docs, folder)
    back = read_tokens(spark, folder, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
