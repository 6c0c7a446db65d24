"""Packing by concatenate and cut.

The first pass tokenises each document once and writes its ids, with its place in its input partition. Partition
totals, summed in order, place the partitions one after another; a document's first token then has a global
offset, and the second pass cuts documents where windows of ``length`` tokens end. A document over a boundary
gives a record on either side. Only the last sequence is shorter, so only it needs padding.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, staged, text_steps

#: Fixed values of the public tokenizer: its pattern, its special token and the id that ends a document here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
#: White space as the pattern's ``\s`` has it; runs so long are encoded apart where the pattern can't take them.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 1000
STOP = 0
LENGTH = 1024
#: Input partitions up to which their totals are broadcast (16 bytes each).
BROADCAST_PARTS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    """Ids that a tokenizer can give."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoder(path: str):
    """Text -> uint32 ids. The rank file beside a .json tokenizer holds the same vocabulary and gives the same ids faster.

    Its engine keeps a place for each character of a run of white space and gives up on runs of about a million.
    Such a text is cut as the pattern would cut it: a run, but for its last character if words follow, is one piece.
    """
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    special, runs = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")"), re.compile(f"{SPACES}{{{LONG_RUN},}}")

    def whole(text: str) -> np.ndarray:
        return own.encode_to_numpy(text, allowed_special="all")

    def cut(text: str) -> np.ndarray:
        out = []
        for part in special.split(text):
            at = 0
            for m in () if part in SPECIAL else runs.finditer(part):
                end = m.end() - (m.end() < len(part))
                out += [whole(part[at : m.start()]), np.array(own._encode_single_piece(part[m.start() : end]), np.uint32)]
                at = end
            out.append(whole(part[at:]))
        return np.concatenate(out)

    def encode(text: str) -> np.ndarray:
        try:
            return whole(text)
        except ValueError:
            return cut(text)

    return encode


def tokenise(docs: DataFrame, path: str, stop: int = STOP) -> DataFrame:
    """doc_id, part, part_start, doc_tokens, ids (little-endian uint32) of rows (doc_id, text)."""

    small_batches(docs.sparkSession)

    def run(batches):
        encode, part, start = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([stop], "<u4").tobytes()
        for batch in batches:
            for piece, texts in text_steps(batch):
                ids = [encode(t.decode("utf-8", "replace")).astype("<u4").tobytes() + end for t in texts]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, part long, part_start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, tokenizer: str | None = None, stop: int = STOP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of one token, the stop. Rows are packed as they come, repeated ids and rows
    too. A document of any length is cut into as many pieces as it spans windows. No rows: no rows.
    """
    ids = staged(tokenise(pick(docs, doc_id=id_col, text=text_col), tokenizer or default_tokenizer(), stop), "token-ids")
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = staged(totals.select(F.col("part").alias("of"), before.alias("base")), "token-totals")
    few = totals.count() <= BROADCAST_PARTS
    placed = ids.join(F.broadcast(totals) if few else totals, F.col("part") == F.col("of"))
    placed = placed.select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("part_start")).alias("g"))
    first, last = F.floor(F.col("g") / length), F.floor((F.col("g") + F.col("doc_tokens") - 1) / length)
    window = F.sequence(first, last)

    def piece(k):
        start = F.greatest(k * length - F.col("g"), F.lit(0))
        end = F.least((k + 1) * length - F.col("g"), F.col("doc_tokens"))
        return F.struct(
            start.alias("start"),
            (end - start).alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")).alias("ids"),
            F.col("doc_tokens").alias("doc_tokens"),
            k.alias("sequence_id"),
            (F.col("g") + start - k * length).alias("offset"),
        )

    return placed.select("doc_id", F.inline(F.transform(window, piece)))


def pack_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    p = pack(docs, tokenizer=tokenizer)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
