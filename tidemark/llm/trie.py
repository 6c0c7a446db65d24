"""A trie of conversation prefixes by preorder intervals.

Distinct sequences of turns, sorted lexicographically, are the trie in preorder: a sequence adds the nodes below
what it shares with the one before it, so running totals of added nodes rank all nodes. A node's subtree is the
interval from its rank to the total after the last sequence that begins with it. With the nodes in this order, leaves and
savings of a subtree are differences of prefix sums, taken by ranges of ranks.

A turn is known by 16 bytes of MD5 over role and text, a sequence by these joined, a node by 16 bytes of BLAKE2b
over its sequence. These aren't verified: among 10^12 nodes a collision has a chance of some 10^-15.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, staged
from .mixing import word_count
from .ranks import numbered

#: Conversations that share an opening, and the turns they may share.
EVERY, MOST_SHARED = 20, 4
#: Bytes of a turn in a path.
KEY = 16
#: Ids joined in one task at a time for the digest of a node's ends.
CHUNK = 4096
#: Ranges of the order up to which their totals are broadcast (a few numbers each).
BROADCAST_PARTS = 1_000_000
#: A node with more children than both this and a thousandth of all nodes hands its id to them by broadcast.
MANY_CHILDREN, HEAVY = 4096, 1000
#: Rows that are handed on at a time.
STEP_ROWS = 20_000


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of key, words): each conversation in order of its turns, null first.

    Null roles and texts count as empty. Rows of equal turns sort by role, then by the turn's key; repeated rows
    stay. Texts, however long, are only hashed and counted, so a conversation is a row of some 40 bytes a turn.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = F.struct(F.col("turn"), role.alias("role"), key.alias("key"), word_count(F.col("text")).alias("words"))
    t = rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return t.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("turns"))


def share_openings(convs: DataFrame, every: int = EVERY, most: int = MOST_SHARED) -> DataFrame:
    """Conversations c whose first h turns are those of conversation c - c % ``every``, h = crc32(decimal c) % ``most``.

    A missing or short opening leaves fewer turns. A null id shares nothing and keeps its turns.
    """
    convs = staged(convs, "conversations")
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)).cast("int")
    openings = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most - 1).alias("opening"))
    both = convs.withColumn("h", h).join(openings, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left")
    first = F.when(F.col("of").isNotNull(), F.slice("opening", F.lit(1), F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.when(first.isNotNull(), F.concat(first, own)).otherwise(own).alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """seq, ends_sha256: the digest of the ids of each sequence's conversations, ascending.

    Ids are numbered by ranges and joined chunk by chunk; a digest takes its chunks in order as a stream, so a
    sequence may have any number of conversations. Null ids aren't among them.
    """
    ids = numbered(rows.filter("conv_id is not null").select("seq", "conv_id"), ["seq"], ["conv_id"], "at", "trie-ends")
    chunks = ids.groupBy("seq", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        seq, h = None, None
        for batch in batches:
            out = []
            for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s == seq:
                    h.update(b"," + ids.encode())
                    continue
                if seq is not None:
                    out.append((seq, h.hexdigest()))
                seq, h = s, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["seq", "ends_sha256"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["seq", "ends_sha256"])

    return chunks.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "ids").mapInArrow(run, "seq binary, ends_sha256 string")


def _shared(a: bytes, b: bytes) -> int:
    """Turns with which two paths begin alike."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return (int(differ.argmax()) if differ.any() else n) // KEY


def _in_order(sequences: DataFrame) -> DataFrame:
    """Sequences with part, place in it, and the turns shared with the one before; -1 for the first of a part."""
    small_batches(sequences.sparkSession)
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = sequences.columns

    def run(batches):
        before, at, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            lcp = np.empty(batch.num_rows, np.int64)
            for i, path in enumerate(batch.column("path").to_pylist()):
                lcp[i] = -1 if before is None else _shared(before, path)
                before = path
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(rows, part, np.int64)), pa.array(np.arange(at, at + rows)), pa.array(lcp)], names=[*names, "part", "at", "lcp"])
            at += rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sequences.schema)
    dealt = sequences.repartitionByRange(n, "path").sortWithinPartitions("path")
    return staged(dealt.mapInArrow(run, f"{kinds}, part long, at long, lcp long"), "trie-order")


def _offsets(ordered: DataFrame) -> DataFrame:
    """For each part of the order (one row): the turns its first sequence shares with the last of the part before, and the nodes before it."""
    sums = ordered.groupBy("part").agg(F.max("at").alias("last"), F.sum(F.floor(F.length("path") / KEY) - F.col("lcp")).alias("made"))
    ends = ordered.join(F.broadcast(staged(sums, "trie-parts")), "part").filter("at = 0 or at = last")
    ends = ends.groupBy("part").agg(F.max(F.when(F.col("at") == 0, F.col("path"))).alias("first"), F.max(F.when(F.col("at") == F.col("last"), F.col("path"))).alias("end"), F.max("made").alias("made"))
    order = Window.orderBy("part")  # one row a part
    ends = ends.withColumn("prior", F.lag("end").over(order))
    shorter = F.floor(F.least(F.length("first"), F.length("prior")) / KEY).cast("int")
    differ = F.filter(F.sequence(F.lit(0), shorter), lambda i: F.substring(F.col("first"), i * KEY + 1, F.lit(KEY)) != F.substring(F.col("prior"), i * KEY + 1, F.lit(KEY)))
    shared = F.coalesce(F.array_min(differ), shorter)
    ends = ends.withColumn("head", F.when(F.col("prior").isNull(), -1).otherwise(shared).cast("long"))
    ends = ends.withColumn("made", F.col("made") - (F.col("head") + 1))
    before = F.coalesce(F.sum("made").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return staged(ends.select(F.col("part").alias("of"), "head", before.cast("long").alias("base")), "trie-offsets")


def _visits(ordered: DataFrame) -> DataFrame:
    """A row for each sequence and node on its path: node, parent, depth, words, the node's rank where this sequence adds it,
    and the nodes up to this sequence; the last node of a path has the digest of its ends."""
    names = ["node", "parent", "depth", "words", "rank", "upto", "n", "conv_id", "ends_sha256"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        part, total = None, 0
        out: list[tuple] = []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path, words, n, conv, ends, p, at, lcp, head, base in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "conv_id", "ends_sha256", "part", "at", "lcp", "head", "base")), strict=True):
                if p != part:
                    part, total = p, base
                shared, length = head if at == 0 else lcp, len(path) // KEY
                first, total = total, total + length - shared
                h = hashlib.blake2b(digest_size=16)
                node, parent = h.digest(), None
                for d in range(length + 1):
                    if d:
                        h.update(path[(d - 1) * KEY : d * KEY])
                        parent, node = node, h.copy().digest()
                    out.append((node, parent, d, words[d - 1] if d else 0, first + d - shared - 1 if d > shared else None, total, n, conv, ends if d == length else None))
                if len(out) >= STEP_ROWS:
                    yield done()
                    out = []
        if out:
            yield done()

    offsets = _offsets(ordered)
    few = offsets.count() <= BROADCAST_PARTS
    rows = ordered.join(F.broadcast(offsets) if few else offsets, F.col("part") == F.col("of")).drop("of")
    rows = rows.repartition("part").sortWithinPartitions("part", "at")
    return rows.mapInArrow(run, "node binary, parent binary, depth long, words long, rank long, upto long, n long, conv_id long, ends_sha256 string")


def _with_parents(nodes: DataFrame, count: int) -> DataFrame:
    """Nodes with parent_conv_id and n_children. Parents of very many children, at most HEAVY of them, are broadcast."""
    kids = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "up")
    nodes = staged(nodes.join(kids, F.col("node") == F.col("up"), "left").drop("up").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    many = F.col("siblings") > max(MANY_CHILDREN, count // HEAVY)
    heavy = nodes.join(F.broadcast(parents.filter(many)), F.col("parent") == F.col("up"), "left")
    rest = heavy.filter("up is null").drop("up", "parent_conv_id", "siblings").join(parents.filter(~many), F.col("parent") == F.col("up"), "left")
    return heavy.filter("up is not null").unionByName(rest).drop("up", "siblings")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the conversations (conv_id long, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, rank, end (subtree: ranks from rank to before end).

    Conversations of no turns are members of the root and end there; without conversations there are no nodes.
    Equal conversations are one sequence, however many. A null id counts as a member, and its digest leaves it out.
    A conversation's turns meet in one row (16 bytes a turn and its words), as do the ids of CHUNK conversations.
    """
    path = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")), F.lit(b""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"))
    rows = staged(rows.withColumn("seq", F.unhex(F.md5("path"))), "trie-sequences")
    sequences = rows.groupBy("seq", "path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"))
    sequences = sequences.join(_ends(rows), "seq", "left").drop("seq")
    visits = _visits(_in_order(sequences))
    same = lambda *cs: [F.max(c).alias(c) for c in cs]
    nodes = visits.groupBy("node").agg(*same("parent", "depth", "words", "upto", "rank", "ends_sha256"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")).withColumnRenamed("upto", "end")
    nodes = staged(nodes, "trie-nodes")
    count = nodes.count()
    nodes = staged(_with_parents(nodes, count), "trie-parents")
    # Prefix sums over the ranks, by ranges of equal width.
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = max(1, -(-count // parts))
    gain = nodes.select("rank", F.floor(F.col("rank") / wide).alias("range"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = gain.groupBy("range").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(F.col("range").alias("of"), F.coalesce(F.sum("leaves").over(earlier), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saves").over(earlier), F.lit(0)).alias("saves"))
    inside = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sums = gain.withColumns({"l": F.coalesce(F.sum("leaf").over(inside), F.lit(0)), "s": F.coalesce(F.sum("saved").over(inside), F.lit(0))})
    sums = sums.join(F.broadcast(totals), F.col("range") == F.col("of"))  # as many rows as shuffle partitions
    sums = staged(sums.select("rank", (F.col("l") + F.col("leaves")).alias("leaves"), (F.col("s") + F.col("saves")).alias("saves"), "leaf", "saved"), "trie-sums")
    # The sums before rank ``count`` are those before the last node and its own.
    past = sums.filter(F.col("rank") == count - 1).select((F.col("rank") + 1).alias("rank"), (F.col("leaves") + F.col("leaf")).alias("leaves"), (F.col("saves") + F.col("saved")).alias("saves"))
    bounds = sums.select("rank", "leaves", "saves").unionByName(past)
    at = lambda k: bounds.select(F.col("rank").alias(f"r{k}"), F.col("leaves").alias(f"l{k}"), F.col("saves").alias(f"s{k}"))
    full = nodes.join(at(0), F.col("rank") == F.col("r0")).join(at(1), F.col("end") == F.col("r1"))
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l1") - F.col("l0")).alias("n_leaves"), (F.col("s1") - F.col("s0")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "rank", "end",
    )


def trie_report(turns: DataFrame) -> DataFrame:
    t = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    convs = share_openings(conversations(t)).withColumn("conv_id", F.col("conv_id").cast("long"))
    return prefix_trie(convs).drop("rank", "end")
