"""A Merkle manifest of a dataset: block traversals from the leaves to one root, with a proof for each document.

Leaves of a source are numbered in order and cut into aligned blocks of FAN ** BLOCK_LEVELS. A block is one small
group: its tree is walked in postorder, each call returns its subtree's digest, and on the way back the siblings of
every node are appended to the leaves below it. The roots of the blocks are the leaves of the next traversal, until
a source has one node; the sources' roots go the same way to the root of all. A document's proof is what its
block, the blocks above and the tree of sources appended, in this order.

Digests are SHA-256 in lowercase hex, and a parent is the digest of its children's hex text. A level of a proof has
the digests to the left of the node (``before``) and to its right (``after``), joined; both are empty where a run
has one node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, staged
from .ranks import numbered

#: Children of a node, and levels that one traversal climbs (729 leaves a block).
FAN = 3
BLOCK_LEVELS = 6
#: Rows of blocks' paths up to which they are broadcast (2 KB each); beyond it the join shuffles on (source, block).
BROADCAST_BLOCKS = 10_000
_PROOF = "array<struct<before: string, after: string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(leaves: list[str], levels: int, fan: int = FAN) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root ``levels`` above the leaves, and each leaf's siblings (before, after) level by level."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(level: int, start: int) -> str:
        if level == 0:
            return leaves[start]
        width = fan ** (level - 1)
        starts = range(start, min(start + fan * width, len(leaves)), width)
        kids = [visit(level - 1, s) for s in starts]
        for k, s in enumerate(starts):
            beside = ("".join(kids[:k]), "".join(kids[k + 1 :]))
            for i in range(s, min(s + width, len(leaves))):
                proofs[i].append(beside)
        return digest("".join(kids))

    return visit(levels, 0), proofs


def levels_over(n: int, fan: int = FAN) -> int:
    """Levels until ``n`` nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def traverse(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One traversal of nodes (grp, idx, digest): the nodes with block and proof, and (grp, idx, digest) of the blocks.

    ``grp`` is any type, null too; idx counts from 0 without gaps in each grp. A grp of one node stays as it is.
    """
    kind = nodes.schema["grp"].dataType.simpleString()
    most = FAN**BLOCK_LEVELS

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        leaves = table.column("digest").to_pylist()
        # A block that isn't full is the only one of its group or the last: only the first case ends below the block's top.
        levels = levels_over(len(leaves)) if table.column("block")[0].as_py() == 0 else BLOCK_LEVELS
        root, proofs = climb(leaves, levels)
        steps = [[{"before": b, "after": a} for b, a in p] for p in proofs]
        roots = [root, *[None] * (len(leaves) - 1)]
        out = [table.column(c) for c in ("grp", "idx", "digest", "block")]
        return pa.Table.from_arrays([*out, pa.array(steps, _STEPS), pa.array(roots, pa.string())], names=["grp", "idx", "digest", "block", "proof", "root"])

    blocks = nodes.select("grp", "idx", "digest", F.floor(F.col("idx") / most).cast("long").alias("block"))
    out = blocks.groupBy("grp", "block").applyInArrow(walk, f"grp {kind}, idx long, digest string, block long, proof {_PROOF}, root string")
    out = staged(out, "merkle-walk")
    return out.drop("root"), out.filter("root is not null").select("grp", F.col("block").alias("idx"), F.col("root").alias("digest"))


def grow(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, idx, proof) of all nodes and (grp, digest) of the roots, by traversals until each group is one node."""
    walked = []
    while True:
        below, nodes = traverse(nodes)
        walked.append(below)
        if nodes.filter("idx > 0").isEmpty():
            break
    path = walked[-1].select("grp", "idx", "proof")
    for below in reversed(walked[:-1]):
        up = staged(path.select(F.col("grp").alias("of"), F.col("idx").alias("at"), F.col("proof").alias("rest")), "merkle-paths")
        few = up.count() <= BROADCAST_BLOCKS
        same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
        path = below.join(F.broadcast(up) if few else up, same).select("grp", "idx", F.concat("proof", "rest").alias("proof"))
    return path, nodes.select("grp", "digest")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, more: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof, and the columns of ``more``.

    ``more`` names columns of the input's (they may use ``id_col`` and ``fields``). Leaves of a source ascend by id, null first,
    then by leaf; rows equal in all are equal leaves, each with its own proof. A null source is a source and comes first;
    sources sort by their bytes. Null and empty values have different leaves. A long text is only hashed. Any source may
    hold most rows: it is dealt out by ranges and walked in blocks. No rows: no rows. Other columns don't matter.
    """
    flat = pick(docs, **{f"f{i}": c for i, c in enumerate((id_col, source_col, *fields))})
    base = flat.select(F.col("f0").alias("doc_id"), F.col("f1").alias("grp"), *[F.col(f"f{i + 2}").alias(f"v{i}") for i in range(len(fields))])
    extra = {} if more is None else more
    by_name = base.withColumns({f"_{c}": F.col(f"v{i}") for i, c in enumerate(fields)})
    rows = by_name.select("doc_id", "grp", leaf(*[F.col(f"v{i}") for i in range(len(fields))]).alias("digest"), *[v.alias(k) for k, v in extra.items()], F.monotonically_increasing_id().alias("place"))
    rows = numbered(staged(rows, "merkle-leaves"), ["grp"], ["doc_id", "digest", "place"], "idx", "merkle-order")
    rows = staged(rows, "merkle-numbered")
    path, subroots = grow(rows.select("grp", "idx", "digest"))
    one = subroots.select(F.lit(0).alias("one"), "grp", F.col("digest").alias("subroot"))
    ranked = staged(numbered(one, ["one"], ["grp"], "rank", "merkle-sources"), "merkle-ranked")
    top, root = grow(ranked.select(F.col("one").alias("grp"), F.col("rank").alias("idx"), F.col("subroot").alias("digest")))
    # One row a source: its subroot, its path in the tree of sources, and the root of all, which is one row.
    above = top.select(F.col("idx").alias("rank"), F.col("proof").alias("above"))
    sources = ranked.join(above, "rank").join(F.broadcast(root.select(F.col("grp").alias("one"), F.col("digest").alias("root"))), "one")
    sources = staged(sources.select(F.col("grp").alias("of"), "subroot", "above", "root"), "merkle-tops")
    few = sources.count() <= BROADCAST_BLOCKS
    place = path.select(F.col("grp").alias("p_grp"), F.col("idx").alias("p_idx"), "proof")
    full = rows.join(place, F.col("grp").eqNullSafe(F.col("p_grp")) & (F.col("idx") == F.col("p_idx")))
    full = full.join(F.broadcast(sources) if few else sources, F.col("grp").eqNullSafe(F.col("of")))
    return full.select("doc_id", F.col("grp").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", F.concat("proof", "above").alias("proof"), *extra)


def tampered_leaf() -> Column:
    """The leaf of the document without line feeds in its text, for every second id by CRC-32; null for the others."""
    chosen = F.coalesce(F.crc32(F.col("_doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    less = F.replace(F.col("_text"), F.lit("\n"), F.lit(""))
    return F.when(chosen, leaf(F.col("_doc_id"), F.col("_source"), F.col("_lang"), F.col("_n_chars"), less))


def verify_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs held against tampered documents."""
    m = merkle_manifest(docs, more={"changed": tampered_leaf()})
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
