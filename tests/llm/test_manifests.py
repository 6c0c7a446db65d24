"""Prefix trie, token files and Merkle manifest against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.oracle import DATA, duck_rows, spark_rows
from tidemark.llm import merkle, oracles, packing, ranks, tokens, trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        own.setdefault(conv, []).append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = t if c is None else own.get(c - c % 20, [])[:h] + t[h:]
    members, kids = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
        ends = sorted(c for c in members[p] if c is not None and len(rebuilt[c]) == len(p))
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, ends)))))
    return out


def trie_rows(df):
    got = trie.trie_report(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in got.collect()]


def by_text(rows):
    return sorted(map(repr, rows))


TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed, convs, words="a b c"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 6])):
            rows.append((c, rng.choice([None, t, t]) if t == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(words.split())))
    return rows


def test_trie_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_text(trie_rows(spark.createDataFrame(rows, TURNS))) == by_text(brute_trie(rows))
    for seed in (1, 2):
        rows = some_turns(seed, 300)
        assert by_text(trie_rows(spark.createDataFrame(rows, TURNS))) == by_text(brute_trie(rows))


def test_trie_of_odd_rows(spark):
    rows = some_turns(3, 60) + [(None, 0, "user", "x"), (None, 1, None, None), (7, None, None, ""), (7, None, None, ""), (20, 1, "user", " "), (21, 0, "user", "w " * 5000), (41, 0, "", None), (43, 0, "a", "lone"), (-3, 0, "user", "a")]
    rows = [r for r in rows if r[0] not in (40,)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", part long, words string")
    # Without conversation 40 those of 41 to 59 have no opening, so some have no turn left; the ids below 0 go with SQL's remainder.
    want = brute_trie([r for r in rows if r[0] != -3])
    assert by_text(trie_rows(df.filter("conv_id is null or conv_id <> -3"))) == by_text(want)
    assert any(n == 0 for _, n, *_ in want) and sum(r[3] for r in trie_rows(df) if r[1] == 0) == len({r[0] for r in rows})
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


def test_trie_of_many_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    monkeypatch.setattr(trie, "MANY_CHILDREN", 3)
    monkeypatch.setattr(trie, "HEAVY", 20)
    rows = [(20 * c, t, "user", f"t{t}") for c in range(400) for t in range(3)] + [(20 * c, 0, "user", f"first {c}") for c in range(400, 700)] + [(99_980, t, "user", f"turn {t}") for t in range(3000)]
    assert by_text(trie_rows(spark.createDataFrame(rows, TURNS))) == by_text(brute_trie(rows))


def test_trie_ranks_are_a_preorder(spark):
    rows = some_turns(5, 200)
    nodes = trie.prefix_trie(trie.conversations(spark.createDataFrame(rows, TURNS))).orderBy("rank").collect()
    assert [n.rank for n in nodes] == list(range(len(nodes)))
    open_ends = []
    for n in nodes:
        while open_ends and open_ends[-1] <= n.rank:
            open_ends.pop()
        assert n.depth == len(open_ends) and (not open_ends or n.end <= open_ends[-1])
        open_ends.append(n.end)


# ---- token files


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(packing.default_tokenizer()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (None, "no id"), (10**12, ""), (10**12 + 1, "x" * 200_000), (10**12 + 2, "<|endoftext|> é \U0001f600" * 300)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, part long, ids string")
    assert sorted(map(repr, [tuple(r) for r in tokens.token_digest(df).collect()])) == sorted(map(repr, brute_tokens(rows)))


def test_token_files_are_flat_and_mapped(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, f"document {i} " * (i % 7)) for i in range(500)] + [(7, "twice"), (7, "twice")]
    manifest = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), shard_bytes=800)
    parts = sorted(manifest.collect())
    assert len(parts) > 8 and sum(p.n_docs for p in parts) == len(rows)
    base = first = 0
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = {7: None} | {k: t for k, t in rows if k != 7}
    seen = []
    for p in parts:
        assert (p.base, p.first_doc) == (base, first)
        flat, offsets = np.fromfile(tmp_path / f"tokens-{p.shard:06d}.u16", "<u2"), np.fromfile(tmp_path / f"offsets-{p.shard:06d}.i64", "<i8")
        assert len(flat) == p.n_tokens == offsets[-1] and len(offsets) == p.n_docs + 1
        shard = tokens.TokenShard(str(tmp_path), p.shard, p.kind)
        assert isinstance(shard.tokens, np.memmap) and len(shard) == p.n_docs
        for i in range(len(shard)):
            k = shard.doc_ids[i].as_py()
            seen.append(k)
            if texts[k] is not None:
                assert tok.decode(shard[i][:-1].tolist()) == texts[k] and shard[i][-1] == 2
        base, first = base + p.n_tokens, first + p.n_docs
    assert seen == sorted(seen) and seen.count(7) == 3
    back = tokens.read_tokens(spark, str(tmp_path)).collect()
    assert len(back) == len(rows) and all(len(r.ids) == 4 * r.n_tokens for r in back)
    assert not [x for x in tmp_path.iterdir() if re.search("[0-9a-f]{32}$", x.name)]


def test_token_files_of_nothing_and_of_text_ids(spark, tmp_path):
    assert tokens.token_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = tokens.token_digest(spark.createDataFrame([("b", "x"), ("a", "y z"), (None, None)], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.start) for r in sorted(named, key=lambda r: r.start)] == [(None, 0), ("a", 1), ("b", 4)]
    assert tokens.width(50_257) == "u16" and tokens.width(1 << 16) == "u16" and tokens.width((1 << 16) + 1) == "u32"


# ---- Merkle manifest


def up(nodes):
    """The root of a list of nodes, and per leaf its siblings (before, after) by level."""
    proofs, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, spans = [], []
        for s in range(0, len(nodes), 3):
            run = nodes[s : s + 3]
            for k in range(len(run)):
                for m in under[s + k]:
                    proofs[m].append((run[:k], run[k + 1 :]))
            above.append(sha("".join(run)))
            spans.append(sum(under[s : s + 3], []))
        nodes, under = above, spans
    return nodes[0], proofs


def brute_merkle(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees.append(up([x[2] for x in sources[s]]))
    if not order:
        return []
    root, tops = up([t[0] for t in trees])
    out = []
    for s, (sub, proofs), top in zip(order, trees, tops, strict=True):
        for (_, _, h, r), p in zip(sources[s], proofs, strict=True):
            x = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                x = leaf((*r[:4], r[4].replace("\n", "")))
            for before, after in p + top:
                x = sha("".join([*before, x, *after]))
            out.append((r[0], h, sub, root, sha("".join("".join(b + a) for b, a in p + top)), x, x == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def merkle_rows(df):
    return sorted(map(repr, [tuple(r) for r in merkle.verify_report(df).collect()]))


def some_docs(n, sources, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([k, None]), rng.choice(["a\nb", "ab", "", None, f"é {k}\n"])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 300])
def test_merkle_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = some_docs(n, ["hot"] * 6 + ["a", "b", None, "", "é", "z"])
    assert merkle_rows(spark.createDataFrame(rows, DOCS)) == sorted(map(repr, brute_merkle(rows)))


def test_merkle_of_whole_blocks_and_many_sources(spark):
    rows = some_docs(1500, ["hot"], 2) + [(k, f"s{k % 900}", None, 1, "x") for k in range(1500, 2600)]
    assert merkle_rows(spark.createDataFrame(rows, DOCS)) == sorted(map(repr, brute_merkle(rows)))


def test_merkle_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", 1, "same\n"), (3, "s", "en", 1, "same\n"), (3, "s", "en", 1, "other\n"), (-4, "s", "", 0, "x" * 300_000 + "\n")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS + ", leaf string, idx long")
    assert merkle_rows(df) == sorted(map(repr, brute_merkle(rows)))
    assert merkle_rows(spark.createDataFrame([], DOCS)) == []


def test_merkle_rows_equal_those_of_sql_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    rows = some_docs(200, ["hot"] * 3 + ["a", None, ""])
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"}).astype(object).where(lambda d: d.notna(), None))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(source AS VARCHAR) AS source, CAST(lang AS VARCHAR) AS lang, CAST(n_chars AS BIGINT) AS n_chars, CAST(text AS VARCHAR) AS text FROM given")
    assert spark_rows(merkle.verify_report(spark.createDataFrame(rows, DOCS))) == duck_rows(con, oracles.SQL["op13_merkle_manifest"])


def test_rows_are_numbered_in_groups_over_many_ranges(spark):
    rows = [("hot", k % 50, k) for k in range(900)] + [(g, k, k) for g in ("a", None, "z") for k in range(20)]
    random.Random(1).shuffle(rows)
    got = ranks.numbered(spark.createDataFrame(rows, "g string, a long, b long"), ["g"], ["a", "b"]).collect()
    for g in ("hot", "a", None, "z"):
        mine = sorted((r["index"], r.a, r.b) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
