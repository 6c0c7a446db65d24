"""Bootstrapped extraction against a plain version, and its cost in one long text."""

import random
import re
import time
from collections import defaultdict

import pytest

from tests.llm import brute
from tests.oracle import DATA
from tidemark.llm import pii

CANDIDATE = re.compile(r"(?<![A-Za-z0-9@._%+/-])[A-Za-z@._%+/-]*+[0-9][A-Za-z0-9@._%+/-]*+")
WORD = re.compile(r"[^\W\d_]+")


def letters(part):
    return [w.lower() for w in re.findall(r"[^\W\d_]+", part)]


def bootstrap(texts):
    """For each text the spans that patterns add."""
    found = []
    for t in texts:
        base = [(a, b, True) for _, a, b in brute.pii(t)[2]]
        more = [(m.start(), m.end(), False) for m in CANDIDATE.finditer(t) if len(m[0]) >= pii.LEAST_CHARS]
        free = base + [x for x in more if not any(a < x[1] and x[0] < b for a, b, _ in base)]
        kinds = {k: [(m.start(), m.end()) for m in re.finditer(rx, t)] for k, rx, _ in brute.PII} | {"id": [(m.start(), m.end()) for m in CANDIDATE.finditer(t)]}
        for a, b, seed in free:
            # A context reaches to the neighbouring match of the same kind.
            of = [k for k, v in kinds.items() if (a, b) in v and (k != "id") == seed]
            for k in of:
                if seed and (k, a, b) not in brute.pii(t)[2]:
                    continue
                i = kinds[k].index((a, b))
                left = letters(t[kinds[k][i - 1][1] if i else 0 : a])
                right = letters(t[b : kinds[k][i + 1][0] if i + 1 < len(kinds[k]) else len(t)])
                last, prev, nxt = (left or [""])[-1], (["", *left])[-2] if len(left) > 1 else "", (right or [""])[0]
                ps = [(1, prev, last)] * bool(prev and last) + [(2, last, nxt)] * bool(last and nxt)
                found.append((len(found), t, a, b, seed, t[a:b], ps))
    edges = defaultdict(set)
    for *_, inst, ps in found:
        for p in ps:
            edges[p].add(inst)
    seeds = {x[5] for x in found if x[4] and x[6]}
    known = set(seeds)
    while True:
        doubt = defaultdict(lambda: 1.0)
        for insts in edges.values():
            s = len(insts & known)
            if s >= pii.MIN_SEEDS:
                for x in insts - known:
                    doubt[x] *= 1 - s / (s + pii.DOUBT * (len(insts) - s) + 1)
        more = {x for x, d in doubt.items() if 1 - d >= pii.MIN_SCORE - 1e-9}
        if not more:
            break
        known |= more
    out = {t: set() for t in texts}
    for _, t, a, b, seed, inst, _ in found:
        if not seed and inst in known - seeds:
            out[t].add((a, b))
    return [sorted(out[t]) for t in texts]


def test_spans_equal_a_plain_bootstrap(spark):
    rng = random.Random(3)
    seeds = [lambda: f"u{rng.randint(1, 60)}@ex.org", lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(1, 255)}", lambda: f"+1 974 555 {rng.randint(1000, 1030)}"]
    ids = [lambda: f"ID-{rng.randint(100000, 100040)}", lambda: f"x{rng.randint(10**6, 10**6 + 30)}", lambda: f"{rng.randint(10, 99)}", lambda: "a.b@" + str(rng.randint(1000, 1040))]
    words = "contact mail the user at host number Über is of very looooooooooooooooooooooooooooooooooooooooooooooooooooooooong".split()
    texts = []
    for _ in range(250):
        out = []
        for _ in range(rng.randint(1, 12)):
            out += rng.choices(words, k=rng.randint(0, 4)) + [rng.choice(seeds if rng.random() < 0.4 else ids)()]
        texts.append(rng.choice([" ", ", ", "\n"]).join(out) + rng.choice(["", " end", "!"]))
    texts = list(dict.fromkeys(texts))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = bootstrap(texts)
    assert sum(map(len, want)) > 100
    for i, (t, spans) in enumerate(zip(texts, want, strict=True)):
        assert got[i].spans == ",".join([f"{k}:{a}:{b}" for k, a, b in brute.pii(t)[2]] + [f"id:{a}:{b}" for a, b in spans]), t
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, spans) in enumerate(zip(texts, want, strict=True)):
        order = {k: n for n, k in enumerate((*pii.KINDS, "id"))}
        out, at = "", 0
        for a, b, k in sorted([(a, b, order[k]) for k, a, b in brute.pii(t)[2]] + [(a, b, 4) for a, b in spans]):
            if a >= at:
                out += t[at:a] + f"[{(*pii.KINDS, 'id')[k]}]"
            at = max(at, b)
        assert clean[i] == out + t[at:]


def test_accepted_instances_support_further_patterns(spark):
    rows = [f"please mail user{i}@ex.org now" for i in range(10)] + [f"please mail KEY-{i}000 now" for i in range(10, 16)]
    rows += [f"our badge KEY-{i}000 opens" for i in range(10, 14)] + ["our badge KEY-99000 opens", "some other KEY-77000 thing"]
    got = {r.doc_id: r.n_id for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [0] * 10 + [1] * 11 + [0]


@pytest.mark.parametrize("op", [pii.find_pii, pii.redact])
def test_many_spans_in_one_text_cost_in_proportion(spark, op):
    took = []
    for n in (8_000, 80_000):
        text = " ".join(f"mail u{i}@ex.org or ask for number A-{i}00000 é" for i in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
        df.count()
        start = time.perf_counter()
        row = op(df).first()
        took.append(time.perf_counter() - start)
        assert ("spans" not in row or (row.n_email, row.n_id) in ((n // 2, n // 2), (n // 2, 0))) and ("text" not in row or row.text.count("[email]") == n // 2)
    assert took[1] < 12 * took[0] + 5


def test_seeds_of_the_table_are_unchanged(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.base_sha256 for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == brute.pii(t)[1] for k, t in rows)
