"""Near-duplicate operators beyond what small tables reach: many reference points, large groups, work that grows slowly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, jaccard


def planted(rng, n, dim, cosine):
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize(("pivots", "dim"), [(32, 64), (256, 64), (1024, 64), (2048, 64), (8192, 64), (32768, 64), (32768, 128), (256, 768), (1024, 768), (10922, 384), (5461, 768)])
@pytest.mark.parametrize("clustered", [False, True])
def test_recall_near_the_threshold(pivots, dim, clustered):
    rng = np.random.default_rng(pivots)
    a, b = planted(rng, 1500, dim, 0.9301)
    points = rng.normal(size=(pivots, dim))
    if clustered:  # a few directions, so that many reference points lie near each vector
        centres = rng.normal(size=(20, dim))
        a = embeddings._unit(centres[rng.integers(0, 20, 1500)] + 0.7 * a * 8)
        z = rng.normal(size=a.shape)
        z = embeddings._unit(z - (z * a).sum(1)[:, None] * a)
        b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * z
        points = centres[rng.integers(0, 20, pivots)] + 0.7 * rng.normal(size=(pivots, dim))
    points = embeddings._unit(points)
    posted, depth = embeddings.reach(pivots)
    p, q = embeddings.permutations(a, points, depth), embeddings.permutations(b, points, depth)
    met = [bool(set(x[:posted]) & set(y[:posted])) and len(set(x) & set(y)) >= embeddings.SHARED for x, y in zip(p.tolist(), q.tolist(), strict=True)]
    assert np.mean(met) >= 0.9


def test_permutations_equal_a_full_sort():
    rng = np.random.default_rng(2)
    x, points = embeddings._unit(rng.normal(size=(200, 8))), embeddings._unit(np.round(rng.normal(size=(300, 8))) + 0.25)
    points[100:150] = points[:50]  # ties
    want = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :8]
    assert (embeddings.permutations(x, points) == want).all()
    assert embeddings.permutations(x, points[:3]).shape == (200, 3)


def test_shared_counts_are_alike_either_way(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = (np.stack([rng.permutation(50)[:8] for _ in range(n)]) for n in (30, 40))
    a[:, 5:], dense = -1, None
    want = [[len(set(x) & set(y) - {-1}) for y in b.tolist()] for x in a.tolist()]
    for limit in (1024, 10):
        monkeypatch.setattr(embeddings, "DENSE", limit)
        assert embeddings._shares(a, b, 50).tolist() == want


def test_candidate_pairs_grow_slower_than_the_square(spark):
    rng, pairs = np.random.default_rng(6), []
    for n in (25_000, 100_000):
        x = embeddings._unit(rng.normal(size=(n, 32)))
        points = x[: 1 << round(np.log2(n) / 2)]
        p = embeddings.permutations(x, points)[:, : embeddings.POSTED]
        pairs.append(int((np.bincount(p.ravel()).astype(np.int64) ** 2).sum()))
    assert pairs[1] < 10 * pairs[0]  # 16 times would be the square


def test_null_ids_and_odd_vectors(spark):
    v = [1.0] + [0.5] * 7
    rows = [(None, v, 0), (1, v, 0), (None, None, 0), (2, [2 * x for x in v], 0), (3, v, None), (4, v + [1.0], 0), (5, v + [1.0], 0)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_large_groups_are_dealt_so_that_every_possible_link_meets(spark):
    rng = np.random.default_rng(3)
    sizes = np.r_[rng.integers(1, 3000, 600), np.arange(1, 60), 124, 125, 155, 156, 157]
    rows = [(7, int(k), int(k), int(n)) for k, n in enumerate(sizes)] + [(8, 1000 + k, 0, 10 + k) for k in range(5)]
    dealt = jaccard._deal(spark.createDataFrame(rows, "low long, node long, label long, n long"), block=20, block_shingles=1 << 40).collect()
    met = set()
    groups = {}
    for r in dealt:
        groups.setdefault((r.low, r.i, r.j), []).append(r)
    for (_, i, j), members in groups.items():
        met |= {(a.node, b.node) for a in members for b in members if a.node < b.node and (i == j or a.mine != b.mine)}
    want = {(a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if 4 * max(sizes[a], sizes[b]) <= 5 * min(sizes[a], sizes[b])}
    assert want <= met and {(1000, 1001), (1000, 1004)} <= met
    all_pairs = (len(sizes) / 20) ** 2 / 2
    assert len({k for k in groups if k[0] == 7}) < 0.5 * all_pairs


def test_join_finds_the_links_of_large_groups(spark, monkeypatch):
    # Blocks of eight texts: each group of the texts below takes many.
    whole = jaccard._deal
    monkeypatch.setattr(jaccard, "_deal", lambda some: whole(some, block=8, block_shingles=1 << 40))
    from tests.llm import brute

    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(120):
        own = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(1, 25)))]
        rows.append((k, " ".join(passage[: int(rng.integers(20, 60))] + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_buckets_beyond_two_to_the_sixteenth(spark, monkeypatch):
    from tests.llm import brute

    monkeypatch.setattr(jaccard, "PER_BUCKET", 1 / 64)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    rng, rows = np.random.default_rng(11), []
    for k in range(80):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        rows += [(4 * k + i, " ".join(base[: 60 - i])) for i in range(4)]
    wanted = []
    first = jaccard.first_pass
    monkeypatch.setattr(jaccard, "first_pass", lambda docs, buckets: wanted.append(buckets) or first(docs, buckets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows) and wanted[0] > 1 << 17


def test_every_length_of_vectors_has_its_own_index(spark):
    rng, rows = np.random.default_rng(12), []
    for dim in (8, 12, 20):
        a, b = planted(rng, 400, dim, 0.97)
        rows += [(f"{dim}", [float(v) for v in x]) for pair in zip(a, b, strict=True) for x in pair]
    df = spark.createDataFrame([(i, v, "one") for i, (_, v) in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    _, classes = embeddings._classes(df)
    pivots = embeddings.choose_pivots(classes)
    assert {d: p.shape for d, p in pivots.items()} == {d: (32, d) for d in (8, 12, 20)}
    sizes = embeddings.post(classes, pivots).groupBy("dim", "list").count().collect()
    assert sum(r["count"] ** 2 for r in sizes) < 0.7 * embeddings.POSTED * 3 * 800**2 and max(r["count"] for r in sizes) < 800
    got = {r.vec_id: r.component_id for r in embeddings.near_vectors(df).collect()}
    assert np.mean([got[2 * k] == got[2 * k + 1] for k in range(1200)]) >= 0.9
    few = embeddings.choose_pivots(classes, most_bytes=32 * 8 * 8 + 100)
    assert list(few) == [8, 12] and len(few[12]) == 1
