"""Importance resampling, centroid clustering and the projection forest against brute force and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import heap_clusters, importance, projection_forest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<double>, label int"


def drawn(docs, items, ngram, buckets, seed, least, percent):
    """(n_features, weight, score, rank) by id, counted feature by feature."""
    def features(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i:i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    sides = [collections.Counter(bucket(f) for t in texts for f in features(t)[1])
             for texts in ([t for _, t in docs], items)]
    s_all, t_all = (sum(c.values()) for c in sides)
    gain = [math.floor(1000 * math.log((sides[1][b] + 1) * (s_all + buckets) / ((sides[0][b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    out = {}
    for i, t in docs:
        w, f = features(t)
        weight = math.floor(sum(gain[bucket(x)] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(w)]
    able = sorted((-r[2], i) for i, r in out.items() if r[4] >= least)
    for place, (_, i) in enumerate(able[:len(able) * percent // 100]):
        out[i][3] = place + 1
    return {i: tuple(r[:4]) for i, r in out.items()}


@pytest.mark.parametrize("ngram", [1, 2, 4])
def test_draw_equals_counting_every_feature(spark, docs, ngram):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    given += [(-1, None), (-2, ""), (-3, "ÀÉ été_x-Y 9z   你好"), (-4, "same words " * 40), (-5, "same words " * 40)]
    items = ["the same Words", None, "", "été 9Z"]
    found = importance.resample(docs(given), spark.createDataFrame([(t,) for t in items], "text string"), ngram, 97, 7, 15, 30)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()} == drawn(
        given, items, ngram, 97, 7, 15, 30)


def test_draw_of_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    clashing = odd.withColumns({c: F.lit("clash") for c in ("score", "weight", "able", "down", "last", "before_able", "n")})
    rows = importance.resample(clashing, items, percent=50, least_words=1).collect()
    assert len(rows) == odd.count() and {r.weight for r in rows if r.doc_id in (2, 3, 4)} == {0}
    able = sum(bool(WORD.findall(r.text or "")) for r in odd.collect())
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, able // 2 + 1))
    assert rows and importance.resample(odd.limit(0), items).count() == 0
    assert importance.resample(odd, items.limit(0)).count() == odd.count()
    assert importance.selected(odd, items, percent=50, least_words=1).count() == len(ranks)


def lloyd(rows, k, rounds, seed=1, scale=64):
    """(cluster, squared distance) by place, centroids; whole numbers of Python."""
    v = [[math.floor(scale * x) for x in e] for _, e in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for (i, _), x in zip(rows, v, strict=True))[:k]
    centres = [x for _, x in first]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres] for x in v]
        at = [min(range(len(centres)), key=r.__getitem__) for r in far]
        for c in range(len(centres)) if turn < rounds else ():
            own = [x for x, a in zip(v, at, strict=True) if a == c]
            centres[c] = [sum(column) // len(own) for column in zip(*own, strict=True)] if own else centres[c]
    return [(a, r[a]) for a, r in zip(at, far, strict=True)], centres


@pytest.mark.parametrize(("seed", "big", "rounds"), [(1, 1.0, 3), (2, 1e7, 3), (3, 1e20, 2), (4, 1.0, 8)])
def test_clusters_equal_lloyd(spark, seed, big, rounds):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 4)) * 3
    points = (middles[rng.integers(0, 5, 240)] + rng.normal(size=(240, 4)) * 0.4) * big
    points = np.concatenate([points, points[:15], np.zeros((3, 4))])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    expected, centres = lloyd(rows, 6, rounds)
    found = heap_clusters.cluster(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), 6, rounds, 4).collect()
    cut = 2 ** 63 - 1
    assert {r.vec_id: (r.cluster, r.distance) for r in found} == {
        i: (a, min(d, cut)) for i, (a, d) in enumerate(expected)}
    assert {r.centroid_sha256 for r in found} == {
        hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest() for a, _ in expected}
    if big == 1.0:
        assert {r.inertia for r in found} == {sum(d for _, d in expected)}
        assert {(r.cluster, r.cluster_inertia) for r in found} == {
            (c, sum(d for a, d in expected if a == c)) for c in {a for a, _ in expected}}
        assert any(r.scans < rounds for r in found)  # bounds spare some vectors a scan


def test_clusters_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [5.0, 5.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [inf, 0.0], 0),
            (5, [nan, 0.0], 0), (6, [1.0], 0), (7, [], 0), (None, [9.0, 9.0], None)]
    df = spark.createDataFrame(rows, VECTORS)
    clashing = df.withColumns({c: F.lit("clash") for c in ("v", "cluster", "was", "expires", "turn", "distance", "scans")})
    found = heap_clusters.cluster(clashing, dim=2).collect()
    assert sorted((str(r.vec_id), r.distance) for r in found) == [("1", 0), ("1", 0), ("1", 0), ("None", 0)]
    assert len({r.cluster for r in found}) == 3  # equal vectors share the smaller number
    assert {r.vec_id for r in heap_clusters.cluster(clashing, k=1, dim=2).collect()} == {1, None}
    assert heap_clusters.cluster(df.limit(0), dim=2).count() == 0


def linked(rows, cosine):
    """(n_links, component) by place, from all pairs."""
    n = len(rows)
    v = np.array([e for _, e, _ in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([x for _, _, x in rows])
    near = (v @ v.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.array([i for i, _, _ in rows])
    for _ in range(n):
        least = np.minimum(root, np.where(near, root[None, :], root[:, None]).min(axis=1))
        if (least == root).all():
            break
        root = least
    return near, root


def border(rng, n, dim, low, high):
    """n random unit vectors and a partner of each at a cosine between low and high."""
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(low, high, n)[:, None]
    return np.concatenate([a, c * a + np.sqrt(1 - c ** 2) * b])


def test_forest_finds_nine_of_ten_border_links_and_no_other(spark):
    rng = np.random.default_rng(11)
    v = border(rng, 700, 64, 0.93, 0.95)
    rows = [(int(i), x.tolist(), 0) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    near, _ = linked(rows, 0.93)
    found = {r.vec_id: r for r in projection_forest.near_copies(
        spark.createDataFrame(rows, VECTORS).repartition(4), leaf_rows=48, sample=300, levels=2).collect()}
    links = np.array([found[i].n_links for i, _, _ in rows])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum()
    for (i, _, _), here in zip(rows, near, strict=True):
        partners = {rows[j][0] for j in np.flatnonzero(here)} | {i}
        assert found[i].component_id in partners and found[i].kept == (found[i].component_id == i)


def test_forest_of_dense_groups_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(4, 16))
    v = [middles[g] + rng.normal(size=16) * s for g, n, s in ((0, 300, 0.08), (1, 90, 0.2), (2, 40, 0.3), (3, 12, 0.05))
         for _ in range(n)]
    v += v[:70]
    rows = [(1000 - i, (x * rng.choice((0.5, 1, 3))).tolist(), i % 2) for i, x in enumerate(v)]
    near, root = linked(rows, 0.93)
    found = projection_forest.near_copies(spark.createDataFrame(rows, VECTORS), leaf_rows=60, block=64, trees=6, spill=2.0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {
        rows[i][0]: (int(near[i].sum()), int(root[i])) for i in range(len(rows))}


def test_forest_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, None, 1),
            (10, [0.0, 0.0], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [None, 1.0], 1), (14, [], 1), (15, [1.0], 1),
            (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 2), (16, [1e300, 1e-300], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    clashing = df.withColumns({c: F.lit("clash") for c in ("key", "rid", "grp", "v", "weight", "low", "leaf", "n_links")})
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection_forest.near_copies(clashing).collect()),
                   key=str)
    alone = [(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 13, 14, 15)]
    assert found == sorted([*alone, (5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (16, 4, 3, False),
                            (None, 4, 3, False), (None, 0, None, False)], key=str)
    assert projection_forest.near_copies(df.limit(0)).count() == 0
