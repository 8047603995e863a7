"""Centroid clustering and whitening against brute force, and their edges."""

import hashlib
import math

import numpy as np
import pytest

from dossier.llm import centroids, whitening
from tests.sql_twin import DATA

SCHEMA = "vec_id long, embedding array<float>, cluster string, x string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def many(n, dim, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=dim) * spread + (i % 5)).astype(np.float32).tolist()) for i in range(n)]


def clusters_by_hand(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=repr)


def test_clusters(spark):
    rows = many(300, 6)
    rows += rows[:40] + [(None, rows[3][1]), (None, rows[4][1]), (7, None), (8, []), (9, [1.0] * 5), (10, [1.0] * 7), (11, [None] + [1.0] * 5), (12, [math.nan] + [1.0] * 5), (13, [-math.inf] + [1.0] * 5)]
    found = sorted(map(tuple, centroids.clustered(vectors(spark, rows), k=9, rounds=4, dim=6)[0].collect()), key=repr)
    assert found == clusters_by_hand(rows, 9, 4, 6, 256)


def test_clusters_edges(spark):
    empty = centroids.clustered(vectors(spark, []), dim=3)
    assert empty[0].collect() == [] and empty[1] == [] and empty[0].columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(i, [float(i), 0.0, -float(i)]) for i in range(3)] + [(None, [5.0, 5.0, 5.0])]  # fewer vectors than centroids
    assert sorted(map(tuple, centroids.clustered(vectors(spark, few), k=10, dim=3)[0].collect()), key=repr) == clusters_by_hand(few, 10, 5, 3, 256)
    same = [(i, [0.25, 0.5, 1.0]) for i in range(50)]  # all equal: the first centroid takes all, the others stay empty
    assert {r["cluster"] for r in centroids.clustered(vectors(spark, same), k=4, dim=3)[0].collect()} == {0}
    far = [(1, [3e38, -3e38, 0.0]), (2, [0.0, 0.0, 0.0])]
    assert {(r["vec_id"], r["distance"]) for r in centroids.clustered(vectors(spark, far), k=1, rounds=0, dim=3)[0].collect()} <= {(1, 0), (2, 2**55), (1, 2**55), (2, 0)}


def test_floor_of_negative_means(spark):
    rows = [(1, [-1 / 256]), (2, [0.0]), (3, [-2 / 256])]
    _, centres = centroids.clustered(vectors(spark, rows), k=1, rounds=1, dim=1)
    assert centres == [[-1]]
    _, centres = centroids.clustered(vectors(spark, rows[:2]), k=1, rounds=1, dim=1)
    assert centres == [[-1]]


def whitened_by_hand(rows, most):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    v = (d.T @ d / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [i for i, _ in kept], n, (d * d).sum(1).tolist(), (d.astype(float) / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rows = [(i, v) for i, v in many(500, 12, 3, 4.0)]
    rows += [(3, rows[3][1]), (None, rows[9][1]), (7, None), (11, [None] + [1.0] * 11), (12, [math.nan] + [1.0] * 11), (13, [math.inf] + [1.0] * 11)]
    ids, n, deviation, w, share = whitened_by_hand(rows, 8)
    found = whitening.whiten(vectors(spark, rows).repartition(3), most=8).collect()
    assert len(found) == len(ids) * 8 and {r["n"] for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r["deviation"], r["vec_id"]), {}).setdefault(r["component"], []).append(r)
    sign = {k: None for k in range(1, 9)}
    for i, d, own in zip(ids, deviation, w, strict=True):
        for k in range(1, 9):
            for r in by[d, i][k]:
                if sign[k] is None and abs(own[k - 1]) > 0.1:
                    sign[k] = math.copysign(1, own[k - 1] * r["whitened"])
                assert abs(abs(r["whitened"]) - abs(own[k - 1])) < 1e-9 and (sign[k] is None or abs(r["whitened"] * sign[k] - own[k - 1]) < 1e-9)
                assert r["explained"] == pytest.approx(share[k - 1], rel=1e-10) and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(5)]):
        found = whitening.whiten(vectors(spark, rows))
        assert found.collect() == [] and found.columns == columns
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()  # one dimension's worth
    assert {r["component"] for r in line} == {1} and all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-9 for r in line)
    mixed = whitening.whiten(vectors(spark, [(1, [1.0, 5.0]), (2, [2.0, 3.0]), (3, [4.0, 4.0]), (4, [9.0])])).collect()
    assert {r["vec_id"] for r in mixed} == {1, 2, 3} and {r["n"] for r in mixed} == {3}
    far = whitening.whiten(vectors(spark, [(1, [3e38, 5.0]), (2, [-3e38, 3.0]), (3, [4.0, 4.0])]))
    assert dict(far.dtypes)["deviation"] == "decimal(38,0)" and all(math.isfinite(r["whitened"]) for r in far.collect())


def test_common_bits_are_products():
    r = np.random.default_rng(1)
    for n, dim, top in ((1, 3, 2), (64, 4, 1000), (65, 2, 1 << 41), (1000, 5, 70)):
        x = r.integers(0, top, (n, dim))
        assert (whitening.products(x, int(x.max()).bit_length()) == x.T.astype(object) @ x.astype(object)).all()


def test_queries(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, centroids.op12_centroids(spark, DATA).collect()), key=repr) == clusters_by_hand(rows, 40, 5, 64, 256)
    ids, n, deviation, w, share = whitened_by_hand(rows, 32)
    found = {(r["vec_id"], r["component"]): r for r in whitening.op13_whitening(spark, DATA).collect()}
    assert len(found) == 32 * len(ids)
    for i, d, own in zip(ids, deviation, w, strict=True):
        for k in range(32):
            r = found[i, k + 1]
            assert r["deviation"] == d and abs(abs(r["whitened"]) - abs(own[k])) < 1e-8 and r["explained"] == pytest.approx(share[k], rel=1e-9) and r["identity_error"] < 1e-9
