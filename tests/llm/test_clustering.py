import hashlib
import math

import numpy as np
import pytest

from tessella.llm import clustering

KIND = "vec_id long, embedding array<double>"


def plain(rows, k=40, rounds=5, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), by all distances in Python's whole numbers."""
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        by = {}
        for _, v in own:
            by.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if j in by else w for j, w in enumerate(c)]
    out = [(i, *near(v)) for i, v in own]
    total, each = sum(d for _, d, _ in out), {}
    for _, d, j in out:
        each[j] = each.get(j, 0) + d
    return sorted((str(i), j, d, each[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out)


def found(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("k, rounds", [(1, 2), (7, 5), (40, 5), (5, 0)])
def test_as_all_distances(spark, k, rounds):
    """Lumps of vectors, copies, vectors just between two centroids, and unusable ones."""
    rng = np.random.default_rng(k)
    rows = [(i, (rng.integers(-3, 4, 4) / 2).tolist()) for i in range(150)]  # a coarse grid: many ties
    rows += [(1000 + i, (rng.normal(size=4) + 5 * (i % 3)).tolist()) for i in range(150)] + [(2000 + i, [0.5] * 4) for i in range(40)] + [(2000, [0.5] * 4), (7, [9.0] * 4), (None, [1.0] * 4), (None, [-1.0] * 4)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 3), (3003, [1.0, None, 1.0, 1.0]), (3004, [float("nan")] * 4), (3005, [float("-inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, KIND).repartition(5).withColumns({n: clustering.F.lit("x") for n in ("cluster", "distance", "q", "id", "upper", "c")})
    got = clustering.cluster(df, k=k, rounds=rounds, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == plain(rows, k, rounds, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.1, 0.2]), (2, [3.0, 3.0]), (3, [3.0, 3.0]), (None, [5.0, 5.0])]
    assert found(clustering.cluster(spark.createDataFrame(rows, KIND), dim=2)) == plain(rows, dim=2)
    assert found(clustering.cluster(spark.createDataFrame([(1, None)], KIND), dim=2)) == []
    assert found(clustering.cluster(spark.createDataFrame([], KIND))) == []


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 500_000), i * 1000.0]) for i in range(50)]
    assert found(clustering.cluster(spark.createDataFrame(rows, KIND), k=6, dim=2)) == plain(rows, 6, dim=2)
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0])], KIND), dim=2).collect()


def test_bounds_skip_and_stay_true(spark):
    """On lumps of vectors most distances aren't computed, and no bound lies."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(4000, 8)) * 0.1 + 4 * rng.integers(0, 6, (4000, 1)))).astype(np.int64)
    c = x[:12].copy()
    a, upper, lower, n = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), 12)), []
    for _ in range(5):
        between = clustering._down(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2).astype(float)))
        a, _, computed = clustering.assign(x, a, upper, lower, c, between)
        n.append(computed)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all() and (upper ** 2 >= d[np.arange(len(x)), a] * (1 - 1e-12)).all() and (lower ** 2 <= d * (1 + 1e-12)).all()
        now = np.array([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(12)])
        moved = clustering._up(np.sqrt(((now - c) ** 2).sum(1).astype(float)))
        upper, lower, c = clustering._up(upper + moved[a]), clustering._down(lower - moved), now
    assert n[0] < 12 * len(x) and n[-1] < 2 * len(x)
