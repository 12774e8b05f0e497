import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from matrixloom.llm import centroids


def brute(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [math.floor(c * scale) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min((d(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        c = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [x for (_, x), a in zip(kept, at) if a == j]) else y for j, y in enumerate(c)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), c


def make(n, size, seed, ties):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) if ties else rng.gauss(i % 5, 1) for _ in range(size)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * (size + 1)), (n + 3, [None] * size), (n + 4, [float("nan")] * size), (n + 5, [float("-inf")] * size)]
    return rows + [(None, [0.5] * size), (None, [-0.5] * size), rows[2], rows[2], (rows[2][0], [9.0] * size)]


@pytest.mark.parametrize("size, ties, k", [(2, True, 6), (3, True, 16), (5, False, 16), (64, False, 16), (4, False, 500)])
def test_against_all_distances(spark, size, ties, k):
    rows = make(240, size, size, ties)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS x", "3 AS cluster", "4 AS `a.b`").repartition(3)
    out, c = centroids.clustered(df, k=k, size=size)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, centres = brute(rows, k=k, size=size)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=str) == want
    assert c.tolist() == centres
    full = centroids.with_inertia(out, c).collect()
    total = {}
    for _, a, d in want:
        total[a] = total.get(a, 0) + d
    assert all(r.inertia == sum(total.values()) and r.cluster_inertia == total[r.cluster] for r in full)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in full)


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 9, (400, 8)) + 60 * j for j in range(6)])
    c = x[::400][:6].copy()
    bounds, done = centroids.Bounds.none(len(x), 6), []
    for _ in range(4):
        done.append(bounds.assign(x, c))
        d = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
        assert (bounds.cluster == d.argmin(axis=1)).all()
        assert (bounds.upper >= d.min(axis=1)).all() and (bounds.lower <= d).all()
        new = np.array([np.floor_divide(x[bounds.cluster == j].sum(axis=0), (bounds.cluster == j).sum()) for j in range(6)])
        bounds, c = bounds.moved(c, new), new
    assert done[-1] <= len(x) < done[0] < 6 * len(x)


def test_no_vectors_and_vectors_that_are_too_large(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out, c = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert centroids.with_inertia(out, c).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>"))


def test_sql_states_the_same(spark, sf):
    got = centroids.op13(spark, sf).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(centroids.ORACLE).df()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want[list(got.columns)].values.tolist()))
