from fractions import Fraction

import numpy as np
import pytest

from matrixloom.llm import whitening


def brute(rows, components=8):
    """Exact covariance in fractions, whitened in doubles."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, [int(np.floor(1024 * c)) + 100_000 for c in v]) for i, v in kept if len(v) == d]
    n, total = len(kept), [sum(x[k] for _, x in kept) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for _, x in kept), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return kept, n, total, cov, values, vectors


@pytest.mark.parametrize("d, diagonals", [(1, 64), (5, 64), (6, 2), (64, 64)])
def test_against_fractions(spark, monkeypatch, d, diagonals):
    monkeypatch.setattr(whitening, "DIAGONALS", diagonals)
    rng = np.random.default_rng(d)
    mix = rng.normal(size=(d, d))
    rows = [(i if i % 7 else None, (rng.normal(size=d) @ mix).tolist()) for i in range(90)]
    rows += [(500, None), (501, []), (502, [None] + [0.5] * (d - 1)), (503, [float("nan")] * d), (504, [float("inf")] * d), (505, [0.1] * (d + 1)), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS x", "3 AS `y.z`", "4 AS component").repartition(5)
    got = whitening.whitened(df).collect()
    kept, n, total, cov, values, vectors = brute(rows)
    assert len(got) == n * len(values) and {r.n for r in got} == {n}
    by = {}
    for i, x in kept:
        by.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(x, total))), []).append((np.array(x) - np.array(total) / n) @ vectors / np.sqrt(values))
    signs = {}
    for r in got:
        want = by[r.id, int(r.deviation)][0][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(r.whitened * want) or 1) if abs(want) > 1e-6 else 1
        assert abs(r.whitened * signs.get(r.component, sign) - want) < 1e-6
        assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_the_covariance_is_exact(spark):
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e8):  # the second sums decimals
        rows = [(i, (scale * rng.normal(size=6)).tolist()) for i in range(50)]
        kept, n, total, cov, *_ = brute(rows)
        x, d = whitening.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got_n, got, width = whitening.means(x)
        assert (got_n, got, d) == (n, total, 6)
        centre = [round(Fraction(s, n)) for s in total]
        centred = spark.createDataFrame([(i, [a - b for a, b in zip(v, centre)]) for i, v in kept], "id long, y array<long>")
        out = whitening.covariance(centred, n, [Fraction(s, n) - c for s, c in zip(total, centre)], width)
        assert (out == cov).all()


def test_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whitened(same).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whitened(line).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True} and got[0].identity_error < 1e-9
    for empty in (same.limit(0), spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")):
        out = whitening.whitened(empty)
        assert out.count() == 0 and out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="can't be whitened"):
        whitening.whitened(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"))
