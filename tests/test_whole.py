"""Matrices that one task holds are searched whole: as the rounds of joins do, in a few tables."""

import random

import pytest

from matrixloom import model, storage
from matrixloom.functions import entries
from matrixloom.model import Matrices
from matrixloom.operators import balance, camion, elimination, pivots, recognition, series
from tests.test_entries import frame, sparse


def written(monkeypatch, module):
    """The tables that a module's rounds and passes write, by their tags."""
    tags = []
    for name in ("written", "counted"):
        real = getattr(storage, name)

        def noted(df, tag, *sums, real=real):
            tags.append(tag)
            return real(df, tag, *sums)

        monkeypatch.setattr(storage, name, noted)
        for m in (module, series):
            if hasattr(m, name):
                monkeypatch.setattr(m, name, noted)
    return tags


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def chain(lines):
    return {(i, i + k): 1 for i in range(lines) for k in (0, 1) if i + k < lines}


def some(seed, values=(-1, 1), sizes=7):
    rng = random.Random(seed)
    out = {0: (0, 0, {}), 1: (3, 0, {}), 2: (2, 2, {})}
    for k in range(3, 40):
        m, n = rng.randrange(1, sizes), rng.randrange(1, sizes)
        out[k] = (m, n, sparse(rng, m, n, rng.randrange(0, 24), values))
    return out


@pytest.mark.parametrize("function", [series.left_over, series.series_parallel])
def test_chains_of_reductions_take_no_rounds(spark, monkeypatch, function):
    tags = written(monkeypatch, series)
    ms = frame(spark, {1: (12, 12, chain(12))})
    assert function(ms).first().is_sp and len(tags) <= 4  # one counted table is noted twice


@pytest.mark.parametrize("ternary", [True, False])
def test_reductions_are_those_of_rounds(spark, monkeypatch, ternary):
    ms = frame(spark, some(1, (-1, 1) if ternary else (1,)))
    assert rows(series.left_over(ms, ternary)) == rows(series._left_over(ms, ternary))
    want = rows(series._series_parallel(ms, ternary))
    assert rows(series.series_parallel(ms, ternary)) == want
    monkeypatch.setattr(model, "WHOLE", 9)  # some of them go by rounds
    assert rows(series.series_parallel(ms, ternary)) == want


def ring(k, v):
    return {(i, j): v if (i, j) == (0, 0) else 1 for i in range(k) for j in (i, (i + 1) % k)}


def test_camion_takes_no_rounds_and_tells_what_they_tell(spark, monkeypatch):
    tags = written(monkeypatch, camion)
    ms = frame(spark, {**some(2, (-1, 1, 1, 2), 5), 50: (5, 5, ring(5, 1)), 51: (6, 6, ring(6, 1))})
    got = rows(camion.camion_test(ms))
    assert len(tags) <= 4
    assert got == rows(camion._camion_test(ms))


def test_camion_signs_are_those_of_rounds(spark):
    ms = frame(spark, {**some(3, sizes=5), 50: (5, 5, ring(5, 1))})
    assert rows(camion.camion_signed(ms).entries) == rows(camion._camion_signed(ms).entries)


def test_balancedness_takes_no_rounds_and_tells_what_they_tell(spark, monkeypatch):
    tags = written(monkeypatch, balance)
    ms = frame(spark, {**some(4, (-1, 1), 6), 50: (5, 5, ring(5, 1)), 51: (6, 6, ring(6, 1)), 52: (6, 6, ring(6, -1))})
    got = rows(balance.balanced_test(ms))
    assert len(tags) <= 4 and got == rows(balance._balanced_test(ms))
    monkeypatch.setattr(balance, "CORE", 11)  # the rings of six go by rounds
    assert rows(balance.balanced_test(ms)) == got


def test_large_cores_with_few_paths_take_no_rounds(spark, monkeypatch):
    tags = written(monkeypatch, balance)
    cells = sparse(random.Random(7), 14, 14, 90, (-1, 1))
    near = entries.near_of([(r, c, v) for (r, c), v in cells.items()])
    entries.reduced(near, True)
    assert sum(map(len, near.values())) > 2 * balance.CORE
    ms = frame(spark, {1: (14, 14, cells), 2: (60, 60, ring(60, 1)), 3: (61, 61, ring(61, 1))})
    got = rows(balance.balanced_test(ms))
    assert len(tags) <= 4
    by_rounds = []
    monkeypatch.setattr(balance, "_balanced_test", lambda large: by_rounds.extend(r.mid for r in large.dims.collect()) or large.dims.selectExpr("mid", "true", "cast(null AS array<int>)", "cast(null AS array<int>)").toDF("mid", "is_balanced", "rows", "cols"))
    monkeypatch.setattr(balance, "PATHS", 125)
    assert balance.balanced_test(ms).count() == 3 and by_rounds == [1]  # it has more paths


@pytest.mark.parametrize("ternary", [True, False])
def test_replays_take_no_rounds_and_tell_what_they_tell(spark, monkeypatch, ternary):
    tags = written(monkeypatch, series)
    ms = frame(spark, {**some(6, (-1, 1) if ternary else (1,)), 50: (12, 12, chain(12)), 51: (5, 5, ring(5, 1))})
    got = rows(series.replays(ms, ternary))
    assert len(tags) <= 4
    assert got == rows(series._replays(ms, ternary))


def test_steps_that_do_not_hold_are_told():
    near = lambda: entries.near_of([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, -1), (2, 1, 1)])
    assert entries.wrong(near(), [(0, -3, 2)], True) == 0
    assert entries.wrong(near(), [(0, -3, 1)], True) == 1  # its entry stands elsewhere
    assert entries.wrong(near(), [(0, -2, -1)], True) == 1  # no copy
    assert entries.wrong(near(), [(0, 2, 0), (1, -2, -1), (2, -3, 0)], True) == 1  # a column with entries; copies by then
    assert entries.wrong(entries.near_of([(0, 0, 1), (1, 0, -1)]), [(0, -2, -1)], False) == 1


def test_rounds_look_at_lines_that_changed_only(monkeypatch):
    looked = []
    monkeypatch.setattr(entries, "sorted", lambda x, **k: looked.append(0) or sorted(x, **k), raising=False)
    near = entries.near_of([(i, j, 1) for i, j in chain(60)] + [(100 + i, 100 + j, v) for (i, j), v in ring(40, 1).items()])
    steps = entries.reduced(near, True)
    assert len(near) == 80 and len({x[0] for x in steps}) > 50 and len(looked) < 600


def test_elimination_takes_no_rounds_and_tells_what_they_tell(spark, monkeypatch):
    tags = written(monkeypatch, elimination)
    ms = frame(spark, some(5, (-3, -1, 1, 2, 10**9), 5))
    square = Matrices(ms.dims.selectExpr("mid", "m", "m AS n"), ms.entries.join(ms.dims.select("mid", "m"), "mid").where("c < m").select("mid", "r", "c", "v"))
    got = rows(elimination.diagonals(ms)), rows(elimination.determinants(square))
    assert len(tags) <= 8
    assert got == (rows(elimination._diagonals(ms)), rows(elimination._determinants(square)))
    tags.clear()
    found = elimination.echelon(ms)
    assert len(tags) <= 4
    want = elimination._echelon(ms, True)
    assert rows(found.pivots) == rows(want.pivots) and rows(found.rows) == rows(want.rows)


def test_pivots_and_complements_are_dealt_to_more_tasks_the_more_entries_there_are(spark, monkeypatch):
    ms = frame(spark, {k: (2, 2, {(0, 0): 1, (0, 1): 1, (1, 1): 1}) for k in range(8)})
    monkeypatch.setattr(model, "work_tasks", lambda spark: 1)
    monkeypatch.setattr(model, "PASS_ROWS", 1)
    for found in (pivots.pivot(ms, ms.dims.selectExpr("mid", "0 AS p", "0 AS q"), 2), recognition.complements(ms, ms.dims.selectExpr("mid", "0 AS i", "1 AS j"))):
        assert found.entries.rdd.getNumPartitions() == 24
