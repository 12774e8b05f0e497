"""Operators that work on entries, on matrices of any size, against plain searches."""

import math
import random
import re

import pytest

from matrixloom import storage
from matrixloom.functions import exact, structure
from matrixloom.model import Matrices, from_dense, to_dense
from matrixloom.operators import balance, camion, elimination, paths, series, trees
from matrixloom.sources import generators
from pyspark.sql import functions as F
from tests import fixtures as X


def sparse(rng, m, n, k, values=(-1, 1)):
    return {(rng.randrange(m), rng.randrange(n)): rng.choice(values) for _ in range(k)}


def frame(spark, matrices):
    """A collection from ``{mid: (m, n, {(r, c): v})}``."""
    dims = spark.createDataFrame([(k, m, n) for k, (m, n, _) in matrices.items()], "mid long, m int, n int")
    return Matrices(dims, spark.createDataFrame([(k, r, c, v) for k, (_, _, e) in matrices.items() for (r, c), v in e.items()], "mid long, r int, c int, v int"))


def neighbours(cells):
    out = {}
    for (r, c), v in cells.items():
        out.setdefault(-1 - r, {})[1 + c] = v
        out.setdefault(1 + c, {})[-1 - r] = v
    return out


def order(x):
    return x > 0, abs(x)


def shortest(cells, group):
    """The path that the operator promises, by a search from each group in turn."""
    near, best = neighbours(cells), None
    closed = {x for x, g in group.items() if g < 0}
    for g in sorted({g for g in group.values() if g > 0}):
        back = {x: None for x, h in group.items() if h == g}
        level = list(back)
        while level:
            ahead = {}
            for x in sorted(level, key=order):
                for y in near.get(x, {}):
                    if y not in back and y not in closed and y not in ahead:
                        ahead[y] = x
            back |= ahead
            level = list(ahead)
            hits = sorted((y for y in level if group.get(y, 0) > g), key=order)
            if hits:
                way = [hits[0]]
                while back[way[-1]] is not None:
                    way.append(back[way[-1]])
                if best is None or len(way) < len(best):
                    best = way
                break
    return best and best[::-1]


def test_shortest_paths(spark):
    rng = random.Random(1)
    matrices, groups = {}, []
    for k in range(60):
        m, n = (rng.randrange(1, 9), rng.randrange(1, 9)) if k else (700, 500)
        matrices[k] = (m, n, sparse(rng, m, n, rng.randrange(1, 20) if k else 1500))
        for x in [-1 - i for i in range(m)] + [1 + j for j in range(n)]:
            g = rng.choice([-1, 0, 0, 0, 1, 2, 3]) if k else {-1: 1, 1: 2}.get(x, 0)
            if rng.random() < 0.9 or not k:
                groups.append((k, x, g))
    ms = frame(spark, matrices)
    found = paths.search(ms, spark.createDataFrame(groups, "mid long, element int, grp int"))
    got = {}
    for r in sorted(found.lines().collect(), key=lambda r: r["at"]):
        got.setdefault(r.mid, []).append(r.element)
    ends = {r.mid: r for r in found.found.collect()}
    lengths = set()
    for k, (_, _, cells) in matrices.items():
        want = shortest(cells, {x: g for mid, x, g in groups if mid == k})
        assert got.get(k) == want, k
        if want:
            near = neighbours(cells)
            assert (ends[k].source, ends[k].target, ends[k].length) == (want[0], want[-1], len(want) - 1)
            assert ends[k].total == sum(near[a][b] for a, b in zip(want, want[1:]))
            lengths.add(len(want))
    assert len(lengths) >= 3 and any(k not in got for k in matrices)
    none = paths.shortest_paths(ms, spark.createDataFrame([], "mid long, element int, grp int")).collect()
    assert len(none) == 60 and all(r.source is None and r.total is None for r in none)


def test_delta_epsilons_close_cycles(spark):
    """[A a; c e] with the path of ones and minus ones through A."""
    ms = from_dense(spark, {
        1: [[1, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 1]],
        2: [[-1, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 1]],
        3: [[1, 0, 0, 0], [0, 1, 1, 0], [1, 0, 0, 1], [0, 0, 1, 1]],
        4: [[1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 1], [1, 0, 1, 1]],
    })
    parts = spark.createDataFrame([(k, [0, 1], [0, 1]) for k in (1, 2, 3, 4)], "mid long, rows array<int>, cols array<int>")
    got = {r.mid: r.epsilon for r in paths.delta_epsilons(ms, parts).collect()}
    # 1: the path r2 c1 r1 c2, sum 3, with entries 1 and 1 has 5; 2: with the sign changed 3
    # 3: no path joins the blocks; 4: a block of rank 2
    assert got == {1: -1, 2: 1, 3: None, 4: None}


def check_reductions(spark, matrices, ternary=True):
    ms = frame(spark, matrices)
    steps, cells = series.reductions(ms, ternary)
    wrong = {r.mid: r.wrong for r in series.replayed(ms, steps, ternary).collect()}
    assert wrong == dict.fromkeys(matrices, 0)
    out = {r.mid: r for r in series.left_over(ms, ternary).collect()}
    core, gone = {}, {}
    for r in cells.collect():
        core.setdefault(r.mid, {})[r.r, r.c] = r.v
    for r in steps.collect():
        gone.setdefault(r.mid, set()).add(r.element)
    for k, (m, n, e) in matrices.items():
        left = {-1 - r for r, _ in core.get(k, {})} | {1 + c for _, c in core.get(k, {})}
        assert left.isdisjoint(gone.get(k, set())) and len(left) + len(gone.get(k, ())) == m + n
        assert core.get(k, {}) == {(r, c): v for (r, c), v in e.items() if -1 - r in left and 1 + c in left}
        assert (out[k].rows, out[k].cols, out[k].nonzeros, out[k].is_sp) == (len({r for r, _ in core.get(k, {})}), len({c for _, c in core.get(k, {})}), len(core.get(k, {})), not left)
    return core


def dense(m, n, cells):
    return [[cells.get((i, j), 0) for j in range(n)] for i in range(m)]


@pytest.mark.parametrize("ternary", [True, False])
def test_reductions_leave_what_a_line_by_line_search_leaves(spark, ternary):
    rng = random.Random(2)
    matrices = {0: (0, 0, {}), 1: (3, 0, {}), 2: (0, 2, {}), 3: (2, 2, {}), 4: (1, 1, {(0, 0): -1})}
    for k in range(5, 120):
        m, n = rng.randrange(1, 8), rng.randrange(1, 8)
        matrices[k] = (m, n, sparse(rng, m, n, rng.randrange(0, 30), (-1, 1) if ternary else (1,)))
    core = check_reductions(spark, matrices, ternary)
    for k, (m, n, e) in matrices.items():
        _, rows, cols = structure.sp_reductions(dense(m, n, e), ternary)
        left = core.get(k, {})
        assert (len({r for r, _ in left}), len({c for _, c in left})) == (len(rows), len(cols))


def grown(rng, lines, base, ternary=True):
    """A matrix that grows from ``base`` by zero lines, units and copies, lines dealt anew."""
    rows, cols = {}, {}
    for (r, c), v in base.items():
        rows.setdefault(r, {})[c] = v
        cols.setdefault(c, {})[r] = v
    for x in {r for r, _ in base}:
        rows.setdefault(x, {})
    for k in range(lines):
        mine, other = (rows, cols) if rng.random() < 0.5 else (cols, rows)
        x, kind = 10**6 + k, rng.random()
        line = {}
        if kind < 0.6 and other:
            line = {rng.choice(list(other)): rng.choice((-1, 1) if ternary else (1,))}
        elif kind < 0.95 and mine:
            s = rng.choice((-1, 1)) if ternary else 1
            like = mine[rng.choice(list(mine))]
            line = {y: s * v for y, v in like.items()} if len(like) < 40 else {}
        mine[x] = line
        for y, v in line.items():
            other[y][x] = v
    at = lambda lines: dict(zip(rng.sample(sorted(lines), len(lines)), range(len(lines))))
    p, q = at(rows), at(cols)
    return len(p), len(q), {(p[r], q[c]): v for r, line in rows.items() for c, v in line.items()}


def test_large_matrices_are_reduced(spark):
    rng = random.Random(3)
    wheel = {(i, j): 1 for i in range(40) for j in (i, (i + 1) % 40)}
    matrices = {0: grown(rng, 3000, {}), 1: grown(rng, 3000, wheel)}
    core = check_reductions(spark, matrices)
    assert 0 not in core and len(core[1]) == 80


def test_known_reductions(spark):
    ms = from_dense(spark, {1: X.SP_TERNARY, 2: X.SP_NOT})
    got = {r.mid: r for r in series.series_parallel(ms).collect()}
    assert len(got[1].reductions) == 20 and got[1].is_sp == (not structure.sp_reductions(X.SP_TERNARY)[1])
    _, rows, cols = structure.sp_reductions(X.SP_NOT)
    assert (len(got[2].rows), len(got[2].cols)) == (len(rows), len(cols)) and not got[2].is_sp
    assert not structure.sp_reductions(to_dense_sub(to_dense(ms)[2], got[2].rows, got[2].cols))[0]


def to_dense_sub(a, rows, cols):
    return [[a[i][j] for j in cols] for i in rows]


def test_collisions_cost_rounds_only(spark, monkeypatch):
    real, seeds = series._hash, []

    def weak(value, seed):
        seeds.append(seed)
        return real(value, seed) * 0 if seed < 2 else real(value, seed)

    monkeypatch.setattr(series, "_hash", weak)
    wheel = {(i, j): 1 for i in range(6) for j in (i, (i + 1) % 6)}
    copied = wheel | {(6, j): -wheel[0, j] for j in (0, 1)}
    core = check_reductions(spark, {1: (6, 6, wheel), 2: (7, 6, copied)})
    assert len(core[1]) == len(core[2]) == 12 and max(seeds) >= 2


def holes(cells):
    """Chordless cycles of a small matrix, as sets of rows and columns with two nonzeros each."""
    near, found = neighbours(cells), set()

    def walk(path):
        for y in near[path[-1]]:
            inner = [x for x in path[:-1] if y in near[x]]
            if y in path:
                continue
            if not inner:
                walk([*path, y])
            elif inner == [path[0]] and len(path) >= 3:
                found.add(frozenset([*path, y]))

    for start in near:
        walk([start])
    return found


def hole_sum(cells, lines):
    return sum(v for (r, c), v in cells.items() if -1 - r in lines and 1 + c in lines)


def test_camion(spark):
    rng = random.Random(4)
    matrices = {}
    for k in range(150):
        m, n = rng.randrange(1, 7), rng.randrange(1, 7)
        e = sparse(rng, m, n, rng.randrange(1, 22))
        matrices[k] = (m, n, e)
        a = structure.camion(dense(m, n, e))[0]
        matrices[1000 + k] = (m, n, {(i, j): v for i, r in enumerate(a) for j, v in enumerate(r) if v})
    matrices[3000] = (2, 2, {(0, 0): 1, (1, 1): 2})
    ms = frame(spark, matrices)
    got = {r.mid: r for r in camion.camion_test(ms).collect()}
    signed = to_dense(camion.camion_signed(ms.where("mid < 3000")))
    again = {r.mid: r.is_camion for r in camion.camion_test(camion.camion_signed(ms.where("mid < 3000"))).collect()}
    assert len(again) == 300 and all(again.values()) and got[3000].rows == [1] and got[3000].cols == [1]
    balanceable = 0
    for k, (m, n, e) in matrices.items():
        if k == 3000:
            continue
        bad = {h for h in holes(e) if hole_sum(e, h) % 4}
        if got[k].is_camion:
            assert got[k].rows is None
        else:
            assert frozenset([-1 - i for i in got[k].rows] + [1 + j for j in got[k].cols]) in bad
        now = {(i, j): v for i, r in enumerate(signed[k]) for j, v in enumerate(r) if v}
        assert {x: abs(v) for x, v in now.items()} == {x: abs(v) for x, v in e.items()}
        if not [h for h in holes(now) if hole_sum(now, h) % 4]:
            balanceable += 1
            assert got[k].is_camion == (not bad)
            assert not structure.camion(dense(m, n, now))[1]
        else:
            assert structure.camion(structure.camion(dense(m, n, e))[0])[1] is None and any(hole_sum(x, h) % 4 for x in [{(i, j): v for i, r in enumerate(structure.camion(dense(m, n, e))[0]) for j, v in enumerate(r) if v}] for h in holes(x))
    assert 50 < balanceable < 300


def test_camion_of_large_matrices(spark):
    """Network matrices of 1,100 lines have Camion's signs; of the same with one sign changed a
    chordless cycle is told, and signing gives the matrix back up to scaling."""
    one = generators.networks(spark, 1, 500, 600).entries.select("r", "c", "v")
    r, c = one.orderBy("r", "c").select("r", "c").collect()[3000]
    both = [one.select(F.lit(k).cast("long").alias("mid"), "r", "c", F.when((F.col("r") == r) & (F.col("c") == c) & F.lit(k == 2), -F.col("v")).otherwise(F.col("v")).cast("int").alias("v")) for k in (1, 2)]
    ms = Matrices(spark.createDataFrame([(1, 499, 600), (2, 499, 600)], "mid long, m int, n int"), both[0].unionByName(both[1]))
    got = {x.mid: x for x in camion.camion_test(ms).collect()}
    assert got[1].is_camion and not got[2].is_camion
    cells = {(x.r, x.c): x.v for x in both[1].collect()}
    near = neighbours(cells)
    lines = {-1 - i for i in got[2].rows} | {1 + j for j in got[2].cols}
    assert all(sum(y in lines for y in near[x]) == 2 for x in lines) and hole_sum(cells, lines) % 4
    signed = camion.camion_signed(ms.where("mid = 2"))
    assert camion.camion_test(signed).first().is_camion
    values = lambda e: {(x.r, x.c): x.v for x in e.collect()}
    assert X.same_up_to_scaling(values(signed.entries), values(both[0]))


def check_echelon(spark, matrices):
    ms = frame(spark, matrices)
    found = elimination.echelon(ms)
    form, steps = {}, {}
    for r in found.form().collect():
        form.setdefault(r.mid, {})[r.r, r.c] = int(r.v)
    for r in sorted(found.pivots.collect(), key=lambda r: (r.k, r.r)):
        steps.setdefault(r.mid, []).append((r.r, r.c, int(r.v)))
    product = {}
    for r in elimination.transformed(ms, found).collect():
        product.setdefault(r.mid, {})[r.r, r.c] = int(r.v)
    assert product == form
    for k in matrices:
        u, p = form.get(k, {}), steps.get(k, [])
        assert {r for r, _ in u} <= {r for r, _, _ in p} and len({c for _, c, _ in p}) == len(p)
        for i, (r, c, v) in enumerate(p):
            assert u[r, c] == v and all((later, c) not in u for later, _, _ in p[i + 1 :])
    # the transformations have determinant 1
    small = {k: (m, m) for k, (m, _, _) in matrices.items() if m <= 8}
    t = found.transformation().select("mid", "r", "c", "v").where(F.col("mid").isin(list(small)))
    dims = spark.createDataFrame([(k, m, m) for k, (m, _) in small.items()], "mid long, m int, n int")
    assert {r.det for r in elimination.determinants(Matrices(dims, t)).collect()} == {"1"}
    return {k: len(p) for k, p in steps.items()}


def test_elimination(spark):
    rng = random.Random(6)
    matrices, want = {0: (0, 0, {}), 1: (3, 3, {}), 2: (2, 3, {(0, 1): 4})}, {}
    for k in range(3, 90):
        m, n = (rng.randrange(1, 7), rng.randrange(1, 7)) if k % 2 else (rng.randrange(1, 7),) * 2
        matrices[k] = (m, n, {x: v for x, v in sparse(rng, m, n, rng.randrange(1, 40), range(-9, 10)).items() if v})
    ranks = check_echelon(spark, matrices)
    ms = frame(spark, matrices)
    det = {r.mid: (r.det, r.status) for r in elimination.determinants(ms).collect()}
    diagonal = {r.mid: (r.rank, r.product) for r in elimination.diagonals(ms).collect()}
    for k, (m, n, e) in matrices.items():
        a = dense(m, n, e)
        assert det[k] == ((str(exact.determinant(a)), "OK") if m == n else (None, "INPUT")), k
        rank = len(exact.upper_diagonal(a))
        assert ranks.get(k, 0) == diagonal[k][0] == rank
        # the columns' order fixes the product
        assert diagonal[k][1] == str(abs(math.prod(exact.upper_diagonal(a))))


def test_elimination_of_large_and_of_long_numbers(spark):
    rng = random.Random(7)
    # 1,000 rows and columns in blocks that are scattered, so many steps go at once
    order_r, order_c = rng.sample(range(1000), 1000), rng.sample(range(1000), 1000)
    cells = {(order_r[4 * b + i], order_c[4 * b + j]): rng.choice((-2, -1, 1, 3)) for b in range(250) for i in range(4) for j in range(4) if rng.random() < 0.7}
    rank = sum(len(exact.upper_diagonal([[cells.get((order_r[4 * b + i], order_c[4 * b + j]), 0) for j in range(4)] for i in range(4)])) for b in range(250))
    assert check_echelon(spark, {1: (1000, 1000, cells), 2: (1, 1, {(0, 0): 7})}) == {1: rank, 2: 1}
    dims = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 1, 1)], "mid long, m int, n int")
    big = [(1, 0, 0, 10**25 + 1), (1, 0, 1, 10**25), (1, 1, 0, 3 * 10**24), (1, 1, 1, 7), (2, 0, 0, 10**20), (2, 1, 1, -(10**20)), (3, 0, 0, 10**30)]
    e = spark.createDataFrame([(k, r, c, str(v)) for k, r, c, v in big], "mid long, r int, c int, v string").withColumn("v", F.col("v").cast("decimal(38,0)"))
    got = {r.mid: (r.det, r.status) for r in elimination.determinants(Matrices(dims, e)).collect()}
    assert got == {1: (None, "OVERFLOW"), 2: (None, "OVERFLOW"), 3: (str(10**30), "OK")}


def test_balancedness(spark):
    rng = random.Random(11)
    matrices = {0: (0, 3, {}), 1: (3, 3, {(0, 0): 1, (1, 2): 2, (1, 1): -3}), 2: (2, 2, {})}
    for k in range(3, 90):
        m, n = rng.randrange(1, 8), rng.randrange(1, 8)
        matrices[k] = (m, n, sparse(rng, m, n, rng.randrange(1, m * n + 1)))
    for k in range(90, 130):  # long holes, some with chords and lines beside them
        size = rng.randrange(3, 7)
        rows, cols = rng.sample(range(8), size), rng.sample(range(8), size)
        e = {(rows[i], cols[j % size]): rng.choice((-1, 1)) for i in range(size) for j in (i, i + 1)}
        matrices[k] = (8, 8, sparse(rng, 8, 8, rng.randrange(0, 4)) | e)
    got, orders = {r.mid: r for r in balance.balanced_test(frame(spark, matrices)).collect()}, set()
    assert set(got) == set(matrices)
    for k, (m, n, e) in matrices.items():
        a = dense(m, n, e)
        want, r = structure.unbalanced(a) if m and n else None, got[k]
        assert r.is_balanced == (want is None) == (r.rows is None), k
        if want:
            assert len(r.rows) == len(r.cols) == len(want[0]), k
            s = [[a[i][j] for j in r.cols] for i in r.rows]
            assert k == 1 or (all(sum(v != 0 for v in x) == 2 for x in (*s, *zip(*s))) and sum(map(sum, s)) % 4), k
            orders.add(len(r.rows))
    assert (got[1].rows, got[1].cols) == ([1], [1]) and orders >= {1, 2, 3, 4, 5, 6}


def test_balancedness_of_large_matrices(spark):
    # 250 scattered blocks that are totally unimodular, and one hole of five rows with another sum
    rng = random.Random(12)
    rows, cols = rng.sample(range(1100), 1100), rng.sample(range(1100), 1100)
    good = {}
    for b in range(250):
        for i in range(4):  # intervals: a column of ones in rows that follow each other
            low, high = sorted((rng.randrange(4), rng.randrange(4)))
            good |= {(rows[4 * b + x], cols[4 * b + i]): 1 for x in range(low, high + 1)}
    hole = {(rows[1000 + i], cols[1000 + (i + d) % 5]): 1 for i in range(5) for d in (0, 1)}
    got = {r.mid: r for r in balance.balanced_test(frame(spark, {1: (1100, 1100, good), 2: (1100, 1100, good | hole)})).collect()}
    assert got[1].is_balanced and not got[2].is_balanced
    assert got[2].rows == sorted(rows[1000:1005]) and got[2].cols == sorted(cols[1000:1005])


def settled(tree, node):
    """A node's attributes by recursion; ``tree``: ``{node: (parent, place, kind, known)}``."""
    _, _, kind, known = tree[node]
    below = [(tree[k][1], settled(tree, k)) for k in tree if tree[k][0] == node]
    least = [min((x[i] for _, x in below), default=0) for i in range(3)]
    places = max((p + 1 for p, _ in below), default=0)
    if below and len(below) < (max(2, places) if kind in ("TWOSUM", "DELTASUM", "YSUM", "THREESUM") else places):
        least = [min(x, 0) for x in least]
    fixed = {"IRREGULAR": (-1, -1, -1), "PLANAR": (1, 1, 1), "GRAPH": (1, 1, None), "COGRAPH": (1, None, 1), "R10": (1, -1, -1), "UNKNOWN": (0, None, None)}
    takes = {"DELTASUM": "110", "YSUM": "101", "THREESUM": "100"}.get(kind, "111")
    if kind in fixed:
        return [k if f is None else f for f, k in zip(fixed[kind], known)]
    if kind == "SERIES_PARALLEL" and not below:
        return [k or 1 for k in known]
    return [k or (x if t == "1" else 0) for k, x, t in zip(known, least, takes)]


def test_attributes_of_trees(spark):
    rng, kinds = random.Random(13), ["ONESUM", "TWOSUM", "SERIES_PARALLEL", "PIVOTS", "DELTASUM", "YSUM", "THREESUM"]
    rows, want = [], {}
    for mid in range(40):
        tree, size = {}, rng.randrange(1, 25)
        parents = [None] + [k - 1 if mid == 0 else rng.randrange(k) for k in range(1, size)]
        for k, p in enumerate(parents):
            leaf = k not in parents
            place = sum(q == p for q in parents[:k]) + (rng.random() < 0.1)
            kind = rng.choice(["PLANAR", "PLANAR", "GRAPH", "COGRAPH", "R10", "IRREGULAR", "UNKNOWN", "SERIES_PARALLEL"] if leaf else kinds)
            tree[k] = (p, place, kind, [rng.choice((0, 0, 0, 0, 1, -1)) for _ in range(3)])
        rows += [(mid, k, p, place, kind, *(x or None for x in known)) for k, (p, place, kind, known) in tree.items()]
        want |= {(mid, k): settled(tree, k) for k in tree}
    schema = "mid long, node int, parent int, place int, kind string, regularity int, graphicness int, cographicness int"
    got = {(r.mid, r.node): [r.regularity, r.graphicness, r.cographicness] for r in trees.attributes(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and {x for v in got.values() for x in v} == {-1, 0, 1}
    assert trees.attributes(spark.createDataFrame([], schema)).collect() == []


def test_rounds_join_by_matrix_without_broadcasts(spark):
    """A broadcast holds far more in the driver than the file's size tells; one deal by matrix does for all joins."""
    cells, _ = storage.written(spark.range(400).selectExpr("id % 10 AS mid", "cast(id % 7 AS int) AS r", "cast(id % 11 AS int) AS c", "1 AS v"), "test-cells")

    @storage.by_shuffles
    def plan():
        return series._round(storage.dealing(cells)(cells), True, 0)._jdf.queryExecution().executedPlan().toString()

    said = plan()
    assert "Broadcast" not in said and said.count("Exchange hashpartitioning(") == said.count("Exchange hashpartitioning(mid#") > 0
    assert re.findall(r"hashpartitioning\(mid#\d+L, (?!\d)", said) == []
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
