import random
from itertools import combinations

import pytest

from matrixloom.functions import exact, graphs, recognise, separations, structure, sums, tu
from tests import fixtures as X


def sub(a, rows, cols):
    return [[a[i][j] for j in cols] for i in rows]


def by_determinants(a):
    """Total unimodularity by definition."""
    m, n = len(a), len(a[0])
    return all(abs(exact.determinant(sub(a, r, c))) <= 1 for k in range(1, min(m, n) + 1) for r in combinations(range(m), k) for c in combinations(range(n), k))


def ternary(rng, m, n, p):
    return [[rng.choice([1, -1]) if rng.random() < p else 0 for _ in range(n)] for _ in range(m)]


def test_camion():
    assert structure.camion(X.CAMION)[0] == X.CAMION_SIGNED
    assert sub(X.CAMION, *structure.camion(X.CAMION)[1]) == X.CAMION_VIOLATOR
    assert structure.camion(X.CAMION_4)[0] == X.CAMION_4_SIGNED and structure.camion(X.CAMION_4_SIGNED)[1] is None


def test_blocks():
    found = structure.blocks(X.BLOCKS)
    assert len(found) == 6 and found[0] == ([0, 5, 6], [1, 3, 8])
    assert structure.blocks([]) == [] and structure.blocks([[], []]) == [([0], []), ([1], [])]


def test_total_unimodularity_algorithms_agree():
    rng = random.Random(4)
    for _ in range(250):
        a = ternary(rng, rng.randrange(1, 5), rng.randrange(1, 6), rng.random())
        if rng.random() < 0.6:
            a = structure.camion(a)[0]
        want = by_determinants(a)
        assert tu.by_partition(a) == want == tu.by_eulerian(a) == recognise.is_tu(a)
        if not want:
            for bad in (recognise.tu_violator(a), tu.eulerian_violator(a)):
                assert abs(exact.determinant(sub(a, *bad))) == 2
    assert not recognise.is_tu([[2]]) and recognise.is_tu([])


def test_named_and_regular():
    assert recognise.is_tu(X.K33) and recognise.is_tu(exact.transposed(X.K33)) and recognise.is_tu(recognise.named("R_12"))
    assert recognise.is_regular(X.FANO) is False and recognise.is_regular(exact.transposed(X.FANO)) is False
    for name, kind in (("R_10.1", 1), ("R_10.2", 2)):
        a = recognise.named(name)
        assert recognise.r10_kind(a) == kind and recognise.decompose(a).kind == "R10" and recognise.is_tu(a)
    assert recognise.identity_order(recognise.named("I_4")) == 4 and recognise.identity_order(X.FANO) is None
    for n in range(3, 12):
        assert abs(exact.determinant(recognise.named(f"W_{n}"))) == 2 * (n % 2)
    with pytest.raises(ValueError):
        recognise.named("Q")


def test_complement_and_ctu():
    assert recognise.ctu_violator(X.CTU_YES) is None and recognise.ctu_violator(X.CTU_NO) == (0, 0)
    for i in range(5):
        for j in range(5):
            both = recognise.complement(recognise.complement(X.CTU_NO, i, None), None, j)
            assert recognise.complement(X.CTU_NO, i, j) == both


def test_equimodular():
    for a, k in X.EQUIMODULAR:
        assert recognise.equimodular(a) == k
    rng = random.Random(8)
    for _ in range(60):  # by definition: all nonsingular minors of full row rank have one absolute value
        a = ternary(rng, 3, 5, 0.6)
        if len(exact.independent(a)[0]) == 3:
            dets = {abs(exact.determinant(sub(a, range(3), c))) for c in combinations(range(5), 3)} - {0}
            assert recognise.equimodular(a) == (dets.pop() if len(dets) == 1 else 0)


def test_balanced():
    for a, want in X.BALANCED:
        assert structure.is_balanced(a) == want
    rng = random.Random(3)
    for _ in range(200):
        a = ternary(rng, 4, 5, 0.5)
        bad = structure.unbalanced(a)
        assert (bad is None) == structure.is_balanced(a)
        if bad:
            s = sub(a, *bad)
            assert all(sum(v != 0 for v in x) == 2 for x in (*s, *zip(*s))) and sum(map(sum, s)) % 4


def test_series_parallel():
    assert len(structure.sp_reductions(X.SP_TERNARY)[0]) == 20
    steps, r, c = structure.sp_reductions(X.SP_NOT)
    assert len(steps) == 10 and len(r) == len(c) == 5
    left = sub(X.SP_NOT, r, c)
    assert abs(exact.determinant(sub(left, *structure.minor_of_two(left)))) == 2


def test_graphs_are_found_again():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randrange(2, 10)
        tree = {i: (rng.randrange(i + 1), i + 1)[:: rng.choice([1, -1])] for i in range(n - 1)}
        others = {j: tuple(rng.choices(range(n), k=2)) for j in range(rng.randrange(1, 12))}
        order = rng.sample(range(n - 1), n - 1)
        for signed in (False, True):
            a = [graphs.represented(tree, others, signed)[i] for i in order]
            found = graphs.network(a) if signed else graphs.realise(a)
            assert found and graphs.represented(*found, signed) == a
    assert graphs.represented({0: (0, 1), 1: (0, 1)}, {}) is None


def test_graphic_verdicts():
    assert not graphs.is_graphic(X.NOT_GRAPHIC) and not graphs.is_graphic(X.FANO) and not graphs.is_cographic(X.FANO)
    assert graphs.is_network(X.NETWORK) and not graphs.is_network(X.NOT_NETWORK)
    k5 = [[abs(v) for v in r] for r in recognise.named("K_5")]
    k33 = recognise.named("K_33")
    for a in (k5, k33):
        assert graphs.is_graphic(a) != graphs.is_cographic(a)
    rng = random.Random(6)
    for _ in range(150):  # what is graphic has a totally unimodular signing
        a = [[int(rng.random() < 0.5) for _ in range(5)] for _ in range(4)]
        if graphs.is_graphic(a):
            assert tu.by_partition(structure.camion(a)[0])
    kept = graphs.greedy_graphic_columns(X.NOT_GRAPHIC)
    assert len(kept) < 10 and graphs.is_graphic(sub(X.NOT_GRAPHIC, range(5), kept))


def test_sums():
    assert sums.two_sum(X.TWO_FIRST, X.TWO_SECOND, 1, 2, row=True) == X.TWO_BY_ROW
    rebuilt = sums.two_sum(X.TWO_FIRST, X.TWO_SECOND, 4, 0, row=False)
    assert rebuilt == X.TWO_BY_COLUMN
    for first, second in X.DELTA:
        assert sums.delta_sum(first, second, 2, (2, 3), 0, (0, 1)) == X.DELTA_SUM
        turned = sums.y_sum(exact.transposed(first), exact.transposed(second), 2, (2, 3), 0, (0, 1))
        assert exact.transposed(turned) == X.DELTA_SUM
    for first, second, want in X.THREE:
        assert sums.three_sum(first, second, (2, 3), (2, 3, 4), (0, 1, 2), (0, 1)) == want
    with pytest.raises(ValueError, match="STRUCTURE"):
        sums.three_sum(*X.THREE_BAD, (2, 3), (2, 3, 4), (0, 1, 2), (0, 1))
    one, two, row = sums.two_sum_parts(X.TWO_BY_ROW, [0, 1, 2, 3], [0, 1, 2, 3, 4])
    assert row and sums.two_sum(one, two, len(one) - 1, 0, row) == X.TWO_BY_ROW
    one, two, row = sums.two_sum_parts(X.TWO_BY_COLUMN, [0, 1, 2, 3, 4], [0, 1, 2, 3])
    assert not row and sums.two_sum(one, two, len(one[0]) - 1, 0, row) == X.TWO_BY_COLUMN
    assert sums.one_sum([[[1, 2]], [[3]], [[], []]]) == [[1, 2, 0], [0, 0, 3], [0, 0, 0], [0, 0, 0]]
    assert sums.path_sum(X.CAMION_4, [0, 1, 2, 3], [0, 1, 2, 3], [-1], [4]) == (3, -1, 4)


def test_determinants():
    rng = random.Random(7)
    for n in range(0, 6):
        a = [[rng.randrange(-9, 10) for _ in range(n)] for _ in range(n)]
        product = 1
        for d in exact.upper_diagonal(a):
            product *= d
        full = len(exact.upper_diagonal(a)) == n
        assert abs(exact.determinant(a)) == (abs(product) if full else 0)


def test_sums_are_taken_apart():
    first, second = separations.delta_parts(X.DELTA_SUM, [0, 1], [0, 1])
    assert (first, second) == X.DELTA[0]
    m = exact.transposed(X.DELTA_SUM)
    first, second = separations.y_parts(m, [0, 1], [0, 1])
    assert sums.y_sum(first, second, 2, (2, 3), 0, (0, 1)) == m
    for _, _, whole in X.THREE:
        assert sums.three_sum(*separations.three_parts(whole, [0, 1], [0, 1, 2, 3])) == whole
    with pytest.raises(ValueError, match="INPUT"):
        separations.delta_parts([[1, 0], [0, 1]], [0], [0])


def test_trees_of_3_connected_matrices():
    root = recognise.decompose(recognise.named("R_12"))
    assert root.kind == "THREESUM" and {c.kind for c in root.children} == {"GRAPH", "COGRAPH"}
    rng, kinds = random.Random(5), set()
    for _ in range(60):
        a = recognise.named("R_12")
        for _ in range(rng.randrange(4)):
            i, j = rng.choice([(i, j) for i in range(6) for j in range(6) if a[i][j]])
            p = a[i][j]
            a = [[-p if (r, c) == (i, j) else p * a[r][c] if r == i or c == j else a[r][c] - p * a[r][j] * a[i][c] for c in range(6)] for r in range(6)]
        if rng.random() < 0.4:
            a[rng.randrange(6)][rng.randrange(6)] = rng.choice([-1, 0, 1])
        kinds |= {x[3] for x in recognise.table(recognise.decompose(a))}
        assert recognise.is_tu(a) == tu.by_partition(a)
    assert {"DELTASUM", "THREESUM", "IRREGULAR"} <= kinds


def test_what_cannot_be_told_is_not_taken_for_no(monkeypatch):
    told = recognise.is_tu
    monkeypatch.setattr(recognise, "is_tu", lambda a: told(a) if len(a) <= 2 else None)
    unit = [[int(i == j) for j in range(4)] for i in range(4)]
    assert recognise.equimodular(unit) is None and recognise.strongly_equimodular(unit) is None
    assert recognise.equimodular([[1, 0], [0, 1]]) == 1
    assert recognise.ctu(X.CTU_YES) == (None, None) and recognise.tu_violator(unit) is None
    monkeypatch.setattr(recognise, "is_tu", lambda a: told(a) if len(a) != 3 else None)
    bad = [[1, 1, 0, 0], [1, -1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    assert recognise.tu_violator(bad) in (None, ([0, 1], [0, 1]))


# --- separations and decompositions of larger matrices ---------------------------------


def all_bipartitions(a, rank, least):
    m, n = len(a), len(a[0])
    s, full = [sum(1 << j for j, v in enumerate(r) if v) for r in a], (1 << n) - 1
    for part in (p for k in range(least, (m + n) // 2 + 1) for p in combinations(range(m + n), k)):
        rows, cols = {x for x in part if x < m}, sum(1 << (x - m) for x in part if x >= m)
        if exact.rank_mod2([s[i] & ~cols & full for i in rows]) + exact.rank_mod2([s[i] & cols for i in range(m) if i not in rows]) <= rank:
            return True
    return False


def test_separations_against_all_bipartitions():
    rng = random.Random(11)
    for _ in range(120):
        m, n = rng.randrange(2, 6), rng.randrange(2, 6)
        a = [[int(rng.random() < 0.5) for _ in range(n)] for _ in range(m)]
        for rank, least in ((1, 2), (2, 4)):
            assert (recognise.separation(a, rank, least) is not None) == all_bipartitions(a, rank, least), (a, rank)


def sum_of_graph_and_cograph(rng, nodes, extra):
    """The delta-sum of a graphic matrix along a triangle and a cographic one along a node of
    degree three, with Camion's signs, some pivots and lines in any order."""
    tree = {i: (rng.randrange(i + 1), i + 1) for i in range(nodes - 1)}
    w = rng.randrange(nodes)
    tree[nodes - 1] = (w, nodes)
    u = rng.choice([z for z in range(nodes) if z != w])
    others = {j: tuple(rng.sample(range(nodes + 1), 2)) for j in range(extra)} | {extra: (u, w), extra + 1: (u, nodes)}
    one = graphs.represented(tree, others)
    tree = {i: (rng.randrange(i + 1), i + 1) for i in range(nodes - 1)}
    k = rng.randrange(nodes - 1)
    split = {0: (tree[k][0], nodes), 1: (nodes, tree[k][1])} | {i + 2: e for i, e in enumerate(e for x, e in tree.items() if x != k)}
    others = {0: (nodes, rng.randrange(nodes))} | {1 + j: tuple(rng.sample(range(nodes), 2)) for j in range(extra)}
    two = [list(c) for c in zip(*graphs.represented(split, others))]
    if not two[0][0]:
        two = [[r[1], r[0], *r[2:]] for r in two]
    a = structure.camion(sums.delta_sum(one, two, nodes - 1, (extra, extra + 1), 0, (0, 1), 2))[0]
    for _ in range(2):
        p, q = rng.choice([(i, j) for i, r in enumerate(a) for j, v in enumerate(r) if v])
        x = a[p][q]
        a = [[-x if (i, j) == (p, q) else x * v if i == p or j == q else (v - x * a[i][q] * a[p][j] + 1) % 3 - 1 for j, v in enumerate(r)] for i, r in enumerate(a)]
    for _ in range(2):
        rng.shuffle(a)
        a = [list(c) for c in zip(*a)]
    return a


def test_sums_of_many_lines_are_decided():
    rng, kinds = random.Random(5), set()
    for nodes, extra in ((6, 8), (8, 12), (12, 20)):
        for _ in range(4):
            a = sum_of_graph_and_cograph(rng, nodes, extra)
            kinds |= {x[3] for x in recognise.table(recognise.decompose(a))}
            assert recognise.is_tu(a) is True and recognise.is_regular([[abs(v) for v in r] for r in a]) is True
            i, j = next((i, j) for i, r in enumerate(a) for j, v in enumerate(r) if not v)
            b = [list(r) for r in a]
            b[i][j] = 1
            if min(len(b), len(b[0])) <= 13:
                assert recognise.is_tu(b) == tu.by_partition(b)
    assert {"GRAPH", "COGRAPH"} <= kinds and kinds & {"DELTASUM", "THREESUM"}
    assert [recognise.is_regular([[int(rng.random() < p) for _ in range(20)] for _ in range(18)]) for p in (0.5, 0.2)] == [False, False]


def test_partial_decompositions_are_completed():
    rng = random.Random(9)
    for _ in range(6):
        a = sum_of_graph_and_cograph(rng, 8, 12)
        whole = recognise.table(recognise.decompose(a))
        for levels in (0, 1, 2, 3):
            part = recognise.decompose(a, levels=levels)
            assert recognise.table(recognise.completed(part)) == whole
            some = recognise.completed(part, number=1)
            assert recognise.table(recognise.completed(some)) == whole
    assert not recognise.is_r12(recognise.named("R_10.1")) and recognise.is_r12(recognise.named("R_12"))
    turned = [r[::-1] for r in recognise.named("R_12")[::-1]]
    assert recognise.is_r12(turned) and not recognise.is_r12([[abs(v) for v in r] for r in turned])
