import pytest

from matrixloom.functions import structure
from matrixloom.model import Matrices, from_dense, problems, to_dense
from matrixloom.operators import algebra, blocks, camion, kary, multigraphs, pivots, recognition, series, sums
from matrixloom.sources import text
from pyspark.sql import functions as F
from tests import fixtures as X


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pivots_reproduce_known_results(spark):
    one = at(spark, [(1, 0, 0)], "mid long, p int, q int")
    assert to_dense(pivots.pivot(from_dense(spark, {1: X.PIVOT_2}), one, 2))[1] == X.PIVOTED_2
    assert to_dense(pivots.pivot(from_dense(spark, {1: X.PIVOT_3}), one, 3))[1] == X.PIVOTED_3
    both = from_dense(spark, {1: [[0, 1]], 2: [[1, 1]], 3: [[-1, 1], [1, 1]]})
    spots = at(spark, [(1, 0, 0), (3, 0, 0)], "mid long, p int, q int")
    out = to_dense(pivots.pivot(both, spots))
    assert out == {2: [[1, 1]], 3: [[1, -1], [-1, 2]]}
    assert [r.mid for r in pivots.zero_pivots(both, spots).collect()] == [1]
    assert [tuple(r) for r in pivots.outside_units(pivots.pivot(both, spots)).collect()] == [(3, 1, 1)]


def test_sums(spark):
    first, second = from_dense(spark, {7: X.TWO_FIRST}), from_dense(spark, {7: X.TWO_SECOND})
    got = to_dense(sums.two_sum(first, second, at(spark, [(7, 1, 2)], "mid long, row int, col int")))
    assert got[7] == X.TWO_BY_ROW
    parts = from_dense(spark, {1: [[1, 2]], 2: "2 0", 3: [[3]]})
    order = at(spark, [(9, 0, 3), (9, 1, 2), (9, 2, 1)], "sid long, place int, mid long")
    assert to_dense(sums.one_sum(parts, order))[9] == [[3, 0, 0], [0, 0, 0], [0, 0, 0], [0, 1, 2]]


def test_algebra(spark):
    a = from_dense(spark, {1: [[1, 0, 2], [0, 3, 0]], 2: "0 3", 3: "2 0"})
    assert to_dense(algebra.transpose(a))[1] == [[1, 0], [0, 3], [2, 0]]
    same = {r.mid: r.equal for r in algebra.equal(a, from_dense(spark, {1: [[1, 0, 2], [0, 3, 0]], 2: "0 2", 4: [[1]]})).collect()}
    assert same == {1: True, 2: False, 3: False, 4: False}
    order = algebra.random_order(a)
    assert sorted((r.mid, r.axis, r.new) for r in order.collect()) == [(1, "c", 0), (1, "c", 1), (1, "c", 2), (1, "r", 0), (1, "r", 1), (2, "c", 0), (2, "c", 1), (2, "c", 2), (3, "r", 0), (3, "r", 1)]
    x = to_dense(algebra.permute(a, order))[1]
    assert sorted(sorted(r) for r in x) == [[0, 0, 3], [0, 1, 2]]
    s = spark.range(1).select(algebra.sub(F.array(F.lit(1)), F.array(F.lit(5))).alias("i"), algebra.sub(F.array(F.lit(2)), F.array(F.lit(5))).alias("b"))
    assert s.select(algebra.sub_slice("b", "i").alias("x")).first().x is None
    assert s.select(algebra.sub_transpose("i").alias("x")).first().x.rows == [5]


def test_conversion(spark):
    d = from_dense(spark, {1: [[0.9999999999, 2.5, -0.2]]}, "double")
    assert to_dense(d.cast("int"))[1] == [[1, 3, 0]]
    with pytest.raises(Exception, match="OVERFLOW"):
        from_dense(spark, {1: [[300.0]]}, "double").cast("tinyint").entries.collect()


def test_problems(spark):
    good = from_dense(spark, {1: [[1]]})
    bad = Matrices(good.dims, at(spark, [(1, 0, 0, 1), (1, 0, 0, 2), (1, 5, 0, 0), (8, 0, 0, 1)], "mid long, r int, c int, v int"))
    assert sorted((r.mid, r.problem) for r in problems(bad).collect()) == [(1, "duplicate entry"), (1, "row out of range"), (1, "stored zero"), (8, "matrix not listed")]


def test_entries(spark):
    ms = from_dense(spark, {1: [[1, 2, 1], [0, 5, 7], [1, 0, 9]], 2: "0 0"})
    assert {r.mid: (r.is_binary, r.bad_r, r.bad_c) for r in kary.is_binary(ms).collect()} == {1: (False, 0, 1), 2: (True, None, None)}
    # of a row and a column with as many bad entries the row goes, so here all rows do
    assert {r.mid: (r.rows, r.cols) for r in kary.large_submatrix(ms).collect()} == {1: ([], [0, 1, 2]), 2: ([], [])}
    assert {r.mid: (r.rows, r.cols) for r in kary.large_submatrix(from_dense(spark, {1: [[1, 7], [0, 7], [1, 7]]})).collect()} == {1: ([0, 1, 2], [0])}


def test_blocks_of_lines_are_the_blocks(spark):
    ms = from_dense(spark, {1: X.BLOCKS, 2: "2 1 0 0", 3: X.NETWORK})
    per_line = {(r.mid, r.element): r.block for r in blocks.block_of_lines(ms).collect()}
    for r in blocks.decompose_blocks(ms).collect():
        assert all(per_line[r.mid, -1 - i] == r.block for i in r.rows) and all(per_line[r.mid, 1 + j] == r.block for j in r.cols)
    assert len(per_line) == 20 + 3 + 13


def test_recognition(spark):
    ms = from_dense(spark, {1: X.FANO, 2: X.K33, 3: X.NETWORK, 4: "0 2", 5: [[2]], 6: X.CTU_NO})
    want = {1: False, 2: True, 3: True, 4: True, 5: False}
    for found in (recognition.tu_by_masks(ms), recognition.tu_test(ms), recognition.tu_test(ms, "eulerian"), recognition.tu_test(ms, "partition")):
        assert want.items() <= {r.mid: r.is_tu for r in found.collect()}.items()
    assert {r.mid: (r.row, r.col) for r in recognition.ctu_test(ms.where("mid = 6")).collect()} == {6: (0, 0)}
    comp = recognition.complements(ms.where("mid = 6"), at(spark, [(6, 2, None)], "mid long, i int, j int"))
    from matrixloom.functions.recognise import complement

    assert to_dense(comp)[6] == complement(X.CTU_NO, 2, None)
    signed = to_dense(camion.camion_signed(from_dense(spark, {1: X.CAMION})))
    cells = lambda a: {(i, j): v for i, r in enumerate(a) for j, v in enumerate(r) if v}
    assert X.same_up_to_scaling(cells(signed[1]), cells(X.CAMION_SIGNED)) and structure.is_camion_signed(signed[1])
    assert {r.k for r in recognition.equimodular_test(from_dense(spark, {1: X.EQUIMODULAR[2][0]})).collect()} == {"2"}


def test_texts(spark, tmp_path):
    ms = from_dense(spark, {0: [[1, 0, -2], [0, 0, 3]], 1: "0 4", 2: "1 0"})
    for said, read in ((text.dense_text(ms), text.read_dense), (text.sparse_text(ms), text.read_sparse)):
        back, status = read(said)
        assert to_dense(back) == to_dense(ms) and {r.status for r in status.collect()} == {"OK"}
    assert {r.mid: r.value for r in text.sparse_text(ms).collect()}[0] == "2 3 3\n\n1 1 1\n1 3 -2\n2 3 3\n"
    bad = at(spark, [(0, "2 2 1\n3 1 5"), (1, "1 1 2\n1 1 4\n1 1 5"), (2, "1 1 1"), (3, "1 2 1 1 2 9")], "mid long, value string")
    back, status = text.read_sparse(bad)
    assert {r.mid: r.status for r in status.collect()} == {0: "INPUT", 1: "INPUT", 2: "INPUT", 3: "OK"} and to_dense(back) == {3: [[0, 9]]}
    assert {r.status for r in text.read_dense(at(spark, [(0, "2 2 1 1 1"), (1, "")], "mid long, value string"))[1].collect()} == {"INPUT"}
    text.write(text.dense_text(ms), str(tmp_path / "out"))
    files = text.whole_files(spark, str(tmp_path / "out") + "/mid=*/*")
    assert sorted(map(str, to_dense(text.read_dense(files)[0]).values())) == sorted(map(str, to_dense(ms).values()))
    subs = at(spark, [(0, 5, 6, [4, 0], [2])], "mid long, m int, n int, rows array<int>, cols array<int>")
    assert text.submatrix_text(subs).first().value == "5 6 2 1\n5 1\n3"
    assert text.read_submatrices(text.submatrix_text(subs)).first().rows == [4, 0]


def test_edge_lists(spark):
    said = at(spark, [(0, "a b r1\nb c -2\na c c1\nc x\n\nz z"), (1, "")], "mid long, value string")
    rows = text.read_edge_lists(said).orderBy("e").collect()
    assert [(r.u_node, r.w_node, r.element) for r in rows] == [(0, 1, -1), (1, 2, -2), (0, 2, 1), (2, 3, None)]
    found = recognition.realised_graphs(from_dense(spark, {5: [[1, 1], [0, 1]]}))
    again = text.read_edge_lists(text.edge_list_text(found))
    assert sorted(r.element for r in again.collect()) == [-2, -1, 1, 2]
    assert text.dot_text(found).first().value.count(" -- ") == 4
    ms = recognition.represented(found)
    assert to_dense(ms)[5] == [[1, 1], [0, 1]]


def test_multigraphs(spark):
    edges = at(spark, [(1, 0, 0, 1, -1), (1, 1, 1, 2, 1), (2, 0, 5, 5, 1)], "mid long, e int, u int, w int, element int")
    more = multigraphs.add_edges(edges, at(spark, [(1, 2, 0, 2), (3, 0, 1, 1)], "mid long, u int, w int, element int"))
    assert sorted((r.mid, r.e) for r in more.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert multigraphs.delete_edges(more, at(spark, [(1, 2), (3, 0)], "mid long, e int")).count() == 3
    assert [r.e for r in multigraphs.delete_nodes(edges, at(spark, [(1, 0), (2, 5)], "mid long, node int")).collect()] == [1]
    merged = multigraphs.merge_nodes(edges, at(spark, [(1, 0, 1)], "mid long, old int, new int"))
    assert sorted((r.u, r.w) for r in merged.collect()) == [(1, 1), (1, 2), (5, 5)]
    assert {(r.mid, r.node): r.degree for r in multigraphs.node_degrees(merged).collect()} == {(1, 1): 3, (1, 2): 1, (2, 5): 2}
    assert multigraphs.nodes_of(edges).count() == 4 and multigraphs.problems(edges).count() == 0
    assert multigraphs.problems(edges.unionByName(edges)).count() == 2


def test_words(spark):
    ms = from_dense(spark, {1: [[1, 0], [1, 0], [0, 0]]})
    assert text.reductions_text(series.series_parallel(ms)).first().value == "5\nr1: unit at c1\nr2: unit at c1\nr3: zero\nc1: zero\nc2: zero"
    said = text.complements_text(at(spark, [(1, 0, None), (2, 1, 2)], "mid long, row int, col int")).collect()
    assert [r.value for r in said] == ["complement row 1", "complement row 2\ncomplement column 3"]


def test_series_parallel_violators(spark):
    ms = from_dense(spark, {1: X.SP_NOT, 2: X.SP_TERNARY, 3: X.FANO})
    found = {r.mid: (r.rows, r.cols) for r in recognition.sp_violators(ms).collect()}
    assert set(found) == {1, 3}
    for mid, (rows, cols) in found.items():
        a = [[(X.SP_NOT if mid == 1 else X.FANO)[i][j] for j in cols] for i in rows]
        assert structure.sp_reductions(a) == ([], list(range(len(a))), list(range(len(a[0]))))


def test_components_and_cleaning(spark):
    import random

    from matrixloom import storage

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in storage.components(at(spark, edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert storage.components(at(spark, [], "a long, b long")).count() == 0
    assert storage.exists(spark, storage.own_dir(spark))
    storage.clean(spark)
    assert not storage.exists(spark, storage.own_dir(spark))


def test_matrices_of_graphs_without_a_group_for_each(spark):
    """Python gets many matrices' edges at once, and once only."""
    rows = [[1, 0, 1], [0, 1, 1]]
    edges = recognition.realised_graphs(from_dense(spark, {i: rows for i in range(50)}))
    found = recognition.represented(edges)
    plan = found.entries._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "InArrow" not in plan
    assert to_dense(found) == {i: rows for i in range(50)}


def test_forest_matrices_are_dealt_by_rows(spark, monkeypatch):
    from matrixloom import model
    from matrixloom.sources import generators

    monkeypatch.setattr(model, "PASS_ROWS", 4000)
    entries = generators.networks(spark, 200, 40, 60).entries
    sizes = [r["count"] for r in entries.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) > 40_000 and max(sizes) < 8000
