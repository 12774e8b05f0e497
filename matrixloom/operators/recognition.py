"""Recognition of matrix classes over collections of matrices.

Small matrices of one collection are independent, so every test runs per matrix in
Arrow batches; tests that a sum over masks can state (Ghouila-Houri) run inside
the JVM on bit masks, one row per matrix.
"""

from __future__ import annotations

from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import graphs, recognise, structure, tu
from ..model import Matrices, batch_of, dealer, per_matrix, work_tasks
from ..storage import counted, written

SUB = "rows array<int>, cols array<int>"
MASK_ROWS = 10


def _sub(found) -> tuple:
    return found if found else (None, None)


# --- total unimodularity ------------------------------------------------------


#: Ghouila-Houri's test on the columns' masks ``{cols}`` of rows with 1 (``p``) and with -1
#: (``q``): each set of rows has a part such that every column's sums over the part and over
#: the rest differ by at most one.
MASK_TEST = """forall(sequence(1L, shiftleft(1L, m) - 1), s -> exists(sequence(0L, shiftright(s, 1)), h ->
  (h & s) = h AND forall({cols}, x -> abs(
    bit_count(x.p & s & ~h) - bit_count(x.q & s & ~h) - bit_count(x.p & h) + bit_count(x.q & h)) <= 1)))"""


def _fits() -> list[int]:
    """For matrices of 0 and 1 with up to five rows: at 32 x + s, for a column of the ones x and a set s of
    rows, the parts of s (as bits) over which and over the rest of s its sums differ by at most one."""
    differ = lambda x, s, h: abs((x & s & ~h).bit_count() - (x & h).bit_count())
    return [sum(1 << h for h in range(32) if h & s == h and differ(x, s, h) <= 1) for x in range(32) for s in range(32)]


def _masked(ms: Matrices) -> DataFrame:
    """``mid, m, n, cols, odd``: matrices of at most ``MASK_ROWS`` rows or columns in one row
    each, the smaller side for the rows; ``cols``: of each column with nonzeros its number
    and masks; ``odd``: whether an entry isn't -1, 0 or 1."""
    dims = ms.dims.where(F.least("m", "n") <= MASK_ROWS).withColumn("turned", F.col("m") > F.col("n"))
    e = ms.entries.join(dims.select("mid", "turned"), "mid")
    e = e.select("mid", "v", F.when(F.col("turned"), F.col("c")).otherwise(F.col("r")).alias("r"), F.when(F.col("turned"), F.col("r")).otherwise(F.col("c")).alias("c"))
    bit = F.expr("shiftleft(1L, CAST(r AS INT))")
    sums = [F.sum(F.when(F.col("v") == x, bit).otherwise(0)).alias(name) for x, name in ((1, "p"), (-1, "q"))]
    columns = e.groupBy("mid", "c").agg(*sums, F.max((~F.col("v").isin(-1, 0, 1)).cast("int")).alias("odd"))
    cols = columns.groupBy("mid").agg(F.collect_list(F.struct("c", "p", "q")).alias("cols"), (F.max("odd") == 1).alias("odd"))
    sides = dims.select("mid", F.least("m", "n").alias("m"), F.greatest("m", "n").alias("n"))
    return sides.join(cols, "mid", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))


def tu_by_masks(ms: Matrices) -> DataFrame:
    """``mid, is_tu``: Ghouila-Houri's test on bit masks (no Python in the tasks) of matrices
    with at most ``MASK_ROWS`` rows or columns; others by decomposition."""
    verdict = F.expr(MASK_TEST.format(cols="array_distinct(transform(cols, x -> named_struct('p', x.p, 'q', x.q)))"))
    told = _masked(ms).select("mid", F.when(F.col("odd"), False).when(F.col("cols").isNull() | (F.col("m") == 0), True).otherwise(verdict).alias("is_tu"))
    large = ms.where(F.least("m", "n") > MASK_ROWS)
    return told.unionByName(tu_test(large).select("mid", "is_tu"))


def tu_test(ms: Matrices, algorithm: str = "decomposition") -> DataFrame:
    """``mid, is_tu, rows, cols``: by ``decomposition``, ``eulerian`` (the violator has least
    order) or ``partition``; else the rows and columns of a violating submatrix."""

    def one(mid, a):
        if algorithm == "partition":
            return [(mid, tu.by_partition(a), None, None)]
        if algorithm == "eulerian":
            bad = tu.eulerian_violator(a)
            return [(mid, bad is None, *_sub(bad))]
        verdict = recognise.is_tu(a)
        return [(mid, verdict, *_sub(recognise.tu_violator(a) if verdict is False else None))]

    return per_matrix(ms, one, f"mid long, is_tu boolean, {SUB}")


def decompositions(ms: Matrices, ternary: bool = True) -> DataFrame:
    """The decomposition trees' nodes, one row each."""
    schema = "mid long, node int, parent int, place int, kind string, regularity int, graphicness int, cographicness int, rows array<int>, cols array<int>"
    return per_matrix(ms, lambda mid, a: [(mid, *x) for x in recognise.table(recognise.decompose(a, ternary))], schema)


_NODE = "mid long, node int, parent int, place int, kind string, regularity int, graphicness int, cographicness int, rows array<int>, cols array<int>, matrix array<array<int>>"


def _table(tree) -> list[tuple]:
    """The rows of a tree with the matrices of what is still to be decomposed."""
    todo, nodes = [tree], []
    while todo:
        x = todo.pop()
        nodes.append(x.matrix)
        todo += x.children[::-1]
    return [(*row, m) for row, m in zip(recognise.table(tree), nodes)]


def partial_decompositions(ms: Matrices, levels: int, ternary: bool = True) -> DataFrame:
    """As :func:`decompositions`, down to ``levels`` levels; deeper nodes are UNKNOWN and have
    their ``matrix``, from which :func:`completed` goes on."""
    return per_matrix(ms, lambda mid, a: [(mid, *x) for x in _table(recognise.decompose(a, ternary, levels))], _NODE)


def completed(nodes: DataFrame, ternary: bool = True, at: int | None = None) -> DataFrame:
    """Trees with their UNKNOWN nodes decomposed (those in the subtree of node ``at``, if
    given) and the attributes above recomputed; nodes are numbered anew."""

    names = [c.split()[0] for c in _NODE.split(", ")]
    held = nodes.groupBy("mid").agg(F.collect_list(F.struct(*names[1:])).alias("rows"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            out = []
            for mid, rows in zip(*(c.to_pylist() for c in batch.columns)):
                tree = recognise.completed(recognise.from_table([tuple(r.values()) for r in rows]), ternary, at)
                out += [(mid, *x) for x in _table(tree)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kind = nodes.sparkSession.createDataFrame([], _NODE).schema
    return held.repartition(work_tasks(nodes.sparkSession), "mid").mapInArrow(run, _NODE)


def three_separations(ms: Matrices) -> DataFrame:
    """``mid, kind, rows, cols, rebuilt``: a 3-separation with four elements or more on each
    side, the sum that it makes, and whether its parts' sum is the matrix again.  Null
    where there is none."""

    def one(mid, a):
        m, n = len(a), len(a[0]) if a else 0
        if not m or not n:
            return [(mid, None, None, None, None)]
        found = recognise.separation([[int(bool(v)) for v in r] for r in a], 2, 4)
        if not found:
            return [(mid, None, None, None, None)]
        kind, rebuilt = recognise.rebuilt(a, *found)
        return [(mid, kind, *found, rebuilt)]

    return per_matrix(ms, one, f"mid long, kind string, {SUB}, rebuilt boolean")


def regular_test(ms: Matrices) -> DataFrame:
    return per_matrix(ms, lambda mid, a: [(mid, recognise.is_regular(a))], "mid long, is_regular boolean")


# --- complements --------------------------------------------------------------


def complements(ms: Matrices, at: DataFrame) -> Matrices:
    """The 0/1 matrices complemented at ``at(mid, i, j)`` (null: none), relationally.

    A cell outside of row i and column j changes by its entries in these and by the entry
    where they cross, one inside of them by the latter only, so the complement is a sum
    modulo 2 of copies: of each entry of row i in all rows, of each of column j in all
    columns, and of the crossing's in all cells.  Only nonzeros are ever joined."""
    e = ms.entries.select("mid", "r", "c", (F.col("v").cast("int") % 2).alias("v")).where("v <> 0")
    e, _, (size,) = counted(e, "complement-entries")
    deal = dealer(e.sparkSession, size)
    near = deal(e).join(deal(ms.dims).hint("merge"), "mid").join(deal(at).hint("merge"), "mid", "left")
    rows, cols = F.sequence(F.lit(0), F.col("m") - 1), F.sequence(F.lit(0), F.col("n") - 1)
    to_rows = F.when(F.col("r").eqNullSafe(F.col("i")), rows).otherwise(F.array("r"))
    to_cols = F.when(F.col("c").eqNullSafe(F.col("j")), cols).otherwise(F.array("c"))
    copies = near.select("mid", to_cols.alias("cs"), F.explode(to_rows).alias("r")).select("mid", "r", F.explode("cs").alias("c"))
    parity = copies.groupBy("mid", "r", "c").agg((F.count("*") % 2).cast("int").alias("v"))
    return Matrices(ms.dims, parity.where("v <> 0"))


#: The entries of a 0/1 matrix's columns after a complement: row i = k div (n + 1) (none: m),
#: column j = k mod (n + 1) (none: n), from the masks ``full`` of all columns.
_ROW, _COL = "CAST(k div (n + 1) AS INT)", "CAST(k % (n + 1) AS INT)"
_HIT = f"IF({_ROW} < m, shiftleft(1L, {_ROW}), 0L)"
_LINE = f"IF({_COL} < n, full[{_COL}], 0L)"
_ALL = "(shiftleft(1L, m) - 1)"
#: What every other column is changed by: column j outside of row i, and all of it once more if they cross in a one.
_OTHER = f"""transform(full, (x, c) -> IF(c = {_COL},
  IF(({_LINE} & {_HIT}) <> 0L, x ^ ({_ALL} & ~{_HIT}), x),
  x ^ {_LINE} ^ IF(((x ^ {_LINE}) & {_HIT}) <> 0L, {_ALL} & ~{_HIT}, 0L)))"""


def ctu_test(ms: Matrices) -> DataFrame:
    """``mid, is_ctu, row, col``: the first complement that isn't totally unimodular;
    ``is_ctu`` is null if it can't be told.

    Matrices of at most ``MASK_ROWS`` rows are complemented and tested on bit masks in one
    expression per matrix; larger ones one by one."""

    def one(mid, a):
        verdict, bad = recognise.ctu(a)
        return [(mid, verdict, *(bad or (None, None)))]

    small = Matrices(ms.dims.where((F.col("m") <= MASK_ROWS) & (F.col("m") > 0) & (F.col("n") > 0)), ms.entries)
    e = small.entries.where("v <> 0")
    bit = F.expr("shiftleft(1L, CAST(r AS INT))")
    cols = e.groupBy("mid", "c").agg(F.sum(F.when(F.col("v") == 1, bit).otherwise(0)).alias("p"), F.max((F.col("v") != 1).cast("int")).alias("odd"))
    cols = cols.groupBy("mid").agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("at"), (F.max("odd") == 1).alias("odd"))
    tasks = work_tasks(ms.dims.sparkSession)
    rows = small.dims.repartition(tasks, "mid").join(cols, "mid", "left")
    full = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.coalesce(F.element_at("at", c), F.lit(0).cast("long")))
    rows = rows.select("mid", "m", "n", "odd", F.coalesce(full, F.array_repeat(F.lit(0).cast("long"), F.col("n"))).alias("full"))
    slow = MASK_TEST.format(cols=f"array_distinct(transform({_OTHER}, y -> named_struct('p', y, 'q', 0L)))")
    # of up to five rows the parts that split a set well are looked up; one must do for all columns
    fast = f"""forall(sequence(1L, {_ALL}), s -> aggregate(cols, -1L, (parts, x) -> parts & fits[CAST(32 * x + s AS INT)]) <> 0L)"""
    fast = f"exists(array(array_distinct({_OTHER})), cols -> {fast})"
    walk = "aggregate(sequence(0, (m + 1) * (n + 1) - 1), -1, (seen, k) -> IF(seen >= 0, seen, IF({test}, -1, k)))"
    rows = rows.withColumn("fits", F.lit(_fits()).cast("array<long>"))
    first = F.when(F.col("m") <= 5, F.expr(walk.format(test=fast))).otherwise(F.expr(walk.format(test=slow)))
    found = rows.withColumn("k", F.when(F.col("odd"), F.lit(-2)).otherwise(first))
    row, col = F.expr("CAST(k div (n + 1) AS INT)"), F.expr("CAST(k % (n + 1) AS INT)")
    told = found.select(
        "mid",
        (F.col("k") == -1).alias("is_ctu"),
        F.when((F.col("k") >= 0) & (row < F.col("m")), row).alias("row"),
        F.when((F.col("k") >= 0) & (col < F.col("n")), col).alias("col"),
    )
    large = ms.where((F.col("m") > MASK_ROWS) | (F.col("m") == 0) | (F.col("n") == 0))
    return told.unionByName(per_matrix(large, one, "mid long, is_ctu boolean, row int, col int"))


# --- series-parallel -----------------------------------------------------------


def sp_violators(ms: Matrices, ternary: bool = True) -> DataFrame:
    """``mid, rows, cols``: minimal submatrices that aren't series-parallel."""
    return per_matrix(ms, lambda mid, a: [(mid, *x) for x in [recognise.sp_violator(a, ternary)] if x], f"mid long, {SUB}")


# --- graphs -------------------------------------------------------------------

EDGES = "mid long, element int, tail int, head int, in_forest boolean"


def _edges(mid, found) -> list[tuple]:
    if not found:
        return []
    tree, others = found
    return [(mid, -1 - i, *tree[i], True) for i in sorted(tree)] + [(mid, 1 + j, *others[j], False) for j in sorted(others)]


def _flip(a):
    return [list(c) for c in zip(*a)] if a and a[0] else a


def graphic_test(ms: Matrices) -> DataFrame:
    """``mid, is_graphic, is_cographic, is_planar``."""

    def one(mid, a):
        g, c = graphs.is_graphic(a), graphs.is_cographic(a)
        return [(mid, g, c, g and c)]

    return per_matrix(ms, one, "mid long, is_graphic boolean, is_cographic boolean, is_planar boolean")


def realised_graphs(ms: Matrices) -> DataFrame:
    """Edges of a graph for each graphic matrix; its forest's edges are the rows."""
    return per_matrix(ms, lambda mid, a: _edges(mid, graphs.realise(a)), EDGES)


def network_test(ms: Matrices) -> DataFrame:
    """``mid, is_network, is_conetwork, support_is_graphic``."""

    def one(mid, a):
        s = [[abs(v) for v in r] for r in a]
        return [(mid, graphs.is_network(a), graphs.is_conetwork(a), graphs.is_graphic(s))]

    return per_matrix(ms, one, "mid long, is_network boolean, is_conetwork boolean, support_is_graphic boolean")


def realised_networks(ms: Matrices) -> DataFrame:
    return per_matrix(ms, lambda mid, a: _edges(mid, graphs.network(a)), EDGES)


def oriented_cographs(ms: Matrices) -> DataFrame:
    """Of the matrices with cographic support ``mid, oriented, edges, rows, cols``: whether the
    graph's edges can be directed as the signs ask; the directed edges (columns are its forest),
    or else a violating submatrix."""

    def one(mid, a):
        if not graphs.is_cographic([[abs(v) for v in r] for r in a]):
            return []
        found = graphs.network(_flip(a))
        if not found:
            return [(mid, False, None, *_sub(structure.camion(a)[1]))]
        tree, others = found
        edges = [{"element": 1 + j, "tail": t, "head": h} for j, (t, h) in sorted(tree.items())]
        edges += [{"element": -1 - i, "tail": t, "head": h} for i, (t, h) in sorted(others.items())]
        return [(mid, True, edges, None, None)]

    return per_matrix(ms, one, f"mid long, oriented boolean, edges array<struct<element: int, tail: int, head: int>>, {SUB}")


def greedy_graphic_columns(ms: Matrices) -> DataFrame:
    return per_matrix(ms, lambda mid, a: [(mid, graphs.greedy_graphic_columns(a))], "mid long, cols array<int>")


def represented(edges: DataFrame, signed: bool = False) -> Matrices:
    """Matrices of graphs ``edges(mid, element, tail, head, in_forest)``: forest edges are
    the rows, in the order of their numbers, others the columns."""
    schema = "mid long, m int, n int, cells array<struct<r: int, c: int, v: int>>"
    arrow = to_arrow_schema(edges.sparkSession.createDataFrame([], schema).schema)

    def one(mid, some):
        tree = {-1 - e: (t, h) for _, e, t, h, f in some if f}
        rest = {e - 1: (t, h) for _, e, t, h, f in some if not f}
        a = graphs.represented(tree, rest, signed)
        if a is not None:
            yield mid, len(tree), len(rest), [{"r": i, "c": j, "v": v} for i, r in enumerate(a) for j, v in enumerate(r) if v]

    def run(batches):
        lines = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        found = (x for mid, some in groupby(lines, key=lambda x: x[0]) for x in one(mid, list(some)))
        while rows := list(islice(found, 500)):
            yield batch_of(rows, arrow)

    # all edges of a matrix in a row, matrix after matrix, so that many go to Python at once
    dealt = edges.select("mid", "element", "tail", "head", "in_forest").repartition(work_tasks(edges.sparkSession), "mid").sortWithinPartitions("mid")
    found, _ = written(dealt.mapInArrow(run, schema), "represented")
    return Matrices(found.select("mid", "m", "n"), found.select("mid", F.explode("cells").alias("x")).select("mid", "x.r", "x.c", "x.v"))


# --- equimodular and named ----------------------------------------------------


def equimodular_test(ms: Matrices) -> DataFrame:
    """``mid, k, strong_k, is_unimodular``: the determinant gcd (0: not equimodular), the
    same if the transpose has it too, and whether k is 1; null for what can't be told."""

    def one(mid, a):
        k = recognise.equimodular(a)
        strong = recognise.strongly_equimodular(a) if k != 0 else 0
        return [(mid, None if k is None else str(k), None if strong is None else str(strong), None if k is None else k == 1)]

    return per_matrix(ms, one, "mid long, k string, strong_k string, is_unimodular boolean")


def named_test(ms: Matrices) -> DataFrame:
    """``mid, identity_order, r10, r12``: the order of an identity matrix (else null), which
    representation of R10 it is (0: none), and whether it is R12's."""
    one = lambda mid, a: [(mid, recognise.identity_order(a), recognise.r10_kind(a), recognise.is_r12(a))]
    return per_matrix(ms, one, "mid long, identity_order int, r10 int, r12 boolean")


def identity_orders(ms: Matrices) -> DataFrame:
    """``mid, identity_order`` relationally: m ones on the diagonal and nothing else."""
    e = ms.entries.groupBy("mid").agg(F.count("*").alias("k"), F.min(((F.col("r") == F.col("c")) & (F.col("v") == 1)).cast("int")).alias("ok"))
    whole: Column = (F.col("m") == F.col("n")) & (F.coalesce("k", F.lit(0)) == F.col("m")) & (F.coalesce("ok", F.lit(1)) == 1)
    return ms.dims.join(e, "mid", "left").select("mid", F.when(whole, F.col("m")).alias("identity_order"))
