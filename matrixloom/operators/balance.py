"""Balancedness of matrices of any size: a search for holes over their entries.

A matrix of -1, 0 and 1 is balanced if the entries of each hole (a chordless cycle of lines;
a submatrix with two nonzeros in each line that is one cycle) sum up to a multiple of four.
Series-parallel reductions go first, as no hole needs a line that they take away.  What they
leave is searched for holes, all matrices at once: a table of chordless paths, each from the
hole's first row on, grows by a line a round; a line that touches an earlier one of its path
is a chord, unless it is the last column and touches the first row, which closes the hole.
A hole is met once: its other rows come after the first, its last column after its second line.

A path is one row, touched lines are found by a join with the entries, and neither a line nor
a matrix is ever in one row.  Matrices that have a hole with another sum drop out, so what is
found has least order.  Each round is a table in the shared folder.  There are as many rounds
as the longest chordless path has lines, so one long hole takes a round for each of its lines,
and there are as many paths as the matrices have: exponentially many in the worst case.

That is for matrices of more than ``model.WHOLE`` nonzeros, or with more than ``CORE`` after the
reductions and more than ``PATHS`` chordless paths of one length before a hole is found; others are
searched in the same way, each in a task's memory, after one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entries as one_matrix
from ..model import Matrices, whole
from ..storage import by_shuffles, counted, dealing, delete, written
from .paths import adjacency
from .series import reductions

#: Nonzeros after the reductions up to which one task searches a matrix to the end.
CORE = 48
#: Paths that a task holds at a time of a matrix with more.
PATHS = 100_000
#: The lines of the last line's side that come before it.
EARLIER = "filter(slice(path, 1, size(path) - 1), (x, i) -> i % 2 = (size(path) - 1) % 2)"


def _grown(paths: DataFrame, edges: DataFrame, column: bool) -> DataFrame:
    """``mid, path, total, closed``: chordless paths with a further line; the sum of a closed
    one has the entry that closes it."""
    more = paths.withColumn("a", F.element_at("path", -1)).join(edges, ["mid", "a"]).where(~F.array_contains("path", F.col("b")))
    if not column:
        more = more.where(F.col("b") < F.col("path")[0])
    tried = more.select("mid", "path", "b", (F.col("total") + F.col("v")).alias("total"), F.explode_outer(F.expr(EARLIER)).alias("a"))
    touched = tried.join(edges.withColumnRenamed("v", "w"), ["mid", "a", "b"], "left")
    first = F.col("a") == F.col("path")[0]
    seen = touched.groupBy("mid", "path", "b").agg(
        F.max("total").alias("total"), F.max(F.when(first, F.col("w"))).alias("closing"), F.count(F.when(~first, F.col("w"))).alias("chords")
    ).where("chords = 0")
    closed = F.col("closing").isNotNull()
    return seen.where(~closed | (F.col("b") > F.col("path")[1])).select(
        "mid", F.concat("path", F.array("b")).alias("path"), (F.col("total") + F.coalesce("closing", F.lit(0))).alias("total"), closed.alias("closed")
    )


@by_shuffles
def odd_holes(ms: Matrices) -> DataFrame:
    """``mid, path``: a shortest hole whose entries don't sum up to a multiple of four, of
    each matrix (of -1, 0 and 1) that has one: its lines in order, from the first row on."""
    spark = ms.dims.sparkSession
    edges, _ = written(adjacency(Matrices(ms.dims, reductions(ms)[1])), "balance-edges")
    dealt = dealing(edges)
    start = edges.where("a < 0").select("mid", F.array("a").alias("path")).distinct()
    paths, path, (n,) = counted(start.select("mid", "path", F.lit(0).alias("total"), F.lit(False).alias("closed")), "balance-paths")
    found, column = None, True
    while n:
        due = paths.where("NOT closed")
        if found is not None:
            due = due.join(found.select("mid"), "mid", "left_anti")
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        bad = F.col("closed") & (F.pmod("total", F.lit(4)) != 0)
        paths, new_path, (_, n, k) = counted(_grown(due.drop("closed"), dealt(edges), column), "balance-paths", count(~F.col("closed")), count(bad))
        if k:
            new, _ = written(paths.where(bad).groupBy("mid").agg(F.min("path").alias("path")), "balance-holes")
            found = new if found is None else found.unionByName(new)
        delete(spark, path)
        path, column = new_path, not column
    return start.limit(0) if found is None else found


@by_shuffles
def balanced_test(ms: Matrices) -> DataFrame:
    """``mid, is_balanced, rows, cols``: with a violator of least order: an entry that isn't -1,
    0 or 1 (the first, by rows), or the lines of a hole.  Both lists are null if balanced."""
    most, paths = CORE, PATHS

    def one(m, n, cells):
        odd = [(r, c) for r, c, v in cells if v not in (-1, 0, 1)]
        if odd:
            r, c = min(odd)
            return False, [r], [c]
        near = one_matrix.near_of(cells)
        one_matrix.reduced(near, True)
        try:
            hole = one_matrix.odd_hole(near, paths if sum(map(len, near.values())) > 2 * most else float("inf"))
        except one_matrix.TooMany:
            return None
        return (True, None, None) if hole is None else (False, *one_matrix.sides(hole))

    small, large = whole(ms, one, "is_balanced boolean, rows array<int>, cols array<int>", "balance-test")
    return small if large is None else small.unionByName(_balanced_test(large))


def _balanced_test(ms: Matrices) -> DataFrame:
    bad = ms.entries.where(~F.col("v").isin(-1, 0, 1)).groupBy("mid").agg(F.min(F.struct("r", "c")).alias("x"))
    bad, _ = written(bad.select("mid", F.array(F.col("x.r").cast("int")).alias("rows"), F.array(F.col("x.c").cast("int")).alias("cols")), "balance-odd")
    ternary = Matrices(ms.dims.join(bad, "mid", "left_anti"), ms.entries.join(bad, "mid", "left_anti"))
    side = lambda keep, index: F.array_sort(F.transform(F.filter("path", keep), index))
    holes = odd_holes(ternary).select("mid", side(lambda x: x < 0, lambda x: -1 - x).alias("rows"), side(lambda x: x > 0, lambda x: x - 1).alias("cols"))
    told = ms.dims.select("mid").join(bad.unionByName(holes), "mid", "left")
    return written(told.select("mid", F.col("rows").isNull().alias("is_balanced"), "rows", "cols"), "balance-told")[0]
