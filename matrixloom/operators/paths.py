"""Shortest paths in the bipartite graphs of matrices: rows and columns are nodes, nonzeros
are edges.

All matrices are searched at once, level by level.  A level is a table of lines with their
parents; the next one is a join of it with the entries and a minimum for each line.  As a
line next to level d lies in one of the levels d - 1 to d + 1, only these two are kept out,
so a step costs as much as its frontier, however much has been seen.  Each level is written
to the shared folder: a lost executor costs one step.  Matrices that have their path drop
out of the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Matrices, column_element, row_element
from ..storage import counted, written


def place(element: Column | str) -> Column:
    """Rows before columns, each by its index."""
    e = F.col(element) if isinstance(element, str) else element
    return F.struct((e > 0).alias("column"), F.abs(e).alias("at"))


def adjacency(ms: Matrices) -> DataFrame:
    """``mid, a, b, v``: each entry from its row to its column and back."""
    ends = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    row, column = row_element(F.col("r")), column_element(F.col("c"))
    return ms.entries.select("mid", F.explode(F.array(ends(row, column), ends(column, row))).alias("e"), "v").select("mid", "e.a", "e.b", "v")


class Search:
    """A search from groups of lines to larger groups, with what it has found.

    ``found``: ``mid, grp, source, target, length, total`` of the matrices that have a path,
    ``levels``: the lines of each step with their parents."""

    def __init__(self, found: DataFrame, levels: list[DataFrame]):
        self.found, self.levels = found, levels

    def lines(self) -> DataFrame:
        """``mid, at, element``: the lines on each path, from its source (at 0) on; one step
        back is one join of a few rows for each matrix."""
        here = self.found.select("mid", "grp", F.col("target").alias("element"), F.col("length").alias("at"))
        out = here
        for k in range(len(self.levels) - 1, 0, -1):
            due = here.where(F.col("at") == k)
            back = due.join(self.levels[k].select("mid", "grp", "element", "parent"), ["mid", "grp", "element"]).select("mid", "grp", F.col("parent").alias("element"), (F.col("at") - 1).alias("at"))
            back, _ = written(back, "paths-back")
            out, here = out.unionByName(back), here.where(F.col("at") < k).unionByName(back)
        return out.select("mid", "at", "element")


def search(ms: Matrices, groups: DataFrame) -> Search:
    """A shortest path of each matrix from a line of a positive group to one of a larger
    group, for ``groups(mid, element, grp)``; lines that aren't listed are in group 0, those
    of negative groups are left out.

    Of several shortest paths: from the smallest group, to the first line, and backwards over
    the first line each (rows before columns).  ``total`` is the sum of the path's entries."""
    listed, _ = written(groups.select("mid", F.col("element").cast("int").alias("element"), F.col("grp").cast("int").alias("grp")).where("grp <> 0"), "paths-groups")
    out_of_it = listed.where("grp < 0").select("mid", F.col("element").alias("a"))
    edges = adjacency(ms).join(out_of_it, ["mid", "a"], "left_anti").join(out_of_it.withColumnRenamed("a", "b"), ["mid", "b"], "left_anti")
    edges, _ = written(edges.select("mid", "a", "b", F.col("v").cast("long").alias("v")), "paths-edges")
    ends = listed.where("grp > 0").select("mid", F.col("element"), F.col("grp").alias("other"))
    level = listed.where("grp > 0").select("mid", "grp", "element", F.lit(None).cast("int").alias("parent"), F.col("element").alias("source"), F.lit(0).cast("long").alias("total"))
    level, _, (n,) = counted(level, "paths-level")
    levels, found = [level], None
    active = level
    while n:
        steps = active.select("mid", "grp", F.col("element").alias("a"), "source", "total").join(edges, ["mid", "a"])
        best = F.min(F.struct(place("a").alias("p"), "a", "source", (F.col("total") + F.col("v")).alias("total"))).alias("x")
        new = steps.groupBy("mid", "grp", F.col("b").alias("element")).agg(best)
        for seen in levels[-2:]:
            new = new.join(seen.select("mid", "grp", "element"), ["mid", "grp", "element"], "left_anti")
        new, _, (n,) = counted(new.select("mid", "grp", "element", F.col("x.a").alias("parent"), "x.source", "x.total"), "paths-level")
        levels.append(new)
        hits = new.join(ends, ["mid", "element"]).where("other > grp")
        first = hits.groupBy("mid").agg(F.min(F.struct("grp", place("element").alias("p"), "source", "element", "total")).alias("x"))
        length = F.lit(len(levels) - 1).alias("length")
        first, _, (k,) = counted(first.select("mid", "x.grp", "x.source", F.col("x.element").alias("target"), length, "x.total"), "paths-found")
        found = first if found is None else found.unionByName(first)
        active = new.join(first.select("mid"), "mid", "left_anti") if k else new
        if k:
            active, _, (n,) = counted(active, "paths-active")
    if found is None:
        found = level.select("mid", "grp", "source", F.col("element").alias("target"), F.lit(0).alias("length"), "total").limit(0)
    return Search(found, levels)


def shortest_paths(ms: Matrices, groups: DataFrame) -> DataFrame:
    """``mid, source, target, length, total`` of :func:`search`, nulls without a path."""
    return ms.dims.select("mid").join(search(ms, groups).found.drop("grp"), "mid", "left")


def _one_line(block: DataFrame) -> DataFrame:
    """``mid, one``: whether the block's rows are copies of one row up to sign."""
    vector = F.array_sort(F.collect_list(F.struct("c", "v")))
    rows = block.groupBy("mid", "r").agg(vector.alias("x")).withColumn("x", F.expr("transform(x, e -> struct(e.c AS c, e.v * signum(x[0].v) AS v))"))
    return rows.groupBy("mid").agg((F.count_distinct("x") == 1).alias("one"))


def delta_epsilons(ms: Matrices, separations: DataFrame) -> DataFrame:
    """``mid, epsilon``: the entry (1 or -1) that the special lines of a delta-sum's parts get,
    for ``separations(mid, rows, cols)``, the first part's lines, whose two off-diagonal
    blocks have rank 1 each.

    A path within the first part from a row of the one block to a column of the other closes
    to a cycle with an entry of each block and epsilon, whose sum is a multiple of four.
    Null if a block's rank isn't 1 or there is no such path."""
    first = separations.select("mid", F.explode(F.concat(F.transform("rows", lambda i: -1 - i), F.transform("cols", lambda j: 1 + j))).alias("element")).select("mid", F.col("element").cast("int").alias("element"), F.lit(True).alias("mine"))
    mine = separations.select("mid")
    tag = lambda name, element: first.select("mid", F.col("element").alias(element), F.col("mine").alias(name))
    e = ms.entries.join(mine, "mid", "left_semi").withColumn("re", row_element(F.col("r"))).withColumn("ce", column_element(F.col("c")))
    e = e.join(tag("rm", "re"), ["mid", "re"], "left").join(tag("cm", "ce"), ["mid", "ce"], "left")
    e, _ = written(e.select("mid", "r", "c", "v", F.col("re").cast("int").alias("re"), F.col("ce").cast("int").alias("ce"), F.coalesce("rm", F.lit(False)).alias("rm"), F.coalesce("cm", F.lit(False)).alias("cm")), "epsilon-entries")
    right, low = e.where("rm AND NOT cm"), e.where("NOT rm AND cm")
    fine = _one_line(right).where("one").join(_one_line(low).where("one"), "mid").select("mid")
    groups = right.select("mid", F.col("re").alias("element"), F.lit(1).alias("grp")).unionByName(low.select("mid", F.col("ce").alias("element"), F.lit(2).alias("grp"))).distinct()
    inner = Matrices(ms.dims.join(mine, "mid", "left_semi"), e.where("rm AND cm").join(fine, "mid", "left_semi").select("mid", "r", "c", "v"))
    found = search(inner, groups.join(fine, "mid", "left_semi")).found
    # an entry of each block: in its first line outside of the first part
    column = right.join(right.groupBy("mid").agg(F.min("c").alias("c")), ["mid", "c"]).select("mid", F.col("re").alias("source"), F.col("v").alias("x"))
    row = low.join(low.groupBy("mid").agg(F.min("r").alias("r")), ["mid", "r"]).select("mid", F.col("ce").alias("target"), F.col("v").alias("y"))
    value = F.when(F.pmod(F.col("total") + F.col("x") + F.col("y"), F.lit(4)) == 1, -1).otherwise(1).alias("epsilon")
    return mine.join(found.join(column, ["mid", "source"]).join(row, ["mid", "target"]).select("mid", value), "mid", "left")

