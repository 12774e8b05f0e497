"""Connected blocks (1-sum decomposition), line degrees and duplicate lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure
from ..model import Matrices, per_matrix
from ..storage import components


def lines(ms: Matrices) -> DataFrame:
    """``mid, element`` of all rows and columns."""
    rows = ms.dims.where("m > 0").select("mid", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).select("mid", (-1 - F.col("i")).alias("element"))
    cols = ms.dims.where("n > 0").select("mid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).select("mid", (1 + F.col("j")).alias("element"))
    return rows.unionByName(cols)


def _place(element: Column) -> Column:
    """Rows before columns, each by its index."""
    return F.struct((element > 0).alias("column"), F.abs(element).alias("at"))


#: Lines up to which a matrix's blocks are found in one row.
SMALL = 256


def block_of_lines(ms: Matrices) -> DataFrame:
    """``mid, element, block``: blocks numbered from 0 by their first line, for matrices of any
    size: small ones each by a search, others as components of one graph whose nodes are
    lines of matrices."""
    small = F.col("m") + F.col("n") <= SMALL
    found = decompose_blocks(ms.where(small))
    elements = F.concat(F.transform("rows", lambda i: -1 - i), F.transform("cols", lambda j: 1 + j))
    searched = found.select("mid", F.explode(elements).alias("element"), "block")
    large = ms.where(~small)
    if large.dims.isEmpty():
        return searched
    return searched.unionByName(_block_of_lines(large))


def _block_of_lines(ms: Matrices) -> DataFrame:
    node = lambda element: F.struct("mid", _place(element).alias("p"))
    e = ms.entries.select(node(-1 - F.col("r")).alias("a"), node(1 + F.col("c")).alias("b"))
    roots = components(e, "blocks")
    all_lines = lines(ms).withColumn("node", node(F.col("element")))
    found = all_lines.join(roots, "node", "left").select("mid", "element", F.coalesce("root", "node").alias("root"))
    firsts = found.select("mid", "root").distinct()
    numbered = firsts.withColumn("block", F.row_number().over(Window.partitionBy("mid").orderBy("root")) - 1)
    return found.join(numbered, ["mid", "root"]).select("mid", "element", "block")


def decompose_blocks(ms: Matrices) -> DataFrame:
    """``mid, block, rows, cols`` per matrix, lines in search order."""
    return per_matrix(ms, lambda mid, a: [(mid, k, r, c) for k, (r, c) in enumerate(structure.blocks(a))], "mid long, block int, rows array<int>, cols array<int>")


def degrees(ms: Matrices) -> DataFrame:
    """``mid, element, degree``: nonzeros of each line."""
    e = ms.entries
    count = e.select("mid", (-1 - F.col("r")).alias("element")).unionByName(e.select("mid", (1 + F.col("c")).alias("element"))).groupBy("mid", "element").agg(F.count("*").alias("degree"))
    return lines(ms).join(count, ["mid", "element"], "left").select("mid", "element", F.coalesce("degree", F.lit(0)).alias("degree"))


def parallel_rows(ms: Matrices, up_to_sign: bool = True) -> DataFrame:
    """``mid, r, first``: rows that are copies of an earlier row (up to sign), and the
    first such row.  Rows are compared as whole sorted vectors."""
    vector = F.array_sort(F.collect_list(F.struct("c", "v")))
    rows = ms.entries.groupBy("mid", "r").agg(vector.alias("x"))
    if up_to_sign:
        rows = rows.withColumn("x", F.expr("transform(x, e -> struct(e.c AS c, e.v * signum(x[0].v) AS v))"))
    first = rows.groupBy("mid", "x").agg(F.min("r").alias("first"))
    return rows.join(first, ["mid", "x"]).where("r <> first").select("mid", "r", "first")
