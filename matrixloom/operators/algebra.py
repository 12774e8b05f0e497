"""Matrix algebra as relational operators (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Matrices


def transpose(ms: Matrices) -> Matrices:
    return Matrices(ms.dims.select("mid", F.col("n").alias("m"), F.col("m").alias("n")), ms.entries.select("mid", F.col("c").alias("r"), F.col("r").alias("c"), "v"))


def permute(ms: Matrices, order: DataFrame) -> Matrices:
    """``result[i, j] = M[rows[i], cols[j]]`` for ``order(mid, axis, new, old)``, axis
    ``r`` or ``c``; an axis of a matrix that it doesn't have stays."""
    entries = ms.entries
    for axis in ("r", "c"):
        mine = order.where(F.col("axis") == axis).select("mid", F.col("old").alias(axis), F.col("new").alias("_new"))
        entries = entries.join(mine, ["mid", axis], "left").withColumn(axis, F.coalesce("_new", axis)).select("mid", "r", "c", "v")
    return Matrices(ms.dims, entries)


def random_order(ms: Matrices, seed: int = 1) -> DataFrame:
    """A seeded uniform order of the rows and of the columns of each matrix."""
    rows, cols = (ms.dims.where(F.col(size) > 0).select("mid", F.lit(axis).alias("axis"), F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("new")) for axis, size in (("r", "m"), ("c", "n")))
    both = rows.unionByName(cols)
    rank = F.row_number().over(Window.partitionBy("mid", "axis").orderBy(F.xxhash64(F.lit(seed), "mid", "axis", "new"), "new")) - 1
    return both.withColumn("old", rank)


def slice_submatrix(ms: Matrices, subs: DataFrame) -> Matrices:
    """Submatrices ``subs(mid, rows, cols)`` in the order of their index lists."""
    rows = subs.select("mid", F.posexplode("rows").alias("new_r", "r"))
    cols = subs.select("mid", F.posexplode("cols").alias("new_c", "c"))
    entries = ms.entries.join(rows, ["mid", "r"]).join(cols, ["mid", "c"])
    dims = ms.dims.select("mid").join(subs, "mid").select("mid", F.size("rows").alias("m"), F.size("cols").alias("n"))
    return Matrices(dims, entries.select("mid", F.col("new_r").alias("r"), F.col("new_c").alias("c"), "v"))


def support(ms: Matrices, eps: float = 0.0) -> Matrices:
    return Matrices(ms.dims, ms.entries.where(F.abs("v") > eps).select("mid", "r", "c", F.lit(1).alias("v")))


def signed_support(ms: Matrices, eps: float = 0.0) -> Matrices:
    return Matrices(ms.dims, ms.entries.where(F.abs("v") > eps).select("mid", "r", "c", F.signum("v").cast("int").alias("v")))


def find_entry(ms: Matrices, r: int | Column, c: int | Column) -> DataFrame:
    """``mid, v`` of the entry at (r, c), 0 where there is none."""
    at = ms.entries.where((F.col("r") == r) & (F.col("c") == c)).select("mid", "v")
    return ms.dims.select("mid").join(at, "mid", "left").select("mid", F.coalesce("v", F.lit(0)).alias("v"))


def equal(a: Matrices, b: Matrices) -> DataFrame:
    """``mid, equal`` for each matrix of ``a`` or ``b``.

    Both sides are tagged and summed, so one shuffle compares all entries.
    """
    tag = lambda ms, i: ms.entries.groupBy("mid", "r", "c", "v").agg(F.lit(i).alias("side"))
    cells = tag(a, 1).unionByName(tag(b, -1)).groupBy("mid", "r", "c", "v").agg(F.sum("side").alias("d"))
    differ = cells.where("d <> 0").select("mid").distinct().withColumn("differ", F.lit(True))
    sizes = a.dims.join(b.dims.select("mid", F.col("m").alias("m2"), F.col("n").alias("n2")), "mid", "full")
    same = F.coalesce((F.col("m") == F.col("m2")) & (F.col("n") == F.col("n2")), F.lit(False)) & F.col("differ").isNull()
    return sizes.join(differ, "mid", "left").select("mid", same.alias("equal"))


def is_transpose(a: Matrices, b: Matrices) -> DataFrame:
    return equal(transpose(a), b)


# Submatrices: a struct of ordered index lists.


def sub(rows: Column, cols: Column) -> Column:
    return F.struct(rows.alias("rows"), cols.alias("cols"))


def sub_transpose(s: str) -> Column:
    return sub(F.col(f"{s}.cols"), F.col(f"{s}.rows"))


def sub_slice(base: str, inner: str) -> Column:
    """``inner``, given in the parent's indices, in ``base``'s; null if it isn't inside."""

    def axis(x: str) -> Column:
        return F.transform(F.col(f"{inner}.{x}"), lambda i: F.array_position(F.col(f"{base}.{x}"), i).cast("int") - 1)

    out = sub(axis("rows"), axis("cols"))
    inside = ~F.exists(axis("rows"), lambda i: i < 0) & ~F.exists(axis("cols"), lambda i: i < 0)
    return F.when(inside, out)


def sub_unslice(base: str, inner: str) -> Column:
    """``inner``, given in ``base``'s indices, in the parent's."""

    def axis(x: str) -> Column:
        return F.transform(F.col(f"{inner}.{x}"), lambda i: F.element_at(F.col(f"{base}.{x}"), i + 1))

    return sub(axis("rows"), axis("cols"))


def sub_sort(s: str) -> Column:
    return sub(F.array_sort(f"{s}.rows"), F.array_sort(f"{s}.cols"))
