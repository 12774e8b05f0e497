"""Pivots over fields and rings, and determinants of 2 x 2 submatrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Matrices, dealer
from ..storage import counted, written


def residue(value: Column, char: int) -> Column:
    """The representative of a residue class: 0, 1 or, modulo 3, -1; for characteristic
    0 the number itself."""
    if char == 2:
        return F.pmod(value, F.lit(2)).cast("int")
    if char == 3:
        return (F.pmod(value + 1, F.lit(3)) - 1).cast("int")
    return value.cast("int")


def pivot(ms: Matrices, at: DataFrame, char: int = 0) -> Matrices:
    """Pivot each matrix at its ``at(mid, p, q)``; matrices without one stay.

    With a = M[p, q]: M'[p, q] = -a, the rest of row p and of column q is
    multiplied by a, and elsewhere M'[r, c] = M[r, c] - a M[r, q] M[p, c].  One
    equi-join by matrix makes the products, one aggregation adds them up.
    A pivot on a zero gives no matrix, see :func:`zero_pivots`.  Entries are dealt by matrix, to
    more tasks the more there are.
    """
    e, _, (size,) = counted(ms.entries.select("mid", "r", "c", F.col("v").cast("long").alias("v")), "pivot-entries")
    at, _ = written(at.select("mid", "p", "q"), "pivot-places")
    deal = dealer(e.sparkSession, size)
    e, at = deal(e), deal(at).hint("merge")
    here = e.join(at, "mid")
    p, q = F.col("p"), F.col("q")
    alpha = here.where((F.col("r") == p) & (F.col("c") == q)).select("mid", "p", "q", F.col("v").alias("a"))
    row = here.where((F.col("r") == p) & (F.col("c") != q)).select("mid", "c", F.col("v").alias("vr"))
    col = here.where((F.col("c") == q) & (F.col("r") != p)).select("mid", "r", F.col("v").alias("vc"))
    stay = e.join(at, "mid", "left").where(p.isNull() | (F.col("r") != p) & (F.col("c") != q)).select("mid", "r", "c", "v")
    row, alpha = row.hint("merge"), alpha.hint("merge")
    crossed = col.join(row, "mid").join(alpha, "mid").select("mid", "r", "c", (-F.col("a") * F.col("vc") * F.col("vr")).alias("v"))
    lines = (
        row.join(alpha, "mid").select("mid", F.col("p").alias("r"), "c", (F.col("a") * F.col("vr")).alias("v"))
        .unionByName(col.join(alpha, "mid").select("mid", "r", F.col("q").alias("c"), (F.col("a") * F.col("vc")).alias("v")))
        .unionByName(alpha.select("mid", F.col("p").alias("r"), F.col("q").alias("c"), (-F.col("a")).alias("v")))
    )
    summed = deal(stay.unionByName(crossed).unionByName(lines)).groupBy("mid", "r", "c").agg(residue(F.sum("v"), char).alias("v")).where("v <> 0")
    bad = at.join(alpha, "mid", "left_anti").select("mid")
    return Matrices(ms.dims.join(bad, "mid", "left_anti"), summed.join(bad, "mid", "left_anti"))


def zero_pivots(ms: Matrices, at: DataFrame) -> DataFrame:
    """``mid`` of the pivots that stand on a zero."""
    cells = ms.entries.select("mid", F.col("r").alias("p"), F.col("c").alias("q"))
    return at.join(cells, ["mid", "p", "q"], "left_anti").select("mid").distinct()


def pivots(ms: Matrices, steps: list[DataFrame], char: int = 0) -> Matrices:
    for at in steps:
        ms = pivot(ms, at, char)
    return ms


def random_entries(ms: Matrices, seed: int, step: int = 0) -> DataFrame:
    """``mid, p, q``: one nonzero of each matrix, that with the least hash of seed, step,
    matrix and place."""
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), *[F.col(c).cast("string") for c in ("mid", "r", "c")]))
    return ms.entries.groupBy("mid").agg(F.min(F.struct(lot.alias("lot"), "r", "c")).alias("w")).select("mid", F.col("w.r").alias("p"), F.col("w.c").alias("q"))


def random_pivots(ms: Matrices, count: int, char: int, seed: int = 1) -> Matrices:
    """``count`` pivots (modulo 2 or 3) one after another on random nonzeros of each matrix;
    zero matrices stay.  Each step is written, as the next one reads it several times."""
    for step in range(count):
        entries, _ = written(pivot(ms, random_entries(ms, seed, step), char).entries, "random-pivots")
        ms = Matrices(ms.dims, entries)
    return ms


def outside_units(ms: Matrices) -> DataFrame:
    """``mid, r, c`` of each matrix's first entry outside -1, 0, 1: what a regular pivot
    must not leave."""
    return ms.entries.where(F.abs("v") > 1).groupBy("mid").agg(F.min(F.struct("r", "c")).alias("w")).select("mid", "w.r", "w.c")


def determinants_2x2(ms: Matrices) -> DataFrame:
    """``mid, r1, r2, c1, c2, det`` of the 2 x 2 submatrices that have a row of two
    nonzeros in both rows, by joining rows on their columns."""
    e = ms.entries
    pair = e.select("mid", "r", F.col("c").alias("c1"), F.col("v").alias("v1")).join(e.select("mid", "r", F.col("c").alias("c2"), F.col("v").alias("v2")), ["mid", "r"]).where("c1 < c2")
    low, high = pair, pair.select("mid", "c1", "c2", F.col("r").alias("r2"), F.col("v1").alias("w1"), F.col("v2").alias("w2"))
    both = low.withColumnRenamed("r", "r1").join(high, ["mid", "c1", "c2"]).where("r1 < r2")
    return both.select("mid", "r1", "r2", "c1", "c2", (F.col("v1") * F.col("w2") - F.col("v2") * F.col("w1")).alias("det"))
