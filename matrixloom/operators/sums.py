"""Sums of matrices as unions and outer-product joins, and separations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import separations
from ..functions import sums as dense_sums
from ..model import Matrices, per_matrix
from .algebra import transpose
from .pivots import residue


def one_sum(ms: Matrices, parts: DataFrame) -> Matrices:
    """Block diagonal sums of the matrices ``parts(sid, place, mid)``, in their order."""
    sized = parts.join(ms.dims, "mid")
    before = Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("sid", "mid", *[F.coalesce(F.sum(x).over(before), F.lit(0)).cast("int").alias(f"_{x}") for x in ("m", "n")])
    dims = sized.groupBy(F.col("sid").alias("mid")).agg(F.sum("m").cast("int").alias("m"), F.sum("n").cast("int").alias("n"))
    e = ms.entries.join(offsets, "mid")
    return Matrices(dims, e.select(F.col("sid").alias("mid"), (F.col("r") + F.col("_m")).alias("r"), (F.col("c") + F.col("_n")).alias("c"), "v"))


def two_sum(first: Matrices, second: Matrices, special: DataFrame, char: int = 3) -> Matrices:
    """[A 0; d c D] for the first's special row and the second's special column,
    ``special(mid, row, col)``: the rest of both, and the outer product of the two lines by
    one join per matrix."""
    s1 = first.dims.join(special, "mid").select("mid", "row", "col", (F.col("m") - 1).alias("m1"), F.col("n").alias("n1"))
    dims = second.dims.join(s1, "mid").select("mid", (F.col("m") + F.col("m1")).alias("m"), (F.col("n") + F.col("n1") - 1).alias("n"))
    a, d = first.entries.join(s1, "mid"), second.entries.join(s1, "mid")
    shifted = F.col("r") - (F.col("r") > F.col("row")).cast("int")
    top = a.where("r <> row").select("mid", shifted.alias("r"), "c", "v")
    right = F.col("n1") + F.col("c") - (F.col("c") > F.col("col")).cast("int")
    low = d.where("c <> col").select("mid", (F.col("m1") + F.col("r")).alias("r"), right.alias("c"), "v")
    line = a.where("r = row").select("mid", "c", F.col("v").alias("x"))
    column = d.where("c = col").select("mid", (F.col("m1") + F.col("r")).alias("r"), F.col("v").alias("y"))
    outer = column.join(line, "mid").select("mid", "r", "c", residue(F.col("x") * F.col("y"), char).alias("v"))
    return Matrices(dims, top.unionByName(low).unionByName(outer).where("v <> 0"))


def two_sum_by_column(first: Matrices, second: Matrices, special: DataFrame, char: int = 3) -> Matrices:
    """[A a b; 0 D] for the first's special column and the second's special row,
    ``special(mid, col, row)``: the 2-sum of the transposes, transposed."""
    turned = special.select("mid", F.col("col").alias("row"), F.col("row").alias("col"))
    return transpose(two_sum(transpose(first), transpose(second), turned, char))


def _rank_of(line: str, *without: str):
    """The place of a line when special ones have been left out."""
    out = F.col(line)
    for w in without:
        out = out - (F.col(line) > F.col(w)).cast("int")
    return out


def delta_problems(first: Matrices, second: Matrices, special: DataFrame) -> DataFrame:
    """``mid`` of the pairs that make no delta-sum: special columns that differ, or special
    entries that aren't 0 and a unit."""

    def column(ms: Matrices, row: str, col: str, name: str) -> DataFrame:
        e = ms.entries.join(special, "mid").where((F.col("c") == F.col(col)) & (F.col("r") != F.col(row)))
        return e.select("mid", "r", F.lit(name).alias("part"), "v")

    def spot(ms: Matrices, row: str, col: str, name: str) -> DataFrame:
        cell = ms.entries.join(special, "mid").where((F.col("r") == F.col(row)) & (F.col("c") == F.col(col)))
        return cell.select("mid", F.col("v").alias(name))

    pairs = column(first, "row", "x", "first").withColumn("w", F.lit(1)).unionByName(column(first, "row", "y", "first").withColumn("w", F.lit(-1)))
    pairs = pairs.unionByName(column(second, "row2", "u", "second").withColumn("w", F.lit(1))).unionByName(column(second, "row2", "w", "second").withColumn("w", F.lit(-1)))
    differ = pairs.groupBy("mid", "part", "r").agg(F.sum(F.col("v") * F.col("w")).alias("d")).where("d <> 0").select("mid")
    units = special.select("mid")
    for ms, row, col, name in ((first, "row", "x", "zero1"), (first, "row", "y", "unit1"), (second, "row2", "w", "zero2"), (second, "row2", "u", "unit2")):
        units = units.join(spot(ms, row, col, name), "mid", "left")
    units = units.where("coalesce(zero1, 0) <> 0 OR coalesce(zero2, 0) <> 0 OR abs(coalesce(unit1, 0)) <> 1 OR abs(coalesce(unit2, 0)) <> 1").select("mid")
    return differ.unionByName(units).distinct()


def delta_sum(first: Matrices, second: Matrices, special: DataFrame, char: int = 3) -> Matrices:
    """[A ab; dc D] of first parts [A a a; c 0 e] and second parts [e 0 b; d d D], with
    ``special(mid, row, x, y, row2, u, w)``: the first's special row and its columns with 0
    and e there, the second's special row and its columns with e and 0.  Both outer products
    are one join per matrix; malformed pairs give none (:func:`delta_problems`)."""
    sizes = first.dims.select("mid", F.col("m").alias("m1"), F.col("n").alias("n1")).join(second.dims.select("mid", F.col("m").alias("m2"), F.col("n").alias("n2")), "mid")
    bad = delta_problems(first, second, special)
    s = special.join(bad, "mid", "left_anti").join(sizes, "mid")
    a, d = first.entries.join(s, "mid"), second.entries.join(s, "mid")
    up, left = _rank_of("r", "row"), _rank_of("c", "x", "y")
    down, right = F.col("m1") - 1 + _rank_of("r", "row2"), F.col("n1") - 2 + _rank_of("c", "u", "w")
    in_first, in_second = F.col("c").isin(F.col("x"), F.col("y")), F.col("c").isin(F.col("u"), F.col("w"))
    blocks = [
        a.where((F.col("r") != F.col("row")) & ~in_first).select("mid", up.alias("r"), left.alias("c"), "v"),
        d.where((F.col("r") != F.col("row2")) & ~in_second).select("mid", down.alias("r"), right.alias("c"), "v"),
    ]
    lines = [
        (a.where((F.col("r") != F.col("row")) & (F.col("c") == F.col("x"))).select("mid", up.alias("r"), F.col("v").alias("p")), d.where((F.col("r") == F.col("row2")) & ~in_second).select("mid", right.alias("c"), F.col("v").alias("q"))),
        (d.where((F.col("r") != F.col("row2")) & (F.col("c") == F.col("u"))).select("mid", down.alias("r"), F.col("v").alias("p")), a.where((F.col("r") == F.col("row")) & ~in_first).select("mid", left.alias("c"), F.col("v").alias("q"))),
    ]
    blocks += [column.join(row, "mid").select("mid", "r", "c", residue(F.col("p") * F.col("q"), char).alias("v")) for column, row in lines]
    entries = blocks[0]
    for b in blocks[1:]:
        entries = entries.unionByName(b)
    dims = s.select("mid", (F.col("m1") + F.col("m2") - 2).alias("m"), (F.col("n1") + F.col("n2") - 4).alias("n"))
    return Matrices(dims, entries.where("v <> 0"))


def y_sum(first: Matrices, second: Matrices, special: DataFrame, char: int = 3) -> Matrices:
    """The delta-sum of the transposes, transposed; ``special(mid, col, x, y, col2, u, w)``
    with special rows x, y, u and w."""
    turned = special.select("mid", F.col("col").alias("row"), "x", "y", F.col("col2").alias("row2"), "u", "w")
    return transpose(delta_sum(transpose(first), transpose(second), turned, char))


def three_sum(first: Matrices, second: Matrices, special: DataFrame, char: int = 3) -> Matrices:
    """[A 0; C D] of parts that share a 2 x 2 block N of the rows i, j and columns k, l:
    first [A 0; C_ij *], whose column ``extra`` stands for the second part, and second
    [* 0; C_kl D], whose row ``top`` stands for the first; C = C_kl N^-1 C_ij.

    ``special(mid, i, j, k, l, extra, top, i2, j2, k2, l2)``.  Pairs whose blocks differ or
    are singular give none.  C is one join per matrix over the two inner lines."""
    s = special.join(first.dims.select("mid", F.col("m").alias("m1"), F.col("n").alias("n1")), "mid").join(second.dims.select("mid", F.col("m").alias("m2"), F.col("n").alias("n2")), "mid")

    def block(ms: Matrices, rows: tuple[str, str], cols: tuple[str, str], names: str) -> DataFrame:
        e = ms.entries.join(special, "mid")
        cells = [F.coalesce(F.max(F.when((F.col("r") == F.col(r)) & (F.col("c") == F.col(c)), F.col("v"))), F.lit(0)).cast("int").alias(f"{names}{x}{y}") for x, r in enumerate(rows) for y, c in enumerate(cols)]
        return e.groupBy("mid").agg(*cells)

    n = block(first, ("i", "j"), ("k", "l"), "p").join(block(second, ("i2", "j2"), ("k2", "l2"), "q"), "mid").withColumn("det", F.expr("p00 * p11 - p01 * p10"))
    n = n.where("p00 = q00 AND p01 = q01 AND p10 = q10 AND p11 = q11").where("abs(det) = 1" if char != 2 else "det % 2 <> 0")
    s = s.join(n.select("mid", "det", "p00", "p01", "p10", "p11"), "mid")
    a, d = first.entries.join(s, "mid"), second.entries.join(s, "mid")
    left, down = _rank_of("c", "extra"), F.col("m1") - 2 + _rank_of("r", "top")
    in_rows = F.col("r").isin(F.col("i"), F.col("j"))
    in_cols = F.col("c").isin(F.col("k2"), F.col("l2"))
    blocks = a.where(~in_rows & (F.col("c") != F.col("extra"))).select("mid", _rank_of("r", "i", "j").alias("r"), left.alias("c"), F.col("v").cast("int").alias("v"))
    blocks = blocks.unionByName(d.where((F.col("r") != F.col("top")) & ~in_cols).select("mid", down.alias("r"), (F.col("n1") - 1 + _rank_of("c", "k2", "l2")).alias("c"), F.col("v").cast("int").alias("v")))
    # C_kl times the inverse of N, by entry: the column that it meets in C_ij and the factor
    low = d.where((F.col("r") != F.col("top")) & in_cols).withColumn("second", (F.col("c") == F.col("l2")).cast("int"))
    to_i = F.when(F.col("second") == 0, F.col("p11")).otherwise(-F.col("p10")) * F.col("det")
    to_j = F.when(F.col("second") == 0, -F.col("p01")).otherwise(F.col("p00")) * F.col("det")
    low = low.select("mid", down.alias("r"), F.explode(F.array(F.struct(F.lit(0).alias("line"), (to_i * F.col("v")).alias("x")), F.struct(F.lit(1).alias("line"), (to_j * F.col("v")).alias("x")))).alias("e")).select("mid", "r", "e.line", "e.x")
    across = a.where(in_rows & (F.col("c") != F.col("extra"))).select("mid", (F.col("r") == F.col("j")).cast("int").alias("line"), left.alias("c"), F.col("v").alias("y"))
    c = low.join(across, ["mid", "line"]).groupBy("mid", "r", "c").agg(residue(F.sum(F.col("x") * F.col("y")), char).alias("v"))
    dims = s.select("mid", (F.col("m1") + F.col("m2") - 3).alias("m"), (F.col("n1") + F.col("n2") - 3).alias("n"))
    return Matrices(dims, blocks.unionByName(c).where("v <> 0"))


PARTS = "mid long, part int, m int, n int, cells array<struct<r: int, c: int, v: int>>"


def parts(ms: Matrices, separations_: DataFrame, kind: str) -> DataFrame:
    """``mid, part, m, n, cells`` (part 0 and 1): matrices taken apart along
    ``separations_(mid, rows, cols)``, the rows and columns of the first part.  ``kind``:
    TWOSUM, DELTASUM, YSUM or THREESUM; what can't be taken apart so is left out.  Special
    lines come last in first parts and first in second ones."""
    take = {"TWOSUM": dense_sums.two_sum_parts, "DELTASUM": separations.delta_parts, "YSUM": separations.y_parts, "THREESUM": separations.three_parts}[kind]
    # the separation travels as entries of its own, in two lines under each matrix
    marks = separations_.join(ms.dims, "mid").select("mid", "m", "n", F.concat(F.transform("rows", lambda i: -1 - i), F.transform("cols", lambda j: 1 + j)).alias("marks"))
    rows = marks.select("mid", F.explode("marks").alias("x"), "m", "n")
    line = F.when(F.col("x") < 0, F.col("m")).otherwise(F.col("m") + 1)
    e = ms.entries.select("mid", "r", "c", F.col("v").cast("int").alias("v")).unionByName(rows.select("mid", line.alias("r"), F.when(F.col("x") < 0, -1 - F.col("x")).otherwise(F.col("x") - 1).alias("c"), F.lit(1).alias("v")))
    dims = marks.select("mid", (F.col("m") + 2).alias("m"), F.greatest("m", "n").alias("n")).join(ms.dims.select("mid", F.col("n").alias("width")), "mid")

    def run(mid, b):
        size = b[-1][-1]
        b = [r[:-1] for r in b]
        m = len(b) - 2
        rows_, cols = [i for i, v in enumerate(b[m]) if v and i < m], [j for j, v in enumerate(b[m + 1]) if v]
        try:
            got = take([r[:size] for r in b[:m]], rows_, cols)
        except ValueError:
            return []
        return [(mid, k, len(x), len(x[0]) if x else 0, [{"r": i, "c": j, "v": v} for i, r in enumerate(x) for j, v in enumerate(r) if v]) for k, x in enumerate(got[:2])]

    # one more column, whose last entry is the matrix's width
    e = e.unionByName(dims.select("mid", (F.col("m") - 1).alias("r"), F.col("n").alias("c"), F.col("width").alias("v")))
    return per_matrix(Matrices(dims.select("mid", "m", (F.col("n") + 1).alias("n")), e), run, PARTS)


def part_matrices(found: DataFrame, part: int) -> Matrices:
    """The first (0) or second (1) parts of :func:`parts` as a collection."""
    some = found.where(F.col("part") == part)
    return Matrices(some.select("mid", "m", "n"), some.select("mid", F.explode("cells").alias("x")).select("mid", "x.r", "x.c", "x.v"))


def part_sizes(parts: DataFrame) -> DataFrame:
    """Sizes of a separation ``parts(mid, element, part)``."""
    axis = F.when(F.col("element") < 0, "r").otherwise("c").alias("axis")
    return parts.groupBy("mid", axis, "part").agg(F.count("*").alias("size"))


def off_diagonal(ms: Matrices, parts: DataFrame) -> DataFrame:
    """``mid, block, r, c, v``: entries whose row and column lie in different parts (0 or 1);
    block ``low`` has rows of part 1."""
    row = parts.where("element < 0").select("mid", (-1 - F.col("element")).alias("r"), F.col("part").alias("row_part"))
    col = parts.where("element > 0").select("mid", (F.col("element") - 1).alias("c"), F.col("part").alias("col_part"))
    e = ms.entries.join(row, ["mid", "r"]).join(col, ["mid", "c"]).where("row_part <> col_part")
    return e.select("mid", F.when(F.col("row_part") == 1, "low").otherwise("high").alias("block"), "r", "c", "v")


def not_rank_one(ms: Matrices, parts: DataFrame) -> DataFrame:
    """``mid, block``: off-diagonal blocks whose nonzero rows aren't multiples of one."""
    rows = off_diagonal(ms, parts).groupBy("mid", "block", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    rows = rows.withColumn("x", F.expr("transform(x, e -> struct(e.c AS c, e.v * signum(x[0].v) AS v))"))
    return rows.groupBy("mid", "block").agg(F.countDistinct("x").alias("kinds")).where("kinds > 1").select("mid", "block")


def representatives(ms: Matrices, parts: DataFrame) -> DataFrame:
    """``mid, block, r``: the first row of each kind (up to sign) in the off-diagonal
    blocks."""
    rows = off_diagonal(ms, parts).groupBy("mid", "block", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    rows = rows.withColumn("x", F.expr("transform(x, e -> struct(e.c AS c, e.v * signum(x[0].v) AS v))"))
    return rows.groupBy("mid", "block", "x").agg(F.min("r").alias("r")).select("mid", "block", "r")


def ternary_violators(ms: Matrices, parts: DataFrame) -> DataFrame:
    """``mid, r1, r2, c1, c2``: 2 x 2 submatrices of the off-diagonal blocks with
    determinant 2 or -2, which no ternary separation has."""
    e = off_diagonal(ms, parts)
    pair = e.select("mid", "block", "r", F.col("c").alias("c1"), F.col("v").alias("v1")).join(e.select("mid", "block", "r", F.col("c").alias("c2"), F.col("v").alias("v2")), ["mid", "block", "r"]).where("c1 < c2")
    other = pair.select("mid", "block", "c1", "c2", F.col("r").alias("r2"), F.col("v1").alias("w1"), F.col("v2").alias("w2"))
    both = pair.withColumnRenamed("r", "r1").join(other, ["mid", "block", "c1", "c2"]).where("r1 < r2")
    return both.where(F.abs(F.col("v1") * F.col("w2") - F.col("v2") * F.col("w1")) == 2).select("mid", "r1", "r2", "c1", "c2")
