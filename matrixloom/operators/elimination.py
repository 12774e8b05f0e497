"""Exact elimination of all matrices at once, in rounds over their entries.

In a round each row that is left names its least entry.  Of the rows whose entries stand in
each other's columns the one with the least is taken, by a fixed order; those that are taken
have nothing in each other's columns, so their operations don't meet, and a sparse matrix
takes many steps at once.  Multiples of the taken rows (rounded quotients) are taken from the
others, as Euclid does; once these have nothing in a pivot's column, its row is done.  Only
multiples of one row are added to another, so a transformation of determinant 1 takes the
matrix to its echelon form; it is kept as further columns that the operations go through, too.

Pivots are an aggregate, operations a join of a column's entries with a row's and a sum by
place with a partial one before the shuffle; each round is written to the shared folder.
Matrices that are done cost nothing more.  Numbers have up to 38 digits; a matrix with longer
ones gets the status OVERFLOW.

A task takes each matrix of up to ``model.WHOLE`` nonzeros through the same rounds by itself, after one
shuffle; larger ones go by joins.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entries as one_matrix
from ..model import Matrices, whole
from ..storage import counted, delete, written

NUMBER = "decimal(38,0)"


class Echelon:
    """``rows(mid, r, c, v, own)``: the echelon form's entries by original row and column
    (``own``) and the transformation's (column c stands for the original row c);
    ``pivots(mid, k, r, c, v)`` in order; ``overflown(mid)``."""

    def __init__(self, rows: DataFrame, pivots: DataFrame, overflown: DataFrame):
        self.rows, self.pivots, self.overflown = rows, pivots, overflown

    def form(self) -> DataFrame:
        return self.rows.where("own").drop("own")

    def transformation(self) -> DataFrame:
        return self.rows.where("NOT own").drop("own")


def _taken(live: DataFrame) -> DataFrame:
    """``mid, pr, pc, p``: pivots, of which no one's row has an entry in another's column."""
    least = F.min(F.struct(F.abs("v").alias("size"), F.xxhash64("mid", "r").alias("lot"), "c", "v")).alias("x")
    named = live.groupBy("mid", "r").agg(least).select("mid", F.col("r").alias("pr"), F.col("x.c").alias("pc"), F.col("x.v").alias("p"), F.struct("x.size", "x.lot", "r").alias("rank"))
    theirs = named.select("mid", F.col("pr").alias("r"), F.col("rank").alias("other"))
    meet = live.select("mid", "r", F.col("c").alias("pc")).join(named, ["mid", "pc"]).where("r <> pr").join(theirs, ["mid", "r"])
    later = F.when(F.col("rank") > F.col("other"), F.col("pr")).otherwise(F.col("r"))
    return named.drop("rank").join(meet.select("mid", later.alias("pr")), ["mid", "pr"], "left_anti")


def _step(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next pivots ``mid, pr, pc, p, cleared`` and the entries after their operations."""
    live = state.where("own")
    pivot, _ = written(_taken(live), "echelon-taken")
    column = live.select("mid", "r", F.col("c").alias("pc"), "v").join(pivot, ["mid", "pc"]).where("r <> pr").select("mid", "r", "pr", _quotient(), "v", "p")
    rest = F.try_subtract("v", F.try_multiply("f", "p").cast(NUMBER))
    left = column.where(F.coalesce(rest != 0, F.lit(True))).select("mid", "pr").distinct().withColumn("left", F.lit(True))
    pivot = pivot.join(left, ["mid", "pr"], "left").select("mid", "pr", "pc", "p", F.col("left").isNull().alias("cleared"))
    return pivot, _changed(state, pivot, column)


def _changed(state: DataFrame, pivot: DataFrame, column: DataFrame) -> DataFrame:
    """``state`` after ``column(mid, pr, r, f)``: f times row pr is taken from row r; ``bad``
    where a number is too long."""
    row = state.withColumnRenamed("r", "pr").join(pivot.select("mid", "pr"), ["mid", "pr"]).select("mid", "pr", "c", "own", F.col("v").alias("w"))
    change = column.select("mid", "pr", "r", "f").join(row, ["mid", "pr"]).select("mid", "r", "c", "own", (-F.try_multiply("f", "w")).cast(NUMBER).alias("v"))
    both = state.select("mid", "r", "c", "own", "v").unionByName(change)
    summed = both.groupBy("mid", "r", "c", "own").agg(F.try_sum("v").cast(NUMBER).alias("v"), F.max(F.col("v").isNull()).alias("bad"))
    return summed.withColumn("bad", F.col("bad") | F.col("v").isNull()).where("bad OR v <> 0")


def _quotient() -> Column:
    return F.round(F.try_divide("v", "p"), 0).cast(NUMBER).alias("f")


def column_echelon(ms: Matrices) -> Echelon:
    """Echelon forms column by column: in the end no two rows have their first entries in one
    column.  The pivots' columns are the first ones that are independent, and the product of
    the pivots is the greatest common divisor of these columns' largest minors, up to sign.

    In each round, of all rows that begin in one column, the one with the least entry there
    is taken from the others."""
    spark = ms.dims.sparkSession
    state, path = written(_start(ms), "echelon-state")
    overflown = spark.createDataFrame([], "mid long")
    while True:
        first = state.groupBy("mid", "r").agg(F.min(F.struct("c", "v")).alias("x")).select("mid", "r", F.col("x.c").alias("c"), F.col("x.v").alias("v"))
        pivot = first.groupBy("mid", "c").agg(F.min(F.struct(F.abs("v").alias("size"), "r", "v")).alias("x"), F.count("*").alias("k")).where("k > 1").select("mid", "c", F.col("x.r").alias("pr"), F.col("x.v").alias("p"))
        pivot, pivot_path, (n,) = counted(pivot, "echelon-taken")
        if not n:
            break
        column = first.join(pivot, ["mid", "c"]).where("r <> pr").select("mid", "pr", "r", _quotient())
        after, after_path, (_, bad) = counted(_changed(state, pivot, column), "echelon-state", F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)))
        if bad:
            gone = after.where("bad").select("mid").distinct()
            overflown, after = overflown.unionByName(gone), after.join(gone, "mid", "left_anti")
        else:
            delete(spark, path)
            path = after_path
        delete(spark, pivot_path)
        state = after.select("mid", "r", "c", "own", "v")
    return Echelon(state, first.select("mid", F.col("c").alias("k"), "r", "c", "v"), overflown)


def _start(ms: Matrices) -> DataFrame:
    return ms.entries.select("mid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(True).alias("own"), F.col("v").cast(NUMBER).alias("v"))


def echelon(ms: Matrices, keep: bool = True) -> Echelon:
    """Echelon forms with least pivots; ``keep``: whether with the transformations."""

    def one(m, n, cells):
        own: dict[int, dict] = {}
        lots = {}
        for r, c, x in cells:
            own.setdefault(r, {})[c], lots[r] = int(x["v"]), x["lot"]
        units = {r: {r: 1} for r in range(m)} if keep else {}
        try:
            pivots = one_matrix.echelon(own, units, lots)
        except one_matrix.Overflow:
            return True, None, None
        rows = [(r, c, Decimal(v), mine) for part, mine in ((own, True), (units, False)) for r, row in part.items() for c, v in row.items()]
        return False, rows, [(k, r, c, Decimal(v)) for k, r, c, v in pivots]

    kind = f"over boolean, rows array<struct<r: int, c: int, v: {NUMBER}, own: boolean>>, pivots array<struct<k: int, r: int, c: int, v: {NUMBER}>>"
    value = F.struct(F.col("v").cast(NUMBER).alias("v"), F.xxhash64("mid", F.col("r").cast("int")).alias("lot"))
    small, large = whole(ms, one, kind, "echelon-whole", value)
    rows = small.select("mid", F.explode("rows").alias("x")).select("mid", "x.r", "x.c", "x.v", "x.own").select("mid", "r", "c", "own", "v")
    pivots = small.select("mid", F.explode("pivots").alias("x")).select("mid", "x.k", "x.r", "x.c", "x.v")
    found = Echelon(rows, pivots, small.where("over").select("mid"))
    if large is None:
        return found
    more = _echelon(large, keep)
    return Echelon(rows.unionByName(more.rows), pivots.unionByName(more.pivots), found.overflown.unionByName(more.overflown))


def _echelon(ms: Matrices, keep: bool) -> Echelon:
    spark = ms.dims.sparkSession
    state = _start(ms)
    if keep:
        unit = ms.dims.where("m > 0").select("mid", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("r"))
        state = state.unionByName(unit.select("mid", "r", F.col("r").alias("c"), F.lit(False).alias("own"), F.lit(1).cast(NUMBER).alias("v")))
    own = F.coalesce(F.sum(F.col("own").cast("long")), F.lit(0))
    state, path, (_, n) = counted(state, "echelon-state", own)
    rows = state.limit(0)
    pivots = spark.createDataFrame([], f"mid long, k int, r int, c int, v {NUMBER}")
    overflown = spark.createDataFrame([], "mid long")
    k = 0
    while n:
        pivot, summed = _step(state)
        pivot, _ = written(pivot, "echelon-pivots")
        # rows that are done leave the state with what they have
        done = pivot.where("cleared").select("mid", F.col("pr").alias("r"), F.lit(True).alias("done"))
        after, after_path, (_, bad, ended) = counted(
            summed.join(done, ["mid", "r"], "left").withColumn("done", F.coalesce("done", F.lit(False))), "echelon-after", F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("done").cast("long")), F.lit(0))
        )
        if bad:
            gone = after.where("bad").select("mid").distinct()
            overflown, after = overflown.unionByName(gone), after.join(gone, "mid", "left_anti")
        if ended:
            rows = rows.unionByName(after.where("done").select("mid", "r", "c", "own", "v"))
            pivots = pivots.unionByName(pivot.where("cleared").select("mid", F.lit(k).alias("k"), F.col("pr").alias("r"), F.col("pc").alias("c"), F.col("p").alias("v")))
        live = after.where("NOT done").select("mid", "r", "c", "own", "v")
        state, new_path, (_, n) = counted(live, "echelon-state", own)
        delete(spark, path)
        path, k = new_path, k + 1
    rows = rows.unionByName(state)
    out = lambda df: df.join(overflown, "mid", "left_anti")
    return Echelon(out(rows), out(pivots), overflown)


def _products(found: Echelon) -> DataFrame:
    """``mid, rank, product, sign``: the pivots' number, their product (null if it is too long)
    and the sign of the order that they put rows and columns in."""
    x = found.pivots.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("k", "r", "c", "v"))).alias("x")).withColumn("x", F.transform("x", lambda e, i: F.struct(i.alias("k"), e["r"].alias("r"), e["c"].alias("c"), e["v"].alias("v"))))
    product = F.aggregate(F.col("x.v"), F.lit(1).cast(NUMBER), lambda acc, v: F.try_multiply(acc, v).cast(NUMBER))
    turned = F.aggregate("x", F.lit(0), lambda n, a: n + F.size(F.filter("x", lambda b: (b.k > a.k) & ((b.r < a.r) != (b.c < a.c)))))
    return x.select("mid", F.size("x").alias("rank"), product.alias("product"), F.when(turned % 2 == 0, 1).otherwise(-1).alias("sign"))


def determinants(ms: Matrices) -> DataFrame:
    """``mid, det, status``: exact, as a decimal string; INPUT if a matrix isn't square, OVERFLOW
    if numbers are too long."""

    def one(m, n, cells):
        if m != n:
            return None, "INPUT"
        try:
            pivots = one_matrix.column_echelon([(r, c, int(v)) for r, c, v in cells])
        except one_matrix.Overflow:
            return None, "OVERFLOW"
        product, sign = one_matrix.product(pivots)
        if len(pivots) < m:
            return "0", "OK"
        return (None, "OVERFLOW") if product is None else (str(product * sign), "OK")

    small, large = whole(ms, one, "det string, status string", "elimination-determinants", F.col("v").cast(NUMBER))
    return small if large is None else small.unionByName(_determinants(large))


def _determinants(ms: Matrices) -> DataFrame:
    square = ms.where("m = n")
    found = column_echelon(square)
    told = ms.dims.join(_products(found), "mid", "left").join(found.overflown.withColumn("over", F.lit(True)), "mid", "left")
    full = F.coalesce("rank", F.lit(0)) == F.col("m")
    value = F.when(F.col("m") == 0, F.lit(1).cast(NUMBER)).when(~full, F.lit(0).cast(NUMBER)).otherwise(F.col("product") * F.col("sign").cast("decimal(1,0)"))
    status = F.when(F.col("m") != F.col("n"), "INPUT").when(F.col("over") | (full & (F.col("m") > 0) & F.col("product").isNull()), "OVERFLOW").otherwise("OK")
    return told.select("mid", status.alias("status"), value.cast(NUMBER).cast("string").alias("d")).select("mid", F.when(F.col("status") == "OK", F.col("d")).alias("det"), "status")


def diagonals(ms: Matrices) -> DataFrame:
    """``mid, rank, product``: rank and the product of the pivots of :func:`column_echelon`, up to
    sign; nulls if numbers are too long."""

    def one(m, n, cells):
        try:
            pivots = one_matrix.column_echelon([(r, c, int(v)) for r, c, v in cells])
        except one_matrix.Overflow:
            return None, None
        product, _ = one_matrix.product(pivots)
        return len(pivots), None if product is None else str(abs(product))

    small, large = whole(ms, one, "rank int, product string", "elimination-diagonals", F.col("v").cast(NUMBER))
    return small if large is None else small.unionByName(_diagonals(large))


def _diagonals(ms: Matrices) -> DataFrame:
    found = column_echelon(ms)
    told = ms.dims.select("mid").join(_products(found), "mid", "left").join(found.overflown.withColumn("over", F.lit(True)), "mid", "left")
    rank, product = F.coalesce("rank", F.lit(0)), F.when(F.col("rank").isNull(), F.lit(1).cast(NUMBER)).otherwise(F.abs("product"))
    fits = F.col("over").isNull()
    return told.select("mid", F.when(fits, rank).alias("rank"), F.when(fits, product.cast("string")).alias("product"))


def transformed(ms: Matrices, found: Echelon) -> DataFrame:
    """``mid, r, c, v``: the transformations times the matrices, to hold against the forms."""
    t = found.transformation().select("mid", "r", F.col("c").alias("i"), F.col("v").alias("x"))
    a = ms.entries.select("mid", F.col("r").cast("int").alias("i"), F.col("c").cast("int").alias("c"), F.col("v").cast("decimal(19,0)").alias("y"))
    return t.join(a, ["mid", "i"]).groupBy("mid", "r", "c").agg(F.sum((F.col("x") * F.col("y")).cast(NUMBER)).cast(NUMBER).alias("v")).where("v <> 0")
