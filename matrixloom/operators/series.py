"""Series-parallel reductions of matrices of any size, in rounds over their entries.

A round takes away all lines at once that can go: those with one nonzero, and all but the
first of lines that are copies of each other (up to sign, if ternary).  Neither keeps another
from going: a line that stays for its copies has two nonzeros or more, and a row and a column
that have only their common entry go one after the other.  Lines get fingerprints (the
exclusive or of their entries' hashes, and of their negatives'), so copies meet by one key;
then their entries are compared, so a collision costs a round and no result.  Lines without
nonzeros go last.

A round is two jobs, each written to the shared folder: the lines that go, and the entries
that stay.  Each deals the entries that are left to tasks by matrix, once, unless a matrix is
too large for that.  No line and no matrix is ever in one row; each round costs what is left.
There are as many rounds as reductions depend on each other.

:func:`left_over`, :func:`series_parallel` and :func:`replays` take rounds for matrices of more than
``model.WHOLE`` nonzeros only; a task goes through each smaller one, after one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entries import near_of, reduced, sides, wrong
from ..model import Matrices, whole
from ..storage import by_shuffles, counted, dealing, delete, written
from .blocks import lines
from .paths import adjacency, place

STEPS = "mid long, step int, element int, mate int"
LISTED = "is_sp boolean, reductions array<struct<element: int, mate: int>>, rows array<int>, cols array<int>"


def _hash(value, seed: int):
    return F.xxhash64(F.lit(seed), F.col("b"), value)


def _round(cells: DataFrame, ternary: bool, seed: int) -> DataFrame:
    """``mid, element, mate, fine``: lines with one nonzero and lines that have the fingerprint
    of an earlier one, the latter fine if their entries agree."""
    both = adjacency(Matrices(None, cells))
    negative = _hash(-F.col("v"), seed) if ternary else _hash(F.col("v"), seed)
    marks = [F.count("*").alias("degree"), F.bit_xor(_hash(F.col("v"), seed)).alias("x"), F.bit_xor(negative).alias("y"), F.min("b").alias("b")]
    found = both.groupBy("mid", "a").agg(*marks)
    ones = found.where("degree = 1").groupBy("mid", F.least("a", "b").alias("row"), F.greatest("a", "b").alias("column")).agg(F.min("a").alias("element"))
    units = ones.select("mid", "element", F.when(F.col("element") < 0, F.col("column")).otherwise(F.col("row")).alias("mate"), F.lit(True).alias("fine"))
    more = found.where("degree > 1").select("mid", "a", "degree", "x", (F.col("a") > 0).alias("side"), F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
    key = ["mid", "side", "degree", "low", "high"]
    firsts = more.groupBy(*key).agg(F.min(F.struct(place("a").alias("p"), "a", "x")).alias("f"), F.count("*").alias("n")).where("n > 1").select(*key, F.col("f.a").alias("mate"), F.col("f.x").alias("fx"))
    pairs = more.join(firsts, key).where("a <> mate").select("mid", "a", "mate", "degree", F.when(F.col("x") == F.col("fx"), 1).otherwise(-1).alias("s"))
    mine = both.join(pairs, ["mid", "a"]).select("mid", "a", "mate", "degree", "b", (F.col("v") * F.col("s")).alias("v"))
    theirs = both.select("mid", F.col("a").alias("mate"), "b", "v", F.lit(1).alias("same"))
    compared = mine.join(theirs, ["mid", "mate", "b", "v"], "left").groupBy("mid", "a", "mate", "degree").agg(F.count("same").alias("same"))
    return units.unionByName(compared.select("mid", F.col("a").alias("element"), "mate", (F.col("same") == F.col("degree")).alias("fine")))


def _without(cells: DataFrame, gone: DataFrame) -> DataFrame:
    rows = gone.where("element < 0").select("mid", (-1 - F.col("element")).alias("r"))
    columns = gone.where("element > 0").select("mid", (F.col("element") - 1).alias("c"))
    return cells.join(rows, ["mid", "r"], "left_anti").join(columns, ["mid", "c"], "left_anti")


@by_shuffles
def reductions(ms: Matrices, ternary: bool = True) -> tuple[DataFrame, DataFrame]:
    """``mid, step, element, mate`` and the entries of what is left.

    Lines of one step go in any order, rows before columns.  ``mate``: the line that the only
    nonzero also stands in, or the line that this one is a copy of; 0 for lines without
    nonzeros, which go in the last step."""
    spark = ms.dims.sparkSession
    e = ms.entries.select("mid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("int").alias("v"))
    cells, path, (n,) = counted(e, "series-cells")
    dealt = dealing(cells)
    steps, step = spark.createDataFrame([], STEPS), 0
    while n:
        gone, gone_path, (seen, fine) = counted(_round(dealt(cells), ternary, step), "series-gone", F.coalesce(F.sum(F.col("fine").cast("long")), F.lit(0)))
        if not seen:
            break
        if fine:
            gone = gone.where("fine")
            steps = steps.unionByName(gone.select("mid", F.lit(step).alias("step"), "element", "mate"))
            cells, new_path, (n,) = counted(_without(dealt(cells), gone).select("mid", "r", "c", "v"), "series-cells")
            delete(spark, path)
            path = new_path
        else:
            delete(spark, gone_path)
        step += 1
    left = adjacency(Matrices(None, cells)).select("mid", F.col("a").alias("element")).distinct()
    empty = lines(ms).join(steps.select("mid", "element").unionByName(left), ["mid", "element"], "left_anti")
    zeros = empty.select("mid", F.lit(step).alias("step"), F.col("element").cast("int").alias("element"), F.lit(0).alias("mate"))
    return steps.unionByName(written(zeros, "series-zeros")[0]), cells


@by_shuffles
def left_over(ms: Matrices, ternary: bool = True) -> DataFrame:
    """``mid, is_sp, rows, cols, nonzeros``: how much no reduction takes away."""

    def one(m, n, cells):
        near = near_of(cells)
        reduced(near, ternary)
        rows = [x for x in near if x < 0]
        return not rows, len(rows), len(near) - len(rows), sum(len(near[x]) for x in rows)

    small, large = whole(ms, one, "is_sp boolean, rows long, cols long, nonzeros long", "series-left")
    return small if large is None else small.unionByName(_left_over(large, ternary))


def _left_over(ms: Matrices, ternary: bool) -> DataFrame:
    _, cells = reductions(ms, ternary)
    size = cells.groupBy("mid", "r").agg(F.count("*").alias("k")).groupBy("mid").agg(F.count("*").alias("rows"), F.sum("k").alias("nonzeros"))
    columns = cells.select("mid", "c").distinct().groupBy("mid").agg(F.count("*").alias("cols"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ms.dims.select("mid").join(size.join(columns, "mid"), "mid", "left").select("mid", F.col("rows").isNull().alias("is_sp"), zero("rows"), zero("cols"), zero("nonzeros"))
    return written(out, "series-left")[0]


def _all_steps(m: int, n: int, near: dict, ternary: bool) -> list[tuple[int, int, int]]:
    """``(step, element, mate)`` of one matrix in order, lines without nonzeros last; ``near`` keeps the rest."""
    steps = reduced(near, ternary)
    seen = near.keys() | {x[1] for x in steps}
    last = steps[-1][0] + 1 if steps else 0
    return steps + [(last, x, 0) for x in (*range(-1, -1 - m, -1), *range(1, n + 1)) if x not in seen]


@by_shuffles
def series_parallel(ms: Matrices, ternary: bool = True) -> DataFrame:
    """``mid, is_sp, reductions, rows, cols``: the reductions of each matrix in order and the
    lines that they leave, as lists; :func:`reductions` and :func:`left_over` keep them apart."""

    def one(m, n, cells):
        near = near_of(cells)
        steps = _all_steps(m, n, near, ternary)
        rows, cols = sides(near)
        return not rows, [x[1:] for x in steps], rows, cols

    small, large = whole(ms, one, LISTED, "series-listed")
    return small if large is None else small.unionByName(_series_parallel(large, ternary))


def _series_parallel(ms: Matrices, ternary: bool) -> DataFrame:
    steps, cells = reductions(ms, ternary)
    listed = steps.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("step", place("element").alias("p"), "element", "mate"))).alias("x"))
    listed = listed.select("mid", F.transform("x", lambda s: F.struct(s["element"].alias("element"), s["mate"].alias("mate"))).alias("reductions"))
    rest = cells.groupBy("mid").agg(F.array_sort(F.collect_set("r")).alias("rows"), F.array_sort(F.collect_set("c")).alias("cols"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = ms.dims.select("mid").join(listed, "mid", "left").join(rest, "mid", "left")
    out = out.select("mid", F.col("rows").isNull().alias("is_sp"), none("reductions", "array<struct<element:int,mate:int>>"), none("rows", "array<int>"), none("cols", "array<int>"))
    return written(out, "series-listed")[0]


@by_shuffles
def replayed(ms: Matrices, steps: DataFrame, ternary: bool = True) -> DataFrame:
    """``mid, wrong``: how many ``steps`` (as :func:`reductions` tells them) don't hold when
    they are gone through: a line must have no nonzero but that with its mate or agree with it
    on all lines that are there when it goes."""
    gone = steps.select("mid", F.col("element").alias("b"), "step", (F.col("element") > 0).alias("later"))
    both = adjacency(Matrices(None, dealing(ms.entries)(ms.entries))).join(gone, ["mid", "b"], "left")
    due = steps.select("mid", "element", "mate", F.col("step").alias("t"))
    # what stands in a line when it goes: entries whose other line goes later, or in the same step after it
    alive = F.col("step").isNull() | (F.col("step") > F.col("t")) | ((F.col("step") == F.col("t")) & F.col("later") & (F.col("element") < 0))
    own = both.join(due.withColumn("a", F.col("element")), ["mid", "a"]).where(alive).select("mid", "element", "b", "v")
    like = both.join(due.withColumn("a", F.col("mate")), ["mid", "a"]).where(alive).select("mid", "element", "b", F.col("v").alias("w"))
    kinds = due.select("mid", "element", "mate", F.when(F.col("mate") == 0, 0).when((F.col("mate") < 0) == (F.col("element") < 0), 2).otherwise(1).alias("kind"))
    pairs = own.join(like, ["mid", "element", "b"], "full").groupBy("mid", "element").agg(
        F.count("v").alias("mine"), F.count("w").alias("theirs"), F.sum((F.col("v") == F.col("w")).cast("int")).alias("equal"), F.sum((F.col("v") == -F.col("w")).cast("int")).alias("opposite"), F.max(F.when(F.col("v").isNotNull(), F.col("b"))).alias("at")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    same = (n("equal") == n("mine")) | ((n("opposite") == n("mine")) & F.lit(ternary))
    holds = F.when(F.col("kind") == 0, n("mine") == 0).when(F.col("kind") == 1, (n("mine") == 1) & (F.col("at") == F.col("mate"))).otherwise((n("mine") == n("theirs")) & same)
    checked = kinds.join(pairs, ["mid", "element"], "left")
    out = ms.dims.select("mid").join(checked.groupBy("mid").agg(F.sum((~F.coalesce(holds, F.lit(False))).cast("long")).alias("wrong")), "mid", "left").select("mid", F.coalesce("wrong", F.lit(0)).alias("wrong"))
    return written(out, "series-replayed")[0]


@by_shuffles
def replays(ms: Matrices, ternary: bool = True) -> DataFrame:
    """``mid, steps, wrong``: how many reductions each matrix has, and how many don't hold when
    they are gone through, from its entries on (:func:`replayed`)."""

    def one(m, n, cells):
        steps = _all_steps(m, n, near_of(cells), ternary)
        return len(steps), wrong(near_of(cells), steps, ternary)

    small, large = whole(ms, one, "steps long, wrong long", "series-replays")
    return small if large is None else small.unionByName(_replays(large, ternary))


def _replays(ms: Matrices, ternary: bool) -> DataFrame:
    steps, _ = written(reductions(ms, ternary)[0], "series-steps")
    told = replayed(ms, steps, ternary).join(steps.groupBy("mid").agg(F.count("*").alias("n")), "mid", "left")
    return written(told.select("mid", F.coalesce("n", F.lit(0)).cast("long").alias("steps"), "wrong"), "series-replays")[0]
