"""Seeded generators of matrix collections: a matrix for each row of a table with a ``mid``, or
for each of so many numbers.  Lots are md5 digests of seed, matrix and place, which SQL engines
agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structure
from ..model import Matrices, from_dense, per_matrix
from ..storage import counted, written


Made = int | DataFrame


def _lot(seed: int, *cols):
    """A number in [0, 1) for each row: the first 32 bits of a digest of the columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _ids(spark: SparkSession, made: Made) -> DataFrame:
    return spark.range(made).select(F.col("id").alias("mid")) if isinstance(made, int) else made.select(F.col("mid").cast("long").alias("mid"))


def _sized(spark: SparkSession, made: Made, m: int, n: int) -> DataFrame:
    return _ids(spark, made).select("mid", F.lit(m).alias("m"), F.lit(n).alias("n"))


def random_binary(spark: SparkSession, made: Made, m: int, n: int, p: float, seed: int = 1) -> Matrices:
    """Each entry is 1 with probability ``p``."""
    dims = _sized(spark, made, m, n)
    cells = dims.select("mid", F.explode(F.sequence(F.lit(0), F.lit(m * n - 1))).alias("k")).select("mid", F.expr(f"CAST(k div {n} AS INT)").alias("r"), F.expr(f"CAST(k % {n} AS INT)").alias("c"))
    return Matrices(dims, cells.where(_lot(seed, "mid", "r", "c") < p).withColumn("v", F.lit(1)))


def wheels(spark: SparkSession, orders: list[int] | DataFrame, modified: bool = False) -> Matrices:
    """W_k, for a list of orders or a table ``mid, k``, with ones on the diagonal and right of it, around the corner; ``modified``: the
    first two rows have ones from the fourth column on, too."""
    dims = orders.select("mid", F.col("k").cast("int").alias("k")) if isinstance(orders, DataFrame) else spark.createDataFrame(list(enumerate(orders)), "mid long, k int")
    rows = dims.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    places = F.array(F.col("r"), (F.col("r") + 1) % F.col("k"))
    if modified:
        places = F.when((F.col("r") < 2) & (F.col("k") > 3), F.concat(places, F.sequence(F.lit(3), F.greatest(F.col("k") - 1, F.lit(3))))).otherwise(places)
    one = rows.select("mid", F.col("r").cast("int").alias("r"), F.explode(F.array_distinct(places)).alias("c"))
    return Matrices(dims.select("mid", F.col("k").alias("m"), F.col("k").alias("n")), one.withColumn("v", F.lit(1)))


def random_trees(spark: SparkSession, made: Made, nodes: int, extra: int, seed: int = 1) -> DataFrame:
    """``mid, element, tail, head, in_forest``: random trees with random further edges."""
    ids = _ids(spark, made)
    tree = ids.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(nodes - 1))))
    parent = F.floor(_lot(seed, "mid", "i", F.lit("t")) * F.col("i")).cast("int")
    turn = _lot(seed, "mid", "i", F.lit("d")) < 0.5
    tree = tree.select("mid", (-F.col("i")).cast("int").alias("element"), F.when(turn, parent).otherwise(F.col("i")).cast("int").alias("tail"), F.when(turn, F.col("i")).otherwise(parent).cast("int").alias("head"), F.lit(True).alias("in_forest"))
    rest = ids.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(extra))))
    end = lambda s: F.floor(_lot(seed, "mid", "j", F.lit(s)) * nodes).cast("int")
    return tree.unionByName(rest.select("mid", F.col("j").cast("int").alias("element"), end("u").alias("tail"), end("w").alias("head"), F.lit(False).alias("in_forest")))


def series_steps(spark: SparkSession, made: Made, base: int, lines: int, ternary: bool = True, seed: int = 1) -> DataFrame:
    """``mid, k, side, at, kind, target, s``: the lines of a growing matrix in turn.  The first
    ``2 * base`` ones are random rows and columns; each later one is a row or a column with
    nothing (zero), with s at the line ``target`` of the other side (unit), or s times the line
    ``target`` of its own side as it is then (copy)."""
    steps = _ids(spark, made).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * base + lines - 1))))
    side = F.when(F.col("k") < base, "r").when((F.col("k") < 2 * base) | (_lot(seed, "mid", "k", F.lit("side")) < 0.5), "c").otherwise("r")
    steps = steps.withColumn("side", side).withColumn("at", F.row_number().over(Window.partitionBy("mid", "side").orderBy("k")) - 1)
    kinds = F.element_at(F.array(F.lit("zero"), F.lit("unit"), F.lit("copy")), F.floor(_lot(seed, "mid", "k", F.lit("kind")) * 3).cast("int") + 1)
    others = F.col("k") - F.col("at")
    steps = steps.withColumn("kind", F.when(F.col("k") < 2 * base, "base").when((F.col("at") == 0) | (others == 0), "zero").otherwise(kinds))
    to = F.floor(_lot(seed, "mid", "k", F.lit("to")) * F.when(F.col("kind") == "unit", others).otherwise(F.col("at"))).cast("int")
    of = F.when(F.col("kind").isin("unit", "copy"), F.when((F.col("side") == "r") == (F.col("kind") == "copy"), "r").otherwise("c"))
    s = F.when(F.lit(ternary) & (_lot(seed, "mid", "k", F.lit("sign")) < 0.5), -1).otherwise(1)
    steps, _ = written(steps.withColumns({"to": to, "of": of, "s": s}), "series-steps")
    lines_ = steps.select("mid", F.col("side").alias("of"), F.col("at").alias("to"), F.col("k").alias("target"))
    return steps.join(lines_, ["mid", "of", "to"], "left").select("mid", "k", "side", "at", "kind", "target", "s")


def random_series_parallel(spark: SparkSession, made: Made, base: int, lines: int, ternary: bool = True, seed: int = 1) -> Matrices:
    """Random base matrices with ``lines`` zero, unit or copied lines put in one after another.

    A cell is what its later line says: s if that is a unit at the other one, and s times another
    cell, of the line that it copies, otherwise.  All cells follow such references at once; the
    rounds are as many as copies of copies."""
    steps, _ = written(series_steps(spark, made, base, lines, ternary, seed), "series-lines")
    of = lambda side, at, k: steps.where(F.col("side") == side).select("mid", F.col("at").alias(at), F.col("k").alias(k))
    open_ = of("r", "r", "x").join(of("c", "c", "y"), "mid").withColumn("s", F.lit(1))
    open_, _, (n,) = counted(open_, "series-open")
    rule = steps.select("mid", F.col("k").alias("later"), "kind", "target", F.col("s").alias("t"))
    done = []
    while n:
        now = open_.withColumn("later", F.greatest("x", "y")).join(rule, ["mid", "later"]).where("kind <> 'zero'")
        other = F.least("x", "y")
        found = now.where(((F.col("kind") == "unit") & (F.col("target") == other)) | ((F.col("kind") == "base") & (_lot(seed, "mid", "x", "y") < 0.5)))
        done.append(written(found.select("mid", "r", "c", (F.col("s") * F.when(F.col("kind") == "unit", F.col("t")).otherwise(1)).alias("v")), "series-found")[0])
        row_later = F.col("x") == F.col("later")
        x, y = F.when(row_later, F.col("target")).otherwise(F.col("x")), F.when(row_later, F.col("y")).otherwise(F.col("target"))
        open_, _, (n,) = counted(now.where("kind = 'copy'").select("mid", "r", "c", x.alias("x"), y.alias("y"), (F.col("s") * F.col("t")).alias("s")), "series-open")
    sizes = steps.groupBy("mid").agg(F.count_if(F.col("side") == "r").cast("int").alias("m"), F.count_if(F.col("side") == "c").cast("int").alias("n"))
    dims = _ids(spark, made).join(sizes, "mid", "left").select("mid", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("n", F.lit(0)).alias("n"))
    entries = spark.createDataFrame([], "mid long, r int, c int, v int")
    for d in done:
        entries = entries.unionByName(d)
    return Matrices(dims, entries)


def perturbed(ms: Matrices, chance: float, values: list[int], seed: int = 1) -> Matrices:
    """Each cell gets, with this chance, one of ``values`` instead of its own."""
    cells = (
        ms.dims.where("m > 0 AND n > 0")
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("mid", "r", "c")
        .join(ms.entries, ["mid", "r", "c"], "left")
    )
    other = F.element_at(F.array(*map(F.lit, values)), F.floor(_lot(seed, "mid", "r", "c", F.lit("v")) * len(values)).cast("int") + 1)
    v = F.when(_lot(seed, "mid", "r", "c") < chance, other).otherwise(F.coalesce("v", F.lit(0)))
    return Matrices(ms.dims, cells.select("mid", "r", "c", v.cast("int").alias("v")).where("v <> 0"))


def camion_signs(ms: Matrices) -> Matrices:
    """A ternary collection with Camion's signs from a 0/1 one."""
    rows = per_matrix(ms, lambda mid, a: [(mid, i, j, v) for i, r in enumerate(structure.camion(a)[0]) for j, v in enumerate(r) if v], "mid long, r int, c int, v int")
    return Matrices(ms.dims, rows)


def graphic(spark: SparkSession, made: Made, nodes: int, extra: int, signed: bool = False, seed: int = 1) -> Matrices:
    """Graphic (or network) matrices of random trees."""
    from ..operators.recognition import represented

    return represented(random_trees(spark, made, nodes, extra, seed), signed)


def networks(spark: SparkSession, made: Made, nodes: int, extra: int, seed: int = 1) -> Matrices:
    """Network matrices of random trees, as joins of nodes' ways to the root: row i - 1 is the
    edge of node i and its parent, and column j goes between two nodes."""
    from ..operators.trees import forest_matrix

    ids = _ids(spark, made)
    tree = ids.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    parents = tree.select("mid", "node", F.when(F.col("node") > 0, F.floor(_lot(seed, "mid", "node", F.lit("t")) * F.col("node")).cast("int")).alias("parent"))
    end = lambda s: F.floor(_lot(seed, "mid", "c", F.lit(s)) * nodes).cast("int").alias(s)
    pairs = ids.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(extra - 1)))).select("mid", "c", end("u"), end("w"))
    ms = forest_matrix(parents, pairs)
    turned = F.when(_lot(seed, "mid", "r", F.lit("d")) < 0.5, -F.col("v")).otherwise(F.col("v"))
    return Matrices(_sized(spark, made, nodes - 1, extra), ms.entries.withColumn("v", turned))


def graph_cograph_sums(spark: SparkSession, made: Made, nodes: int, extra: int, pivots: int = 2, seed: int = 1) -> Matrices:
    """Delta-sums of graphic matrices along a triangle and cographic ones along a node of
    degree three, with Camion's signs, some ternary pivots and lines in random order: totally
    unimodular matrices of some ``2 * nodes + extra`` lines a side that, as a rule, are neither
    graphic nor cographic."""
    import random

    from ..functions import graphs, sums

    def tree(rng):
        return {i: (rng.randrange(i + 1), i + 1) for i in range(nodes - 1)}

    def drawn(mid, _):
        rng = random.Random(seed * 1_000_003 + mid)
        # a triangle: the last tree edge, and two columns whose paths differ in it
        forest, hub = tree(rng), rng.randrange(nodes)
        forest[nodes - 1] = (hub, nodes)
        far = rng.choice([x for x in range(nodes) if x != hub])
        chords = {j: tuple(rng.sample(range(nodes + 1), 2)) for j in range(extra)} | {extra: (far, hub), extra + 1: (far, nodes)}
        first = graphs.represented(forest, chords)
        # a node of degree three: a tree edge cut in two, and one chord at the cut
        edges = list(tree(rng).values())
        a, b = edges.pop(rng.randrange(len(edges)))
        forest = dict(enumerate([(a, nodes), (nodes, b), *edges]))
        chords = {0: (nodes, rng.randrange(nodes))} | {1 + j: tuple(rng.sample(range(nodes), 2)) for j in range(extra)}
        second = [list(c) for c in zip(*graphs.represented(forest, chords))]
        if not second[0][0]:
            second = [[r[1], r[0], *r[2:]] for r in second]
        m = structure.camion(sums.delta_sum(first, second, nodes - 1, (extra, extra + 1), 0, (0, 1), 2))[0]
        for _ in range(pivots):
            p, q = rng.choice([(i, j) for i, r in enumerate(m) for j, v in enumerate(r) if v])
            x = m[p][q]
            m = [[-x if (i, j) == (p, q) else x * v if i == p or j == q else sums.residue(v - x * m[i][q] * m[p][j], 3) for j, v in enumerate(r)] for i, r in enumerate(m)]
        for _ in range(2):
            rng.shuffle(m)
            m = [list(c) for c in zip(*m)]
        return [(mid, len(m), len(m[0]), [{"r": i, "c": j, "v": v} for i, r in enumerate(m) for j, v in enumerate(r) if v])]

    empty = Matrices(_sized(spark, made, 0, 0), spark.createDataFrame([], "mid long, r int, c int, v int"))
    found = per_matrix(empty, drawn, "mid long, m int, n int, cells array<struct<r: int, c: int, v: int>>")
    return Matrices(found.select("mid", "m", "n"), found.select("mid", F.explode("cells").alias("x")).select("mid", "x.r", "x.c", "x.v"))


def literals(spark: SparkSession, names: list[str], made: DataFrame | None = None) -> Matrices:
    """Named matrices; with a table ``mid, k`` the k-th of them for each of its rows."""
    from ..functions.recognise import named

    ms = from_dense(spark, {i: named(x) for i, x in enumerate(names)})
    if made is None:
        return ms
    kind = lambda df: F.broadcast(df.withColumnRenamed("mid", "k"))  # noqa: E731  a few rows for each name
    of = made.select(F.col("mid").cast("long").alias("mid"), F.col("k").cast("long").alias("k"))
    return Matrices(of.join(kind(ms.dims), "k").select("mid", "m", "n"), of.join(kind(ms.entries), "k").select("mid", "r", "c", "v"))


