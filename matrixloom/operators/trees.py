"""Graphic and network matrices of rooted forests, and attributes of decomposition trees, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import WHOLE, Matrices, dealer
from ..storage import by_shuffles, counted, delete, written


def _dealer(spark: SparkSession, rows: int, *tables: DataFrame):
    """Deals tables by matrix, to as many tasks as so many rows need; not if a matrix has more than ``WHOLE``
    rows of one of ``tables``, when each join shuffles by its own keys."""
    for t in tables:
        if (t.groupBy("mid").count().agg(F.max("count")).first()[0] or 0) > WHOLE:
            return lambda df: df
    return dealer(spark, rows)


@by_shuffles
def ancestors(parents: DataFrame) -> DataFrame:
    """``mid, node, edge``: the edges (each named by its lower node) on every node's way to
    its root, for ``parents(mid, node, parent)``.

    By doubling: in each round every node's way gets the way of the node at its end put on,
    so the number of rounds is the logarithm of the depth; each is written, so that a lost
    executor costs one round.  Tasks get a bounded number of ways, by matrix."""
    spark = parents.sparkSession
    inner, inner_path, (n,) = counted(parents.where("parent IS NOT NULL").select("mid", "node", "parent"), "tree-inner")
    deal = _dealer(spark, n, inner)
    ways, ways_path = written(inner.select("mid", "node", F.col("node").alias("edge")), "tree-ways")
    below = deal(inner.select("mid", F.col("node").alias("parent")))
    jumps, jumps_path = written(deal(inner).join(below, ["mid", "parent"], "left_semi").select("mid", "node", F.col("parent").alias("to")), "tree-jumps")
    delete(spark, inner_path)
    while not jumps.isEmpty():
        deal = _dealer(spark, 2 * n, jumps)
        on = deal(ways.select("mid", F.col("node").alias("to"), "edge"))
        more, more_path, (n,) = counted(ways.unionByName(deal(jumps).join(on, ["mid", "to"]).select("mid", "node", "edge")), "tree-ways")
        further = deal(jumps.select("mid", F.col("node").alias("to"), F.col("to").alias("next")))
        next_, next_path = written(deal(jumps).join(further, ["mid", "to"]).select("mid", "node", F.col("next").alias("to")), "tree-jumps")
        delete(spark, ways_path)
        delete(spark, jumps_path)
        ways, ways_path, jumps, jumps_path = more, more_path, next_, next_path
    return ways


@by_shuffles
def forest_matrix(parents: DataFrame, pairs: DataFrame, signed: bool = True) -> Matrices:
    """One row per forest edge (in the order of the lower nodes), one column per ``pairs(mid,
    c, u, w)``: the edges on exactly one of the ways of u and w to the root, -1 on u's.

    Ends, ways and numbers of edges meet in tasks of a bounded number of cells, by matrix."""
    spark = parents.sparkSession
    edges, _, (nodes,) = counted(parents.where("parent IS NOT NULL").select("mid", "node", "parent"), "tree-edges")
    pairs, _, (n,) = counted(pairs.select("mid", "c", "u", "w"), "tree-pairs")
    up = ancestors(edges)
    # a pair meets two ways of the mean length
    deal = _dealer(spark, 2 * n * -(-up.count() // max(1, nodes)), edges, pairs)
    numbered = deal(edges).select("mid", F.col("node").alias("edge"), (F.row_number().over(Window.partitionBy("mid").orderBy("node")) - 1).alias("r"))
    ends = deal(pairs).select("mid", "c", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(-1).alias("s")), F.struct(F.col("w").alias("node"), F.lit(1).alias("s")))).alias("x"))
    cells = ends.select("mid", "c", "x.node", "x.s").join(deal(up), ["mid", "node"]).groupBy("mid", "c", "edge").agg(F.sum("s").alias("v")).where("v <> 0")
    value = F.col("v") if signed else F.abs("v")
    e, _ = written(cells.join(numbered, ["mid", "edge"]).select("mid", "r", "c", value.cast("int").alias("v")), "tree-entries")
    dims = edges.groupBy("mid").agg(F.count("*").cast("int").alias("m")).join(pairs.groupBy("mid").agg(F.count("*").cast("int").alias("n")), "mid")
    return Matrices(dims, e)


ATTRIBUTES = ("regularity", "graphicness", "cographicness")
#: What a node's kind says by itself: regularity, graphicness, cographicness; None: nothing.
LEAVES = {
    "IRREGULAR": (-1, -1, -1),
    "UNKNOWN": (0, None, None),
    "PLANAR": (1, 1, 1),
    "GRAPH": (1, 1, None),
    "COGRAPH": (1, None, 1),
    "R10": (1, -1, -1),
}
#: Which attributes sums (and reductions, and pivots) have from their children: all have the least.
#: A graphic 3-sum may have parts that aren't, depending on its kind, and likewise for cographs.
INNER = {
    "ONESUM": (True, True, True),
    "TWOSUM": (True, True, True),
    "SERIES_PARALLEL": (True, True, True),
    "PIVOTS": (True, True, True),
    "DELTASUM": (True, True, False),
    "YSUM": (True, False, True),
    "THREESUM": (True, False, False),
}
#: Kinds that have two children; of one that isn't there nothing is known.
TWO = ("TWOSUM", "DELTASUM", "YSUM", "THREESUM")


def attributes(nodes: DataFrame) -> DataFrame:
    """``mid, node`` and the attributes of every node of decomposition trees, from the leaves up,
    for ``nodes(mid, node, parent, place, kind)`` with what attributes are known.

    1: has it, -1: hasn't, 0: unknown.  What is known stays; an unknown attribute of a sum is the
    least that any child has, at most 0 if a child is missing.  A matrix without nonzeros
    (reduced to nothing: SERIES_PARALLEL without children) has all three.

    All trees at once: levels are found by joins from the roots on and settled by one
    aggregation each from below; each is written, so a lost executor costs one level.
    There are twice as many rounds as the deepest tree has levels."""
    own = nodes.select("mid", "node", "parent", "place", "kind", *(F.coalesce(x, F.lit(0)).alias(x) for x in ATTRIBUTES))
    by_kind = lambda table, k: F.coalesce(*(F.when(F.col("kind") == kind, F.lit(row[k])) for kind, row in table.items()))
    told = own.select("mid", "node", "parent", "place", "kind", *(F.coalesce(by_kind(LEAVES, k), F.col(x)).cast("int").alias(x) for k, x in enumerate(ATTRIBUTES)))
    told, _ = written(told, "tree-nodes")
    level, _, (n,) = counted(told.where("parent IS NULL"), "tree-level")
    levels = []
    while n:
        levels.append(level)
        above = level.select("mid", F.col("node").alias("parent"))
        level, _, (n,) = counted(told.join(above, ["mid", "parent"]).select(*told.columns), "tree-level")
    settled = below = None
    for level in reversed(levels):
        if below is None:
            got = level.withColumns({"children": F.lit(0), **{f"least_{x}": F.lit(None).cast("int") for x in ATTRIBUTES}})
        else:
            least = [F.min(x).alias(f"least_{x}") for x in ATTRIBUTES]
            sums = below.groupBy("mid", F.col("parent").alias("node")).agg(F.count("*").alias("children"), (F.max("place") + 1).alias("places"), *least)
            got = level.join(sums, ["mid", "node"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
            wanted = F.when(F.col("kind").isin(*TWO), F.greatest(F.lit(2), "places")).otherwise(F.col("places"))
            missing = F.col("children") < wanted
            got = got.withColumns({f"least_{x}": F.when(missing, F.least(f"least_{x}", F.lit(0))).otherwise(F.col(f"least_{x}")) for x in ATTRIBUTES})
        nothing = (F.col("kind") == "SERIES_PARALLEL") & (F.col("children") == 0)
        value = lambda k, x: F.when(F.col(x) != 0, F.col(x)).when(nothing, 1).when(by_kind(INNER, k), F.coalesce(f"least_{x}", F.lit(0))).otherwise(F.col(x))
        below, _ = written(got.select("mid", "node", "parent", "place", *(value(k, x).cast("int").alias(x) for k, x in enumerate(ATTRIBUTES))), "tree-settled")
        settled = below if settled is None else settled.unionByName(below)
    return (settled if settled is not None else told).select("mid", "node", *ATTRIBUTES)
