"""Collections of multigraphs as edge tables ``mid, e, u, w, element``; loops and parallel
edges are allowed, nodes without edges are listed in ``nodes(mid, node)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("mid", F.explode(F.array("u", "w")).alias("node")).distinct()


def delete_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges at the nodes ``gone(mid, node)``."""
    for end in ("u", "w"):
        edges = edges.join(gone.select("mid", F.col("node").alias(end)), ["mid", end], "left_anti")
    return edges


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("mid", "e"), ["mid", "e"], "left_anti")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """With ``more(mid, u, w, element)``, numbered after each graph's last edge."""
    from pyspark.sql import Window

    last = edges.groupBy("mid").agg(F.max("e").alias("last"))
    place = F.row_number().over(Window.partitionBy("mid").orderBy("element", "u", "w"))
    new = more.withColumn("k", place).join(last, "mid", "left")
    return edges.select("mid", "e", "u", "w", "element").unionByName(new.select("mid", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int").alias("e"), "u", "w", "element"))


def merge_nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Node ``old`` becomes ``new`` for ``pairs(mid, old, new)``; edges between them become
    loops."""
    for end in ("u", "w"):
        mine = pairs.select("mid", F.col("old").alias(end), F.col("new").alias("_new"))
        edges = edges.join(mine, ["mid", end], "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges.select("mid", "e", "u", "w", "element")


def incident(edges: DataFrame) -> DataFrame:
    """``mid, node, e, other``: each edge at both of its ends, a loop twice."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("w").alias("other")), F.struct(F.col("w").alias("node"), F.col("u").alias("other")))
    return edges.select("mid", "e", F.explode(ends).alias("x")).select("mid", "x.node", "e", "x.other")


def node_degrees(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy("mid", "node").agg(F.count("*").alias("degree"))


def problems(edges: DataFrame) -> DataFrame:
    """``mid, problem``: edge numbers used twice, ends that are missing."""
    twice = edges.groupBy("mid", "e").count().where("count > 1").select("mid", F.lit("edge number used twice").alias("problem"))
    open_ = edges.where("u IS NULL OR w IS NULL").select("mid", F.lit("end is missing").alias("problem"))
    return twice.unionByName(open_).distinct()
