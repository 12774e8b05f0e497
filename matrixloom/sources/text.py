"""Matrices, submatrices and edge lists in text files, read and written by Spark.

One text holds one matrix (or submatrix, or graph), and a table ``mid, value`` holds the
texts, however they were read; :func:`whole_files` reads files.  Numbers stand anywhere between
white space; indices in files count from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Matrices


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``mid, value`` of text files, numbered by their names."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    names = files.select("file").distinct().withColumn("mid", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    return files.join(names, "file").select("mid", "value")


def _words(texts: DataFrame) -> DataFrame:
    return texts.select("mid", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("x"))


def _at(i: int):
    return F.get("x", F.lit(i)).try_cast("int")


def read_dense(texts: DataFrame, kind: str = "int") -> tuple[Matrices, DataFrame]:
    """Texts (``mid, value``) ``m n`` and m * n numbers; zeros aren't kept.  Also ``mid,
    status``: INPUT for a text that is too short or has what isn't a number; its
    matrix is left out."""
    files = _words(texts).withColumns({"m": _at(0), "n": _at(1)})
    numbers = F.slice("x", F.lit(3), F.greatest(F.col("m") * F.col("n"), F.lit(0)))
    ok = F.coalesce((F.col("m") >= 0) & (F.col("n") >= 0) & (F.size("x") - 2 >= F.col("m") * F.col("n")) & ~F.exists(numbers, lambda v: v.try_cast(kind).isNull()), F.lit(False))
    good = files.where(ok)
    cells = good.select("mid", "m", "n", F.posexplode(numbers).alias("k", "v"))
    e = cells.select("mid", F.expr("CAST(k div n AS INT)").alias("r"), (F.col("k") % F.col("n")).alias("c"), F.col("v").cast(kind).alias("v")).where("v <> 0")
    return Matrices(good.select("mid", "m", "n"), e), files.select("mid", F.when(ok, "OK").otherwise("INPUT").alias("status"))


def read_sparse(texts: DataFrame, kind: str = "int") -> tuple[Matrices, DataFrame]:
    """Texts ``m n k`` and k times ``r c v``; zeros aren't kept.  INPUT for texts that are too
    short, or that have an index out of range, an entry twice or what isn't a number."""
    files = _words(texts).withColumns({"m": _at(0), "n": _at(1), "k": _at(2)})
    long = F.coalesce((F.col("m") >= 0) & (F.col("n") >= 0) & (F.col("k") >= 0) & (F.size("x") - 3 >= 3 * F.col("k")), F.lit(False))
    triple = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    cells = files.where(long).select("mid", "m", "n", F.explode(F.transform(triple, lambda i: F.slice("x", 4 + 3 * i, 3))).alias("t"))
    e = cells.select("mid", "m", "n", (F.get("t", F.lit(0)).try_cast("int") - 1).alias("r"), (F.get("t", F.lit(1)).try_cast("int") - 1).alias("c"), F.get("t", F.lit(2)).try_cast(kind).alias("v"))
    out = e.where("NOT coalesce(r >= 0 AND r < m AND c >= 0 AND c < n AND v IS NOT NULL, FALSE)").select("mid")
    twice = e.groupBy("mid", "r", "c").count().where("count > 1").select("mid")
    bad = out.unionByName(twice).distinct().withColumn("bad", F.lit(True))
    status = files.join(bad, "mid", "left").select("mid", "m", "n", F.when(long & F.col("bad").isNull(), "OK").otherwise("INPUT").alias("status"))
    good = status.where("status = 'OK'")
    return Matrices(good.select("mid", "m", "n"), e.where("v <> 0").join(good.select("mid"), "mid").select("mid", "r", "c", "v")), status.select("mid", "status")


def sparse_text(ms: Matrices) -> DataFrame:
    """``mid, value``: header, blank line, and triples in row order."""
    cells = ms.entries.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("cells"))
    said = F.transform(F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)), lambda x: F.concat_ws(" ", (x.r + 1).cast("string"), (x.c + 1).cast("string"), x.v.cast("string")))
    head = F.concat_ws(" ", "m", "n", F.size(F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType))))
    return ms.dims.join(cells, "mid", "left").select("mid", F.concat(head, F.lit("\n\n"), F.array_join(said, "\n"), F.lit("\n")).alias("value"))


def dense_text(ms: Matrices, zero: str = "0", header: bool = False) -> DataFrame:
    """``mid, value``: header and rows; zeros are written as ``zero``; ``header``: a line of
    the columns' last digits (counted from 1) comes before the rows."""
    digits = F.array_join(F.transform(_upto("n"), lambda j: ((j + 1) % 10).cast("string")), " ")
    lines = dense_lines(ms, zero, F.concat(F.lit("\n"), digits) if header else None)
    whole = lines.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))
    # without rows the header's line is followed by an empty one
    end = F.when(F.size("x") == 1, "\n\n").otherwise("\n")
    return whole.select("mid", F.concat(F.array_join("x.value", "\n"), end).alias("value"))


def _upto(size: str):
    return F.when(F.col(size) > 0, F.sequence(F.lit(0), F.col(size) - 1)).otherwise(F.array().cast("array<int>"))


def dense_lines(ms: Matrices, zero: str = "0", head=None) -> DataFrame:
    """``mid, at, value``: the lines of dense texts, sizes and ``head`` at -1, then a line for each
    row.  A row's text is made from its nonzeros and the gaps between them."""
    entry = F.struct(F.col("c").cast("int").alias("c"), F.col("v").cast("string").alias("v"))
    cells = ms.entries.groupBy("mid", F.col("r").cast("int").alias("at")).agg(F.array_sort(F.collect_list(entry)).alias("cells"))
    rows = ms.dims.select("mid", "n", F.explode(_upto("m")).alias("at")).join(cells, ["mid", "at"], "left")
    gap = lambda x, i: x["c"] - F.coalesce(F.get("cells", i - 1)["c"], F.lit(-1)) - 1
    said = F.transform("cells", lambda x, i: F.concat(F.repeat(F.lit(f"{zero} "), gap(x, i)), x["v"]))
    rest = F.repeat(F.lit(f" {zero}"), F.col("n") - 1 - F.element_at("cells", -1)["c"])
    zeros = F.array_join(F.array_repeat(F.lit(zero), F.col("n")), " ")
    value = F.coalesce(F.concat(F.array_join(said, " "), rest), zeros)
    return ms.dims.select("mid", F.lit(-1).alias("at"), F.concat(F.concat_ws(" ", "m", "n"), F.lit("") if head is None else head).alias("value")).unionByName(rows.select("mid", "at", value.alias("value")))


def read_submatrices(texts: DataFrame) -> DataFrame:
    """``mid, m, n, rows, cols`` of texts ``m n r c``, r row and c column indices."""
    files = _words(texts).withColumns({"m": _at(0), "n": _at(1), "a": _at(2), "b": _at(3)})
    zero = lambda start, size: F.transform(F.slice("x", start, F.col(size)), lambda v: v.cast("int") - 1)
    return files.select("mid", "m", "n", zero(F.lit(5), "a").alias("rows"), zero(5 + F.col("a"), "b").alias("cols"))


def submatrix_text(subs: DataFrame) -> DataFrame:
    """``mid, value`` of ``subs(mid, m, n, rows, cols)``, counted from 1."""
    one = lambda c: F.array_join(F.transform(c, lambda i: (i + 1).cast("string")), " ")
    head = F.concat_ws(" ", "m", "n", F.size("rows"), F.size("cols"))
    return subs.select("mid", F.concat_ws("\n", head, one("rows"), one("cols")).alias("value"))


def minor_text(minors: DataFrame) -> DataFrame:
    """``mid, value`` of minors: the submatrix that remains, without the pivots."""
    return submatrix_text(minors.select("mid", "m", "n", "rows", "cols"))


def read_edge_lists(texts: DataFrame) -> DataFrame:
    """``mid, e, u, w, u_node, w_node, element`` of texts with lines ``u v [element]``, up to the first line
    with fewer than two words.  Elements: r<i>, t<i> or -<i> a row (negative), c<j> a
    column, a bare number itself; nodes are numbered in the order of first mention."""
    lines = texts.select("mid", F.posexplode(F.split("value", "\r?\n")).alias("e", "line"))
    words = lines.select("mid", "e", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("x"))
    end = words.where(F.size("x") < 2).groupBy("mid").agg(F.min("e").alias("end"))
    words = words.join(end, "mid", "left").where(F.col("end").isNull() | (F.col("e") < F.col("end")))
    said = F.lower(F.get("x", F.lit(2)))
    number = F.regexp_extract(said, "([0-9]+)", 1)
    element = F.when(said.rlike("^[rt-][0-9]+$"), -number.try_cast("int")).when(said.rlike("^c?[0-9]+$"), number.try_cast("int"))
    edges = words.select("mid", "e", F.get("x", F.lit(0)).alias("u"), F.get("x", F.lit(1)).alias("w"), element.alias("element"))
    first = edges.select("mid", F.explode(F.array(F.struct("u", (2 * F.col("e")).alias("at")), F.struct(F.col("w").alias("u"), (2 * F.col("e") + 1).alias("at")))).alias("x"))
    nodes = first.groupBy("mid", "x.u").agg(F.min("x.at").alias("at"))
    nodes = nodes.withColumn("node", F.row_number().over(Window.partitionBy("mid").orderBy("at")) - 1)
    ends = lambda c: nodes.select("mid", F.col("u").alias(c), F.col("node").alias(f"{c}_node"))
    return edges.join(ends("u"), ["mid", "u"]).join(ends("w"), ["mid", "w"]).select("mid", "e", "u", "w", "u_node", "w_node", "element")


def _sorted_lines(edges: DataFrame, line, tag: str) -> DataFrame:
    return edges.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("element", line.alias("line")))).alias("x")).select("mid", F.array_join(F.col("x.line"), "\n").alias(tag))


def element_word(element):
    return F.when(element < 0, F.concat(F.lit("r"), (-element).cast("string"))).otherwise(F.concat(F.lit("c"), element.cast("string")))


def edge_list_text(edges: DataFrame) -> DataFrame:
    """``mid, value`` of ``edges(mid, element, tail, head, ..)``."""
    line = F.concat_ws(" ", F.concat(F.lit("v"), F.col("tail").cast("string")), F.concat(F.lit("v"), F.col("head").cast("string")), element_word(F.col("element")))
    return _sorted_lines(edges, line, "value")


def dot_text(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``mid, value``: GraphViz; forest edges are bold."""
    arrow = " -> " if directed else " -- "
    style = F.when(F.col("in_forest"), ",style=bold").otherwise("")
    line = F.concat(F.lit(" v"), F.col("tail").cast("string"), F.lit(f"{arrow}v"), F.col("head").cast("string"), F.lit(' [label="'), element_word(F.col("element")), F.lit('"'), style, F.lit("];"))
    said = _sorted_lines(edges, line, "body")
    return said.select("mid", F.concat(F.lit("digraph G {\n" if directed else "graph G {\n"), "body", F.lit("\n}\n")).alias("value"))


def tree_text(nodes: DataFrame) -> DataFrame:
    """``mid, value``: a line for each node of a decomposition tree, in order and indented by
    depth; nodes are numbered from 0 on and come after their parents."""
    graphs = F.concat_ws(" ", F.concat(F.lit("graphic="), F.col("graphicness").cast("string")), F.concat(F.lit("cographic="), F.col("cographicness").cast("string")))
    line = F.concat_ws(" ", F.col("node").cast("string"), "kind", F.concat(F.size("rows"), F.lit("x"), F.size("cols")), F.concat(F.lit("regularity="), F.col("regularity").cast("string")), graphs)
    x = nodes.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("node", "parent", line.alias("line")))).alias("x"))
    depth = F.aggregate("x", F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(F.when(r.parent.isNull(), 0).otherwise(F.get(acc, r.parent) + 1))))
    said = F.zip_with("x", depth, lambda r, d: F.concat(F.repeat(F.lit("  "), d), r.line))
    return x.select("mid", F.array_join(said, "\n").alias("value"))


def tree_dot(nodes: DataFrame) -> DataFrame:
    """``mid, value``: a decomposition tree in GraphViz, its nodes by kind and size."""
    label = F.concat_ws(" ", "kind", F.concat(F.size("rows"), F.lit("x"), F.size("cols")))
    node = F.concat(F.lit(" n"), F.col("node").cast("string"), F.lit(' [label="'), label, F.lit('"];'))
    edge = F.when(F.col("parent").isNotNull(), F.concat(F.lit("\n n"), F.col("parent").cast("string"), F.lit(" -> n"), F.col("node").cast("string"), F.lit(";"))).otherwise("")
    x = nodes.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("node", F.concat(node, edge).alias("line")))).alias("x"))
    return x.select("mid", F.concat(F.lit("digraph G {\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\n}\n")).alias("value"))


def reductions_text(reduced: DataFrame) -> DataFrame:
    """``mid, value`` of series-parallel ``reductions``: their number, then a line each."""

    def said(x):
        element, mate = element_word(x.element), element_word(x.mate)
        kind = F.when(x.mate == 0, F.lit("zero")).when((x.element < 0) == (x.mate < 0), F.concat(F.lit("copy of "), mate)).otherwise(F.concat(F.lit("unit at "), mate))
        return F.concat(element, F.lit(": "), kind)

    return reduced.select("mid", F.concat_ws("\n", F.size("reductions").cast("string"), F.array_join(F.transform("reductions", said), "\n")).alias("value"))


def complements_text(found: DataFrame) -> DataFrame:
    """``mid, value``: the complements of ``found(mid, row, col)`` in words, counted from 1."""
    row = F.when(F.col("row").isNotNull(), F.concat(F.lit("complement row "), (F.col("row") + 1).cast("string")))
    col = F.when(F.col("col").isNotNull(), F.concat(F.lit("complement column "), (F.col("col") + 1).cast("string")))
    return found.select("mid", F.concat_ws("\n", row, col).alias("value"))


def write(texts: DataFrame, path: str) -> None:
    """One file per matrix, ``path/mid=<mid>/part-*``."""
    texts.select("mid", F.regexp_replace("value", "\n$", "").alias("value")).write.partitionBy("mid").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """As :func:`write`, line after line, of ``lines(mid, at, value)``: no matrix is in one row."""
    lines.repartition("mid").sortWithinPartitions("mid", "at").select("mid", "value").write.partitionBy("mid").text(path)
