"""Matrices in files of any size: ranges of a file are read by different tasks.

Numbers stand anywhere between white space, so what a number means follows from how many come
before it.  A first pass counts the numbers of each range; a second one numbers each line's
first number, as its range comes by, and needs no shuffle of the lines.  From there on each line
stands for itself: a dense cell's place follows from its number, and so does a sparse entry's
unless a line ends within it; only the numbers of such lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Matrices
from ..storage import written

_LINES = "file string, block long, start long, value string"


def _words() -> Column:
    return F.filter(F.split(F.col("value"), r"\s+"), lambda w: w != "")


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many numbers of its range come before each line; lines come in order, range after range."""
    here, before = None, 0
    for batch in batches:
        starts = []
        for file, block, count in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (file, block) != here:
                here, before = (file, block), 0
            starts.append(before)
            before += count
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), batch.column(2)], names=["file", "block", "start", "value"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, words``: each line with words, and how many words of its file come before;
    written to the shared folder, as all that is asked of them would read the files again."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counted = lines.withColumn("k", F.size(_words()))
    ranges = counted.groupBy("file", "block").agg(F.sum("k").alias("k"))
    before = F.sum("k").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    started = counted.select("file", "block", "value", "k").mapInArrow(_started, _LINES)
    numbered = started.join(offsets, ["file", "block"]).select("file", (F.col("start") + F.col("before")).alias("start"), _words().alias("words")).where(F.size("words") > 0)
    return written(numbered, "numbered-lines")[0]


def _named(heads: DataFrame, mid: Column | None) -> DataFrame:
    """With ``mid``: from ``file``, or the place of the file's name among all."""
    return heads.withColumn("mid", mid.cast("long") if mid is not None else (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))


def _heads(lines: DataFrame, names: tuple[str, ...], mid: Column | None) -> DataFrame:
    """``mid, file``, the first numbers of each file by ``names``, and how many ``total`` there are."""
    word = lambda i: F.max(F.when((F.col("start") <= i) & (F.col("start") + F.size("words") > i), F.get("words", (i - F.col("start")).cast("int")).try_cast("int"))).alias(names[i])
    return _named(lines.groupBy("file").agg(*[word(i) for i in range(len(names))], F.sum(F.size("words")).alias("total")), mid)


def _whole(heads: DataFrame, bad: DataFrame, fits: Column) -> tuple[DataFrame, DataFrame]:
    marked = heads.join(bad.select("mid").distinct().withColumn("bad", F.lit(True)), "mid", "left")
    status = marked.select("mid", "m", "n", F.when(F.coalesce(fits, F.lit(False)) & F.col("bad").isNull(), "OK").otherwise("INPUT").alias("status"))
    return status.where("status = 'OK'").select("mid", "m", "n"), status.select("mid", "status")


def read_dense(spark: SparkSession, path: str, kind: str = "int", mid: Column | None = None) -> tuple[Matrices, DataFrame]:
    """As :func:`.text.read_dense` of whole files: the matrices and ``mid, status``."""
    lines = numbered_lines(spark, path)
    heads = _heads(lines, ("m", "n"), mid)
    cells = lines.select("file", "start", F.posexplode("words").alias("i", "word")).select("file", (F.col("start") + F.col("i") - 2).alias("k"), "word").where("k >= 0")
    cells = cells.join(heads, "file").where("k < cast(m as long) * n").select("mid", F.expr("cast(k div n as int)").alias("r"), (F.col("k") % F.col("n")).cast("int").alias("c"), F.col("word").try_cast(kind).alias("v"))
    good, status = _whole(heads, cells.where("v IS NULL"), F.expr("m >= 0 AND n >= 0 AND total - 2 >= cast(m as long) * n"))
    return Matrices(good, cells.where("v <> 0").join(good.select("mid"), "mid", "left_semi")), status


def read_sparse(spark: SparkSession, path: str, kind: str = "int", mid: Column | None = None) -> tuple[Matrices, DataFrame]:
    """As :func:`.text.read_sparse` of whole files: the matrices and ``mid, status``."""
    lines = numbered_lines(spark, path)
    heads = _heads(lines, ("m", "n", "k"), mid)
    aligned = (F.col("start") >= 3) & (F.col("start") % 3 == 0) & (F.size("words") % 3 == 0)
    triples = F.transform(F.sequence(F.lit(0), (F.size("words") / 3 - 1).cast("int")), lambda i: F.struct((F.col("start") / 3 - 1 + i).cast("long").alias("i"), F.get("words", 3 * i).alias("r"), F.get("words", 3 * i + 1).alias("c"), F.get("words", 3 * i + 2).alias("v")))
    plain = lines.where(aligned).select("file", F.explode(triples).alias("e")).select("file", "e.*")
    words = lines.where(~aligned).select("file", "start", F.posexplode("words").alias("j", "word")).select("file", (F.col("start") + F.col("j") - 3).alias("k"), "word").where("k >= 0")
    part = lambda i, name: F.max(F.when(F.col("k") % 3 == i, F.col("word"))).alias(name)
    torn = words.groupBy("file", F.expr("k div 3").alias("i")).agg(part(0, "r"), part(1, "c"), part(2, "v"))
    e = plain.unionByName(torn).join(heads, "file").where("i < k").select("mid", "m", "n", (F.col("r").try_cast("int") - 1).alias("r"), (F.col("c").try_cast("int") - 1).alias("c"), F.col("v").try_cast(kind).alias("v"))
    out = e.where("NOT coalesce(r >= 0 AND r < m AND c >= 0 AND c < n AND v IS NOT NULL, FALSE)").select("mid")
    twice = e.groupBy("mid", "r", "c").count().where("count > 1").select("mid")
    good, status = _whole(heads, out.unionByName(twice), F.expr("m >= 0 AND n >= 0 AND k >= 0 AND total - 3 >= 3 * cast(k as long)"))
    return Matrices(good, e.where("v <> 0").join(good.select("mid"), "mid", "left_semi").select("mid", "r", "c", "v")), status
