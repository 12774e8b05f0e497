"""Matrix collections derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Matrices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Quantities of a band: 1 to 17, 18 to 34 and 35 to 50 are 0, 1 and 2.
BAND, BANDS = 17, 3


def _parts(spark: SparkSession, sf_dir: str, value) -> Matrices:
    """4 x 7 matrices, one per part and band of quantities: supplier number modulo 4 by
    line number, of all lines of ``lineitem``.  ``value`` is never zero."""
    band = F.floor((F.col("l_quantity") - 1) / BAND).cast("long")
    e = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_partkey") * BANDS + band).alias("mid"), (F.col("l_suppkey") % 4).cast("int").alias("r"), (F.col("l_linenumber") - 1).alias("c")
    ).agg(value.cast("int").alias("v"))
    return Matrices(e.select("mid").distinct().select("mid", F.lit(4).alias("m"), F.lit(7).alias("n")), e)


def part_sign(spark: SparkSession, sf_dir: str) -> Matrices:
    """-1 where more lines were returned (A) than not."""
    returned = F.sum(F.when(F.col("l_returnflag") == "A", -1).otherwise(1))
    return _parts(spark, sf_dir, F.when(returned < 0, -1).otherwise(1))


def part_binary(spark: SparkSession, sf_dir: str) -> Matrices:
    return _parts(spark, sf_dir, F.lit(1))


def part_count(spark: SparkSession, sf_dir: str) -> Matrices:
    return _parts(spark, sf_dir, F.count("*"))


def embeddings(spark: SparkSession, sf_dir: str) -> Matrices:
    """One matrix per label: its vectors, in the order of their numbers, as rows."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("mid"), "vec_id", "embedding")
    # places within ranges of numbers, after the vectors of the ranges before: no label is sorted in one task
    v = v.withColumn("range", F.floor(F.col("vec_id") / 4096))
    sizes = v.groupBy("mid", "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("mid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("mid", "range").orderBy("vec_id")) - 1
    rows = v.withColumn("at", place).join(sizes.select("mid", "range", before.alias("before")), ["mid", "range"]).withColumn("r", (F.col("at") + F.col("before")).cast("int"))
    dims = rows.groupBy("mid").agg(F.count("*").cast("int").alias("m"), F.max(F.size("embedding")).alias("n"))
    e = rows.select("mid", "r", F.posexplode("embedding").alias("c", "v")).select("mid", "r", "c", F.col("v").cast("double").alias("v")).where("v <> 0")
    return Matrices(dims, e)


#: The families as SQL, with the same columns.
PART_SQL = """SELECT l_partkey * 3 + CAST(floor((l_quantity - 1) / 17) AS BIGINT) AS mid, CAST(l_suppkey % 4 AS INTEGER) AS r,
  CAST(l_linenumber - 1 AS INTEGER) AS c, CAST({value} AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3"""
SIGN_SQL = PART_SQL.format(value="CASE WHEN sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END) < 0 THEN -1 ELSE 1 END")
BINARY_SQL = PART_SQL.format(value="1")
COUNT_SQL = PART_SQL.format(value="count(*)")
EMBED_SQL = """SELECT mid, r, c, CAST(x AS DOUBLE) AS v FROM (SELECT CAST(label AS BIGINT) AS mid,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS r,
  unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS c FROM embeddings) WHERE x <> 0"""

#: Orders and columns of a matrix of :func:`order_sign`.
ORDERS, PLACES = 256, 1024


def order_sign(spark: SparkSession, sf_dir: str) -> Matrices:
    """Large sparse matrices: orders, 256 in a row, by 1,024 places that suppliers and line
    numbers are dealt to; -1 where more lines were returned (A) than not."""
    lines, mid = table(spark, sf_dir, "lineitem"), F.floor(F.col("l_orderkey") / ORDERS).cast("long").alias("mid")
    e = lines.groupBy(
        mid,
        (F.col("l_orderkey") % ORDERS).cast("int").alias("r"),
        ((11 * F.col("l_suppkey") + F.col("l_linenumber")) % PLACES).cast("int").alias("c"),
    ).agg(F.when(F.sum(F.when(F.col("l_returnflag") == "A", -1).otherwise(1)) < 0, -1).otherwise(1).alias("v"))
    # each line has an entry, so the matrices are told without adding the entries up again
    return Matrices(lines.select(mid).distinct().select("mid", F.lit(ORDERS).alias("m"), F.lit(PLACES).alias("n")), e)


ORDER_SQL = """SELECT l_orderkey // 256 AS mid, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST((11 * l_suppkey + l_linenumber) % 1024 AS INTEGER) AS c,
  CASE WHEN sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END) < 0 THEN -1 ELSE 1 END AS v FROM lineitem GROUP BY 1, 2, 3"""
