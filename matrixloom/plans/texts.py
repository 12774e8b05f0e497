"""Queries of texts read and written, submatrices, multigraphs and generators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..model import Matrices
from ..operators import algebra, multigraphs, recognition
from ..sources import generators, splits, text
from .families import EMBED_SQL, ORDER_SQL, SIGN_SQL, embeddings, order_sign, part_sign, table
from .queries import GRAPH_SQL, SIGN_CLASS, _number, order_graphs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- submatrices -----------------------------------------------------------------------

#: Of each matrix the rows and columns with a minus one, rows backwards.
MARKED = f"""marked AS (SELECT mid, list(DISTINCT r ORDER BY r DESC) AS rows, list(DISTINCT c ORDER BY c) AS cols FROM ({SIGN_SQL}) WHERE v = -1 GROUP BY mid)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = part_sign(spark, sf_dir).entries.where("v = -1")
    return low.groupBy("mid").agg(F.sort_array(F.collect_set("r"), asc=False).alias("rows"), F.sort_array(F.collect_set("c")).alias("cols"))


@query(f"""WITH {MARKED} SELECT mid, concat_ws(chr(10), '4 7 ' || len(rows) || ' ' || len(cols), array_to_string(list_transform(rows, lambda x: x + 1), ' '),
  array_to_string(list_transform(cols, lambda x: x + 1), ' ')) AS value FROM marked""")
def submatrix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.submatrix_text(_marked(spark, sf_dir).select("mid", F.lit(4).alias("m"), F.lit(7).alias("n"), "rows", "cols"))


@query(f"WITH {MARKED} SELECT mid, 4 AS m, 7 AS n, array_to_string(rows, ',') AS rows, array_to_string(cols, ',') AS cols FROM marked")
def submatrices_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submatrices written as texts and read from them again."""
    texts, _ = storage.written(submatrix_texts(spark, sf_dir), "submatrices")
    return text.read_submatrices(texts).select("mid", "m", "n", F.array_join("rows", ",").alias("rows"), F.array_join("cols", ",").alias("cols"))


@query(f"WITH {MARKED} SELECT mid, array_to_string(cols, ',') AS rows, array_to_string(rows, ',') AS cols FROM marked")
def submatrices_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _marked(spark, sf_dir).select("mid", algebra.sub(F.col("rows"), F.col("cols")).alias("s")).select("mid", algebra.sub_transpose("s").alias("t"))
    return t.select("mid", F.array_join("t.rows", ",").alias("rows"), F.array_join("t.cols", ",").alias("cols"))


@query(f"WITH {MARKED} SELECT mid, array_to_string(list_sort(rows), ',') AS rows, array_to_string(cols, ',') AS cols FROM marked")
def submatrices_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _marked(spark, sf_dir).select("mid", algebra.sub(F.col("rows"), F.col("cols")).alias("s")).select("mid", algebra.sub_sort("s").alias("t"))
    return t.select("mid", F.array_join("t.rows", ",").alias("rows"), F.array_join("t.cols", ",").alias("cols"))


@query(f"""WITH f AS (SELECT mid, min(r * 1000 + c) // 1000 AS p, min(r * 1000 + c) % 1000 AS q FROM ({SIGN_SQL}) GROUP BY mid)
SELECT mid, concat_ws(chr(10), '4 7 3 6', array_to_string([x + 1 FOR x IN range(0, 4) IF x <> p], ' '), array_to_string([x + 1 FOR x IN range(0, 7) IF x <> q], ' ')) AS value FROM f""")
def minor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each matrix beside the row and column of its first entry."""
    first = part_sign(spark, sf_dir).entries.groupBy("mid").agg(F.min(F.struct("r", "c")).alias("w"))
    others = lambda size, at: F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: x != F.col(at))
    return text.minor_text(first.select("mid", F.lit(4).alias("m"), F.lit(7).alias("n"), others(4, "w.r").alias("rows"), others(7, "w.c").alias("cols")))


# --- files that are read in ranges ---------------------------------------------------------


def _files(spark: SparkSession, texts: DataFrame, tag: str) -> str:
    path = storage.new_path(spark, tag)
    text.write(texts, path)
    return path


def _mid():
    return F.regexp_extract("file", "mid=([0-9]+)", 1)


@query(f"SELECT mid, r, c, v FROM ({ORDER_SQL})")
def sparse_ranges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of 1,280 lines, a file for each, written and read in ranges."""
    path = _files(spark, text.sparse_text(order_sign(spark, sf_dir)), "sparse-files")
    return splits.read_sparse(spark, path, mid=_mid())[0].entries


@query(f"SELECT mid, r, c, CAST(round(v * 10) AS INTEGER) AS v FROM ({EMBED_SQL}) WHERE round(v * 10) <> 0")
def dense_ranges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, a file for each label, written in tenths and read in ranges."""
    ms = embeddings(spark, sf_dir)
    tenths = Matrices(ms.dims, ms.entries.withColumn("v", F.col("v") * 10)).cast("int")
    path = storage.new_path(spark, "dense-files")
    text.write_lines(text.dense_lines(tenths), path)
    return splits.read_dense(spark, path, mid=_mid())[0].entries


# --- edge lists and multigraphs -----------------------------------------------------------


@query("""WITH e AS (SELECT l_orderkey AS mid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 5, l_suppkey % 5, l_returnflag = 'A') - 1 AS INTEGER) AS e, 'p' || l_partkey % 5 AS u, 's' || l_suppkey % 5 AS w,
  CAST(CASE WHEN l_returnflag = 'A' THEN -1 - l_linenumber ELSE l_linenumber END AS INTEGER) AS element FROM lineitem),
seen AS (SELECT mid, x, min(k) AS k FROM (SELECT mid, u AS x, 2 * e AS k FROM e UNION ALL SELECT mid, w, 2 * e + 1 FROM e) GROUP BY mid, x),
node AS (SELECT mid, x, CAST(row_number() OVER (PARTITION BY mid ORDER BY k) - 1 AS INTEGER) AS n FROM seen)
SELECT e.mid, e, u, w, a.n AS u_node, b.n AS w_node, element FROM e JOIN node a ON a.mid = e.mid AND a.x = u JOIN node b ON b.mid = e.mid AND b.x = w""")
def edge_lists_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per order, with a line per line of it: between its part's and its supplier's
    number modulo 5, named as a column, or as a row if it was returned."""
    element = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("r"), (F.col("l_linenumber") + 1).cast("string"))).otherwise(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")))
    name = lambda mark, key: F.concat(F.lit(mark), (F.col(key) % 5).cast("string"))
    line = F.concat_ws(" ", name("p", "l_partkey"), name("s", "l_suppkey"), element)
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("x"))
    return text.read_edge_lists(texts.select("mid", F.array_join(F.col("x.line"), "\n").alias("value")))


@query(f"""SELECT mid, CAST(4 AS BIGINT) AS rows, CAST(7 AS BIGINT) AS cols, CAST(5 AS BIGINT) AS nodes FROM ({SIGN_CLASS} SELECT mid FROM net WHERE is_network)""")
def network_edge_lists_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge lists of the networks found, written and read: edges of each kind, and the nodes
    that the forest's edges join."""
    texts, _ = storage.written(text.edge_list_text(recognition.realised_networks(part_sign(spark, sf_dir))), "network-texts")
    edges = text.read_edge_lists(texts)
    counts = edges.groupBy("mid").agg(F.count_if(F.col("element") < 0).alias("rows"), F.count_if(F.col("element") > 0).alias("cols"))
    forest = edges.where("element < 0").select("mid", F.explode(F.array("u", "w")).alias("x")).groupBy("mid").agg(F.count_distinct("x").alias("nodes"))
    return counts.join(forest, "mid")


@query(f"""WITH g AS ({GRAPH_SQL}), bad AS (SELECT mid, e, CASE WHEN u = 0 THEN NULL ELSE u END AS u, w FROM g UNION ALL SELECT mid, e, u, w FROM g WHERE w = 1)
SELECT mid, 'edge number used twice' AS problem FROM bad GROUP BY mid HAVING count(*) > count(DISTINCT e) UNION ALL SELECT DISTINCT mid, 'end is missing' FROM bad WHERE u IS NULL OR w IS NULL""")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of graphs that lack ends and repeat edges."""
    edges = order_graphs(spark, sf_dir)
    lacking = edges.withColumn("u", F.when(F.col("u") != 0, F.col("u")))
    return multigraphs.problems(lacking.unionByName(edges.where("w = 1")))


# --- generators ----------------------------------------------------------------------------


@query(f"""SELECT mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 1 AS v FROM (SELECT c_custkey AS mid FROM customer), range(0, 6) a(r), range(0, 8) b(c)
WHERE {_number("'7:' || mid || ':' || r || ':' || c")} < 0.3""")
def generated_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random 6 x 8 matrix for each customer, three ones in ten entries."""
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mid"))
    return generators.random_binary(spark, made, 6, 8, 0.3, seed=7).entries


@query(f"""WITH RECURSIVE tree AS MATERIALIZED (SELECT s_suppkey AS mid, node, CAST(floor({_number("'1:' || s_suppkey || ':' || node || ':t'")} * node) AS BIGINT) AS parent FROM supplier, range(1, 40) n(node)),
pair AS (SELECT s_suppkey AS mid, c, CAST(floor({_number("'1:' || s_suppkey || ':' || c || ':u'")} * 40) AS BIGINT) AS u, CAST(floor({_number("'1:' || s_suppkey || ':' || c || ':w'")} * 40) AS BIGINT) AS w FROM supplier, range(0, 60) n(c)),
way AS (SELECT mid, c, u AS node, -1 AS s FROM pair UNION ALL SELECT mid, c, w, 1 FROM pair UNION ALL SELECT way.mid, c, parent, s FROM way JOIN tree ON tree.mid = way.mid AND tree.node = way.node WHERE way.node > 0)
SELECT mid, CAST(node - 1 AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(CASE WHEN {_number("'1:' || mid || ':' || (node - 1) || ':d'")} < 0.5 THEN -sum(s) ELSE sum(s) END AS INTEGER) AS v
FROM way WHERE node > 0 GROUP BY mid, node, c HAVING sum(s) <> 0""")
def generated_network_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 39 x 60 network matrix of a random tree for each supplier."""
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mid"))
    return generators.networks(spark, made, 40, 60).entries.select("mid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("int").alias("v"))


def _lot_of(name: str) -> str:
    return _number(f"'1:' || mid || ':' || k || ':{name}'")


#: The lines of growing matrices: three rows and three columns, and 30 more lines.
GROWN = f"""WITH RECURSIVE k0 AS (SELECT s_suppkey AS mid, k FROM supplier, range(0, 36) a(k)),
k1 AS (SELECT mid, k, CASE WHEN k < 3 THEN 'r' WHEN k < 6 OR {_lot_of('side')} < 0.5 THEN 'c' ELSE 'r' END AS side FROM k0),
k2 AS (SELECT *, row_number() OVER (PARTITION BY mid, side ORDER BY k) - 1 AS p FROM k1),
k3 AS (SELECT *, CASE WHEN k < 6 THEN 'base' WHEN p = 0 OR k = p THEN 'zero' ELSE ['zero', 'unit', 'copy'][1 + CAST(floor({_lot_of('kind')} * 3) AS INTEGER)] END AS kind FROM k2),
k4 AS (SELECT *, floor({_lot_of('to')} * CASE WHEN kind = 'unit' THEN k - p ELSE p END) AS goal, CASE WHEN (side = 'r') = (kind = 'copy') THEN 'r' ELSE 'c' END AS goal_side,
  CASE WHEN {_lot_of('sign')} < 0.5 THEN -1 ELSE 1 END AS s FROM k3),
line AS MATERIALIZED (SELECT a.mid, a.k, a.side, a.p, a.kind, a.s, CASE WHEN a.kind IN ('unit', 'copy') THEN b.k END AS target FROM k4 a LEFT JOIN k4 b ON b.mid = a.mid AND b.side = a.goal_side AND b.p = a.goal),
cell AS (SELECT a.mid, a.p AS r, b.p AS c, a.k AS x, b.k AS y, 1 AS s, FALSE AS done FROM line a JOIN line b USING (mid) WHERE a.side = 'r' AND b.side = 'c'
  UNION ALL SELECT o.mid, o.r, o.c, CASE WHEN l.kind = 'copy' AND x > y THEN target ELSE x END, CASE WHEN l.kind = 'copy' AND y > x THEN target ELSE y END,
    o.s * CASE WHEN l.kind = 'base' THEN 1 ELSE l.s END, l.kind <> 'copy' FROM cell o JOIN line l ON l.mid = o.mid AND l.k = greatest(x, y)
  WHERE NOT done AND (l.kind = 'copy' OR l.kind = 'unit' AND target = least(x, y) OR l.kind = 'base' AND {_number("'1:' || o.mid || ':' || x || ':' || y")} < 0.5))"""


@query(f"{GROWN} SELECT mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, s AS v FROM cell WHERE done")
def generated_series_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for each supplier that grows from a random 3 x 3 one by 30 lines."""
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mid"))
    return generators.random_series_parallel(spark, made, 3, 30).entries
