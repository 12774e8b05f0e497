"""Queries over large sparse matrices, and of operators that search on entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..model import Matrices
from ..operators import algebra, balance, camion, elimination, paths, recognition, series
from .families import ORDER_SQL, SIGN_SQL, order_sign, part_binary, part_count, part_sign
from .queries import BINARY_CLASS, GH_SIGN, LARGEST, SIGN_CLASS, UNBALANCED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- paths ------------------------------------------------------------------------

#: Levels that the recursive SQL goes through; no shortest path in these tables is longer.
STEPS = 24
PATHS = f"""WITH RECURSIVE e AS MATERIALIZED ({ORDER_SQL}),
edge AS MATERIALIZED (SELECT mid, -1 - r AS a, 1 + c AS b, v FROM e WHERE c % 7 <> 3 UNION ALL SELECT mid, 1 + c, -1 - r, v FROM e WHERE c % 7 <> 3),
grp AS (SELECT DISTINCT mid, -1 - r AS x, CASE WHEN r < 16 THEN 1 ELSE 2 END AS g FROM e WHERE r < 16 OR r >= 240),
walk AS (SELECT mid, x, 0 AS d FROM grp WHERE g = 1 UNION SELECT w.mid, b, d + 1 FROM walk w JOIN edge ON edge.mid = w.mid AND a = x WHERE d < {STEPS}),
dist AS MATERIALIZED (SELECT mid, x, min(d) AS d FROM walk GROUP BY mid, x),
goal AS MATERIALIZED (SELECT mid, min({{'d': d, 'x': -x}}) AS best FROM dist JOIN grp USING (mid, x) WHERE g = 2 GROUP BY mid),
parent AS MATERIALIZED (SELECT f.mid, f.x, f.d, min({{'k': t.x > 0, 'x': abs(t.x), 'v': edge.v}}) AS p FROM dist f JOIN edge ON edge.mid = f.mid AND edge.b = f.x JOIN dist t ON t.mid = f.mid AND t.x = edge.a AND t.d = f.d - 1 GROUP BY f.mid, f.x, f.d),
back AS (SELECT mid, -best.x AS x, -best.x AS target, best.d AS length, best.d AS left_, 0 AS total FROM goal
  UNION ALL SELECT b.mid, CASE WHEN p.p.k THEN p.p.x ELSE -p.p.x END, target, length, left_ - 1, total + p.p.v FROM back b JOIN parent p ON p.mid = b.mid AND p.x = b.x WHERE left_ > 0)
SELECT m.mid, CAST(x AS INTEGER) AS source, CAST(target AS INTEGER) AS target, CAST(length AS INTEGER) AS length, CAST(total AS BIGINT) AS total
FROM (SELECT DISTINCT mid FROM e) m LEFT JOIN (SELECT * FROM back WHERE left_ = 0) USING (mid)"""


def _path_groups(spark: SparkSession, sf_dir: str) -> tuple:
    """From the first 16 orders of each matrix to the last 16, without every seventh place."""
    ms = order_sign(spark, sf_dir)
    rows = ms.entries.where("r < 16 OR r >= 240").select("mid", (-1 - F.col("r")).alias("element"), F.when(F.col("r") < 16, 1).otherwise(2).alias("grp")).distinct()
    closed = ms.entries.where("c % 7 = 3").select("mid", (1 + F.col("c")).alias("element"), F.lit(-1).alias("grp")).distinct()
    return ms, rows.unionByName(closed)


@query(PATHS)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matrices of 1,280 lines, some 1,000 nonzeros each."""
    return paths.shortest_paths(*_path_groups(spark, sf_dir))


@query(f"SELECT mid, length + 1 AS lines, total, source, target FROM ({PATHS}) WHERE length IS NOT NULL")
def shortest_path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each path, in order: how many there are, and what their entries sum up to."""
    ms, groups = _path_groups(spark, sf_dir)
    lines = paths.search(ms, groups).lines()
    way = lines.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("at", "element"))).alias("way"))
    pairs = way.select("mid", F.explode(F.transform(F.sequence(F.lit(0), F.size("way") - 2), lambda k: F.struct(F.get("way", k)["element"].alias("a"), F.get("way", k + 1)["element"].alias("b")))).alias("p")).select("mid", "p.a", "p.b")
    total = pairs.join(paths.adjacency(ms), ["mid", "a", "b"]).groupBy("mid").agg(F.sum("v").alias("total"))
    return way.join(total, "mid").select("mid", F.size("way").alias("lines"), "total", F.col("way")[0]["element"].alias("source"), F.element_at("way", -1)["element"].alias("target"))


#: Rows 0 and 1 and columns 0 to 3 are the first part; a path in it has one or three entries.
EPSILON = f"""WITH e AS MATERIALIZED ({SIGN_SQL}), f AS (SELECT mid, r, c, coalesce(v, 0) AS v FROM (SELECT mid, r, c FROM (SELECT DISTINCT mid FROM e), range(0, 4) a(r), range(0, 7) b(c)) LEFT JOIN e USING (mid, r, c)),
minor AS (SELECT mid, p.r < 2 AS up, max(abs(p.v * s.v - q.v * t.v)) AS x FROM f p JOIN f s USING (mid) JOIN f q USING (mid) JOIN f t USING (mid)
  WHERE p.r < s.r AND p.c < s.c AND q.r = p.r AND q.c = s.c AND t.r = s.r AND t.c = p.c AND (s.r < 2 AND p.c > 3 OR p.r > 1 AND s.c < 4) GROUP BY mid, up),
fine AS (SELECT mid FROM e GROUP BY mid HAVING bool_or(r < 2 AND c > 3) AND bool_or(r > 1 AND c < 4)
  INTERSECT SELECT mid FROM minor GROUP BY mid HAVING max(x) = 0),
side AS MATERIALIZED (SELECT DISTINCT mid, r FROM e WHERE r < 2 AND c > 3), foot AS MATERIALIZED (SELECT DISTINCT mid, c FROM e WHERE r > 1 AND c < 4), inn AS MATERIALIZED (SELECT * FROM e WHERE r < 2 AND c < 4),
way AS (SELECT mid, 1 AS d, c, r AS r2, -1 AS c1, r, v AS total FROM inn JOIN side USING (mid, r) JOIN foot USING (mid, c)
  UNION ALL SELECT i.mid, 3, k.c, j.r, i.c, i.r, i.v + j.v + k.v FROM inn i JOIN side s ON s.mid = i.mid AND s.r = i.r JOIN inn j ON j.mid = i.mid AND j.c = i.c AND j.r <> i.r JOIN inn k ON k.mid = i.mid AND k.r = j.r AND k.c <> i.c
    JOIN foot t ON t.mid = i.mid AND t.c = k.c),
best AS (SELECT mid, min({{'d': d, 'c': c, 'r2': r2, 'c1': c1, 'r': r, 't': total}}) AS w FROM way GROUP BY mid),
x AS (SELECT mid, r, arg_min(v, c) AS x FROM e WHERE r < 2 AND c = (SELECT min(c) FROM e o WHERE o.mid = e.mid AND o.r < 2 AND o.c > 3) GROUP BY mid, r),
y AS (SELECT mid, c, arg_min(v, r) AS y FROM e WHERE c < 4 AND r = (SELECT min(r) FROM e o WHERE o.mid = e.mid AND o.c < 4 AND o.r > 1) GROUP BY mid, c)
SELECT m.mid, CASE WHEN w IS NULL OR x IS NULL OR y IS NULL THEN NULL WHEN ((w.t + x + y) % 4 + 4) % 4 = 1 THEN -1 ELSE 1 END AS epsilon
FROM (SELECT DISTINCT mid FROM e) m LEFT JOIN (SELECT mid, w FROM best JOIN fine USING (mid)) b USING (mid) LEFT JOIN x ON x.mid = m.mid AND x.r = w.r LEFT JOIN y ON y.mid = m.mid AND y.c = w.c"""


@query(EPSILON)
def delta_epsilons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    lines = lambda *x: F.array(*map(F.lit, x))
    return paths.delta_epsilons(ms, ms.dims.select("mid", lines(0, 1).alias("rows"), lines(0, 1, 2, 3).alias("cols")))


# --- series-parallel reductions ------------------------------------------------------


def _peeled(cells: str, sign: str = "w[1]") -> str:
    """``core``: what is left of ``cells`` when rows, then columns, with one nonzero or the
    entries of an earlier line (times ``sign``) have gone again and again."""
    kept = """{name} AS (SELECT mid, {a}, unnest(o) AS {b}, unnest(w) AS v, n FROM (SELECT *, row_number() OVER (PARTITION BY mid, o, list_transform(w, lambda x: x * {sign}) ORDER BY {a}) AS first
    FROM (SELECT mid, n, {a}, list({b} ORDER BY {b}) AS o, list(v ORDER BY {b}) AS w FROM {of} GROUP BY mid, n, {a}) WHERE len(o) > 1) WHERE first = 1)"""
    rows, columns = kept.format(name="by_row", a="r", b="c", of="s", sign=sign), kept.format(name="by_column", a="c", b="r", of="by_row", sign=sign)
    return f"""peel AS (SELECT mid, r, c, v, count(*) OVER (PARTITION BY mid) AS n, TRUE AS more FROM {cells}
  UNION ALL (WITH s AS (SELECT * FROM peel WHERE more), {rows}, {columns} SELECT mid, r, c, v, m AS n, m < n AS more FROM (SELECT *, count(*) OVER (PARTITION BY mid) AS m FROM by_column))),
core AS (SELECT * FROM peel WHERE NOT more)"""


LEFT_OVER = """SELECT m.mid, coalesce(rows, 0) = 0 AS is_sp, coalesce(rows, 0) AS rows, coalesce(cols, 0) AS cols, coalesce(nonzeros, 0) AS nonzeros FROM (SELECT DISTINCT mid FROM e) m
LEFT JOIN (SELECT mid, count(DISTINCT r) AS rows, count(DISTINCT c) AS cols, count(*) AS nonzeros FROM core GROUP BY mid) USING (mid)"""
PART_CORE = f"WITH RECURSIVE e AS MATERIALIZED ({SIGN_SQL}), {_peeled('e')}"
ORDER_CORE = f"WITH RECURSIVE e AS MATERIALIZED ({ORDER_SQL}), {_peeled('e')}"
BINARY_CORE = f"WITH RECURSIVE e AS MATERIALIZED (SELECT mid, r, c, 1 AS v FROM ({ORDER_SQL})), {_peeled('e', '1')}"


@query(f"{PART_CORE} {LEFT_OVER}")
def series_parallel_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines and nonzeros no reduction takes away; no order of reductions changes that."""
    return series.left_over(part_sign(spark, sf_dir))


@query(f"{ORDER_CORE} {LEFT_OVER}")
def series_parallel_core_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matrices of 1,280 lines."""
    return series.left_over(order_sign(spark, sf_dir))


@query(f"{BINARY_CORE} {LEFT_OVER}")
def series_parallel_core_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.left_over(algebra.support(order_sign(spark, sf_dir)), ternary=False)


@query(f"""{ORDER_CORE}, left_ AS ({LEFT_OVER}) SELECT mid, 256 + 1024 - rows - cols AS steps, 0 AS wrong FROM left_""".replace("0 AS wrong", "CAST(0 AS BIGINT) AS wrong"))
def series_parallel_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reductions of matrices of 1,280 lines, gone through one after the other: how many there
    are, and how many don't hold."""
    return series.replays(order_sign(spark, sf_dir))


# --- Camion's signs -------------------------------------------------------------------


def _signed_tu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the supports, with Camion's signs, are totally unimodular."""
    ms, _ = storage.written_matrices(camion.camion_signed(part_binary(spark, sf_dir)), "camion-signed")
    return recognition.tu_by_masks(ms)


@query(f"{BINARY_CLASS} SELECT mid, is_regular AS is_tu FROM bin")
def camion_signed_tu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: regular matrices are those that Camion's signs make totally unimodular."""
    return _signed_tu(spark, sf_dir)


@query(f"{GH_SIGN} SELECT mid, is_tu FROM gh")
def tu_by_camion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix is totally unimodular if its signs are Camion's and those of its support make it so."""
    told = camion.camion_test(part_sign(spark, sf_dir)).select("mid", "is_camion")
    return told.join(_signed_tu(spark, sf_dir), "mid").select("mid", (F.col("is_camion") & F.col("is_tu")).alias("is_tu"))


def _cycles(ms: Matrices, found: DataFrame) -> DataFrame:
    """``mid, is_cycle, is_wrong`` of the submatrices ``found(mid, rows, cols)``: whether they have two
    nonzeros in each line, and a sum that isn't a multiple of four."""
    inner, _ = storage.written(algebra.slice_submatrix(ms, found.select("mid", "rows", "cols")).entries, "cycle-cells")
    lines = paths.adjacency(Matrices(ms.dims, inner)).groupBy("mid", "a").agg(F.count("*").alias("k")).groupBy("mid").agg((F.min("k") == 2).alias("least"), (F.max("k") == 2).alias("most"), F.count("*").alias("lines"))
    sums = inner.groupBy("mid").agg((F.pmod(F.sum("v"), F.lit(4)) != 0).alias("is_wrong"))
    out = found.select("mid", (F.size("rows") + F.size("cols")).alias("size")).join(lines, "mid").join(sums, "mid")
    return out.select("mid", (F.col("least") & F.col("most") & (F.col("lines") == F.col("size"))).alias("is_cycle"), "is_wrong")


@query(f"{SIGN_CLASS} SELECT mid, TRUE AS is_cycle, TRUE AS is_wrong FROM sup JOIN gh USING (mid) WHERE is_regular AND NOT is_tu")
def camion_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matrices with regular support but other signs: what the violators are."""
    ms, _ = storage.written_matrices(part_sign(spark, sf_dir), "camion-matrices")
    found, _ = storage.written(camion.camion_test(ms).where("NOT is_camion").join(_signed_tu(spark, sf_dir).where("is_tu"), "mid", "left_semi"), "camion-violators")
    return _cycles(ms, found)


# --- balancedness -----------------------------------------------------------------------


@query(f"{UNBALANCED} SELECT mid, CAST(least AS INTEGER) AS size, TRUE AS is_cycle, TRUE AS is_wrong FROM bad")
def balance_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the holes with another sum, which are least, and what they are."""
    ms, _ = storage.written_matrices(part_sign(spark, sf_dir), "balance-matrices")
    found, _ = storage.written(balance.balanced_test(ms).where("NOT is_balanced"), "balance-violators")
    return found.select("mid", F.size("rows").alias("size")).join(_cycles(ms, found), "mid")


@query(f"""WITH e AS MATERIALIZED ({ORDER_SQL}), two AS (SELECT a.mid, a.c, a.r AS r, b.r AS s, a.v + b.v AS v FROM e a JOIN e b ON a.mid = b.mid AND a.c = b.c AND a.r < b.r)
SELECT DISTINCT x.mid, FALSE AS is_balanced FROM two x JOIN two y ON x.mid = y.mid AND x.r = y.r AND x.s = y.s AND x.c < y.c WHERE (x.v + y.v) % 4 <> 0""")
def balanced_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matrices of 1,280 lines: those whose least violators have two rows."""
    return balance.balanced_test(order_sign(spark, sf_dir)).where("size(rows) = 2").select("mid", "is_balanced")


# --- elimination ------------------------------------------------------------------------


@query(f"{LARGEST} SELECT mid, CAST(any_value(size) AS INTEGER) AS rank, TRUE AS equal, '1' AS det FROM m GROUP BY mid")
def echelon_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, whether the transformations take the matrices to their echelon forms, and the
    transformations' determinants."""
    ms, _ = storage.written_matrices(part_count(spark, sf_dir), "echelon-matrices")
    found = elimination.echelon(ms)
    ranks = found.pivots.groupBy("mid").agg(F.count("*").cast("int").alias("rank"))
    square = Matrices(ms.dims.select("mid", "m", F.col("m").alias("n")), found.transformation())
    at = lambda e: Matrices(ms.dims, e.select("mid", "r", "c", "v"))
    same = algebra.equal(at(elimination.transformed(ms, found)), at(found.form()))
    return ranks.join(same, "mid").join(elimination.determinants(square), "mid").select("mid", "rank", "equal", "det")
