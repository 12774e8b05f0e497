"""The registered queries over the matrix operators, each with its SQL where there is one."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..model import Matrices, packed, problems
from ..operators import algebra, balance, blocks
from ..operators import camion as camion_signs
from ..operators import elimination, kary, multigraphs, pivots, recognition, series, sums, trees
from ..sources import generators, text
from ..streaming import gates
from .families import BINARY_SQL, COUNT_SQL, EMBED_SQL, SIGN_SQL, embeddings, part_binary, part_count, part_sign, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _entries(ms: Matrices) -> DataFrame:
    return ms.entries.select("mid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


# --- total unimodularity --------------------------------------------------------

#: Ghouila-Houri in SQL over entries ``e(key.., r, c, v)`` of matrices with 4 rows: of each
#: pattern of a column and each set s of rows, the parts t of s (as bits) that split it well.
GH = """
side AS (SELECT CAST(x AS BIGINT) AS x FROM range(0, 16) a(x)),
fit AS (SELECT a.x AS p, b.x AS q, s.x AS s, bit_or(CASE WHEN (t.x & s.x) = t.x AND abs(bit_count(a.x & s.x & ~t.x) - bit_count(b.x & s.x & ~t.x)
    - bit_count(a.x & t.x) + bit_count(b.x & t.x)) <= 1 THEN CAST(1 AS BIGINT) << t.x ELSE 0 END) AS parts
  FROM side a, side b, side s, side t WHERE (a.x & b.x) = 0 AND s.x > 0 GROUP BY a.x, b.x, s.x),
pattern AS (SELECT DISTINCT {key}, p, q FROM (SELECT {key}, c, CAST(sum(CASE WHEN v = 1 THEN 1 << r ELSE 0 END) AS BIGINT) AS p,
  CAST(sum(CASE WHEN v = -1 THEN 1 << r ELSE 0 END) AS BIGINT) AS q FROM e GROUP BY {key}, c)),
sets AS (SELECT {key}, s, bit_and(parts) <> 0 AS ok FROM pattern JOIN fit USING (p, q) GROUP BY {key}, s),
gh AS (SELECT {key}, bool_and(ok) AS is_tu FROM sets GROUP BY {key})"""
GH_SIGN = f"WITH e AS ({SIGN_SQL}), {GH.format(key='mid')}"


@query(f"{GH_SIGN} SELECT mid, is_tu FROM gh")
def tu_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghouila-Houri's test on bit masks."""
    return recognition.tu_by_masks(part_sign(spark, sf_dir))


@query(f"{GH_SIGN} SELECT mid, is_tu FROM gh")
def tu_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.tu_test(part_sign(spark, sf_dir), "partition").select("mid", "is_tu")


@query(f"{GH_SIGN} SELECT mid, is_tu FROM gh")
def tu_eulerian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.tu_test(part_sign(spark, sf_dir), "eulerian").select("mid", "is_tu")


@query(f"{GH_SIGN} SELECT mid, is_tu FROM gh")
def tu_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.tu_test(part_sign(spark, sf_dir)).select("mid", "is_tu")


def _sub_dets(ms: Matrices, subs: DataFrame) -> DataFrame:
    return elimination.determinants(algebra.slice_submatrix(ms, subs))


@query(f"{GH_SIGN} SELECT mid, 2 AS det FROM gh WHERE NOT is_tu")
def tu_violator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal violators, checked: their determinants are 2 up to sign."""
    ms, _ = storage.written_matrices(part_sign(spark, sf_dir), "violator-matrices")
    bad, _ = storage.written(recognition.tu_test(ms).where("NOT is_tu").select("mid", "rows", "cols"), "violators")
    return _sub_dets(ms, bad).select("mid", F.abs(F.col("det").cast("int")).alias("det"))


@query(f"{GH_SIGN} SELECT mid, CASE WHEN is_tu THEN 1 ELSE -1 END AS regularity FROM gh")
def seymour_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.decompositions(part_sign(spark, sf_dir)).where("node = 0").select("mid", "regularity")


@query(f"{GH_SIGN} SELECT mid, CASE WHEN is_tu THEN 1 ELSE -1 END AS regularity FROM gh")
def seymour_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decompositions of one level, written and completed."""
    nodes, _ = storage.written(recognition.partial_decompositions(part_sign(spark, sf_dir), 1), "partial")
    return recognition.completed(nodes).where("node = 0").select("mid", "regularity")


@query()
def seymour_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.decompositions(part_sign(spark, sf_dir))


def _attributes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decompositions and their attributes, told anew from the leaves' kinds."""
    nodes, _ = storage.written(recognition.decompositions(part_sign(spark, sf_dir)), "nodes")
    kept = F.col("kind").isin("GRAPH", "COGRAPH", "DELTASUM", "THREESUM")
    return nodes, trees.attributes(nodes.withColumns({x: F.when(kept, F.col(x)) for x in trees.ATTRIBUTES}))


@query()
def seymour_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of inner nodes."""
    nodes, told = _attributes(spark, sf_dir)
    inner = nodes.where("parent IS NOT NULL").select("mid", F.col("parent").alias("node")).distinct()
    return told.join(inner, ["mid", "node"]).select("mid", "node", "regularity")


@query("SELECT s_suppkey AS mid, CASE WHEN s_suppkey % 3 < 2 THEN 'THREESUM' END AS kind, CASE WHEN s_suppkey % 3 < 2 THEN TRUE END AS rebuilt FROM supplier")
def named_separations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-separations of R12, of its dual, and (there is none) of R10, one for each supplier, its
    lines in a random order."""
    of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mid"), (F.col("s_suppkey") % 3).alias("k"))
    ms = generators.literals(spark, ["R_12", "R_12*", "R_10.2"], of)
    return recognition.three_separations(algebra.permute(ms, algebra.random_order(ms))).select("mid", "kind", "rebuilt")


@query()
def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tree_text(recognition.decompositions(part_sign(spark, sf_dir)))


# --- complements ------------------------------------------------------------------

#: A 4 x 7 matrix in one row: the masks of its columns' ones.
WHOLE = f"""b AS ({BINARY_SQL}), whole AS (SELECT mid, {', '.join(f'CAST(sum(CASE WHEN c = {j} THEN 1 << r ELSE 0 END) AS BIGINT) AS x{j}' for j in range(7))} FROM b GROUP BY mid)"""


def _flipped(i: str, j: str) -> str:
    """The columns of ``whole`` complemented at row i (4: none) and column j (7: none)."""
    line = f"CASE {j} " + " ".join(f"WHEN {c} THEN x{c}" for c in range(7)) + " ELSE 0 END"
    d = f"(({line}) >> {i}) & 1"
    rest = f"(15 & ~(CASE WHEN {i} < 4 THEN CAST(1 AS BIGINT) << {i} ELSE 0 END))"
    own = lambda c: f"xor(x{c}, CASE WHEN {d} = 1 THEN {rest} ELSE 0 END)"
    other = lambda c: f"xor(xor(xor(x{c}, {line}), CASE WHEN {d} = 1 THEN {rest} ELSE 0 END), CASE WHEN (x{c} >> {i}) & 1 = 1 THEN {rest} ELSE 0 END)"
    return "[" + ", ".join(f"CASE WHEN {j} = {c} THEN {own(c)} ELSE {other(c)} END" for c in range(7)) + "]"


@query(f"""WITH {WHOLE}, z AS (SELECT mid, unnest({_flipped('1', '2')}) AS x, unnest(range(0, 7)) AS c FROM whole)
SELECT mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 1 AS v FROM z, range(0, 4) y(r) WHERE (x >> r) & 1 = 1""")
def complement_row_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_binary(spark, sf_dir)
    return _entries(recognition.complements(ms, ms.dims.select("mid", F.lit(1).alias("i"), F.lit(2).alias("j"))))


@query(f"""WITH {WHOLE}, z AS (SELECT mid, i, j, unnest({_flipped('i', 'j')}) AS x, unnest(range(0, 7)) AS c FROM whole, range(0, 5) a(i), range(0, 8) o(j)),
e AS (SELECT mid, i, j, r, c, (x >> r) & 1 AS v FROM z, range(0, 4) y(r)),
{GH.format(key="mid, i, j")}, bad AS (SELECT mid, min(i * 100 + j) FILTER (NOT is_tu) AS w FROM gh GROUP BY mid)
SELECT mid, w IS NULL AS is_ctu, CASE WHEN w // 100 < 4 THEN CAST(w // 100 AS INTEGER) END AS row, CASE WHEN w % 100 < 7 THEN CAST(w % 100 AS INTEGER) END AS col FROM bad""")
def ctu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.ctu_test(part_binary(spark, sf_dir))


# --- algebra ----------------------------------------------------------------------


@query(f"SELECT mid, c AS r, r AS c, v FROM ({SIGN_SQL})")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(algebra.transpose(part_sign(spark, sf_dir)))


@query(f"SELECT mid, 3 - r AS r, CAST((c + 2) % 7 AS INTEGER) AS c, v FROM ({SIGN_SQL})")
def permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    axis = lambda a, n, old: ms.dims.select("mid", F.lit(a).alias("axis"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("new")).withColumn("old", old)
    order = axis("r", 4, 3 - F.col("new")).unionByName(axis("c", 7, (F.col("new") + 5) % 7))
    return _entries(algebra.permute(ms, order))


@query(f"""SELECT mid, CASE r WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS r, CASE c WHEN 5 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS c, v
FROM ({SIGN_SQL}) WHERE r IN (3, 0, 1) AND c IN (5, 1, 3, 0)""")
def slice_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    lists = [F.array(*map(F.lit, x)) for x in ((3, 0, 1), (5, 1, 3, 0))]
    return _entries(algebra.slice_submatrix(ms, ms.dims.select("mid", lists[0].alias("rows"), lists[1].alias("cols"))))


@query(f"SELECT mid, r, c, 1 AS v FROM ({EMBED_SQL}) WHERE abs(v) > 0.05")
def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(algebra.support(embeddings(spark, sf_dir), 0.05))


@query(f"SELECT mid, r, c, CAST(sign(v) AS INTEGER) AS v FROM ({EMBED_SQL}) WHERE abs(v) > 0.05")
def signed_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(algebra.signed_support(embeddings(spark, sf_dir), 0.05))


@query(f"SELECT mid, r, c, CAST(round(v * 10) AS INTEGER) AS v FROM ({EMBED_SQL}) WHERE round(v * 10) <> 0")
def convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = embeddings(spark, sf_dir)
    return _entries(Matrices(ms.dims, ms.entries.withColumn("v", F.col("v") * 10)).cast("int"))


@query(f"""WITH e AS ({SIGN_SQL}) SELECT d.mid, coalesce(e.v, 0) AS v FROM (SELECT DISTINCT mid FROM e) d LEFT JOIN e ON d.mid = e.mid AND r = 1 AND c = 3""")
def find_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.find_entry(part_sign(spark, sf_dir), 1, 3)


@query(f"""WITH a AS ({SIGN_SQL}), b AS ({BINARY_SQL}),
d AS (SELECT mid, count(*) AS k FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY mid)
SELECT m.mid, d.k IS NULL AND a.mid IS NOT NULL AS equal FROM (SELECT DISTINCT mid FROM b) m LEFT JOIN d USING (mid) LEFT JOIN (SELECT DISTINCT mid FROM a) a USING (mid)""")
def equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.equal(part_sign(spark, sf_dir), part_binary(spark, sf_dir))


@query(f"SELECT DISTINCT mid, '3,0,1' AS rows, '1,3' AS cols FROM ({SIGN_SQL})")
def submatrix_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unslicing a slice, and slicing that again."""
    arr = lambda *x: F.array(*map(F.lit, x))
    s = part_sign(spark, sf_dir).dims.select("mid", algebra.sub(arr(3, 0, 2, 1), arr(5, 1, 3)).alias("base"), algebra.sub(arr(0, 1, 3), arr(1, 2)).alias("inner"))
    s = s.withColumn("outer", algebra.sub_unslice("base", "inner")).withColumn("again", algebra.sub_slice("base", "outer"))
    return s.where("again = inner").select("mid", F.array_join("outer.rows", ",").alias("rows"), F.array_join("outer.cols", ",").alias("cols"))


@query(f"SELECT mid, bool_and(v = 1) AS equal FROM ({SIGN_SQL}) GROUP BY mid")
def transpose_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the transpose of the support."""
    return algebra.is_transpose(part_sign(spark, sf_dir), algebra.transpose(part_binary(spark, sf_dir)))


@query(f"""WITH e AS ({COUNT_SQL}) SELECT DISTINCT mid, 'matrix not listed' AS problem FROM e WHERE mid % 3 = 0
UNION ALL SELECT DISTINCT mid, 'row out of range' FROM e WHERE mid % 3 <> 0 AND r >= 3 UNION ALL SELECT DISTINCT mid, 'column out of range' FROM e WHERE mid % 3 <> 0 AND c >= 6
UNION ALL SELECT DISTINCT mid, 'stored zero' FROM e WHERE v = 1 UNION ALL SELECT DISTINCT mid, 'duplicate entry' FROM e WHERE c = 2""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a collection with all kinds of problems."""
    ms = part_count(spark, sf_dir)
    dims = ms.dims.where("mid % 3 <> 0").select("mid", F.lit(3).alias("m"), F.lit(6).alias("n"))
    e = ms.entries.withColumn("v", F.col("v") - 1)
    return problems(Matrices(dims, e.unionByName(e.where("c = 2"))))


@query(f"SELECT mid, v, count(*) AS entries, count(DISTINCT r) AS rows, count(DISTINCT c) AS cols FROM ({SIGN_SQL}) GROUP BY mid, v")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no order of the lines changes: of each value how many entries, rows and columns have it."""
    ms = part_sign(spark, sf_dir)
    e = algebra.permute(ms, algebra.random_order(ms, 7)).entries
    return e.groupBy("mid", "v").agg(F.count("*").alias("entries"), F.countDistinct("r").alias("rows"), F.countDistinct("c").alias("cols"))


# --- entries -----------------------------------------------------------------------

WITNESS = """SELECT mid, count(*) FILTER ({bad}) = 0 AS {name}, CAST(min(r * 1000 + c) FILTER ({bad}) // 1000 AS INTEGER) AS bad_r,
CAST(min(r * 1000 + c) FILTER ({bad}) % 1000 AS INTEGER) AS bad_c FROM ({e}) GROUP BY mid"""


@query(WITNESS.format(bad="v NOT IN (0, 1)", name="is_binary", e=COUNT_SQL))
def is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kary.is_binary(part_count(spark, sf_dir))


@query(WITNESS.format(bad="v NOT IN (-1, 0, 1)", name="is_ternary", e=COUNT_SQL))
def is_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kary.is_ternary(part_count(spark, sf_dir))


@query(WITNESS.format(bad="abs(v - round(v)) > 0.000000001", name="is_integer", e=f"SELECT * FROM (SELECT mid, r, c, CASE WHEN mid % 2 = 0 THEN round(v * 10) ELSE v END AS v FROM ({EMBED_SQL})) WHERE v <> 0"))
def is_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the embeddings, every other matrix rounded to tenths and multiplied by ten."""
    ms = embeddings(spark, sf_dir)
    v = F.when(F.col("mid") % 2 == 0, F.round(F.col("v") * 10)).otherwise(F.col("v"))
    return kary.is_integer(Matrices(ms.dims, ms.entries.withColumn("v", v).where("v <> 0")))


@query(f"SELECT DISTINCT mid, TRUE AS is_binary FROM ({COUNT_SQL}) WHERE v = 1")
def large_binary_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is kept, whether it is binary; a matrix with a one keeps a nonzero."""
    ms = part_count(spark, sf_dir)
    found, _ = storage.written(kary.large_submatrix(ms), "large-binary-submatrix")
    some = ms.entries.where("v = 1").select("mid").distinct()
    return kary.is_binary(algebra.slice_submatrix(ms, found)).join(some, "mid", "left_semi").select("mid", "is_binary")


@query(f"SELECT DISTINCT mid, TRUE AS is_ternary FROM ({COUNT_SQL}) WHERE v = 1")
def large_ternary_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is kept, whether it is ternary; a matrix with a one keeps a nonzero."""
    ms = part_count(spark, sf_dir)
    found, _ = storage.written(kary.large_submatrix(ms, ternary=True), "large-ternary-submatrix")
    some = ms.entries.where("v = 1").select("mid").distinct()
    return kary.is_ternary(algebra.slice_submatrix(ms, found)).join(some, "mid", "left_semi").select("mid", "is_ternary")


@query(f"SELECT mid, count(*) AS nonzeros, bool_and(v IN (0, 1)) AS is_binary, bool_and(v IN (-1, 0, 1)) AS is_ternary FROM ({COUNT_SQL}) GROUP BY mid")
def entry_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates as a stream over written entries; the last state of each matrix."""
    source, path = storage.written(part_count(spark, sf_dir).entries, "entries")
    out, log = storage.new_path(spark, "gate"), storage.new_path(spark, "gate-log")
    stream = gates.entry_gate(spark.readStream.schema(source.schema).parquet(path))
    gates.run_to_end(stream, out, log)
    states = spark.read.schema(stream.schema).parquet(out)
    return states.groupBy("mid").agg(F.max(F.struct("nonzeros", "is_binary", "is_ternary")).alias("s")).select("mid", "s.*")


# --- pivots and determinants ----------------------------------------------------------


def _pivot_sql(family: str, value: str, first: str = "min(r * 1000 + c)") -> str:
    return f"""WITH e AS ({family}), spot AS (SELECT mid, {first} // 1000 AS p, {first} % 1000 AS q FROM e GROUP BY mid),
a AS (SELECT e.mid, v AS alpha, p, q FROM e JOIN spot ON e.mid = spot.mid AND r = p AND c = q),
terms AS (SELECT e.mid, r, c, CASE WHEN r = p AND c = q THEN -v WHEN r = p OR c = q THEN alpha * v ELSE v END AS x FROM e JOIN a USING (mid)
  UNION ALL SELECT y.mid, y.r, x.c, -alpha * y.v * x.v FROM a JOIN e x ON x.mid = a.mid AND x.r = p AND x.c <> q JOIN e y ON y.mid = a.mid AND y.c = q AND y.r <> p)
SELECT * FROM (SELECT mid, r, c, CAST({value} AS INTEGER) AS v FROM terms GROUP BY mid, r, c) WHERE v <> 0"""


def _first_entries(ms: Matrices) -> DataFrame:
    return ms.entries.groupBy("mid").agg(F.min(F.struct("r", "c")).alias("w")).select("mid", F.col("w.r").alias("p"), F.col("w.c").alias("q"))


@query(_pivot_sql(BINARY_SQL, "abs(sum(x)) % 2"))
def binary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_binary(spark, sf_dir)
    return _entries(pivots.pivot(ms, _first_entries(ms), 2))


@query(_pivot_sql(SIGN_SQL, "(sum(x) + 1 + 30) % 3 - 1"))
def ternary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return _entries(pivots.pivot(ms, _first_entries(ms), 3))


_LOT = "arg_min(r * 1000 + c, md5('5:0:' || mid || ':' || r || ':' || c))"


@query(_pivot_sql(BINARY_SQL, "abs(sum(x)) % 2", _LOT))
def random_pivot_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(pivots.random_pivots(part_binary(spark, sf_dir), 1, 2, seed=5))


@query(_pivot_sql(SIGN_SQL, "(sum(x) + 1 + 30) % 3 - 1", _LOT))
def random_pivot_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(pivots.random_pivots(part_sign(spark, sf_dir), 1, 3, seed=5))


@query(f"WITH t AS ({_pivot_sql(SIGN_SQL, 'sum(x)')}) SELECT mid, CAST(min(r * 1000 + c) // 1000 AS INTEGER) AS r, CAST(min(r * 1000 + c) % 1000 AS INTEGER) AS c FROM t WHERE abs(v) > 1 GROUP BY mid")
def regular_pivot_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entries that regular pivots would leave outside of -1, 0 and 1."""
    ms = part_sign(spark, sf_dir)
    return pivots.outside_units(pivots.pivot(ms, _first_entries(ms))).select("mid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))


@query(_pivot_sql(SIGN_SQL, "sum(x)"))
def regular_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return _entries(pivots.pivot(ms, _first_entries(ms)))


@query(f"SELECT mid, r, c, v FROM ({SIGN_SQL})")
def pivot_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoting twice at one entry negates its row and column but for itself."""
    ms = part_sign(spark, sf_dir)
    at = _first_entries(ms)
    twice, _ = storage.written(pivots.pivots(ms, [at, at]).entries, "pivots")
    v = F.when((F.col("r") == F.col("p")) != (F.col("c") == F.col("q")), -F.col("v")).otherwise(F.col("v"))
    first = ms.entries.select("mid", F.col("r").alias("p"), F.col("c").alias("q"), F.col("v").alias("a")).join(at, ["mid", "p", "q"])
    return twice.join(first, "mid").select("mid", "r", "c", v.cast("int").alias("v"))


def _leibniz() -> str:
    def sign(p):
        return (-1) ** sum(p[i] > p[j] for i in range(4) for j in range(i, 4))

    return " + ".join(f"({sign(p)}) * " + " * ".join(f"a{i}{j}" for i, j in enumerate(p)) for p in permutations(range(4)))


@query(f"""WITH e AS ({COUNT_SQL}), w AS (SELECT mid, {', '.join(f'coalesce(max(v) FILTER (r = {i} AND c = {j}), 0) AS a{i}{j}' for i in range(4) for j in range(4))} FROM e GROUP BY mid)
SELECT mid, CAST({_leibniz()} AS BIGINT) AS det FROM w""")
def determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first four columns."""
    ms = part_count(spark, sf_dir)
    four = F.array(*map(F.lit, range(4)))
    return _sub_dets(ms, ms.dims.select("mid", four.alias("rows"), four.alias("cols"))).select("mid", F.col("det").cast("long").alias("det"))


@query(f"""WITH e AS ({COUNT_SQL}) SELECT a.mid, a.r AS r1, b.r AS r2, a.c AS c1, x.c AS c2, CAST(a.v * y.v - x.v * b.v AS INTEGER) AS det
FROM e a JOIN e x ON x.mid = a.mid AND x.r = a.r AND x.c > a.c JOIN e b ON b.mid = a.mid AND b.c = a.c AND b.r > a.r JOIN e y ON y.mid = a.mid AND y.r = b.r AND y.c = x.c""")
def determinants_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.determinants_2x2(part_count(spark, sf_dir))


def _minor(rows: tuple[int, ...], cols: tuple[int, ...]) -> str:
    sign = lambda p: (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i, len(p)))
    return " + ".join(f"({sign(p)})*" + "*".join(f"a{r}{cols[x]}" for r, x in zip(rows, p)) for p in permutations(range(len(rows))))


def _minors() -> str:
    """All minors of 4 x 7 matrices as ``(size, rows, cols, value)``."""
    parts = []
    for k in range(1, 5):
        at = [(r, c) for r in combinations(range(4), k) for c in combinations(range(7), k)]
        names = [", ".join("'" + "".join(map(str, x[i])) + "'" for x in at) for i in (0, 1)]
        parts.append(f"SELECT mid, {k} AS size, unnest([{names[0]}]) AS rows, unnest([{names[1]}]) AS cols, unnest([{', '.join(_minor(*x) for x in at)}]) AS value FROM w")
    return " UNION ALL ".join(parts)


#: The largest minors that aren't all zero.
LARGEST = f"""WITH e AS ({COUNT_SQL}), w AS (SELECT mid, {', '.join(f'CAST(coalesce(max(v) FILTER (r = {i} AND c = {j}), 0) AS BIGINT) AS a{i}{j}' for i in range(4) for j in range(7))} FROM e GROUP BY mid),
d AS (SELECT * FROM ({_minors()}) WHERE value <> 0), top AS (SELECT mid, max(size) AS size FROM d GROUP BY mid),
m AS (SELECT mid, size, rows, cols, abs(value) AS value FROM d JOIN top USING (mid, size))"""


@query(f"""{LARGEST}, f AS (SELECT mid, min(cols) AS cols FROM m GROUP BY mid)
SELECT mid, CAST(any_value(size) AS INTEGER) AS rank, CAST(list_reduce(list(value), lambda x, y: gcd(x, y)) AS VARCHAR) AS product FROM m JOIN f USING (mid, cols) GROUP BY mid""")
def echelon_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: the product is the divisor of the largest minors of the first columns that have any."""
    return elimination.diagonals(part_count(spark, sf_dir))


# --- blocks and lines -------------------------------------------------------------------


BLOCKS = f"""WITH RECURSIVE e AS ({SIGN_SQL}), node AS (SELECT mid, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT mid FROM e), range(0, 11) y(x)),
pair AS (SELECT mid, r AS x, 4 + c AS y FROM e UNION ALL SELECT mid, 4 + c, r FROM e),
reach(mid, x, y) AS (SELECT mid, x, x FROM node UNION SELECT reach.mid, reach.x, pair.y FROM reach JOIN pair ON reach.mid = pair.mid AND reach.y = pair.x),
root AS (SELECT mid, x, min(y) AS low FROM reach GROUP BY mid, x)"""


@query(f"""{BLOCKS} SELECT mid, CASE WHEN x < 4 THEN -1 - x ELSE x - 3 END AS element, CAST(dense_rank() OVER (PARTITION BY mid ORDER BY low) - 1 AS INTEGER) AS block FROM root""")
def block_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_of_lines(part_sign(spark, sf_dir))


@query(f"""{BLOCKS} SELECT mid, coalesce(string_agg(x, ',' ORDER BY x) FILTER (x < 4), '') AS rows, coalesce(string_agg(x - 4, ',' ORDER BY x) FILTER (x >= 4), '') AS cols FROM root GROUP BY mid, low""")
def block_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.decompose_blocks(part_sign(spark, sf_dir))
    return found.select("mid", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("rows", "cols")])


@query(f"""WITH e AS ({SIGN_SQL}), d AS (SELECT DISTINCT mid FROM e)
SELECT d.mid, CAST(-1 - x AS INTEGER) AS element, count(e.v) AS degree FROM d CROSS JOIN range(0, 4) y(x) LEFT JOIN e ON e.mid = d.mid AND r = x GROUP BY ALL
UNION ALL SELECT d.mid, CAST(1 + x AS INTEGER), count(e.v) FROM d CROSS JOIN range(0, 7) y(x) LEFT JOIN e ON e.mid = d.mid AND c = x GROUP BY ALL""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.degrees(part_sign(spark, sf_dir))


@query(f"""WITH x AS (SELECT mid, r, list(struct_pack(c := c, v := v * s) ORDER BY c) AS k FROM (SELECT *, first_value(v) OVER (PARTITION BY mid, r ORDER BY c) AS s FROM ({SIGN_SQL})) GROUP BY mid, r)
SELECT mid, r, first FROM (SELECT mid, r, min(r) OVER (PARTITION BY mid, k) AS first FROM x) WHERE r <> first""")
def parallel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.parallel_rows(part_sign(spark, sf_dir))


# --- sums ---------------------------------------------------------------------------------


@query(f"""WITH e AS ({SIGN_SQL}), p AS (SELECT mid, mid // 10 AS sid, row_number() OVER (PARTITION BY mid // 10 ORDER BY mid) - 1 AS k FROM (SELECT DISTINCT mid FROM e))
SELECT sid AS mid, CAST(r + 4 * k AS INTEGER) AS r, CAST(c + 7 * k AS INTEGER) AS c, v FROM e JOIN p USING (mid)""")
def one_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return _entries(sums.one_sum(ms, ms.dims.select(F.expr("mid div 10").alias("sid"), F.col("mid").alias("place"), "mid")))


TWO_SUM = f"""WITH a AS ({SIGN_SQL})
SELECT mid, CAST(r - (r > 1)::INT AS INTEGER) AS r, c, v FROM a WHERE r <> 1
UNION ALL SELECT mid, r + 3, CAST(7 + c - (c > 2)::INT AS INTEGER), v FROM a WHERE c <> 2
UNION ALL SELECT y.mid, y.r + 3, x.c, y.v * x.v FROM a x JOIN a y ON x.mid = y.mid AND x.r = 1 AND y.c = 2"""


@query(TWO_SUM)
def two_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matrix with itself, along its second row and third column."""
    ms = part_sign(spark, sf_dir)
    return _entries(sums.two_sum(ms, ms, ms.dims.select("mid", F.lit(1).alias("row"), F.lit(2).alias("col"))))


@query(f"""WITH a AS ({SIGN_SQL})
SELECT mid, r, CAST(c - (c > 2)::INT AS INTEGER) AS c, v FROM a WHERE c <> 2
UNION ALL SELECT mid, CAST(4 + r - (r > 1)::INT AS INTEGER), 6 + c, v FROM a WHERE r <> 1
UNION ALL SELECT x.mid, x.r, 6 + y.c, x.v * y.v FROM a x JOIN a y ON x.mid = y.mid AND x.c = 2 AND y.r = 1""")
def two_sum_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matrix with itself, along its third column and second row."""
    ms = part_sign(spark, sf_dir)
    return _entries(sums.two_sum_by_column(ms, ms, ms.dims.select("mid", F.lit(2).alias("col"), F.lit(1).alias("row"))))


@query(f"SELECT * FROM ({TWO_SUM}) WHERE mid IN (SELECT mid FROM ({SIGN_SQL}) WHERE r = 1) AND mid IN (SELECT mid FROM ({SIGN_SQL}) WHERE c = 2)")
def two_sum_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-sums taken apart and put together again."""
    ms = part_sign(spark, sf_dir)
    whole = sums.two_sum(ms, ms, ms.dims.select("mid", F.lit(1).alias("row"), F.lit(2).alias("col")))
    first = ms.dims.select("mid", F.sequence(F.lit(0), F.lit(2)).alias("rows"), F.sequence(F.lit(0), F.lit(6)).alias("cols"))
    found, _ = storage.written(sums.parts(whole, first, "TWOSUM"), "two-sum-parts")
    one, two = sums.part_matrices(found, 0), sums.part_matrices(found, 1)
    return _entries(sums.two_sum(one, two, one.dims.select("mid", (F.col("m") - 1).alias("row"), F.lit(0).alias("col"))))


def _spots(ms: Matrices, *cells: tuple[int, int, int]) -> DataFrame:
    spots = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(v).alias("v")) for r, c, v in cells])
    return ms.dims.select("mid", F.explode(spots).alias("x")).select("mid", "x.r", "x.c", "x.v")


def _picked(e: DataFrame, *pieces: tuple[str, int, int]) -> DataFrame:
    """Of entries those under each condition, moved by so many rows and columns."""
    out = [e.where(where).select("mid", (F.col("r") + r).alias("r"), (F.col("c") + c).alias("c"), "v") for where, r, c in pieces]
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def _delta_pairs(ms: Matrices) -> tuple[Matrices, Matrices, DataFrame]:
    """[A a a; c 0 1] and [1 0 b; d d D] of each matrix [A a .; c . .] = [. . b; d . D]."""
    first = _picked(ms.entries, ("r < 3 AND c <= 5", 0, 0), ("r < 3 AND c = 5", 0, 1), ("r = 3 AND c < 5", 0, 0)).unionByName(_spots(ms, (3, 6, 1)))
    second = _picked(ms.entries, ("c >= 2", 0, 0), ("r > 0 AND c = 0", 0, 0), ("r > 0 AND c = 0", 0, 1)).unionByName(_spots(ms, (0, 0, 1)))
    special = ms.dims.select("mid", *[F.lit(x).alias(n) for n, x in (("row", 3), ("x", 5), ("y", 6), ("row2", 0), ("u", 0), ("w", 1))])
    return Matrices(ms.dims, first), Matrices(ms.dims, second), special


DELTA = f"""WITH a AS ({SIGN_SQL}) SELECT mid, r, c, v FROM a WHERE r < 3 AND c < 5
UNION ALL SELECT mid, r + 2, c + 3, v FROM a WHERE r > 0 AND c >= 2
UNION ALL SELECT x.mid, x.r, y.c + 3, x.v * y.v FROM a x JOIN a y ON x.mid = y.mid AND x.r < 3 AND x.c = 5 AND y.r = 0 AND y.c >= 2
UNION ALL SELECT x.mid, x.r + 2, y.c, x.v * y.v FROM a x JOIN a y ON x.mid = y.mid AND x.r > 0 AND x.c = 0 AND y.r = 3 AND y.c < 5"""


@query(DELTA)
def delta_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms, _ = storage.written_matrices(part_sign(spark, sf_dir), "delta-matrices")
    return _entries(sums.delta_sum(*_delta_pairs(ms)))


@query(f"SELECT DISTINCT mid FROM ({SIGN_SQL}) WHERE r < 3 AND c = 5")
def delta_sum_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose second special column lacks its copy."""
    first, second, special = _delta_pairs(part_sign(spark, sf_dir))
    return sums.delta_problems(Matrices(first.dims, first.entries.where("c <> 6 OR r = 3")), second, special)


@query(f"SELECT mid, c AS r, r AS c, v FROM ({DELTA})")
def y_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, special = _delta_pairs(part_sign(spark, sf_dir))
    special = special.withColumnsRenamed({"row": "col", "row2": "col2"})
    return _entries(sums.y_sum(algebra.transpose(first), algebra.transpose(second), special))


@query(f"""WITH a AS ({SIGN_SQL}), d AS (SELECT DISTINCT mid FROM a),
line AS (SELECT mid, 0 AS line, 0 AS c, 1 AS v FROM d UNION ALL SELECT mid, 1, 1, 1 FROM d UNION ALL SELECT mid, r - 2, c, v FROM a WHERE r >= 2 AND c >= 2),
kl AS (SELECT mid, 2 AS r, 0 AS line, 1 AS v FROM d UNION ALL SELECT mid, 3, 1, 1 FROM d UNION ALL SELECT mid, r + 2, c, v FROM a WHERE r >= 2 AND c < 2)
SELECT mid, r, c, v FROM a WHERE r < 2 UNION ALL SELECT mid, r + 2, c + 5, v FROM a WHERE c >= 2
UNION ALL SELECT * FROM (SELECT kl.mid, kl.r, line.c, CAST((sum(kl.v * line.v) + 1 + 30) % 3 - 1 AS INTEGER) AS v FROM kl JOIN line USING (mid, line) GROUP BY kl.mid, kl.r, line.c) WHERE v <> 0""")
def three_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts that are made of one matrix and share an identity block."""
    ms = part_sign(spark, sf_dir)
    first = _picked(ms.entries, ("r < 2 OR c >= 2", 0, 0)).unionByName(_spots(ms, (2, 0, 1), (3, 1, 1), (2, 7, 1), (3, 7, 1)))
    second = _picked(ms.entries, ("r < 2 AND c >= 2", 1, 0), ("r >= 2", 1, 0)).unionByName(_spots(ms, (0, 0, -1), (0, 1, 1), (1, 0, 1), (2, 1, 1)))
    sized = lambda m, n: ms.dims.select("mid", F.lit(m).alias("m"), F.lit(n).alias("n"))
    special = ms.dims.select("mid", *[F.lit(x).alias(n) for n, x in (("i", 2), ("j", 3), ("k", 0), ("l", 1), ("extra", 7), ("top", 0), ("i2", 1), ("j2", 2), ("k2", 0), ("l2", 1))])
    return _entries(sums.three_sum(Matrices(sized(4, 8), first), Matrices(sized(5, 7), second), special))


def _halves(ms: Matrices) -> DataFrame:
    x = blocks.lines(ms)
    return x.withColumn("part", F.when(F.col("element").isin(-1, -2, 1, 2, 3), 0).otherwise(1))


OFF = f"SELECT mid, CASE WHEN r >= 2 THEN 'low' ELSE 'high' END AS block, r, c, v FROM ({SIGN_SQL}) WHERE (r >= 2) <> (c >= 3)"


@query(OFF)
def off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return sums.off_diagonal(ms, _halves(ms))


@query(f"""WITH x AS (SELECT mid, block, r, list(struct_pack(c := c, v := v * s) ORDER BY c) AS k FROM (SELECT *, first_value(v) OVER (PARTITION BY mid, block, r ORDER BY c) AS s FROM ({OFF})) GROUP BY mid, block, r)
SELECT mid, block, min(r) AS r FROM x GROUP BY mid, block, k""")
def separation_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return sums.representatives(ms, _halves(ms))


@query(f"""WITH e AS ({OFF}) SELECT a.mid, a.r AS r1, b.r AS r2, a.c AS c1, x.c AS c2
FROM e a JOIN e x ON x.mid = a.mid AND x.block = a.block AND x.r = a.r AND x.c > a.c JOIN e b ON b.mid = a.mid AND b.block = a.block AND b.c = a.c AND b.r > a.r
JOIN e y ON y.mid = a.mid AND y.block = a.block AND y.r = b.r AND y.c = x.c WHERE abs(a.v * y.v - x.v * b.v) = 2""")
def separation_ternary_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    return sums.ternary_violators(ms, _halves(ms))


@query(f"""SELECT mid, CASE WHEN x < 0 THEN 'r' ELSE 'c' END AS axis, CASE WHEN x IN (-1, -2, 1, 2, 3) THEN 0 ELSE 1 END AS part, count(*) AS size
FROM (SELECT DISTINCT mid FROM ({SIGN_SQL})), range(-4, 8) y(x) WHERE x <> 0 GROUP BY ALL""")
def separation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums.part_sizes(_halves(part_sign(spark, sf_dir)))


# --- classes -------------------------------------------------------------------------------


#: Submatrices with two nonzeros in each line and a sum that isn't a multiple of four.
UNBALANCED = f"""WITH e AS ({SIGN_SQL}), sub AS (SELECT s, t FROM range(1, 16) a(s), range(1, 128) b(t) WHERE bit_count(s) = bit_count(t) AND bit_count(s) > 1),
inside AS (SELECT mid, s, t, r, c, v FROM e, sub WHERE (s >> r) & 1 = 1 AND (t >> c) & 1 = 1),
lines AS (SELECT mid, s, t, r, count(*) AS k FROM inside GROUP BY ALL), cols AS (SELECT mid, s, t, c, count(*) AS k FROM inside GROUP BY ALL),
rows_two AS (SELECT mid, s, t FROM lines GROUP BY ALL HAVING min(k) = 2 AND max(k) = 2 AND count(*) = bit_count(s)),
cols_two AS (SELECT mid, s, t FROM cols GROUP BY ALL HAVING min(k) = 2 AND max(k) = 2 AND count(*) = bit_count(t)),
total AS (SELECT mid, s, t, sum(v) AS x FROM inside GROUP BY ALL),
bad AS (SELECT mid, min(bit_count(s)) AS least FROM rows_two JOIN cols_two USING (mid, s, t) JOIN total USING (mid, s, t) WHERE x % 4 <> 0 GROUP BY mid)"""


@query(f"{UNBALANCED} SELECT mid, mid NOT IN (SELECT mid FROM bad) AS is_balanced FROM (SELECT DISTINCT mid FROM e)")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balanced_test(part_sign(spark, sf_dir)).select("mid", "is_balanced")


#: The points of a 4-row matrix's matroid as masks: unit vectors and different columns.
POINTS = """{name}_col AS (SELECT DISTINCT mid, CAST(x AS BIGINT) AS x FROM (SELECT mid, c, sum(1 << r) AS x FROM {e} GROUP BY mid, c)),
{name}_point AS (SELECT mid, x FROM {name}_col UNION SELECT mid, CAST(1 AS BIGINT) << i FROM (SELECT DISTINCT mid FROM {e}), range(0, 4) u(i)),
{name}_plane AS (SELECT mid, max(inside) AS inside, max(outside) AS outside, max(inside + outside) AS size FROM (SELECT mid, w, count(*) FILTER (bit_count(x & w) % 2 = 0) AS inside,
  count(*) FILTER (bit_count(x & w) % 2 = 1) AS outside FROM {name}_point, (SELECT CAST(w AS BIGINT) AS w FROM range(1, 16) p(w)) GROUP BY mid, w) GROUP BY mid),
{name}_star AS (SELECT mid, max(classes) AS classes FROM (SELECT a.mid, a.x, count(DISTINCT least(b.x, xor(a.x, b.x))) AS classes
  FROM {name}_point a JOIN {name}_point b ON a.mid = b.mid AND a.x <> b.x GROUP BY a.mid, a.x) GROUP BY mid),
{name} AS (SELECT mid, inside < 7 AND outside < 7 AND classes < 7 AS is_regular, inside < 7 AND outside < 7 AND classes < 7 AND size < 10 AS is_cographic,
  inside < 6 AND classes < 6 AS is_sp FROM {name}_plane JOIN {name}_star USING (mid))"""


def _tree_paths() -> str:
    """All trees with four named edges, as ``(tree, forth, back)``: for each way between two
    of its nodes the masks of the edges taken along and against their direction."""
    from itertools import product

    seen: dict[frozenset, list[tuple[int, int]]] = {}
    for code in product(range(5), repeat=3):  # Pruefer's codes of the trees on five nodes
        degree, edges = [1 + code.count(v) for v in range(5)], []
        for v in code:
            leaf = degree.index(1)
            edges.append((leaf, v))
            degree[leaf], degree[v] = 0, degree[v] - 1
        edges.append(tuple(v for v in range(5) if degree[v] == 1))
        for order in permutations(range(4)):
            ways = []
            for start in range(5):
                reached, todo = {start: (0, 0)}, [start]
                for x in todo:
                    forth, back = reached[x]
                    for bit, i in enumerate(order):
                        a, b = edges[i]
                        for u, w, step in ((a, b, (forth | 1 << bit, back)), (b, a, (forth, back | 1 << bit))):
                            if u == x and w not in reached:
                                reached[w] = step
                                todo.append(w)
                ways += [way for w, way in reached.items() if w != start]
            seen.setdefault(frozenset(f | b for f, b in ways), ways)
    return ", ".join(f"({i}, {f}, {b})" for i, ways in enumerate(seen.values()) for f, b in ways)


#: A 4-row matrix is graphic if all of its columns are paths of one tree, and a network matrix if
#: all are ways through one tree with directed edges.
TREES = f"way AS (SELECT CAST(tree AS BIGINT) AS tree, CAST(f AS BIGINT) AS f, CAST(b AS BIGINT) AS b FROM (VALUES {_tree_paths()}) t(tree, f, b))"
GRAPHIC = """{name}_need AS (SELECT mid, count(*) AS k FROM {name}_col GROUP BY mid),
{name}_hit AS (SELECT mid, tree, count(*) AS k FROM {name}_col JOIN (SELECT DISTINCT tree, f | b AS x FROM way) USING (x) GROUP BY mid, tree),
{name}_graph AS (SELECT n.mid, coalesce(max(h.k) = max(n.k), FALSE) AS is_graphic FROM {name}_need n LEFT JOIN {name}_hit h ON n.mid = h.mid GROUP BY n.mid)"""
NETWORK = """way_d AS (SELECT DISTINCT tree * 16 + o.o AS tree, (f & ~o.o) | (b & o.o) AS p, (b & ~o.o) | (f & o.o) AS q FROM way, (SELECT CAST(o AS BIGINT) AS o FROM range(0, 16) x(o)) o),
signed AS (SELECT DISTINCT mid, p, q FROM (SELECT mid, c, CAST(sum(CASE WHEN v = 1 THEN 1 << r ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN v = -1 THEN 1 << r ELSE 0 END) AS BIGINT) AS q FROM e GROUP BY mid, c)),
signed_need AS (SELECT mid, count(*) AS k FROM signed GROUP BY mid),
signed_hit AS (SELECT mid, tree, count(*) AS k FROM signed JOIN way_d USING (p, q) GROUP BY mid, tree),
net AS (SELECT n.mid, coalesce(max(h.k) = max(n.k), FALSE) AS is_network FROM signed_need n LEFT JOIN signed_hit h ON n.mid = h.mid GROUP BY n.mid)"""
BINARY_CLASS = f"WITH b AS ({BINARY_SQL}), {TREES}, {POINTS.format(name='bin', e='b')}, {GRAPHIC.format(name='bin')}"
SIGN_CLASS = f"{GH_SIGN}, {TREES}, {POINTS.format(name='sup', e='e')}, {GRAPHIC.format(name='sup')}, {NETWORK}"


@query(f"{SIGN_CLASS} SELECT mid, is_sp AND is_tu AS is_sp FROM sup JOIN gh USING (mid)")
def series_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No wheel in the support (oracle: no minor of six points and rank three) and signs that fit."""
    return series.left_over(part_sign(spark, sf_dir)).select("mid", "is_sp")


@query(f"{BINARY_CLASS} SELECT mid, is_sp FROM bin")
def series_parallel_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.left_over(part_binary(spark, sf_dir), ternary=False).select("mid", "is_sp")


@query(f"{BINARY_CLASS} SELECT mid, is_graphic, is_cographic, is_graphic AND is_cographic AS is_planar FROM bin JOIN bin_graph USING (mid)")
def graphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: all 25 trees of four edges; regular and without the ten points of K5 for cographs."""
    return recognition.graphic_test(part_binary(spark, sf_dir))


def _equal(found: Matrices, ms: Matrices) -> DataFrame:
    some = found.dims.select("mid")
    return algebra.equal(found, Matrices(ms.dims.join(some, "mid", "left_semi"), ms.entries.join(some, "mid", "left_semi")))


@query(f"{BINARY_CLASS} SELECT mid, TRUE AS equal FROM bin_graph WHERE is_graphic")
def graphic_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mid, equal``: the matrices of the graphs found, against the matrices themselves."""
    ms = part_binary(spark, sf_dir)
    edges, _ = storage.written(recognition.realised_graphs(ms), "graphs")
    return _equal(recognition.represented(edges), ms)


@query(f"{SIGN_CLASS} SELECT mid, is_network, is_tu AND is_cographic AS is_conetwork, is_graphic AS support_is_graphic FROM net JOIN gh USING (mid) JOIN sup USING (mid) JOIN sup_graph USING (mid)")
def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: all trees of four directed edges."""
    return recognition.network_test(part_sign(spark, sf_dir))


@query(f"{SIGN_CLASS} SELECT mid, is_tu AS oriented, CASE WHEN is_tu THEN 11 ELSE 0 END AS edges, NOT is_tu AS violated FROM sup JOIN gh USING (mid) WHERE is_cographic")
def cograph_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognition.oriented_cographs(part_sign(spark, sf_dir))
    return found.select("mid", "oriented", F.coalesce(F.size("edges"), F.lit(0)).alias("edges"), F.col("rows").isNotNull().alias("violated"))


@query(f"""{SIGN_CLASS} SELECT mid, CASE WHEN is_tu THEN 1 ELSE -1 END AS regularity, CASE WHEN is_network THEN 1 ELSE -1 END AS graphicness,
CASE WHEN is_tu AND is_cographic THEN 1 ELSE -1 END AS cographicness FROM net JOIN gh USING (mid) JOIN sup USING (mid)""")
def seymour_root_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of whole matrices, from their decompositions' leaves up."""
    return _attributes(spark, sf_dir)[1].where("node = 0").drop("node")


@query(f"{SIGN_CLASS} SELECT mid, TRUE AS equal FROM net WHERE is_network")
def network_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = part_sign(spark, sf_dir)
    edges, _ = storage.written(recognition.realised_networks(ms), "networks")
    return _equal(recognition.represented(edges, signed=True), ms)


@query()
def network_edge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.edge_list_text(recognition.realised_networks(part_sign(spark, sf_dir)))


@query(f"{BINARY_CLASS} SELECT mid, is_regular FROM bin")
def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: no minor of Fano's plane or its dual."""
    return recognition.regular_test(part_binary(spark, sf_dir))


@query(f"""SELECT mid, concat_ws(chr(10), 'complement row ' || (row + 1), 'complement column ' || (col + 1)) AS value FROM ({SQL['ctu']}) WHERE NOT is_ctu""")
def ctu_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.complements_text(recognition.ctu_test(part_binary(spark, sf_dir)).where("NOT is_ctu"))


NAMES = ["I_3", "R_10.1", "R_10.2", "R_12", "W_4", "K_5", "K_3,3", "I_1"]


@query("""SELECT s_suppkey AS mid, CASE s_suppkey % 8 WHEN 0 THEN 3 WHEN 7 THEN 1 END AS identity_order, CASE s_suppkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS r10,
  s_suppkey % 8 = 3 AS r12 FROM supplier""")
def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of eight known matrices for each supplier."""
    of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mid"), (F.col("s_suppkey") % 8).alias("k"))
    return recognition.named_test(generators.literals(spark, NAMES, of))


@query("""SELECT c_custkey AS mid, CAST(CASE WHEN c_nationkey % 3 = 1 OR c_nationkey % 3 = 0 AND c_custkey % 5 > 0 THEN NULL ELSE c_custkey % 5 + 1 END AS INTEGER) AS identity_order FROM customer""")
def identity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a matrix per customer: the identity of order 1 to 5, by nation with a sign changed or an entry more."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mid"), (F.col("c_custkey") % 5 + 1).cast("int").alias("k"), (F.col("c_nationkey") % 3).alias("kind"))
    diagonal = c.select("mid", "kind", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("r"))
    e = diagonal.select("mid", "r", F.col("r").alias("c"), F.when((F.col("kind") == 1) & (F.col("r") == 0), -1).otherwise(1).alias("v"))
    e = e.unionByName(c.where("kind = 0 AND k > 1").select("mid", F.lit(0).alias("r"), (F.col("k") - 1).alias("c"), F.lit(1).alias("v")))
    return recognition.identity_orders(Matrices(c.select("mid", F.col("k").alias("m"), F.col("k").alias("n")), e))


@query()
def camion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camion_signs.camion_test(part_sign(spark, sf_dir))


@query(f"SELECT mid, r, c, 1 AS v FROM ({SIGN_SQL})")
def camion_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camion's signs change no zero."""
    ms = algebra.support(camion_signs.camion_signed(part_sign(spark, sf_dir)))
    return _entries(ms)


@query()
def series_parallel_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_parallel(part_sign(spark, sf_dir))


@query()
def series_parallel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.reductions_text(series.series_parallel(part_sign(spark, sf_dir)))


@query(f"{SIGN_CLASS} SELECT mid, FALSE AS is_sp FROM sup JOIN gh USING (mid) WHERE NOT (is_sp AND is_tu)")
def series_parallel_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submatrices that aren't series-parallel, of all matrices that aren't."""
    ms = part_sign(spark, sf_dir)
    found, _ = storage.written(recognition.sp_violators(ms), "violators")
    return series.left_over(algebra.slice_submatrix(ms.where(F.lit(True)), found)).join(found.select("mid"), "mid", "left_semi").select("mid", "is_sp")


@query()
def graphic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.greedy_graphic_columns(part_binary(spark, sf_dir))


@query()
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dot_text(recognition.realised_graphs(part_binary(spark, sf_dir)))


@query(f"""{LARGEST},
by_rows AS (SELECT mid, rows, min(value) AS low, max(value) AS high FROM m GROUP BY mid, rows), by_cols AS (SELECT mid, cols, min(value) AS low, max(value) AS high FROM m GROUP BY mid, cols),
one AS (SELECT mid, CASE WHEN bool_and(low = high) THEN list_reduce(list(low), lambda x, y: gcd(x, y)) ELSE 0 END AS k FROM by_rows GROUP BY mid),
two AS (SELECT mid, CASE WHEN bool_and(low = high) THEN list_reduce(list(low), lambda x, y: gcd(x, y)) ELSE 0 END AS k FROM by_cols GROUP BY mid)
SELECT mid, CAST(one.k AS VARCHAR) AS k, CAST(CASE WHEN one.k = two.k THEN one.k ELSE 0 END AS VARCHAR) AS strong_k, one.k = 1 AS is_unimodular FROM one JOIN two USING (mid)""")
def equimodular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle: of the largest minors that aren't all zero, those of the same rows are equal up to sign."""
    return recognition.equimodular_test(part_count(spark, sf_dir))


# --- trees, texts, generators -----------------------------------------------------------------


def geo(spark: SparkSession, sf_dir: str) -> Matrices:
    """The tree world - region - nation, and a column for each pair of nations."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    one = F.lit(0).cast("long").alias("mid")
    top = spark.range(1).select(one, F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"))
    parents = top.unionByName(region.select(one, (F.col("r_regionkey") + 1).alias("node"), F.lit(0).alias("parent"))).unionByName(
        nation.select(one, (F.col("n_nationkey") + 100).alias("node"), (F.col("n_regionkey") + 1).alias("parent"))
    )
    a, b = nation.select(F.col("n_nationkey").alias("a")), nation.select(F.col("n_nationkey").alias("b"))
    count = nation.agg(F.count("*").alias("k"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(count).select(one, F.expr("CAST(a * (2 * k - a - 1) / 2 + b - a - 1 AS INT)").alias("c"), (F.col("a") + 100).alias("u"), (F.col("b") + 100).alias("w"))
    return trees.forest_matrix(parents, pairs)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1 AS c, a.n_nationkey AS u, b.n_nationkey AS w, a.n_regionkey AS ru, b.n_regionkey AS rw
  FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey), k AS (SELECT count(*) AS regions FROM region)
SELECT CAST(0 AS BIGINT) AS mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM (
  SELECT regions + u AS r, c, -1 AS v FROM p, k UNION ALL SELECT regions + w, c, 1 FROM p, k
  UNION ALL SELECT ru, c, -1 FROM p WHERE ru <> rw UNION ALL SELECT rw, c, 1 FROM p WHERE ru <> rw)""")
def network_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(geo(spark, sf_dir))


def order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multigraph per order: an edge per line between its part's and its supplier's number
    modulo 5."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mid"), "l_linenumber").agg((F.min("l_partkey") % 5).cast("int").alias("u"), (F.min("l_suppkey") % 5).cast("int").alias("w"))
    return lines.select("mid", F.col("l_linenumber").alias("e"), "u", "w", F.col("l_linenumber").alias("element"))


GRAPH_SQL = """SELECT l_orderkey AS mid, l_linenumber AS e, CAST(min(l_partkey) % 5 AS INTEGER) AS u, CAST(min(l_suppkey) % 5 AS INTEGER) AS w, l_linenumber AS element
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(f"SELECT mid, e, CASE u WHEN 4 THEN 0 ELSE u END AS u, CASE w WHEN 4 THEN 0 ELSE w END AS w, element FROM ({GRAPH_SQL})")
def graph_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_graphs(spark, sf_dir)
    return multigraphs.merge_nodes(edges, edges.select("mid").distinct().select("mid", F.lit(4).alias("old"), F.lit(0).alias("new")))


@query(f"SELECT mid, e, u, w, element FROM ({GRAPH_SQL}) WHERE u <> 2 AND w <> 2")
def graph_delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_graphs(spark, sf_dir)
    return multigraphs.delete_nodes(edges, edges.select("mid").distinct().withColumn("node", F.lit(2))).select("mid", "e", "u", "w", "element")


@query(f"SELECT mid, node, count(*) AS degree FROM (SELECT mid, u AS node FROM ({GRAPH_SQL}) UNION ALL SELECT mid, w FROM ({GRAPH_SQL})) GROUP BY mid, node")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multigraphs.node_degrees(order_graphs(spark, sf_dir))


@query(f"SELECT mid, r, c, v FROM ({SIGN_SQL})")
def dense_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(text.read_dense(text.dense_text(part_sign(spark, sf_dir)))[0])


@query(f"SELECT mid, r, c, v FROM ({COUNT_SQL})")
def sparse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(text.read_sparse(text.sparse_text(part_count(spark, sf_dir)))[0])


@query(f"""WITH e AS ({SIGN_SQL}) SELECT mid, '4 7 ' || count(*) || chr(10) || chr(10) || string_agg((r + 1) || ' ' || (c + 1) || ' ' || v, chr(10) ORDER BY r, c) || chr(10) AS value FROM e GROUP BY mid""")
def sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sparse_text(part_sign(spark, sf_dir))


@query("""SELECT mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 1 AS v FROM (SELECT c_custkey AS mid, 3 + c_custkey % 30 AS k FROM customer), range(0, 33) b(r), range(0, 33) d(c)
WHERE r < k AND c < k AND (c = r OR c = (r + 1) % k OR r < 2 AND c >= 3)""")
def generated_wheels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wheel of order 3 to 32 for each customer."""
    orders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mid"), (3 + F.col("c_custkey") % 30).alias("k"))
    return _entries(generators.wheels(spark, orders, modified=True))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mid"))


@query("SELECT s_suppkey AS mid, TRUE AS is_network, TRUE AS support_is_graphic FROM supplier")
def generated_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random network matrix for each supplier, recognised again."""
    return recognition.network_test(generators.networks(spark, _suppliers(spark, sf_dir), 12, 15)).select("mid", "is_network", "support_is_graphic")


@query("SELECT s_suppkey AS mid, TRUE AS is_sp FROM supplier")
def generated_series_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for each supplier that grows by zero lines, units and copies, reduced again."""
    return series.left_over(generators.random_series_parallel(spark, _suppliers(spark, sf_dir), 0, 20)).select("mid", "is_sp")


@query("SELECT s_suppkey AS mid, TRUE AS is_tu FROM supplier")
def generated_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a sum of a graphic and a cographic matrix, some 20 x 20 (neither graphic
    nor cographic as a rule): totally unimodular."""
    return recognition.tu_test(generators.graph_cograph_sums(spark, _suppliers(spark, sf_dir), 6, 8)).select("mid", "is_tu")


@query("SELECT CAST(0 AS BIGINT) AS mid, TRUE AS is_network, FALSE AS is_conetwork, TRUE AS support_is_graphic")
def network_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the tree of nations, 30 x 300, recognised again."""
    return recognition.network_test(geo(spark, sf_dir))


@query()
def tree_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tree_dot(recognition.decompositions(part_sign(spark, sf_dir)))


#: A lot as SQL, of a digest's first 32 bits.
def _number(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"""WITH s AS ({SIGN_SQL}), cell AS (SELECT mid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT mid FROM s), range(0, 4) a(r), range(0, 7) b(c)),
lot AS (SELECT mid, r, c, {_number("'1:' || mid || ':' || r || ':' || c")} AS hit, {_number("'1:' || mid || ':' || r || ':' || c || ':v'")} AS pick FROM cell),
e AS (SELECT mid, r, c, CASE WHEN hit < 0.1 THEN CAST(floor(pick * 3) AS INTEGER) - 1 ELSE coalesce(v, 0) END AS v FROM lot LEFT JOIN s USING (mid, r, c)), {GH.format(key='mid')} SELECT mid, is_tu FROM gh""")
def perturbed_tu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.tu_by_masks(generators.perturbed(part_sign(spark, sf_dir), 0.1, [-1, 0, 1]))


@query(f"SELECT mid, count(*) AS nonzeros FROM ({SIGN_SQL}) GROUP BY mid")
def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(part_sign(spark, sf_dir)).select("mid", F.size("cells").cast("long").alias("nonzeros"))
