"""Centroid clustering (k-means) with Elkan's bounds, in whole numbers.

With each vector go its cluster, an upper bound of the distance to that centroid and a
lower bound for each centroid.  When centroids move, the bounds move by as much.  A
centroid is looked at only if neither its lower bound nor half its distance from the
vector's own centroid exceeds the upper bound; what is skipped is strictly farther away,
so ties are always looked at and go to the smaller number.  Bounds are rounded outwards
(upper ones up, lower ones down, in single precision), comparisons and results use exact
squared distances.

A round is one pass over the vectors, without a shuffle of them, that writes the state
(vectors and bounds) to the shared folder, so a lost executor costs its tasks; then each
task's sums of each cluster and dimension are added up.  Centroids (k, a parameter) are
sent to the tasks.

Behaviour: only vectors of ``size`` entries, none null or non-finite, are clustered; others
get no row.  Entries over 2^27 are an error, since a distance might not fit.  Starting vectors come in the order
of their hashes, equal ones (repeated identifiers) in that of their entries, null
identifiers last; with fewer vectors than centroids there are as many centroids as vectors.
Repeated rows are clustered alike.  Empty tables give no rows.  Only identifier and vector
are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Vectors looked at together.
_ROWS = 4_096
#: Entries up to this give exact sums of squares.
LARGEST = 1 << 27


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """``id, x``: the vectors that are clustered, as whole numbers."""
    v = F.col("v")
    fine = (F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.when(F.abs(c) * scale <= LARGEST, F.floor(c.cast("double") * scale).cast("int")).when(F.abs(c) < float("inf"), F.raise_error(F.lit("an entry is too large to be clustered exactly")).cast("int"))
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")).where(v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select("id", F.transform("v", entry).alias("x"))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float64), np.inf).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float64), -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return ((x - c) ** 2).sum(axis=-1)


class Bounds:
    """What Elkan's method knows of some vectors: cluster, upper bound, lower bounds."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.lower = cluster, upper, lower

    @classmethod
    def none(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, dtype=np.int32), np.full(n, np.inf, dtype=np.float32), np.zeros((n, k), dtype=np.float32))

    def moved(self, old: np.ndarray, new: np.ndarray) -> Bounds:
        """The bounds after the centroids have moved."""
        shift = np.sqrt(squares(old, new).astype(np.float64))
        still = squares(old, new) == 0
        upper, lower = up(self.upper.astype(np.float64) + up(shift)[self.cluster]), down(self.lower.astype(np.float64) - up(shift))
        return Bounds(self.cluster, np.where(still[self.cluster], self.upper, upper), np.where(still, self.lower, lower))

    def assign(self, x: np.ndarray, c: np.ndarray) -> int:
        """Move each vector to its nearest centroid; the number of distances that took."""
        k = len(c)
        half = down(np.sqrt(squares(c[:, None], c[None]).astype(np.float64)) / 2)
        np.fill_diagonal(half, np.inf)
        live = np.flatnonzero(self.upper >= half[self.cluster].min(axis=1))
        best = np.zeros(len(x), dtype=np.int64)
        best[live] = squares(x[live], c[self.cluster[live]])
        root = np.sqrt(best[live].astype(np.float64))
        self.upper[live], self.lower[live, self.cluster[live]] = up(root), down(root)
        done = len(live)
        for j in range(k):
            a = self.cluster[live]
            look = live[(a != j) & (self.upper[live] >= self.lower[live, j]) & (self.upper[live] >= half[a, j])]
            if not len(look):
                continue
            done += len(look)
            found = squares(x[look], c[j])
            root = np.sqrt(found.astype(np.float64))
            self.lower[look, j] = down(root)
            nearer = (found < best[look]) | ((found == best[look]) & (j < self.cluster[look]))
            at = look[nearer]
            best[at], self.cluster[at], self.upper[at] = found[nearer], j, up(root[nearer])
        return done


def _numbers(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """A round over ``id, x`` and, if there are centroids from ``before``, the bounds:
    the state with its new clusters and bounds or, at the ``last`` one, ``id, cluster, distance``."""
    kind = state.schema["id"].dataType
    columns = [("id", to_arrow_type(kind)), *([("cluster", pa.int32()), ("distance", pa.int64())] if last else [("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float32()), ("lower", pa.list_(pa.float32()))])]
    schema = pa.schema(columns)

    def run(batches):
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            n = batch.num_rows
            x = _numbers(batch.column(1), n, np.int64)
            if before is None:
                bounds = Bounds.none(n, len(centroids))
            else:
                bounds = Bounds(batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy(), _numbers(batch.column(4), n, np.float32)).moved(before, centroids)
            bounds.assign(x, centroids)
            if last:
                out = [pa.array(bounds.cluster), pa.array(squares(x, centroids[bounds.cluster]))]
            else:
                out = [batch.column(1), pa.array(bounds.cluster), pa.array(bounds.upper), _lists(bounds.lower, pa.float32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], schema=schema)

    rest = "cluster int, distance long" if last else "x array<int>, cluster int, upper float, lower array<float>"
    return state.mapInArrow(run, f"id {kind.simpleString()}, {rest}")


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors at the floor of their mean."""
    out = centroids.copy()
    sums = state.select("cluster", F.posexplode("x").alias("i", "c")).groupBy("cluster", "i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("long")).alias("s"))
    for r in sums.collect():  # at most k rows for each dimension
        out[r.cluster, r.i] = r.s // r.n
    return out


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of each vector after ``rounds`` moves, and the centroids."""
    spark = df.sparkSession
    state, path = common.written(vectors(df, id_col, vec_col, size, scale), "centroids-vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(lot.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not first:
        return state.selectExpr("id", "0 as cluster", "0L as distance"), np.zeros((0, size), dtype=np.int64)
    centroids, before = np.array([r.x for r in first], dtype=np.int64), None
    for _ in range(rounds):
        state, new_path = common.written(assigned(state, centroids, before, False), "centroids-state")
        common.delete(spark, path)
        path, before, centroids = new_path, centroids, moved(state, centroids)
    out, _ = common.written(assigned(state, centroids, before, True), "centroids-clusters")
    common.delete(spark, path)
    return out, centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Further columns: the distances summed over the cluster and over all, and the digest of the
    cluster's centroid."""
    spark = rows.sparkSession
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    at = sorted(sums)
    digests = [hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest() for i in at]
    named = common.local_table(spark, {"cluster": (pa.int32(), at), "cluster_inertia": (pa.int64(), [sums[i] for i in at]), "centroid_sha256": (pa.string(), digests)})
    return rows.join(F.broadcast(named), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector that is clustered."""
    rows, centroids = clustered(common.table(spark, sf_dir, "embeddings"))
    return with_inertia(rows, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS i, [floor(x::DOUBLE * {scale})::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {size})""",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INTEGER AS c, x FROM "
        f"(SELECT sha256('1:' || vec_id) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT {k})",
    ]
    near = "SELECT i, min((d, c)) AS best FROM (SELECT i, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, k.x)])::BIGINT AS d FROM v, c{r} k) GROUP BY i"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT c, list(s ORDER BY p) AS x FROM (SELECT c, p, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS s
  FROM (SELECT best[2] AS c, unnest(x) AS x, unnest(range({size})) AS p FROM v JOIN a{r} USING (i)) GROUP BY c, p) GROUP BY c)""".replace("best[2]", "best.c")
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x)::BIGINT[] AS x FROM c{r} k LEFT JOIN m{r} m USING (c))")
    text = ",\n".join(parts).replace("min((d, c))", "min({'d': d, 'c': c})")
    return f"""WITH {text}
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (i) JOIN c{rounds} k ON k.c = best.c"""


ORACLE = _oracle()
