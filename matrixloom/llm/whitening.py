"""Whitening of embeddings by column aggregates of the covariance's upper triangle.

Vectors become whole numbers, and rounded means (whole numbers, too) are taken off.  One
aggregation then sums the products of every pair of dimensions.  Its expressions are
generated from the dimension, one for each diagonal of the upper triangle: with the rows
grouped by a first dimension i, expression t sums the products of dimensions i and i + t,
counted around, so that each pair comes once.  These sums are exact, whatever order they
are added up in; what rounding the means leaves is taken off in exact fractions.  LAPACK
decomposes the covariance; each row is projected on the components and divided by the
square roots of the eigenvalues.

One expression for each pair, all in one row, gives the same sums, but Spark compiles no
code for so many columns: 2,080 of them take 9.3 s where the 33 diagonals take 0.6 s
(10,256 vectors of 64 entries).

Sizes: a task hands on a row for each dimension, and the driver gets one for each.  Up to
``DIAGONALS`` diagonals are one aggregation; a dimension with more has several.  All is
summed over all rows.  Centred rows are written once, and projected rows once, over which
the whitened covariance is measured.

Behaviour: rows are left out if the vector is null, empty or holds null or non-finite
entries, and if its length isn't the most common one of the others (of equally common
ones the longest).  Entries of 2^30 and more are an error, since sums of their products
don't fit any type.  Null and repeated identifiers and repeated vectors are rows like
others.  There are min(components, dimension) components; for one without variance
``whitened`` is null and ``explained`` 0, and ``identity_error`` is taken over the others
(null if there is none).  Empty tables give no rows.  Only identifier and vector are read,
whatever other columns are called.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Diagonals that one aggregation sums, and the bits of a sum's lower part.
DIAGONALS, LOW = 64, 20
#: An eigenvalue under this share of the trace is none.
NOTHING = 1e-12


def whole(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> tuple[DataFrame, int]:
    """``id, x``: the rows that are kept, entries as whole numbers; and how many each has."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.when(F.abs(c) < 1 << 30, F.floor(c.cast("double") * scale) + offset).when(F.abs(c) < float("inf"), F.raise_error(F.lit("an entry of 2^30 or more can't be whitened")))
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")).where(v.isNotNull() & F.coalesce(fine, F.lit(False)))
    common_size = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common_size[0].d if common_size else 0
    return kept.where(F.size("v") == d).select("id", F.transform("v", entry).alias("x")), d


def pair_sums(rows: DataFrame, d: int, kind: str = "long") -> dict[tuple[int, int], int | float]:
    """The sums of the products of every two of the ``d`` entries of ``rows``' y, by place."""
    around = rows.select(F.concat("y", F.slice("y", 1, d // 2)).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i"))
    entry = "get(y, i{})" if kind != "decimal" else "cast(get(y, i{}) as decimal(19,0))"
    out = {}
    for first in range(0, d // 2 + 1, DIAGONALS):
        diagonals = range(first, min(d // 2 + 1, first + DIAGONALS))
        sums = [F.expr(f"sum({entry.format('')} * {entry.format(f' + {t}')})").alias(f"t{t}") for t in diagonals]
        for r in around.groupBy("i").agg(*sums).collect():  # d rows
            for t in diagonals:
                j = (r.i + t) % d
                out[min(r.i, j), max(r.i, j)] = r[f"t{t}"]
    return out


def means(rows: DataFrame) -> tuple[int, list[int], int]:
    """How many rows, the exact sum of each dimension, the largest width of one."""
    entries = rows.select(F.posexplode("x").alias("i", "c"))
    halves = [F.sum(F.shiftright("c", LOW)).alias("high"), F.sum(F.col("c").bitwiseAND(F.lit((1 << LOW) - 1))).alias("low")]
    got = entries.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *halves, (F.max("c") - F.min("c")).alias("width")).orderBy("i").collect()  # d rows
    return got[0].n, [(r.high << LOW) + r.low for r in got], max(r.width for r in got)


def covariance(centred: DataFrame, n: int, rest: list[Fraction], width: int) -> np.ndarray:
    """The covariance (divisor n) of ``centred``'s y, whose means are ``rest``: each entry the
    nearest double of the exact one."""
    d = len(rest)
    out = np.zeros((d, d))
    for (i, j), s in pair_sums(centred, d, "long" if n * (width + 1) ** 2 < 1 << 62 else "decimal").items():
        out[i, j] = out[j, i] = float(Fraction(int(s), n) - rest[i] * rest[j])
    return out


def projected(centred: DataFrame, n: int, rest: list[Fraction], weights: np.ndarray) -> DataFrame:
    """``id, deviation, w``: of each row the squared distance from the mean times n^2, and its
    projections."""
    kind = centred.schema["id"].dataType
    left, mean = [int(r * n) for r in rest], np.array([float(r) for r in rest])
    schema = pa.schema([("id", to_arrow_type(kind)), ("deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if (int(np.abs(y).max()) * n + n) ** 2 * y.shape[1] < 1 << 63:
                deviation = ((y * n - np.array(left)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * a - b) ** 2 for a, b in zip(row, left)) for row in y.tolist()]
            w = (y - mean) @ weights
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(Decimal, deviation), pa.decimal128(38, 0)), lists], schema=schema)

    return centred.mapInArrow(run, f"id {kind.simpleString()}, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, real: list[int], n: int) -> float | None:
    """The largest entry of |covariance - identity| of ``rows``' w at the places ``real``."""
    if not real:
        return None
    w = rows.select(F.array(*[F.col("w")[k] for k in real]).alias("w"))
    total = {r.i: r.s for r in w.select(F.posexplode("w").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).collect()}  # as many rows as components
    mean = F.array(*[F.lit(total[i] / n) for i in range(len(real))])
    sums = pair_sums(w.select(F.zip_with("w", mean, lambda a, b: a - b).alias("y")), len(real))
    return max(abs(s / n - (i == j)) for (i, j), s in sums.items())


def whitened(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row that is
    kept and each component."""
    spark = df.sparkSession
    rows, d = whole(df, id_col, vec_col, scale, offset)
    if d:
        n, total, width = means(rows)
        centre = [round(Fraction(s, n)) for s in total]
        rest = [Fraction(s, n) - c for s, c in zip(total, centre)]
        centred = rows.select("id", F.zip_with("x", F.array(*[F.lit(c).cast("long") for c in centre]), lambda a, b: a - b).alias("y"))
        centred, path = common.written(centred, "whitening-centred")
        v = covariance(centred, n, rest, width)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(v))
        real = [k for k, e in enumerate(values[order]) if e > NOTHING * trace]
        scales = np.array([1 / np.sqrt(e) if k in real else np.nan for k, e in enumerate(values[order])])
        out, _ = common.written(projected(centred, n, rest, vectors[:, order] * scales), "whitening-rows")
        common.delete(spark, path)
        explained = [float(values[order[k]]) / trace if k in real else 0.0 for k in range(len(order))]
        error = identity_error(out, real, n)
    else:
        n, explained, error = 0, [0.0], None
        out = rows.selectExpr("id", "cast(0 as decimal(38,0)) as deviation", "array(0D) as w").limit(0)
    return out.select("id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained))[F.col("k")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; a deviation that no long holds is null (the operator has it)."""
    rows = whitened(common.table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
