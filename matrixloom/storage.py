"""Tables in the folder that driver and executors share, and graph components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session (tests on one machine) that names none a temporary folder
    of this machine is made and set; on a cluster it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matrixloom-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/matrixloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that
    have not been consumed or saved yet read from there."""
    delete(spark, own_dir(spark))


#: A job's shuffle files go when it has ended, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: a cut of its lineage
    that any executor can read after another one is lost.  The executors' shuffle files
    of it are deleted then."""
    path = new_path(df.sparkSession, tag)
    with conf(df.sparkSession, TIDY):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written_matrices(ms, tag: str):
    """A collection written as two tables and read again, and their paths."""
    dims, a = written(ms.dims, f"{tag}-dims")
    entries, b = written(ms.entries, f"{tag}-entries")
    return type(ms)(dims, entries), (a, b)


def counted(df: DataFrame, tag: str, *sums) -> tuple[DataFrame, str, tuple]:
    """As :func:`written`, and the number of rows and further ``sums`` (aggregates over
    ``df``), which the job that writes takes along."""
    seen = Observation()
    values = [F.count(F.lit(1)).alias("s0"), *[x.alias(f"s{i}") for i, x in enumerate(sums, 1)]]
    out, path = written(df.observe(seen, *values), tag)
    got = seen.get
    return out, path, tuple(got[f"s{i}"] for i in range(len(values)))


@contextlib.contextmanager
def conf(spark: SparkSession, values: dict[str, str]):
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Small whole numbers take a byte or two a row in a file, so a file's size says little about the rows that
#: a broadcast of it would hold in the driver: joins are by shuffles, unless these tell that a side is small.
#: What is dealt by matrix stays so in joins and groups by matrix and line.
SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
#: Nonzeros of a matrix up to which all of it is dealt to one task.
TOGETHER = 1_000_000


def by_shuffles(function: Callable) -> Callable:
    """Run ``function``, whose jobs are all done when it returns, with the settings ``SHUFFLED``."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        with conf(SparkSession.active(), SHUFFLED):
            return function(*args, **kwargs)

    return run


def dealing(entries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of rounds over ``entries`` are dealt: by matrix, which one shuffle does for
    all joins of a round, unless a matrix is too large for one task."""
    most = entries.groupBy("mid").count().agg(F.max("count")).first()[0]
    return (lambda df: df.repartition("mid")) if (most or 0) <= TOGETHER else (lambda df: df)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the least
    node of its component; both columns of one orderable type.

    Alternating large-star and small-star steps: each writes the edges to the
    shared folder, so a lost executor costs one step.  Each step groups by node
    with a partial minimum before the shuffle and joins that minimum back, so
    that no node's list of neighbours is ever gathered in one place.  Ends when
    a step changes nothing; the number of steps is logarithmic in the size.
    """
    spark = edges.sparkSession
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path, (n,) = counted(first, tag)
    seen = None
    while n:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step = small.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        step, step_path, mark = counted(step, tag, F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        delete(spark, path)
        current, path, n = step, step_path, mark[0]
        if mark == seen:
            break
        seen = mark
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
