"""Table reading and stable row places for this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import components, conf, counted, delete, exists, new_path, shared_dir, written

__all__ = ["BLOOM_CONF", "SMALL_BATCHES", "components", "conf", "counted", "delete", "exists", "filed", "local_table", "nested", "new_path", "place", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Let Spark test join keys against a Bloom filter (of bounded size) of the smaller
#: side in the scan, before it shuffles any text, at every size of the input.
BLOOM_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}


#: Batches for Python of few MB, whatever a row holds.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def local_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A small table from lists in the driver, as a local relation of known size."""
    return spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (t, v) in columns.items()}))


def filed(df: DataFrame, tag: str) -> DataFrame:
    """``df`` itself if its rows come straight from files, else a copy in the shared
    folder: either way rows have a lasting place in the files' metadata."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return written(df, tag)[0]


def place(df: DataFrame) -> Column:
    """The file of each row and its place there, which stays the same however often the
    rows of a :func:`filed` table are read; whatever the table's own columns are called."""
    meta = df.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file_path"), meta["row_index"].alias("row_index"))


def nested(df: DataFrame, tag: str) -> DataFrame:
    """``at, row``: the place of each row (see :func:`place`) and the row itself as one
    struct, so that its columns' names clash with none."""
    df = filed(df, tag)
    return df.select(place(df).alias("at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
