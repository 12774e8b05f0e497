"""Entry predicates over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_gate(entries: DataFrame) -> DataFrame:
    """``mid, nonzeros, is_binary, is_ternary`` so far, for a stream (or a table) of entries
    ``mid, r, c, v``: a keyed aggregation whose state is one row per matrix."""
    return entries.groupBy("mid").agg(
        F.count("*").alias("nonzeros"),
        F.min(F.col("v").isin(0, 1).cast("int")).cast("boolean").alias("is_binary"),
        F.min(F.col("v").isin(-1, 0, 1).cast("int")).cast("boolean").alias("is_ternary"),
    )


def run_to_end(stream: DataFrame, path: str, log: str) -> None:
    """Run a stream over all that is there now; each batch's changes go to ``path``."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
