"""Exact dedup by stateful streaming (JVM only: DataFrame functions, no Python rows).

The documents' digests form a stream.  A streaming aggregation keeps, for each
digest and without expiry, the state that later batches need: how many rows had
it, and the identifier and content locator of the row that stays.  The state
lies on the executors' disks (RocksDB state store) with a durable log in the
shared folder, so it may be larger than memory and survives lost executors.  A
table is read in several batches, each of which meets the state of those before it,
and a state that the caller names serves later tables too: an arrival lands once under its
name, however often a call is tried, and of rows that a later one overtakes corrections
are told.
Digests that the state has seen more than once are hits; for these the full
bytes of every row are compared with those of the row that stays, which its
locator finds.  Rows whose bytes differ (colliding digests) are grouped anew by
their whole texts.

Behaviour: a null text counts as empty; texts are compared byte by byte without
any change.  Of equal texts the row with the largest identifier stays (a null is
smallest); where rows repeat an identifier too, the one with the largest
locator.  Exactly one row of each group is kept.  An empty table gives an empty
result.  Further columns are not read by :func:`judge`, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: don't set disk aside ahead of need, and log changes instead of whole snapshots
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # what all stores of an executor hold in memory together, and each before it writes a file
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}
def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, digest, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, locator, text`` of each row of a filed table."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), digest(text).alias("digest"), common.place(docs).alias("locator"), text.alias("text"))


def landed(rows: DataFrame, at: str, arrival: str | None, batches: int) -> DataFrame:
    """``rows`` as files of the arrival in ``at``/landed, at least one for each batch; an
    arrival of that name that has landed already stays as it is."""
    spark, path = rows.sparkSession, f"{at}/landed/{arrival or uuid.uuid4().hex}"
    if not common.exists(spark, f"{path}/_SUCCESS"):
        aside, aside_path = common.written(rows, "dedup-arrival")
        few = len(aside.inputFiles()) < batches
        (aside.repartition(batches, "digest", "locator") if few else aside).write.mode("overwrite").parquet(path)
        common.delete(spark, aside_path)
    return spark.read.schema(rows.schema).parquet(path)


def versions(spark: SparkSession, at: str, schema) -> DataFrame:
    """The state's last version as ``digest, n, keep``: that with the largest count."""
    found = spark.read.schema(schema).parquet(f"{at}/changes") if common.exists(spark, f"{at}/changes") else spark.createDataFrame([], schema)
    return found.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("v")).select("digest", "v.n", "v.keep")


def state_of(source: DataFrame, at: str, batches: int = 3) -> DataFrame:
    """Stream what has landed in ``at``/landed since the last time through the state kept
    in ``at``, in about ``batches`` batches; the state's last version as
    ``digest, n, keep``.

    Each batch writes the keys that it changed to the shared folder, under its number (a
    batch that is run again after a failure replaces what it wrote); of a key's
    versions the one with the largest count is the last.
    """
    spark = source.sparkSession
    files = len(source.inputFiles())
    reader = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max(1, -(-files // batches)))
    changes = reader.parquet(f"{at}/landed").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"))
    out = f"{at}/changes"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with common.conf(spark, STREAM_CONF):
        query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return versions(spark, at, changes.schema)


def salts_of(state: DataFrame) -> DataFrame:
    """``digest, salts`` of the digests that more than a thousandth of all rows (and 1,000
    rows) have: a thousand digests at most, into how many parts to deal their rows."""
    total = state.agg(F.sum("n")).first()[0] or 0
    most = max(1000, total // 1000)
    return F.broadcast(state.where(F.col("n") > most).select("digest", F.ceil(F.col("n") / most).cast("int").alias("salts")))


def joined(rows: DataFrame, other: DataFrame, hot: DataFrame, any_hot: bool) -> DataFrame:
    """``rows`` with what ``other`` has for their digests.  Rows of a hot digest are dealt
    to as many places as it has salts, and the other side's row goes to each; the rest is a
    plain join, whose scan Spark can test against a Bloom filter of the other side."""
    if not any_hot:
        return rows.join(other, "digest")
    cold = rows.join(hot, "digest", "left_anti").join(other, "digest")
    salt = F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int")
    mine = rows.join(hot, "digest").withColumn("salt", salt).drop("salts")
    each = other.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.unionByName(mine.join(each, ["digest", "salt"]).drop("salt"))


def texts_at(rows: DataFrame, docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the rows that hits' locators name: among ``rows`` and, for rows that came
    earlier, in the files they came from."""
    found = rows.join(hits, ["digest", "locator"]).select("digest", "n", F.col("text").alias("kept_text"))
    here = hits.select("locator.file_path").distinct().join(rows.select("locator.file_path").distinct(), "file_path", "left_anti")
    earlier = [r.file_path for r in here.collect()]  # names of files, not rows
    if earlier:
        old = docs.sparkSession.read.schema(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).schema).parquet(*earlier)
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("kept_text")
        named = old.select(common.place(old).alias("locator"), text)
        found = found.unionByName(named.join(hits, "locator").select("digest", "n", "kept_text"))
    return found


def earlier_rows(landed_rows: DataFrame, rows: DataFrame, docs: DataFrame, odd: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, locator, text`` of the rows of earlier calls that have one of the digests
    ``odd``, their texts from the files they came from."""
    old = landed_rows.join(F.broadcast(odd), "digest", "left_semi").join(rows.select("locator"), "locator", "left_anti")
    files = [r.file_path for r in old.select("locator.file_path").distinct().collect()]  # names of files, not rows
    if not files:
        return rows.limit(0)
    source = docs.sparkSession.read.schema(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).schema).parquet(*files)
    texts = source.select(common.place(source).alias("locator"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return old.join(texts, "locator").select("id", "digest", "locator", "text")


def collisions(rows: DataFrame, docs: DataFrame, state: DataFrame, hot: DataFrame, any_hot: bool, id_col: str, text_col: str, landed_rows: DataFrame | None = None) -> DataFrame | None:
    """The groups of rows whose digests hide different texts: ``id, digest, locator,
    keep, n, old``; None if full bytes agree everywhere.  ``landed_rows``: the rows of all
    calls, if there may have been earlier ones; of theirs those that stood before."""
    spark = rows.sparkSession
    with common.conf(spark, common.BLOOM_CONF):
        hits = state.where("n > 1").select("digest", "keep.locator", "n")
        kept, kept_path = common.written(texts_at(rows, docs, hits, id_col, text_col), "dedup-kept")
        slim = kept.where("n > 1").select("digest", "kept_text")
        odd = joined(rows, slim, hot, any_hot).where(F.col("text") != F.col("kept_text")).select("digest")
        odd, _ = common.written(odd, "dedup-odd")
        common.delete(spark, kept_path)
        if odd.isEmpty():
            return None
        mine = rows.join(odd.distinct(), "digest").withColumn("old", F.lit(False))
        if landed_rows is not None:
            mine = mine.unionByName(earlier_rows(landed_rows, rows, docs, odd.distinct(), id_col, text_col).withColumn("old", F.lit(True)))
        stood = F.max(F.when(F.col("old"), F.struct("id", "locator"))).alias("stood")
        groups = mine.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"), stood)
        told = mine.join(groups, ["digest", "text"]).where(~F.col("old") | (F.col("locator") == F.col("stood.locator")))
        return common.written(told.select("id", "digest", "locator", "keep", "n", "old"), "dedup-groups")[0]


def judge(
    docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, state: str | None = None, arrival: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id, digest, locator, keep_id, n, kept``.

    ``state``: a folder that keeps the state (see :func:`state_of`).  Rows given in a
    later call with the same folder meet what earlier calls left there: they are judged
    against all rows that have come so far, whose files must still be there for a
    hit's full bytes.  ``arrival`` names the rows of a call: a call that is tried again
    under the same name counts them once.  Rows that an earlier call kept and a row of this
    call overtakes come once more, with ``kept`` false: corrections.
    """
    spark = docs.sparkSession
    docs = common.filed(docs, "dedup-rows")
    rows = located(docs, digest, id_col, text_col)
    at = state or common.new_path(spark, "dedup-state")
    slim = landed(rows.drop("text"), at, arrival, batches)
    everything = None
    last = state_of(slim, at, batches)
    if state:
        last = last.join(slim.select("digest").distinct(), "digest", "left_semi")
        everything = spark.read.schema(slim.schema).option("recursiveFileLookup", "true").parquet(f"{at}/landed")
    last, _ = common.written(last, "dedup-last")
    hot, _ = common.written(salts_of(last), "dedup-hot")
    any_hot, hot = not hot.isEmpty(), F.broadcast(hot)
    odd = collisions(rows, docs, last, hot, any_hot, id_col, text_col, everything)
    found = joined(slim, last, hot, any_hot)
    if state:
        found = found.unionByName(overtaken(everything, slim, last))
    if odd is not None:  # in place of what their digests say
        apart = odd.join(slim.select(F.col("locator").alias("new")), F.col("keep.locator") == F.col("new"), "left").where(~F.col("old") | F.col("new").isNotNull())
        found = found.join(odd.select("digest").distinct(), "digest", "left_anti").unionByName(apart.select("id", "digest", "locator", "n", "keep").select(*found.columns))
    return found.select(
        "id", "digest", "locator", F.col("keep.id").alias("keep_id"), "n", (F.col("locator") == F.col("keep.locator")).alias("kept")
    )


def overtaken(everything: DataFrame, slim: DataFrame, last: DataFrame) -> DataFrame:
    """Of the digests that this call's rows ``slim`` have taken over, the row of earlier calls
    that stood before: ``id, digest, locator, n, keep``."""
    new = slim.select("locator")
    taken = last.join(new, F.col("keep.locator") == F.col("locator"), "left_semi")
    before = everything.join(new, "locator", "left_anti").join(taken.select("digest"), "digest", "left_semi")
    stood = before.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("was"))
    return stood.join(taken, "digest").select("was.id", "digest", "was.locator", "n", "keep")


def deduped(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns."""
    docs = common.filed(docs, "dedup-docs")
    stay = judge(docs, **kw).where("kept").select(F.col("locator").alias("stay"))
    rows = common.nested(docs, "dedup-docs")
    return rows.join(stay, F.col("at") == F.col("stay"), "left_semi").select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``; see the module's docstring."""
    return judge(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
