"""Quality by compression: which class's dictionary makes a text smaller.

From pieces of labelled texts one zstandard dictionary is trained for good texts and one
for bad ones.  A text is compressed under both, piece by piece (so that a long text
learns no more from itself than a short one); its evidence is the bytes that the good
dictionary saves over the bad one, divided by the bytes of the text.  Repetitive texts
need no dictionary, so they gain from neither: evidence about 0, where good texts have
more.  A logistic curve turns evidence into a score from 0 to 1.  It is set by Newton's
method on labelled rows that the dictionaries did not see, with Platt's targets.  The
language, source and identifier of a document are not inputs.

Sizes: the dictionaries come from at most about ``fit_rows`` labelled rows of each class,
chosen by a hash of the identifier, and ``PIECES`` pieces of ``PIECE`` characters of each,
``fit_rows * PIECES`` pieces of a class in all: a bounded sample that meets in the driver.
The dictionaries (``DICTIONARY`` bytes each) are broadcast.  What the curve is set on is
counted by rounded evidence, of which there are few values, however many rows there are.
Scoring is one pass over whole texts, without a shuffle.

Behaviour: null and empty texts have the evidence 0; labels of one identifier that
conflict count as bad; null labels and identifiers are no labels (a null identifier is not
held out); without usable labels of both classes all scores are the share of good ones,
0.5 if there are none; repeated rows are scored alike; only identifier and text are read,
whatever other columns are called.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Characters of a piece for the dictionaries and pieces of a row; bytes of a piece that is
#: compressed; bytes of a dictionary; level of compression; rows scored at once.
PIECE, PIECES, BLOCK, DICTIONARY, LEVEL, _ROWS = 2000, 3, 2000, 1 << 18, 3, 500
#: The curve is set on evidence in these steps.
STEP = 1e-4


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; too few pieces to train on are the dictionary themselves."""
    pieces = [p for p in pieces if p]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    found = zstandard.ZstdCompressionDict(content)
    found.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, **plain)


def curve(evidence: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve for counts of good and bad rows by evidence."""
    n, p = good + bad, (good.sum() + 1) / (good.sum() + 2)
    target = (good * p + bad / (bad.sum() + 2)) / np.maximum(n, 1)
    unit = float(np.sqrt(np.average(evidence**2, weights=n))) or 1.0
    x = np.stack([evidence / unit, np.ones(len(n))])
    ridge, w = np.diag([1e-3, 1e-6]), np.zeros(2)
    loss = lambda w: float((n * (np.logaddexp(0, w @ x) - target * (w @ x))).sum() + w @ ridge @ w / 2)
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
        step = np.linalg.solve((x * (n * s * (1 - s))) @ x.T + ridge, x @ (n * (s - target)) + ridge @ w)
        scale = 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-9:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-10:
            break
    return float(w[0] / unit), float(w[1])


@dataclass
class Model:
    """Dictionaries of good and bad texts, and the curve."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Bytes that the good dictionary saves over the bad one, a byte of each text."""
        if not self.good and not self.bad:
            return np.zeros(len(texts))
        good, bad = _compressors(self.name, self.good, self.bad)
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            data = memoryview((text or "").encode())
            saved = 0
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                saved += len(bad.compress(block)) - len(good.compress(block))
            out[i] = saved / max(1, len(data))
        return out


@lru_cache(maxsize=2)
def _compressors(name: str, good: bytes, bad: bytes):
    return compressor(good), compressor(bad)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 3_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of ``docs``' texts under ``labels``; held-out identifiers are not used."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    usable = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    usable, path = common.written(usable, "quality-labels")
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = 0.5 if not sizes else min(max(sizes.get(1, 0) / sum(sizes.values()), 0.01), 0.99)
        common.delete(spark, path)
        return Model(intercept=float(np.log(share / (1 - share))))
    lots = lambda label: int(min(1.0, fit_rows / sizes[label]) * (1 << 20))
    lot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20))
    sample = usable.where(lot < F.when(F.col("label") == 1, lots(1)).otherwise(lots(0))).withColumn("check", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0)
    seen = slim.join(F.broadcast(sample), "id")
    count = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1))
    picks = F.array_distinct(F.array(*[F.pmod(F.xxhash64("id", F.lit(3 + j)), count) for j in range(PIECES)]))
    pieces = seen.where(~F.col("check") & (F.length("text") > 0)).select("label", F.explode(F.transform(picks, lambda k: F.substring("text", k.cast("int") * PIECE + 1, F.lit(PIECE)))).alias("piece"))
    dealt = F.xxhash64("piece")
    by_label = [pieces.where(F.col("label") == label).orderBy(dealt, "piece").limit(fit_rows * PIECES).select("piece").toArrow().column(0).to_pylist() for label in (1, 0)]
    model = Model(*[dictionary([p.encode() for p in found]) for found in by_label])
    run = _evidence(spark, model, pa.int32())
    checked = seen.where("check").select("text", "label").mapInArrow(run, "key int, evidence double")
    counts = checked.groupBy(F.round(F.col("evidence") / STEP).alias("e")).agg(F.sum("key").alias("good"), F.sum(1 - F.col("key")).alias("bad")).orderBy("e").toArrow()
    if counts.num_rows:
        e, good, bad = (c.to_numpy().astype(float) for c in counts.columns)
        model.slope, model.intercept = curve(e * STEP, good, bad)
    common.delete(spark, path)
    return model


def _evidence(spark: SparkSession, model: Model, key_type: pa.DataType):
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sent.value.evidence(part.column(0).to_pylist()))], names=["key", "evidence"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, evidence, score`` of each row."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("key"))
    found = rows.mapInArrow(_evidence(docs.sparkSession, model, to_arrow_type(kind)), f"key {kind.simpleString()}, evidence double")
    power = F.greatest(F.least(F.col("evidence") * -model.slope - model.intercept, F.lit(700.0)), F.lit(-700.0))
    return found.select(F.col("key").alias("id"), "evidence", (1 / (1 + F.exp(power))).alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = common.table(spark, sf_dir, "documents")
    with common.conf(spark, common.SMALL_BATCHES):
        model = fit(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
