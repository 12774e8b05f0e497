import hashlib
import re
import time

from pyspark.sql import functions as F

import corpus_pipeline
from matrixloom.llm import common

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_whole_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if k < 4:
            assert docs.columns == DOCS
            assert all(r.text == texts[r.doc_id] for r in docs.collect())
    toxic, exact, near, mixed, last = kept
    assert set(toxic) <= set(texts) and len(toxic) > 0.8 * len(texts)
    largest = {}
    for i in toxic:
        largest[texts[i]] = max(i, largest.get(texts[i], i))
    assert exact == sorted(largest.values())
    assert set(near) <= set(exact) and len(near) > 0.8 * len(exact)
    assert set(mixed) <= set(near) and last == mixed
    words = lambda ids: sum(len(re.findall("[^ \t-\r]+", texts[i])) for i in ids)
    assert 0.3 * words(near) < words(mixed) <= words(near) * 60 // 100
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_on_odd_rows(spark, sf):
    text = "some words that stand in this text more than once and others that do not " * 9
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (None, text, "en", "src0", 5), (7, text, "en", "src0", 5), (8, text + "end", None, "src12", 6), (9, "x" * 300000, "de", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS id", "2 AS n", "'q' AS digest", "3 AS score", "4 AS root", "5 AS epochs", "6 AS at")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if k < 4:
            assert out.columns == docs.columns
            kept = sorted(((r.doc_id, len(r.text or "")) for r in out.collect()), key=str)
            assert set(kept) <= {(i, len(t or "")) for i, t, *_ in rows}
            if k == 0:
                assert len(kept) == len(rows)
            if k == 1:
                assert kept == sorted([(2, 0), (7, len(text)), (8, len(text) + 3), (9, 300000)], key=str)
            if k == 2:
                assert kept == sorted([(1, 0), (7, len(text)), (9, 300000)], key=str)
        else:
            assert out.count() == len(rows)


def test_stages_keep_columns_of_any_name(spark, sf, tmp_path):
    names = ["_at", "_gone", "_domain", "_epoch", "_metadata", "at", "row", "_row", "gone", "stay", "domain", "epoch", "key", "cls", "_id", "_place", "_bucket", "_lang", "locator", "digest", "x.y", "row.at", "doc_id.z"]
    rows = [(i, f"some words of text {i % 3} that repeat", "en", "src0", 5) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long"])).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, given, sf)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert got, name
            for r in got:
                assert all(r[n] == f"{n}{r.doc_id}" for n in names), name
        assert corpus_pipeline.STAGES[4][1](spark, given, sf).count() == 12


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {name for name in files.getAllFiles().mkString("\n").replace("/", "\n").split("\n") if name.startswith("shuffle_")}
    before = found()
    rows, _ = common.written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "tidy")
    for _ in range(50):
        left = found() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and rows.count() == 1000
