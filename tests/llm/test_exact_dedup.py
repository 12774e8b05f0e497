from pyspark.sql import functions as F

from matrixloom.llm import exact_dedup

ROWS = [(4, "a"), (9, "a"), (9, "a"), (None, "a"), (1, None), (2, ""), (3, "b "), (5, "b"), (7, "B"), (8, "x" * 100000)]


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return sorted(((i, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in rows), key=str)


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'q' AS digest", "1 AS n", "2 AS keep", "3 AS locator")
    for digest in (exact_dedup.sha256, lambda t: F.length(t).cast("string")):  # the second collides
        for batches in (1, 3):
            out = exact_dedup.judge(docs.repartition(3), digest=digest, batches=batches).collect()
            assert sorted(((r.id, r.keep_id, r.n) for r in out), key=str) == brute(ROWS)
            assert sum(r.kept for r in out) == len({t or "" for _, t in ROWS})
    assert exact_dedup.judge(docs.limit(0)).count() == 0


def test_kept_rows_are_whole(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "doc_id AS id", "'q' AS digest").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = exact_dedup.deduped(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in ROWS})


def arrivals(spark, tmp_path):
    def frame(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return frame


def told(df):
    return sorted((r.id, r.keep_id, r.n, r.kept) for r in df.collect())


def test_a_later_arrival_meets_the_kept_state(spark, tmp_path):
    frame, state = arrivals(spark, tmp_path), str(tmp_path / "state")
    first, second = frame([(1, "a"), (5, "a"), (2, "b"), (3, None)], "x"), frame([(4, "a"), (9, "b"), (6, "c"), (7, ""), (8, "")], "y")
    assert told(exact_dedup.judge(first, state=state, arrival="x")) == [(1, 5, 2, False), (2, 2, 1, True), (3, 3, 1, True), (5, 5, 2, True)]
    # rows 2 and 3, which stood before, are overtaken by 9 and 8
    want = [(2, 9, 2, False), (3, 8, 3, False), (4, 5, 3, False), (6, 6, 1, True), (7, 8, 3, False), (8, 8, 3, True), (9, 9, 2, True)]
    assert told(exact_dedup.judge(second, state=state, arrival="y")) == want
    # a call that is tried again counts nothing twice
    assert told(exact_dedup.judge(second, state=state, arrival="y")) == want


def test_one_file_is_several_batches(spark, tmp_path):
    docs = arrivals(spark, tmp_path)([(i, f"t{i % 40}") for i in range(400)], "x")
    state = str(tmp_path / "state")
    assert sum(r.kept for r in exact_dedup.judge(docs, state=state).collect()) == 40
    assert len(list((tmp_path / "state" / "changes").glob("epoch=*"))) >= 3


def test_collisions_across_calls(spark, tmp_path):
    frame, state = arrivals(spark, tmp_path), str(tmp_path / "state")
    length = lambda t: F.length(t).cast("string")  # noqa: E731  collides
    first, second = frame([(1, "aa"), (9, "bb"), (2, "bb")], "x"), frame([(4, "aa"), (5, "bb"), (6, "cc"), (10, "bb")], "y")
    assert told(exact_dedup.judge(first, digest=length, state=state, arrival="x")) == [(1, 1, 1, True), (2, 9, 2, False), (9, 9, 2, True)]
    got = told(exact_dedup.judge(second, digest=length, state=state, arrival="y"))
    assert [r for r in got if r[0] in (4, 5, 6, 10)] == [(4, 4, 2, True), (5, 10, 4, False), (6, 6, 1, True), (10, 10, 4, True)]
    # of those that stood before, 1 and 9 are overtaken
    assert (9, 10, 4, False) in got and (1, 4, 2, False) in got and len(got) == 6


def test_rows_of_a_hot_text_are_dealt_to_many_places(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = exact_dedup.judge(docs)
    got = {(r.id, r.keep_id, r.n) for r in out.collect()}
    assert got == {(i, 5999 if t == "same" else i, 4000 if t == "same" else 1) for i, t in rows}
    state = spark.createDataFrame([("x", 4000), ("y", 2)], "digest string, n long")
    assert [tuple(r) for r in exact_dedup.salts_of(state).collect()] == [("x", 4)]
