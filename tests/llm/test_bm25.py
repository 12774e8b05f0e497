import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from matrixloom.llm import bm25
from pyspark.sql import functions as F


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(rows, asks, k):
    docs = [(i, Counter(words(t))) for i, t in rows]
    n, mean = len(docs), max(1, sum(sum(c.values()) for _, c in docs)) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, c in docs:
        if q is None or not asks(q):
            continue
        scored = []
        for i, d in docs:
            common = c.keys() & d.keys()
            if common:
                dl = sum(d.values())
                s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * dl / mean)) for w in common)
                scored.append((-round(s, 6), i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(60)] + ["the", "OF", "é"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, None), (None, "the abc"), (1001, "the of é " * 400), (1002, rows[4][1]), (1003, rows[4][1]), (1005, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS shard", "3 AS query", "4 AS rank")
    for shard, block in ((16_384, 200), (70, 7), (20, 7)):
        out = bm25.search(docs.repartition(3), F.col("doc_id") % 4 == 0, k=5, shard_docs=shard, block=block).collect()
        assert sorted(((r.query, r.rank, r.id, r.score) for r in out), key=str) == brute(rows, lambda q: q % 4 == 0, 5)
    assert bm25.search(docs.limit(0), F.lit(True)).count() == 0


def test_pruning_leaves_blocks_out():
    rng = np.random.default_rng(3)
    n = 6400
    terms = np.concatenate([np.full(n, 1), np.full(40, 2)]).astype(np.uint64)
    owner = np.concatenate([np.arange(n), np.arange(40)])
    index = bm25.Index(np.arange(n), np.full(n, 10.0), terms, rng.integers(1, 3, len(terms)), owner, 10.0)
    seen = []
    whole = bm25.spread

    def spy(a, b):
        out = whole(a, b)
        seen.append(len(out[0]))
        return out

    bm25.spread = spy
    try:
        docs, scores = index.top(np.array([1, 2], dtype=np.uint64), np.array([0.1, 8.0]), 10)
    finally:
        bm25.spread = whole
    assert (docs < 40).all() and len(docs) == 10 and sum(seen[1:]) < n // 10


def test_whole_table_against_sql(spark, sf):
    cols = ["query_id", "rank", "doc_id", "score"]
    sql = bm25.ORACLE.replace("FROM documents", f"FROM read_parquet('{sf}/documents.parquet')")
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in bm25.op9(spark, sf).select(cols).collect())


def test_pairs_of_shards_and_queries_are_not_shuffled(spark):
    """Else what is written grows with shards times queries."""
    shards = spark.range(6).selectExpr("cast(id AS int) AS shard", "array(cast('d' AS binary)) AS docs")
    groups = spark.range(4).selectExpr("cast(id AS int) AS group", "array(cast('q' AS binary)) AS queries", "array(id) AS asked", "array(0.5D) AS floors")
    cells = bm25._cells(shards, groups)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and cells.count() == 24


def test_groups_of_queries(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    out = bm25.search(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), k=3, shard_docs=16, block=5, group_queries=25, first=2)
    assert sorted(((r.query, r.rank, r.id, r.score) for r in out.collect()), key=str) == brute(rows, lambda q: True, 3)


def test_terms_are_runs_of_the_contract_s_bytes():
    every = bytes(range(256)) * 2 + b"One  two\x85three\xa0 9_x\xc3\x9f"
    assert bm25.terms_of(every) == re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", every.lower())
    assert bm25.terms_of(b"") == []


def test_exact_scores_weigh_only_postings_of_the_query_s_terms(monkeypatch):
    n, width = 300, 200
    terms = np.tile(np.arange(width, dtype=np.uint64), n)
    owner = np.repeat(np.arange(n), width)
    index = bm25.Index(np.arange(n), np.full(n, width) + np.arange(n), terms, np.ones(n * width, dtype=np.int64), owner, 200.0)
    asked = []
    impact = bm25.Index._impact
    monkeypatch.setattr(bm25.Index, "_impact", lambda self, postings, entry: asked.append(len(postings)) or impact(self, postings, entry))
    best, scores = index.top(np.array([3, 5], dtype=np.uint64), np.array([1.0, 2.0]), 10)
    assert best.tolist() == list(range(10)) and (np.diff(scores) < 0).all()
    assert 0 < sum(asked) <= 2 * n
