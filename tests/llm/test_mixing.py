import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pyarrow as pa

from matrixloom.llm import common, mixing


def fill(budget, caps, weights):
    """Whole shares: fill up those that can't take theirs, divide again, then deal
    the remainder out in order of cap / weight and name."""
    caps = {k: c if weights[k] > 0 else 0 for k, c in caps.items()}
    order = sorted(caps, key=lambda k: (caps[k] / max(1, weights[k]), k))
    full = {k for k in caps if caps[k] == 0}
    while True:
        left, total = budget - sum(caps[k] for k in full), sum(weights[k] for k in caps if k not in full)
        new = {k for k in caps if k not in full and caps[k] <= Fraction(left * weights[k], total)}
        if not new:
            break
        full |= new
    share = {k: caps[k] if k in full else left * weights[k] // total for k in caps}
    rest = budget - sum(share.values())
    for k in [k for k in order if k not in full][: max(0, rest)]:
        share[k] += 1
    return share


def brute(rows, weights, percent, epochs, seed, domain):
    leaf = defaultdict(list)
    for i, text, lang, source in rows:
        leaf[domain(source or ""), lang or "", source or ""].append((i, len(re.findall("[^ \t-\r]+", text or ""))))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    w = lambda k: weights.get(k, 1)

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        children = {k[: len(prefix) + 1] for k in leaf if k[: len(prefix)] == prefix}
        caps = {c: epochs * sum(t for k, t in tokens.items() if k[: len(c)] == c) for c in children}
        share, out = fill(budget, caps, {c: w(c) for c in children}), {}
        for c in children:
            out |= down(c, share[c])
        return out

    taken = []
    for k, budget in down((), sum(tokens.values()) * percent // 100).items():
        if not tokens[k]:
            continue
        e, rest = divmod(budget, tokens[k])
        taken += [(i, k[0], x) for i, _ in leaf[k] for x in range(1, e + 1)]
        place = lambda i: hashlib.md5(f"{seed}:{e + 1}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        by = defaultdict(list)
        for i, n in leaf[k]:
            by[place(i)].append((i, n))
        total = 0
        for p in sorted(by) if rest else []:
            total += sum(n for _, n in by[p])
            if total > rest:
                break
            taken += [(i, k[0], e + 1) for i, _ in by[p]]
    return sorted(taken, key=str)


def table(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(n) if rng.random() < 0.9 else i, " ".join("ab" for _ in range(rng.randrange(0, 30))), rng.choice(["en", "en", "de", None]), "src" + str(rng.choice([0, 0, 0, 0, 3, 11, 12]))) for i in range(n)]
    return [*rows, (None, None, "en", None), (7, "x " * 3000, "en", "src3")]


def test_against_brute_force(spark):
    domain = lambda s: "web" if len(re.search("[0-9]*$", s)[0]) <= 1 else "curated"
    for seed, percent, epochs, weights in ((1, 60, 2, mixing.WEIGHTS), (2, 150, 2, {("web", "de"): 0}), (3, 500, 3, {("web",): 9}), (4, 30, 1, {("curated",): 50, ("curated", "de", "src11"): 7})):
        rows = table(300, seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS epochs", "2 AS tokens", "3 AS rest", "4 AS weight")
        out = mixing.mixed(docs, weights, percent, epochs, seed=5)
        assert out.columns == [*docs.columns, "_domain", "_epoch"]
        assert sorted(((r.doc_id, r._domain, r._epoch) for r in out.collect()), key=str) == brute(rows, weights, percent, epochs, 5, domain), seed
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    # a.x can give 10 of its 50; a.y takes the other 40 before b gets any of it
    rows = [("a", "x", "s", 10, 10), ("a", "y", "s", 1000, 1000), ("b", "z", "s", 1000, 1000)]
    cols = dict(zip((*mixing.LEVELS, "tokens", "cap"), zip(*rows)))
    leaves = common.local_table(spark, {k: (pa.int64() if isinstance(v[0], int) else pa.string(), list(v)) for k, v in cols.items()}).drop("cap")
    got = {r._lang: r.budget for r in mixing.budgets(leaves, {}, 10, 1).collect()}
    assert got == {"x": 10, "y": 90, "z": 101}


def test_whole_table_against_sql(spark, sf):
    docs = f"read_parquet('{sf}/documents.parquet')"
    cols = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens"]
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE.replace('FROM documents', 'FROM ' + docs)})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in mixing.op4(spark, sf).select(cols).collect())
