import random

import numpy as np
import pandas as pd
import xxhash

from matrixloom.llm import simhash
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"


def brute_fp(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in WS else c for c in text).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, k=2):
    """fps: (id, fp) pairs; the least id reachable over links."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= k:
                root[find(i)] = find(j)
    low = {}
    for i, (x, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), x), x)
    return {(x, low[find(i)]) for i, (x, _) in enumerate(fps)}


def test_fingerprint_is_the_brute_force_one():
    for t in ("", None, "a", "A b", "x y z", "One two\tthree four five\x1csix " * 9, "É é\x85k", "w " * 70000):
        assert simhash.fingerprint((t or "").encode())[0] == brute_fp(t), t


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.toPandas()
    out = simhash.op1(spark, sf).toPandas()
    assert len(out) == len(rows)
    fps = [(int(i), brute_fp(t)) for i, t in zip(rows.doc_id, rows.text)]
    assert {(int(i), f) for i, f in zip(out.doc_id, out.fingerprint)} == {(i, f"{f:016x}") for i, f in fps}
    assert {(int(i), int(c)) for i, c in zip(out.doc_id, out.component_id)} == brute_components(fps)


def test_links_of_any_key_size(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for b in base for _ in range(25)}
    frame = spark.createDataFrame(pd.DataFrame({"fp": np.array(sorted(fps), dtype=np.uint64).view(np.int64)}))
    from matrixloom.llm.common import components

    for k, hot in ((2, 1), (2, 4), (2, 1000), (3, 1), (3, 1000), (1, 1)):
        found = components(simhash.links(frame, k=k, blocks=k + 2, hot=hot))
        got = frame.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")).toPandas()
        ids = [(int(x), int(x) & (2**64 - 1)) for x in got.fp]
        assert {(int(a), int(b)) for a, b in zip(got.fp, got.root)} == brute_components(ids, k), (k, hot)


def test_edge_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "  \n", 3), (5, "same text here now", 4), (5, "same text here now", 5), (None, "same text here now", 6), (9, "word", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").selectExpr("*", "1 AS component", "2 AS id")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("id", "component").collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (5, 5), (5, 5), (None, 5), (9, 9)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(400)]
        for c in range(rng.choice([1, 1, 2, 3]) if g else 150):
            copy = list(base)
            for _ in range(rng.randrange(0, 3) if c else 0):
                copy[rng.randrange(400)] = word()
            assert jaccard(base, copy) > 0.9
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), g))
    rows += [(len(rows), None, -1), (len(rows) + 1, "", -1), (len(rows) + 2, "one word", -1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id int").selectExpr("*", "1 AS at", "2 AS root", "3 AS f0")
    frame.repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    stay = {r.doc_id for r in out.collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert stay == set(first.values()) | {len(rows) - 3, len(rows) - 1}
    assert simhash.one_of_each(spark.read.schema(docs.schema).parquet(str(tmp_path / "d")).where("doc_id < 0")).count() == 0


def test_stars_whose_middle_is_not_the_least_class(spark):
    rng, fps = random.Random(3), [f"f{i}" for i in range(4)]
    flipped = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(256), k))
    found = []
    for _ in range(40):
        base = rng.getrandbits(256)
        found += [*(flipped(base, 30) for _ in range(6)), base]
    rows = [(c, *(x >> 64 * w & (1 << 64) - 1 for w in range(4))) for c, x in enumerate(found)]
    frame = pd.DataFrame(np.array(rows, dtype=np.uint64).view(np.int64), columns=["cls", *fps])
    classes = spark.createDataFrame(frame)
    # one key for all and one for each family
    keyed = classes.select("cls", F.explode(F.array(F.lit(-1).cast("long"), F.floor(F.col("cls") / 7))).alias("key"))
    for some in (keyed, keyed.where("key < 0"), keyed.where("key >= 0")):
        roots = {r.node: r.root for r in simhash.met_links(classes, some, fps, 38).collect()}
        assert {(c, roots.get(c, c)) for c in range(len(found))} == brute_components(list(enumerate(found)), 38)


def test_pairs_at_the_similarity_meet_at_any_width():
    rng, share = np.random.default_rng(4), float(np.arccos(1.6 / 1.8) / np.pi)
    differ = rng.random((1000, 256)) < share
    for bits in (12, 20, 26, 30):
        choices = simhash.mask_choices(4, bits, simhash.key_choices(share, 4, bits, 96, 0.95))
        met = np.zeros(1000, dtype=bool)
        for choice in choices:
            met |= ~differ[:, [b for b in range(256) if choice[b // 64] >> b % 64 & 1]].any(axis=1)
        assert met.mean() > 0.93, bits


def test_unlike_texts_with_a_common_repeated_line_stay(spark):
    rng = random.Random(12)
    words = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    line = words(16)
    texts = [f"{words(204)} {' '.join([line] * 20)}" for _ in range(8)]
    copy = words(100)
    # the last three: 96 shingles, of which 11 of 107 or 21 of 117 differ
    texts += [copy, f"{copy} {words(11)}", f"{words(10)} {copy} {words(17)}"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {root.index(r) for r in set(root)}


def test_recall_from_the_similarity_up_at_two_sizes(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for fillers in (0, 9000):
        rows, pairs = [], []
        while len(pairs) < 150:
            base = [word() for _ in range(rng.randrange(150, 400))]
            copy = list(base)
            for _ in range(max(1, len(base) // 48)):
                copy[rng.randrange(len(base))] = word()
            if 0.8 <= jaccard(base, copy) < 0.86:
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
        rows += [(len(rows) + i, " ".join(word() for _ in range(30))) for i in range(fillers)]
        stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
        assert stay >= {i for i, _ in rows} - {b for _, b in pairs}
        assert sum(b not in stay for _, b in pairs) >= 0.9 * len(pairs), fillers


def test_hot_keys_ask_about_few_pairs_and_lose_no_link(spark, monkeypatch):
    rng, asked = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, other = ([word() for _ in range(300)] for _ in range(2))
    texts = []
    for i in range(240):
        copy = list(base if i % 3 else other)
        copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    real = simhash.alike_pairs
    monkeypatch.setattr(simhash, "alike_pairs", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs, hot=8).collect()} == {0, 1}
    assert sum(asked) < 10 * len(texts)


def test_marks_never_part_what_is_similar_and_part_most_else(spark):
    rng, rows, same, parted = np.random.default_rng(3), [], [], []
    for size in (0, 1, 3, 4, 5, 9, 15, 16, 17, 60, 120, 128, 129, 150, 500, 512, 520, 3000):
        for part in (1.0, 0.9, 0.81, 0.8, 0.799, 0.7, 0.5):
            for wide in (size, round(size / 0.8), round(size * 0.9)):
                both = min(round(part * (size + wide) / (1 + part)), size, wide)
                pool = np.unique(rng.integers(0, 1 << 32, 2 * (size + wide) + 9, dtype=np.uint64).astype("<u4"))
                rng.shuffle(pool)
                x, y = pool[:size], np.concatenate([pool[:both], pool[size : size + wide - both]])
                rows.append([(len(v), *([m - (1 << 64) if m >> 63 else m for m in ms] for ms in simhash.marks(v))) for v in (x, y)])
                union = size + wide - both
                same.append(both >= 0.8 * union)
                parted.append(size >= 60 and both < 0.72 * union)
    mark = "struct<size: int, marks: array<long>, half: array<long>>"
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, x {mark}, y {mark}")
    for a, b in (("x", "y"), ("y", "x")):
        kept = {r.i for r in frame.where(simhash.may_be_alike(a, b, 0.8)).select("i").collect()}
        assert sum(same) > 50 and kept >= {i for i, s in enumerate(same) if s}
        assert sum(parted) > 50 and not kept & {i for i, s in enumerate(parted) if s}


def test_near_but_unlike_texts_are_not_asked_about(spark, monkeypatch):
    rng, asked = random.Random(17), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for i in range(200):
        copy = list(base)
        for k in range(2 if i % 4 == 0 else 5):
            copy[30 * k + rng.randrange(25)] = word()
        texts.append(" ".join(copy))
    # the texts with two new words are within 0.8 of each other or not, chains link them
    rows = [t.split() for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    root = list(range(len(rows)))
    for i, j in pairs:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    real = simhash.alike_pairs
    monkeypatch.setattr(simhash, "alike_pairs", lambda some, *a: asked.append(some.count()) or real(some, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (8, 1000):
        asked.clear()
        assert {r.doc_id for r in simhash.one_of_each(docs, hot=hot).collect()} == set(root)
        assert 1 < len(set(root)) and sum(asked) < 5 * len(texts), (hot, sum(asked))


def test_pairs_by_key_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    n = 4000
    keys = rng.integers(-300, 300, n)
    keys[:900] = 7
    cls, f0 = (rng.integers(-(1 << 62), 1 << 62, n) for _ in range(2))
    near = rng.random(n) < 0.5
    f0[near] = f0[0] ^ (1 << rng.integers(0, 62, near.sum()))
    frame = spark.createDataFrame(pd.DataFrame({"key": keys, "cls": cls, "f0": f0}))
    by = {}
    for row in zip(keys.tolist(), cls.tolist(), f0.tolist()):
        by.setdefault(row[0], []).append(row)
    for batch, hot in (("10000", 8), ("37", 8), ("37", 1000), ("500", 40)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = simhash.pairs_by_key(frame, 20, hot).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs = {(min(a, b), max(a, b)) for rows in by.values() if len(rows) <= hot for i, (_, a, x) in enumerate(rows) for _, b, y in rows[:i] if bin((x ^ y) & (1 << 64) - 1).count("1") <= 20}
        assert {(r.a, r.b) for r in got if r.key is None} == pairs and pairs
        assert sorted((r.key, r.a, r.b) for r in got if r.key is not None) == sorted(r for rows in by.values() if len(rows) > hot for r in rows)
