import random
import zlib

import numpy as np

from matrixloom.llm import quality

WORDS = "the river runs slowly under old bridges while children watch boats and birds drift along quiet water".split()


def make(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(10, 150))]
        bad = i % 4 == 0
        if bad:
            words = [words[0]] * 80 if i % 8 else [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = make(1200, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS label", "2 AS key", "3 AS `a.b`", "4 AS piece")
    lab = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "9 AS label", "1 AS `doc_id.x`")
    model = quality.fit(d, lab)
    got = {r.id: r.score for r in quality.scored(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 1200 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.7) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)
    # held-out labels teach nothing
    turned = [(i, 1 - q if i in set(held) else q) for i, q in labels]
    other = quality.fit(d, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert (other.good, other.bad, other.slope, other.intercept) == (model.good, model.bad, model.slope, model.intercept)


def test_evidence_is_that_of_sizes_under_the_dictionaries():
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    good, bad = [text(WORDS).encode() for _ in range(300)], [text(["@@@", "x#x#", "%%y"]).encode() for _ in range(300)]
    model = quality.Model(quality.dictionary(good, 4096), quality.dictionary(bad, 4096))
    texts = [text(WORDS), text(["@@@", "x#x#"]), "", None, "é" * 100_000 + text(WORDS), text(WORDS) * 500]
    got = model.evidence(texts)
    import zstandard

    for t, e in zip(texts, got):
        raw = (t or "").encode()
        size = lambda content: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK))
        # a compressor that digests the dictionary anew finds other matches now and then
        assert abs(e - (size(model.bad) - size(model.good)) / max(1, len(raw))) <= 0.02
    assert got[0] > 0.05 > -0.05 > got[1] and got[2] == got[3] == 0


def test_the_curve_is_the_likeliest():
    rng = np.random.default_rng(3)
    e = np.linspace(-1, 1, 41)
    n = rng.integers(5, 50, 41).astype(float)
    good = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(4 * e + 0.5)))).astype(float)
    slope, intercept = quality.curve(e, good, n - good)
    p, q = (good.sum() + 1) / (good.sum() + 2), 1 / ((n - good).sum() + 2)
    loss = lambda a, b: (good * (np.logaddexp(0, a * e + b) - p * (a * e + b)) + (n - good) * (np.logaddexp(0, a * e + b) - q * (a * e + b))).sum()
    assert all(loss(slope, intercept) <= loss(slope + x, intercept + y) + 1e-3 for x in (-0.05, 0, 0.05) for y in (-0.05, 0, 0.05))
    far = quality.curve(np.array([-1.0, 1.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0]))
    assert 0 < far[0] < 100


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 200_000), (2, "same"), (2, "same")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, one)).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and got[0].score > 0.9
    both = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.fit(docs, both)).collect())
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), both)).count() == 0
