import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import toxicity

GOOD = "the river runs slowly under old bridges while children watch boats and birds drift along quiet water".split()
BAD = "vexgrum vexgrud vexgrol nastworm nastling".split()


def make(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = make(800, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS label", "2 AS key", "3 AS evidence")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.id: r.score for r in toxicity.scored(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 800 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)
    stay = toxicity.kept(d, model)
    assert stay.columns == d.columns
    assert {r.doc_id for r in stay.collect()} == {i for i, s in got.items() if s < 0.5}
    # a form of a toxic word that no text has, and an unknown harmless word
    unseen, harmless = model.evidence(["vexgruling", "rivering"], toxicity.Memory())
    assert unseen > 1 > harmless


def cut(counts):
    one, two = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
    return min(0.9, max(0.3, one / (one + 2 * two))) if one else 0.5


class Brute:
    """The same probabilities from dictionaries of strings."""

    def __init__(self, corpus, fitted):
        order = toxicity.ORDER
        tally = {}
        for t in corpus:
            for w in set(toxicity.words_of(t)):
                tally[w] = tally.get(w, 0) + 1
        pairs = {}
        for w, n in tally.items():
            for x, y in zip("^" + w, w + "$"):
                pairs[x, y] = pairs.get((x, y), 0) + n
        self.shared = []
        for seen in ({("", y): sum(k[1] == y for k in pairs) for _, y in pairs}, pairs):
            self.shared.append((seen, cut(seen.values())))
        self.own = []
        for label in (0, 1):
            threes = set()
            for t, y in fitted:
                if y == label:
                    w = toxicity.words_of(t)
                    threes |= set(zip(["", "", *w], ["", *w], w))
            two, one = {}, {}
            for _, v, w in threes:
                two[v, w] = two.get((v, w), 0) + 1
            for _, w in two:
                one[w] = one.get(w, 0) + 1
            spell = {}
            for w in one:
                padded = "^" * (order - 1) + w + "$"
                for i in range(order - 1, len(padded)):
                    g = padded[i - order + 1 : i + 1]
                    spell[g] = spell.get(g, 0) + 1
            levels = {order: spell}
            for k in range(order - 1, 2, -1):
                ends = {}
                for g in levels[k + 1]:
                    ends[g[1:]] = ends.get(g[1:], 0) + 1
                levels[k] = ends
            self.own.append((two, one, levels))

    def spelled(self, label, word):
        order, p = toxicity.ORDER, 1.0
        padded = "^" * (order - 1) + word + "$"
        for i in range(order - 1, len(padded)):
            q = 1e-4
            for (seen, d), context in zip(self.shared, ("", padded[i - 1])):
                total, kinds = sum(n for k, n in seen.items() if k[0] == context), sum(k[0] == context for k in seen)
                if total:
                    q = max(seen.get((context, padded[i]), 0) - d, 0) / total + d * kinds / total * q
            for k in (3, 4, 5):
                seen, g = self.own[label][2][k], padded[i - k + 1 : i + 1]
                d, of = cut(seen.values()), [n for x, n in seen.items() if x[:-1] == g[:-1]]
                if of:
                    q = max(seen.get(g, 0) - d, 0) / sum(of) + d * len(of) / sum(of) * q
            p *= q
        return p

    def word(self, label, left, word):
        two, one, _ = self.own[label]
        d, total = cut(one.values()), sum(one.values())
        p = max(one.get(word, 0) - d, 0) / total + d * len(one) / total * self.spelled(label, word)
        of = [n for (v, _), n in two.items() if v == left]
        if of:
            off = lambda n: min(n, toxicity.CONTEXTS - 1 + cut(two.values()))
            n = two.get((left, word), 0)
            p = (n - off(n)) / sum(of) + sum(map(off, of)) / sum(of) * p
        return p

    def evidence(self, text):
        w = toxicity.words_of(text)
        each = [math.log(1 + toxicity.WEIGHT * (self.word(1, v, x) / self.word(0, v, x) - 1)) for v, x in zip(["", *w], w)]
        return sum(each) / len(each) if each else 0.0


def test_evidence_is_the_brute_force_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_SCORED", 7)
    monkeypatch.setattr(toxicity, "_CACHE", 40)
    docs, labels = make(60, 2)
    docs = [(i, t.replace("the river", "the Öß river")) for i, t in docs]
    d, of = spark.createDataFrame(docs, "doc_id long, text string"), dict(labels)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    lot = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "pmod(xxhash64(doc_id, 2), 4) = 0 AS check").collect()
    fitted = [(t, of[i]) for (i, t) in docs if zlib.crc32(str(i).encode()) % 5 and not dict(map(tuple, lot))[i]]
    brute = Brute([t for _, t in docs], fitted)
    texts = [docs[0][1], docs[1][1], docs[5][1], "", None, "vexgruling", "quiet rivering water vexgrum the the river", "Zzz ß 12 x"]
    got = model.evidence(texts, toxicity.Memory())
    assert np.allclose(got, [brute.evidence(t) for t in texts], rtol=1e-4, atol=1e-6)
    assert any(n > toxicity.CONTEXTS for n in brute.own[0][0].values())


def test_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "words here"), (3, "1234 !!"), (4, "x" * 200000), (5, "long " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        model = toxicity.fit(docs, labels)
        out = toxicity.scored(docs, model).collect()
        assert len(out) == len(rows) and all(0 <= r.score < 0.5 for r in out)
        assert toxicity.kept(docs, model).count() == len(rows)
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_whole_table(spark, sf):
    out = toxicity.op2(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(isinstance(r.held_out, bool) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out)


@pytest.mark.parametrize("x", [[], ["é"], ["漢字", "abc"]])
def test_codes_are_bounded(x):
    assert (toxicity.codes(x) < toxicity.CODES).all()


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    look = toxicity.Lookup(keys[::2])
    at, known = look.find(keys)
    assert known[::2].all() and not known[1::2].any() and (look.keys[at[::2]] == keys[::2]).all()
    assert not toxicity.Lookup(keys[:0]).find(keys)[1].any()


def test_kept_rows_travel_in_small_batches(spark):
    class Model:
        sent, curve, name = None, (4.0, 1.0), "sizes"

        def broadcast(self, spark):
            return SimpleNamespace(value=self)

        def evidence(self, texts, memory):
            assert sum(map(len, texts)) < 16 << 20, "a batch of too many bytes"
            return np.zeros(len(texts))

    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some "), 200_000).alias("text"))
    assert toxicity.kept(docs, Model()).select("doc_id").count() == 40
