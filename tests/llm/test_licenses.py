import random
import re

import duckdb

from matrixloom.llm import licenses


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(4)
    out = [None, "", "...", "MIT", "mit license", "The MIT-License; cc/by CC BY-NC", "gnu general public", "GNU General  Public\nLicense " * 3, "mıt license", "MİT license", "licenSe MIT Kelvin \u212am\u0130t license cc by", "é mit licensé", "cc by " * 5000]
    bits = [p for _, p in licenses.PHRASES] + ["gnu", "license", "cc", "by", "the", "MIT", "public"]
    return out + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(60)]


def test_base_against_brute_force(spark):
    rows = [(i // 2, t) for i, t in enumerate(texts() + texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "3 AS n", "'x' AS label", "4 AS template")
    out = licenses.scanned(docs.repartition(3)).collect()
    got = sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.n_base == 0 or r.score == 1
    assert licenses.scanned(docs.limit(0)).count() == 0


def brute_labels(text):
    """Labels and score, from lists of places and diagonals."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    labels, score = set(), 0.0
    for _, label, phrase, template in licenses.templates():
        k = min(3, len(template))
        grams = len(template) - k + 1
        diagonals = {}
        for i in range(len(words) - k + 1):
            for j in range(grams):
                if words[i : i + k] == template[j : j + k]:
                    diagonals.setdefault(i - j, []).append((i, j))
        spans, before = [], None
        for d in sorted(diagonals):
            whole = len(diagonals[d]) == grams
            if before is None or d - before[0] > 3 or whole or before[1]:
                spans.append([])
            spans[-1].append(d)
            before = (d, whole)
        for span in spans:
            hits = [h for d in span for h in diagonals[d]]
            near = max(i for i, _ in hits) + k - min(i for i, _ in hits) <= 2 * len(template)
            share = len({j for _, j in hits}) / grams
            if near:
                score = max(score, share)
            if len(diagonals[span[0]]) == grams and phrase or not phrase and near and share >= 0.8:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_against_brute_force(spark):
    rng = random.Random(6)
    given = texts() + ["3 clause bsd 3 clause bsd", "3 clause bsd license 3 clause bsd license", "cc0 1 0 cc0 1 0 universal public", ""]
    for _, _, _, words in licenses.templates():
        for _ in range(6):
            mixed = list(words) + rng.choice([[], words[:4], words])
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(mixed))
                mixed[i : i + rng.randrange(2)] = rng.choice([[], ["foo"], [rng.choice(words)], words[:3]])
            given.append(" ".join(mixed))
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.id: (r.labels, r.score) for r in licenses.scanned(docs).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(given)}
    assert got[given.index("3 clause bsd 3 clause bsd")] == ("", 0.5)


def test_notices_with_changed_words_are_found(spark):
    notice = dict(licenses.NOTICES)["mit"]
    said = notice.replace("person obtaining", "person who is obtaining").replace(" ", ", ").upper()
    cut = " ".join(notice.split()[:9])
    rows = [(1, "foo bar " + said + " end"), (2, cut), (3, "Licensed under CC BY-SA 4.0")]
    out = {r.id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].labels == "mit" and out[1].base_labels == "" and out[1].spans[0].low == 2
    assert out[2].labels == "" and 0 < out[2].score < 0.8
    assert out[3].labels == "cc-by,cc-by-sa" and out[3].base_labels == "cc-by"


def test_whole_table_against_sql(spark, sf):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    sql = licenses.ORACLE.replace("FROM documents", f"FROM read_parquet('{sf}/documents.parquet')")
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in licenses.op7(spark, sf).select(cols).collect())
