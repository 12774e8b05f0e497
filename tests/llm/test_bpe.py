import hashlib
import random
import struct

import pytest

from matrixloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_whole_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5(spark, sf).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in rows}


def test_edge_rows(spark, library):
    shared = "the quick brown fox's 12 jumps, over  the\n\n lazy dog " * 60
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, shared), (4, "head " + shared + " tail"), (5, " " * 5000), (6, "　  a" * 3000), (7, "ab<|endoftext|>cd " * 400), (8, "漢字かな" * 4000), (9, "z" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS part", "3 AS ids").repartition(2)
    out = bpe.digests(bpe.encoded(docs, bpe.default_path(), bits=6, least=32, most=512, parts=3)).collect()
    want = sorted(((i, *expected(library, t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert bpe.encoded(docs.limit(0), bpe.default_path()).count() == 0


def test_any_cut_is_repaired(library):
    with open(bpe.default_path(), "rb") as f:
        coder = bpe.Codec(f.read())
    rng = random.Random(3)
    parts = ["a", " b", "  ", "\n", " don't", "'s", "1", " 22", "…", " é", " ", "<|endoftext|>", "-", " ", "the", "漢"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
        at = sorted(rng.sample(range(len(text) + 1), rng.randrange(0, min(5, len(text)) + 1)))
        cut = [text[i:j].encode() for i, j in zip([0, *at], [*at, len(text)]) if i < j]
        assert coder.join([coder.encode(c) for c in cut]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(4000)).encode()
    a, b = b"x" * 100 + passage, b"yy " * 50 + passage

    def chunks(t):
        ends = bpe.cuts(t, 10, 128, 1 << 14)
        assert ends[-1] == len(t) and ends == sorted(set(ends))
        return {t[i:j] for i, j in zip([0, *ends], ends)}

    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 4
