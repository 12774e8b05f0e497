"""Files that are read in ranges, against whole ones."""

import random

import pytest

from matrixloom.model import from_dense, to_dense
from matrixloom.sources import splits, text
from pyspark.sql import functions as F


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def told(rows):
    return sorted((r.mid, r.status) for r in rows.collect())


def test_ranges_of_files(spark, tmp_path, small_ranges):
    rng = random.Random(1)

    def spaced(words, lines):
        return "".join(str(w) + (rng.choice(["\n", "\n\n", "\r\n"]) if rng.random() < lines else rng.choice([" ", "  ", "\t"])) for w in words)

    sparse, dense = tmp_path / "sparse", tmp_path / "dense"
    sparse.mkdir(), dense.mkdir()
    for k in range(12):
        m, n = rng.randrange(1, 40), rng.randrange(1, 9)
        a = [[rng.choice([0, 0, 0, 1, -1, 12]) for _ in range(n)] for _ in range(m)]
        cells = [(i + 1, j + 1, v) for i, r in enumerate(a) for j, v in enumerate(r) if v]
        head = [m, n, len(cells)]
        if k % 3:
            (sparse / f"f{k:02}").write_text(spaced([*head, *[x for c in cells for x in c]], (0.1, 0.5, 0.9)[k % 3]))
            (dense / f"f{k:02}").write_text(spaced([m, n, *[v for r in a for v in r]], 0.3))
        else:  # as they are written
            (sparse / f"f{k:02}").write_text(" ".join(map(str, head)) + "\n\n" + "\n".join(" ".join(map(str, c)) for c in cells) + "\n")
            (dense / f"f{k:02}").write_text(f"{m} {n}\n" + "\n".join(" ".join(map(str, r)) for r in a))
    for name, words in (("g0", "2 2 3 1 1 1 2 2 1"), ("g1", "2 2 1 3 1 1"), ("g2", "2 2 2 1 1 1 1 1 5"), ("g3", "2 2 1 1 1 x"), ("g4", "2 2 0"), ("g5", "0 3 0 7"), ("g6", "a b c"), ("g7", "2 2 1 1 1 0")):
        (sparse / name).write_text(words)
        (dense / name).write_text(words)
    for folder, whole, ranges in ((sparse, text.read_sparse, splits.read_sparse), (dense, text.read_dense, splits.read_dense)):
        want, status = whole(text.whole_files(spark, str(folder)))
        got, said = ranges(spark, str(folder))
        assert told(said) == told(status) and {s for _, s in told(said)} == {"OK", "INPUT"}
        assert to_dense(got) == to_dense(want) and len(to_dense(got)) >= 12
    assert spark.read.text(str(sparse)).rdd.getNumPartitions() > 20


def test_dense_files_line_by_line(spark, tmp_path):
    """Rows are lines of their own until they are in the file, in order, and all of a matrix in one file."""
    dense = {0: [[0, 0, 3], [0, 0, 0], [-1, 2, 0]], 7: [[i * j % 5 for j in range(40)] for i in range(300)], 8: "2 0"}
    ms = from_dense(spark, dense)
    lines = text.dense_lines(ms)
    assert lines.where("mid = 0").orderBy("at").toPandas()["value"].tolist() == ["3 3", "0 0 3", "0 0 0", "-1 2 0"]
    text.write_lines(lines.repartition(5), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("mid=7/part-*"))) == 1
    got, status = splits.read_dense(spark, str(tmp_path / "t"), mid=F.regexp_extract("file", "mid=([0-9]+)", 1))
    assert {r.status for r in status.collect()} == {"OK"} and to_dense(got) == {0: dense[0], 7: dense[7], 8: [[], []]}
    assert [r.value for r in text.dense_text(ms.where("mid <> 7"), "", header=True).orderBy("mid").collect()] == ["3 3\n123\n  3\n  \n-1 2 \n".replace("123", "1 2 3"), "2 0\n\n\n\n"]
