import io
import struct
import zipfile

import duckdb
import pytest

from matrixloom.llm import warc


def package(data: bytes) -> warc.Package:
    return warc.Package(lambda at, n: data[at : at + n], len(data))


def made(records):
    out = io.BytesIO()
    w = warc.Writer(out)
    for key, url, payload, revisit in records:
        w.add(key, warc.record(key, url, payload, "2024-01-01T00:00:00Z", "9", revisit))
    w.close()
    return out.getvalue()


def test_records_come_back():
    records = [("1", "http://a/b c\r\nX: y", b"<p>\r\n\r\n</p>", False), ("2", None, b"", False), (None, "é", "ü".encode() * 9000, True)]
    data = made(records)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    got = list(package(data).records())
    assert [f.get("X-Row-Id") for f, _ in got] == ["1", "2", None]
    assert got[0][1].endswith(b"<p>\r\n\r\n</p>") and got[0][0]["WARC-Target-URI"] == "http://a/b%20c%0D%0AX:%20y"
    assert got[2][0]["WARC-Type"] == "revisit" and got[2][0]["X-Payload-Length"] == "18000" and b"\xc3" not in got[2][1]


def test_reads_only_ranges_of_a_zip64_package_with_a_comment():
    big, index = b"x" * 100_000, b"i"
    data = made([("1", "u", big, False)])
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    p = warc.Package(read, len(data))
    assert set(p.members) == {warc.DATA, warc.INDEX}
    # the same directory as ZIP64, with a comment that holds an end's signature
    entries, length, offset = p._end()
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, length, offset)
    cut = data.rindex(warc.END)
    comment = b"see " + warc.END + b"!"
    zip64 = data[:cut] + end64 + warc.LOCATOR64 + struct.pack("<IQI", 0, cut, 1)
    zip64 += warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    assert package(zip64).members == p.members
    assert [b for _, b in package(zip64).records()] == [b for _, b in p.records()]
    assert index and max(asked) <= 65_557


def test_damaged_or_compressed_packages_are_refused():
    with pytest.raises(ValueError, match="not a ZIP"):
        package(b"PK nothing")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, "x" * 1000)
        z.writestr(warc.DATA, "x" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        list(package(out.getvalue()).records())


ROWS = [(1, "u", "a"), (5, "u", "a"), (5, "v", "a"), (None, None, "a"), (2, "u", None), (3, "u", ""), (4, "http://x", "b" * 200000), (7, "u", "é")]


def test_rows(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'p' AS payload", "2 AS first", "3 AS n")
    out = warc.read_packages(warc.write_packages(pages.repartition(3))).collect()
    assert len(out) == len(ROWS)
    a = sorted(((r.id, r.record_type, r.refers_to) for r in out if r.payload_digest == warc.digest(b"a")), key=str)
    assert a == sorted([(1, "revisit", 5), (5, "revisit", 5), (5, "response", None), (None, "revisit", 5)], key=str)
    assert {(r.id, r.record_type, r.refers_to) for r in out if not r.payload_bytes} == {(3, "response", None), (2, "revisit", 3)}
    assert {bytes(r.payload).decode() for r in out if r.record_type == "response"} == {h or "" for _, _, h in ROWS}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out)
    small = warc.read_packages(warc.write_packages(pages, min_bytes=2, package_mb=0)).collect()
    assert {r.record_type for r in small} == {"response"} and len(small) == len(ROWS)
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_whole_table_against_sql(spark, sf):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    sql = warc.ORACLE.replace("FROM pages", f"FROM read_parquet('{sf}/pages.parquet')")
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in warc.op8(spark, sf).select(cols).collect())
