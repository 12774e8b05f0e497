"""WARC files in ZIP packages: written once, read by ranges without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one
gzip member per record, and ``indexes/index.cdxj``, one line per record with its
offset and length.  The reader finds the end of the central directory (and its
ZIP64 form), reads the directory, finds where the stored members' bytes lie, reads
the index, and then reads records by their ranges, neighbouring ones together.  It
needs only a function that reads a range, so packages may lie in any store.

Of records with equal payloads (told by SHA-256, as SHA-1, which the records carry, has
known collisions) of at least ``min_bytes`` bytes, the one with the largest identifier is a
response and the others revisit it.  Packages are written by tasks into the shared folder
under names of their own; only those that successful tasks report are in the manifest, so
tasks can be run again.

Behaviour: a null payload counts as empty; null identifiers are the smallest;
where rows repeat an identifier and a payload, one is the response and the others
revisit it; a null url is left out of the record, and control characters in a url
are percent-encoded; an empty table gives an empty manifest and no records; only
the identifier, the url and the payload are read, whatever other columns are
called.  A task holds one record and the index of the package that it writes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures of a ZIP file's parts.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_NEAR = 4 << 20


# --- reading packages ---------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class Package:
    """A ZIP file behind ``read(offset, length) -> bytes``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Entries, bytes and offset of the central directory."""
        at = max(0, self.size - 65_557)
        tail = self.read(at, self.size - at)
        place = tail.rfind(END)
        while place >= 0:  # a comment may hold the signature, too
            if len(tail) - place >= 22 and place + 22 + struct.unpack_from("<H", tail, place + 20)[0] == len(tail):
                break
            place = tail.rfind(END, 0, place)
        if place < 0:
            raise ValueError("not a ZIP file: no end of a central directory")
        entries, length, offset = struct.unpack_from("<HII", tail, place + 10)
        if 0xFFFF in (entries,) or 0xFFFFFFFF in (length, offset):
            locator = self.read(at + place - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("ZIP64 locator is missing")
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("ZIP64 end of central directory is missing")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
        return entries, length, offset

    def _directory(self) -> Iterator[Member]:
        entries, length, offset = self._end()
        data, at = self.read(offset, length), 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            stored, size, names, extras, comments = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end = at + 46 + names, at + 46 + names + extras
            while extra + 4 <= end:
                kind, long = struct.unpack_from("<HH", data, extra)
                if kind == 1:  # holds, in this order, only what didn't fit above
                    place = extra + 4
                    values = []
                    for value in (size, stored, header):
                        if value == 0xFFFFFFFF:
                            (value,) = struct.unpack_from("<Q", data, place)
                            place += 8
                        values.append(value)
                    size, stored, header = values
                extra += 4 + long
            yield Member(name, method, size, stored, header)
            at = end + comments

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed, its records can't be read by ranges")
        local = self.read(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + names + extras, member.size

    def records(self) -> Iterator[tuple[dict, bytes]]:
        """Headers and block of each record, in the order of the index."""
        start, length = self.place(INDEX)
        lines = self.read(start, length).decode().splitlines()
        ranges = [(x["offset"], x["length"]) for x in (json.loads(line[line.index("{") :]) for line in lines)]
        data, _ = self.place(DATA)
        i = 0
        while i < len(ranges):
            j, first, end = i, ranges[i][0], ranges[i][0] + ranges[i][1]
            while j + 1 < len(ranges) and ranges[j + 1][0] == end and end + ranges[j + 1][1] - first <= _NEAR:
                j += 1
                end += ranges[j][1]
            piece = self.read(data + first, end - first)
            for offset, size in ranges[i : j + 1]:
                yield parsed(gzip.decompress(piece[offset - first : offset - first + size]))
            i = j + 1


def parsed(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:length]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing packages ---------------------------------------------------------


def _urn(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{key}')}>"


def record(key: str | None, url: str | None, payload: bytes, date: str, refers: str | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if key is not None:
        fields.append(("X-Row-Id", key))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers))]
        if refers is not None:
            fields.append(("X-Refers-To-Row-Id", refers))
    fields += [
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


class Writer:
    """Writes one package to a stream that needn't be seekable."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.lines, self.at = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), [], 0

    def add(self, key: str | None, said: bytes) -> None:
        press = zlib.compressobj(4, zlib.DEFLATED, 31)
        piece = press.compress(said) + press.flush()
        self.data.write(piece)
        self.lines.append(f"{_urn(key)} " + json.dumps({"offset": self.at, "length": len(piece)}))
        self.at += len(piece)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _written(folder: str, date: str, package_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        files, base = _filesystem(folder)
        task = TaskContext.get()
        made, writer, stream, name, count = 0, None, None, "", 0

        def close():
            writer.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, refers, revisit = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made}.zip"
                    stream = files.open_output_stream(f"{base}/{name}")
                    writer, count, made = Writer(stream), 0, made + 1
                writer.add(key, record(key, url, payload, date, refers, revisit))
                count += 1
                if writer.at >= package_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return run


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", package_mb: int = 32, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to packages in ``folder``; their manifest ``path, records``."""
    spark = pages.sparkSession
    folder = common.new_path(spark, "warc") if folder is None else folder
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = common.filed(pages, "warc-rows")
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), common.place(rows).alias("row"))
    # equal payloads meet as SHA-256 digests beside small rows; payloads travel by their own
    # rows' places, of which none is common
    slim = rows.where(F.octet_length("payload") >= min_bytes).select("row", "id", F.sha2("payload", 256).alias("key"))
    equal = slim.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("first")).where("n > 1")
    equal, _ = common.written(equal.select("key", "first"), "warc-equal")
    told = slim.join(equal, "key").select("row", F.col("first.id").alias("refers"), (F.col("row") != F.col("first.row")).alias("revisit"))
    found = rows.join(told, "row", "left").select(
        F.col("id").cast("string"), "url", "payload", F.col("refers").cast("string").alias("refers"), F.coalesce("revisit", F.lit(False)).alias("revisit")
    )
    return common.written(found.mapInArrow(_written(folder, date, package_mb << 20), "path string, records long"), "warc-manifest")[0]


def _read(with_payload: bool):
    def run(batches):
        schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = _filesystem(path)
                rows, held = [], 0
                with files.open_input_file(place) as f:

                    def read(offset: int, length: int) -> bytes:
                        f.seek(offset)  # noqa: B023
                        return f.read(length)  # noqa: B023

                    for fields, block in Package(read, f.size()).records():
                        said, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        payload = None
                        if fields["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (digest(payload), len(payload)) != (said, size):
                                raise ValueError(f"{path}: a payload isn't what its digest says")
                        rows.append((fields.get("X-Row-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload if with_payload else None, size, said, fields.get("X-Refers-To-Row-Id")))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_packages(manifest: DataFrame, id_type: str = "long", with_payload: bool = True, parts: int | None = None) -> DataFrame:
    """The records of the packages that ``manifest`` lists; a revisit has no payload."""
    parts = parts or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("path").repartition(parts, "path").mapInArrow(
        _read(with_payload), "id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    )
    return rows.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page, from the packages."""
    manifest = write_packages(common.table(spark, sf_dir, "pages"))
    return read_packages(manifest, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
