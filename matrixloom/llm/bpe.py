"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

1. Cut: a rolling hash over 32 bytes cuts each text where its top bits are zero
   (moved on to the next character), so equal passages give equal chunks
   wherever they stand.  A chunk is named by its 128-bit BLAKE2b digest.
2. Encode once: chunks meet by digest, whatever documents they come from, and
   each distinct chunk is encoded by one task, once.
3. Join: the ids of its chunks come back to each document, once per task of
   documents.  Where two chunks meet, a window of known ids on both sides is
   turned back into text and encoded anew, and widened until its outer ids agree
   with those of the chunks.  Only then do the chunks' other ids stand.
4. Decode: the ids' bytes are put together again.

The two exchanges move compressed blocks of chunks and of ids, dealt out by a
number; texts move once at most and a chunk that very many documents share moves
once from each task and once to each.  Every step is a function of its input
partition, so lost tasks can be run again.  A task holds the chunks or ids of
its partition (``part_mb`` of text, about), besides the longest document.

Ids are those of the tokenizers library for the same file, without special
tokens added; those that stand in the text are recognised, as it does.

Behaviour: a null text counts as empty and gives no ids; empty tables give empty
results; repeated rows and identifiers are rows of their own; only the
identifier and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 32
_PIECE = 1 << 20
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
_BUFFER = 64 << 20
#: Bytes of neighbouring documents that are put together in one place.
_HOME = 1 << 18
_UNKNOWN = 1 << 50


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return out


class Codec:
    """Encoder and decoder made from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, spec: bytes):
        import tiktoken

        found = json.loads(spec)
        model, pre = found["model"], found["pre_tokenizer"]
        flags = [t for t in found["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or found["normalizer"] or flags:
            raise ValueError("only plain byte-level BPE is supported")
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        ranks = {bytes(symbols[c] for c in w): i for w, i in model["vocab"].items() if w not in self.special}
        self.pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.engine = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        # Before a space and the first byte of a character that is never white
        # space, a word ends whatever stands around it.
        firm = {*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)}
        self.starts = np.array([len(p) > 1 and p[0] == 0x20 and p[1] in firm for p in self.pieces])

    def encode(self, text: bytes) -> np.ndarray:
        said = text.decode("utf-8")
        if any(s in said for s in self.special):
            ids = self.engine.encode(said, allowed_special="all")
        else:
            ids = self.engine.encode_ordinary(said)
        return np.array(ids, dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def join(self, chunks: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from those of its chunks, each encoded alone."""
        done: list[np.ndarray] = []
        tail = chunks[0] if chunks else np.zeros(0, dtype=self.dtype)
        for right in chunks[1:]:
            width = 2
            while True:
                cuts = np.flatnonzero(self.starts[tail])
                while len(cuts) < width and done:
                    tail = np.concatenate([done.pop(), tail])
                    cuts = np.flatnonzero(self.starts[tail])
                near = np.flatnonzero(self.starts[right])
                i, i2 = (cuts[-width], cuts[1 - width]) if len(cuts) >= width else (0, 0)
                j, j2 = (near[width - 1], near[width - 2]) if len(near) >= width else (len(right), len(right))
                new = self.encode(self.decode(tail[i:]) + self.decode(right[:j]))
                whole = not i and j == len(right)
                if whole or np.array_equal(new[: i2 - i], tail[i:i2]) and np.array_equal(new[len(new) - (j - j2) :], right[j2:j]):
                    break
                width *= 2
            done.append(tail[:i])
            tail = np.concatenate([new, right[j:]])
        return np.concatenate([*done, tail])


@lru_cache(maxsize=2)
def codec(spec: bytes) -> Codec:
    return Codec(spec)


def cuts(text: bytes, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``text``."""
    if len(text) <= least:
        return [len(text)] if text else []
    data, ends, start = np.frombuffer(text, dtype=np.uint8), [], 0
    for at in range(0, len(data), _PIECE):
        lead = min(at, WINDOW - 1)
        h = _TABLE[data[at - lead : at + _PIECE]]
        for s in (1, 2, 4, 8, 16):
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        for end in (np.flatnonzero(h[lead:] >> np.uint32(32 - bits) == 0) + at + 1).tolist():
            while end - start > most:
                start = _whole(data, start + most)
                ends.append(start)
            if end - start >= least and (end := _whole(data, end)) < len(data):
                ends.append(end)
                start = end
    while len(data) - start > most:
        start = _whole(data, start + most)
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def _whole(data: np.ndarray, end: int) -> int:
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


class Blocks:
    """Gathers items by their destination and gives out compressed blocks: each when it
    is large enough, and the larger half of them when all together hold ``_BUFFER`` bytes."""

    def __init__(self, kind: int, parts: int, size):
        import zstandard

        self.kind, self.size, self.held, self.bytes = kind, size, {}, {}
        self.most, self.total = max(1 << 15, min(1 << 20, _BUFFER // parts)), 0
        self.press, self.out = zstandard.ZstdCompressor(level=6), []

    def add(self, part: int, item) -> None:
        self.held.setdefault(part, []).append(item)
        size = self.size(item)
        self.bytes[part] = self.bytes.get(part, 0) + size
        self.total += size
        if self.bytes[part] >= self.most:
            self.close(part)
        elif self.total > _BUFFER:
            for large in sorted(self.bytes, key=self.bytes.get, reverse=True)[: max(1, len(self.bytes) // 2)]:
                self.close(large)

    def close(self, part: int) -> None:
        self.out.append((part, self.kind, self.press.compress(pickle.dumps(self.held.pop(part), protocol=5))))
        self.total -= self.bytes.pop(part)

    def close_all(self) -> None:
        for part in list(self.held):
            self.close(part)

    def taken(self):
        """What is ready, as batches."""
        out, self.out = self.out, []
        if out:
            parts, kinds, blocks = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "kind", "block"])


ROWS = "part int, kind int, block binary"
CHUNKS, REFS, IDS = 0, 1, 2


def _opened(batches):
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for part, kind, block in zip(*batch.columns):
            yield part.as_py(), kind.as_py(), block.as_py(), press


def _cut(parts: int, bits: int, least: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        asked: dict[bytes, set] = {}
        chunks = Blocks(CHUNKS, parts, lambda x: len(x[1]) + 24)
        refs = Blocks(REFS, parts, lambda x: 24 + 18 * len(x[1]))
        at, volume = TaskContext.get().partitionId() * 7919, 0
        for batch in batches:
            for key, text in ((k.as_py(), t.as_py()) for k, t in zip(*batch.columns)):
                home, start, names = (at + volume // _HOME) % parts, 0, []
                volume += len(text or b"") + 64
                for end in cuts(text or b"", bits, least, most):
                    chunk = text[start:end]
                    name = hashlib.blake2b(chunk, digest_size=16).digest()
                    names.append(name)
                    start = end
                    homes = asked.get(name)
                    if homes is None:
                        asked[name] = {home}
                        chunks.add(int.from_bytes(name[:4], "little") % parts, (name, chunk, home))
                    elif home not in homes:
                        homes.add(home)
                        chunks.add(int.from_bytes(name[:4], "little") % parts, (name, b"", home))
                refs.add(home, (key, names))
            yield from chunks.taken()
            yield from refs.taken()
        for x in (chunks, refs):
            x.close_all()
            yield from x.taken()

    return run


def _encode(parts: int, spec):
    def run(batches):
        coder = codec(spec.value)
        known: dict[bytes, bytes] = {}
        sent: dict[bytes, set] = {}
        waiting: dict[bytes, set] = {}
        out = Blocks(IDS, parts, lambda x: len(x[1]) + 24)

        def send(name: bytes, home: int) -> None:
            homes = sent.setdefault(name, set())
            if home not in homes:
                homes.add(home)
                out.add(home, (name, known[name]))

        for part, kind, block, press in _opened(batches):
            if kind == REFS:
                out.out.append((part, kind, block))
            else:
                for name, chunk, home in pickle.loads(press.decompress(block)):
                    if chunk and name not in known:
                        known[name] = coder.encode(chunk).tobytes()
                        for x in waiting.pop(name, ()):
                            send(name, x)
                    if name in known:
                        send(name, home)
                    else:
                        waiting.setdefault(name, set()).add(home)
            yield from out.taken()
        out.close_all()
        yield from out.taken()

    return run


def _joined(spec, key_type: pa.DataType):
    def run(batches):
        coder = codec(spec.value)
        known: dict[bytes, np.ndarray] = {}
        refs = []
        for _, kind, block, press in _opened(batches):
            items = pickle.loads(press.decompress(block))
            if kind == REFS:
                refs.append(items)
            else:
                known.update((name, np.frombuffer(ids, dtype=coder.dtype)) for name, ids in items)
        rows, size = [], 0

        def batch():
            keys, ids, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["id", "ids", "text"])

        for items in refs:
            for key, names in items:
                ids = coder.join([known[n] for n in names])
                text = coder.decode(ids)
                rows.append((key, ids.astype("<u4").tobytes(), text.decode("utf-8", "replace")))
                size += len(text) + 4 * len(ids)
                if size > 8 << 20 or len(rows) >= 5000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 11, least: int = 512, most: int = 1 << 15, part_mb: int = 48, parts: int | None = None) -> DataFrame:
    """``id, ids`` (unsigned 32-bit, little-endian), ``text`` (decoded again) of each row.

    ``path``: the tokenizer's JSON; it is read here and sent to the executors.
    ``bits``, ``least``, ``most``: chunks end where so many bits of the rolling
    hash are zero, and are ``least`` to ``most`` bytes long.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if parts is None:
        estimate = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if estimate > _UNKNOWN:  # the rows don't come straight from files, so they are measured
            estimate = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * estimate // (part_mb << 20))
    kind = slim.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    chunks = slim.mapInArrow(_cut(parts, bits, least, most), ROWS).repartition(parts, "part")
    ids = chunks.mapInArrow(_encode(parts, spec), ROWS).repartition(parts, "part")
    return ids.mapInArrow(_joined(spec, to_arrow_type(kind)), f"id {kind.simpleString()}, ids binary, text string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return digests(encoded(common.table(spark, sf_dir, "documents"), default_path()))
