"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprint: A-Z are lower-cased, words are runs of anything but space and
``\\t``..``\\r``, shingles are ``n`` consecutive words joined by a space, repeats
included (fewer words: the whole sequence; none: fingerprint zero).  A bit is set
if it is set in over half of the shingles' XXH64 values (UTF-8, seed 42).

Links: equal fingerprints are one class, so copies cost nothing below.  The 64
bits are cut into ``blocks`` blocks; two fingerprints that differ in at most
``k`` bits agree on at least ``blocks - k`` of them, so each class is filed under
every choice of that many blocks, classes are joined on these keys, and the
Hamming distance of each pair that meets is checked.  A key that more than
``hot`` classes share is not joined with itself: there every class is filed under
each value within half of ``k`` bits (rounded up) outside the key's blocks, and
linked to the least class that is within half of ``k`` bits (rounded down) of
that value.  Two classes are within ``k`` bits just when such a value lies
between them, so this links the same classes at a cost in proportion to their
number.

Behaviour: a null text counts as empty; texts without words have fingerprint
zero and link like any other; repeated rows and identifiers are rows of their
own; an empty table gives an empty result; only the identifier and the text are
read, whatever other columns are called.  The smallest identifier of a component
names it (null only if all its identifiers are null).

:func:`similar` is for a similarity that differs in too many bits for every
choice of blocks to be filed (a 0.8 of shingles is 38 of 256 bits: blocks that all such
pairs are sure to share take 10,660 choices of 3 of 41): it has longer fingerprints of
distinct shingles, files each class under a number of seeded choices of blocks that
grows with the number of classes, and compares the shingle sets of what is near.
Pairs that are near but can't be that similar are told by :func:`marks` before.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_PIECE = 1 << 16


def fingerprint(text: bytes, n: int = 3, longs: int = 1) -> list[int]:
    """SimHash of one text given in UTF-8, as unsigned longs: the first of the
    shingles' hashes themselves, further ones of mixtures of them."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return [0] * longs
    grams = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    total, count, buffer = np.zeros((longs, 64), dtype=np.int64), 0, []

    def add() -> None:
        nonlocal count
        h = np.array(buffer, dtype="<u8")
        for i in range(longs):
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[i] += bits.sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        count += len(buffer)
        buffer.clear()

    for gram in grams:
        buffer.append(xxh64_intdigest(gram, 42))
        if len(buffer) == _PIECE:
            add()
    if buffer:
        add()
    return np.packbits(2 * total > count, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def sketch(text: bytes, n: int = 5, longs: int = 4) -> tuple[int, list[int], bytes]:
    """Of the set of a text's shingles, repeats left out: its XXH64, its SimHash and its
    elements (the low halves of their XXH64 values, sorted)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    grams = [b" ".join(words)] if 0 < len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    hashes = np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))
    total = np.zeros((longs, 64), dtype=np.int64)
    for at in range(0, len(hashes), _PIECE):
        h = hashes[at : at + _PIECE]
        for i in range(longs):
            total[i] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    bits = np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()
    return xxh64_intdigest(hashes.tobytes(), 42), bits, np.unique(hashes.astype("<u4")).tobytes()


def marks(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """Bit i (of four times as many bits as there are shingles, rounded up to 64 times a
    power of two): whether the number of shingles that are i modulo the number of bits is
    odd; and the same of half as many bits.  As unsigned longs.

    What two sets have in common cancels out, so the bits in which marks differ are
    at most as many as the elements that only one set has."""
    longs = 1 << max(0, math.ceil(len(shingles) / 16) - 1).bit_length()
    odd = np.bincount(shingles % np.uint32(64 * longs), minlength=64 * longs) & 1
    whole = np.packbits(odd.astype(bool), bitorder="little").view("<u8")
    return whole.tolist(), (whole[: longs // 2] ^ whole[longs // 2 :]).tolist() if longs > 1 else []


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (the fingerprint's bits as a signed long) for each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.fromiter((fingerprint(t or b"", n)[0] for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def block_masks(k: int, blocks: int) -> list[int]:
    """The bits of each choice of ``blocks - k`` blocks, as unsigned longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(single, blocks - k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, k: int = 2, blocks: int = 4, hot: int = 64) -> DataFrame:
    """Edges ``a, b`` between values within ``k`` bits: each pair directly, or
    chains of links through values that lie between two classes."""
    masks = [signed(m) for m in block_masks(k, blocks)]
    keyed, path = common.written(
        classes.select(
            "fp",
            F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"),
        ),
        "simhash-keys",
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    met, met_path = common.written(keyed.join(sizes, ["choice", "key"]), "simhash-met")
    few = met.where(F.col("size") <= hot).select("choice", "key", "fp")
    pairs = (
        few.join(few.withColumnRenamed("fp", "fp2"), ["choice", "key"])
        .where("fp < fp2")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= k)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    ones = F.array(*[F.lit(signed(1 << i)) for i in range(64)])
    of_choice = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("choice") + 1)
    outside = F.filter(ones, lambda bit: bit.bitwiseAND(of_choice) == 0)
    step = met.where(F.col("size") > hot).select("choice", "key", "fp", F.col("fp").alias("hub"), outside.alias("bits"))
    for _ in range((k + 1) // 2):
        step = step.select(
            "choice", "key", "fp", "bits", F.explode(F.concat(F.array("hub"), F.transform("bits", lambda bit: F.col("hub").bitwiseXOR(bit)))).alias("hub")
        ).select("choice", "key", "fp", "hub", "bits")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= k // 2
    hubs = step.groupBy("choice", "key", "hub").agg(F.min(F.when(near, F.col("fp"))).alias("low")).where("low IS NOT NULL")
    starred = step.join(hubs, ["choice", "key", "hub"]).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.unionByName(starred)


def near_duplicates(docs: DataFrame, n: int = 3, k: int = 2, blocks: int = 4, hot: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component`` for each row."""
    rows, _ = common.written(fingerprints(docs, n, id_col, text_col), "simhash-rows")
    classes, _ = common.written(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies")), "simhash-classes")
    roots = common.components(links(classes, k, blocks, hot), "simhash-cc")
    of_class = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = of_class.groupBy("root").agg(F.min("low").alias("component"))
    named, _ = common.written(of_class.join(names, "root").select("fp", "component"), "simhash-named")
    return rows.join(named, "fp").select("id", "fp", "component")


def mask_choices(longs: int, bits: int, choices: int, seed: int = 7) -> list[list[int]]:
    """Seeded choices of ``bits`` bits of a fingerprint, in blocks of three."""
    rng, size = np.random.default_rng(seed), 64 * longs
    out = []
    for _ in range(choices):
        starts = rng.choice(size // 3, -(-bits // 3), replace=False) * 3
        chosen = [int(s) + i for s in starts for i in range(3)][:bits]
        out.append([sum(1 << (b % 64) for b in chosen if b // 64 == w) for w in range(longs)])
    return out


def key_choices(share: float, longs: int, bits: int, least: int, chance: float) -> int:
    """How many choices of ``bits`` bits (``least`` or more) let two fingerprints, each bit
    of which differs with probability ``share``, agree on one with probability ``chance``."""
    size = 64 * longs
    alike = np.array([math.prod((size - d - i) / (size - i) for i in range(bits)) for d in range(size - bits + 1)])
    weights = np.array([math.comb(size, d) * share**d * (1 - share) ** (size - d) for d in range(size - bits + 1)])
    while float((weights * (1 - (1 - alike) ** least)).sum()) < chance:
        least += 8
    return least


def pairs_by_key(keyed: DataFrame, bound: int, hot: int) -> DataFrame:
    """Of ``keyed(key, cls, f0)``: the pairs ``a, b`` of classes under a key of at most ``hot``
    classes whose first 64 bits differ in at most ``bound`` (``key`` is null), and the
    rows ``key, cls, f0`` of larger keys as they are, as ``key, a, b``.

    One exchange by key, whose partitions are sorted and read as they come; of each key at
    most ``hot`` rows are held."""

    def run(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3
        large = None  # the key that is being read and is known to be large
        for batch in batches:
            key, cls, f0 = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            keep = int(sizes[-1]) if sizes[-1] <= hot and key[-1] != large else 0  # it may go on
            held = [x[len(key) - keep :].copy() for x in (key, cls, f0)]
            done = slice(0, len(starts) - bool(keep))
            yield from _met(key, cls, f0, starts[done], sizes[done], large, bound, hot)
            large = None if keep else key[-1] if sizes[-1] > hot or key[-1] == large else None
        if len(held[0]):
            yield from _met(*held, np.zeros(1, dtype=np.int64), np.array([len(held[0])]), None, bound, hot)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def _met(key, cls, f0, starts, sizes, large, bound, hot):
    whole = (sizes > hot) | (key[starts] == large) if large is not None else sizes > hot
    for size in np.unique(sizes[~whole & (sizes > 1)]).tolist():
        x, y = np.triu_indices(size, 1)
        first = starts[~whole & (sizes == size)]
        for i in range(0, len(first), 1 + (1 << 18) // len(x)):
            at = first[i : i + 1 + (1 << 18) // len(x), None]
            a, b = (at + x).ravel(), (at + y).ravel()
            near = np.bitwise_count((f0[a] ^ f0[b]).view(np.uint64)) <= bound
            a, b = cls[a[near]], cls[b[near]]
            if len(a):
                yield _triples(None, np.minimum(a, b), np.maximum(a, b))
    for i, n in zip(starts[whole].tolist(), sizes[whole].tolist()):
        yield _triples(key[i : i + n], cls[i : i + n], f0[i : i + n])


def _triples(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([keys, pa.array(a), pa.array(b)], names=["key", "a", "b"])


def first_bound(most: int, longs: int) -> int:
    """In how many of the first 64 bits pairs may differ that differ in ``most`` of all: one
    pair in 10,000 of those just there differs in more."""
    limit = most / (64 * longs)
    return min(64, int(64 * limit + 3.7 * math.sqrt(64 * limit * (1 - limit))))


def may_be_alike(one: str, two: str, similarity: float) -> Column:
    """Whether sets may have that Jaccard similarity, by columns with their ``size`` and
    :func:`marks`; true for all that have it.

    Sets of sizes x and y have it if at most (x + y) (1 - similarity) / (1 + similarity)
    elements are in one of them only.  Their marks then are of equal length, or one is twice
    as long as the other."""
    x, y = F.col(one), F.col(two)
    most = (x["size"] + y["size"]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    fitted = lambda a, b: F.when(F.size(a["marks"]) > F.size(b["marks"]), a["half"]).otherwise(a["marks"])
    differ = F.aggregate(F.zip_with(fitted(x, y), fitted(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, bits: n + bits)
    return (F.abs(x["size"] - y["size"]) <= most) & (differ <= most)


def possible(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose sets may be alike, by ``marked(cls, mark)``."""
    one, two = (marked.select(F.col("cls").alias(c), F.col("mark").alias(f"{c}_mark")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(may_be_alike("a_mark", "b_mark", similarity)).select(pairs.columns)


def near_pairs(pairs: DataFrame, classes: DataFrame, fps: list[str], most: int) -> DataFrame:
    """Of the pairs ``a, b`` those within ``most`` bits, once each, with that number as ``dist``."""
    left, right = (classes.select(F.col("cls").alias(c), *[F.col(f).alias(f"{c}_{f}") for f in fps]) for c in ("a", "b"))
    differ = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in fps[1:]), F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))))
    return pairs.distinct().join(left, "a").join(right, "b").withColumn("dist", differ.cast("int")).where(F.col("dist") <= most).select("a", "b", "dist")


def joined(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``node, root``: the components of ``roots`` and further ``edges(a, b)``."""
    if roots is not None:
        edges = edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return common.components(edges, "similar-cc")


def rooted(rows: DataFrame, roots: DataFrame | None, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the root of each column's class; ``columns``: new name by column."""
    for c, name in columns.items():
        if roots is None:
            rows = rows.withColumn(name, F.col(c))
        else:
            rows = rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    return rows


def settled(near: DataFrame, roots: DataFrame | None, alike) -> DataFrame | None:
    """``roots`` with what ``alike`` keeps of the pairs ``near(a, b, dist)`` joined.

    A pair that links join already is never asked about, so a group of many near copies
    costs about as many questions as it has members: first each component asks about
    its nearest open pair to another, then about up to 64, at last about all.
    """
    spark, picks, path = near.sparkSession, 1, None
    open_ = near
    while True:
        mine = rooted(open_.select("a", "b", "dist"), roots, {"a": "x", "b": "y"}).where("x <> y")
        open_, new_path, (left,) = common.counted(mine, "similar-open")
        if path:
            common.delete(spark, path)
        path = new_path
        if not left:
            return roots
        if picks > 64:
            chosen = open_.select("a", "b")
        else:
            slot = F.pmod(F.xxhash64("a", "b"), F.lit(picks))
            each = open_.select(F.col("x").alias("root"), "dist", "a", "b").unionByName(open_.select(F.col("y").alias("root"), "dist", "a", "b"))
            chosen = each.groupBy("root", slot.alias("slot")).agg(F.min(F.struct("dist", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
            chosen, _ = common.written(chosen, "similar-chosen")
        kept, some = alike(chosen)
        if some:
            roots = joined(roots, kept)
        if picks > 64:
            return roots
        open_ = open_.join(chosen, ["a", "b"], "left_anti")
        picks *= 64


def met_links(classes: DataFrame, keyed: DataFrame, fps: list[str], most: int, roots: DataFrame | None = None, alike=None, marked: DataFrame | None = None, similarity: float = 0.8) -> DataFrame | None:
    """``node, root``: components of ``roots`` and of the classes that share a key, differ in
    at most ``most`` bits and are among the pairs that ``alike`` (if given) keeps of such ones.
    ``marked(cls, mark)`` (if given) tells pairs that don't have the ``similarity`` before.

    In each round some heads of a key are compared with all its classes that aren't
    linked to them yet, and then leave it; whatever is near a head stays and is
    compared with the rest.  Heads come from the smallest components of the key and
    grow eightfold in number by round.  A key is done when links join all its
    classes, so one of many similar classes costs little more than their number; pairs
    of classes that no links join are compared one by one, by their marks where these
    tell enough.
    """
    spark = classes.sparkSession
    bound = first_bound(most, len(fps))
    if "f0" not in keyed.columns:
        keyed = keyed.join(classes.select("cls", F.col(fps[0]).alias("f0")), "cls")
    path, turn, asked = None, 0, None
    while True:
        heads = 8**turn
        mine = rooted(keyed, roots, {"cls": "root"}).select("cls", "key", "f0", "root")
        several = mine.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        current, current_path, (left,) = common.counted(mine.join(several, "key").select("cls", "key", "f0", "root"), "similar-keyed")
        if path:
            common.delete(spark, path)
        path, turn = current_path, turn + 1
        if not left:
            return roots
        sized = current
        if turn > 1:
            sized = current.join(current.groupBy("key", "root").agg(F.count("*").alias("size")), ["key", "root"])
        slot = F.pmod(F.xxhash64("cls"), F.lit(heads))
        least = F.min(F.struct(*(["size"] if turn > 1 else []), "cls", "root", "f0")).alias("h")
        head = sized.groupBy("key", slot.alias("slot")).agg(least).select(F.col("key").alias("k"), F.col("h.cls").alias("b"), F.col("h.root").alias("b_root"), F.col("h.f0").alias("b_f0"))
        may = F.bit_count(F.col("f0").bitwiseXOR(F.col("b_f0"))) <= bound
        ones, others = current, head
        if marked is not None:
            ones = current.join(marked, "cls")
            others = head.join(marked.select(F.col("cls").alias("b"), F.col("mark").alias("b_mark")), "b")
            may = may & may_be_alike("mark", "b_mark", similarity)
        met = ones.join(others, (F.col("key") == F.col("k")) & (F.col("root") != F.col("b_root")) & may).select(F.col("cls").alias("a"), "b")
        near = near_pairs(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), classes, fps, most)
        if asked is not None:
            near = near.join(asked, ["a", "b"], "left_anti")
        near, _, (some,) = common.counted(near, "similar-near")
        if some:
            roots = settled(near, roots, alike) if alike else joined(roots, near.select("a", "b"))
            # what was near once is linked now or has been asked about
            asked = near.select("a", "b") if asked is None else asked.unionByName(near.select("a", "b"))
        keyed = current.join(head.select(F.col("k").alias("key"), F.col("b").alias("cls")), ["key", "cls"], "left_anti").select("cls", "key", "f0")


def shingle_sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``cls, shingles, mark`` (see :func:`may_be_alike`) of the rows of ``texts(at, text)``
    that ``wanted(cls, at)`` names.

    The scan tests rows against a Bloom filter of the wanted ones, so that other texts
    aren't shuffled."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                sets = [sketch(t or b"", n, 1)[2] for t in batch.column(1)[i : i + 500].to_pylist()]
                found = [np.frombuffer(s, dtype="<u4") for s in sets]
                whole, half = (pa.array([np.array(m, dtype=np.uint64).view(np.int64) for m in ms], pa.list_(pa.int64())) for ms in zip(*map(marks, found)))
                mark = pa.StructArray.from_arrays([pa.array([len(f) for f in found], pa.int32()), whole, half], names=["size", "marks", "half"])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 500], pa.array(sets, pa.binary()), mark], names=["cls", "shingles", "mark"])

    place = lambda at: F.xxhash64(f"{at}.file_path", f"{at}.row_index")
    rows = texts.select(place("at").alias("place"), "at", F.col("text").cast("binary").alias("text"))
    named = wanted.select("cls", F.col("at").alias("of"), place("at").alias("place_of"))
    same = (F.col("place") == F.col("place_of")) & (F.col("at.row_index") == F.col("of.row_index")) & (F.col("at.file_path") == F.col("of.file_path"))
    return rows.join(named, same).select("cls", "text").mapInArrow(run, "cls long, shingles binary, mark struct<size: int, marks: array<long>, half: array<long>>")


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """The pairs ``a, b`` whose shingle sets (``cls, shingles``) have that Jaccard
    similarity or more, and their number."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u4") for v in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    whole = pairs.join(one, "a").join(two, "b").select("a", "b", "a_set", "b_set")
    with common.conf(pairs.sparkSession, common.SMALL_BATCHES):
        kept, _, (some,) = common.counted(whole.mapInArrow(run, "a long, b long"), "similar-alike")
    return kept, some


def similar(texts: DataFrame, n: int = 5, similarity: float = 0.8, longs: int = 8, chance: float = 0.95, hot: int = 48) -> DataFrame:
    """``at, root`` of each row of ``texts(at, text)``: components of rows whose sets of
    ``n``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Sets of Jaccard similarity j have a cosine of about 2j / (1 + j) or more, and so
    differ in the angle's share of their ``64 * longs`` bits on average; what differs in
    up to three standard deviations more is a candidate, and the sets of
    candidates are compared, but for those whose marks tell that they are less similar.  Rows of one set are one class.  Each class is filed under seeded
    choices of blocks, of more bits the more classes there are, and under as many
    choices as let fingerprints of just that similarity meet with probability
    ``chance`` at any number of classes.  Under keys of up to ``hot`` classes all pairs are
    candidates; :func:`met_links` compares the classes of larger ones.  (Keys that very many
    near copies share are many, as the copies share most choices, and lie in different
    partitions of the one exchange by key, which streams.)

    ``at``: a struct with ``file_path`` and ``row_index`` that names a row.
    """
    spark = texts.sparkSession
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = int(64 * longs * share + 3 * math.sqrt(64 * longs * share * (1 - share)))
    fps = [f"f{i}" for i in range(longs)]
    slim = texts.select("at", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                found = [sketch(t or b"", n, longs)[:2] for t in batch.column(1)[i : i + 500].to_pylist()]
                words = np.array([(cls, *bits) for cls, bits in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 500], *(pa.array(c) for c in words.T.copy())], names=["at", "cls", *fps])

    schema = f"at {slim.schema['at'].dataType.simpleString()}, cls long, " + ", ".join(f"{f} long" for f in fps)
    with common.conf(spark, common.SMALL_BATCHES):
        rows, _ = common.written(slim.mapInArrow(run, schema), "similar-rows")
    first = F.min(F.struct("at.file_path", "at.row_index")).alias("at")
    classes, _ = common.written(rows.groupBy("cls").agg(*[F.min(f).alias(f) for f in fps], first), "similar-classes")
    bits = max(12, math.ceil(math.log2(max(2, classes.count()))) - 1)
    chosen = mask_choices(longs, bits, key_choices(share, longs, bits, 8, chance))
    masks = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(signed(m)).alias(f) for f, m in zip(fps, choice)]) for i, choice in enumerate(chosen)])
    filed = classes.select("cls", *fps, F.explode(masks).alias("mask"))
    keyed = filed.select(F.xxhash64("mask.i", *[F.col(f).bitwiseAND(F.col(f"mask.{f}")) for f in fps]).alias("key"), "cls", "f0")
    met, met_path = common.written(pairs_by_key(keyed, first_bound(most, longs), hot), "similar-met")
    near, _ = common.written(near_pairs(met.where("key IS NULL").select("a", "b"), classes, fps, most), "similar-near")
    rest, _ = common.written(met.where("key IS NOT NULL").select(F.col("a").alias("cls"), "key", F.col("b").alias("f0")), "similar-hot")
    common.delete(spark, met_path)
    named = near.select(F.col("a").alias("cls")).union(near.select("b")).union(rest.select("cls")).distinct()
    wanted, _ = common.written(named.join(classes, "cls").select("cls", "at"), "similar-wanted")
    with common.conf(spark, common.BLOOM_CONF | common.SMALL_BATCHES):
        sets, sets_path = common.written(shingle_sets(slim, wanted, n), "similar-sets")
    marked = sets.select("cls", "mark")
    alike = lambda some: alike_pairs(some, sets, similarity)
    roots = settled(possible(near, marked, similarity), None, alike)
    roots = met_links(classes, rest, fps, most, roots, alike, marked, similarity)
    found, _ = common.written(rooted(rows.select("at", "cls"), roots, {"cls": "root"}).select("at", "root"), "similar-found")
    common.delete(spark, sets_path)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, whole: of each group of
    :func:`similar` the row with the least identifier stays, nulls last (of equal
    ones the first in the files).  Null texts count as empty and are near each other;
    an empty table gives an empty result; columns may have any names."""
    rows = common.nested(docs, "similar-docs")
    ids = rows.select(F.struct("at.*", F.col(f"row.`{id_col}`").alias("id")).alias("at"), F.col(f"row.`{text_col}`").alias("text"))
    groups = similar(ids, **kw)
    first = F.min(F.struct(F.col("at.id").isNull(), F.col("at.id"), "at.file_path", "at.row_index")).alias("first")
    several = groups.groupBy("root").agg(F.count("*").alias("size"), first).where("size > 1").select("root", "first")
    gone = groups.join(several, "root").where(~((F.col("at.file_path") == F.col("first.file_path")) & (F.col("at.row_index") == F.col("first.row_index"))))
    gone, _ = common.written(gone.select(F.struct("at.file_path", "at.row_index").alias("gone")), "similar-gone")
    return rows.join(gone, F.col("at") == F.col("gone"), "left_anti").select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
