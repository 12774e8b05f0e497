"""Exact top-k search by BM25: inverted index by shards, block-max WAND.

Terms are runs of anything but ASCII characters other than letters and digits,
with A-Z lower-cased; a query is the set of its text's terms.  Global statistics
(documents, mean length, documents of each term of a query) come first, so each
shard scores as the whole collection would.

A shard holds a bounded number of documents as an inverted index.  Documents of the
same terms are one entry; entries are ordered by likeness (clusters of their frequent
terms, then length), so that aligned blocks of ``BLOCK`` entries hold like ones, and
each term has the largest impact in each of its blocks.

Queries are answered in batches.  The postings of a query's rare terms are all added
up; a block's scores are bounded by the best of these sums in it plus the frequent
terms' block maxima, for a batch a product of matrices.  The block of the best bound
gives each query a first threshold, the k-th score found.  Then the index is walked in
order: the pivot of a query is the next block whose bound reaches its threshold,
blocks before it are skipped, and thresholds rise with what pivots give.  The blocks at
pivots are scored for the queries that stop there, again by products of matrices in
single precision; all that comes within their rounding errors (bounded by the number
of terms) of the k-th score is scored once more in double precision, so no document of
the top k is missed.  Shards' answers are merged.

Shards and groups of queries, both of bounded size, are a row each in the shared folder.
Their pairs are a Cartesian product, which reads both where they lie: neither is copied for
the other, so what is written grows with the documents only.  A task holds one shard's
index and answers block after block of a group's queries.  Shards are asked in rounds, and
what the earlier ones found is the least that the later ones' answers must reach.  Terms
travel as 64-bit hashes (XXH64), once for each block of documents or queries.

Scores are rounded to six decimals; equal ones rank by the smaller identifier.

Behaviour: null texts are empty, match nothing and, as queries, have no answers;
only documents that share a term with the query are answers, the query's own row
among them; repeated rows and identifiers are rows of their own; identifiers are whole
numbers (other types are an error); rows with a null identifier can be found but ask
nothing; an empty table gives an empty result; only identifier and text are read,
whatever other columns are called.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common

K1, B = 1.2, 0.75
#: Entries of a block, and of a chunk of blocks that is scored at once.
BLOCK, CHUNK = 32, 128
#: Documents and queries that travel as one block; terms that a task counts before it hands them on.
_DOCS, _TERMS = 256, 400_000
#: A-Z lower-cased, and a space for each byte that no term has.
_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b > 0x7F else 0x20 for b in range(256))
_QUERIES = 2000
#: A shard or a group of queries is a row of some MB: a task for each.
_LARGE_ROWS = {"spark.sql.files.maxPartitionBytes": "16m"}


def _pack(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unpack(x: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text, in order."""
    return text.translate(_BYTES).split()


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    return np.arange(len(owner), dtype=np.int32) + np.repeat((starts - np.cumsum(sizes) + sizes).astype(np.int32), sizes), owner


class Index:
    """Inverted index of one shard's documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, owner: np.ndarray, mean: float, known: np.ndarray | None = None):
        """ids, lengths: of documents; terms, counts, owner: of postings; known: the different terms in order, if ``terms`` are places among them."""
        if known is None:
            known, terms = np.unique(terms, return_inverse=True)
        if (owner[1:] < owner[:-1]).any():
            by = np.argsort(owner, kind="stable")
            terms, counts, owner = terms[by], counts[by], owner[by]
        n, self.terms, term = len(ids), known, terms.astype(np.int32)
        df = np.bincount(term, minlength=len(known))
        often = np.flatnonzero(df > n // 48)
        self.frequent = np.full(len(known), -1, dtype=np.int32)
        self.frequent[often] = np.arange(len(often))
        sizes = np.bincount(owner, minlength=n)
        starts = np.cumsum(sizes) - sizes
        self.order = _by_likeness(term, owner, lengths, df)
        self.ids = ids[self.order]
        # postings by entry
        at = spread(starts[self.order], (starts + sizes)[self.order])[0].astype(np.int32)
        sizes = sizes[self.order]
        self.entry_start = np.concatenate([[0], np.cumsum(sizes)])
        self.entry_term, self.entry_count = term[at], _small(counts[at])
        self.norm = K1 * (1 - B + B * lengths[self.order] / mean)
        del at, term
        entry = np.repeat(np.arange(n, dtype=np.int32), sizes)
        place = self.frequent[self.entry_term]
        # postings of rare terms by term; frequent ones as block maxima and dense chunks
        rare = np.flatnonzero(place < 0).astype(np.int32)
        rare = rare[np.argsort(self.entry_term[rare], kind="stable")]
        self.entry, self.impact = entry[rare], self._impact(rare, entry[rare]).astype(np.float32)
        del rare
        self.first = np.concatenate([[0], np.cumsum(np.where(self.frequent < 0, df, 0))])
        self.size = -(-n // CHUNK) * CHUNK
        self.most = np.zeros((len(often), self.size // BLOCK), dtype=np.float32)
        self.chunks = []
        for c in range(self.size // CHUNK):
            a, b = self.entry_start[c * CHUNK], self.entry_start[min(n, (c + 1) * CHUNK)]
            some = a + np.flatnonzero(place[a:b] >= 0)
            rows, at = np.unique(place[some], return_inverse=True)
            dense = np.zeros((len(rows), CHUNK), dtype=np.float32)
            dense[at, entry[some] % CHUNK] = self._impact(some, entry[some])
            self.chunks.append((rows, dense))
            self.most[rows, c * (CHUNK // BLOCK) : (c + 1) * (CHUNK // BLOCK)] = dense.reshape(len(rows), -1, BLOCK).max(axis=2)
        self.weights = np.zeros(len(known))

    def _impact(self, postings: np.ndarray, entry: np.ndarray) -> np.ndarray:
        tf = self.entry_count[postings].astype(np.float64)
        return tf * (K1 + 1) / (tf + self.norm[entry])

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their numbers) of the k best scores, ties by identifier."""
        return self.answers(np.zeros(len(terms), dtype=np.int64), terms, weights, 1, k)[0]

    def answers(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, count: int, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """As :meth:`top` for each of ``count`` queries; query: of each term (ascending);
        floor: a score that each query's answers must reach."""
        floor = np.zeros(count) if floor is None else floor
        none = (np.zeros(0, dtype=np.int64), np.zeros(0))
        if not len(self.terms) or not len(terms):
            return [none] * count
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        ok = self.terms[at] == terms
        query, at, weights = query[ok], at[ok], weights[ok]
        place = self.frequent[at]
        often = place >= 0
        rare, owner = spread(self.first[at[~often]], self.first[at[~often] + 1])
        cells = (query[~often] * self.size).astype(np.int32)[owner] + self.entry[rare]
        values = self.impact[rare] * weights[~often].astype(np.float32)[owner]
        partial = np.bincount(cells, values, minlength=count * self.size).astype(np.float32).reshape(count, self.size)
        dense = np.zeros((count, len(self.most)), dtype=np.float32)
        dense[query[often], place[often]] = weights[often]
        bound = dense @ self.most
        bound += partial.reshape(count, -1, BLOCK).max(axis=2)
        # what sums in single precision may be off by, twice, and what rounding to six decimals may add
        slack = 4e-6 + 2.5e-7 * (np.bincount(query, minlength=count) + 8) * bound.max(axis=1)
        found = self._candidates(dense, partial, bound, slack, k, floor)
        starts = np.searchsorted(query, np.arange(count + 1))
        return [self._exact(at[a:b], weights[a:b], some, k, low) if len(some) else none for a, b, some, low in zip(starts, starts[1:], found, floor)]

    def _candidates(self, dense: np.ndarray, partial: np.ndarray, bound: np.ndarray, slack: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
        """Of each query the entries whose scores reach the k-th and the floor within the slack."""
        count, weights = len(dense), np.ascontiguousarray(dense.T)
        best = np.zeros((count, k), dtype=np.float32)  # the k best scores so far
        least = floor.copy()  # what scores must reach
        per = CHUNK // BLOCK
        reach = bound.reshape(count, -1, per).max(axis=2)
        entries: list[tuple] = []

        def score(c: int, some: np.ndarray) -> None:
            rows, impacts = self.chunks[c]
            # rows of terms are copied whole, which is quicker than picking single cells
            mine = weights[rows]
            got = (mine if len(some) == count else mine.take(some, axis=1)).T @ impacts
            got += partial[some, c * CHUNK : (c + 1) * CHUNK]
            hit = got.max(axis=1) >= least[some] - slack[some]
            if not hit.any():
                return
            some, got = some[hit], got[hit]
            most = np.concatenate([best[some], got], axis=1)
            best[some] = np.partition(most, most.shape[1] - k, axis=1)[:, -k:]
            least[some] = np.maximum(floor[some], best[some].min(axis=1))
            q, e = np.nonzero((got > 0) & (got >= (least[some] - slack[some])[:, None]))
            entries.append((some[q], e + c * CHUNK, got[q, e]))

        start = reach.argmax(axis=1)
        asks = (reach[np.arange(count), start] > 0) & (reach[np.arange(count), start] >= floor - slack)
        for c in np.unique(start[asks]).tolist():
            score(c, np.flatnonzero(asks & (start == c)))
        for c in range(len(self.chunks)):
            # pivots: blocks of this chunk whose bounds reach the thresholds
            some = np.flatnonzero(asks & (start != c) & (reach[:, c] > 0) & (reach[:, c] >= least - slack))
            if len(some):
                score(c, some)
        query, entry, got = (np.concatenate(x) for x in zip(*entries)) if entries else (np.zeros(0, dtype=np.int64),) * 3
        keep = got >= (least - slack)[query]
        query, entry = query[keep], entry[keep]
        by = np.argsort(query, kind="stable")
        return np.split(entry[by], np.searchsorted(query[by], np.arange(1, count)))

    def _exact(self, at: np.ndarray, weights: np.ndarray, some: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        self.weights[at] = weights
        postings, owner = spread(self.entry_start[some], self.entry_start[some + 1])
        weight = self.weights[self.entry_term[postings]]
        mine = np.flatnonzero(weight)  # postings of the query's terms
        postings, owner = postings[mine], owner[mine]
        score = np.round(np.bincount(owner, weight[mine] * self._impact(postings, some[owner]), minlength=len(some)), 6)
        self.weights[at] = 0.0
        best = np.lexsort((self.ids[some], -score))[:k]
        best = best[score[best] >= floor - 1e-9]
        return self.order[some[best]], score[best]


def _by_likeness(term: np.ndarray, owner: np.ndarray, lengths: np.ndarray, df: np.ndarray, clusters: int = 16, terms: int = 256) -> np.ndarray:
    """An order of documents: clusters of those that have like ones of the most frequent
    terms, in these by length.  What is found doesn't depend on it."""
    n, cluster = len(lengths), np.zeros(len(lengths), dtype=np.int64)
    if n > 4 * BLOCK:
        column = np.full(len(df), -1, dtype=np.int32)
        most = np.argsort(-df, kind="stable")[:terms]
        column[most] = np.arange(len(most))
        at = np.flatnonzero(column[term] >= 0)
        rows = np.zeros((n, len(most)), dtype=np.float32)
        rows[owner[at], column[term[at]]] = 1.0
        rows /= np.maximum(np.sqrt(rows.sum(axis=1, keepdims=True)), 1.0)
        centers = rows[np.random.default_rng(5).choice(n, min(n, clusters), replace=False)]
        for _ in range(5):
            cluster = (rows @ centers.T).argmax(axis=1)
            centers = np.stack([rows[cluster == c].sum(axis=0) for c in range(len(centers))])
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.arange(n), lengths, cluster))


class Shard:
    """The index of a shard's blocks of documents, those of the same terms as one entry."""

    def __init__(self, blocks: list[tuple], mean: float):
        keys = [x for b in blocks for x in b[0]]
        sizes, lengths = (np.concatenate([b[i].astype(np.int64) for b in blocks]) for i in (1, 2))
        known = np.unique(np.concatenate([b[3] for b in blocks]))
        terms = np.concatenate([np.searchsorted(known, b[3]).astype(np.int32)[b[4]] for b in blocks])
        counts = np.concatenate([b[5].astype(np.int32) for b in blocks])
        blocks.clear()
        ends = np.cumsum(sizes)
        seen: dict[bytes, int] = {}
        self.keys: list[list] = []
        first = []
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            entry = seen.setdefault(terms[a:b].tobytes() + counts[a:b].tobytes(), len(seen))
            if entry == len(self.keys):
                self.keys.append([])
                first.append(i)
            self.keys[entry].append(keys[i])
        del seen
        for same in self.keys:
            same.sort(key=lambda x: (x is None, x or 0))
        first = np.array(first, dtype=np.int64)
        at, owner = (x.astype(np.int32) for x in spread((ends - sizes)[first], ends[first]))
        ids = np.array([np.iinfo(np.int64).max if x[0] is None else x[0] for x in self.keys], dtype=np.int64)
        self.index = Index(ids, lengths[first], terms[at], counts[at], owner, mean, known)

    def answers(self, block: tuple, k: int, docs: int, floors: dict, size: int):
        """``query, id, score`` of the k best documents of each query of a block, as far as
        they reach the query's floor; docs: of all shards; size: queries answered at once."""
        keys, sizes, terms, df, steps = block
        df = df.astype(np.float64)
        weights = np.log((docs - df + 0.5) / (df + 0.5) + 1)
        ends = np.cumsum(sizes)
        at = np.cumsum(steps, dtype=np.int64)  # of each query the first step counts from 0
        at -= np.repeat(np.concatenate([[0], at[ends[:-1] - 1]]), sizes)
        for i in range(0, len(keys), size):
            mine = keys[i : i + size]
            some = at[ends[i] - sizes[i] : ends[min(i + size, len(keys)) - 1]]
            query = np.repeat(np.arange(len(mine)), sizes[i : i + size])
            floor = np.array([floors.get(key, 0.0) for key in mine])
            for key, (best, scores) in zip(mine, self.index.answers(query, terms[some], weights[some], len(mine), k, floor)):
                left = k
                # entries of one score rank by identifier, so all of them are asked before any is cut
                for score, same in groupby(zip(scores.tolist(), best.tolist()), key=lambda x: x[0]):
                    ids = sorted((x for _, e in same for x in self.keys[e][:k]), key=lambda x: (x is None, x or 0))[:left]
                    yield from ((key, x, score) for x in ids)
                    left -= len(ids)
                    if not left:
                        break


def _read(shards: int, size: int):
    """Of texts: blocks of documents, dealt to the shards (kind 3), the documents of each
    term (2), the number of documents (0) and of their terms (1)."""
    names = ["kind", "shard", "block", "term", "n"]

    def tally(kind, terms, n):
        size = len(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), terms, pa.array(n, pa.int64())], names=names)

    def summed(held):
        terms, n = (np.concatenate(x) for x in zip(*held))
        terms, at = np.unique(terms, return_inverse=True)
        return terms, np.bincount(at, n, minlength=len(terms)).astype(np.int64)

    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        at = xxh64_intdigest(str(TaskContext.get().partitionId()))
        held, waiting, docs, length = [], 0, 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                keys, texts, asks = (batch.column(c)[i : i + size].to_pylist() for c in range(3))
                vocabulary: dict[bytes, int] = {}
                sizes, lengths, terms, counts = [], [], [], []
                for text in texts:
                    found = Counter(terms_of(text or b""))
                    mine = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), dtype=np.int64, count=len(found))
                    n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                    by = np.argsort(mine)
                    sizes.append(len(found))
                    lengths.append(int(n.sum()))
                    terms.append(mine[by])
                    counts.append(n[by])
                hashes = np.fromiter(map(xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
                # in the order of hashes, so that the same terms look the same in all blocks
                rank = np.argsort(np.argsort(hashes))
                sizes = np.array(sizes, dtype=np.int64)
                terms, counts = rank[np.concatenate(terms)], np.concatenate(counts)
                by = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
                terms, counts, hashes = terms[by], counts[by], np.sort(hashes)
                block = (keys, _small(sizes), _small(np.array(lengths)), hashes, _small(terms), _small(counts), np.array(asks, dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([at % shards], pa.int32()), pa.array([_pack(block)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
                at, docs, length = at + 1, docs + len(keys), length + sum(lengths)
                held.append((hashes, np.bincount(terms, minlength=len(hashes))))
                waiting += len(hashes)
                if waiting > _TERMS:
                    terms, n = summed(held)
                    held, waiting = [(terms, n)], len(terms)
                    if waiting > _TERMS // 2:
                        yield tally(2, pa.array(terms.view(np.int64)), n)
                        held, waiting = [], 0
        if held:
            terms, n = summed(held)
            yield tally(2, pa.array(terms.view(np.int64)), n)
        for kind, n in ((0, docs), (1, length)):
            yield tally(kind, pa.nulls(1, pa.int64()), [n])

    return run


def _query_terms(batches):
    """Of blocks of documents the terms of those that ask."""
    for batch in batches:
        for packed in batch.column(0):
            keys, sizes, _, hashes, terms, _, asks = _unpack(packed.as_py())
            mine = asks & np.array([x is not None for x in keys], dtype=bool)
            some = np.repeat(mine, sizes)
            ids = np.repeat(np.array([x or 0 for x in keys], dtype=np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(hashes[terms[some]].view(np.int64))], names=["query", "term"])


def _packed_queries(size: int):
    """Rows of one part sorted by query, with the documents of each term, to blocks of ``size`` queries."""

    def pack(part, keys, sizes, terms, df):
        sizes = np.array(sizes)
        terms, first, at = np.unique(np.array(terms, dtype=np.int64).view(np.uint64), return_index=True, return_inverse=True)
        at = at[np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))]
        steps = np.diff(at, prepend=0)
        starts = np.cumsum(sizes) - sizes
        steps[starts] = at[starts]
        block = _pack((keys, sizes, terms, _small(np.array(df)[first]), _small(steps)))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

    def run(batches):
        part, keys, sizes, terms, df = None, [], [], [], []
        for batch in batches:
            for p, q, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not keys or q != keys[-1] or p != part:
                    if len(keys) == size or (keys and p != part):
                        yield pack(part, keys, sizes, terms, df)
                        keys, sizes, terms, df = [], [], [], []
                    part = p
                    keys.append(q)
                    sizes.append(0)
                sizes[-1] += 1
                terms.append(t)
                df.append(n)
        if keys:
            yield pack(part, keys, sizes, terms, df)

    return run


def _answered(k: int, mean: float, count: int, size: int):
    """The answers of shards to groups of queries; a shard's rows come one after another."""

    def run(batches):
        here, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != here:
                    here, shard = batch.column(0)[i].as_py(), None
                    shard = Shard([_unpack(x.as_buffer()) for x in batch.column(1)[i].values], mean)
                floors = dict(zip(*((batch.column(c)[i].as_py() or []) for c in (3, 4))))
                for block in batch.column(2)[i].values:
                    found = list(shard.answers(_unpack(block.as_buffer()), k, count, floors, size))
                    for j in range(0, len(found), 50_000):
                        columns = zip(*found[j : j + 50_000])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "id", "score"])

    return run


def _filed(df: DataFrame, key: str, tag: str) -> tuple[DataFrame, str]:
    """``df`` in a folder for each ``key``, so that a row, some MB long, is a file."""
    path = common.new_path(df.sparkSession, tag)
    df.write.partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _cells(shards: DataFrame, groups: DataFrame) -> DataFrame:
    """Each of ``shards(shard, docs)`` with each of ``groups(group, queries, asked, floors)``,
    without a shuffle of either."""
    pairs = shards.hint("shuffle_replicate_nl").crossJoin(groups)
    return pairs.select("shard", "docs", "queries", "asked", "floors")


def search(docs: DataFrame, asks: Column, k: int = 10, shard_docs: int = 8_192, block: int = 200, group_queries: int = 20_000, first: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query, rank, id, score``: for each row that ``asks`` holds for, the ``k`` best
    of all rows.  A task answers up to about ``group_queries`` queries, ``block`` at a
    time, from a shard of about ``shard_docs`` documents.

    Shards are asked in rounds, ``first`` in the first and three times as many as before
    in each later one; the k-th best score of the rounds before is the floor that a query's
    answers must reach, so later shards skip most of their blocks and answer little."""
    spark, ident, text = docs.sparkSession, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    if not isinstance(docs.select(ident).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} isn't a whole number")
    slim = docs.select(ident.cast("long").alias("id"), text.cast("binary").alias("text"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows, asking = slim.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, groups = max(1, -(-rows // shard_docs)), max(1, -(-asking // group_queries))
    with common.conf(spark, common.SMALL_BATCHES):
        read, read_path = common.written(slim.mapInArrow(_read(shards, min(_DOCS, shard_docs)), "kind int, shard int, block binary, term long, n long"), "bm25-read")
    sums = {r.kind: r.n for r in read.where("kind < 2").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    count, mean = sums.get(0) or 0, max(1, sums.get(1) or 0) / max(1, sums.get(0) or 0)
    of_term = read.where("kind = 2").groupBy("term").agg(F.sum("n").alias("df"))
    held = read.where("kind = 3").select("shard", "block")
    wanted = held.select("block").mapInArrow(_query_terms, "query long, term long").distinct()
    # queries travel in few large blocks, whose terms are sent once; several blocks are a group
    parts = max(1, -(-group_queries // _QUERIES))
    group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    part = (group * parts + F.pmod(F.xxhash64(F.lit(1), "query"), F.lit(parts))).cast("int").alias("part")
    weighed = wanted.join(of_term, "term").select(part, "query", "term", "df")
    blocks = weighed.repartitionById(groups * parts, "part").sortWithinPartitions("part", "query").mapInArrow(_packed_queries(_QUERIES), "part int, block binary")
    blocks = blocks.groupBy(F.floor(F.col("part") / parts).cast("int").alias("group")).agg(F.collect_list("block").alias("queries"))
    blocks, _ = common.written(blocks, "bm25-queries")
    dealt, _ = _filed(held.repartition(shards, "shard").groupBy("shard").agg(F.collect_list("block").alias("docs")), "shard", "bm25-shards")
    common.delete(spark, read_path)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    floors = spark.createDataFrame([], "group int, asked array<bigint>, floors array<double>")
    best, best_path, done, size = None, None, 0, first
    while done < shards:
        upto = min(shards, done + size)
        if best is not None:
            least = best.groupBy(group.alias("group"), "query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            floors = least.groupBy("group").agg(F.collect_list(F.struct("query", "floor")).alias("x")).select("group", F.col("x.query").alias("asked"), F.col("x.floor").alias("floors"))
        asked, asked_path = _filed(blocks.join(floors, "group", "left"), "group", "bm25-asked")
        with common.conf(spark, common.SMALL_BATCHES | _LARGE_ROWS):
            cells = _cells(dealt.where(F.col("shard").between(done, upto - 1)), asked)
            found, found_path = common.written(cells.mapInArrow(_answered(k, mean, count, block), "query long, id long, score double"), "bm25-found")
        common.delete(spark, asked_path)
        both = found if best is None else best.unionByName(found)
        best, new_path = common.written(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score"), "bm25-best")
        for path in (found_path, best_path):
            if path:
                common.delete(spark, path)
        best_path, done, size = new_path, upto, 3 * upto
        if done < shards:
            best = best.drop("rank")
    return best


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whose id is divisible by 20, its ten best among all."""
    return search(common.table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0).withColumnsRenamed({"query": "query_id", "id": "doc_id"})


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row_no, doc_id, len(w) AS dl, unnest(w) AS term FROM d),
p AS (SELECT row_no, doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT count(*) AS n, greatest(1, sum(len(w))) / count(*) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM p WHERE doc_id % 20 = 0),
scored AS (SELECT query_id, row_no, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / mean))), 6) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY query_id, row_no, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
