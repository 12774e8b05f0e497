"""Toxicity by class-conditional Kneser-Ney models of words.

For each class (toxic, ordinary) the probability of a word after another comes from
absolutely discounted continuation counts, at three orders that back off in turn:
in how many different left contexts the class has the two words (what fewer than
``CONTEXTS`` contexts have, as in copies and repeated passages, is discounted wholly), in how many
it has the word, and a spelling model, so that rare or new forms of a word are judged
by what they share with known ones.  The spelling model is a Kneser-Ney model of
characters over the class's distinct words, of order ``ORDER``, whose lowest orders
come from counts that both classes share, taken over the words of every document of
the corpus.

A toxic text is mostly ordinary words, so the toxic model gives each word the class's
probability with weight ``WEIGHT`` and the ordinary one's with the rest.  A text's
evidence is the difference of its two log-likelihoods, over all of its words and
divided by their number.  A logistic curve, set on labelled rows that the counts did
not see, maps this to 0..1.  The language, source and identifier of a document are
not inputs.

Sizes: all counts are made in partitions and summed by Spark, and the levels' shares
and left-over masses are computed there.  The class models are fitted on at most
about ``fit_rows`` labelled rows of each class (a documented bound, chosen by a hash of
the identifier), which bounds the levels; these, and the shared counts of at most
``CODES`` squared pairs, are broadcast.  Whole texts are read, in pieces.

Behaviour: null and empty texts have no evidence and get the curve's value at 0;
unlabelled tables score everything by the curve's default; conflicting labels of
one identifier count as toxic; null labels and identifiers are no labels (a null
identifier is not held out); repeated rows are scored alike; only identifier and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

ORDER, SHARED = 5, 2
#: Weight of the toxic class's own model within that of toxic texts.
WEIGHT = 0.003
#: Contexts that two words in a row must have in a class for its model to know them.
CONTEXTS = 3
CODES = 1024
WORD = re.compile(r"[^\W\d_]+")
#: Words that a task remembers, rows counted at once, words spelled at once, words scored at once.
_CACHE, _ROWS, _RATED, _SCORED = 250_000, 500, 10_000, 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def codes(words: list[str]) -> np.ndarray:
    """The words' characters, each word after ORDER - 1 zeros and before a one."""
    pad = "\0" * (ORDER - 1)
    x = np.frombuffer((pad + ("\1" + pad).join(words) + "\1").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return np.where(x < 768, x, 768 + x * np.uint64(2654435761) % np.uint64(CODES - 768))


def gram(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k characters up to each place."""
    out, power = np.zeros(len(x), dtype=np.uint64), 1
    for j in range(k):
        out[j:] += (x[: len(x) - j] + np.uint64(11)) * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
    return out


class Lookup:
    """Finds hashes among ``keys`` by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of those that want one slot, one gets it
            rest = self.table[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of ``x`` among the keys, and whether it is there."""
        slot = self._slot(x)
        at = self.table[slot]
        if not len(self.keys):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        known = (self.keys[at] == x) & (at >= 0)
        open_ = np.flatnonzero((at >= 0) & ~known)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = self.table[slot[open_]]
            known[open_] = (self.keys[at[open_]] == x[open_]) & (at[open_] >= 0)
            open_ = open_[(at[open_] >= 0) & ~known[open_]]
        return np.maximum(at, 0), known


class Level:
    """One order of a model: discounted shares of grams and left-over mass of contexts,
    of each of some models."""

    def __init__(self, grams: np.ndarray, shares: list[np.ndarray], contexts: np.ndarray, lefts: list[np.ndarray]):
        self.grams, self.share = Lookup(grams), [s.astype(np.float32) for s in shares]
        self.contexts, self.left = Lookup(contexts), [b.astype(np.float32) for b in lefts]

    def step(self, gram: np.ndarray, context: np.ndarray, lower: list[np.ndarray]) -> list[np.ndarray]:
        if not len(self.grams.keys):
            return lower
        g, known = self.grams.find(gram)
        c, seen = self.contexts.find(context)
        return [np.where(known, s[g], 0.0) + np.where(seen, b[c], 1.0) * p for s, b, p in zip(self.share, self.left, lower)]


def hashed(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two words in a row from those of each."""
    return (left + np.uint64(11)) * np.uint64(0x9E3779B97F4A7C15) + (right ^ (left >> np.uint64(31)))


class Model:
    """Probabilities of words in toxic and ordinary texts.

    levels: by name, ``(grams, shares, contexts, lefts)``: ``two`` (of words after a
    word), ``one`` (of words; its one context is 0) and ``spell3`` to ``spell5``.
    pairs: shared counts of two characters in a row, as rows of first, second, count.
    """

    def __init__(self, levels: dict[str, tuple], pairs: np.ndarray):
        self.curve, self.name, self.classes, self.sent = (4.0, 1.0), uuid.uuid4().hex, bool(levels), None
        if not self.classes:
            return
        a, b, n = pairs.T if len(pairs) else np.zeros((3, 0), dtype=np.int64)
        first, second = a.astype(np.uint64), b.astype(np.uint64)
        g1 = gram(second, 1)
        g2 = (second + np.uint64(11)) + (first + np.uint64(11)) * np.uint64(0x9E3779B97F4A7C15)
        u1, n1 = np.unique(g1, return_counts=True)
        self.spelling = [_shared_level(u1, np.zeros(len(u1), dtype=np.uint64), n1), _shared_level(g2, gram(first, 1), n)]
        self.spelling += [Level(*levels[f"spell{k}"]) for k in range(SHARED + 1, ORDER + 1)]
        self.one, self.two = Level(*levels["one"]), Level(*levels["two"])

    def __getstate__(self):
        return self.__dict__ | {"sent": None}

    def broadcast(self, spark: SparkSession):
        """The model for the tasks; it is sent once."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def words(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The words' hashes and their probabilities in either class, whatever stands before."""
        x = codes(words)
        at = np.flatnonzero(x > 0)
        before, p = gram(x, 0), [np.full(len(at), 1e-4)]
        for k, level in enumerate(self.spelling, 1):
            if k == SHARED + 1:
                p = [p[0], p[0]]
            now = gram(x, k)
            p = level.step(now[at], before[at - 1], p)
            before = now
        starts = np.concatenate([[0], np.flatnonzero(x[at] == 1)[:-1] + 1])
        spelled = [np.exp(np.maximum(-60.0, np.add.reduceat(np.log(q), starts))) for q in p]
        h = hashed(words)
        return h, self.one.step(h, np.zeros(len(h), dtype=np.uint64), spelled)

    def ratios(self, left: np.ndarray, right: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
        """log P(word | toxic text) - log P(word | ordinary text), each after its left word.

        left, right: hashes of words (0: nothing before); p: the right words' probabilities."""
        toxic, ordinary = self.two.step(paired(left, right), left, p)
        return np.log1p(WEIGHT * (toxic / ordinary - 1.0))

    def evidence(self, texts: list[str | None], memory: Memory) -> np.ndarray:
        """Of each text the difference of its log-likelihoods by word."""
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if not self.classes:
            return sums
        held, count = [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            for j in range(0, len(words), _SCORED):
                part = words[j : j + _SCORED]
                held.append((i, words[j - 1] if j else None, part))
                count += len(part)
                if count >= _SCORED:
                    self._add(held, memory, sums)
                    held, count = [], 0
        self._add(held, memory, sums)
        return sums / np.maximum(sizes, 1)

    def _add(self, held: list[tuple[int, str | None, list[str]]], memory: Memory, sums: np.ndarray) -> None:
        """Add what runs of words, with what stood before them, give to their texts' sums."""
        if not held:
            return
        at = memory.places(self, [w for _, before, part in held for w in ((before,) if before else ()) + tuple(part)])
        h = memory.hash[at]
        left = np.zeros(len(at), dtype=np.uint64)
        left[1:] = h[:-1]
        sizes = np.array([len(part) + bool(before) for _, before, part in held])
        starts = np.cumsum(sizes) - sizes
        left[starts] = 0
        ratio = self.ratios(left, h, [p[at] for p in memory.p])
        ratio[starts[np.array([bool(before) for _, before, _ in held])]] = 0.0
        np.add.at(sums, np.array([i for i, _, _ in held]), np.add.reduceat(ratio, starts))


class Memory:
    """What a task remembers of up to ``_CACHE`` different words."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.hash, self.p = np.zeros(0, dtype=np.uint64), [np.zeros(0), np.zeros(0)]

    def places(self, model: Model, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.place})
        if len(self.place) + len(new) > _CACHE:
            self.__init__()
            new = list(set(words))
        for i in range(0, len(new), _RATED):
            part = new[i : i + _RATED]
            h, p = model.words(part)
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            self.hash = np.concatenate([self.hash, h])
            self.p = [np.concatenate(x) for x in zip(self.p, p)]
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))


def _shared_level(grams: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> Level:
    """A level of one model from the counts of its grams."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    cut = min(0.9, max(0.3, one / (one + 2 * two))) if one else 0.5
    known, at = np.unique(contexts, return_inverse=True)
    total, kinds = np.bincount(at, counts, minlength=len(known)), np.bincount(at, minlength=len(known))
    return Level(grams, [(counts - cut) / total[at]], known, [cut * kinds / np.maximum(total, 1)])


def curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle: the middle where F1 is best, halfway to the next lower row;
    the slope such that rows around it are not cut off sharply."""
    if not toxic.any() or toxic.all():
        return 4.0, 1.0
    order = np.argsort(-evidence, kind="stable")
    x, y = evidence[order], toxic[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = 0
    best = int(f1.argmax())
    below = x[best + 1] if best + 1 < len(x) else 0.0
    middle = max((x[best] + below) / 2, 1e-3)
    return 4.0 / middle, float(middle)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _memory_of(model_name: str) -> Memory:
    return Memory()


def _counted(batches):
    """Of labelled rows for the fit the different (class, word before, left word, word),
    the first two as hashes; of all rows the shared counts of characters (class 2)."""
    shared = np.zeros(CODES * CODES, dtype=np.int64)
    for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
        tally: dict[str, int] = {}
        threes: tuple[set, set] = (set(), set())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for w in set(words):
                tally[w] = tally.get(w, 0) + 1
            if label is not None:
                threes[label].update(zip(["", "", *words], ["", *words], words))
        if tally:
            x, n = codes(list(tally)), np.fromiter(tally.values(), dtype=np.int64, count=len(tally))
            at = np.flatnonzero(x > 0)
            word = np.concatenate([[0], np.cumsum(x[at] == 1)[:-1]])
            np.add.at(shared, x[at - 1].astype(np.int64) * CODES + x[at].astype(np.int64), n[word])
        for label in (0, 1):
            rows = list(threes[label])
            for i in range(0, len(rows), _SCORED):
                first, second, word = zip(*rows[i : i + _SCORED])
                yield _rows(np.full(len(word), label), _signed(first), _signed(second), word, np.ones(len(word), dtype=np.int64))
    some = np.flatnonzero(shared)
    if len(some):
        yield _rows(np.full(len(some), 2), some // CODES, some % CODES, [None] * len(some), shared[some])


def _signed(words) -> np.ndarray:
    """Hashes of words as signed longs, 0 for none."""
    h = hashed(list(words))
    h[np.fromiter(map(len, words), dtype=np.int64, count=len(words)) == 0] = 0
    return h.view(np.int64)


def _rows(label, a, b, word, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["label", "a", "b", "word", "n"]
    )


_SPELLED = [*(f"g{k}" for k in range(SHARED + 1, ORDER + 1)), *(f"c{k}" for k in range(SHARED + 1, ORDER + 1))]


def _spelled(batches):
    """Of each class's words the grams of ``SHARED + 1`` to ``ORDER`` characters that
    end at each place, and the context of each."""
    for batch in batches:
        labels, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for i in range(0, len(words), _RATED):
            x = codes(words[i : i + _RATED])
            at = np.flatnonzero(x > 0)
            word = np.concatenate([[0], np.cumsum(x[at] == 1)[:-1]])
            grams = {k: gram(x, k) for k in range(SHARED, ORDER + 1)}
            columns = [grams[k][at] for k in range(SHARED + 1, ORDER + 1)] + [grams[k - 1][at - 1] for k in range(SHARED + 1, ORDER + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[i : i + _RATED][word], pa.int32()), *(pa.array(c.view(np.int64)) for c in columns)], names=["label", *_SPELLED])


def _paired_words(batches):
    """The hash of each word, and of it after the word ``b``."""
    for batch in batches:
        h = hashed(batch.column(2).to_pylist())
        left = batch.column(1).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(h.view(np.int64)), pa.array(paired(left, h).view(np.int64))], names=["label", "b", "word", "n", "h", "pair"])


def leveled(counts: DataFrame, least: int = 1) -> tuple:
    """A level of both classes from ``label, gram, context, n``: grams and contexts as
    arrays, with the toxic and the ordinary class's shares and left-over masses.

    Kneser-Ney's discount is estimated from the numbers of ones and twos of each class;
    counts under ``least`` are discounted wholly, and as much is taken from the others."""
    ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    rate = F.least(F.lit(0.9), F.greatest(F.lit(0.3), ones / (ones + 2 * twos)))
    cut = F.broadcast(counts.groupBy("label").agg(F.when(ones > 0, rate).otherwise(0.5).alias("cut")))
    rows = counts.join(cut, "label").withColumn("off", F.least(F.col("n"), F.col("cut") + (least - 1)))
    sums = rows.groupBy("label", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
    toxic = lambda c: F.coalesce(F.sum(F.when(F.col("label") == 1, c)), F.lit(0.0))
    ordinary = lambda c, none: F.coalesce(F.sum(F.when(F.col("label") == 0, c)), F.lit(none))
    share = (F.col("n") - F.col("off")) / F.col("total")
    shares = rows.where(F.col("n") >= least).join(sums, ["label", "context"]).groupBy("gram").agg(toxic(share).alias("toxic"), ordinary(share, 0.0).alias("ordinary"))
    sums = sums.where("mass < total")  # what leaves all its mass backs off as unknown contexts do
    left = F.col("mass") / F.col("total")
    lefts = sums.groupBy("context").agg(F.coalesce(F.sum(F.when(F.col("label") == 1, left)), F.lit(1.0)).alias("toxic"), ordinary(left, 1.0).alias("ordinary"))
    out = []
    for frame, key in ((shares, "gram"), (lefts, "context")):
        got = frame.select(F.col(key), F.col("toxic").cast("float"), F.col("ordinary").cast("float")).toArrow()
        keys, t, o = (c.to_numpy() for c in got.columns)
        out += [keys.view(np.uint64), [t, o]]
    return tuple(out)


def levels(counted: DataFrame) -> dict[str, tuple]:
    """The levels of both classes from :func:`_counted`'s rows; none if a class has no words."""
    spark = counted.sparkSession
    kind = "label int, b long, word string, n long, h long, pair long"
    # in how many different contexts a class has two words in a row, and a word
    threes = counted.where("label < 2").select("label", "a", "b", "word").distinct()
    twos = threes.groupBy("label", "b", "word").agg(F.count("*").alias("n")).mapInArrow(_paired_words, kind)
    twos, twos_path = common.written(twos, "toxicity-twos")
    ones, ones_path = common.written(twos.groupBy("label", "word", "h").agg(F.count("*").alias("n")), "toxicity-ones")
    if {r.label for r in ones.select("label").distinct().collect()} != {0, 1}:
        return {}
    found = {
        "two": leveled(twos.select("label", F.col("pair").alias("gram"), F.col("b").alias("context"), "n"), CONTEXTS),
        "one": leveled(ones.select("label", F.col("h").alias("gram"), F.lit(0).cast("long").alias("context"), "n")),
    }
    spelled = ones.select("label", "word").mapInArrow(_spelled, "label int, " + ", ".join(f"{c} long" for c in _SPELLED)).withColumn("n", F.lit(1).cast("long"))
    path = None
    for k in range(ORDER, SHARED, -1):
        # of the longest grams, how many words have them; of others, how many longer ones end in them
        count = F.sum("n") if k == ORDER else F.count("*")
        rest = [c for c in _SPELLED if int(c[1:]) < k]
        rows = spelled.groupBy("label", f"g{k}").agg(count.alias("n"), F.min(f"c{k}").alias(f"c{k}"), *[F.min(c).alias(c) for c in rest])
        spelled, new_path = common.written(rows, "toxicity-spelled")
        if path:
            common.delete(spark, path)
        path = new_path
        found[f"spell{k}"] = leveled(spelled.select("label", F.col(f"g{k}").alias("gram"), F.col(f"c{k}").alias("context"), "n"))
    for p in (path, twos_path, ones_path):
        common.delete(spark, p)
    return found


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``docs``' texts under ``labels``; held-out identifiers are not used."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    usable = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    usable, path = common.written(usable, "toxicity-labels")
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda label: int(min(1.0, fit_rows / max(1, sizes.get(label, 0))) * (1 << 20))
    lot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20))
    sample = usable.where(lot < F.when(F.col("label") == 1, share(1)).otherwise(share(0))).withColumn("check", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0)
    sample = F.broadcast(sample)
    counted = (
        slim.join(sample, "id", "left")
        .select("text", F.when(~F.col("check"), F.col("label")).alias("label"))
        .mapInArrow(_counted, "label int, a long, b long, word string, n long")
    )
    with common.conf(spark, common.SMALL_BATCHES):
        counted, counted_path = common.written(counted, "toxicity-counts")
    pairs = counted.where("label = 2").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy("a", "b").toArrow()
    model = Model(levels(counted), np.stack([c.to_numpy().astype(np.int64) for c in pairs.columns], axis=1))
    common.delete(spark, counted_path)
    if model.classes:
        seen = slim.join(sample.where("check"), "id").select("text", "label")
        checked = seen.mapInArrow(_evidence(spark, model, pa.int32()), "key int, evidence double").toArrow()
        model.curve = curve(checked.column(1).to_numpy(), checked.column(0).to_numpy() == 1)
    common.delete(spark, path)
    return model


def _evidence(spark: SparkSession, model: Model, key_type: pa.DataType):
    sent = model.broadcast(spark)

    def run(batches):
        memory = _memory_of(sent.value.name)
        for batch in batches:
            text, key = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, _ROWS):
                found = sent.value.evidence(text[i : i + _ROWS].to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([key[i : i + _ROWS], pa.array(found)], names=["key", "evidence"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of each row."""
    kind = docs.schema[id_col].dataType
    run = _evidence(docs.sparkSession, model, to_arrow_type(kind))
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("key"))
    slope, middle = model.curve
    found = rows.mapInArrow(run, f"key {kind.simpleString()}, evidence double")
    return found.select(F.col("key").alias("id"), (1 / (1 + F.exp(F.lit(-slope) * (F.col("evidence") - middle)))).alias("score"))


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, whole, in one pass, written to the shared
    folder.  Rows travel as one struct, so columns may have any names, dots included, and
    in small batches, as tasks hold them on both sides of Python and of the filter."""
    sent, (slope, middle) = model.broadcast(docs.sparkSession), model.curve
    at = docs.columns.index(text_col)

    def run(batches):
        memory = _memory_of(sent.value.name)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                evidence = sent.value.evidence(part.column(0).field(at).to_pylist(), memory)
                yield part.filter(pa.array(1.0 / (1.0 + np.exp(np.clip(-slope * (evidence - middle), -60, 60))) < 0.5))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with common.conf(docs.sparkSession, common.SMALL_BATCHES):
        return common.written(rows.mapInArrow(run, rows.schema).select("row.*"), "toxicity-kept")[0]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
