"""HTML extraction by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements,
with the elements around them (end tags that HTML lets a page leave out are
supplied).  Each block has features: its ancestors' tags and the words of their
classes, ids and roles, and its text's length, punctuation and share of links.  A
chain of two labels, main text or not, runs over a page's blocks; its weights are
fitted by maximum likelihood on labelled pages and decoded by Viterbi's algorithm.
Main blocks are joined in page order.

Character references are decoded, white space in a block becomes one space, inline
tags don't divide words, line breaks do.  Scripts, styles and the like hold no
text.

Behaviour: a null or empty page has the empty text; a page without tags is one
block; damaged markup is read as far as it goes; repeated rows are rows of their
own; an empty table gives an empty result; only identifier, url and html are
read, whatever other columns are called.  Pages are read whole, one at a time.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pages

#: Kinds of elements in HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea iframe svg math canvas object audio video noframes noembed xmp".split())
#: Of these, the elements whose content is no markup: without an end tag they last to the page's end.
RAW = frozenset("script style textarea iframe noframes noembed xmp".split())
#: An element's start tag ends these open ones, up to the second list.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
NOT_IN_P = BLOCKS - {"button", "label", "option", "optgroup", "select", "legend"}
TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|(?P<name>/?[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)|[!?/][^>]*+>?)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LENGTHS = (1, 2, 4, 8, 16, 32, 64)


class Block:
    __slots__ = ("text", "around", "own")

    def __init__(self, text: str, around: frozenset, own: tuple):
        self.text, self.around, self.own = text, around, own


def _bucket(n: int) -> int:
    return sum(n > x for x in _LENGTHS)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    said: list[str] = []
    links = letters = anchors = 0

    def flush() -> None:
        nonlocal links, letters
        text = " ".join("".join(said).split())
        said.clear()
        if text:
            n = text.count(" ") + 1
            share = links / max(1, letters)
            near = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
            stops = sum(map(text.count, ".,;!?"))
            own = (f"own:{near}", f"words:{_bucket(n)}", f"links:{round(share * 3)}", f"stops:{min(3, 12 * stops // n)}", "sentence" if text[-1] in ".!?…" else "open", "sign" if "©" in text[:20] else "plain")
            out.append(Block(text, stack[-1][1], own))
        links = letters = 0

    def add(raw: str) -> None:
        nonlocal links, letters
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            said.append(text)
            letters += len(text)
            if anchors:
                links += len(text)

    def pop(to: int) -> None:
        nonlocal anchors
        anchors -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    at, unended = 0, set()
    while (m := TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name[0] == "/":
            name = name[1:]
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name in BLOCKS:
                flush()
                if place:
                    pop(place)
            elif place:
                if any(t in BLOCKS for t, _ in stack[place:]):
                    anchors -= name == "a"
                    del stack[place]  # it stays open for nothing, the blocks in it do
                else:
                    pop(place)
            continue
        attrs = m["attrs"]
        if name in SILENT:
            if name in unended or name in ("svg", "math") and attrs.endswith("/>"):
                continue
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in RAW:
                at = len(page)
            else:
                unended.add(name)  # only the tag is skipped
            continue
        if name in BLOCKS:
            flush()
            if name in NOT_IN_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name in ENDS:
                ended, limit = ENDS[name]
                cut = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in limit:
                        break
                    if stack[i][0] in ended:
                        cut = i
                if cut:
                    pop(cut)
        elif name == "br":
            said.append(" ")
        if name in VOID or attrs.endswith("/>") and name not in BLOCKS:
            continue
        around = stack[-1][1]
        new = {f"in:{name}"}
        for kind, *values in NAMED.findall(attrs):
            for part in PARTS.findall("".join(values)):
                new.add(f"name:{part.lower()}")
        stack.append((name, around if new <= around else around | new))
        anchors += name == "a"
    add(page[at:])
    flush()
    return out


class Model:
    """Weights of features for main text, and of steps from label to label."""

    def __init__(self, weights: dict[str, float], first: np.ndarray, steps: np.ndarray):
        self.weights, self.first, self.steps = weights, first.tolist(), steps.tolist()

    def decoded(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not found:
            return []
        weights, around = self.weights, {}
        (s00, s01), (s10, s11) = self.steps
        back, zero, one = [], 0.0, 0.0
        for i, b in enumerate(found):
            e = around.get(id(b.around))
            if e is None:
                e = around[id(b.around)] = sum(weights.get(f, 0.0) for f in b.around)
            e += sum(weights.get(f, 0.0) for f in b.own)
            if i == 0:
                zero, one = self.first[0], self.first[1] + e
                continue
            from0, from1 = (zero + s00, one + s10), (zero + s01, one + s11)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            zero, one = max(from0), max(from1) + e
        label = int(one > zero)
        labels = [label]
        for b in reversed(back):
            label = int(b[label])
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return " ".join(b.text for b, label in zip(found, self.decoded(found)) if label)


def fit(labelled: list[tuple[str, list[int]]], rounds: int = 300, rate: float = 0.15, decay: float = 1e-5, least: int = 3) -> Model:
    """Maximum likelihood by gradient ascent (Adam), with forward-backward over all
    pages at once.  Features that fewer than ``least`` blocks have are left out."""
    chains = [(b, y) for page, y in labelled if (b := blocks(page))]
    for b, y in chains:
        if len(b) != len(y):
            raise ValueError("a page's blocks and labels differ in number")
    counts: dict[str, int] = {}
    for b, _ in chains:
        for x in b:
            for f in (*x.around, *x.own):
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= least)
    number = {f: i for i, f in enumerate(names)}
    long, many = max(len(b) for b, _ in chains), len(chains)
    seen = np.zeros((many, long), dtype=bool)
    y = np.zeros((many, long), dtype=np.int64)
    cells, features = [], []
    for i, (b, labels) in enumerate(chains):
        seen[i, : len(b)], y[i, : len(b)] = True, labels
        for t, x in enumerate(b):
            mine = [number[f] for f in (*x.around, *x.own) if f in number]
            features += mine
            cells += [i * long + t] * len(mine)
    cells, features = np.array(cells), np.array(features)
    w, first, steps = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, steps)]
    total = seen.sum()
    pair = seen[:, 1:]
    for turn in range(1, rounds + 1):
        e = np.zeros((many, long, 2))
        e[:, :, 1] = np.bincount(cells, w[features], minlength=many * long).reshape(many, long)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = first + e[:, 0]
        for t in range(1, long):
            new = np.logaddexp(a[:, t - 1, :1] + steps[0], a[:, t - 1, 1:] + steps[1]) + e[:, t]
            a[:, t] = np.where(seen[:, t, None], new, a[:, t - 1])
        for t in range(long - 2, -1, -1):
            nxt = e[:, t + 1] + b[:, t + 1]
            new = np.logaddexp(nxt[:, :1] + steps[:, 0], nxt[:, 1:] + steps[:, 1])
            b[:, t] = np.where(seen[:, t + 1, None], new, b[:, t])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None]
        one = np.where(seen, np.exp(a[:, :, 1] + b[:, :, 1] - z), 0)
        two = a[:, :-1, :, None] + steps + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None]
        two = np.where(pair[:, :, None, None], np.exp(np.minimum(two, 0)), 0).sum(axis=(0, 1))
        off = np.where(seen, y - one, 0).ravel()
        grads = [
            np.bincount(features, off[cells], minlength=len(names)),
            np.array([(1 - y[:, 0] - (1 - one[:, 0])).sum(), (y[:, 0] - one[:, 0]).sum()]),
            np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)]) - two,
        ]
        for p, g, (m, v) in zip((w, first, steps), grads, moments):
            g = g / total - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return Model(dict(zip(names, w.tolist())), first, steps)


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Fitted on 700 generated pages (see :mod:`.pages`)."""
    return fit(pages.labelled(700, 11))


def extracted(rows: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of each row."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(default_model() if model is None else model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [sent.value.text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    slim = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, url string, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page."""
    out = extracted(common.table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
