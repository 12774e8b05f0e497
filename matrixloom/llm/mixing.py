"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

The leaves of a domain - language - source tree hold tokens; a leaf can give each
of its tokens at most ``max_epochs`` times.  A budget of tokens is handed down the
tree: each node's budget is divided among its children in proportion to their
weights; a child whose leaves can't give that much is filled up, and what is left
is divided among its siblings anew, so a shortage stays within its parent as long
as siblings can make up for it and only then reaches the parent's siblings.
Shares are whole tokens; remainders go one by one to the first children that are
not full.

A leaf with a budget of e times its tokens and r more gives all its documents in
epochs 1..e, and in epoch e + 1 the longest prefix, in the order of a hash of
seed, epoch and identifier, that holds at most r tokens.

Scale: tokens are counted in the scan; budgets are windows over the tree's nodes.
A prefix is found without sorting a leaf: tokens are summed by leaf and hash
bucket, the bucket where the prefix ends is found in those sums, and only that
bucket's documents are sorted.  The number of buckets grows with the square root
of the number of documents.  What remains is one cut per leaf, with which each
document is judged where it lies; texts aren't moved.

Behaviour: null domain, language or source count as empty strings; a null
identifier counts as an empty one in the hash; rows that repeat an identifier
lie at one place of the order and are taken together or not at all; texts without words
cost no tokens; leaves of weight 0 give nothing; a tree that can't give the whole
budget gives what it can.  An empty table gives an empty result.  All columns
are kept by :func:`mixture`, in a struct and so whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed value: what separates words, as a class of characters.
WORDS = "[^ \\t-\\r]+"
LEVELS = ("_domain", "_lang", "_source")
BIG = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def default_domain(source: Column) -> Column:
    """The production tree's domains: sources without a number of two digits or more
    are of the web."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1), F.lit(""))
    return F.when(F.length(number) <= 1, "web").otherwise("curated")


#: The production mixture: weights of domains, of languages in a domain and of
#: sources; what isn't named has weight 1.
WEIGHTS = {("web",): 3, ("curated",): 2, ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2, ("curated", "en"): 4, ("curated", "de"): 2, ("curated", "fr"): 2, ("web", "en", "src0"): 3}


def _weights(spark: SparkSession, weights: Mapping[tuple, int], depth: int) -> DataFrame:
    rows = [(k, int(w)) for k, w in weights.items() if len(k) == depth]
    columns = {c: (pa.string(), [k[i] for k, _ in rows]) for i, c in enumerate(LEVELS[:depth])}
    return common.local_table(spark, columns | {"weight": (pa.int32(), [w for _, w in rows])})


def divided(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes(parent.., child, cap, weight, budget)``, the parent's budget, with
    ``share`` for each child."""
    nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0))).withColumn("weight", F.greatest("weight", F.lit(0)))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.col("cap").cast("double") / F.greatest(F.col("weight"), F.lit(1)).cast("double")
    order = by.orderBy(ratio, F.col(child))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: c.cast(BIG)
    nodes = nodes.withColumns(
        {
            "_spent": F.coalesce(F.sum(big(F.col("cap"))).over(before), F.lit(0)).cast(BIG),
            "_weights": F.sum(big(F.col("weight"))).over(onward),
        }
    )
    left = big(F.col("budget") - F.col("_spent"))
    nodes = nodes.withColumn("_full", big(F.col("cap") * F.col("_weights")) <= big(left * F.col("weight")))
    nodes = nodes.withColumns(
        {
            "_used": F.coalesce(F.sum(F.when(F.col("_full"), big(F.col("cap")))).over(by), F.lit(0)).cast(BIG),
            "_open": F.coalesce(F.sum(F.when(~F.col("_full"), big(F.col("weight")))).over(by), F.lit(0)).cast(BIG),
        }
    )
    nodes = nodes.withColumn("_floor", F.expr("CASE WHEN _full THEN cap ELSE CAST((budget - _used) * weight AS DECIMAL(38,0)) div _open END").cast("long"))
    open_order = by.orderBy(F.col("_full"), ratio, F.col(child))
    nodes = nodes.withColumns(
        {
            "_rest": F.col("budget") - F.sum("_floor").over(by),
            "_place": F.row_number().over(open_order),
        }
    )
    extra = F.when(~F.col("_full") & (F.col("_place") <= F.col("_rest")), 1).otherwise(0)
    return nodes.withColumn("share", (F.col("_floor") + extra).cast("long")).drop("_spent", "_weights", "_full", "_used", "_open", "_floor", "_rest", "_place")


def budgets(leaves: DataFrame, weights: Mapping[tuple, int], percent: int, max_epochs: int) -> DataFrame:
    """``leaves(_domain, _lang, _source, tokens)`` with ``epochs`` and ``rest``."""
    spark = leaves.sparkSession
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    level = None
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).join(_weights(spark, weights, depth), keys, "left").fillna(1, ["weight"])
        if depth == 1:
            nodes = nodes.withColumn("budget", F.lit(total).cast("long"))
        else:
            nodes = nodes.join(level, keys[:-1])
        level = divided(nodes, keys[:-1], keys[-1]).select(*keys, F.col("share").alias("budget"))
    out = leaves.join(level, list(LEVELS)).where("tokens > 0")
    return out.select(*LEVELS, "tokens", "budget", F.expr("budget div tokens").alias("epochs"), F.expr("budget - (budget div tokens) * tokens").alias("rest"))


def _placed(rows: DataFrame, seed: int, id_col: str, digits: int) -> DataFrame:
    """Each row's place in the order of its leaf's last epoch."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return rows.withColumn("_place", place).withColumn("_bucket", F.substring("_place", 1, digits))


def plan(docs: DataFrame, weights: Mapping[tuple, int], percent: int, max_epochs: int, seed: int, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, int]:
    """Each leaf's budget and cut, and the number of hash digits in a bucket."""
    said = [F.coalesce(c, F.lit("")).alias(level) for c, level in zip((domain, F.col(f"`{lang_col}`"), F.col(f"`{source_col}`")), LEVELS)]
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), *said, tokens_of(F.col(f"`{text_col}`")).alias("_tokens"))
    slim, _ = common.written(slim, "mixing-tokens")
    held, _ = common.written(slim.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens")), "mixing-held")
    leaves, _ = common.written(budgets(held, weights, percent, max_epochs), "mixing-leaves")
    digits = max(1, math.ceil(math.log(max(2, slim.count()), 16) / 2))
    placed = _placed(slim.join(leaves.where("rest > 0"), list(LEVELS)), seed, "_id", digits)
    by = Window.partitionBy(*LEVELS).orderBy("_bucket")
    sums = placed.groupBy(*LEVELS, "rest", "_bucket").agg(F.sum("_tokens").alias("t")).withColumn("upto", F.sum("t").over(by))
    edges = sums.where("upto > rest AND upto - t <= rest").select(*LEVELS, "_bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))
    edges, _ = common.written(edges, "mixing-edges")
    inside = placed.join(edges, [*LEVELS, "_bucket"]).select(*LEVELS, "_place", "_tokens", "room")
    inside = inside.withColumn("upto", F.sum("_tokens").over(Window.partitionBy(*LEVELS).orderBy("_place")))
    last = inside.where("upto <= room").groupBy(*LEVELS).agg(F.max("_place").alias("_last"))
    cuts = edges.join(last, list(LEVELS), "left").select(*LEVELS, F.col("_bucket").alias("_edge"), F.coalesce("_last", F.lit("")).alias("_last"))
    return common.written(leaves.join(cuts, list(LEVELS), "left"), "mixing-plan")[0], digits


def mixture(
    docs: DataFrame,
    weights: Mapping[tuple, int] = WEIGHTS,
    percent: int = 60,
    max_epochs: int = 2,
    seed: int = 17,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``row, domain, epoch``: the rows of ``docs`` (as structs, whatever their columns
    are called) that the mixture takes, once for each epoch that has them.

    ``percent``: the budget, as a share of the tokens that are there.
    """
    domain = default_domain(F.col(f"`{source_col}`")) if domain is None else domain
    leaves, digits = plan(docs, weights, percent, max_epochs, seed, domain, id_col, text_col, lang_col, source_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    said = [F.coalesce(c, F.lit("")).alias(level) for c, level in zip((domain, F.col(f"`{lang_col}`"), F.col(f"`{source_col}`")), LEVELS)]
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("_id"), *said).join(leaves.where("budget > 0").drop("tokens", "budget"), list(LEVELS))
    rows = _placed(rows, seed, "_id", digits)
    # without an edge, a leaf with a rest would be all inside; a rest is less than its tokens, so there is one
    also = F.col("_edge").isNotNull() & ((F.col("_bucket") < F.col("_edge")) | (F.col("_bucket") == F.col("_edge")) & (F.col("_place") <= F.col("_last")))
    epochs = F.col("epochs") + F.when(also, 1).otherwise(0)
    taken = rows.where(epochs > 0).select("_row", "_domain", F.explode(F.sequence(F.lit(1), epochs.cast("int"))).alias("_epoch"))
    return taken.select(F.col("_row").alias("row"), F.col("_domain").alias("domain"), F.col("_epoch").alias("epoch"))


def mixed(docs: DataFrame, *args, **kw) -> DataFrame:
    """The rows of :func:`mixture` with ``_domain`` and ``_epoch`` added to their columns."""
    return mixture(docs, *args, **kw).select("row.*", F.col("domain").alias("_domain"), F.col("epoch").alias("_epoch"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mixture of ``documents``: one row per document and epoch."""
    return mixture(common.table(spark, sf_dir, "documents")).select(
        "row.doc_id", "domain", "row.lang", "row.source", "epoch", tokens_of(F.col("row.text")).alias("n_tokens")
    )


def _divided_sql(name: str, nodes: str, parent: list[str], child: str) -> str:
    """The division of a budget among children, as common table expressions."""
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    by = f"{part} ORDER BY ratio, {child}"
    return f"""
{name}_a AS (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM ({nodes})),
{name}_b AS (SELECT *,
  coalesce(sum(CAST(cap AS HUGEINT)) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(CAST(weight AS HUGEINT)) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM {name}_a),
{name}_c AS (SELECT *, cap * onward <= (budget - spent) * weight AS is_full FROM {name}_b),
{name}_d AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN CAST(cap AS HUGEINT) END) OVER ({part}), 0) AS used,
  sum(CASE WHEN NOT is_full THEN CAST(weight AS HUGEINT) END) OVER ({part}) AS open_w FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS HUGEINT) ELSE ((budget - used) * weight) // open_w END AS low FROM {name}_d),
{name}_f AS (SELECT *, budget - sum(low) OVER ({part}) AS left_over,
  row_number() OVER ({part} ORDER BY is_full, ratio, {child}) AS place FROM {name}_e),
{name} AS (SELECT *, CAST(low + CASE WHEN NOT is_full AND place <= left_over THEN 1 ELSE 0 END AS BIGINT) AS share FROM {name}_f)"""


def _weight_sql(depth: int) -> str:
    cols = ("domain", "lang", "source")[:depth]
    cases = [" AND ".join(f"{c} = '{v}'" for c, v in zip(cols, k)) + f" THEN {w}" for k, w in WEIGHTS.items() if len(k) == depth]
    return "CASE " + " ".join(f"WHEN {c}" for c in cases) + " ELSE 1 END"


def _oracle(percent: int = 60, max_epochs: int = 2, seed: int = 17) -> str:
    count = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))"
    return f"""
WITH t AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN length(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)) <= 1 THEN 'web' ELSE 'curated' END AS domain,
  CAST({count} AS BIGINT) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens FROM t GROUP BY ALL),
{_divided_sql("one", f"SELECT domain, sum(tokens) * {max_epochs} AS cap, {_weight_sql(1)} AS weight, (SELECT sum(tokens) * {percent} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain", [], "domain")},
{_divided_sql("two", f"SELECT l.domain, l.lang, l.cap, {_weight_sql(2).replace('domain', 'l.domain')} AS weight, o.share AS budget FROM (SELECT domain, lang, sum(tokens) * {max_epochs} AS cap FROM leaf GROUP BY ALL) l JOIN one o ON l.domain = o.domain", ["domain"], "lang")},
{_divided_sql("three", f"SELECT l.*, l.tokens * {max_epochs} AS cap, {_weight_sql(3).replace('domain', 'l.domain').replace('lang', 'l.lang')} AS weight, o.share AS budget FROM leaf l JOIN two o ON l.domain = o.domain AND l.lang = o.lang", ["domain", "lang"], "source")},
plan AS (SELECT domain, lang, source, CAST(share // tokens AS BIGINT) AS epochs, share % tokens AS rest FROM three WHERE tokens > 0),
placed AS (SELECT t.*, epochs, rest, md5('{seed}:' || (epochs + 1) || ':' || doc_id) AS place FROM t JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) <= rest AS also FROM placed),
taken AS (SELECT *, epochs + CASE WHEN also AND rest > 0 THEN 1 ELSE 0 END AS k FROM cut)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, CAST(e AS INTEGER) AS epoch, n AS n_tokens
FROM taken, LATERAL (SELECT unnest(generate_series(1, k)) AS e)
"""


ORACLE = _oracle()
