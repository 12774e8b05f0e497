"""URL filters: pattern rules behind an index of literal tokens (JVM only).

Rules are of two kinds.  A site rule ``host/path`` fits its host and all
subdomains where the url's path starts with the rule's; the longest that fits
wins, and any that fits wins over pattern rules.  A pattern rule is text with
``^`` for a separator (anything but a letter or digit, or an end) and ``*`` for
anything, looked for in host and path in lower case; one that fits blocks.

Both become regular expressions.  A rule's literal tokens are the runs of a-z
and 0-9 in it that separators bound on both sides, so a url that the rule fits
has each of them as a token.  Every rule is filed under its token that the fewest
urls have (counted over the whole table).  The tokens of each different url fetch
the rules filed under them, and only those rules' expressions are run on it.

Behaviour: a null url, or one without ``://``, has an empty host and path and no
rule; repeated urls are judged once and joined back; an empty table gives an
empty result; only the identifier and the url are read, whatever other columns
are called.  The rules are a list in the driver's hands; up to
``BROADCAST_BYTES`` of them are broadcast, more are joined by shuffling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "(?:[^a-z0-9]|^|$)"


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    site: bool
    regex: str
    tokens: tuple[str, ...]


def site_rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    path = slash + path
    bounded = path if path.endswith("/") else path[: re.search(r"[^/]*$", path.lower()).start()]
    tokens = re.findall(r"[a-z0-9]+", (host + bounded).lower())
    return Rule(text, action, True, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(dict.fromkeys(tokens)))


def pattern_rule(text: str, action: str = "block") -> Rule:
    text = text.lower()
    tokens = [m[0] for m in re.finditer(r"[a-z0-9]+", text) if m.start() and text[m.start() - 1] != "*" and text[m.end() : m.end() + 1] not in ("", "*")]
    if not tokens:
        raise ValueError(f"no whole token in {text!r}")
    regex = "".join({"^": SEPARATOR, "*": ".*"}.get(c) or re.escape(c) for c in text)
    return Rule(text, action, False, regex, tuple(dict.fromkeys(tokens)))


#: The sites' rules.
SITES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Parts of urls of advertising, betting, pill and adult pages.
PATTERNS = ["^ads-track^", "^ad-server^", "^doubleclick^", "^casino-win^", "^casino^", "^free-bets^", "^poker-*^online^", "^cheap-pills^", "^viagra^", "^spam-farm^", "^link-farm^", "^adult-x^", "^xxx^", "^porn^", "/wp-login.php^", "/cgi-bin/"]


def production_rules() -> list[Rule]:
    return [site_rule(*r) for r in SITES] + [pattern_rule(p) for p in PATTERNS]


def parts(pages: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with ``host`` and ``path`` of its urls."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1),
        }
    )


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict, pattern`` of each row."""
    spark = pages.sparkSession
    rows = parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").select("id", "host", "path")
    places = rows.where("host <> ''").select("host", "path").distinct()
    said = F.concat("host", "path")
    tokens = places.select("host", "path", F.explode(F.array_distinct(F.split(F.lower(said), "[^a-z0-9]+"))).alias("token")).where("token <> ''")

    pairs = [(i, t) for i, r in enumerate(rules) for t in r.tokens]
    listed = common.local_table(spark, {"rule_no": (pa.int32(), [i for i, _ in pairs]), "token": (pa.string(), [t for _, t in pairs])})
    small = sum(len(r.regex) + len(r.text) for r in rules) <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df
    counts = tokens.join(sent(listed.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        listed.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("at"))
        .select("rule_no", "at.token")
    )
    known = common.local_table(
        spark,
        {"rule_no": (pa.int32(), list(range(len(rules))))} | {k: (pa.string(), [getattr(r, k) for r in rules]) for k in ("text", "action", "regex")} | {"site": (pa.bool_(), [r.site for r in rules])},
    )
    index = sent(known.join(rarest, "rule_no"))

    subject = F.when(F.col("site"), said).otherwise(F.lower(said))
    best = (
        tokens.join(index, "token")
        .where(F.regexp_like(subject, F.col("regex")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("site", F.length("text").alias("size"), "text", "action")).alias("best"))
    )
    # urls without a host meet no rule: they aren't dealt by a key that all of them share
    hopeless = rows.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    whole = rows.where("host <> ''").join(best, ["host", "path"], "left").unionByName(hopeless)
    return whole.select(
        "id",
        "host",
        "path",
        F.when(F.col("best.site"), F.col("best.text")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.text")).alias("pattern"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page, and the pattern that blocked it."""
    return judged(common.table(spark, sf_dir, "pages"), production_rules()).withColumnRenamed("id", "page_id")


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(r.text)}, {quoted(r.action)}, {r.site}, {quoted(r.regex)})" for r in production_rules())


ORACLE = f"""
WITH rules(text, action, site, regex) AS (VALUES {_values()}),
cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_no
  FROM pages),
hits AS (
  SELECT row_no, text, action, site,
         row_number() OVER (PARTITION BY row_no ORDER BY site DESC, length(text) DESC, text DESC) AS place
  FROM cut JOIN rules ON host <> '' AND regexp_matches(CASE WHEN site THEN host || path ELSE lower(host || path) END, regex))
SELECT page_id, host, path, CASE WHEN site THEN text END AS rule, coalesce(action, 'allow') AS verdict,
       CASE WHEN NOT site THEN text END AS pattern
FROM cut LEFT JOIN (SELECT * FROM hits WHERE place = 1) h ON cut.row_no = h.row_no
"""
