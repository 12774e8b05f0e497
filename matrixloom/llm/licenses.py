"""License scans by diagonal voting (JVM only).

Words are runs of anything but ASCII characters other than letters and digits,
with A-Z lower-cased.  All rolling k-grams of a text's words (``K`` words; two for
templates of two words) are joined by hash, and by the words themselves, to the
places where templates have them.  Each match votes for the diagonal text place -
template place; votes are counted by text, template and diagonal.  A phrase stands
where a diagonal has all its votes.  For notices, diagonals at most ``TOLERANCE``
apart, as words put in or left out make them, are merged; the merged span is
verified: the different places of the template whose k-grams stand on it (however
often) must reach the part ``COVERAGE`` of its places, and the span must not be longer
than twice the template.

Behaviour: a null text counts as empty and has no words; a text without matches
has no places, empty label strings and score 0; repeated rows are rows of their
own; an empty table gives an empty result; only the identifier and the text are
read, whatever other columns are called.  The templates are a fixed list of known
size, which is broadcast; one has at most ``PLACES`` k-grams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, TOLERANCE, COVERAGE, PLACES = 3, 3, 0.8, 63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that name a license.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Public notices, as licenses ask for them, and names of further licenses.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "3 clause bsd license"),
    ("bsd", "2 clause bsd license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """Number, label, whether it is a phrase, words."""
    listed = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, phrase, text.split()) for i, (label, phrase, text) in enumerate(listed)]


def _grams_of(spark: SparkSession, listed) -> DataFrame:
    rows = []
    for no, label, phrase, words in listed:
        k = min(K, len(words))
        count = len(words) - k + 1
        if count > PLACES:
            raise ValueError(f"a template of more than {PLACES} k-grams: {label}")
        rows += [(no, label, phrase, len(words), count, i, k, " ".join(words[i : i + k])) for i in range(count)]
    no, label, phrase, size, count, at, k, gram = (list(c) for c in zip(*rows))
    frame = common.local_table(
        spark,
        {"template": (pa.int32(), no), "label": (pa.string(), label), "phrase": (pa.bool_(), phrase), "size": (pa.int32(), size), "grams": (pa.int32(), count), "at": (pa.int32(), at), "k": (pa.int32(), k), "template_gram": (pa.string(), gram)},
    )
    return F.broadcast(frame.withColumn("template_hash", F.xxhash64("k", "template_gram")))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed=None) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``
    of each row; spans: the verified ones, as label, first word, end and share."""
    listed = templates() if listed is None else listed
    # two characters that lower() would turn into ASCII letters are taken out of its way
    text = F.coalesce(F.col(text_col), F.lit(""))
    for capital, plain in (("\u0130", "\u0131"), ("\u212a", "\u0138")):
        text = F.replace(text, F.lit(capital), F.lit(plain))
    low = F.lower(text)
    words = F.filter(F.split(low, GAPS), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words.alias("w")).withColumn("n", F.size("w"))

    def grams(k: int):
        places = F.sequence(F.lit(1), F.col("n") - (k - 1))
        joined = F.transform(places, lambda i: F.concat_ws(" ", *[F.element_at("w", i + j) for j in range(k)]))
        return F.when(F.col("n") >= k, joined).otherwise(F.array().cast("array<string>"))

    long = F.greatest(F.col("n") - (K - 1), F.lit(0))
    # a row without a gram stands first, so that each text has a row
    cells = rows.select("id", "row", "n", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), grams(K), grams(2))).alias("cell", "gram"))
    cells = cells.select(
        "id", "row", "n", "cell", "gram",
        F.when(F.col("cell") <= long, F.lit(K)).otherwise(2).alias("gram_k"),
        F.when(F.col("cell") <= long, F.col("cell") - 1).otherwise(F.col("cell") - 1 - long).alias("place"),
    ).withColumn("gram_hash", F.xxhash64("gram_k", "gram"))
    sent = _grams_of(docs.sparkSession, listed)
    same = (F.col("gram_hash") == F.col("template_hash")) & (F.col("gram") == F.col("template_gram")) & (F.col("gram_k") == F.col("k"))
    hits = cells.join(sent, same, "left").where((F.col("cell") == 0) | F.col("template").isNotNull())
    votes = hits.groupBy("id", "row", "n", "template", "label", "phrase", "size", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count("*").cast("int").alias("votes"), F.bit_or(F.expr("shiftleft(1L, at)")).alias("places"), F.min("place").alias("low"), F.max(F.col("place") + F.col("gram_k")).alias("high")
    )
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > TOLERANCE, F.lit(True))
    # all votes of one diagonal are a whole place and merge with no other
    whole = F.col("votes") == F.col("grams")
    fresh = fresh | whole | F.coalesce(F.lag(whole).over(by), F.lit(False))
    votes = votes.withColumn("_fresh", fresh.cast("int")).withColumn("span", F.sum("_fresh").over(by))
    spans = votes.groupBy("id", "row", "n", "template", "label", "phrase", "size", "grams", "span").agg(
        (F.bit_count(F.bit_or("places")) / F.col("grams")).alias("share"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("votes").alias("most"),
        F.min("diagonal").alias("diagonal"),
    )
    base = F.col("phrase") & (F.col("most") == F.col("grams"))
    fits = base | (F.col("phrase") == F.lit(False)) & (F.col("share") >= COVERAGE) & (F.col("high") - F.col("low") <= 2 * F.col("size"))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    near = (F.col("high") - F.col("low")) <= 2 * F.col("size")
    return spans.groupBy("id", "row", F.col("n").cast("long").alias("n_words")).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(fits).alias("labels"),
        F.coalesce(F.max(F.when(near, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(fits, F.struct("label", "low", "high", "share")))).alias("spans"),
    ).drop("row")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return scanned(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def _oracle() -> str:
    rows = ", ".join(f"({no}, '{label}', {str(phrase).upper()}, {len(words)}, {min(K, len(words))}, {i}, '{w}')" for no, label, phrase, words in templates() for i, w in enumerate(words))
    return rf"""
WITH tw(template, label, phrase, size, k, tpos, word) AS (VALUES {rows}),
doc AS (SELECT row_number() OVER () AS row_no, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM doc),
hit AS (SELECT row_no, template, label, phrase, size, k, tpos, pos, pos - tpos AS diagonal FROM word JOIN tw USING (word)),
gram AS (SELECT * FROM (SELECT *, lead(tpos, 1) OVER d AS next1, lead(tpos, 2) OVER d AS next2 FROM hit
  WINDOW d AS (PARTITION BY row_no, template, diagonal ORDER BY tpos)) WHERE next1 = tpos + 1 AND (k = 2 OR next2 = tpos + 2)),
vote AS (SELECT row_no, template, label, phrase, size, size - k + 1 AS grams, diagonal, count(*) AS votes, min(pos) AS low, max(pos + k) AS high
  FROM gram GROUP BY ALL),
step AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER d > {TOLERANCE}, TRUE) OR votes = grams
  OR coalesce(lag(votes = grams) OVER d, FALSE) THEN 1 ELSE 0 END AS fresh FROM vote
  WINDOW d AS (PARTITION BY row_no, template ORDER BY diagonal)),
mark AS (SELECT *, sum(fresh) OVER (PARTITION BY row_no, template ORDER BY diagonal) AS span FROM step),
spans AS (SELECT m.row_no, m.template, m.label, m.phrase, m.size, m.grams, m.span, count(DISTINCT g.tpos)::DOUBLE / m.grams::DOUBLE AS share,
  min(low) AS low, max(high) AS high, max(votes) = m.grams AS is_whole, min(m.diagonal) AS diagonal
  FROM mark m JOIN gram g ON g.row_no = m.row_no AND g.template = m.template AND g.diagonal = m.diagonal
  GROUP BY m.row_no, m.template, m.label, m.phrase, m.size, m.grams, m.span),
judged AS (SELECT *, phrase AND is_whole AS base, high - low <= 2 * size AS near FROM spans),
summed AS (SELECT row_no, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  list_sort(list_distinct(list(label) FILTER (base))) AS b, list_sort(list_distinct(list(label) FILTER (base OR NOT phrase AND near AND share >= {COVERAGE}))) AS l,
  max(share) FILTER (near) AS score FROM judged GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM doc LEFT JOIN summed USING (row_no)
"""


ORACLE = _oracle()
