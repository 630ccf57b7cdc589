"""License scans by diagonal voting, with SQL functions only.

Every rolling k-gram of words of every document is joined, by its hash, to the places
in the templates where the same words stand (the words of a match are compared, a hash
is not trusted). A match at document word d and template word t votes for the diagonal
d - t. Votes are counted per document, template and diagonal before anything is
shuffled; a diagonal's list of template places is all that leaves a task. Diagonals at
most ``slack`` words apart, as insertions and deletions leave them, are merged, and
a merged span, like each diagonal alone, is verified: the share of
the longer of span and template that the votes' words cover must reach ``least``. An exact template (a
phrase) is one diagonal that covers all its words. A template shorter than k is matched by grams of its own length.

Rules: a null text is the empty text, with no words and no spans; a null doc_id stays null. Repeated
rows and rows of one id are scanned each by itself. An empty table gives no rows; other
columns of the input are not read. One document's matches meet in one task, at
most its words times the places of one gram in the templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates of more places than this are joined by a salted shuffle instead of a broadcast (about 100 bytes a place).
MAX_BROADCAST_GRAMS = 100_000
SALTS = 64
#: The phrases of the base rule with their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Notices as their licenses give them.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def standard(spark: SparkSession) -> DataFrame:
    """The phrases (exact) and notices: label, text and exact."""
    rows = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("label", "text", "exact"), strict=True))) for r in rows))))


def _places(templates: DataFrame, k: int) -> DataFrame:
    """template, label, exact, size (its words), k, t (a place) and gram (the k words there) of all templates that have a word."""
    rows = templates.select(F.xxhash64("label", "text", "exact").alias("template"), "label", "exact", words(F.col("text")).alias("w")).dropDuplicates(["template"])
    rows = rows.withColumn("size", F.size("w")).where("size > 0").withColumn("k", F.least(F.lit(k), F.col("size")))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("t"))
    return at.select("template", "label", "exact", "size", "k", "t", F.array_join(F.slice("w", F.col("t") + 1, F.col("k")), " ").alias("gram"))


def _votes(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Per row, template and diagonal the template places voted for; and for each row one without a template."""
    ks = sorted(r[0] for r in places.select("k").distinct().collect())  # k numbers at most
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    following = F.transform("w", lambda x, i: F.concat_ws(" ", x, *(F.get("w", i + j) for j in range(1, k))))
    head = F.array(F.lit(None).cast("string"))
    at = given.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(head, following)).alias("d", "long_gram"))
    # place 0 is the row itself, which stays whatever matches; words count from 1 here
    grams = F.array(*(F.struct(F.lit(n).alias("k"), F.substring_index("long_gram", " ", n).alias("gram")) for n in ks)) if ks else F.array().cast("array<struct<k: int, gram: string>>")
    itself = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("gram")))
    at = at.select("row", "doc_id", "n_words", "d", F.inline(F.when(F.col("d") == 0, itself).otherwise(grams)))
    at = at.withColumn("hash", F.xxhash64("k", "gram"))
    there = places.withColumn("hash", F.xxhash64("k", "gram")).withColumnsRenamed({"k": "t_k", "gram": "t_gram", "hash": "t_hash"})
    same = (F.col("hash") == F.col("t_hash")) & (F.col("k") == F.col("t_k")) & (F.col("gram") == F.col("t_gram"))
    if places.count() <= MAX_BROADCAST_GRAMS:
        met = at.join(F.broadcast(there), same, "left")
    else:
        met = _salted(at, there, same)
    met = met.where("d = 0 or template is not null").withColumn("diagonal", F.col("d") - 1 - F.col("t"))
    return met.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "size", "t_k", "diagonal").agg(F.collect_list("t").alias("places"))


def _salted(at: DataFrame, there: DataFrame, same: Column) -> DataFrame:
    """The join when the templates are too many to broadcast: a frequent gram's rows are spread over SALTS tasks."""
    spread = there.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return at.withColumn("salt", F.pmod(F.xxhash64("row", "d"), F.lit(SALTS)).cast("int")).join(spread, same & (F.col("salt") == F.col("t_salt")), "left")


def _share(places: Column, start: Column, stop: Column) -> Column:
    """The share of the longer of span and template that is covered by the words of the places' grams."""
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("t_k") - 1)))))
    return covered / F.greatest(F.col("size"), stop - start)


def scan(docs: DataFrame, templates: DataFrame | None = None, k: int = 4, slack: int = 8, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, spans and score of every row of docs.

    spans: label, exact, start and stop (words from 0, end exclusive) and share of each verified
    span, sorted; score: the greatest share of any span, verified or not (0: none).
    templates: label, text and exact per row; standard() if none are given.
    """
    templates = standard(docs.sparkSession) if templates is None else templates
    votes = _votes(docs, _places(templates, k), k).repartition("row")
    votes = votes.withColumns({"start": F.col("diagonal") + F.array_min("places"), "stop": F.col("diagonal") + F.array_max("places") + F.col("t_k")})
    near = W.Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("begins", F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(near) > slack), 1).otherwise(0))
    votes = votes.withColumn("island", F.sum("begins").over(near.rowsBetween(W.Window.unboundedPreceding, 0)))
    votes = votes.withColumn("alone", F.struct(_share(F.col("places"), F.col("start"), F.col("stop")).alias("share"), F.col("start"), F.col("stop")))
    by = ["row", "doc_id", "n_words", "template", "label", "exact", "size", "t_k", "island"]
    spans = votes.groupBy(*by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("alone").alias("alone"))
    merged = F.struct(_share(F.col("places"), F.col("start"), F.col("stop")).alias("share"), F.col("start"), F.col("stop"))
    best = spans.select("row", "doc_id", "n_words", "template", "label", "exact", F.when(F.col("exact"), F.col("alone")).otherwise(F.greatest("alone", merged)).alias("best"))
    ok = F.col("template").isNotNull() & (F.col("best.share") >= F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(least)))
    span = F.struct(F.col("best.start").alias("start"), F.col("best.stop").alias("stop"), F.col("label"), F.col("exact"), F.col("best.share").alias("share"))
    rows = best.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(F.when(ok, span))).alias("spans"), F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("best.share"))), F.lit(0.0)).alias("score"))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", "score")


def labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Of scan()'s rows: doc_id, n_words, n_base, first_word, last_word (of exact spans), base_labels, labels and score."""
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    rows = scanned.withColumn("base", base)
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score")


def _values() -> str:
    rows = [(label, text, "true") for label, text in PHRASES] + [(label, text, "false") for label, text in NOTICES]
    return ", ".join(f"({n}, '{label}', '{text}', {exact})" for n, (label, text, exact) in enumerate(rows))


#: SQL for op12's rows: summary(scan()) of documents with the default parameters.
ORACLE = rf"""
WITH given(id, label, text, exact) AS (VALUES {_values()}),
tw AS (SELECT id, label, exact, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM given),
ts AS (SELECT *, len(w) AS size, least(4, len(w)) AS k FROM tw),
places AS (SELECT id, label, exact, size, k, t, array_to_string(w[t + 1:t + k], ' ') AS gram FROM ts, unnest(range(0, size - k + 1)) AS u(t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS w1, unnest(w[2:] || ['']) AS w2, unnest(w[3:] || ['', '']) AS w3, unnest(w[4:] || ['', '', '']) AS w4 FROM d WHERE len(w) > 0),
grams AS (SELECT doc_id, p, 2 AS k, w1 || ' ' || w2 AS gram FROM spots WHERE w2 <> '' UNION ALL SELECT doc_id, p, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM spots WHERE w4 <> ''),
votes AS (SELECT doc_id, id, label, exact, size, k, p - t AS diagonal, min(p) AS start, max(p + k) AS stop, list(t) AS places FROM grams JOIN places USING (k, gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) > 8 THEN 1 ELSE 0 END AS begins FROM votes),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, id ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM marked),
cand AS (
  SELECT doc_id, id, label, exact, size, k, island, start, stop, places FROM islands
  UNION ALL SELECT doc_id, id, label, exact, size, k, island, min(start), max(stop), flatten(list(places)) FROM islands GROUP BY ALL),
shares AS (SELECT *, len(list_distinct(flatten(list_transform(places, lambda x: range(x, x + k))))) / greatest(size, stop - start)::DOUBLE AS share FROM cand),
best AS (SELECT doc_id, id, label, exact, island, max(share) AS share, min(start) AS start FROM shares GROUP BY ALL),
found AS (
  SELECT doc_id, max(share) AS score, count(*) FILTER (exact AND share = 1) AS n_base, min(start) FILTER (exact AND share = 1) AS first_word, max(start) FILTER (exact AND share = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND share = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= CASE WHEN exact THEN 1 ELSE 0.6 END) AS labels
  FROM best GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""
