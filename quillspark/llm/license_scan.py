"""Licence statements by diagonal voting, with DataFrame functions only.

The word pairs of every document are joined by hash to the places where they stand in
the templates, passages of licence texts and notices. A pair at word p that matches
template place t votes for diagonal p - t. A base phrase is a diagonal with all votes of
its template, word for word. For the others neighbouring diagonals are merged, as an
inserted or lost word moves the rest by one, and each span is verified: from every diagonal
of it on, those that lie within a length that fits the template are put together, their
distinct places are counted, and if these are enough, the longest run of pairs that stand
in the template's order is the score. So words of a template that recur, or stand in
another order, give no more than they hold of it, and take nothing from a whole passage.

The template list is fixed, so it is broadcast; documents are exploded and pre-aggregated
map side, and only one row for each document and voted diagonal is shuffled.

Nulls: a null text has no words: counts 0, places null, labels empty, score 0. Repeated
rows are scanned each; of equal scores one counts. Extra columns are not read, whatever
they are called. Texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases, found word for word.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method, found with gaps: fixed texts of notices and licences, cut into passages of fewer than 64 words.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at': "apache",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.': "apache",
    "Released under the MIT License": "mit",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction': "mit",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "This work is licensed under the GNU General Public License, version 3": "gnu",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gnu",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "creative-commons",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "subject to the terms of the Mozilla Public License": "mpl",
    "This is free and unencumbered software released into the public domain.": "unlicense",
}
NEAR, LEAST, LONGEST = 3, 0.7, 1.5


def words(text: Column) -> Column:
    """Words in order, A-Z lowered."""
    found = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD)
    return F.filter(found, lambda w: w != "")


def listed() -> list[tuple[int, str, str, bool]]:
    """(number, phrase, label, base) of every template."""
    both = [(p, x, True) for p, x in BASE.items()] + [(" ".join(re.findall("[a-z0-9]+", p.lower())), x, False) for p, x in TEMPLATES.items()]
    return [(i, *row) for i, row in enumerate(both)]


def pairs(phrase: str) -> list[tuple[int, str, str]]:
    w = phrase.split()
    return [(t, a, b) for t, (a, b) in enumerate(zip(w[:-1], w[1:], strict=True))]


def grams(spark: SparkSession) -> DataFrame:
    """(gram, t, template): the places of every word pair."""
    rows = [(a, b, t, i) for i, phrase, _, _ in listed() for t, a, b in pairs(phrase)]
    return spark.createDataFrame(rows, "a string, b string, t int, template int").select(F.xxhash64("a", "b").alias("gram"), "t", "template")


def facts(spark: SparkSession) -> DataFrame:
    rows = [(i, label, base, len(pairs(phrase))) for i, phrase, label, base in listed()]
    return spark.createDataFrame(rows, "template int, label string, base boolean, pairs int")


def in_order(points: Column, size: Column) -> Column:
    """Longest run of points (p, t) in which both rise; points are sorted by p, then falling t."""

    def longer(best: Column, x: Column) -> Column:
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), x["t"])), F.lit(0))
        return F.transform(best, lambda v, i: F.when(i == x["t"], F.greatest(v, before + 1)).otherwise(v))

    return F.aggregate(points, F.array_repeat(F.lit(0), size), longer, F.array_max)


def most_places(diagonals: Column, pairs: Column) -> Column:
    """Most pairs of a template that stand in order on neighbouring diagonals (diagonal, low, high, places) within the longest length; 0 if under LEAST."""
    longest = LONGEST * pairs

    def more(got: Column, x: Column) -> Column:
        begin, end = F.least(got["begin"], x["diagonal"] + x["low"]), F.greatest(got["end"], x["diagonal"] + x["high"])
        fits = end - begin + 1 <= longest
        places = F.when(fits, got["places"].bitwiseOR(x["places"])).otherwise(got["places"])
        return F.struct(places.alias("places"), begin.alias("begin"), end.alias("end"), (got["n"] + fits.cast("int")).alias("n"))

    none = F.struct(F.lit(0).cast("long").alias("places"), F.lit(2**31 - 1).alias("begin"), F.lit(-(2**31)).alias("end"), F.lit(0).alias("n"))
    # diagonals are whole numbers; of those further apart than twice the length none fit
    near = F.ceil(2 * longest).cast("int")

    def held(x: Column) -> Column:
        bits = F.filter(F.sequence(x["low"], x["high"]), lambda t: F.getbit(x["places"], t) == 1)
        return F.transform(bits, lambda t: F.struct((x["diagonal"] + t).alias("p"), F.negative(t).alias("n"), t.alias("t")))

    def chain(i: Column) -> Column:
        part = F.slice(diagonals, i + 1, near)
        got = F.aggregate(part, none, more)
        points = F.array_sort(F.flatten(F.transform(F.slice(part, F.lit(1), got["n"]), held)))
        return F.when(F.bit_count(got["places"]) >= LEAST * pairs, in_order(points, pairs)).otherwise(0)

    return F.array_max(F.transform(diagonals, lambda _, i: chain(i)))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    hashes = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), hashes.alias("grams"))
    df = df.select("doc_id", "row", "n_words", F.posexplode_outer("grams").alias("p", "gram"))
    df = df.join(F.broadcast(grams(docs.sparkSession)), "gram", "left")
    # numbers only, so that the words are combined in a hash table and not sorted
    votes = df.groupBy("row", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("t").alias("votes"), F.min("t").alias("low"), F.max("t").alias("high"),
        F.expr("bit_or(shiftleft(1L, t))").alias("places"),
    )
    votes = votes.join(F.broadcast(facts(docs.sparkSession)), "template", "left")
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    votes = votes.withColumn("cluster", F.sum(apart.cast("int")).over(order))
    full = F.col("base") & (F.col("votes") == F.col("pairs"))
    spans = votes.groupBy("row", "template", "cluster", "label", "base", "pairs").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count_if(full).alias("n_full"), F.min(F.when(full, F.col("diagonal"))).alias("first"), F.max(F.when(full, F.col("diagonal"))).alias("last"),
        F.array_sort(F.collect_list(F.when(~F.col("base"), F.struct("diagonal", "low", "high", "places")))).alias("diagonals"),
    )
    part = most_places(F.col("diagonals"), F.col("pairs")) / F.col("pairs")
    mine = F.when(F.col("base"), F.when(F.col("n_full") > 0, F.lit(1.0))).when(part >= LEAST, part)
    named = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    spans = spans.withColumn("share", mine)
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum("n_full").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        named(F.col("base") & (F.col("n_full") > 0)).alias("base_labels"), named(F.col("share").isNotNull()).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _values() -> str:
    rows = [f"('{a} {b}', {t}, {i}, '{label}', {str(base).lower()}, {len(pairs(phrase))})" for i, phrase, label, base in listed() for t, a, b in pairs(phrase)]
    return ", ".join(rows)


ORACLE = f"""
WITH templates(gram, t, template, label, base, pairs) AS (VALUES {_values()}),
docs AS (
  SELECT doc_id, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, id, CAST(len(w) AS BIGINT) AS n_words, w, unnest(range(0, greatest(len(w), 1))) AS p FROM docs),
grams AS (SELECT doc_id, id, n_words, p, concat(w[p + 1], ' ', w[p + 2]) AS gram FROM places),
votes AS (
  SELECT id, template, label, base, pairs, p - t AS diagonal, any_value(doc_id) AS doc_id, any_value(n_words) AS n_words,
    count(t) AS votes, min(t) AS low, max(t) AS high
  FROM grams LEFT JOIN templates USING (gram) GROUP BY id, template, label, base, pairs, p - t),
gaps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS apart FROM votes),
clusters AS (SELECT *, sum(apart) OVER (PARTITION BY id, template ORDER BY diagonal) AS cluster FROM gaps),
marked AS (
  SELECT id, template, cluster, label, base, pairs, any_value(doc_id) AS doc_id, any_value(n_words) AS n_words,
    count(*) FILTER (base AND votes = pairs) AS n_full, min(diagonal) FILTER (base AND votes = pairs) AS first,
    max(diagonal) FILTER (base AND votes = pairs) AS last FROM clusters GROUP BY id, template, cluster, label, base, pairs),
windows AS (
  SELECT a.id, a.template, a.cluster, a.pairs, a.diagonal AS start, b.diagonal,
    max(b.diagonal + b.high) OVER w - min(b.diagonal + b.low) OVER w + 1 <= {LONGEST} * a.pairs AS fits
  FROM clusters AS a JOIN clusters AS b ON a.id = b.id AND a.template = b.template AND a.cluster = b.cluster
    AND b.diagonal BETWEEN a.diagonal AND a.diagonal + CAST(ceil(2 * {LONGEST} * a.pairs) AS INTEGER) WHERE NOT a.base
  WINDOW w AS (PARTITION BY a.id, a.template, a.cluster, a.diagonal ORDER BY b.diagonal)),
points AS (
  SELECT w.id, w.template, w.cluster, w.pairs, start, p, t FROM windows AS w
  JOIN (SELECT id, p, template, t FROM grams JOIN templates USING (gram)) AS g ON g.id = w.id AND g.template = w.template AND g.p - g.t = w.diagonal WHERE fits),
chains AS (
  SELECT id, template, cluster, pairs, start, list_max(list_reduce(
      list_prepend(list_transform(range(pairs), lambda z: 0), list([CAST(t AS INTEGER)] ORDER BY p, t DESC)),
      lambda best, x: list_transform(best, lambda v, i: CASE WHEN i = x[1] + 1 THEN greatest(v, 1 + coalesce(list_max(best[1:x[1]]), 0)) ELSE v END))) AS n
  FROM points GROUP BY id, template, cluster, pairs, start HAVING count(DISTINCT t) >= {LEAST} * pairs),
verified AS (SELECT id, template, cluster, CAST(max(n) AS DOUBLE) / any_value(pairs) AS part FROM chains GROUP BY id, template, cluster),
found AS (
  SELECT m.*, CASE WHEN base THEN CASE WHEN n_full > 0 THEN CAST(1.0 AS DOUBLE) END WHEN part >= {LEAST} THEN part END AS mine
  FROM marked AS m LEFT JOIN verified AS v ON v.id = m.id AND v.template = m.template AND v.cluster = m.cluster)
SELECT any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, CAST(sum(n_full) AS BIGINT) AS n_base,
  CAST(min(first) AS BIGINT) AS first_word, CAST(max(last) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND n_full > 0), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (mine IS NOT NULL), '') AS labels,
  coalesce(max(mine), CAST(0 AS DOUBLE)) AS score
FROM found GROUP BY id
"""
