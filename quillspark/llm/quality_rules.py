"""Quality rules with thresholds that follow the data.

One Python pass measures each document. Quantile sketches of the measures
(`percentile_approx`, merged map side first) give an upper and a lower fence per
language and source: REACH interquartile ranges off the quartiles, and no cutoff is
fixed. A group's quartiles are drawn towards those of its language, and these towards
those of all documents, as if PRIOR documents more stood there, so a group of any size
has its fence by the same rule. Where nearly all documents agree the range is nothing;
the least range then leaves room for a few odd signs. The fences are joined back and filter.

Nulls: a null text is an empty one, and fails; a null language or source is a group of
its own. Values at a fence are kept. Repeated rows are judged each. Extra columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, staged, table, utf8

SYMBOLS = b"#*$%&|<>"
#: Measure and its least interquartile range.
FENCES = {"symbol_ratio": 0.0025, "dup_line_ratio": 0.05, "word_length": 0.1}
REACH, PRIOR = 8.0, 50
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base = len(seen)
    pairs = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of docs and the measures."""
    schema = docs.select(*keep).schema
    names = FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measures(text) for (text,) in rows_of(batch, ["_text"])]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    for name in names:
        schema = schema.add(name, "long")
    return docs.select(*keep, utf8("text").alias("_text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        }
    )


def fences(df: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Fences by lang and source, by lang, and for all; `level` tells them apart (0 is the finest).

    The quartiles come from documents that pass the base rules.
    """
    quartiles = [F.percentile_approx(m, [0.25, 0.75], accuracy).alias(m) for m in FENCES]
    passing = df.filter(~base_failed())
    at = passing.agg(*quartiles).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *FENCES)
    parts = [at.withColumn("level", F.lit(2))]
    for level, keys in ((1, ["lang"]), (0, ["lang", "source"])):
        group = passing.groupBy(*keys).agg(F.count("*").alias("_n"), *quartiles)
        above = at.select(F.col("lang").alias("_lang"), *(F.col(m).alias(f"_{m}") for m in FENCES))
        # the table above has one row, or one for each language
        group = group.join(F.broadcast(above), F.lit(True) if level == 1 else F.col("lang").eqNullSafe(F.col("_lang")))
        drawn = lambda m: F.zip_with(m, f"_{m}", lambda x, y: (F.col("_n") * x + PRIOR * y) / (F.col("_n") + PRIOR))
        source = F.col("source") if level == 0 else F.lit(None).cast("string").alias("source")
        at = group.select("lang", source, *(drawn(m).alias(m) for m in FENCES))
        parts.append(at.withColumn("level", F.lit(level)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    limits = []
    for m, least in FENCES.items():
        low, high = F.col(m)[0], F.col(m)[1]
        limits.append((high + REACH * F.greatest(high - low, F.lit(least))).alias(f"{m}_max"))
        if m == "word_length":
            limits.append((low - REACH * F.greatest(high - low, F.lit(least))).alias(f"{m}_min"))
    return out.select("level", "lang", "source", *limits)


def judged(df: DataFrame, limits: DataFrame) -> DataFrame:
    """df of `measured` with base_failed and kept; `limits` has one row per group (see `fences`)."""
    df = with_ratios(df)
    names = [*(f"{m}_max" for m in FENCES), "word_length_min"]
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        side = limits.filter(F.col("level") == level).select(
            *(F.col(k).alias(f"_{k}") for k in keys), F.struct(*names).alias(f"_at{level}")
        )
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        if keys:
            df = df.join(side, on, "left").drop(*(f"_{k}" for k in keys))
        else:
            df = df.join(F.broadcast(side), how="left")  # one row
    at = F.coalesce("_at0", "_at1", "_at2")
    bad = F.col("word_length") < at["word_length_min"]
    for m in FENCES:
        bad = bad | (F.col(m) > at[f"{m}_max"])
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | F.coalesce(bad, F.lit(False))))


def quality_filter(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns (lang and source among them) with measures, base_failed and kept."""
    base = staged(measured(docs, keep), "quality-measures")
    return judged(base, staged(fences(with_ratios(base)), "quality-fences"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever those are called; each text is measured once."""
    rows = docs.select("text", "lang", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    base = staged(measured(rows, ["_row", "lang", "source"]), "quality-measures")
    return judged(base, staged(fences(with_ratios(base)), "quality-fences")).filter("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_filter(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quartiles() -> str:
    return ", ".join(f"quantile_disc({m}, {p}) AS {m}_{k}" for m in FENCES for k, p in (("lo", 0.25), ("hi", 0.75)))


def _drawn() -> str:
    return ", ".join(f"(g.n * g.{m}_{k} + {PRIOR} * a.{m}_{k}) / (g.n + {PRIOR}) AS {m}_{k}" for m in FENCES for k in ("lo", "hi"))


def _bad() -> str:
    spread = {m: f"{REACH} * greatest({m}_hi - {m}_lo, {least})" for m, least in FENCES.items()}
    return " OR ".join([*(f"{m} > {m}_hi + {spread[m]}" for m in FENCES), f"word_length < word_length_lo - {spread['word_length']}"])


ORACLE = f"""
WITH base AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT id, unnest(string_split(t, chr(10))) AS l FROM base),
dup AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY id),
places AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS s FROM base WHERE len(w) >= 3),
grams AS (SELECT id, s, count(*) OVER (PARTITION BY id, w[s], w[s + 1], w[s + 2]) AS c FROM places),
covered AS (SELECT id, count(DISTINCT s + o) AS n FROM grams, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY id),
measured AS (
  SELECT b.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base AS b LEFT JOIN dup ON dup.id = b.id LEFT JOIN covered ON covered.id = b.id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1) AS symbol_ratio,
    CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_ratio, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS word_length FROM measured),
passing AS (SELECT * FROM judged WHERE NOT base_failed),
every AS (SELECT {_quartiles()} FROM passing),
by_lang AS (SELECT lang, {_drawn()} FROM (SELECT lang, count(*) AS n, {_quartiles()} FROM passing GROUP BY lang) AS g CROSS JOIN every AS a),
by_source AS (
  SELECT g.lang, source, {_drawn()} FROM (SELECT lang, source, count(*) AS n, {_quartiles()} FROM passing GROUP BY lang, source) AS g
  JOIN by_lang AS a ON a.lang IS NOT DISTINCT FROM g.lang),
fences AS (
  SELECT 0 AS level, * FROM by_source UNION ALL SELECT 1, lang, NULL, * EXCLUDE (lang) FROM by_lang UNION ALL SELECT 2, NULL, NULL, * FROM every),
met AS (
  SELECT j.*, {_bad()} AS bad
  FROM judged AS j LEFT JOIN fences AS f ON (level = 0 AND f.lang IS NOT DISTINCT FROM j.lang AND f.source IS NOT DISTINCT FROM j.source)
    OR (level = 1 AND f.lang IS NOT DISTINCT FROM j.lang) OR level = 2
  QUALIFY row_number() OVER (PARTITION BY j.id ORDER BY level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce(bad, false)) AS kept FROM met
"""
