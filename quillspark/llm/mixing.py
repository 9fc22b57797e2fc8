"""Mixing sources to target weights by systematic sampling.

Documents stand in one order within their source; the running sum of their expected copies
plus one random offset of the source crosses some integers at each document, and one copy
is taken per crossing. Large documents stand first, in classes of near sizes. The expected
copies are the same for all documents of a class: what is left of the target over the words
that are left, 3 at most. So each class makes up for the crossings of the larger ones, and
what a source gives stays near its target whatever the offset.

The running sum needs no task that sees a whole source: documents are ranked within small
cells (source, size class, hash bucket), cells are summed within source and class, and a
source's classes, some two hundred at most, are folded in one row.

Nulls: a null source is a source, last in order; a document without words, null texts among
them, is never taken. Repeated rows are documents of their own; which of several with one
doc_id and size is taken is not told apart. Extra columns are kept; those that are called
like the columns of `mix` give way to them. Sources of no words have target 0. The table of
sources is small and is ranked in one task; documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import n_words, staged, table

MOST_TIMES = 3
#: Hexadecimal digits of the bucket: the cells of a source and class are some thousands at most.
DIGITS = 3
CELL = ("source", "_class", "_bucket")
PART = ("source", "_class", "_part")
ADDED = ("size", "source_size", "target", "copies")


def size_class(size: Column) -> Column:
    """Bit length and the three bits after the first: sizes in a class differ by an eighth at most."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7)).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, source_size), one row per source.

    A source is full when its share of what the full ones before it leave is above its
    limit; sources come in order of limit over weight, so one pass finds the fixed point.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    df = sizes.withColumn("w", (rank - 1) % 3 + 1).withColumn("limit", F.col("source_size") * MOST_TIMES)
    before = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.partitionBy()
    total = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight = F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0))
    df = df.withColumn("level", total / weight)
    df = df.withColumn("full", F.col("level") * F.col("w") > F.col("limit"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("w"), F.col("level")))).over(everywhere)["level"]
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("w"))
    return df.select("source", "source_size", target.alias("target"))


def offset(seed: str) -> Column:
    """The random number in [0, 1) of the seed and the source."""
    name = F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def crossed(start: Column, expected: Column) -> Column:
    """Integers above start and up to start + expected."""
    return F.floor(start + expected) - F.floor(start)


def expectations(classes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """(source, _class, start, rate, source_size, target): offset and running sum before a class, and the expected copies of each of its documents."""
    listed = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.negative("_class").alias("c"), "n", "words"))).alias("classes"))
    met = same_cell(listed, targets, ("source",)).withColumn("u", offset(seed))
    none = F.array().cast("array<struct<_class: int, start: double, rate: double>>")
    begin = F.struct(F.col("target").cast("double").alias("left"), F.col("source_size").cast("long").alias("words"), F.col("u").alias("at"), none.alias("out"))

    def after(done: Column, c: Column) -> Column:
        rate = F.when(done["words"] > 0, F.least(F.lit(float(MOST_TIMES)), F.greatest(F.lit(0.0), done["left"] / done["words"]))).otherwise(0.0)
        taken = crossed(done["at"], c["n"] * rate).cast("double") * c["words"] / c["n"]
        one = F.struct(F.negative(c["c"]).alias("_class"), done["at"].alias("start"), rate.alias("rate"))
        return F.struct((done["left"] - taken).alias("left"), (done["words"] - c["words"]).alias("words"), (done["at"] + c["n"] * rate).alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    met = met.select("source", "source_size", "target", F.explode(F.aggregate("classes", begin, after, lambda x: x["out"])).alias("c"))
    return met.select("source", "c.*", "source_size", "target")


def ranked(sized: DataFrame, starts: DataFrame) -> DataFrame:
    """sized with _place (from 1 within source and class) and the columns that starts has of the cell.

    One key that is never null names the cell, so that the ranks and the join share one exchange.
    """
    cell = F.concat_ws("|", F.col("_class").cast("string"), "_bucket", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    out = sized.withColumn("_cell", cell)
    out = out.withColumn("_in_cell", F.row_number().over(W.partitionBy("_cell").orderBy("size", "doc_id")))
    out = out.join(starts.withColumn("_cell", cell).drop(*CELL), "_cell", "left")
    return out.withColumn("_place", F.col("_in_cell") + F.col("before")).drop("_in_cell", "before", "_cell")


def mix(docs: DataFrame, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """docs with size (`size`, or the words of text), source_size, target and copies."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    own = [c for c in docs.columns if c not in ADDED]
    size = F.coalesce(size, F.lit(0)).cast("long") if size is not None else n_words("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), "doc_id", "source", size.alias("size"))
    rows = rows.withColumns({"_class": size_class(F.col("size")), "_bucket": F.substring(key, 1, DIGITS)})
    cells = staged(rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    classes = staged(cells.groupBy("source", "_class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_class = staged(expectations(classes, targets, seed), "mix-expectations")
    # before a cell: the parts of its class before its own, 16 at most, and in its part the cells before it, 256 at most
    cells = cells.withColumn("_part", F.substring("_bucket", 1, 1))
    inside = W.partitionBy(*PART).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = cells.groupBy(*PART).agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("source", "_class").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = staged(parts.withColumn("parts_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "mix-parts")
    starts = cells.withColumn("in_part", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n", "words")
    starts = same_cell(starts, parts, PART).withColumn("before", F.col("in_part") + F.col("parts_before")).drop("in_part", "parts_before", "_part")
    starts = staged(same_cell(starts, by_class, ("source", "_class")), "mix-starts")
    out = ranked(rows, starts)
    so_far = F.col("start") + (F.col("_place") - 1) * F.col("rate")
    copies = F.floor(F.col("start") + F.col("_place") * F.col("rate")) - F.floor(so_far)
    return out.select("_row.*", "size", "source_size", "target", copies.cast("long").alias("copies"))


def same_cell(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join on null-safe keys; right gives its other columns."""
    right = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"{k}_r"])
    return left.join(right, on, "left").drop(*(f"{k}_r" for k in keys))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, numbered from 0 in `copy` (with underscores before it while docs has such a column)."""
    number = "copy"
    while number in docs.columns:
        number = f"_{number}"
    rows = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"))
    out = mix(rows, seed).filter(F.col("copies") > 0).select("_own", "copies")
    return out.select("_own.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias(number))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("n"))
    return mix(staged(docs, "mix-sizes"), size=F.col("n")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sized AS (SELECT doc_id, source, size, len(bin(size)) AS bits, substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))), 1, {DIGITS}) AS bucket FROM base),
classed AS (SELECT *, bits * 8 + ((size >> greatest(bits - 4, 0)) & 7) AS class FROM sized),
ranked AS (SELECT doc_id, source, size, class, row_number() OVER (PARTITION BY source, class ORDER BY bucket, size, doc_id) AS place FROM classed),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, {MOST_TIMES} * source_size AS cap FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS DOUBLE) AS level
  FROM weighed WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, level * w > cap AS is_full FROM levels),
targets AS (
  SELECT i, source, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE)
      ELSE (SELECT level FROM filled WHERE NOT is_full ORDER BY cap / w, source NULLS LAST LIMIT 1) * w END AS target,
    CAST(CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(source, 'null'))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM filled),
classes AS (
  SELECT i, class, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (PARTITION BY i ORDER BY class DESC) AS k
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source GROUP BY i, class),
walk(i, k, class, start, rate, rest, words, after) AS (
  SELECT i, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), target, source_size, u FROM targets
  UNION ALL
  SELECT i, k, class, after, rate, rest - CAST(floor(after + n * rate) - floor(after) AS DOUBLE) * w / n, words - w, after + n * rate
  FROM (SELECT c.i, c.k, CAST(c.class AS BIGINT) AS class, c.n, c.words AS w, walk.after, walk.rest, walk.words,
      CASE WHEN walk.words > 0 THEN least({MOST_TIMES}.0, greatest(CAST(0 AS DOUBLE), walk.rest / walk.words)) ELSE CAST(0 AS DOUBLE) END AS rate
    FROM walk JOIN classes AS c ON c.i = walk.i AND c.k = walk.k + 1))
SELECT doc_id, size, source_size, target, CAST(floor(start + place * rate) - floor(start + (place - 1) * rate) AS BIGINT) * size AS taken
FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source JOIN walk ON walk.i = targets.i AND walk.class = ranked.class
"""
