"""URL verdicts from fixed rules and from association rules, with DataFrame functions only.

FP-growth over the tokens of labelled URLs finds frequent combinations; those that stand
with the label "bad" often enough, and with enough confidence, become rules. A rule is
posted once, under its rarest token; a URL meets the rules posted under its own tokens,
and a rule holds when the URL has all of its tokens. Rules made of common tokens only are
rare, so hot hosts meet few rules. The longest fixed rule that fits goes first.

Labels: a page is bad when `labels` has it (by id) with quality 0 or toxic 1; pages
without labels teach nothing. Rules are pruned by support and confidence, whatever their
length. A URL's verdict is the same for all rows that hold it. Nulls: a null URL, or one without "://", has empty host and
path, no tokens and the verdict allow. Repeated rows are judged each; of repeated labels
the bad one counts. Extra columns are not read, whatever they are called. Without labels there are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BAD = "label=bad"
SUPPORT, CONFIDENCE = 0.005, 0.6


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of the whole URL: host=<label> for each label of the host, path=, query= and part=<run> for each run of letters and digits after it."""

    def named(kind: str, text: Column, parting: str) -> Column:
        return F.transform(F.filter(F.split(text, parting), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    rest = lambda pattern: F.lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")))
    runs = r"[^\p{L}\p{N}]+"
    parts = (
        named("host=", host(url), r"\."), named("path=", F.lower(path(url)), runs),
        named("query=", rest(r"://[^?#]*\?([^#]*)"), runs), named("part=", rest(r"://[^#]*#(.*)"), runs),
    )
    return F.array_distinct(F.concat(*parts))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(items, confidence, support) from (tokens, bad)."""
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets.filter(F.size("items") > 0)).freqItemsets
    found = staged(found.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    bad = found.filter(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("n_bad"))
    rules = bad.filter(F.size("items") > 0).join(found, "items").withColumn("confidence", F.col("n_bad") / F.col("freq"))
    return rules.filter(F.col("confidence") >= confidence).select("items", "confidence", F.col("n_bad").alias("support"))


def posted(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """(token, items, confidence): each rule under its rarest token."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    each = rules.select("items", "confidence", F.explode("items").alias("token")).join(counts, "token")
    return each.groupBy("items", "confidence").agg(F.min_by("token", F.struct("df", "token")).alias("token"))


def url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the best mined rule that holds, else null)."""
    h, p = host(F.col("url")), path(F.col("url"))
    parts = pages.select("page_id", h.alias("host"), p.alias("path"), tokens(F.col("url")).alias("tokens"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = staged(parts.join(marks.filter("bad IS NOT NULL"), "page_id").select("tokens", "bad"), "url-labelled")
    index = staged(posted(mined_rules(labelled), labelled), "url-rules")
    each = parts.withColumn("row", F.monotonically_increasing_id())
    each = each.select("*", F.explode_outer("tokens").alias("token")).join(index, "token", "left")
    holds = F.col("items").isNotNull() & (F.size(F.array_except("items", "tokens")) == 0)
    best = each.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max(F.when(holds, F.col("confidence"))).alias("confidence")
    )
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return best.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_filter(pages.select("page_id", "url"), labels).drop("confidence")


def _fits_sql() -> str:
    rows = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = (" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{x}'" for h, p, v in rows for x in ((h + p) if k else v,)) for k in (1, 0))
    return f"CASE {rule} END AS rule, CASE {verdict} END AS fixed"


#: Every subset of every basket is counted, which is slow but says the same as FP-growth.
ORACLE = f"""
WITH parts AS (
  SELECT row_number() OVER () AS id, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '') AS query,
    coalesce(regexp_extract(url, '://[^#]*#(.*)', 1), '') AS part FROM pages),
held AS (
  SELECT id, page_id, host, path, list_sort(list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x)
    || list_transform(list_filter(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: 'path=' || x)
    || list_transform(list_filter(string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: 'query=' || x)
    || list_transform(list_filter(string_split_regex(lower(part), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: 'part=' || x))) AS tokens FROM parts),
marks AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id HAVING bool_or(quality = 0 OR toxic = 1) IS NOT NULL),
baskets AS (SELECT tokens, bad FROM held JOIN marks ON doc_id = page_id WHERE bad OR len(tokens) > 0),
subsets AS (
  SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, bad FROM (SELECT tokens, bad, unnest(range(1, 1 << len(tokens))) AS m FROM baskets)),
rules AS (
  SELECT items FROM subsets GROUP BY items
  HAVING count(*) FILTER (bad) >= greatest(1, ceil({SUPPORT} * (SELECT count(*) FROM baskets))) AND count(*) FILTER (bad) >= {CONFIDENCE} * count(*)),
met AS (
  SELECT DISTINCT id FROM (SELECT id, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT id, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM held))
  SEMI JOIN rules USING (items)),
judged AS (SELECT held.*, met.id IS NOT NULL AS mined, {_fits_sql()} FROM held LEFT JOIN met ON met.id = held.id)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN mined THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
