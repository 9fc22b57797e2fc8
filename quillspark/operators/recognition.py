"""Recognition metrics over (document_id, line_id, ord, ground_truth, prediction)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.udfs import long_edits, long_token_edits

REQUIRED = ("document_id", "ground_truth", "line_id", "prediction")
LEVELS = ("word", "line", "document")
#: Characters from which on texts are long to compare.
LONG = 64
#: name -> factory of an aggregate over normalised `l` and `r` and their edit distances `e` in characters and `te` in words.
METRICS: dict[str, Callable[[], Column]] = {}


def register_metric(name: str, metric: Callable[[], Column]) -> None:
    METRICS[name] = metric


def ratio(total: Column, size: Column) -> Column:
    """Micro average; 0 where there is nothing to divide by."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0.0).otherwise(total / size)


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def near_perfect(k: int = 1) -> Column:
    return mean(T.within("l", "r", k))


register_metric("ema", lambda: mean(F.col("l") == F.col("r")))
register_metric("near_perfect_match", near_perfect)
register_metric("cer", lambda: ratio(F.sum("e"), F.sum(F.length("l"))))
register_metric("wer", lambda: ratio(F.sum("te"), F.sum(F.size(T.tokens("l")))))
register_metric("levenshtein_distance", lambda: mean(F.col("e")))


def at_level(df: DataFrame, level: str) -> DataFrame:
    """Pairs (l, r, e, te) of a level: rows, or texts joined in row order by line or document, and their edit distances.

    Row order is `ord`; without that column, the order of the rows as they are read. Joined
    texts are few bytes but long to compare, so they are dealt out anew.
    """
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    if "ord" not in df.columns:
        df = df.withColumn("ord", F.monotonically_increasing_id())
    df = df.select(*REQUIRED, "ord", T.normalize("ground_truth").alias("l"), T.normalize("prediction").alias("r"))
    if level != "word":
        keys = ["document_id", "line_id"] if level == "line" else ["document_id"]
        order = [F.col("ord")]
        df = df.groupBy(*keys).agg(T.in_order(order, F.col("l"), " ").alias("l"), T.in_order(order, F.col("r"), " ").alias("r"))
        spark = df.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        df = df.select(T.normalize("l").alias("l"), T.normalize("r").alias("r")).repartition(tasks, "l", "r")
    return compared(df.select("l", "r"))


def compared(df: DataFrame) -> DataFrame:
    """df (l, r and what else it has) with their edit distances `e` and `te`.

    Short texts are compared by expressions; long ones, where these would fill a table of
    distances, by bit vectors in Python, which sees nulls for the others.
    """
    long = F.greatest(F.length("l"), F.length("r")) > LONG
    l, r = (F.when(long & (F.col("l") != F.col("r")), F.col(c)) for c in "lr")
    short = lambda d: F.when(F.col("l") == F.col("r"), F.lit(0)).when(~long, d)
    words = T.token_edits(T.tokens("l"), T.tokens("r"))
    return df.withColumns({"e": F.coalesce(short(T.edits("l", "r")), long_edits(l, r)), "te": F.coalesce(short(words), long_token_edits(l, r))})


def evaluate(df: DataFrame, level: str = "word", metrics: list[str] | None = None) -> DataFrame:
    """One row: level, count and the metrics, in one aggregate."""
    names = metrics or list(METRICS)
    pairs = at_level(df, level)
    return pairs.agg(F.count("*").alias("count"), *(METRICS[n]().alias(n) for n in names)).select(F.lit(level).alias("level"), "*")


def report(df: DataFrame, levels: tuple[str, ...] = LEVELS, metrics: list[str] | None = None) -> DataFrame:
    """A row for each level."""
    out = evaluate(df, levels[0], metrics)
    for level in levels[1:]:
        out = out.unionByName(evaluate(df, level, metrics))
    return out


def long_form(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, key, value) of numeric columns."""
    values = [c for c in df.columns if c not in ids]
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(ids, values, "key", "value")


def timing(df: DataFrame, seconds: str = "seconds", samples: str = "samples") -> DataFrame:
    total, n = F.coalesce(F.sum(seconds), F.lit(0.0)), F.coalesce(F.sum(samples), F.lit(0))
    return df.agg(total.alias("total_s"), n.alias("n")).select(
        "total_s", F.when(F.col("n") > 0, F.col("total_s") / F.col("n")).otherwise(0.0).alias("s_per_sample"),
        F.when(F.col("total_s") > 0, F.col("n") / F.col("total_s")).otherwise(0.0).alias("samples_per_s"), "n",
    )
