"""Pivots, keys and rows of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.experiments import safe

PREFERRED = ("ema", "near_perfect_match", "cer", "wer", "levenshtein_distance")
#: How metrics are called in tables (fixed values).
LABELS = {"ema": "EMA", "near_perfect_match": "NPM", "cer": "CER", "wer": "WER", "levenshtein_distance": "LevDist"}
REPORT = "model string, created_at string, dataset_id string, metrics map<string, map<string, double>>, timing map<string, double>"


def metric_keys(found: Column) -> Column:
    """Preferred keys that were found, in their order, then the others sorted; count and level are none."""
    wanted = F.array(*map(F.lit, PREFERRED))
    rest = F.array_sort(F.array_except(found, F.concat(wanted, F.array(F.lit("count"), F.lit("level")))))
    return F.concat(F.filter(wanted, lambda k: F.array_contains(found, k)), rest)


def metric_label(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(table[key], key)


def at_level(metrics: Column, level: str) -> Column:
    """The metrics of a level out of a map by level; where it has none, those of the first level that is there."""
    found = F.try_element_at(metrics, F.lit(level))
    return F.when(F.size(found) > 0, found).otherwise(F.get(F.map_values(metrics), F.lit(0)))


def payload(long: DataFrame, model: str, data_set: str, level: str) -> DataFrame:
    """(key, value) under model/data set for (part, key, value), part being metrics or timing, and the level that was measured."""
    prefix = f"{model}/{data_set}"
    rows = long.select(F.concat_ws("/", F.lit(prefix), "part", "key").alias("key"), F.col("value").cast("string").alias("value"))
    return rows.unionByName(long.sparkSession.createDataFrame([(f"{prefix}/metrics_level", level)], "key string, value string"))


def as_json(evaluated: DataFrame, model: str, created_at: Column | None = None) -> DataFrame:
    """One row `report`: model, time and the metrics of each level of `recognition.report`, as JSON."""
    names = [c for c in evaluated.columns if c != "level"]
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if created_at is None else created_at
    by_level = evaluated.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", values.alias("v"))), _by_level)).alias("metrics"))
    return by_level.select(F.to_json(F.struct(F.lit(model).alias("model"), now.alias("created_at"), "metrics")).alias("report"))


def _by_level(a: Column, b: Column) -> Column:
    return F.when(a["level"] < b["level"], -1).when(a["level"] > b["level"], 1).otherwise(0)


def from_json(report: Column) -> Column:
    return F.from_json(report, REPORT)


def latex_table(data_set: str, models: list[str], found: dict[str, tuple[dict, float | None]]) -> str:
    """The table of a data set: a row for each model, a column for each metric that some model has, and the time of a sample."""
    keys = [k for k in PREFERRED if any(k in m for m, _ in found.values())]
    keys += sorted({k for m, _ in found.values() for k in m} - {*PREFERRED, "count", "level"})
    row = lambda cells: " & ".join(cells) + r" \\"
    body = []
    for model in models:
        metrics, seconds = found.get(model, ({}, None))
        body.append(row([T.latex(model), *(T.four_decimals(metrics.get(k)) for k in keys), T.four_decimals(seconds)]))
    head = row(["Model", *(T.latex(LABELS.get(k, k)) for k in keys), "AvgTimeS"])
    lines = [
        r"\begin{table}[ht]", r"\centering", rf"\caption{{{T.latex(f'Wyniki dla datasetu {data_set}')}}}", rf"\label{{{T.latex(f'tab:{safe(data_set)}')}}}",
        rf"\begin{{tabular}}{{l{'r' * (len(keys) + 1)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}",
    ]
    return "\n".join(lines) + "\n"


def pivoted(long: DataFrame, row: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """A row for each `row`, a column for each of the keys; the keys are given, so no pass looks for them."""
    return long.groupBy(row).pivot(key, keys).agg(F.first(value))


def latex_rows(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    cells = [T.latex_escape(name), *(T.format_number(v) for v in values)]
    return df.select(name, F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def loss_rollup(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, val_loss, map, map50): losses summed and rounded; the longer mAP key is told first."""
    key = F.col("key")
    total = lambda when: F.sum(F.when(when, F.col("value")))
    is_map = key.contains("mAP50-95")
    return df.groupBy(*ids).agg(
        F.round(F.coalesce(total(key.contains("loss")), F.lit(0.0)), 5).alias("val_loss"),
        F.max(F.when(is_map, F.col("value"))).alias("map"), F.max(F.when(key.contains("mAP50") & ~is_map, F.col("value"))).alias("map50"),
    )


def train_loss(df: DataFrame, parts: list[str]) -> DataFrame:
    """df with `train_loss`, the sum of its parts, to five digits."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.col(part)
    return df.withColumn("train_loss", F.round(total, 5))


def status_counts(df: DataFrame, states: tuple[str, ...] = ("ok", "skip", "error"), column: str = "status") -> DataFrame:
    """One row: how many rows have each state."""
    return df.agg(*(F.count_if(F.col(column) == s).alias(s) for s in states))


def latency(value: str) -> list[Column]:
    return [F.coalesce(F.avg(value), F.lit(0.0)).alias("ms_mean"), F.coalesce(F.median(value), F.lit(0.0)).alias("ms_median")]


def plain_field(value: object) -> str:
    """A field of a log event: lists in brackets, maps in braces by sorted key, texts on one line."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain_field(value[k])}" for k in sorted(value, key=str)) + "}"
    if isinstance(value, list | tuple | set):
        return "[" + ",".join(map(plain_field, value)) + "]"
    return str(value).replace("\n", " ").strip()


def event_line(event: str, request_id: str | None = None, **fields: object) -> str:
    """`event=… request_id=… key=value` with sorted keys; None is left out, nested values are flattened."""
    first = [("event", event), ("request_id", request_id)] if request_id else [("event", event)]
    return " ".join(f"{k}={plain_field(v)}" for k, v in [*first, *sorted(fields.items())] if v is not None)


def log_event(event: Column, fields: Column) -> Column:
    """`event=… key=value` with sorted keys; null values are left out."""
    kept = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull())))
    return F.concat_ws(" ", F.concat(F.lit("event="), event), F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "))
