"""The recognition benchmark: every model on every data set, with failures as rows, and its tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.udfs import Loader, recognise
from quillspark.operators import recognition, reporting
from quillspark.operators.experiments import enabled, safe, sample_limit
from quillspark.sources import readers, sinks

OUTCOME = "model string, data_set string, status string, detail string"


def level_of(data_set: dict) -> str:
    return "word" if data_set.get("single_words", False) else "line"


def timing_of(seconds: float, samples: int) -> dict:
    return {
        "prediction_seconds_total": float(seconds), "prediction_seconds_per_sample": seconds / samples if samples else 0.0,
        "prediction_throughput_samples_per_sec": samples / seconds if seconds > 0 else 0.0, "prediction_samples": samples,
    }


def load_samples(spark: SparkSession, data_set: dict) -> DataFrame:
    """Samples of a data set of a config, as many as it allows; none at all is an error."""
    labels = readers.labels_csv(spark, data_set["labels_csv"])
    found = readers.samples(labels, readers.image_index(spark, data_set["images_dir"]), sample_limit(data_set))
    if found.isEmpty():
        raise ValueError("no samples: no label has an image")
    return found


def measure(samples: DataFrame, load: Loader, level: str, batch: int = 8) -> tuple[DataFrame, dict, dict]:
    """Recognised samples (kept, as they are read again), their metrics at a level, and the timing."""
    results = recognise(samples, load, batch, seconds=True).persist()
    metrics = recognition.evaluate(results, level).first().asDict()
    total = results.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"), F.count("*").alias("n")).first()
    return results.drop("seconds"), metrics, timing_of(total.s, total.n)


def run(
    spark: SparkSession, config: dict, load: Callable[[dict], Loader], out: str | None = None, now: datetime | None = None,
    samples: Callable[[SparkSession, dict], DataFrame] = load_samples, note: Callable[[dict], object] | None = None,
) -> tuple[str, DataFrame]:
    """Run a config; the folder of results and an outcome for each model and data set.

    `load` makes a recogniser's loader of a model's entry, and fails where its service
    is not well; that model is left out, and one data set that fails leaves out only
    itself. Nothing runs unless services start by themselves, one after the other.
    """
    settings = config.get("settings", {})
    folder = sinks.run_folder(spark, out or settings.get("output_dir", "wyniki"), config.get("experiment", {}).get("name", "Unnamed"), config, now)
    outcomes = []
    models = enabled(config.get("models", [])) if settings.get("auto_start_services", False) and settings.get("sequential", True) else []
    for model in models:
        try:
            recogniser = load(model)
        except Exception as e:  # noqa: BLE001  # whatever goes wrong in a service ends that service only
            outcomes.append((model["id"], None, "model failed", str(e)))
            continue
        for data_set in enabled(config.get("datasets", [])):
            level = level_of(data_set)
            try:
                results, metrics, timing = measure(samples(spark, data_set), recogniser, level)
                summary = {"model": model["id"], "created_at": sinks.iso_now(now), "metrics": {level: metrics}, "dataset_id": data_set["id"], "timing": timing}
                sinks.data_set_results(results, summary, folder, model["id"], data_set["id"])
                results.unpersist()
                if note:
                    note(payload(summary, level))
                outcomes.append((model["id"], data_set["id"], "ok", None))
            except Exception as e:  # noqa: BLE001
                outcomes.append((model["id"], data_set["id"], "data set failed", str(e)))
    if settings.get("export_overleaf_table", False):
        export_tables(spark, folder, config)
    return folder, spark.createDataFrame(outcomes, OUTCOME)


def payload(summary: dict, level: str) -> dict:
    """What a tracker is told of a summary, under flat keys."""
    prefix = f"{summary['model']}/{summary['dataset_id']}"
    parts = {"metrics": summary["metrics"].get(level, {}), "timing": summary["timing"]}
    return {f"{prefix}/metrics_level": level} | {f"{prefix}/{part}/{k}": v for part, values in parts.items() for k, v in values.items()}


def export_tables(spark: SparkSession, folder: str, config: dict, name: str = "overleaf_tables.tex") -> str:
    """A file with a table for each data set, from the summaries in the folder; models without one have n/a."""
    models = [str(m.get("id", "unnamed")) for m in enabled(config.get("models", []))]
    tables = []
    try:
        found = readers.summaries(spark, f"{folder}/*/*/summary_metrics.json")
        rows = found.select("model", "dataset_id", "metrics", F.element_at("timing", "prediction_seconds_per_sample").alias("seconds")).collect()  # one row a model and data set
    except Exception:  # noqa: BLE001  # no summary at all
        rows = []
    for data_set in enabled(config.get("datasets", [])):
        id_ = str(data_set.get("id", "unnamed"))
        of = {r.model: (_metrics(r.metrics, level_of(data_set)), r.seconds) for r in rows if safe(r.dataset_id) == safe(id_)}
        tables.append(reporting.latex_table(id_, models, of))
    return sinks.one_file(spark, folder, name, "\n".join(tables).strip() + "\n")


def _metrics(by_level: dict | None, level: str) -> dict:
    by_level = by_level or {}
    return {k: float(v) for k, v in (by_level.get(level) or next(iter(by_level.values()), {})).items() if k not in ("count", "level")}
