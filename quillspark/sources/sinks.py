"""Writers of results.

Files that go one to a row are written by the executors, through pyarrow's file systems, so
that no row passes the driver and any store that it knows will do; a name is written anew
when a task is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.detection import SUMMARY


def result_tree(predictions: DataFrame, path: str, keys: tuple[str, ...] = ("model_id", "dataset_id")) -> None:
    """Predictions under <key>=<value> folders, which readers can prune by."""
    predictions.write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


def append_summary(row: DataFrame, path: str, columns: list[str]) -> None:
    """Append rows with exactly these columns; others are dropped, missing ones stay empty."""
    row.select(*(F.col(c) if c in row.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("append").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fan_out(*sinks: Callable[[DataFrame], None] | None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to every sink that is not None, computed once."""
    used = [s for s in sinks if s]

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for sink in used:
                sink(batch)
        finally:
            batch.unpersist()

    return write


def files(df: DataFrame, path: str, name: str = "name", body: str = "text") -> int:
    """Write `body` (text or bytes) of each row to the file `name` under path; how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made = set()
        n = 0
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{file}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(content or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.col(name).alias("name"), F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary")).alias("body"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def one_file(spark: SparkSession, path: str, name: str, text: str) -> str:
    files(spark.createDataFrame([(name, text)], "name string, text string"), path)
    return f"{path}/{name}"


def yolo_data_set(images: DataFrame, gt: DataFrame, path: str, split: str) -> int:
    """Label files of a split, one for each image, and the description of the data set; stems must differ."""
    from quillspark.operators import datasets

    n = files(datasets.yolo_files(datasets.unique_stems(images), gt), f"{path}/labels/{split}")
    one_file(images.sparkSession, path, "data.yaml", datasets.DATA_YAML)
    return n


def page_images(made: DataFrame, path: str) -> int:
    """Preprocessed pages (path, status, content, comparison) as `<stem>.png`, those with a comparison as `compare/<stem>_compare.png` too."""
    from quillspark.functions import text as T

    good = made.filter("status = 'ok'").withColumn("stem", T.stem("path"))
    beside = good.filter("comparison IS NOT NULL")
    out = good.select(F.concat("stem", F.lit(".png")).alias("name"), "content")
    return files(out.unionByName(beside.select(F.concat(F.lit("compare/"), "stem", F.lit("_compare.png")).alias("name"), F.col("comparison").alias("content"))), path, body="content")


def page_files(images: DataFrame, gt: DataFrame, path: str) -> int:
    from quillspark.operators import datasets

    return files(datasets.page_xml(images, gt), path, body="xml")


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, most: int = 0) -> None:
    """images, annotations and categories as folders of JSON lines; as one document `path`.json if they are `most` rows at most."""
    parts = {"images": images, "annotations": annotations, "categories": categories}
    if sum(df.limit(most + 1).count() for df in parts.values()) <= most:
        whole = {k: [json.loads(r) for r in df.toJSON().collect()] for k, df in parts.items()}
        folder, name = path.rsplit("/", 1)
        one_file(images.sparkSession, folder, f"{name}.json", json.dumps(whole))
        return
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def data_sets(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, most: int = 0, **split: object) -> dict[str, int]:
    """Train, val and test sets (see `datasets.data_sets`) as instances_<name> under path; the images of each."""
    from quillspark.operators import datasets

    out = {}
    for name, part in datasets.data_sets(images, **split).items():
        coco_document(part, datasets.subset(annotations, part), categories, f"{path}/instances_{name}", most)
        out[name] = part.count()
    return out


def predictions(df: DataFrame, path: str, meta: dict) -> None:
    """predictions (rows in results format) and meta.json."""
    df.write.mode("overwrite").json(f"{path}/predictions")
    one_file(df.sparkSession, path, "meta.json", json.dumps(meta))


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def iso_now(now: datetime | None = None) -> str:
    return (now or datetime.now()).isoformat(timespec="seconds")


def run_folder(spark: SparkSession, path: str, name: str, config: dict, now: datetime | None = None) -> str:
    """A new folder `<name>_<stamp>` with the configuration in meta.yaml; its path."""
    import yaml

    from quillspark.operators.experiments import safe

    folder = f"{path}/{safe(name)}_{stamp(now)}"
    one_file(spark, folder, "meta.yaml", yaml.safe_dump(config, sort_keys=False))
    return folder


def outputs(results: DataFrame, report: dict, path: str, now: datetime | None = None) -> tuple[str, str]:
    """results_<stamp> (CSV) and summary_<stamp>.json."""
    at = stamp(now)
    results.write.mode("overwrite").option("header", True).csv(f"{path}/results_{at}")
    return f"{path}/results_{at}", one_file(results.sparkSession, path, f"summary_{at}.json", json.dumps(report, ensure_ascii=False, indent=2))


def data_set_results(results: DataFrame, summary: dict, folder: str, model: str, data_set: str) -> str:
    """<folder>/<model>/<data set>: raw predictions (CSV) and summary_metrics.json."""
    from quillspark.operators.experiments import safe

    path = f"{folder}/{safe(model)}/{safe(data_set)}"
    results.write.mode("overwrite").option("header", True).csv(f"{path}/raw_predictions")
    one_file(results.sparkSession, path, "summary_metrics.json", json.dumps(summary, indent=2))
    return path


def evaluation(report: DataFrame, exp_id: str, out: str, meta: DataFrame | None = None) -> None:
    """metrics/<exp_id>.json with the overall block and one for each source, and a row of the summary."""
    from quillspark.operators.detection import summary_row

    rows = [r.asDict() for r in report.collect()]  # a row for each source
    block = lambda r: {k: v for k, v in r.items() if k not in ("source", "conf_thresh")}
    overall = next(block(r) for r in rows if r["source"] is None)
    cost = meta.filter(F.col("exp_id") == exp_id).first() if meta is not None else None
    overall |= {k: v for k, v in (cost.asDict() if cost else {}).items() if k != "exp_id" and v is not None}
    result = {"conf_thresh": rows[0]["conf_thresh"], "overall": overall, "per_source": {r["source"]: block(r) for r in rows if r["source"] is not None}}
    one_file(report.sparkSession, f"{out}/metrics", f"{exp_id}.json", json.dumps(result, indent=2))
    append_summary(summary_row(report, exp_id, meta), f"{out}/summary", list(SUMMARY))


def run_log(spark: SparkSession, path: str, kind: str, exp_id: str, status: str, now: datetime | None = None) -> bool:
    """Append a row to the log of runs; a log that cannot be written stops nothing."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JError

    try:
        row = spark.createDataFrame([(iso_now(now), kind, exp_id, status)], "timestamp string, kind string, exp_id string, status string")
        row.coalesce(1).write.mode("append").option("header", True).csv(path)
    except (PySparkException, Py4JError):
        return False
    return True
