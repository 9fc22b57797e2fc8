"""Experiment matrix: jobs as rows, their commands and artifacts, and a runner that leaves out what is done."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Checkpoint to evaluate, by framework, and that of all others (fixed values).
CHECKPOINTS = {"ultralytics": "train/weights/best.pt", "detectron2": "model_final.pth", "kraken": "model_best.mlmodel"}
OTHER_CHECKPOINT = "train/weights/best.pt"
#: Ports of the recogniser services on the local machine (fixed values).
PORTS = {
    "easyocr": 8001, "trocr": 8002, "paddleocr": 8003, "parseq": 8004, "calamari": 8005, "rysocr": 8006,
    "tesseract_pol": 8007, "surya": 8008, "got_ocr": 8009, "qwen2_5_vl": 8010, "kraken": 8011, "glm_4v": 8012,
}
#: Seconds that a service may take, where its model is long to load, and otherwise (fixed values).
TIMEOUTS, TIMEOUT = {"qwen2_5_vl": 3600.0, "kraken": 600.0, "glm_4v": 1800.0}, 60.0
MODEL = "model string, place int, service string, weights string, finetune boolean, zeroshot boolean, lr0 double, data_format string, train_flags array<string>"
VARIANT = "variant string, at int, yolo string, images_root string, pagexml string"


def load_config(path: str) -> dict:
    import yaml

    with open(path.removeprefix("file:"), encoding="utf-8") as f:
        return yaml.safe_load(f)


def safe(name: str | None) -> str:
    """A name of A-Z, a-z, 0-9, dot, underscore and hyphen; `unnamed` if nothing is left."""
    return re.sub("_+", "_", re.sub(r"[^A-Za-z0-9._-]", "_", (name or "").strip())).strip("_") or "unnamed"


def enabled(entries: list[dict]) -> list[dict]:
    """Entries that are not switched off."""
    return [e for e in entries if e.get("enabled", True)]


def sample_limit(entry: dict) -> int | None:
    """A data set without a limit takes one sample, one with a null limit all."""
    return entry.get("limit", 1)


def base_url(model: str, given: str = "") -> str:
    return given.rstrip("/") if given else f"http://localhost:{PORTS[model]}"


def timeout(model: str, given: float | None = None) -> float:
    return TIMEOUTS.get(model, TIMEOUT) if given is None else float(given)


def service_options(model: str, flags: dict) -> dict:
    """The options of a model's service among flat flags `<model>_<option>`; languages are a list."""
    prefix = f"{model}_"
    own = {k.removeprefix(prefix): v for k, v in flags.items() if k.startswith(prefix)}
    return {k: languages(v) if k == "langs" and isinstance(v, str) else v for k, v in own.items()}


def service_entry(model: str, flags: dict) -> dict:
    """A model's entry of a config from flat flags: where its service is, how long it may take, and its options."""
    return {"id": model, "base_url": base_url(model, flags.get("http_base_url") or ""), "timeout": timeout(model, flags.get("http_timeout")), "options": service_options(model, flags)}


def languages(text: str) -> list[str]:
    """Languages of a comma-separated list; Polish if there are none."""
    return [x for x in map(str.strip, text.split(",")) if x] or ["pl"]


def as_bool(value: object, default: bool = False) -> bool:
    """Truth of an option: the usual words for yes in a text, the default for none."""
    if isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "y", "on")
    return default if value is None else bool(value)


def device(name: str, has_gpu: bool, must: bool = True) -> str:
    """`cuda` or `cpu`; `auto` takes the GPU and, where one must be, is an error without."""
    wanted = name.strip().lower()
    if wanted == "cpu" or (wanted == "auto" and not has_gpu and not must):
        return "cpu"
    if wanted not in ("auto", "cuda"):
        raise ValueError(f"unknown device: {name}")
    if not has_gpu:
        raise RuntimeError(f"device {wanted} asks for a GPU")
    return "cuda"


def number_type(name: str, has_gpu: bool = False, has_bfloat: bool = False) -> str:
    wanted = name.strip().lower()
    if wanted in ("float16", "bfloat16", "float32"):
        return wanted
    return ("bfloat16" if has_bfloat else "float16") if has_gpu else "float32"


def detector_family(weights: Column) -> Column:
    """Which trainer a weight file needs, by its name."""
    return F.when(F.lower(weights).contains("rtdetr"), "rtdetr").otherwise("yolo")


def checkpoint(service: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CHECKPOINTS.items() for x in pair])
    return F.coalesce(table[F.coalesce(service, F.lit("ultralytics"))], F.lit(OTHER_CHECKPOINT))


def config_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Models and data variants of a config as tables, in the order of the config."""
    d = config.get("defaults", {})
    models = [
        (name, i, m.get("service", "ultralytics"), m.get("weights"), as_bool(m.get("finetune")), as_bool(m.get("zeroshot")), m.get("lr0", d.get("lr0")), m.get("data_format", "yolo"), m.get("train_flags", d.get("train_flags", [])))
        for i, (name, m) in enumerate(config["models"].items())
    ]
    variants = [(name, i, v.get("yolo"), v.get("images_root"), v.get("pagexml")) for i, (name, v) in enumerate(config["data"].items())]
    return spark.createDataFrame(models, MODEL).coalesce(1), spark.createDataFrame(variants, VARIANT).coalesce(1)


def matrix(spark: SparkSession, config: dict, results: str = "results") -> DataFrame:
    """Jobs of a config (models, data), numbered in `ord`: each model's trainings, each followed by a prediction and an evaluation on every variant."""
    models, variants = config_tables(spark, config)
    at = variants.select(F.col("variant").alias("on"), F.col("at").alias("on_at"), F.col("images_root").alias("on_root"))
    tuned = models.filter("finetune").crossJoin(F.broadcast(variants)).withColumn("run", F.concat_ws("_ft-", "model", "variant"))
    trained = F.concat_ws("/", F.lit(results), F.lit("checkpoints"), "run", checkpoint(F.col("service")))
    plain = models.filter("zeroshot").withColumns({"run": F.concat("model", F.lit("_zeroshot")), "at": F.lit(1 << 30)})
    own = ["place", "at", "model", "service"]
    train = tuned.select(*own, F.lit(-1).alias("on_at"), F.lit("train").alias("kind"), F.col("run").alias("exp_id"), "weights", "images_root", F.col("yolo").alias("data_yaml"), "pagexml")
    runs = tuned.select(*own, "run", trained.alias("weights")).unionByName(plain.select(*own, "run", "weights")).crossJoin(F.broadcast(at))
    runs = runs.withColumn("exp_id", F.concat_ws("_eval-", "run", "on"))
    predict = runs.select(*own, "on_at", F.lit("predict").alias("kind"), "exp_id", "weights", F.col("on_root").alias("images_root"))
    evaluate = runs.select("place", "at", "model", "on_at", F.lit("eval").alias("kind"), "exp_id")
    jobs = train.unionByName(predict, True).unionByName(evaluate, True)
    order = F.row_number().over(W.orderBy("place", "at", "on_at", F.desc("kind")))  # as many rows as the config has jobs
    return jobs.withColumn("ord", order).drop("place", "at", "on_at")


def selected(jobs: DataFrame, only: str | None = None, stage: str | None = None) -> DataFrame:
    """Jobs whose id holds `only` and whose kind is `stage`."""
    jobs = jobs.filter(F.col("exp_id").contains(only)) if only else jobs
    return jobs.filter(F.col("kind") == stage) if stage else jobs


def artifact(results: str = "results") -> Column:
    """The file that a job leaves behind."""
    path = lambda *parts: F.concat_ws("/", F.lit(results), *parts)
    return F.when(F.col("kind") == "train", path(F.lit("checkpoints"), F.col("exp_id"), checkpoint(F.col("service")))).when(
        F.col("kind") == "predict", path(F.lit("predictions"), F.col("exp_id"), F.lit("predictions.json"))
    ).otherwise(path(F.lit("metrics"), F.concat("exp_id", F.lit(".json"))))


def todo(jobs: DataFrame, present: DataFrame, results: str = "results") -> DataFrame:
    """Jobs whose artifact is not among the paths (path) that are present."""
    return jobs.withColumn("_artifact", artifact(results)).join(present.select(F.col("path").alias("_artifact")), "_artifact", "left_anti").drop("_artifact")


def commands(jobs: DataFrame, config: dict, local: bool = False, results: str = "results") -> DataFrame:
    """jobs with `argv`: a model's own learning rate and flags go before the defaults; without `local`, models run in their containers."""
    d = config["defaults"]
    models, _ = config_tables(jobs.sparkSession, config)
    rows = jobs.join(models.select("model", "lr0", "data_format", "train_flags"), "model", "left")
    words = lambda *parts: F.array(*(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    under = lambda folder, tail="": F.concat(F.lit(f"{results}/{folder}/"), F.col("exp_id"), F.lit(tail))
    script = F.concat(F.lit("docker/"), F.col("service"), F.lit("/cli.py"))
    data = F.when(F.col("data_format") == "coco", words("--train-coco", config.get("train_coco"), "--val-coco", config.get("val_coco"), "--images-root", F.col("images_root")))
    data = data.when(F.col("data_format") == "pagexml", words("--data", F.col("pagexml"))).otherwise(words("--data", F.col("data_yaml")))
    rate = F.when(F.col("lr0").isNotNull(), words("--lr0", F.col("lr0").cast("string"))).otherwise(F.array().cast("array<string>"))
    train = F.concat(
        words("python", script, "train", "--weights", F.col("weights")), data, words("--out", under("checkpoints"), "--epochs", d.get("epochs"), "--imgsz", d.get("imgsz"), "--batch", d.get("batch")), rate, F.col("train_flags"),
    )
    predict = words("python", script, "predict", "--weights", F.col("weights"), "--coco", config.get("test_coco"), "--images-root", F.col("images_root"), "--out", under("predictions"), "--imgsz", d.get("imgsz"), *d.get("predict_flags", []))
    evaluate = words(
        "python", "evaluation/evaluate.py", "--gt", config.get("test_coco"), "--pred", under("predictions", "/predictions.json"), "--exp-id", F.col("exp_id"), "--out-dir", results, "--conf-thresh", d.get("conf_thresh"),
    )
    contained = words("docker", "compose", "run", "--rm", F.coalesce("service", F.lit("ultralytics")))
    inside = lambda argv: argv if local else F.concat(contained, argv)
    argv = F.when(F.col("kind") == "train", inside(train)).when(F.col("kind") == "predict", inside(predict)).otherwise(evaluate)
    return rows.withColumn("argv", argv).select(*jobs.columns, "argv")


def run(
    jobs: DataFrame, present: DataFrame, execute: Callable[[list[str]], int], force: bool = False, dry_run: bool = False,
    log: Callable[[str, str, str], object] | None = None, results: str = "results",
) -> dict[str, list[str]]:
    """Run jobs (with argv) in order: skip those whose artifact is present, go on after failures; ids by outcome, failures in the log too."""
    waiting = {(r.kind, r.exp_id) for r in (jobs if force else todo(jobs, present, results)).select("kind", "exp_id").collect()}
    out: dict[str, list[str]] = {"ok": [], "failed": [], "skip": [], "would": []}
    for job in jobs.orderBy("ord").collect():  # one row a job of the config
        if (job.kind, job.exp_id) not in waiting:
            state = "skip"
        elif dry_run:
            state = "would"
        else:
            try:
                state = "ok" if execute(list(job.argv)) == 0 else "failed"
            except OSError:
                state = "failed"
            if log:
                log(job.kind, job.exp_id, state)
        out[state].append(f"{job.kind} {job.exp_id}")
    return out
