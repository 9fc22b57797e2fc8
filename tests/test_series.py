import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import images, udfs
from quillspark.operators import diagnostics, experiments, reporting
from quillspark.plans.registry import ORACLE_SQL, QUERIES
from quillspark.sources import readers, sinks
from quillspark.streaming import stateful


def series(spark, values):
    return spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run string, step long, value double")


def test_smoothing(spark):
    got = diagnostics.ema(series(spark, [1, float("nan"), 2, 3]), "run", ["step"], "value").orderBy("step").collect()
    assert [r.ema for r in got] == pytest.approx([1, 1.02, 1.0596])


@pytest.mark.parametrize("values", [[1.5, 0.0, 2.25, -3.5, 0.0, 4.0, 8.0, 0.5], [153.99, 206.64, 71.5, 11.7, 89.39, 40.03, 5.0, 0.93, 49.97, 46.73]], ids=["zero and negative", "halves"])
def test_ema_positive_is_its_sql(spark, tmp_path, values):
    """Each step of an id that 7 does not divide counts, whatever its value, and halves are rounded alike."""
    con = duckdb.connect()
    steps = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_seconds({i}), {r}, CAST({v} AS DOUBLE))" for r in (1, 2) for i, v in enumerate(values[r - 1 :], 1 + 700 * r))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {steps}) AS t(event_id, ts, user_id, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = QUERIES["ema_positive"](spark, str(tmp_path)).select("run", "event_id", "ema").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["ema_positive"]).fetchall())


def test_best(spark):
    got = diagnostics.best_so_far(series(spark, [0.5, 0.5, 0.4, 0.6]), "run", ["step"], "value").orderBy("step").collect()
    assert [r.improved for r in got] == [True, False, True, False]


def test_divergence_and_suggestion(spark):
    df = diagnostics.until_divergence(series(spark, [1] * 12 + [9, 9]), "run", "step", "value")
    assert df.count() == 13
    df = series(spark, [3, 1, 2]).select("run", "step", F.col("value").alias("ema"), (F.col("step") + 1).cast("double").alias("lr"))
    assert diagnostics.lr_suggestion(df, "run").first().suggested_lr == pytest.approx(0.2)
    assert diagnostics.lr_suggestion(df.limit(1), "run").first().suggested_lr is None


def test_vectors(spark):
    df = spark.createDataFrame([("r", 0, [1.0, 0.0]), ("r", 1, [0.0, 1.0]), ("r", 2, [0.0, 0.0])], "run string, step long, v array<double>")
    got = diagnostics.vector_steps(df, "run", "step", "v").orderBy("step").collect()
    assert [r["cosine"] for r in got] == [0, 0, 0] and got[1].update_norm == pytest.approx(2**0.5) and got[1].update_ratio == pytest.approx(2**0.5)
    m = spark.createDataFrame([(0, 0, 3.0), (1, 1, 1.0)], "row int, col int, value double")
    assert diagnostics.dominant_eigenvalue(m, 12) == pytest.approx(3, rel=1e-3)


def test_eigenvalues_keep_their_sign(spark):
    m = spark.createDataFrame([(0, 0, -4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0)], "row int, col int, value double")
    exact = np.linalg.eigvalsh([[-4.0, 1.0], [1.0, 2.0]])
    assert diagnostics.dominant_eigenvalue(m, 20) == pytest.approx(min(exact), rel=1e-3)
    assert diagnostics.dominant_eigenvalue(m.withColumn("value", F.lit(0.0))) == 0.0


def test_long_series_cost_no_more_a_step(spark):
    """Four times the steps of a run take no more than about four times as long."""
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 97).cast("double").alias("value"))
        began = time.perf_counter()
        diagnostics.ema(df, "run", ["step"], "value").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 6 * max(seconds(20_000), 0.3)


def test_schedule(spark):
    rates = spark.range(1).select(diagnostics.lr_schedule(1e-6, 1e-1, 200)).first()[0]
    assert len(rates) == 201 and rates[0] == pytest.approx(1e-6) and rates[-1] == pytest.approx(1e-1)


def streamed(spark, tmp_path, rows, schema, make):
    """Rows of a stream's batches, one file each, through `make`."""
    for i, part in enumerate(rows):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "a.json").write_text("\n".join(map(json.dumps, part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    seen = []
    make(stream).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return seen


def test_stream_stops_at_divergence(spark, tmp_path):
    values = [1.0] * 14 + [60.0, 80.0, 90.0]
    parts = [[{"run": "r", "metric": "m", "step": i, "value": v} for i, v in enumerate(values) if i // 8 == k] for k in range(3)]
    seen = streamed(spark, tmp_path, parts, "run string, metric string, step long, value double", stateful.until_divergence)
    smooth = diagnostics.ema(series(spark, values), "run", ["step"], "value", 0.7)
    batch = diagnostics.until_divergence(smooth, "run", "step", "ema").collect()
    assert {r.step: round(r.ema, 9) for r in seen} == {r.step: round(r.ema, 9) for r in batch} and len(seen) == 15 and [r.step for r in seen if r["last"]] == [14]


def test_stream_of_cosines(spark, tmp_path):
    rows = [{"run": "r", "step": i, "vec": [float(i % 3), 1.0, 2.0]} for i in range(7)]
    seen = streamed(spark, tmp_path, [rows[:3], rows[3:]], "run string, step long, vec array<double>", stateful.cosines)
    batch = diagnostics.vector_steps(spark.createDataFrame([(r["run"], r["step"], r["vec"]) for r in rows], "run string, step long, vec array<double>"), "run", "step", "vec").collect()
    assert {r.step: round(r["cosine"], 9) for r in seen} == {r.step: round(r["cosine"], 9) for r in batch}


def test_log_tail_and_warmup(spark, tmp_path):
    for i in range(2):
        sinks.run_log(spark, f"{tmp_path}/log", "train", f"x{i}", "ok")
    seen = []
    stateful.log_tail(spark, f"{tmp_path}/log").writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.exp_id for r in seen) == ["x0", "x1"]
    assert stateful.after_warmup(series(spark, range(15))).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    for i, rows in enumerate(([0, 1, 2], [3, 4])):
        lines = [json.dumps({"run": "r", "metric": "m", "step": s, "value": float(s % 3)}) for s in rows]
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "a.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("run string, metric string, step long, value double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    seen = []
    write = sinks.fan_out(None, lambda df: seen.extend(df.collect()))
    stateful.smoothed(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    batch = diagnostics.ema(series(spark, [0, 1, 2, 0, 1]), "run", ["step"], "value").collect()
    assert {r.step: round(r.ema, 9) for r in seen} == {r.step: round(r.ema, 9) for r in batch}
    best = diagnostics.best_so_far(series(spark, [0, 1, 2, 0, 1]), "run", ["step"], "value").collect()
    assert {(r.step, r.best, r.improved) for r in seen} == {(r.step, r.best, r.improved) for r in best}


def test_sources(spark, tmp_path):
    pics = tmp_path / "pics" / "sub"
    pics.mkdir(parents=True)
    for name in ("doc_1.png", "doc_1.jpg", "é_2.png"):
        (pics / name).write_bytes(b"x")
    (tmp_path / "labels.csv").write_text("file_name,label\ndoc_1.png,007\né_2.png,NA\ngone.png,x\n")
    got = readers.samples(readers.labels_csv(spark, str(tmp_path / "labels.csv")), readers.image_index(spark, str(tmp_path / "pics")))
    rows = {r.file_name: r for r in got.collect()}
    assert len(rows) == 2 and rows["doc_1.png"].ground_truth == "007" and rows["doc_1.png"].line_id == "1"
    out = udfs.recognise(got, lambda: udfs.mock_recogniser).collect()
    assert {r.prediction for r in out} == {"doc 1", "é 2"}
    with pytest.raises(ValueError, match="label"):
        (tmp_path / "bad.csv").write_text("file_name\na\n")
        readers.labels_csv(spark, str(tmp_path / "bad.csv"))
    doc = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "annotations": [{"image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 1, "name": "line"}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc))
    _, notes, _ = readers.coco(spark, str(tmp_path / "coco.json"))
    assert notes.select("gt", "source", "x", "h").first() == (0, "?", 1.0, 4.0)


def test_reports(spark):
    df = spark.createDataFrame([("a", "cer", 0.5)], "model string, key string, value double")
    row = reporting.latex_rows(reporting.pivoted(df, "model", "key", "value", ["cer", "wer"]), "model", ["cer", "wer"]).first()
    assert row.line == r"a & 0.5000 & n/a \\"
    event = reporting.log_event(F.lit("load"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"), F.lit("c"), F.lit(None).cast("string")))
    assert spark.range(1).select(event).first()[0] == "event=load a=2 b=1"


def test_image_kernels():
    image = np.full((20, 30), 255, np.uint8)
    image[8:10, :] = 0
    assert images.otsu(image) < 255 and images.skew(image) == 0
    assert images.bordered(image, 10).shape == (40, 50) and images.inverted(image).shape == (20, 30, 3)
    assert images.morph(image, 3, False)[7, 5] == 0 and images.median_blur(image, 2).shape == image.shape
    rgba = np.zeros((4, 4, 4), np.uint8)
    rgba[1:4, :, 3] = 255
    assert images.composite(rgba).shape == (3, 4, 3)
