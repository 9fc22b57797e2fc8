"""Writers and readers, each through files."""

import json
import os
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import boxes, datasets, detection
from quillspark.operators import experiments as E
from quillspark.sources import readers, sinks

NOW = datetime(2024, 5, 6, 7, 8, 9)
IMAGES = "image_id long, file_name string, width int, height int"
GT = "image_id long, gt long, x double, y double, w double, h double"


@pytest.fixture
def pages(spark):
    images = spark.createDataFrame([(1, 'in/a&b <x>".png', 200, 100), (2, "b.png", 50, 60), (3, "empty.png", 10, 10)], IMAGES)
    gt = spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 10.0), (1, 9, 0.5, 20.0, 100.0, 10.0), (2, 3, 5.0, 6.0, 7.0, 8.0)], GT)
    return images, gt


def test_page_layouts_are_read_back(spark, pages, tmp_path):
    assert sinks.page_files(*pages, f"{tmp_path}/xml") == 3
    assert sorted(os.listdir(f"{tmp_path}/xml")) == ['a&b <x>".xml', "b.xml", "empty.xml"]
    root = ET.parse(f'{tmp_path}/xml/a&b <x>".xml').getroot()
    assert root.tag == f"{{{datasets.PAGE_NS}}}PcGts" and root[0].attrib["imageFilename"] == 'a&b <x>".png'
    assert root[0][0][0].attrib["points"] == "0,0 200,0 200,100 0,100" and [x.attrib["id"] for x in root[0][0][1:]] == ["l0", "l1"]
    rows = readers.page_layouts(spark, f"file://{tmp_path}/xml").orderBy("file", "line").collect()
    assert [(r.file, r.line, r.outline, r.baseline) for r in rows if r.line] == [
        ('a&b <x>".png', "l0", "0,0 100,0 100,10 0,10", "0,8 100,8"), ('a&b <x>".png', "l1", "0,20 100,20 100,30 0,30", "0,28 100,28"),
        ("b.png", "l0", "5,6 12,6 12,14 5,14", "5,12 12,12"),
    ]
    os.mkdir(f"{tmp_path}/none")
    with pytest.raises(ValueError):
        readers.page_layouts(spark, f"file://{tmp_path}/none")


def test_label_files_are_read_back(spark, pages, tmp_path):
    images, gt = pages
    assert sinks.yolo_data_set(images, gt, str(tmp_path), "train") == 3
    folder = f"{tmp_path}/labels/train"
    assert open(f"{folder}/empty.txt").read() == "" and open(f"{folder}/b.txt").read() == "0 0.170000 0.166667 0.140000 0.133333\n"
    assert open(f"{tmp_path}/data.yaml").read() == datasets.DATA_YAML
    rows = {r.stem: r for r in readers.yolo_labels(spark, f"file://{folder}", 50, 60).filter("stem = 'b'").collect()}
    assert (rows["b"].x, rows["b"].y, rows["b"].w, rows["b"].h) == pytest.approx((5, 6, 7, 8), abs=1e-4)
    assert readers.first_labels(readers.yolo_labels(spark, f"file://{folder}"), 1).select("stem").distinct().count() == 1
    with pytest.raises(ValueError, match="duplicate stem: b"):
        sinks.yolo_data_set(images.unionByName(spark.createDataFrame([(4, "other/b.jpg", 1, 1)], IMAGES)), gt, str(tmp_path), "train")
    # the binary value of 0.1234565 lies under the half
    line = spark.createDataFrame([(0.0, 0.0, 0.1234565, 0.5)], "x double, y double, w double, h double")
    got = line.select(boxes.yolo_line(F.lit(1), F.lit(1), exact=True), boxes.yolo_line(F.lit(1), F.lit(1))).first()
    assert got[0].split()[3] == f"{0.1234565:.6f}" and abs(float(got[1].split()[3]) - 0.1234565) < 1e-6


def test_converter_finds_images_and_counts(spark):
    images = spark.createDataFrame([(1, "x/a.png", 10, 10), (2, "b.png", 10, 0), (3, "c.png", 10, 10), (4, "/abs/d.png", 10, 10)], IMAGES)
    files = spark.createDataFrame([("/root/x/../x/a.png",), ("/img/a.png",), ("/root/b.png",), ("/abs/d.png",)], "path string")
    found = datasets.resolved_paths(images, files, "/root", "/img/")
    assert {r.image_id: r.path for r in found.collect()} == {1: "/root/x/a.png", 2: "/root/b.png", 3: None, 4: "/abs/d.png"}
    notes = spark.createDataFrame(
        [(0, 1, 5, [1.0, 1.0, 2.0, 2.0]), (1, 1, 9, [1.0, 1.0, 20.0, 2.0]), (2, 1, 5, None), (3, 1, 5, []), (4, 1, 5, [1.0] * 3), (5, 1, 5, [1.0, 1.0, 0.0, 2.0]), (6, 2, 5, None)],
        "gt long, image_id long, category_id int, bbox array<double>",
    )
    out = datasets.converted(found, notes, spark.createDataFrame([(7,), (5,)], "category_id int"))
    assert tuple(datasets.conversion_counts(out).first()) == (2, 2, 2, 4)
    texts = {r.image_id: r.text for r in out.collect()}
    assert texts == {1: "0 0.200000 0.200000 0.200000 0.200000\n0 1.000000 0.200000 1.000000 0.200000", 2: None, 3: None, 4: ""}
    odd = ["a//b/./c", "../x", "/../x", "a/../..", "", "a/.."]
    paths = spark.createDataFrame([(p,) for p in odd], "p string").select(datasets.normal_path("p")).collect()
    assert [r[0] for r in paths][:2] == ["a/b/c", "../x"] and [r[0] for r in paths][3:] == ["..", ".", "."]


def test_splits():
    split = datasets.shuffled_split(range(10), 0)
    assert sorted(sum(split.values(), [])) == list(range(10)) and [len(split[k]) for k in ("test", "val", "train")] == [2, 2, 6]
    import random

    order = list(range(10))
    random.Random(0).shuffle(order)
    assert split == {"test": order[:2], "val": order[2:4], "train": order[4:]}


def test_coco_documents(spark, pages, tmp_path):
    images, gt = pages
    notes = gt.select(F.col("gt").alias("id"), "image_id", F.lit(1).alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"))
    named = images.withColumnRenamed("image_id", "id")
    kinds = spark.createDataFrame([(1, "line")], "id int, name string")
    keep = spark.createDataFrame([(2,)], "id long")
    sinks.coco_document(datasets.subset(named, keep, "id"), notes.join(keep.withColumnRenamed("id", "image_id"), "image_id", "left_semi"), kinds, f"{tmp_path}/one", 100)
    whole = json.load(open(f"{tmp_path}/one.json"))
    assert [len(whole[k]) for k in ("images", "annotations", "categories")] == [1, 1, 1]
    got, boxed, _ = readers.coco(spark, f"file://{tmp_path}/one.json")
    assert got.first().image_id == 2 and boxed.first().w == 7.0
    sinks.coco_document(named, notes, kinds, f"{tmp_path}/many")
    assert spark.read.json(f"{tmp_path}/many/annotations").count() == 3


def test_data_sets_are_written(spark, pages, tmp_path):
    images, gt = pages
    more = images.unionByName(spark.range(10, 60).select(F.col("id").alias("image_id"), F.concat(F.lit("p"), "id").alias("file_name"), F.lit(5).alias("width"), F.lit(5).alias("height")))
    kinds = spark.createDataFrame([(1, "line")], "id int, name string")
    n = sinks.data_sets(more, gt, kinds, str(tmp_path), 1000)
    held = {k: json.load(open(f"{tmp_path}/instances_{k}.json")) for k in n}
    ids = {k: {i["image_id"] for i in v["images"]} for k, v in held.items()}
    assert sum(n.values()) == 53 == len(set().union(*ids.values())) and all(len(v) == n[k] for k, v in ids.items())
    assert sum(len(v["annotations"]) for v in held.values()) == 3 and all({a["image_id"] for a in v["annotations"]} <= ids[k] for k, v in held.items())
    train, val = datasets.random_split(more)
    assert train.count() + val.count() == 53


def test_labels_as_pandas_reads_them(spark, tmp_path):
    open(f"{tmp_path}/l.csv", "w").write("file_name,label\na,NA\nb,\nc,007\n")
    assert [r.label for r in readers.labels_csv(spark, f"{tmp_path}/l.csv").collect()] == ["NA", "", "007"]
    assert [r.label for r in readers.labels_csv(spark, f"{tmp_path}/l.csv", True).collect()] == ["nan", "nan", "007"]
    open(f"{tmp_path}/m.csv", "w").write("file_name,text\na,b\n")
    with pytest.raises(ValueError, match="label"):
        readers.labels_csv(spark, f"{tmp_path}/m.csv")


def test_predictions_and_evaluation(spark, pages, tmp_path):
    images, gt = pages
    gt = gt.withColumn("source", F.when(F.col("image_id") == 1, "iam"))
    pred = gt.select("image_id", F.col("gt").alias("pred"), "x", "y", "w", "h", F.lit(0.9).alias("score")).filter("gt <> 9")
    folder = f"{tmp_path}/results/predictions/run1"
    sinks.predictions(pred.select(boxes.records().alias("r")).select("r.*"), folder, {"ms_per_image_mean": 5.5, "device": "cpu"})
    assert readers.coco_results(spark, f"file://{folder}/predictions").count() == 2
    meta = readers.meta(spark, f"file://{tmp_path}/results/predictions/*/meta.json")
    assert meta.first().exp_id == "run1" and meta.first().peak_ram_mb is None
    report = detection.report(images, gt, pred)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {None, "iam", "?"} and got[None].n_images == 3 and got["iam"].recall == 0.5 and got["?"].f1 == 1.0
    for _ in range(2):
        sinks.evaluation(report, "run1", f"{tmp_path}/results", meta)
    one = json.load(open(f"{tmp_path}/results/metrics/run1.json"))
    assert one["overall"]["ms_per_image_mean"] == 5.5 and set(one["per_source"]) == {"iam", "?"} and one["conf_thresh"] == 0.25
    rows = spark.read.option("header", True).csv(f"{tmp_path}/results/summary")
    assert rows.columns == list(detection.SUMMARY) and rows.count() == 2 and rows.first().peak_gpu_mem_mb is None
    assert {r.source for r in detection.report(images, gt.filter("image_id = 1"), pred.limit(0)).collect()} == {None}


def test_listings(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "a.png", "sub/c.tif", "notes.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        open(f"{tmp_path}/{name}", "wb").write(b"x")
    assert [r.name for r in readers.images_listed(spark, f"file://{tmp_path}").collect()] == ["a.jpg", "a.png", "b.PNG", "c.tif"]
    files = readers.listed(spark, f"file://{tmp_path}")
    assert readers.by_stem(spark.createDataFrame([("a",), ("z",)], "stem string"), files).select(F.regexp_extract("path", "([^/]*)$", 1)).collect() == [("a.jpg",)]
    raw = files.filter("suffix = 'png'")
    both, skipped = readers.twins(raw, files.limit(0), files.filter("suffix = 'jpg'"))
    assert [r.name for r in both.collect()] == ["a.png"] and [r.name for r in skipped.collect()] == ["b.PNG"]
    assert readers.cache_present(spark, None) is None and readers.cache_present(spark, f"{tmp_path}/no") is False and readers.cache_present(spark, str(tmp_path)) is True
    got = readers.pages(spark, f"file://{tmp_path}/a.jpg").collect()
    assert [(r.page, bytes(r.content)) for r in got] == [(0, b"x")]
    open(f"{tmp_path}/d.pdf", "wb").write(b"one two")
    assert [(r.page, bytes(r.content)) for r in readers.pages(spark, f"file://{tmp_path}/d.pdf", lambda c: c.split()).collect()] == [(0, b"one"), (1, b"two")]
    with pytest.raises(Exception, match="unsupported"):
        readers.pages(spark, f"file://{tmp_path}/notes.txt").collect()


def test_run_folders_and_logs(spark, tmp_path):
    folder = sinks.run_folder(spark, str(tmp_path), "Mój test/1", {"a": [1]}, NOW)
    assert folder.endswith("M_j_test_1_20240506_070809") and open(f"{folder}/meta.yaml").read() == "a:\n- 1\n"
    assert E.load_config(f"{folder}/meta.yaml") == {"a": [1]}
    assert sinks.run_log(spark, f"{tmp_path}/log", "train", "x", "ok", NOW) and sinks.run_log(spark, f"{tmp_path}/log", "eval", "y", "failed", NOW)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/log").orderBy("kind").collect()
    assert [tuple(r) for r in rows] == [("2024-05-06T07:08:09", "eval", "y", "failed"), ("2024-05-06T07:08:09", "train", "x", "ok")]
    assert sinks.run_log(spark, "nostore://x/y", "eval", "y", "failed") is False
    results = spark.createDataFrame([("a", "b")], "x string, y string")
    csv, report = sinks.outputs(results, {"m": "ż"}, str(tmp_path), NOW)
    assert csv.endswith("results_20240506_070809") and json.load(open(report)) == {"m": "ż"}
    sinks.append_json(results, f"{tmp_path}/j")
    sinks.append_json(results, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.result_tree(results.withColumns({"model_id": F.lit("m"), "dataset_id": F.lit("d")}), f"{tmp_path}/tree")
    assert os.path.isdir(f"{tmp_path}/tree/model_id=m/dataset_id=d")
