import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import boxes, datasets, detection, ordered

GT = "image_id long, gt long, x double, y double, w double, h double"
PRED = "image_id long, pred long, score double, x double, y double, w double, h double"
G = [(1, 0, 0, 0, 100, 10), (1, 1, 0, 20, 100, 10), (1, 2, 0, 40, 100, 10), (2, 0, 0, 0, 100, 10), (2, 1, 0, 10, 100, 10)]
P = [(1, 0, 0.9, 0, 0, 100, 10), (1, 1, 0.8, 0, 20, 50, 10), (1, 2, 0.7, 50, 20, 50, 10), (1, 3, 0.3, 0, 100, 10, 10), (2, 0, 1.0, 0, 0, 100, 20)]


def frames(spark, g=G, p=P):
    f = lambda rows: [tuple(map(lambda i, v: v if i < 2 else float(v), range(len(r)), r)) for r in rows]
    return spark.createDataFrame([(1,), (2,), (3,)], "image_id long"), spark.createDataFrame(f(g), GT), spark.createDataFrame(f(p), PRED)


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_golden_lines(spark):
    images, gt, pred = frames(spark)
    got = {(r.image_id, r.gt, r.pred, round(r.iou, 6)) for r in boxes.greedy(boxes.pairs(gt, pred)).collect()}
    assert got == {(1, 0, 0, 1.0), (1, 1, 1, 0.5), (2, 0, 0, 0.5)}
    counts = {r.image_id: r for r in boxes.line_counts(images, gt, pred).collect()}
    assert [(counts[i].split, counts[i].absorbed, counts[i].missed) for i in (1, 2, 3)] == [(1, 0, 1), (0, 2, 0), (0, 0, 0)]
    m = boxes.micro(boxes.line_counts(images, gt, pred)).first()
    assert (m.precision, m.recall, m.f1, m.split_rate, m.absorbed_rate, m.missed_rate) == pytest.approx((0.6, 0.6, 0.6, 0.2, 0.4, 0.2))
    hits = boxes.any_hits(images, gt, pred).first()
    assert (hits.missed_rate, hits.split_rate, hits.merge_rate, hits.count_within_0, hits.count_within_1) == pytest.approx((0.2, 0.2, 0.2, 0.0, 1.0))


def test_greedy_against_loop(spark):
    rng = random.Random(5)
    box = lambda: (rng.randint(0, 30), rng.randint(0, 30), rng.randint(10, 30), rng.randint(10, 30))
    g = [(i, k, *box()) for i in (1, 2, 3) for k in range(12)]
    p = [(i, k, rng.randint(0, 9) / 10, *box()) for i in (1, 2, 3) for k in range(12)]
    _, gt, pred = frames(spark, g, p)
    expected = set()
    for i in (1, 2, 3):
        free = {k: b for j, k, *b in g if j == i}
        for _, k, s, *b in sorted((r for r in p if r[0] == i), key=lambda r: (-r[2], r[1])):
            best = max(free, key=lambda q: (iou(free[q], b), -q), default=None)
            if best is not None and iou(free[best], b) >= 0.3:
                expected.add((i, best, k))
                del free[best]
    assert {(r.image_id, r.gt, r.pred) for r in boxes.greedy(boxes.pairs(gt, pred), 0.3).collect()} == expected


def test_calibration(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "score double, correct int")
    assert boxes.ece(df, True).first()[0] == pytest.approx(0.5)
    assert boxes.ece(df, False).first()[0] == 0.0
    assert boxes.ece(df.limit(0), True).first()[0] == 0.0


def test_average_precision(spark):
    g = [(1, 0, 0, 0, 100, 10)]
    for width, expected in ((100, (1.0, 1.0, 1.0)), (62, (0.3, 1.0, 0.0))):
        _, gt, pred = frames(spark, g, [(1, 0, 0.9, 0, 0, width, 10)])
        got = boxes.coco_map(gt, pred).first()
        assert (got.ap, got.ap50, got.ap75) == pytest.approx(expected)
    _, gt, pred = frames(spark, g, P[:1])
    assert tuple(boxes.coco_map(gt, pred.limit(0)).first()) == (0, 0, 0, 0)


def test_formats(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x double, y double, w double, h double")
    line = df.select(boxes.yolo_line(F.lit(100.0), F.lit(200.0)).alias("line"))
    assert line.first()[0] == "0 0.250000 0.200000 0.300000 0.200000"
    back = line.select(boxes.parsed_yolo(F.col("line"), F.lit(100.0), F.lit(200.0)).alias("b")).first().b
    assert (back.x, back.y, back.w, back.h) == pytest.approx((10, 20, 30, 40))
    assert line.select(boxes.parsed_yolo(F.lit("0 1 2"), F.lit(1.0), F.lit(1.0))).first()[0] is None
    df = spark.createDataFrame([(3.7, 2.2, 10.5, 5.9)], "x double, y double, w double, h double")
    assert tuple(df.select(*boxes.crop(4, F.lit(20), F.lit(10))).first()) == (0, 0, 18, 10)
    df = spark.createDataFrame([(20.0, 10.0), (1.0, 2.0)], "y double, h double")
    assert [r[0] for r in df.select(boxes.baseline_y()).collect()] == [28, 2]


def test_splits(spark):
    assert datasets.split_sizes(10) == (2, 2, 6) and datasets.split_sizes(30) == (4, 4, 22)
    parts = datasets.shuffled_split(list(range(30)), 7)
    assert sorted(sum(parts.values(), [])) == list(range(30)) and parts == datasets.shuffled_split(list(range(30)), 7)
    got = datasets.hashed_split(spark.range(4000), "id").groupBy("split").count().collect()
    assert {r.split: round(r["count"] / 4000, 1) for r in got} == pytest.approx({"val": 0.2, "test": 0.1, "train": 0.7}, abs=0.11)


def test_running(spark):
    """Places and sums over a whole table, whatever its partitions; what was kept is given back."""
    rng = random.Random(9)
    values = [(i, rng.randint(0, 5), rng.randint(-3, 3)) for i in range(500)]
    df = spark.createDataFrame(values, "id long, v long, w long").repartition(7)
    got = ordered.running(df, [F.desc("v"), F.asc("id")], ["w"]).orderBy("place").collect()
    total, expected = 0, []
    for k, (i, v, w) in enumerate(sorted(values, key=lambda r: (-r[1], r[0]))):
        total += w
        expected.append((i, v, total, k + 1))
    assert [(r.id, r.v, r.w, r.place) for r in got] == expected
    ordered.release()
    assert ordered.running(df.limit(0), [F.asc("id")], ["w"]).count() == 0
    by = detection.quantiles(df.withColumn("g", F.col("id") % 3), ["g"], "w", ["id"], [0.0, 0.1, 0.5, 1.0]).collect()
    for r in by:
        own = np.array([w for i, _, w in values if i % 3 == r.g])
        assert list(r.q) == pytest.approx([np.quantile(own, p) for p in (0.0, 0.1, 0.5, 1.0)])


def test_report_by_hand(spark):
    """Overall and by source: images without boxes count overall only; calibration and overlaps are of one-to-one matches."""
    images, gt, pred = frames(spark)
    gt = gt.withColumn("source", F.when(F.col("image_id") == 1, "a").otherwise("b"))
    got = {r.source: r for r in detection.report(images, gt, pred, 0.5).collect()}
    assert set(got) == {None, "a", "b"} and [got[k].n_images for k in (None, "a", "b")] == [3, 1, 1]
    # of the predictions at 0.5 two of three match on image 1, and one of one on image 2
    assert (got["a"].precision, got["a"].recall, got["a"].iou_mean, got["a"].iou_median) == pytest.approx((2 / 3, 2 / 3, 0.75, 0.75))
    assert (got["b"].precision, got["b"].recall, got["b"].ece, got["b"].merge_rate) == pytest.approx((1, 0.5, 0, 1))
    assert got["a"].ece == pytest.approx((0.1 + 0.2 + 0.7) / 3) and got[None].n_matched == 3
    none = detection.report(images, gt, pred.limit(0)).filter("source IS NULL").first()
    assert (none.ap, none.f1, none.ece, none.iou_median, none.n_pred) == (0, 0, 0, 0, 0)
