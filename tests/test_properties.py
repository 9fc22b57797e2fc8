"""Properties that hold for any input."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import images, png, udfs
from quillspark.operators import boxes, datasets, recognition
from quillspark.operators import experiments as E

short = st.text(alphabet="abż ́", max_size=40)


@settings(deadline=None)
@given(short, short, short)
def test_distance_is_a_metric(a, b, c):
    d = udfs.distance
    assert (d(a, b) == 0) == (a == b) and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)
    assert abs(len(a) - len(b)) <= d(a, b) <= max(len(a), len(b))


@given(st.text(max_size=30))
def test_safe_names(name):
    made = E.safe(name)
    assert made and made == E.safe(made) and all(c.isascii() and (c.isalnum() or c in "._-") for c in made)


@settings(deadline=None, max_examples=25)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from((1, 3, 4)), st.integers(0, 1000))
def test_png_and_geometry(height, width, channels, seed):
    image = np.random.default_rng(seed).integers(0, 256, (height, width) if channels == 1 else (height, width, channels), dtype=np.uint8)
    assert (png.decode(png.encode(image)) == image).all()
    out = images.preprocessed(image, images.SAME_GEOMETRY)
    assert out.shape == (height, width, 3) and set(np.unique(out)) <= {0, 255}
    assert (images.inverted(images.inverted(images.grey(image))[..., 0])[..., 0] == images.grey(image)).all()


@given(st.lists(st.integers(0, 10**6), unique=True, max_size=60), st.integers(0, 5))
def test_splits_cover_all(ids, seed):
    split = datasets.shuffled_split(ids, seed)
    assert sorted(sum(split.values(), [])) == sorted(ids) and split == datasets.shuffled_split(ids[::-1], seed)


def test_boxes(spark):
    rng = random.Random(8)
    box = lambda: tuple(float(rng.randint(0, 40)) for _ in range(4))
    g = spark.createDataFrame([(i % 4, i, *box()) for i in range(40)], "image_id long, gt long, x double, y double, w double, h double")
    p = spark.createDataFrame([(i % 4, i, rng.random(), *box()) for i in range(60)], "image_id long, pred long, score double, x double, y double, w double, h double")
    met = boxes.pairs(g, p)
    back = boxes.pairs(p.withColumnRenamed("pred", "gt").drop("score"), g.withColumnRenamed("gt", "pred").withColumn("score", F.lit(1.0)))
    assert {(r.image_id, r.gt, r.pred): round(r.iou, 12) for r in met.collect()} == {(r.image_id, r.pred, r.gt): round(r.iou, 12) for r in back.collect()}
    assert met.filter("iou < 0 OR iou > 1").isEmpty()
    itself = boxes.pairs(g, g.select("image_id", F.col("gt").alias("pred"), F.lit(1.0).alias("score"), "x", "y", "w", "h")).filter("gt = pred")
    assert itself.filter("abs(iou - 1) > 1e-12").isEmpty()
    matched = boxes.greedy(met, 0.1).collect()
    assert len({(r.image_id, r.gt) for r in matched}) == len({(r.image_id, r.pred) for r in matched}) == len(matched)
    judged = p.select("score", (F.col("pred") % 3 == 0).alias("correct"))
    assert all(0 <= boxes.ece(judged, closed).first().ece <= 1 for closed in (True, False))
    around = g.select("gt", *boxes.xyxy()).select("gt", *boxes.xywh()).join(g.select("gt", F.struct("x", "y", "w", "h").alias("b")), "gt")
    assert around.filter("x <> b.x OR y <> b.y OR abs(w - b.w) > 1e-9 OR abs(h - b.h) > 1e-9").isEmpty()


def test_rates_of_equal_texts(spark):
    rows = [("d", "0", i, t, t) for i, t in enumerate(("a b", "", "żółć " * 40, "x"))]
    df = spark.createDataFrame(rows, "document_id string, line_id string, ord int, ground_truth string, prediction string")
    for level in recognition.LEVELS:
        r = recognition.evaluate(df, level).first()
        assert (r.ema, r.near_perfect_match, r.cer, r.wer, r.levenshtein_distance) == (1, 1, 0, 0, 0)
    changed = df.withColumn("prediction", F.when(F.col("ord") == 3, "y").otherwise(F.col("prediction")))
    assert all(recognition.evaluate(changed, level).first().cer > 0 for level in recognition.LEVELS)
