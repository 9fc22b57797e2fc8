"""Boxes (x, y, w, h), their overlaps, one-to-one matching and line metrics.

Boxes of an image meet by an equi-join on image_id, so that no pair across images is
made; matching streams the pairs above the threshold in score order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.udfs import six_decimals
from quillspark.operators.ordered import fold, running

THRESHOLD = 0.5


def xyxy() -> list[Column]:
    return [F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")]


def xywh() -> list[Column]:
    return [F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")]


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def yolo_line(width: Column, height: Column, cls: Column | None = None, exact: bool = False) -> Column:
    """A label line of six decimals; `exact` rounds the binary value, as Python does, where Java rounds the shortest decimal."""
    x, y, w, h = (F.col(c) for c in "xywh")
    parts = [clip01((x + w / 2) / width), clip01((y + h / 2) / height), clip01(w / width), clip01(h / height)]
    parts = [six_decimals(p) if exact else F.format_string("%.6f", p) for p in parts]
    return F.concat_ws(" ", (F.lit(0) if cls is None else cls).cast("string"), *parts)


def parsed_yolo(line: Column, width: Column, height: Column) -> Column:
    """Struct (cls, x, y, w, h) of a label line; null for lines of fewer than five fields."""
    p = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    n = lambda i: F.get(p, F.lit(i)).cast("double")
    box = F.struct(
        n(0).cast("int").alias("cls"), ((n(1) - n(3) / 2) * width).alias("x"), ((n(2) - n(4) / 2) * height).alias("y"), (n(3) * width).alias("w"), (n(4) * height).alias("h")
    )
    return F.when(F.size(p) >= 5, box)


def lines_of_polygons(df: DataFrame) -> DataFrame:
    """df with x, y, w, h around `boundary` (an array of points) and score 1; rows without points are left out."""
    return df.filter(F.size("boundary") > 0).withColumn("_b", polygon_box(F.col("boundary"))).select("*", "_b.*", F.lit(1.0).alias("score")).drop("_b")


def records(category: int = 1) -> Column:
    """A prediction in results format: image, category, box and score; a missing score is 1."""
    box = F.array(*(F.col(c).cast("double") for c in "xywh"))
    return F.struct("image_id", F.lit(category).alias("category_id"), box.alias("bbox"), F.coalesce("score", F.lit(1.0)).alias("score"))


def polygon_box(points: Column) -> Column:
    """Struct (x, y, w, h) around an array of (x, y); null if empty."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(points) > 0, F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h")))


def crop(pad: int, width: Column, height: Column) -> list[Column]:
    """Padded integer rectangle within the image."""
    whole = lambda c: F.col(c).cast("int")
    return [
        F.greatest(F.lit(0), whole("x") - pad).alias("x1"), F.greatest(F.lit(0), whole("y") - pad).alias("y1"),
        F.least(width, (F.col("x") + F.col("w")).cast("int") + pad).alias("x2"), F.least(height, (F.col("y") + F.col("h")).cast("int") + pad).alias("y2"),
    ]


def baseline_y() -> Column:
    return F.bround(F.col("y") + 0.75 * F.col("h")).cast("int")


def reading_order(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df with `line`, from 1 down each image (or page, by its keys) by the middles of its boxes."""
    order = W.partitionBy(*(keys or ["image_id"])).orderBy(F.col("y") + F.col("h") / 2, "pred")
    return df.withColumn("line", F.row_number().over(order).cast("long"))


def surest(df: DataFrame, most: int = 300) -> DataFrame:
    """The `most` predictions of each image with the highest scores."""
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "pred")
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def pair_errors(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, gt, pred, centre_error, aspect_error): vertical middle off by how much of the box's height, and difference of width over height."""
    g, p = (df.select("image_id", key, *(F.col(c).alias(f"{key[0]}{c}") for c in "ywh")) for df, key in ((gt, "gt"), (pred, "pred")))
    met = matches.join(g, ["image_id", "gt"]).join(p, ["image_id", "pred"])
    centre = F.abs((F.col("py") + F.col("ph") / 2) - (F.col("gy") + F.col("gh") / 2)) / F.col("gh")
    return met.select("image_id", "gt", "pred", centre.alias("centre_error"), F.abs(F.col("pw") / F.col("ph") - F.col("gw") / F.col("gh")).alias("aspect_error"))


def pairs(gt: DataFrame, pred: DataFrame, overlapping: bool = True) -> DataFrame:
    """(image_id, gt, pred, score, inter, iou, of_gt, of_pred) for boxes of one image that overlap (or all)."""
    side = lambda df, s, own: df.select("image_id", *own, *(F.col(c).alias(f"{s}{c}") for c in "xywh"))
    df = side(gt, "g", ["gt"]).join(side(pred, "p", ["pred", "score"]), "image_id")
    span = lambda a, d: F.greatest(F.lit(0.0), F.least(F.col(f"g{a}") + F.col(f"g{d}"), F.col(f"p{a}") + F.col(f"p{d}")) - F.greatest(f"g{a}", f"p{a}"))
    df = df.withColumn("inter", span("x", "w") * span("y", "h"))
    if overlapping:
        df = df.filter("inter > 0")
    area_g, area_p = F.col("gw") * F.col("gh"), F.col("pw") * F.col("ph")
    union = area_g + area_p - F.col("inter")
    return df.select(
        "image_id", "gt", "pred", "score", "inter", F.when(union > 0, F.col("inter") / union).otherwise(0.0).alias("iou"),
        (F.col("inter") / F.greatest(area_g, F.lit(1e-9))).alias("of_gt"), (F.col("inter") / F.greatest(area_p, F.lit(1e-9))).alias("of_pred"),
    )


def matches(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """(image_id, gt, pred, iou, level): at each threshold (its place is the level), predictions by falling score (then index) each take the best free box (then lowest index)."""
    df = df.filter(F.col("iou") >= min(thresholds)).select("image_id", "gt", "pred", "score", "iou")
    order = [F.desc("score"), F.asc("pred"), F.desc("iou"), F.asc("gt")]

    def step(state: list[set], row: tuple) -> tuple | None:
        image, gt, pred, _, iou = row
        levels = []
        for i, t in enumerate(thresholds):
            if iou < t:
                continue
            taken = state[i]  # boxes as (0, gt), predictions as (1, pred)
            if (1, pred) not in taken and (0, gt) not in taken:
                taken.update(((0, gt), (1, pred)))
                levels.append(i)
        return (image, gt, pred, iou, levels) if levels else None

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"image_id {kinds['image_id']}, gt {kinds['gt']}, pred {kinds['pred']}, iou double, levels array<int>"
    return fold(df, ["image_id"], order, lambda: [set() for _ in thresholds], step, schema).select("image_id", "gt", "pred", "iou", F.explode("levels").alias("level"))


def greedy(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(image_id, gt, pred, iou): one-to-one matches at the threshold."""
    return matches(df, [threshold]).drop("level")


def detection_rates(tp: Column, n_pred: Column, n_gt: Column) -> list[Column]:
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_gt > 0, tp / n_gt).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def line_counts(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per image: n_gt, n_pred, matched, split, absorbed, missed. Images without boxes count 0."""
    met = pairs(gt, pred)
    matched = greedy(met, threshold).select("image_id", "gt", F.lit(True).alias("hit"))
    split = met.filter("of_pred >= 0.5").groupBy("image_id", "gt").agg(F.count("*").alias("k")).filter("k >= 2").select("image_id", "gt", F.lit(True).alias("split"))
    many = F.count("*").over(W.partitionBy("image_id", "pred"))
    absorbed = met.filter("of_gt >= 0.5").withColumn("k", many).filter("k >= 2").select("image_id", "gt", F.lit(True).alias("absorbed")).distinct()
    cover = met.groupBy("image_id", "gt").agg(F.least(F.lit(1.0), F.sum("of_gt")).alias("cover"))
    each = gt.select("image_id", "gt")
    for part in (matched, split, absorbed, cover):
        each = each.join(part, ["image_id", "gt"], "left")
    missed = F.col("hit").isNull() & F.col("split").isNull() & (F.coalesce("cover", F.lit(0.0)) < 0.25)
    g = each.groupBy("image_id").agg(F.count("*").alias("n_gt"), F.count("hit").alias("matched"), F.count("split").alias("split"), F.count("absorbed").alias("absorbed"), F.count_if(missed).alias("missed"))
    p = pred.groupBy("image_id").agg(F.count("*").alias("n_pred"))
    out = images.select("image_id").join(g, "image_id", "left").join(p, "image_id", "left")
    return out.na.fill(0)


def micro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rates over all images, or by keys."""
    names = ["n_gt", "n_pred", "matched", "split", "absorbed", "missed"]
    df = counts.groupBy(*(keys or [])).agg(*(F.sum(c).alias(c) for c in names))
    rate = lambda c: F.when(F.col("n_gt") > 0, F.col(c) / F.col("n_gt")).otherwise(0.0)
    return df.select(*(keys or []), "n_gt", "n_pred", *detection_rates(F.col("matched"), F.col("n_pred"), F.col("n_gt")), *(rate(c).alias(f"{c}_rate") for c in ("split", "absorbed", "missed")))


def score_bin(closed: bool, bins: int = 10) -> Column:
    """The bin of `score`. Open: a score of 1 is in none."""
    inside = lambda i: (F.col("score") >= i * 0.1) & ((F.col("score") < (i + 1) * 0.1) | (F.lit(closed) & (i == bins - 1) & (F.col("score") <= 1.0)))
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), inside), F.lit(0))


def ece(df: DataFrame, closed: bool) -> DataFrame:
    """Expected calibration error of (score, correct). Open: a score of 1 is in no bin but counts in N."""
    # bins are few, so N is the sum of their counts
    by_bin = df.groupBy(score_bin(closed).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("hit"), F.avg("score").alias("sure"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("hit") - F.col("sure"))).otherwise(0.0)
    return by_bin.agg(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece"))


def any_hits(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The older family: any pair at the threshold is a hit, many to many; merges are per prediction."""
    hits = pairs(gt, pred).filter(F.col("iou") >= threshold)
    by_gt = hits.groupBy("image_id", "gt").agg(F.count("*").alias("k")).groupBy("image_id").agg(F.count("*").alias("hit"), F.count_if(F.col("k") > 1).alias("split"))
    by_pred = hits.groupBy("image_id", "pred").agg(F.count("*").alias("k")).groupBy("image_id").agg(F.count_if(F.col("k") > 1).alias("merged"))
    n_gt, n_pred = (df.groupBy("image_id").agg(F.count("*").alias(n)) for df, n in ((gt, "n_gt"), (pred, "n_pred")))
    out = images.select("image_id")
    for part in (n_gt, n_pred, by_gt, by_pred):
        out = out.join(part, "image_id", "left")
    out = out.na.fill(0).filter("n_gt > 0").agg(*(F.sum(c).alias(c) for c in ("n_gt", "n_pred", "hit", "split", "merged")), F.count("*").alias("images"), *(F.avg((F.abs(F.col("n_pred") - F.col("n_gt")) <= k).cast("double")).alias(f"count_within_{k}") for k in (0, 1)))
    per = lambda c, n: F.col(c) / F.greatest(F.col(n), F.lit(1))
    return out.select("images", (1 - per("hit", "n_gt")).alias("missed_rate"), per("split", "n_gt").alias("split_rate"), per("merged", "n_pred").alias("merge_rate"), "count_within_0", "count_within_1")


LEVELS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def average_precision(gt: DataFrame, pred: DataFrame, scopes: DataFrame, most: int = 100) -> DataFrame:
    """(scope, ap, ap50, ap75, ar100) of one category by the published COCO protocol, for each scope of (image_id, scope) with boxes and predictions.

    At each threshold predictions match greedily. True positives are summed over falling
    score, in range partitions; at each of 101 recalls the precision is the largest of
    those whose recall is no less, so it is enough to keep the largest between two recalls.
    """
    top = W.partitionBy("image_id").orderBy(F.desc("score"), "pred")
    pred = pred.withColumn("rk", F.row_number().over(top)).filter(F.col("rk") <= most).drop("rk")
    hits = matches(pairs(gt, pred), LEVELS).groupBy("image_id", "pred").agg(F.collect_set("level").alias("levels"))
    names = [f"tp{i}" for i in range(len(LEVELS))]
    rows = pred.select("image_id", "pred", "score").join(hits, ["image_id", "pred"], "left").join(scopes, "image_id")
    rows = rows.select("scope", "image_id", "pred", "score", *(F.coalesce(F.array_contains("levels", i), F.lit(False)).cast("long").alias(n) for i, n in enumerate(names)))
    rows = rows.withColumns({f"own{i}": F.col(n) for i, n in enumerate(names)})
    rows = running(rows, [F.asc("scope"), F.desc("score"), F.asc("image_id"), F.asc("pred")], names, "k")
    # what stood before the scope; there are as many rows as scopes
    before = rows.groupBy("scope").agg((F.min("k") - 1).alias("k0"), F.array(*(F.min(F.col(n) - F.col(f"own{i}")) for i, n in enumerate(names))).alias("tp0"))
    before = before.join(gt.join(scopes, "image_id").groupBy("scope").agg(F.count("*").alias("n_gt")), "scope")
    rows = rows.select("scope", "k", F.posexplode(F.array(*names)).alias("level", "tps")).join(before, "scope")
    rows = rows.select("scope", "level", "n_gt", (F.col("k") - F.col("k0")).alias("k"), (F.col("tps") - F.element_at("tp0", F.col("level") + 1)).alias("tps"))
    recall = F.col("tps") / F.col("n_gt")
    best = rows.groupBy("scope", "level", F.floor(recall * 100 + 1e-9).alias("point")).agg(F.max(F.col("tps") / F.col("k")).alias("precision"), F.max(recall).alias("recall"))
    points = W.partitionBy("scope", "level")  # 101 rows at most
    after = points.orderBy(F.desc("point")).rowsBetween(W.unboundedPreceding, 0)
    best = best.withColumns({"precision": F.max("precision").over(after), "low": F.coalesce(F.lag("point").over(points.orderBy("point")), F.lit(-1))})
    by_level = best.groupBy("scope", "level").agg((F.sum(F.col("precision") * (F.col("point") - F.col("low"))) / 101).alias("ap"), F.max("recall").alias("ar"))
    at = lambda i: F.max(F.when(F.col("level") == i, F.col("ap")))
    return by_level.groupBy("scope").agg(F.avg("ap").alias("ap"), at(0).alias("ap50"), at(5).alias("ap75"), F.avg("ar").alias("ar100"))


def coco_map(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """ap, ap50, ap75, ar100 over all images; zeros without predictions."""
    scopes = gt.select("image_id").union(pred.select("image_id")).distinct().withColumn("scope", F.lit(""))
    found = average_precision(gt, pred, scopes)
    return found.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("ap", "ap50", "ap75", "ar100")))
