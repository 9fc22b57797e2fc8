"""Reports over line detection: overall and by source, and the older block of validation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import boxes
from quillspark.operators.ordered import running

OPERATING_POINT = 0.25
#: Columns of a summary row, in order (fixed format).
SUMMARY = (
    "exp_id", "conf_thresh", "ap", "ap50", "ap75", "ar100", "precision", "recall", "f1", "missed_rate", "split_rate", "merge_rate", "iou_mean", "iou_median",
    "ece", "n_images", "n_gt", "n_pred", "ms_per_image_mean", "ms_per_image_median", "peak_gpu_mem_mb", "peak_ram_mb",
)
META = ("ms_per_image_mean", "ms_per_image_median", "peak_gpu_mem_mb", "peak_ram_mb")


def at_operating_point(pred: DataFrame, least: float = OPERATING_POINT) -> DataFrame:
    """Predictions whose score is at least `least`; a missing score counts as 1."""
    return pred.filter(F.coalesce("score", F.lit(1.0)) >= least)


def image_sources(gt: DataFrame) -> DataFrame:
    """(image_id, source): the source of an image's first annotation, `?` if that has none."""
    return gt.groupBy("image_id").agg(F.min_by(F.coalesce("source", F.lit("?")), "gt").alias("source"))


def quantiles(df: DataFrame, keys: list[str], value: str, ties: list[str], shares: list[float]) -> DataFrame:
    """keys and `q` (an array, by linear interpolation) of exact quantiles; no task holds a group's values."""
    ranked = running(df.select(*keys, value, *ties), [*(F.asc(k) for k in keys), F.asc(value), *(F.asc(t) for t in ties)], [], "_place")
    groups = ranked.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    wanted = [F.lit(s) * (F.col("_n") - 1) for s in shares]
    ends = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(w), F.ceil(w)) for w in wanted))))
    need = groups.select(*keys, "_first", "_n", F.explode(ends).alias("_rank")).withColumn("_place", F.col("_first") + F.col("_rank"))
    found = ranked.select("_place", F.col(value).alias("_v")).join(need, "_place")
    at = found.groupBy(*keys).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(w: Column) -> Column:
        low, high = F.element_at("_at", F.floor(w)), F.element_at("_at", F.ceil(w))
        return low + (high - low) * (w - F.floor(w))

    return at.select(*keys, F.array(*(between(w) for w in wanted)).alias("q"))


def calibration(df: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """keys and the expected calibration error of (score, correct)."""
    by_bin = df.groupBy(*keys, boxes.score_bin(closed).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("hit"), F.avg("score").alias("sure")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("hit") - F.col("sure"))).otherwise(0.0)
    return by_bin.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def report(images: DataFrame, gt: DataFrame, pred: DataFrame, least: float = OPERATING_POINT) -> DataFrame:
    """A row for all images (source null) and, if there are several sources, one for each.

    Rates, overlaps and calibration are those of predictions at the operating point,
    average precision that of all. Images without boxes have no source, but count overall.
    """
    op = at_operating_point(pred, least)
    sources = image_sources(gt)
    scopes = images.select("image_id", F.lit("").alias("scope")).unionByName(
        sources.join(images.select("image_id"), "image_id", "left_semi").select("image_id", F.concat(F.lit("="), "source").alias("scope"))
    )
    counts = boxes.line_counts(images, gt, op).join(scopes, "image_id")
    out = counts.groupBy("scope").agg(F.count("*").alias("n_images"), *(F.sum(c).alias(c) for c in ("n_gt", "n_pred", "matched", "split", "absorbed", "missed")))
    matches = boxes.greedy(boxes.pairs(gt, op))
    overlaps = matches.join(scopes, "image_id")
    middle = quantiles(overlaps, ["scope"], "iou", ["image_id", "pred"], [0.5]).select("scope", F.col("q")[0].alias("iou_median"))
    mean = overlaps.groupBy("scope").agg(F.avg("iou").alias("iou_mean"))
    judged = op.select("image_id", "pred", F.coalesce("score", F.lit(1.0)).alias("score")).join(matches.select("image_id", "pred", F.lit(True).alias("hit")), ["image_id", "pred"], "left")
    sure = calibration(judged.withColumn("correct", F.col("hit").isNotNull()).join(scopes, "image_id"), ["scope"], closed=True)
    for part in (middle, mean, sure, boxes.average_precision(gt, pred, scopes)):
        out = out.join(part, "scope", "left")
    rate = lambda c: F.when(F.col("n_gt") > 0, F.col(c) / F.col("n_gt")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    several = out.withColumn("_sources", F.count("*").over(W.partitionBy(F.col("scope") != "")))  # a row for each source
    return several.filter((F.col("scope") == "") | (F.col("_sources") > 1)).select(
        F.when(F.col("scope") != "", F.substring("scope", 2, 1 << 30)).alias("source"), F.lit(least).alias("conf_thresh"), *map(zero, ("ap", "ap50", "ap75", "ar100")),
        *boxes.detection_rates(F.col("matched"), F.col("n_pred"), F.col("n_gt")), rate("missed").alias("missed_rate"), rate("split").alias("split_rate"),
        rate("absorbed").alias("merge_rate"), *map(zero, ("iou_mean", "iou_median", "ece")), "n_images", "n_gt", "n_pred", F.col("matched").alias("n_matched"),
    )


def summary_row(report_: DataFrame, exp_id: str, meta: DataFrame | None = None) -> DataFrame:
    """The row of all images in the columns of a summary; cost figures come from meta (exp_id and any of META)."""
    row = report_.filter("source IS NULL").withColumn("exp_id", F.lit(exp_id))
    if meta is not None:
        row = row.join(meta.select("exp_id", *(c for c in META if c in meta.columns)), "exp_id", "left")
    return row.select(*(F.col(c) if c in row.columns else F.lit(None).cast("double").alias(c) for c in SUMMARY))


def line_report(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = boxes.THRESHOLD) -> DataFrame:
    """For each image its counts, the rates of boxes missed, split and absorbed, and mean and median overlap of its matches; zeros where there is nothing."""
    counts = boxes.line_counts(images, gt, pred, threshold)
    overlap = boxes.greedy(boxes.pairs(gt, pred), threshold).groupBy("image_id").agg(F.avg("iou").alias("iou_mean"), F.median("iou").alias("iou_median"))
    rate = lambda c: F.when(F.col("n_gt") > 0, F.col(c) / F.col("n_gt")).otherwise(0.0)
    rates = [rate(c).alias(name) for c, name in (("missed", "missed_rate"), ("split", "split_rate"), ("absorbed", "merge_rate"))]
    return counts.join(overlap, "image_id", "left").select(*counts.columns, *rates, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("iou_mean", "iou_median")))


def detection_delta(detected: DataFrame) -> DataFrame:
    """(image, raw, preprocessed, delta): numbers of boxes of (image, variant, pred) on both variants of an image."""
    n = lambda v: F.count_if(F.col("variant") == v)
    out = detected.groupBy("image").agg(n("raw").alias("raw"), n("preprocessed").alias("preprocessed"))
    return out.withColumn("delta", F.col("preprocessed") - F.col("raw"))


def iou_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, n) of iou in [0, 1]; the last bin holds 1."""
    at = F.least(F.floor(F.col("iou") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") / bins).alias("low"), "n")


def validation_block(images: DataFrame, gt: DataFrame, pred: DataFrame, least: float = OPERATING_POINT, threshold: float = boxes.THRESHOLD) -> DataFrame:
    """One row of the older twelve metrics: any pair at the threshold is a hit, many to many.

    Only images with boxes count. Overlap is that of a box with its best prediction;
    errors are those of a prediction against its best box, relative to the page.
    images has width and height.
    """
    op = at_operating_point(pred, least)
    used = images.join(gt.select("image_id").distinct(), "image_id", "left_semi")
    op = op.join(used.select("image_id"), "image_id", "left_semi")
    hits = boxes.pairs(gt, op).filter(F.col("iou") >= threshold)
    best = hits.groupBy("image_id", "gt").agg(F.max("iou").alias("iou"))
    q = quantiles(best.withColumn("_all", F.lit(1)), ["_all"], "iou", ["image_id", "gt"], [0.1, 0.5, 0.9])
    mean = best.agg(F.avg("iou").alias("iou_mean"))
    own = hits.groupBy("image_id", "pred").agg(F.max_by("gt", F.struct("iou", F.negative("gt"))).alias("gt"))
    size = lambda df, s, key: df.select("image_id", key, *(F.col(c).alias(f"{s}{c}") for c in "ywh"))
    met = own.join(size(gt, "g", "gt"), ["image_id", "gt"]).join(size(op, "p", "pred"), ["image_id", "pred"]).join(used.select("image_id", "width", "height"), "image_id")
    centre = lambda s: (F.col(f"{s}y") + F.col(f"{s}h") / 2) / F.col("height")
    aspect = lambda s: (F.col(f"{s}w") / F.col("width")) / (F.col(f"{s}h") / F.col("height") + 1e-6)
    errors = met.select(F.lit(1).alias("_all"), "image_id", "pred", F.abs(centre("p") - centre("g")).alias("cy"), F.abs(aspect("p") - aspect("g")).alias("ar"))
    middle = lambda c: quantiles(errors, ["_all"], c, ["image_id", "pred"], [0.5]).select("_all", F.col("q")[0].alias(c))
    judged = op.select("image_id", "pred", "score").join(own.select("image_id", "pred", F.lit(True).alias("hit")), ["image_id", "pred"], "left")
    sure = calibration(judged.select(F.lit(1).alias("_all"), "score", F.col("hit").isNotNull().alias("correct")), ["_all"], closed=False)
    out = boxes.any_hits(used, gt, op, threshold).withColumn("_all", F.lit(1)).crossJoin(F.broadcast(mean))  # one row each
    for part in (q, middle("cy"), middle("ar"), sure):
        out = out.join(F.broadcast(part), "_all", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    at = lambda i: F.get(F.col("q"), F.lit(i))
    return out.select(
        zero(F.col("iou_mean"), "iou_mean"), zero(at(1), "iou_median"), zero(at(0), "iou_p10"), zero(at(2), "iou_p90"),
        zero(F.col("missed_rate"), "missed_line_rate"), zero(F.col("split_rate"), "split_rate"), zero(F.col("merge_rate"), "merge_rate"),
        zero(F.col("cy"), "median_cy_error_norm"), zero(F.col("ar"), "median_ar_error"), zero(F.col("count_within_0"), "line_count_acc_exact"),
        zero(F.col("count_within_1"), "line_count_acc_pm1"), zero(F.col("ece"), "confidence_ece"),
    )
