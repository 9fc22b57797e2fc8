"""Data-set preparation: splits, subsets, label and page-layout texts, samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import boxes
from quillspark.operators.ordered import running


def split_sizes(n: int, val: float = 0.15, test: float = 0.15) -> tuple[int, int, int]:
    """(val, test, train); Python rounds halves to even."""
    v, t = round(n * val), round(n * test)
    return v, t, n - v - t


def sizes_of(n: Column, val: float = 0.15, test: float = 0.15) -> list[Column]:
    """The same of a column."""
    v, t = F.bround(n * val).cast("long"), F.bround(n * test).cast("long")
    return [v.alias("val"), t.alias("test"), (n - v - t).alias("train")]


def shuffled_split(ids: list[int], seed: int = 0, val: float = 0.15, test: float = 0.15) -> dict[str, list[int]]:
    """Seeded permutation of sorted ids, for lists that fit the driver: test comes first, then val, and train is the rest."""
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    v, t, _ = split_sizes(len(order), val, test)
    return {"test": order[:t], "val": order[t : t + v], "train": order[t + v :]}


def hashed_split(df: DataFrame, id_: str, seed: str = "0", val: float = 0.15, test: float = 0.15) -> DataFrame:
    """df with `split`, at any size: the place of an id is its hash, so no order is needed. Sizes are near the shares."""
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(at < val, "val").when(at < val + test, "test").otherwise("train"))


def random_split(df: DataFrame, val: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, val) without a seed: another split at each call."""
    train, held = df.randomSplit([1 - val, val])
    return train, held


def data_sets(images: DataFrame, test_images: DataFrame | None = None, val: float = 0.15, test: float = 0.15, seed: str = "0") -> dict[str, DataFrame]:
    """train, val and test: all from one master table, or train and val from one table beside a given test table."""
    split = hashed_split(images, "image_id", seed, val, 0.0 if test_images is not None else test)
    of = lambda name: split.filter(F.col("split") == name).drop("split")
    return {"train": of("train"), "val": of("val"), "test": of("test") if test_images is None else test_images}


def subset(df: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def category_index(df: DataFrame, categories: DataFrame) -> DataFrame:
    """`cls`: dense index of category_id in order of id; 0 for unknown ones."""
    index = categories.select("category_id").distinct().withColumn("cls", F.dense_rank().over(W.orderBy("category_id")) - 1)
    return df.join(index, "category_id", "left").na.fill(0, ["cls"])


def box_flaw(box: Column) -> Column:
    """Why an annotated box (an array) is not used: missing, not four numbers, or empty; null if it is fine."""
    return F.when(box.isNull() | (F.size(box) == 0), "missing").when(F.size(box) != 4, "size").when(~((F.get(box, F.lit(2)) > 0) & (F.get(box, F.lit(3)) > 0)), "empty")


def resolved_paths(images: DataFrame, files: DataFrame, coco_root: str, images_dir: str) -> DataFrame:
    """images with `path`: the first of five places, without repetitions, at which files (path) has the image; null if none does."""
    name, base = F.col("file_name"), F.regexp_extract("file_name", r"([^/]*)$", 1)
    under = lambda folder, what: F.when(what.startswith("/"), what).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), what))
    inner = images_dir if images_dir.startswith("/") else f"{coco_root.rstrip('/')}/{images_dir}"
    places = F.array(name, under(coco_root, name), under(images_dir, name), under(images_dir, base), under(inner, base))
    tried = images.select("image_id", F.posexplode(places).alias("rank", "place")).withColumn("path", normal_path("place"))
    found = tried.join(files.select(normal_path("path").alias("path")).distinct(), "path").groupBy("image_id").agg(F.min_by("path", "rank").alias("path"))
    return images.join(found, "image_id", "left")


def normal_path(path: Column | str) -> Column:
    """The path without empty, `.` and, where that can be told, `..` parts."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def walk(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), walk)
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def converted(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, name, path, state, text, skipped): label texts of images with a path, the class of each box by its category.

    state is `copied`, or `missing` for images without path or extent; annotations has
    (gt, image_id, category_id, bbox), and boxes with a flaw are skipped and counted.
    """
    usable = F.col("path").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)
    images = images.withColumn("state", F.when(usable, "copied").otherwise("missing"))
    boxed = annotations.join(images.filter("state = 'copied'").select("image_id", "width", "height"), "image_id")
    boxed = category_index(boxed.withColumn("flaw", box_flaw(F.col("bbox"))), categories)
    boxed = boxed.select("*", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")))
    line = F.when(F.col("flaw").isNull(), F.struct("gt", boxes.yolo_line(F.col("width"), F.col("height"), F.col("cls")).alias("line")))
    found = boxed.groupBy("image_id").agg(joined_lines(line, "\n").alias("text"), F.count("flaw").alias("skipped"))
    out = images.join(found, "image_id", "left").withColumn("name", F.concat(stem(F.col("file_name")), F.lit(".txt")))
    text = F.when(F.col("state") == "copied", F.coalesce("text", F.lit("")))
    return out.select("image_id", "name", "path", "state", text.alias("text"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def conversion_counts(df: DataFrame) -> DataFrame:
    """One row: images copied and missing, label files written, boxes skipped."""
    copied = F.count_if(F.col("state") == "copied")
    return df.agg(copied.alias("copied"), F.count_if(F.col("state") == "missing").alias("missing"), copied.alias("written"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


def joined_lines(line: Column, sep: str) -> Column:
    """Aggregate: the texts of structs (order, line), in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"]), sep)


def stem(path: Column) -> Column:
    return T.stem(path)


def unique_stems(images: DataFrame) -> DataFrame:
    """images, if no two share the stem of their file name, as labels are found by it; else an error."""
    double = duplicate_stems(images, stem(F.col("file_name"))).limit(1).collect()
    if double:
        raise ValueError(f"duplicate stem: {double[0].stem}")
    return images


def yolo_files(images: DataFrame, gt: DataFrame, exact: bool = False) -> DataFrame:
    """(image_id, name, text): one line a box in box order, each ended; images without boxes have an empty text.

    With `exact`, halves at the sixth decimal are rounded by their binary value, in Python.
    """
    line = boxes.yolo_line(F.col("width"), F.col("height"), exact=exact)
    lines = gt.join(images.select("image_id", "width", "height"), "image_id").select("image_id", F.struct("gt", line.alias("line")).alias("l"))
    text = lines.groupBy("image_id").agg(F.concat(joined_lines(F.col("l"), "\n"), F.lit("\n")).alias("text"))
    named = images.select("image_id", F.concat(stem(F.col("file_name")), F.lit(".txt")).alias("name"))
    return named.join(text, "image_id", "left").na.fill("", ["text"])


#: Name space of page layouts, and the text of a data set's description (fixed formats).
PAGE_NS = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
DATA_YAML = "train: images/train\nval: images/val\ntest: images/test\nnames:\n  0: line\n"


def xml_attribute(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def page_xml(images: DataFrame, gt: DataFrame) -> DataFrame:
    """(image_id, name, xml): a page of one region, with a text line (outline and baseline) for each box, numbered within the page in box order."""
    whole = lambda c: F.bround(c).cast("int")
    pts = lambda *p: F.concat_ws(" ", *(F.concat_ws(",", a, b) for a, b in p))
    x, y, r, b = whole(F.col("x")), whole(F.col("y")), whole(F.col("x") + F.col("w")), whole(F.col("y") + F.col("h"))
    outline = pts((x, y), (r, y), (r, b), (x, b))
    baseline = pts((x, boxes.baseline_y()), (r, boxes.baseline_y()))
    number = F.row_number().over(W.partitionBy("image_id").orderBy("gt")) - 1
    line = F.format_string('<TextLine id="l%d"><Coords points="%s" /><Baseline points="%s" /></TextLine>', number, outline, baseline)
    rows = gt.select("image_id", F.struct("gt", line.alias("line")).alias("l")).groupBy("image_id").agg(joined_lines(F.col("l"), "").alias("lines"))
    width, height, zero = F.col("width").cast("string"), F.col("height").cast("string"), F.lit("0")
    xml = F.format_string(
        f'<PcGts xmlns="{PAGE_NS}"><Page imageFilename="%s" imageWidth="%s" imageHeight="%s"><TextRegion id="r0"><Coords points="%s" />%s</TextRegion></Page></PcGts>',
        xml_attribute(F.regexp_extract("file_name", r"([^/]*)$", 1)), width, height, pts((zero, zero), (width, zero), (width, height), (zero, height)), F.coalesce("lines", F.lit("")),
    )
    return images.join(rows, "image_id", "left").select("image_id", F.concat(stem(F.col("file_name")), F.lit(".xml")).alias("name"), xml.alias("xml"))


def strided(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every step-th row in order, `most` at the largest; step is n // most, at least 1."""
    step = max(1, df.count() // most)
    at = F.col("_r") - 1
    return running(df, [F.col(order)], [], "_r").filter((at % step == 0) & (at < step * most)).drop("_r")


def first_n(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def duplicate_stems(df: DataFrame, stem: Column) -> DataFrame:
    return df.groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")


def batches(df: DataFrame, group: list[str], order: list[str], size: int = 8) -> DataFrame:
    """df with `batch`, from 0 within the group."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size))


def source_prefix(path: Column, mark: str = "_") -> Column:
    """What stands before the first mark of a file's stem."""
    return F.split_part(stem(path), F.lit(mark), F.lit(1))
