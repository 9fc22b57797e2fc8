"""Readers of the formats the benchmarks use; every schema is declared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import boxes

COCO = (
    "images array<struct<id: long, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, source: string, area: double, iscrowd: int>>, "
    "categories array<struct<id: int, name: string>>"
)
RESULTS = "image_id long, category_id int, bbox array<double>, score double"
SUFFIXES = ("jpg", "jpeg", "png")


#: Texts that pandas reads as missing (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def labels_csv(spark: SparkSession, path: str, pandas_na: bool = False) -> DataFrame:
    """(file_name, label), all text; other columns are dropped, missing ones are an error.

    An empty label is the empty text. With `pandas_na` it is "nan", as is any other text
    that pandas takes for a missing value.
    """
    found = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if lacking := sorted({"file_name", "label"} - set(found.columns)):
        raise ValueError(f"labels lack columns: {', '.join(lacking)}")
    label = F.coalesce("label", F.lit(""))
    return found.select("file_name", F.when(label.isin(*MISSING), "nan").otherwise(label).alias("label") if pandas_na else label.alias("label"))


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), deep: bool = True) -> DataFrame:
    """(path, name, stem, suffix) of files, contents not read; with suffixes (lower case, without dot), those only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(path).select("path")
    files = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    files = files.select("path", "name", T.stem("name").alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("suffix"))
    return files.filter(F.col("suffix").isin(*suffixes)) if suffixes else files


#: Suffixes of images that are preprocessed or shown (fixed values).
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def images_listed(spark: SparkSession, path: str) -> DataFrame:
    """Images below path, in order of their paths."""
    return listed(spark, path, IMAGES).orderBy("path")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """(exp_id, cost figures) of the meta.json files at <exp_id>/meta.json; figures that a file lacks are null."""
    schema = "ms_per_image_mean double, ms_per_image_median double, peak_gpu_mem_mb double, peak_ram_mb double"
    found = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1).alias("exp_id"), "*")


def page_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, line, outline, baseline) of the text lines of PAGE XML files; no file is an error."""
    point = "struct<_points: string>"
    line = f"struct<_id: string, Coords: {point}, Baseline: {point}>"
    schema = f"_imageFilename string, _imageWidth int, _imageHeight int, TextRegion array<struct<_id: string, TextLine: array<{line}>>>"
    pages = spark.read.format("xml").option("rowTag", "Page").schema(schema).load(path)
    if pages.isEmpty():
        raise ValueError(f"no PAGE XML in {path}")
    lines = pages.select(F.col("_imageFilename").alias("file"), F.col("_imageWidth").alias("width"), F.col("_imageHeight").alias("height"), F.explode_outer(F.flatten("TextRegion.TextLine")).alias("l"))
    return lines.select("file", "width", "height", F.col("l._id").alias("line"), F.col("l.Coords._points").alias("outline"), F.col("l.Baseline._points").alias("baseline"))


def by_stem(left: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, how: str = "inner") -> DataFrame:
    """left (stem) with `path`, the file of that stem whose suffix is listed first."""
    rank = F.array_position(F.array(*map(F.lit, suffixes)), F.col("suffix"))
    first = files.filter(F.col("suffix").isin(*suffixes)).groupBy("stem").agg(F.min_by("path", F.struct(rank.alias("rank"), "path")).alias("path"))
    return left.join(first, "stem", how)


def twins(raw: DataFrame, made: DataFrame, fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw images with the path of their preprocessed twin (`<stem>.jpg`), in order of names, and those without one; without any files made, fallback is taken."""
    made = fallback if fallback is not None and made.isEmpty() else made
    both = by_stem(raw.select("name", "stem", F.col("path").alias("raw")), made, ("jpg",), "left").withColumnRenamed("path", "preprocessed")
    return both.filter("preprocessed IS NOT NULL").orderBy("name"), both.filter("preprocessed IS NULL").select("name", "raw")


def pages(spark: SparkSession, path: str, pdf: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """(path, page, content): an image is one page; a PDF has as many as `pdf` makes of it; other files are an error."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = spark.read.format("binaryFile").load(path).select("path", "content", kind.alias("kind"))
    schema = "path string, page int, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content, suffix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if suffix == "pdf" and pdf:
                    rows += [(name, i, p) for i, p in enumerate(pdf(content))]
                elif suffix in IMAGES:
                    rows.append((name, 0, content))
                else:
                    raise ValueError(f"unsupported file type: {name}")
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["path", "page", "content"])

    return files.mapInArrow(run, schema)


def cache_present(spark: SparkSession, path: str | None) -> bool | None:
    """Whether a cache folder (or file) is there and holds something; None if no path is given."""
    if not path:
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(store.exists(place)) and len(store.listStatus(place)) > 0


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, path), one path for each file name: the first by suffix, then by path. Contents are not read."""
    return first_by_name(listed(spark, path, SUFFIXES))


def first_by_name(files: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    return files.groupBy("name").agg(F.min_by("path", F.struct(rank.alias("rank"), "path")).alias("path"))


def samples(labels: DataFrame, index: DataFrame, limit: int | None = None) -> DataFrame:
    """Labels with their images: by name as it is, else by NFC, else by NFD form; labels without image go before the limit."""
    from quillspark.functions.udfs import unicode_form

    names = index.select("name", "path").withColumn("key", F.explode(F.array_distinct(F.array("name", unicode_form("NFC")("name"), unicode_form("NFD")("name")))))
    keys = names.groupBy("key").agg(F.min_by("path", "name").alias("path"))
    tried = labels.withColumn("ord", F.monotonically_increasing_id())
    tried = tried.select("*", F.posexplode(F.array("file_name", unicode_form("NFC")("file_name"), unicode_form("NFD")("file_name"))).alias("rank", "key"))
    met = tried.join(keys, "key").groupBy("ord").agg(F.first("file_name").alias("file_name"), F.first("label").alias("ground_truth"), F.min_by("path", "rank").alias("image_path"))
    document, line = T.sample_ids("file_name")
    out = met.withColumns({"document_id": document, "line_id": line})
    return out.orderBy("ord").limit(limit) if limit and limit > 0 else out


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations with gt index and box columns, categories) of a COCO document."""
    doc = spark.read.option("multiLine", True).schema(COCO).json(path)
    images = doc.selectExpr("inline(images)").withColumnRenamed("id", "image_id")
    notes = doc.select(F.posexplode("annotations").alias("gt", "a")).select("gt", "a.image_id", "a.category_id", F.coalesce("a.source", F.lit("?")).alias("source"), *(F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")))
    return images, notes, doc.selectExpr("inline(categories)").withColumnRenamed("id", "category_id")


def coco_results(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("multiLine", True).schema(RESULTS).json(path)
    return found.select("image_id", "category_id", "score", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")))


def yolo_labels(spark: SparkSession, path: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(stem, cls, x, y, w, h); lines of fewer than five fields are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("stem", T.stem(F.col("_metadata.file_path")))
    return lines.select("stem", boxes.parsed_yolo(F.col("value"), F.lit(width), F.lit(height)).alias("b")).filter("b IS NOT NULL").select("stem", "b.*")


def first_labels(labels: DataFrame, most: int | None = 200) -> DataFrame:
    """Label rows of the first `most` files by stem; all without `most`."""
    if not most:
        return labels
    return labels.join(labels.select("stem").distinct().orderBy("stem").limit(most), "stem", "left_semi")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary JSON files; broken ones are left out."""
    schema = "model string, created_at string, dataset_id string, metrics map<string, map<string, string>>, timing map<string, double>, _corrupt_record string"
    found = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    return found.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
