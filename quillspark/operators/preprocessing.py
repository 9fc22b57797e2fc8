"""Preprocessing of page images as a table: bytes in, bytes and a status out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quillspark.functions import images, png
from quillspark.functions import text as T
from quillspark.functions.udfs import detect
from quillspark.operators.boxes import reading_order

SCHEMA = "path string, status string, detail string, content binary, comparison binary"


def preprocessed(pages: DataFrame, changes: dict | None = None, same_geometry: bool = False, compare: bool = False) -> DataFrame:
    """(path, status, detail, content, comparison) of pages (path, content): PNG in, PNG out.

    A page that cannot be read has status `error`. With `same_geometry` an output of another
    size is an error that ends the query, as boxes would no longer fit. With `compare`, input
    and output side by side.
    """
    settings = {**(images.SAME_GEOMETRY if same_geometry else {}), **(changes or {})}

    def one(content: bytes | None) -> tuple[str, str | None, bytes | None, bytes | None]:
        try:
            image = png.decode(content or b"")
        except Exception as e:  # noqa: BLE001  # whatever a broken file does
            return "error", str(e), None, None
        out = images.preprocessed(image, settings)
        if same_geometry and out.shape[:2] != image.shape[:2]:
            raise RuntimeError(f"geometry changed: {image.shape[:2]} to {out.shape[:2]}")
        beside = png.encode(images.side_by_side(images.composite(image, False), out)) if compare else None
        return "ok", None, png.encode(out), beside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(c) for c in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["path", "status", "detail", "content", "comparison"])

    return pages.select("path", "content").mapInArrow(run, SCHEMA)


def unless_made(pages: DataFrame, made: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages still to do, and a `skip` row for each whose output (path) is there."""
    skipped = pages.select("path").join(made.select("path"), "path", "left_semi")
    states = skipped.select("path", F.lit("skip").alias("status"))
    return (pages, states.limit(0)) if force else (pages.join(made.select("path"), "path", "left_anti"), states)


def crops(pages: DataFrame, boxes: DataFrame, keys: list[str], pad: int = 4) -> DataFrame:
    """keys, pred, line and `crop`: the padded cut-out of each box (keys, pred, line, x, y, w, h) from its page, as PNG; a page is decoded once."""
    boxed = boxes.groupBy(*keys).agg(F.collect_list(F.struct("pred", "line", "x", "y", "w", "h")).alias("boxes"))
    met = pages.select(*keys, "content").join(boxed, keys)
    schema = StructType([*(met.schema[k] for k in keys), StructField("pred", LongType()), StructField("line", LongType()), StructField("crop", BinaryType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, content, found in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 2)), strict=True):
                image = images.rgb(images.composite(png.decode(content), False))
                height, width = image.shape[:2]
                for b in found:
                    x1, y1 = max(0, int(b["x"]) - pad), max(0, int(b["y"]) - pad)
                    x2, y2 = min(width, int(b["x"] + b["w"]) + pad), min(height, int(b["y"] + b["h"]) + pad)
                    cut = image[y1:y2, x1:x2]
                    rows.append((*key, b["pred"], b["line"], png.encode(cut) if cut.size else None))
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], kinds.names)

    return met.mapInArrow(run, schema)


def read_lines(pages: DataFrame, detector: Callable, reader: Callable, prepare: Callable[[DataFrame], DataFrame] | None = None, pad: int = 4) -> DataFrame:
    """(path, page, line, pred, x, y, w, h, score, text): lines of pages (path, page, content) in reading order.

    `detector` loads a function of a page's bytes to boxes, `reader` one of encoded
    cut-outs to texts. Boxes are looked for on the prepared page, if that is given, and
    cut from the page as it is.
    """
    keys = ["path", "page"]
    seen = prepare(pages) if prepare else pages
    lines = reading_order(detect(seen, detector, keys), keys)
    cut = crops(pages, lines, keys, pad)
    schema = StructType([*(f for f in cut.schema if f.name != "crop"), StructField("text", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for frame in frames:
            texts = list(read(list(frame["crop"])))
            # as many as there are: a line without an answer has no text
            texts += [None] * (len(frame) - len(texts))
            yield frame.drop(columns="crop").assign(text=texts[: len(frame)])

    return lines.join(cut.mapInPandas(run, schema).drop("line"), [*keys, "pred"]).select(*keys, "line", "pred", "x", "y", "w", "h", "score", "text")


def page_texts(lines: DataFrame) -> DataFrame:
    """(path, text): lines joined by line breaks, pages by empty lines."""
    return T.page_texts(lines, ["path"], "page", "line", "text")
