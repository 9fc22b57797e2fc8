"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and 0x09-0x0D. `bytes.split()`
splits at exactly these, so Python stages work on UTF-8 bytes, whole texts only.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker at a time; texts can be long, so its memory stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/quillspark"


_opened = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were staged within; what is to last is staged after it."""
    outer, _opened.paths = getattr(_opened, "paths", None), []
    try:
        yield
    finally:
        paths, _opened.paths = _opened.paths, outer
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a reread and not a rerun, and
    gives the optimizer the real size of the table. A `scratch` around deletes it,
    unless it is lasting.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting and getattr(_opened, "paths", None) is not None:
        _opened.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result staged and the tables on the way to it deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return staged(query(spark, sf_dir), "result", lasting=True)

    return run


def utf8(column: str) -> Column:
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def rows_of(batch: pa.RecordBatch, names: list[str]) -> zip:
    """Python values of the named columns, row by row."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def n_words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
