"""Running counts over a whole table, and folds over sorted rows, without a task that holds a table or a group.

A total order is made by range partitioning; what lies before a partition is a sum over
partitions, of which there are few. Folds stream through rows sorted by group and order and
carry one state, so their cost grows with the rows, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


_kept: list[DataFrame] = []


def release() -> None:
    """Give back the rows that `running` keeps, once the results that need them are written."""
    while _kept:
        _kept.pop().unpersist()


def running(df: DataFrame, order: list[Column], sums: list[str], place: str = "place") -> DataFrame:
    """df with `place` (from 1 in the order) and, under its own name, the running sum of each of `sums`.

    The order must tell all rows apart. The range-partitioned rows are kept (see `release`),
    so that both passes see the same partitions; a lost block is made again with the same bounds.
    """
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    _kept.append(part)
    totals = part.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select("_part", offset("_n").alias("_n"), *(offset(f"_sum_{c}").alias(f"_sum_{c}") for c in sums))
    so_far = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = part.withColumns({place: F.row_number().over(so_far), **{c: F.sum(c).over(so_far) for c in sums}})
    out = out.join(F.broadcast(totals), "_part")
    added = {place: F.col(place) + F.col("_n"), **{c: F.col(c) + F.col(f"_sum_{c}") for c in sums}}
    return out.withColumns(added).drop("_part", "_n", *(f"_sum_{c}" for c in sums))


def fold(df: DataFrame, keys: list[str], order: list[Column], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], schema: str) -> DataFrame:
    """For each row (a tuple), in order within its keys, what `step` makes of the group's state and the row; None gives no row.

    Rows of equal keys follow one another in one partition, sorted, so only a state is held.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    key_of = itemgetter(*(df.columns.index(k) for k in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = key_of(row)
                if fresh or key != last:
                    last, state, fresh = key, start(), False
                if (made := step(state, row)) is not None:
                    out.append(made)
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], kinds.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
