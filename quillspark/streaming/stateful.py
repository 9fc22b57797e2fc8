"""Order-dependent operators over metric streams, keyed by run and metric; the step is the order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "run string, metric string, step long, value double, ema double, best double, improved boolean"
STATE = "ema double, best double, seen long"


def smoothed(stream: DataFrame, decay: float = 0.98, smallest: bool = True) -> DataFrame:
    """For (run, metric, step, value): the smoothed value, the best so far and whether it improved strictly.

    A batch is sorted by step within its key; values that are not finite leave the state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        ema, best, seen = state.get if state.exists else (None, None, 0)
        frame = pd.concat(list(frames)).sort_values("step", kind="stable")
        rows = []
        for step, value in zip(frame["step"], frame["value"], strict=True):
            if value is None or value != value or abs(value) == float("inf"):
                continue
            ema = value if seen == 0 else decay * ema + (1 - decay) * value
            better = seen == 0 or (value < best if smallest else value > best)
            best, seen = value if better else best, seen + 1
            rows.append((*key, step, value, ema, best, better))
        if seen:
            state.update((ema, best, seen))
        yield pd.DataFrame(rows, columns=["run", "metric", "step", "value", "ema", "best", "improved"])

    return stream.groupBy("run", "metric").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def until_divergence(stream: DataFrame, decay: float = 0.7, after: int = 10, times: float = 4.0, steps: int | None = None) -> DataFrame:
    """Rows of (run, metric, step, value) with their smoothed value, up to and with the first, past step `after`, over `times` the least smoothed value, or step `steps`."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        ema, least, over = state.get if state.exists else (None, None, False)
        frame = pd.concat(list(frames)).sort_values("step", kind="stable")
        rows = []
        for step, value in zip(frame["step"], frame["value"], strict=True):
            if over or value is None or value != value:
                continue
            ema = value if ema is None else decay * ema + (1 - decay) * value
            least = ema if least is None else min(least, ema)
            over = (step > after and ema > times * least) or (steps is not None and step >= steps)
            rows.append((*key, step, value, ema, over))
        if ema is not None:
            state.update((ema, least, over))
        yield pd.DataFrame(rows, columns=["run", "metric", "step", "value", "ema", "last"])

    out = "run string, metric string, step long, value double, ema double, last boolean"
    return stream.groupBy("run", "metric").applyInPandasWithState(update, out, "ema double, least double, over boolean", "append", "NoTimeout")


def cosines(stream: DataFrame) -> DataFrame:
    """(run, step, cosine) of vectors (run, step, vec) with the one before; 0 for the first, and where sizes differ or a vector is 0."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        before = np.array(state.get[0]) if state.exists else None
        frame = pd.concat(list(frames)).sort_values("step", kind="stable")
        rows = []
        for step, vec in zip(frame["step"], frame["vec"], strict=True):
            now = np.asarray(vec, float)
            sizes = np.linalg.norm(now) * np.linalg.norm(before) if before is not None and len(before) == len(now) else 0.0
            rows.append((*key, step, float(now @ before / sizes) if sizes > 0 else 0.0))
            before = now
        if before is not None:
            state.update((before.tolist(),))
        yield pd.DataFrame(rows, columns=["run", "step", "cosine"])

    return stream.groupBy("run").applyInPandasWithState(update, "run string, step long, cosine double", "vec array<double>", "append", "NoTimeout")


def after_warmup(stream: DataFrame, steps: int = 10) -> DataFrame:
    """Without the first steps of a run."""
    return stream.filter(F.col("step") > steps)


LOG = "timestamp string, kind string, exp_id string, status string"


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """The log of runs as a stream."""
    return spark.readStream.schema(LOG).option("header", True).csv(path)
