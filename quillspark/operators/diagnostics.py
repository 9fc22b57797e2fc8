"""Training-run series: ordered folds and windows per run.

A run's series is folded in step order within its key, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.ordered import fold


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ema(df: DataFrame, key: str, step: list[str], value: str, decay: float = 0.98, keep: Column | None = None) -> DataFrame:
    """(key, step, value, ema): seeded with the first value; values that are not finite, or not to keep, are skipped."""
    df = df.filter(finite(F.col(value)) & (F.lit(True) if keep is None else keep)).select(key, *step, F.col(value).cast("double").alias(value))

    def smooth(state: list, row: tuple) -> tuple:
        state[:] = [decay * state[0] + (1 - decay) * row[-1] if state else row[-1]]
        return (*row, state[0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return fold(df, [key], [F.col(s) for s in step], list, smooth, f"{schema}, ema double")


def best_so_far(df: DataFrame, key: str, step: list[str], value: str, smallest: bool = True) -> DataFrame:
    """With `best` (up to and with this step) and `improved` (strictly better than all before)."""
    order = W.partitionBy(key).orderBy(*step)
    pick = F.min if smallest else F.max
    before = pick(value).over(order.rowsBetween(W.unboundedPreceding, -1))
    better = F.col(value) < before if smallest else F.col(value) > before
    return df.withColumns({"best": pick(value).over(order.rowsBetween(W.unboundedPreceding, 0)), "improved": before.isNull() | better})


def lr_suggestion(df: DataFrame, key: str) -> DataFrame:
    """Rate at the smallest smoothed loss over 10; null with fewer than two points. df: key, step, lr, ema."""
    least = F.min_by("lr", F.struct("ema", "step"))
    return df.groupBy(key).agg(F.when(F.count("*") >= 2, least / 10).alias("suggested_lr"))


def until_divergence(df: DataFrame, key: str, step: str, value: str, after: int = 10, times: float = 4.0) -> DataFrame:
    """Rows up to and with the first where step > after and the value is over `times` the minimum so far."""
    order = W.partitionBy(key).orderBy(step)
    least = F.min(value).over(order.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_bad", ((F.col(step) > after) & (F.col(value) > times * least)).cast("int"))
    seen = F.coalesce(F.sum("_bad").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_seen", seen).filter("_seen = 0").drop("_bad", "_seen")


def growth_factor(lr_min: float, lr_max: float, steps: int) -> float:
    return (lr_max / lr_min) ** (1 / steps)


def lr_schedule(lr_min: float, lr_max: float, steps: int) -> Column:
    """Array of the rates at steps 0 to `steps`, each the same factor above the one before, from lr_min to lr_max."""
    growth = growth_factor(lr_min, lr_max, steps)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.lit(lr_min) * F.pow(F.lit(growth), k))


def warmup(step: Column, warm_epochs: float, epoch_steps: int) -> Column:
    return F.least(step / (warm_epochs * epoch_steps), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other sizes, null or zero norm."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(usable, dot(a, b) / (norm(a) * norm(b))), F.lit(0.0))


def vector_steps(df: DataFrame, key: str, step: str, vector: str) -> DataFrame:
    """Cosine with the vector before, norm of the update, and its ratio to the norm of the vector; 0 at the first step."""
    before = F.lag(vector).over(W.partitionBy(key).orderBy(step))
    df = df.withColumn("_before", before)
    update = norm(F.zip_with(F.col(vector), F.col("_before"), lambda x, y: x.cast("double") - y.cast("double")))
    size = norm(F.col(vector))
    return df.select(key, step, cosine(F.col(vector), F.col("_before")).alias("cosine"), F.coalesce(update, F.lit(0.0)).alias("update_norm"),
                     F.coalesce(F.when(size > 0, update / size), F.lit(0.0)).alias("update_ratio"))


def flattened(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """keys and `vector`: the parts of each group, in order, as one vector; parts that are null are left out."""
    parts = F.array_sort(F.collect_list(F.when(F.col(vector).isNotNull(), F.struct(order, F.col(vector).alias("v")))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["v"])).alias("vector"))


def momentum_stats(df: DataFrame, keys: list[str], order: str, momentum: str, gradient: str) -> DataFrame:
    """keys, norm of the momentum and its cosine with the gradient, over parts that have both; zeros where none has."""
    both = F.when(F.col(momentum).isNotNull() & F.col(gradient).isNotNull(), F.struct(order, F.col(momentum).alias("m"), F.col(gradient).alias("g")))
    parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(both)).alias("parts"))
    whole = lambda c: F.flatten(F.transform("parts", lambda p: p[c]))
    return parts.select(*keys, norm(whole("m")).alias("momentum_norm"), cosine(whole("m"), whole("g")).alias("momentum_grad_cosine"))


def split_like(vector: Column, sizes: Column) -> Column:
    """A vector cut into consecutive parts of the sizes."""
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda s, n: s + n.cast("int")))
    return F.zip_with(ends, sizes, lambda end, n: F.slice(vector, end - n.cast("int") + 1, n.cast("int")))


def perturbed(values: Column, direction: Column, eps: float) -> Column:
    return F.zip_with(values, direction, lambda x, d: x + eps * d)


def tracked(df: DataFrame, key: str, step: str, spec: dict[str, str]) -> DataFrame:
    """For metrics in columns, by spec to be smallest (`min`) or largest (`max`): `improved`, the names that are strictly better than ever before at each step; null is no value."""
    order = W.partitionBy(key).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    better = []
    for name, mode in spec.items():
        before = (F.min if mode == "min" else F.max)(name).over(order)
        beats = F.col(name) < before if mode == "min" else F.col(name) > before
        better.append(F.when(F.col(name).isNotNull() & (before.isNull() | beats), F.lit(name)))
    return df.withColumn("improved", F.array_compact(F.array(*better)))


def aliases(step: str, improved: str = "improved") -> Column:
    """Names under which a checkpoint is kept: latest, its epoch, and what it is best at."""
    own = F.array(F.lit("latest"), F.concat(F.lit("epoch_"), F.col(step).cast("string")))
    return F.concat(own, F.transform(F.col(improved), lambda n: F.concat(F.lit("best_"), n)))


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    """Steps at which a probe runs."""
    return df.filter(F.col(step) % n == 0)


def shown_epochs(df: DataFrame, key: str, epoch: str, every: int) -> DataFrame:
    """Every n-th epoch of a run, and its last."""
    last = F.max(epoch).over(W.partitionBy(key))
    return df.withColumn("_last", last).filter((F.col(epoch) % every == 0) | (F.col(epoch) == F.col("_last"))).drop("_last")


def curvature(plus: Column, zero: Column, minus: Column, eps: float) -> Column:
    """Second difference of the loss along a direction."""
    return (plus - 2 * zero + minus) / (eps * eps)


def dominant_eigenvalue(matrix: DataFrame, rounds: int = 8, seed: int = 0) -> float:
    """The eigenvalue of largest size, with its sign, by power iteration on (row, col, value) from a seeded start.

    Each product is a join and a sum; only numbers reach the driver. 0 where a product vanishes.
    """
    chance = F.xxhash64(F.lit(seed), F.col("i")) / F.lit(2.0**63)
    v = matrix.select(F.col("col").alias("i")).union(matrix.select(F.col("row"))).distinct().withColumn("x", chance)
    size = lambda y: y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0
    v, value = v.withColumn("x", F.col("x") / F.lit(size(v) or 1.0)), 0.0
    for _ in range(rounds):
        y = matrix.join(v, matrix["col"] == v["i"]).groupBy(F.col("row").alias("i")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))
        y = y.checkpoint() if y.sparkSession.sparkContext.getCheckpointDir() else y
        length = size(y)
        if length == 0:
            return 0.0
        value = y.join(v.withColumnRenamed("x", "u"), "i").agg(F.sum(F.col("u") * F.col("x"))).first()[0] or 0.0
        v = y.withColumn("x", F.col("x") / length)
    return value


def run_diagnostics(df: DataFrame, key: str, step: str, loss: list[str], gradient: str, weights: str, decay: float = 0.98) -> DataFrame:
    """(key, step, train_loss, ema, gradient_norm, gradient_cosine, update_norm, update_ratio) of a training run, in one table."""
    from quillspark.operators.reporting import train_loss

    total = train_loss(df, loss)
    smooth = ema(total.select(key, step, "train_loss"), key, [step], "train_loss", decay).select(key, step, "ema")
    grads = vector_steps(df, key, step, gradient).select(key, step, F.col("cosine").alias("gradient_cosine"))
    moved = vector_steps(df, key, step, weights).select(key, step, "update_norm", "update_ratio")
    out = total.select(key, step, "train_loss", norm(F.col(gradient)).alias("gradient_norm"))
    for part in (smooth, grads, moved):
        out = out.join(part, [key, step], "left")
    return out.select(key, step, "train_loss", "ema", "gradient_norm", "gradient_cosine", "update_norm", "update_ratio")
