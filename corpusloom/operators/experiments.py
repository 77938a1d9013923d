"""Analytics over metric series (arm, step, train_loss, val_loss, ...): best step, early stopping, comparisons."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize(series: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm: rows, first and last step, best value with its step (the first of equals), last value."""
    best = F.min_by(F.struct("step", "val_loss"), F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "step")))
    last = F.max_by("val_loss", F.when(F.col("val_loss").isNotNull(), F.col("step")))
    return series.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        best["val_loss"].alias("best_val"),
        best["step"].alias("best_step"),
        last.alias("last_val"),
    )


def rank_arms(summary: DataFrame, by: str = "best_val") -> DataFrame:
    """summary with rank by a value, arms without one last; arms are few, one row each."""
    order = Window.orderBy(F.col(by).asc_nulls_last(), "arm")
    return summary.withColumn("rank", F.row_number().over(order))


def running_best(series: DataFrame, arm: str = "arm", start: float = 1e9) -> DataFrame:
    """series with prev_best, the least value before, and is_best; the first step is never best."""
    w = Window.partitionBy(arm).orderBy("step")
    least = F.least(F.lit(start), F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = series.withColumn("prev_best", F.coalesce(least, F.lit(start)))
    return out.withColumn("is_best", F.coalesce((F.col("val_loss") < F.col("prev_best")) & (F.col("step") > 0), F.lit(False)))


def early_stop(series: DataFrame, arm: str = "arm", min_steps: int = 0, least_gain: float = 0.0, patience: int = 3) -> DataFrame:
    """Per arm: stop_step, the step at which `patience` evaluations in a row brought no gain; null if none.

    A gain is a value below the best before by more than least_gain; steps before min_steps don't count.
    Runs without gain are islands between gains, numbered by a running count.
    """
    w = Window.partitionBy(arm).orderBy("step")
    judged = running_best(series, arm).where(F.col("step") >= min_steps)
    gain = F.coalesce(F.col("val_loss") < F.col("prev_best") - least_gain, F.lit(False))
    islands = judged.withColumn("_gain", gain).withColumn("_island", F.sum(F.col("_gain").cast("int")).over(w))
    of_island = Window.partitionBy(arm, "_island").orderBy("step")
    run = islands.withColumn("_run", F.sum((~F.col("_gain")).cast("int")).over(of_island))
    return run.groupBy(arm).agg(F.min(F.when(F.col("_run") >= patience, F.col("step"))).alias("stop_step"))


def ema_series(series: DataFrame, value: str, arm: str = "arm", keep: float = 0.9, size: int = 4096) -> DataFrame:
    """(arm, step, ema): the exponential mean after each step: keep * mean + (1 - keep) * value, begun by the first value.

    A run of n steps takes a mean m to keep**n * m + its own part, an affine map, and two such maps compose to one. So
    each block of `size` step numbers is folded by itself; the blocks' maps, one row for each, are composed in order to
    what every block begins with; and that is added to the block's own part. A task holds one block of an arm, or the
    maps of one arm. Nulls are no steps; of a step that is there more than once all values count, in order of size.
    """
    known = series.where(F.col(value).isNotNull() & F.col("step").isNotNull())
    steps = F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("v"))))
    blocks = known.groupBy(arm, F.floor(F.col("step") / size).alias("block")).agg(steps.alias("steps"))

    @F.pandas_udf("array<double>")
    def folded(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> np.ndarray:
            out, mean = np.empty(len(v)), 0.0
            for i, x in enumerate(v.tolist()):
                out[i] = mean = mean * keep + x * (1 - keep)
            return out

        return values.map(one)

    blocks = blocks.select(arm, "block", "steps", folded("steps.v").alias("own"))
    maps = blocks.select(arm, "block", F.get("steps.v", F.lit(0)).alias("first"), F.size("own").alias("n"), F.element_at("own", -1).alias("part"))

    def begun(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        mean, out = float(frame["first"].iloc[0]), []
        for n, part in zip(frame["n"], frame["part"], strict=True):
            out.append(mean)
            mean = mean * keep ** int(n) + part
        return pd.DataFrame({"arm": frame["arm"], "block": frame["block"], "mean": out})

    kind = series.schema[arm].dataType.simpleString()
    carried = maps.withColumnRenamed(arm, "arm").groupBy("arm").applyInPandas(begun, f"arm {kind}, block long, mean double")
    carried = carried.select(F.col("arm").alias("_arm"), F.col("block").alias("_block"), "mean")
    joined = blocks.join(carried, F.col(arm).eqNullSafe(F.col("_arm")) & (F.col("block") == F.col("_block")))
    each = joined.select(arm, "mean", F.posexplode(F.arrays_zip("steps.step", "own")).alias("i", "s"))
    return each.select(arm, F.col("s.step").alias("step"), (F.col("mean") * F.pow(F.lit(keep), F.col("i") + 1) + F.col("s.own")).alias("ema"))


def ema(series: DataFrame, value: str, arm: str = "arm", keep: float = 0.9) -> DataFrame:
    """Per arm, the exponential mean after its last step; see ema_series()."""
    return ema_series(series, value, arm, keep).groupBy(arm).agg(F.max_by("ema", "step").alias("ema"))


def learning_rate(step: Column, peak: float, floor: float, warmup: int, decay: int) -> Column:
    """Linear warm-up, cosine decay to floor, then floor."""
    cosine = floor + 0.5 * (1 + F.cos(math.pi * (step - warmup) / (decay - warmup))) * (peak - floor)
    return F.when(step < warmup, peak * (step + 1) / (warmup + 1)).when(step > decay, F.lit(floor)).otherwise(cosine)


def arm_deltas(series: DataFrame, base: str, arm: str = "arm") -> DataFrame:
    """Per arm: last and best value, gain over its first value, and differences to the base arm's."""
    first = F.min_by("val_loss", "step")
    table = series.groupBy(arm).agg(
        F.max_by("val_loss", "step").alias("last_val"),
        F.min("val_loss").alias("best_val"),
        (F.min("val_loss") - first).alias("delta_val"),
    )
    of_base = table.where(F.col(arm) == base).select(F.col("last_val").alias("_last"), F.col("best_val").alias("_best"))
    return table.crossJoin(F.broadcast(of_base.limit(1))).select(
        arm,
        "last_val",
        "best_val",
        "delta_val",
        (F.col("last_val") - F.col("_last")).alias("last_delta"),
        (F.col("best_val") - F.col("_best")).alias("best_delta"),
    )


def zip_runs(new: DataFrame, base: DataFrame) -> DataFrame:
    """(n, step, new_val, base_val, delta): two runs sorted by step and paired by place, up to the shorter."""
    nth = F.row_number().over(Window.orderBy("step"))  # one training run each: its evaluations, not its data
    a = new.select(nth.alias("n"), "step", F.col("val_loss").alias("new_val"))
    b = base.select(nth.alias("n"), F.col("val_loss").alias("base_val"))
    return a.join(b, "n").withColumn("delta", F.col("new_val") - F.col("base_val"))


def mfu(n_params: Column, layers: Column, heads: Column, head_size: Column, block: Column, passes: Column, seconds: Column, peak: float = 312e12) -> Column:
    """Share of the peak floating point rate that a training iteration reaches."""
    per_token = 6 * n_params + 12 * layers * heads * head_size * block
    return per_token * block * passes / seconds / peak


def architecture_tags(flags: dict[str, str]) -> Column:
    """array<string> of the labels whose flag column is true."""
    return F.array_compact(F.array(*(F.when(F.col(flag), label) for flag, label in flags.items())))


def compare_vectors(left: DataFrame, right: DataFrame, tolerance: float = 0.01, k: int = 5) -> DataFrame:
    """One row: largest and mean absolute difference of (idx, value) tables, whether their top k agree, passed."""
    top = lambda side: F.slice(F.array_sort(F.collect_list(F.struct((-F.col(side)).alias("v"), "idx"))), 1, k)
    joined = left.select("idx", F.col("value").alias("a")).join(right.select("idx", F.col("value").alias("b")), "idx")
    best = lambda side: joined.orderBy(F.desc(side), "idx").limit(k).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col(side)).alias("v"), "idx"))), lambda x: x["idx"]).alias(f"top_{side}")
    )
    errors = joined.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_error"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_error"))
    both = errors.crossJoin(best("a")).crossJoin(best("b"))  # one row each
    same = F.col("top_a") == F.col("top_b")
    return both.select("max_error", "mean_error", same.alias("same_top"), (same & (F.col("max_error") < tolerance)).alias("passed"))


def estimate_loss(losses: DataFrame, split: str, batch: str, value: str, batches: int) -> DataFrame:
    """(split, loss): the mean over its first batches of a split of each batch's mean; partial sums a batch are shuffled."""
    means = losses.where(F.col(batch) < batches).groupBy(split, batch).agg(F.avg(value).alias("__mean"))
    return means.groupBy(split).agg(F.avg("__mean").alias("loss"))
