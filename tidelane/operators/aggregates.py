"""Aggregates over trials, rollouts and metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a reward may be from 1 and still be a success.
TOLERANCE = 1e-6


def is_success(reward: Column) -> Column:
    return F.abs(reward - 1) <= TOLERANCE


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k); null where n < k."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * ((n - c - i) / F.greatest(n - i, F.lit(1)))
    return F.when(n >= k, F.when(n - c < k, 1.0).otherwise(1 - miss))


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """C(c, k) / C(n, k); null where n < k."""
    hit = F.lit(1.0)
    for i in range(k):
        hit = hit * (F.greatest(c - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n >= k, hit)


def task_pass(trials: DataFrame, ks: Iterable[int], task: str = "task_id", reward: str = "reward") -> DataFrame:
    """Trials and successes of each task, with pass_at_k and pass_hat_k for each k."""
    counts = trials.groupBy(task).agg(F.count(reward).alias("n"), F.count_if(is_success(F.col(reward))).alias("c"))
    n, c = F.col("n"), F.col("c")
    return counts.withColumns({f"pass_at_{k}": pass_at_k(n, c, k) for k in ks} | {f"pass_hat_{k}": pass_hat_k(n, c, k) for k in ks})


def macro_pass(trials: DataFrame, ks: Iterable[int], task: str = "task_id", reward: str = "reward") -> DataFrame:
    """Means over tasks; tasks with fewer than k trials don't count for k."""
    ks = list(ks)
    return task_pass(trials, ks, task, reward).agg(F.count("*").alias("tasks"), *(F.avg(f"pass_{x}_{k}").alias(f"pass_{x}_{k}") for k in ks for x in ("at", "hat")))


def trial_summary(plan: DataFrame, results: DataFrame, task: str = "task_id", trial: str = "trial", reward: str = "reward") -> DataFrame:
    """One row: planned, scored, complete; and metrics, null unless every planned trial is scored."""
    joined = plan.select(task, trial).join(results.select(task, trial, reward), [task, trial], "left")
    scored, planned = F.count(reward), F.count("*")
    whole = scored == planned
    return joined.agg(planned.alias("planned"), scored.alias("scored"), whole.alias("complete"), F.when(whole, F.avg(reward)).alias("mean_reward"), F.when(whole, F.avg(is_success(F.col(reward)).cast("double"))).alias("solve_rate"))


def group_mean_std(df: DataFrame, key: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Mean and sample deviation (of a variance of eps at least); a group of one has mean 0 and deviation 1."""
    n = F.count(value)
    return df.groupBy(key).agg(n.alias("n"), F.when(n > 1, F.avg(value)).otherwise(0.0).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(F.var_samp(value), F.lit(eps)))).otherwise(1.0).alias("std"))


def group_normalize(df: DataFrame, key: str, value: str, least: int = 2, eps: float = 1e-6) -> DataFrame:
    """Adds `normalized`: the distance from the mean over the population deviation plus eps; 0 in groups that are small or constant."""
    w = Window.partitionBy(key)
    flat = (F.count(value).over(w) < least) | (F.max(value).over(w) == F.min(value).over(w))
    return df.withColumn("normalized", F.when(flat, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + eps)))


def majority_vote(df: DataFrame, key: str, vote: str, value: str, order: str) -> DataFrame:
    """The most frequent vote of each key, the first seen among equals, and the value of its
    first voter (the least, if several are first)."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("f")
    votes = df.groupBy(key, vote).agg(F.count("*").alias("votes"), first).select(key, vote, "votes", F.col("f.o").alias("first_"), F.col("f.v").alias("value_"))
    best = F.max_by(F.struct(vote, "votes", "value_"), F.struct("votes", -F.col("first_"))).alias("b")
    return votes.groupBy(key).agg(best).select(key, F.col(f"b.{vote}").alias(vote), F.col("b.votes").alias("votes"), F.col("b.value_").alias(value))


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Sum, mean (over the mask's sum plus 1e-8) and unbiased variance of masked values. The
    mean comes first, and then the squared distances from it."""
    m = F.col(mask).cast("double")
    on = df.filter(m != 0)
    first = on.agg(F.sum(F.col(value) * m).alias("masked_sum"), F.sum(m).alias("n_")).withColumn("masked_mean", F.col("masked_sum") / (F.col("n_") + 1e-8))
    n, d = F.col("n_"), F.col(value) - F.col("masked_sum") / F.col("n_")
    spread = on.crossJoin(F.broadcast(first)).agg(F.sum(d * d * m).alias("d_"))
    return first.crossJoin(spread).select("masked_sum", "masked_mean", (F.col("d_") / n * n / (n - 1)).alias("masked_var"))


def aggregate_loss(df: DataFrame, loss: str, mask: str, row: str, mode: str, scale: float | None = None) -> DataFrame:
    """One value: token-mean, seq-mean-token-sum, seq-mean-token-sum-norm or seq-mean-token-mean
    over tokens in long form. The norm divides the mean of the sequences' sums by `scale`, the
    length that they are padded to."""
    m = F.col(mask).cast("double")
    if mode == "token-mean":
        return df.agg((F.sum(F.col(loss) * m) / F.sum(m)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        if not scale:
            raise ValueError("seq-mean-token-sum-norm needs a scale")
        return aggregate_loss(df, loss, mask, row, "seq-mean-token-sum").select((F.col("loss") / scale).alias("loss"))
    total, n = F.sum(F.col(loss) * m), F.sum(m)
    per = {"seq-mean-token-sum": total, "seq-mean-token-mean": total / (n + 1e-8)}
    if mode not in per:
        raise ValueError(f"unknown mode {mode}")
    rows = df.groupBy(row).agg(per[mode].alias("loss_"), n.alias("n_"))
    return rows.filter("n_ > 0").agg(F.avg("loss_").alias("loss"))


def quantiles(df: DataFrame, value: str, keys: list[str], points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation. Equal values are counted before the shuffle; a
    group's distinct values are then sorted, and may spill, instead of being held in a buffer."""
    w = Window.partitionBy(*keys, F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    upto = counts.withColumn("to_", F.sum("c_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_", F.sum("c_").over(w))
    out = []
    for name, p in points.items():
        at = (F.col("n_") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: F.max(F.when((F.col("to_") > k) & (F.col("to_") - F.col("c_") <= k), F.col(value).cast("double")))
        part = F.max(at - low)
        out.append((holds(low) + (holds(high) - holds(low)) * part).alias(name))
    return upto.groupBy(*keys).agg(*out)


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, coverage, sum, mean, and exact median and 95th percentile with linear interpolation."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), (F.count(value) / F.count("*")).alias("coverage"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    ranks = quantiles(df, value, list(keys), {"p50": 0.5, "p95": 0.95})
    if not keys:
        return plain.join(ranks)
    same = [F.col(f"{k}_k").eqNullSafe(F.col(k)) for k in keys]
    return plain.join(ranks.withColumnsRenamed({k: f"{k}_k" for k in keys}), same, "left").drop(*(f"{k}_k" for k in keys))


def reduce_metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    """One value per name: the largest if the name has "max" in it, the least if "min", else the mean."""
    kind = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(kind.alias("value"))


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value by order, greatest and mean: a telemetry summary."""
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of rows with both; null where one doesn't vary."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return both.agg(F.count("*").alias("n"), F.when(varies, F.corr(x, y)).alias("correlation"))


def association(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Correlation after both are centred within groups."""
    w = Window.partitionBy(key)
    return correlation(df.select((F.col(x) - F.avg(x).over(w)).alias("x"), (F.col(y) - F.avg(y).over(w)).alias("y")), "x", "y")


def paired_bootstrap(pairs: DataFrame, resamples: int = 2000, confidence: float = 0.95, seed: int = 42, base: str = "baseline", new: str = "treatment") -> DataFrame:
    """Mean difference of aligned tasks, its interval and a centred two-sided p-value.

    A resample weighs every task by a Poisson number of mean 1, as drawing tasks with
    replacement does where they are many, so that tasks never meet: each batch of them gives
    its weighted sum and weights for all resamples, and Spark adds these up. Draws are
    seeded by partition and batch.
    """
    differences = pairs.select((F.col(new) - F.col(base)).cast("double").alias("d")).filter("d is not null")

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for part in parts:
            d = part["d"].to_numpy()
            for at in range(0, len(d), 4096):
                own = d[at : at + 4096]
                weight = rng.poisson(1.0, (len(own), resamples))
                yield pd.DataFrame({"id": np.arange(resamples), "total": own @ weight, "weight": weight.sum(axis=0).astype(float)})

    if differences.isEmpty():
        raise ValueError("no task is in both")
    mean = differences.agg(F.avg("d").alias("difference"))
    draws = differences.mapInPandas(draw, "id long, total double, weight double").groupBy("id").agg((F.sum("total") / F.sum("weight")).alias("mean")).filter("mean is not null")
    tail = (1 - confidence) / 2
    seen = draws.crossJoin(F.broadcast(mean))
    apart = F.abs(F.col("mean") - F.col("difference")) >= F.abs(F.col("difference"))
    return seen.groupBy("difference").agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"), F.avg(apart.cast("double")).alias("p_value"))
