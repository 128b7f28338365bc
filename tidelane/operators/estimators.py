"""Group-relative advantage estimators.

Each adds `advantage`, one value per row, to rollouts with a group column and a score.
Groups are window partitions: one shuffle on the group, whatever the estimator.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.scans import backward

EPSILON = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"an estimator named {name} is registered already")
        return f

    return add


def advantage(name: str, rollouts: DataFrame, **options) -> DataFrame:
    """Dispatch by name."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](rollouts, **options)


def whiten(df: DataFrame, value: str, weight: str, name: str = "advantage", shift_mean: bool = True) -> DataFrame:
    """Adds `name`: value less its weighted mean, over its weighted unbiased deviation, over
    all of df. The mean comes first and then the squared distances from it, which large means
    don't cancel; each is one row, and broadcast. Without shift_mean the mean is added again."""
    v, w = F.col(value), F.col(weight)
    mean = df.agg((F.sum(v * w) / F.sum(w)).alias("mean_"))
    centred = df.crossJoin(F.broadcast(mean))
    n, d = F.sum(w), v - F.col("mean_")
    var = centred.agg((F.sum(d * d * w) / n * n / (n - 1)).alias("var_"))
    scaled = d / F.sqrt(F.col("var_") + 1e-8)
    return centred.crossJoin(F.broadcast(var)).withColumn(name, scaled if shift_mean else scaled + F.col("mean_")).drop("mean_", "var_")


def _group(score: str, uid: str) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation over the group; a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(uid)
    n = F.count(F.lit(1)).over(w)
    one = n == 1
    return n, F.when(one, 0.0).otherwise(F.avg(score).over(w)), F.when(one, 1.0).otherwise(F.stddev_samp(score).over(w))


@register("grpo")
def grpo(df: DataFrame, score: str = "score", uid: str = "uid", by_std: bool = True) -> DataFrame:
    _, mean, std = _group(score, uid)
    centred = F.col(score) - mean
    return df.withColumn("advantage", centred / (std + EPSILON) if by_std else centred)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, score: str = "score", uid: str = "uid", by_std: bool = True) -> DataFrame:
    n, mean, _ = _group(score, uid)
    std = F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score).over(Window.partitionBy(uid)), F.lit(EPSILON))))
    centred = F.col(score) - mean
    return df.withColumn("advantage", centred / (std + EPSILON) if by_std else centred)


@register("grpo_passk")
def grpo_passk(df: DataFrame, score: str = "score", uid: str = "uid", row: str = "row_id", by_std: bool = True) -> DataFrame:
    """The best row of a group gets its lead over the second best; groups of one are an error."""
    w = Window.partitionBy(uid)
    best = w.orderBy(F.desc(score), row)
    lead = F.col(score) - F.lead(score).over(best)
    ranked = df.withColumns({"rank_": F.row_number().over(best), "lead_": lead, "n_": F.count(F.lit(1)).over(w), "std_": F.stddev_samp(score).over(w)})
    value = F.col("lead_") / (F.col("std_") + EPSILON) if by_std else F.col("lead_")
    short = F.raise_error(F.lit("pass@k advantages need two or more rows in a group"))
    return ranked.withColumn("advantage", F.when(F.col("n_") < 2, short.cast("double")).when(F.col("rank_") == 1, value).otherwise(0.0)).drop("rank_", "lead_", "n_", "std_")


@register("rloo")
def rloo(df: DataFrame, score: str = "score", uid: str = "uid", single: str = "score") -> DataFrame:
    """Leave-one-out; a row alone in its group keeps its score, or gets 0 (single="zero")."""
    w = Window.partitionBy(uid)
    n, total = F.count(F.lit(1)).over(w), F.sum(score).over(w)
    alone = F.col(score) if single == "score" else F.lit(0.0)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(score) - total) / (n - 1)).otherwise(alone))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    return rloo(df, score, uid, single="zero")


@register("opo")
def opo(df: DataFrame, score: str = "score", uid: str = "uid", length: str = "length") -> DataFrame:
    w = Window.partitionBy(uid)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(base))


@register("gpg")
def gpg(df: DataFrame, score: str = "score", uid: str = "uid", f_norm: float = 1.0) -> DataFrame:
    """Centred scores times rows / rows with a score, over all of df."""
    _, mean, _ = _group(score, uid)
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("alpha_"))
    return df.withColumn("centred_", F.col(score) - mean).crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("alpha_") * F.col("centred_") / f_norm).drop("alpha_", "centred_")


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, score: str = "score", uid: str = "uid", length: str = "length") -> DataFrame:
    """Group-centred scores, whitened over all valid tokens (every row counts `length` times)."""
    _, mean, _ = _group(score, uid)
    return whiten(df.withColumn("centred_", F.col(score) - mean), "centred_", length).drop("centred_")


@register("episode")
def episode(df: DataFrame, score: str = "score", uid: str = "uid", f_norm: float = 1.0) -> DataFrame:
    """Mean-centred within the group, divided by a fixed norm."""
    return df.withColumn("advantage", (F.col(score) - F.avg(score).over(Window.partitionBy(uid))) / f_norm)


def step_advantage(steps: DataFrame, value: str = "value", anchor: str = "anchor", f_norm: float = 1.0, least: int = 2) -> DataFrame:
    """Centred within steps of one anchor state; smaller groups, and steps without an anchor, get 0."""
    w = Window.partitionBy(anchor)
    enough = F.col(anchor).isNotNull() & (F.count(F.lit(1)).over(w) >= least)
    return steps.withColumn("advantage", F.when(enough, (F.col(value) - F.avg(value).over(w)) / f_norm).otherwise(0.0))


def discounted_returns(rewards: str, gamma: float, mask: str | None = None) -> Column:
    """For each position of an array of rewards, its discounted sum to the end; outside the
    mask a position has, and passes on, the value of the next one."""

    def step(now: list[np.ndarray], state: list[np.ndarray]) -> tuple:
        value = now[0] + gamma * state[0]
        value = np.where(now[1] == 1, value, state[0]) if mask else value
        return value, [value]

    return backward(step, 1, *([rewards, mask] if mask else [rewards]))


def gae(rewards: str, values: str, gamma: float, lam: float, mask: str | None = None) -> Column:
    """Generalised advantage estimates of one row's arrays of rewards and values; a masked
    position has the estimate of the next valid one, and is passed over by those before it."""

    def step(now: list[np.ndarray], state: list[np.ndarray]) -> tuple:
        following, last = state
        value = now[0] + gamma * following - now[1] + gamma * lam * last
        if not mask:
            return value, [now[1], value]
        valid = now[2] == 1
        value = np.where(valid, value, last)
        return value, [np.where(valid, now[1], following), value]

    return backward(step, 2, *([rewards, values, mask] if mask else [rewards, values]))


@register("gae")
def gae_advantage(df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0, row: str = "row_id") -> DataFrame:
    """(row, pos, return, advantage) for every token of rows of arrays: estimates whitened over
    the valid tokens of all rows; the return is the estimate plus the value, before whitening."""
    tokens = df.select(row, F.posexplode(F.arrays_zip(gae(rewards, values, gamma, lam, mask).alias("a"), F.col(values).alias("v"), F.col(mask).alias("m"))).alias("pos", "x"))
    tokens = tokens.select(row, "pos", F.col("x.a").alias("a_"), (F.col("x.a") + F.col("x.v")).alias("return"), F.col("x.m").alias("m_"))
    return whiten(tokens, "a_", "m_").select(row, "pos", "return", "advantage")


def kl_penalty(kind: str, logp: str = "logp", ref: str = "ref") -> Column:
    """Per-token estimates of KL divergence: k1, abs, k2 and k3 (with their long names)."""
    d = F.col(logp) - F.col(ref)
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        back = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(back) - back - 1))
    raise NotImplementedError(kind)


@register("gdpo")
def gdpo(df: DataFrame, scores: tuple[str, ...] = ("score",), weights: tuple[float, ...] | None = None, uid: str = "uid", length: str = "length", by_std: bool = True) -> DataFrame:
    """Each reward normalised within the group by itself, their weighted sum whitened over all valid tokens."""
    total = F.lit(0.0)
    for score, weight in zip(scores, weights or (1.0,) * len(scores), strict=True):
        _, mean, std = _group(score, uid)
        centred = F.col(score) - mean
        total = total + weight * (centred / (std + EPSILON) if by_std else centred)
    return whiten(df.withColumn("total_", total), "total_", length).drop("total_")
