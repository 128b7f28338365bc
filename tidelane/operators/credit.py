"""Turn- and token-level credit.

A rollout's own sequence is an array column, worked on by array functions; what is compared
across rollouts is exploded into one row per turn or token and normalised by windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.aggregates import group_normalize
from tidelane.operators.estimators import discounted_returns, whiten
from tidelane.operators.scans import backward


def turn_credit(rollouts: DataFrame, gamma: float = 0.9, outcome_weight: float = 0.3, uid: str = "uid", row: str = "row_id", rewards: str = "turn_rewards", outcome: str = "outcome") -> DataFrame:
    """(uid, row, turn, turn_return, episode, advantage): a row for each turn of a rollout.

    A turn's return is its reward plus the discounted return of the next one, the outcome
    following the last. Returns are normalised among the rollouts of a group at the same turn
    number, outcomes among the group's rollouts; the advantage adds both, the latter weighted.
    Groups of one, and constant ones, get 0. Rollouts without turns have no rows and don't count.
    """
    active = rollouts.filter(F.size(rewards) > 0)
    episodes = group_normalize(active, uid, outcome).withColumnRenamed("normalized", "episode")
    chained = discounted_returns(f"array_append({rewards}, CAST({outcome} AS DOUBLE))", gamma)
    turns = episodes.select(uid, row, "episode", F.posexplode(F.slice(chained, F.lit(1), F.size(rewards))).alias("turn", "turn_return"))
    keyed = group_normalize(turns.withColumn("key_", F.struct(uid, "turn")), "key_", "turn_return")
    return keyed.select(uid, row, "turn", "turn_return", "episode", (F.col("normalized") + outcome_weight * F.col("episode")).alias("advantage"))


def reset_returns(rewards: str, mask: str, gamma: float) -> Column:
    """Discounted returns whose running value is multiplied by the mask, so that it starts
    again before a masked position."""

    def step(now: list[np.ndarray], state: list[np.ndarray]) -> tuple:
        value = now[0] + gamma * state[0]
        return value, [value * now[1]]

    return backward(step, 1, rewards, mask)


def reinforce_plus_plus(rollouts: DataFrame, gamma: float = 1.0, row: str = "row_id", rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    """(row, pos, token_return, advantage): discounted returns whitened over all valid tokens; 0 outside the mask."""
    tokens = rollouts.select(row, F.posexplode(F.arrays_zip(reset_returns(rewards, mask, gamma).alias("g"), F.col(mask).alias("m"))).alias("pos", "x"))
    tokens = tokens.select(row, "pos", F.col("x.g").alias("token_return"), F.col("x.m").alias("m_"))
    return whiten(tokens, "token_return", "m_").select(row, "pos", "token_return", (F.col("advantage") * F.col("m_")).alias("advantage"))


def remax(rewards: str, baseline: str, mask: str) -> Column:
    """An array of each position's masked reward-to-go less the row's baseline; 0 less nothing outside the mask."""
    togo = discounted_returns(f"zip_with({rewards}, {mask}, (r, m) -> CAST(r * m AS DOUBLE))", 1.0)
    return F.zip_with(togo, F.col(mask), lambda g, m: g - F.col(baseline) * m)


def token_baseline(tokens: DataFrame, uid: str = "uid", row: str = "row_id", pos: str = "pos", reward: str = "reward", mask: str = "mask", energy: str = "energy", zero_tail: bool = False, epsilon: float = 1e-8) -> DataFrame:
    """Adds `token_return` and `advantage`: reward-to-go less the baseline that is optimal at
    each position of a group, its rollouts' returns weighted by their running energy.

    tokens has a row for each position (from 0) of a rollout. Rollouts alone in their group have no
    baseline. With zero_tail it is also 0 where the longest rollout goes on beyond the
    second longest. For turns on compacted tokens, number the valid ones first (`compact`).
    """
    line, past = Window.partitionBy(uid, row), (Window.unboundedPreceding, 0)
    to_go, so_far = line.orderBy(F.desc(pos)).rowsBetween(*past), line.orderBy(pos).rowsBetween(*past)
    own = tokens.withColumns({"token_return": F.sum(F.col(reward) * F.col(mask)).over(to_go), "w_": F.sum(F.col(energy) * F.col(mask)).over(so_far)})
    lengths = tokens.groupBy(uid, row).agg(F.sum(mask).alias("len_"))
    ranked = lengths.groupBy(uid).agg(F.count("*").alias("n_"), F.slice(F.sort_array(F.collect_list("len_"), asc=False), 1, 2).alias("top_"))
    at = Window.partitionBy(uid, pos)
    base = F.sum(F.col("token_return") * F.col("w_") * F.col(mask)).over(at) / (F.sum(F.col("w_") * F.col(mask)).over(at) + epsilon)
    joined = own.withColumn("base_", base).join(ranked, uid)
    none = F.col("n_") == 1
    if zero_tail:
        joined = joined.join(lengths, [uid, row])
        none = none | ((F.col("len_") == F.element_at("top_", 1)) & (F.try_element_at("top_", F.lit(2)) < F.col("len_")) & (F.col(pos) >= F.try_element_at("top_", F.lit(2))))
    value = (F.col("token_return") - F.when(none, 0.0).otherwise(F.col("base_"))) * F.col(mask)
    return joined.withColumn("advantage", value).drop("w_", "base_", "n_", "top_", "len_")


def compact(tokens: DataFrame, row: str = "row_id", pos: str = "pos", mask: str = "mask") -> DataFrame:
    """The valid tokens alone, with `pos` renumbered from 0 within the row."""
    return tokens.filter(F.col(mask) != 0).withColumn(pos, F.row_number().over(Window.partitionBy(row).orderBy(pos)) - 1)


def step_returns(steps: DataFrame, row: str = "row_id", step: str = "step", outcome: str = "outcome", gamma: float = 0.95) -> DataFrame:
    """Adds `value`: the outcome discounted by the steps that were still to come."""
    w = Window.partitionBy(row)
    left = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(step))
    return steps.withColumn("value", F.col(outcome) * F.pow(F.lit(gamma), left))


def on_spans(length: Column, spans: str, values: str) -> Column:
    """An array of `length` in which each span [start, end) has its value and all else is 0; spans don't overlap."""
    pairs = F.arrays_zip(F.col(spans).alias("s"), F.col(values).alias("v"))
    one = lambda t: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: (p["s"]["start"] <= t) & (t < p["s"]["end"])), F.lit(1))["v"], F.lit(0.0))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), one)).otherwise(F.array().cast("array<double>"))


def call_credit(turns: DataFrame, mode: str = "local", least: int = 2, eps: float = 1e-6, uid: str = "uid") -> DataFrame:
    """turns with call_baseline, turn_support, call_support, fallback_reason and call_advantages.

    turns has uid, turn, reward, turn_return, advantage (see turn_credit), call_rewards (their sum
    is the reward) and eligible. The local mode puts each call's distance from the mean over the
    group's trajectories of their mean call reward at this turn number in place of the turn's
    centred reward; the residual mode adds its distance from the turn's own mean. Both
    are divided by the deviation of the group's returns. Where a reason stands, the turn keeps
    its advantage and call_advantages is empty.
    """
    if mode not in ("local", "residual"):
        raise ValueError(f"unknown call credit {mode}; known: local, residual")
    group = Window.partitionBy(uid, "turn")
    calls = F.coalesce(F.size("call_rewards"), F.lit(0))
    own = F.when(calls > 0, F.expr("aggregate(call_rewards, 0D, (s, q) -> s + q)") / calls)
    known = turns.withColumns({
        "own_": own, "turn_support": F.count("*").over(group), "call_support": F.count(own).over(group), "peers_": F.avg(own).over(group),
        "mean_": F.avg("reward").over(group), "scale_": F.stddev_pop("turn_return").over(group) + eps, "flat_": F.max("turn_return").over(group) == F.min("turn_return").over(group),
    })
    reason = (
        F.when(calls <= 0, "no_calls")
        .when(~F.coalesce("eligible", F.lit(False)), "attribution_ineligible")
        .when(F.col("turn_support") < least, "insufficient_turn_support")
        .when(F.col("call_support") < least, "insufficient_call_support")
        .when(F.col("flat_"), "zero_return_variance")
    )
    if mode == "residual":
        reason = reason.when(calls == 1, "single_call").when(F.array_max("call_rewards") == F.array_min("call_rewards"), "uniform_call_rewards")
    moved = "q - own_" if mode == "residual" else "(q - peers_) - (reward - mean_)"
    known = known.withColumn("fallback_reason", reason).withColumn("call_baseline", F.col("own_" if mode == "residual" else "peers_"))
    known = known.withColumn("call_advantages", F.when(F.col("fallback_reason").isNull(), F.expr(f"transform(call_rewards, q -> advantage + ({moved}) / scale_)")).otherwise(F.expr("CAST(array() AS array<double>)")))
    return known.drop("own_", "peers_", "mean_", "scale_", "flat_")
