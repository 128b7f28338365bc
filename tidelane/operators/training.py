"""Filters of groups and metrics of training batches, in long form: rows, and tokens of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.aggregates import quantiles

TOLERANCE = 1e-9


def classify_groups(df: DataFrame, uid: str = "uid", reward: str = "reward", size: int = 8, top: float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """(uid, n, kind): incomplete where the group hasn't `size` rows (0: any number), all_zero,
    all_one (also where rewards hardly differ), or informative."""
    low, high, n = F.min(reward), F.max(reward), F.count(F.lit(1))
    kind = F.when((n != size) if size > 0 else F.lit(False), "incomplete").when(high <= 0, "all_zero").when((low >= top - tolerance) | (high - low <= tolerance), "all_one").otherwise("informative")
    return df.groupBy(uid).agg(n.alias("n"), kind.alias("kind"))


def filter_stats(groups: DataFrame, *keys: str) -> DataFrame:
    """Of classified groups (by update, if keys name it): candidate and effective groups and rows,
    groups of each other kind, d_bar (the part that isn't effective) and 1 / (1 - d_bar), infinite where none is."""
    kept = F.col("kind") == "informative"
    n, good = F.count("*"), F.count_if(kept)
    return groups.groupBy(*keys).agg(
        n.alias("candidate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_rollouts"), good.alias("effective_groups"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("effective_rollouts"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}_groups") for k in ("all_zero", "all_one", "incomplete")),
        F.when(n > 0, 1 - good / n).otherwise(0.0).alias("d_bar"), F.when(good > 0, n / good).otherwise(F.lit(float("inf"))).alias("inverse_one_minus_d_bar"),
    )


def merge_filter_stats(updates: DataFrame) -> DataFrame:
    """One row over the filter stats of several updates: their number, summed groups, mean and greatest d_bar."""
    d = F.col("d_bar")
    return updates.agg(F.count("*").alias("updates"), *(F.sum(c).alias(c) for c in ("candidate_groups", "effective_groups", "all_zero_groups", "all_one_groups")), F.avg(d).alias("d_bar_mean"), F.max(d).alias("d_bar_max"), F.avg(1 / F.greatest(F.lit(1e-9), 1 - d)).alias("inverse_one_minus_d_bar_mean"))


def advantage_filter(tokens: DataFrame, size: int, uid: str = "uid", row: str = "row_id", tolerance: float = 1e-12, padding: Column | None = None) -> DataFrame:
    """tokens with `mask` 0 in groups without a valid token whose advantage is beyond the
    tolerance, and in padding rows, which never count. A group of another size is an error."""
    pad = F.lit(False) if padding is None else F.coalesce(padding, F.lit(False))
    real = tokens.filter(~pad)
    rows = real.groupBy(uid, row).agg(F.max(F.coalesce((F.abs("adv") > tolerance) & (F.col("mask") > 0), F.lit(False))).alias("s_"))
    groups = rows.groupBy(uid).agg(F.count("*").alias("n_"), F.max("s_").alias("s_"))
    wrong = F.raise_error(F.concat(F.lit("incomplete group "), F.col(uid).cast("string"))).cast("boolean")
    kept = groups.select(uid, F.when(F.col("n_") == size, F.col("s_")).otherwise(wrong).alias("keep_"))
    out = tokens.join(kept, uid, "left")
    return out.withColumn("mask", F.when(F.coalesce("keep_", F.lit(False)) & ~pad, F.col("mask")).otherwise(F.lit(0).cast(tokens.schema["mask"].dataType))).drop("keep_")


def _span(name: str, value: str | Column) -> list[Column]:
    return [F.avg(value).alias(f"{name}_mean"), F.max(value).alias(f"{name}_max"), F.min(value).alias(f"{name}_min")]


def data_metrics(rows: DataFrame, tokens: DataFrame, most_response: int, most_prompt: int, critic: bool = True) -> DataFrame:
    """One row: mean, greatest and least score and reward of rows with a response, of valid
    tokens' advantages, returns and (with a critic) values, lengths and how many are at their
    limit, the part of rows without a response, and the variance of returns that values explain.

    rows: score, reward, response_length, prompt_length. tokens: adv, ret, value, mask.
    """
    live, length = F.col("response_length") > 0, F.col("response_length")
    at = lambda c, most, on=F.lit(True): F.avg(F.when(on, (F.col(c) == most).cast("double")))
    a = rows.agg(
        *_span("score", F.when(live, F.col("score"))), *_span("rewards", F.when(live, F.col("reward"))), *_span("response_length", length), at("response_length", most_response).alias("response_length_clip_ratio"),
        *_span("response_length_non_aborted", F.when(live, length)), at("response_length", most_response, live).alias("response_length_non_aborted_clip_ratio"), F.avg((length == 0).cast("double")).alias("aborted_ratio"),
        *_span("prompt_length", "prompt_length"), at("prompt_length", most_prompt).alias("prompt_length_clip_ratio"),
    )
    more = [*_span("values", "value"), (1 - F.var_samp(F.col("ret") - F.col("value")) / (F.var_samp("ret") + 1e-5)).alias("vf_explained_var")] if critic else []
    return a.crossJoin(tokens.filter(F.col("mask") > 0).agg(*_span("advantages", "adv"), *_span("returns", "ret"), *more))


def timing_metrics(timings: DataFrame, lengths: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """(stage, timing_s, timing_per_token_ms): `gen` counts response tokens, the other stages of
    an update all tokens, and stages of no update have no time per token."""
    total = lengths.agg(F.sum("prompt_length").alias("p_"), F.sum("response_length").alias("r_"))
    per = F.when(F.col(stage) == "gen", F.col("r_")).when(F.col(stage).isin("ref", "values", "adv", "update_critic", "update_actor"), F.col("p_") + F.col("r_"))
    return timings.crossJoin(F.broadcast(total)).select(stage, F.col(seconds).alias("timing_s"), (F.col(seconds) * 1000 / per).alias("timing_per_token_ms"))


def throughput(lengths: DataFrame, seconds: float, devices: int, tokens: str = "tokens") -> DataFrame:
    """One row: total_num_tokens, time_per_step and tokens a second and device."""
    return lengths.agg(F.sum(tokens).alias("total_num_tokens"), F.lit(seconds).alias("time_per_step"), (F.sum(tokens) / (seconds * devices)).alias("throughput"))


def variance_proxies(tokens: DataFrame, gradient_norm: float | None = None, row: str = "row_id", weight: str | None = None) -> DataFrame:
    """One row of proxies of the gradient's variance: signal, total power (the mean of the squared
    mean advantage times W), noise, and both means. W sums 1 - 2 p + sum of squares over a row's valid
    tokens (logp, squares, adv, mask); weights multiply W by their squares and the power by their squared mean."""
    m = F.col("mask").cast("double")
    w = 1 - 2 * F.exp("logp") + F.col("squares")
    rho = F.col(weight) if weight else F.lit(1.0)
    rows = tokens.groupBy(row).agg(
        (F.sum(F.col("adv") * m) / (F.sum(m) + 1e-8)).alias("a"), F.sum(w * rho * rho * m).alias("w"), F.sum(w * rho * rho / F.greatest(rho * rho, F.lit(1e-10)) * m).alias("w0"), (F.sum(rho * m) / (F.sum(m) + 1e-8)).alias("r")
    )
    a2 = F.col("a") * F.col("a")
    power = F.avg((F.col("r") * F.col("r") if weight else F.lit(1.0)) * a2 * F.greatest(F.col("w0" if weight else "w"), F.lit(0.0)))
    signal = None if gradient_norm is None else gradient_norm**2
    noise = F.lit(0.0) if signal is None else F.when(F.count("*") > 1, F.greatest(F.lit(0.0), (power - signal) / (F.count("*") - 1))).otherwise(0.0)
    return rows.agg(F.lit(signal or 0.0).alias("signal_strength"), power.alias("total_power"), noise.alias("pure_noise"), F.avg(a2).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def declared_metrics(values: DataFrame, name: str = "name", kind: str = "kind", rank: str = "rank", step: str = "step", value: str = "value") -> DataFrame:
    """(name, value): means and sums are taken over the steps' means over ranks, least and greatest
    over all values. `kind` is mean, sum, min or max; ranks with unequal numbers of values are an error."""
    steps = values.groupBy(name, kind, step).agg(F.avg(value).alias("a_"), F.min(value).alias("l_"), F.max(value).alias("h_"), F.countDistinct(rank).alias("r_"))
    uneven = F.max("r_") != F.min("r_")
    out = F.when(uneven, F.raise_error(F.lit("ranks have unequal numbers of values")).cast("double")).when(F.col(kind) == "mean", F.avg("a_")).when(F.col(kind) == "sum", F.sum("a_")).when(F.col(kind) == "min", F.min("l_")).when(F.col(kind) == "max", F.max("h_"))
    return steps.groupBy(name, kind).agg(out.alias("value")).select(name, "value")


#: Words of a metric's name that say how a window of it is summed up, in this order.
BY_NAME = [(("timing_s/",), "sum"), (("mean", "avg", "average"), "avg"), (("max", "maximum"), "max"), (("min", "minimum"), "min"), (("sum", "total"), "sum")]


def window_metrics(values: DataFrame, rules: dict[str, Iterable[str]] | None = None, name: str = "name", order: str = "order", value: str = "value", samples: str = "samples") -> DataFrame:
    """(name, value) of a window of values. rules list names by kind (last, weighted_avg by
    samples, sum, avg, max, min); other names are summed up by the words in them, or averaged."""
    kind = F.lit(None).cast("string")
    for words, k in reversed(BY_NAME):
        kind = F.when(F.lower(name).rlike("|".join(words)), k).otherwise(kind)
    kind = F.coalesce(kind, F.lit("avg"))
    for k, names in (rules or {}).items():
        kind = F.when(F.col(name).isin(list(names)), "sum" if k == "time_sum" else k).otherwise(kind)
    kinds = {"last": F.max_by(value, order), "weighted_avg": F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(samples)), F.sum(samples)), F.avg(value)), "sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value)}
    out = F.lit(None).cast("double")
    for k, c in kinds.items():
        out = F.when(F.col("k_") == k, c).otherwise(out)
    return values.withColumn("k_", kind).groupBy(name, "k_").agg(out.alias("value")).select(name, "value")


def index_quantiles(df: DataFrame, value: str, *keys: str, part: float = 0.9) -> DataFrame:
    """n, median (interpolated) and the value at place min(n - 1, floor(part * n)) from 0 in order, by keys."""
    w = Window.partitionBy(*keys, F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    placed = counts.withColumns({"to_": F.sum("c_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n_": F.sum("c_").over(w)})
    at = F.least(F.col("n_") - 1, F.floor(F.col("n_") * F.lit(part)))
    high = placed.groupBy(*keys).agg(F.max("n_").alias("n"), F.min(F.when(F.col("to_") > at, F.col(value))).alias("at_part"))
    middle = quantiles(df, value, list(keys), {"median": 0.5})
    return high.join(middle, list(keys)) if keys else high.join(middle)


def pair_metrics(pairs: DataFrame, same: str = "same", said: str = "predicted") -> DataFrame:
    """One row of judged pairs: n, how many were decided (said isn't null), right ones, false and missed merges, and rates of the decided."""
    known, merged, really = F.col(said).isNotNull(), F.col(said) == True, F.col(same) == True  # noqa: E712
    n, decided = F.count("*"), F.count_if(known)
    return pairs.agg(
        n.alias("n"), decided.alias("decided"), (n - decided).alias("abstained"), F.count_if(F.col(said) == F.col(same)).alias("right"), F.count_if(merged & ~really).alias("false_merges"), F.count_if(known & ~merged & really).alias("missed_merges"),
        F.try_divide(F.count_if(F.col(said) == F.col(same)), decided).alias("accuracy"), F.try_divide(decided, n).alias("coverage"),
    )


def merged_counters(df: DataFrame, counters: str, *keys: str) -> DataFrame:
    """(keys, name, n): maps from name to number, added up."""
    return df.select(*keys, F.explode(counters).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))


def conditional_means(df: DataFrame, values: dict[str, Column], *keys: str) -> DataFrame:
    """The mean of each value over the rows where it is present, and how many those are."""
    return df.groupBy(*keys).agg(*(c for name, v in values.items() for c in (F.avg(v).alias(name), F.count(v).alias(f"{name}_n"))))


def logp_difference(a: str, b: str, mask: str) -> Column:
    """Mean absolute difference of two arrays over the masked places."""
    kept = F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m")), lambda x: x["m"] > 0)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.abs(x["a"] - x["b"])), F.size(kept))


def token_differences(a: str, b: str, mask: str) -> Column:
    """Part of the masked places at which two arrays differ; places that one of them lacks differ."""
    kept = F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m")), lambda x: x["m"] > 0)
    return F.try_divide(F.size(F.filter(kept, lambda x: ~x["a"].eqNullSafe(x["b"]))), F.size(kept))


REDUCERS: dict[str, Callable] = {"mean": np.mean, "max": np.max, "min": np.min, "median": np.median}
#: These take all resamples at once, others one after the other.
AT_ONCE = tuple(REDUCERS.values())


@lru_cache(maxsize=64)
def _drawn(n: int, size: int, resamples: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, size=(resamples, size), replace=True)


def _reduced(f: Callable, drawn: np.ndarray) -> np.ndarray:
    return f(drawn, axis=1) if f in AT_ONCE else np.apply_along_axis(f, 1, drawn)


def bootstrap_metric(df: DataFrame, key: str, value: str, order: str, size: int, reducers: dict[str, Callable] | None = None, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(key, metric, mean, std) of reducers over seeded resamples, with replacement, of each
    key's values in order: those of one prompt, as many as were drawn for it, in one task."""
    reducers = REDUCERS if reducers is None else reducers

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("o_", kind="stable")["v_"].to_numpy(float)
        drawn = values[_drawn(len(values), size, resamples, seed)]
        each = {n: _reduced(f, drawn) for n, f in reducers.items()}
        return pd.DataFrame({key: group[key].iloc[:1].repeat(len(each)).array, "metric": list(each), "mean": [x.mean() for x in each.values()], "std": [x.std() for x in each.values()]})

    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v_"), F.col(order).alias("o_")).groupBy(key).applyInPandas(run, f"`{key}` {kind}, metric string, mean double, std double")


def signal_audit(before: DataFrame, after: DataFrame, row: str = "row_id", pos: str = "pos", step: str = "step", adv: str = "adv") -> DataFrame:
    """(step, tokens_before, tokens_after, signal_before, signal_after, kept_signal) of a mask before and after
    a filter, in valid tokens and in those with an advantage. A token valid after alone is an error."""
    a = before.filter("mask > 0").select(row, pos, step, F.col(adv).alias("a_"), F.lit(True).alias("b_"))
    b = after.filter("mask > 0").select(row, pos, F.lit(True).alias("c_"))
    both = a.join(b, [row, pos], "full_outer")
    wrong = F.raise_error(F.lit("the filter made a token valid")).cast("int")
    on = F.when(F.col("b_").isNull(), wrong).otherwise((F.col("a_") != 0).cast("int"))
    had, has = F.sum(on), F.sum(F.when(F.col("c_"), on).otherwise(0))
    return both.groupBy(step).agg(F.count("b_").alias("tokens_before"), F.count("c_").alias("tokens_after"), had.alias("signal_before"), has.alias("signal_after"), F.try_divide(has, had).alias("kept_signal"))


def budget_boundary(steps: DataFrame, interval: int, step: str = "step") -> DataFrame:
    """Adds `boundary`: the step, rounded up to the next multiple of the interval."""
    return steps.withColumn("boundary", (F.ceil(F.col(step) / interval) * interval).cast("long"))


def tier_calibration(observations: DataFrame, tiers: str, value: str, least: int, delta: float) -> DataFrame:
    """(tier, present, support, mean_with, mean_without, weight): how outcomes of observations
    with a tier (an array of them) compare with the others; the weight, the difference, is null
    below `least` observations on either side, and 0 where the means differ by less than delta."""
    total = observations.agg(F.count("*").alias("all_"), F.sum(value).alias("sum_"))
    each = observations.select(F.explode(F.array_distinct(tiers)).alias("tier"), F.col(value).alias("v_")).groupBy("tier").agg(F.count("*").alias("support"), F.sum("v_").alias("t_"))
    seen = each.crossJoin(F.broadcast(total)).withColumns({"mean_with": F.col("t_") / F.col("support"), "mean_without": F.try_divide(F.col("sum_") - F.col("t_"), F.col("all_") - F.col("support")), "present": F.col("support") / F.col("all_")})
    gap = F.col("mean_with") - F.col("mean_without")
    weight = F.when((F.col("support") >= least) & (F.col("all_") - F.col("support") >= least), F.when(F.abs(gap) < delta, 0.0).otherwise(gap))
    return seen.select("tier", "present", "support", "mean_with", "mean_without", weight.alias("weight"))
