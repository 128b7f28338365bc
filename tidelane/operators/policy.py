"""Policy losses (forward values), importance weights and off-policy metrics.

Tokens are rows: row_id, logp (new policy), old (old or rollout policy), adv and mask.
Every loss is one pass of expressions and aggregates that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.aggregates import aggregate_loss
from tidelane.operators.selection import largest, uniform

BOUND = 20.0
LOSSES: dict[str, Callable[..., tuple]] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"a loss named {name} is registered already")
        return f

    return add


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def _clipped(adv: Column, ratio: Column, low: float, high: float) -> tuple[Column, Column]:
    return -adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high)


#: Each gives (loss per token, whether it was clipped, whether it was clipped from below).
@register("vanilla")
def vanilla(logp: Column, old: Column, adv: Column, mean: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple:
    a, b = _clipped(adv, F.exp(clamp(logp - old, -BOUND, BOUND)), low, high)
    most, floor = F.greatest(a, b), -adv * dual
    return F.when(adv < 0, F.least(floor, most)).otherwise(most), b > a, (most > floor) & (adv < 0)


def _masked_policy_gradient(logp: Column, old: Column, adv: Column, valid: Column, most: float) -> tuple:
    ratio = F.exp(clamp(logp - old, -BOUND, BOUND))
    return -adv * clamp(ratio, None, most) * logp * valid.cast("double"), ~valid, valid & (ratio > most)


@register("dppo_tv")
def dppo_tv(logp: Column, old: Column, adv: Column, mean: Column, low: float = 0.2, high: float = 0.2, most: float = 20.0) -> tuple:
    moved = F.exp(logp) - F.exp(old)
    return _masked_policy_gradient(logp, old, adv, F.when(adv > 0, moved <= high).otherwise(moved >= -low), most)


@register("dppo_kl")
def dppo_kl(logp: Column, old: Column, adv: Column, mean: Column, low: float = 0.2, high: float = 0.2, most: float = 20.0) -> tuple:
    p, q = F.exp(logp), F.exp(old)
    kl = q * (old - logp) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
    return _masked_policy_gradient(logp, old, adv, F.when(adv > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q)), most)


@register("gspo")
def gspo(logp: Column, old: Column, adv: Column, mean: Column, low: float = 0.2, high: float = 0.2) -> tuple:
    a, b = _clipped(adv, F.exp(clamp(mean, None, 10.0)), low, high)
    return F.greatest(a, b), b > a, F.lit(False)


@register("sapo")
def sapo(logp: Column, old: Column, adv: Column, mean: Column, positive: float = 1.0, negative: float = 1.05) -> tuple:
    tau = F.when(adv > 0, F.lit(positive)).otherwise(F.lit(negative))
    ratio = F.exp(clamp(logp - old, -BOUND, BOUND))
    return -(4 / tau) / (1 + F.exp(-tau * (ratio - 1))) * adv, F.lit(False), F.lit(False)


@register("gpg")
def gpg(logp: Column, old: Column, adv: Column, mean: Column) -> tuple:
    return -logp * adv, F.lit(False), F.lit(False)


@register("cispo")
def cispo(logp: Column, old: Column, adv: Column, mean: Column, low: float = 0.2, high: float = 0.2) -> tuple:
    ratio = F.exp(clamp(logp - old, -BOUND, BOUND))
    kept = clamp(ratio, 1 - low, 1 + high)
    return -kept * adv * logp, ratio != kept, F.lit(False)


@register("reinforce")
def reinforce(logp: Column, old: Column, adv: Column, mean: Column) -> tuple:
    return -adv * logp, F.lit(False), F.lit(False)


#: Losses that single out tokens by the covariance of advantage and log-probability.
BY_COVARIANCE = ("clip_cov", "kl_cov")
#: Losses whose tokens are always averaged within their sequence first.
BY_SEQUENCE = {"gspo", "sapo"}


def policy_loss(name: str, tokens: DataFrame, mode: str = "token-mean", row: str = "row_id", weight: str | None = None, **options) -> DataFrame:
    """One row: loss, clip_fraction, clip_fraction_lower and kl of the masked tokens.
    `weight` names a column of importance weights."""
    if name == "geo_mean":
        return _geometric(tokens, row, **options)
    if name in BY_COVARIANCE:
        return _by_covariance(name, tokens, mode, row, weight, **options)
    if name not in LOSSES:
        raise ValueError(f"unknown policy loss {name}; known: {sorted([*LOSSES, *BY_COVARIANCE, 'geo_mean'])}")
    logp, old, adv, mask = F.col("logp"), F.col("old"), F.col("adv"), F.col("mask").cast("double")
    if name == "gspo":
        w = Window.partitionBy(row)
        tokens = tokens.withColumn("mean_", F.sum(clamp(logp - old, None, None) * mask).over(w) / F.greatest(F.sum(mask).over(w), F.lit(1.0)))
    loss, clipped, lower = LOSSES[name](logp, old, adv, F.col("mean_") if name == "gspo" else F.lit(0.0), **options)
    drift = old - logp if name in ("gspo",) else -clamp(logp - old, -BOUND, BOUND)
    valued = tokens.select(row, "mask", (loss * F.col(weight) if weight else loss).alias("loss_t"), (clipped.cast("double") * mask).alias("c_"), (lower.cast("double") * mask).alias("l_"), (drift * mask).alias("k_"))
    share = lambda c: (F.sum(c) / (F.sum(F.col("mask").cast("double")) + 1e-8))
    rest = valued.agg(share("c_").alias("clip_fraction"), share("l_").alias("clip_fraction_lower"), share("k_").alias("kl"))
    return aggregate_loss(valued, "loss_t", "mask", row, "seq-mean-token-mean" if name in BY_SEQUENCE else mode).join(F.broadcast(rest))


def _geometric(tokens: DataFrame, row: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The geometric mean of a sequence's clipped ratios times its mean advantage, averaged over sequences."""
    mask, d, sign = F.col("mask").cast("double"), F.col("logp") - F.col("old"), F.signum("adv")
    kept = clamp(d, -low, high)
    least = sign * F.least(sign * d, sign * kept)
    clipped = (d != kept).cast("double") * mask
    rows = tokens.groupBy(row).agg(
        F.sum(mask).alias("n"), F.sum(least * mask).alias("s"), F.sum(F.col("adv") * mask).alias("a"), F.sum(clipped * (F.col("adv") > 0).cast("double")).alias("c"), F.sum(clipped * (F.col("adv") < 0).cast("double")).alias("l"), F.sum(-d * mask).alias("k")
    )
    n = F.col("n") + 1e-8
    total = F.sum("n") + 1e-8
    return rows.agg(F.avg(-F.col("a") / n * F.exp(F.col("s") / n)).alias("loss"), (F.sum("c") / total).alias("clip_fraction"), (F.sum("l") / total).alias("clip_fraction_lower"), (F.sum("k") / total).alias("kl"))


def _by_covariance(name: str, tokens: DataFrame, mode: str, row: str, weight: str | None, pos: str = "pos", share: float = 0.0002, low: float = 0.2, high: float = 0.2, least: float = 1.0, most: float = 5.0, penalty: float = 1.0, seed: int = 0) -> DataFrame:
    """clip_cov leaves out a share of the tokens whose covariance lies between the bounds, drawn by a
    seeded hash; kl_cov adds a penalty on the log-ratio of the share with the largest covariance.
    `pos` tells the tokens of a row apart. At least one token is singled out, if any can be."""
    if share <= 0:
        raise ValueError(f"share {share} isn't positive")
    masked, d = F.col("mask") > 0, F.col("logp") - F.col("old")
    n, adv, logp = tokens.filter(masked).agg(F.count("*"), F.avg("adv"), F.avg("logp")).first()
    cov = (F.col("adv") - F.lit(adv)) * (F.col("logp") - F.lit(logp))
    a, b = _clipped(F.col("adv"), F.exp(d), low, high)
    pool = tokens.filter(masked).select(row, pos, cov.alias("cov_"), uniform(seed, row, pos).alias("u_"), (b > a).alias("cut_"))
    by = "cov_"
    if name == "clip_cov":
        pool, by = pool.filter(~F.col("cut_") & (F.col("cov_") > least) & (F.col("cov_") < most)), "u_"
    # Covariances that are equal but for rounding count as ties.
    picked = largest(pool.withColumn("cov_", F.round("cov_", 12)).withColumn("tie_", F.struct("u_", row, pos)), by, "tie_", max(int(share * n), 1)).select(row, pos, F.lit(True).alias("picked_"))
    told = tokens.join(picked, [row, pos], "left").withColumn("picked_", F.coalesce("picked_", F.lit(False)))
    if name == "clip_cov":
        loss, drift = F.when(F.col("picked_"), 0.0).otherwise(F.greatest(a, b)), -d
    else:
        loss, drift = a + F.when(F.col("picked_"), penalty * F.abs(d)).otherwise(0.0), F.abs(d)
    mask = F.col("mask").cast("double")
    clipped = F.col("picked_").cast("double") * mask if name == "clip_cov" else F.lit(0.0)
    valued = told.select(row, "mask", (loss * F.col(weight) if weight else loss).alias("loss_t"), clipped.alias("c_"), (drift * mask).alias("k_"))
    total = F.sum(F.col("mask").cast("double")) + 1e-8
    rest = valued.agg((F.sum("c_") / total).alias("clip_fraction"), F.lit(0.0).alias("clip_fraction_lower"), (F.sum("k_") / total).alias("kl"))
    return aggregate_loss(valued, "loss_t", "mask", row, mode).join(F.broadcast(rest))


def kl_coefficients(updates: DataFrame, run: str, step: str, kl: str, n_steps: str, start: float, target: float, horizon: float, adaptive: bool = True) -> DataFrame:
    """updates with `coefficient`, the KL coefficient after each: multiplied by 1 plus the relative
    distance of the KL from its target, held within 0.2, times steps over horizon. Not adaptive: the start."""
    factor = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n_steps) / horizon
    past = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumn("coefficient", start * F.product(factor).over(past) if adaptive else F.lit(start))


def bypass_loss(tokens: DataFrame, kind: str = "ppo_clip", weights: dict | None = None, rejection: dict[str, str] | None = None, mode: str = "token-mean", row: str = "row_id") -> DataFrame:
    """policy_loss where the old policy is the one that sampled: tokens that the rejection (options
    with their thresholds) leaves out are masked first. `reinforce` multiplies by importance
    weights (the options of importance_weights); in `ppo_clip` the ratio itself does that."""
    if kind not in ("reinforce", "ppo_clip"):
        raise ValueError(f"unknown kind {kind}; known: reinforce, ppo_clip")
    known = importance_weights(tokens, row=row, **weights) if weights is not None and kind == "reinforce" else tokens
    known = rejection_mask(known, rejection, row) if rejection else known
    return policy_loss("vanilla" if kind == "ppo_clip" else kind, known, mode, row, weight="weight" if weights is not None and kind == "reinforce" else None)


def entropy(logits: str) -> Column:
    """Entropy of the distribution that an array of logits gives."""
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: x - top)
    total = F.aggregate(F.transform(shifted, F.exp), F.lit(0.0), lambda s, x: s + x)
    return F.log(total) - F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x * F.exp(x)) / total


def entropy_loss(tokens: DataFrame, logits: str = "logits", mode: str = "token-mean", row: str = "row_id", mask: str = "mask") -> DataFrame:
    """One row: the entropy of each token's distribution, aggregated like a loss."""
    return aggregate_loss(tokens.withColumn("loss_t", entropy(logits)), "loss_t", mask, row, mode)


def label_logp(logits: str, label: str) -> Column:
    """Log-probability of the label (from 0) under an array of logits."""
    top = F.array_max(logits)
    return F.get(logits, F.col(label)) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def sum_of_squares(logits: str) -> Column:
    """Sum of the squared probabilities that an array of logits gives."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(2 * (x - top))) / (total * total)


#: Divergences of a token, by the log-ratio, and what a sequence's tokens are summed up to.
DIVERGENCES = {"k1": lambda d: -d, "k2": lambda d: 0.5 * d * d, "k3": lambda d: F.exp(d) - 1 - d}
LEVELS = {"token": ("k1", "k2", "k3"), "seq_sum": ("k1", "k2", "k3"), "seq_mean": ("k1", "k2", "k3"), "seq_max": ("k2", "k3")}


def rejection_options(options: dict[str, str | float]) -> dict[str, tuple[float | None, float]]:
    """Lowest and highest value allowed for each option; k1 takes "low_high" bounds on the
    ratio (a single one is the high one, and its inverse the low one), the others one bound."""
    out = {}
    for name, bound in options.items():
        level, _, kind = name.rpartition("_")
        if kind not in LEVELS.get(level, ()):
            raise ValueError(f"unknown option {name}")
        low, _, high = str(bound).rpartition("_")
        if kind != "k1" and low:
            raise ValueError(f"{name} takes one bound")
        if float(high) <= 0 or low and not 0 < float(low) <= float(high):
            raise ValueError(f"bounds of {name} aren't positive or not in order")
        out[name] = (math.log(float(low) if low else 1 / float(high)), math.log(float(high))) if kind == "k1" else (None, float(high))
    return out


def rejection_mask(tokens: DataFrame, options: dict[str, str | float], row: str = "row_id") -> DataFrame:
    """tokens with `mask` 0 wherever a divergence of the policies (log-ratio within ±20) is out
    of its bounds: of the token itself, or the sum, mean or maximum of its sequence's valid
    tokens. All options must pass."""
    w, valid, m = Window.partitionBy(row), F.col("mask") > 0, F.col("mask").cast("double")
    d = clamp(F.col("logp") - F.col("old"), -BOUND, BOUND)
    keep = F.lit(True)
    for name, (low, high) in rejection_options(options).items():
        level, _, kind = name.rpartition("_")
        x = DIVERGENCES[kind](d)
        total = F.sum(x * m).over(w)
        stat = {"token": x, "seq_sum": total, "seq_mean": total / (F.sum(m).over(w) + 1e-8), "seq_max": F.coalesce(F.max(F.when(valid, x)).over(w), F.lit(0.0))}[level]
        keep = keep & (stat <= high) & (F.lit(True) if low is None else stat >= low)
    return tokens.withColumn("mask", F.when(keep, F.col("mask")).otherwise(F.lit(0).cast(tokens.schema["mask"].dataType)))


def rejected(before: DataFrame, after: DataFrame, row: str = "row_id", pos: str = "pos") -> DataFrame:
    """One row: the part of the valid tokens that a mask left out, and of the rows in which it left out any."""
    both = before.filter(F.col("mask") > 0).select(row, pos).join(after.select(row, pos, F.col("mask").alias("m_")), [row, pos])
    rows = both.groupBy(row).agg(F.count("*").alias("n"), F.count_if(F.col("m_") == 0).alias("gone"))
    total = before.agg(F.countDistinct(row).alias("rows"))
    return rows.agg((F.sum("gone") / (F.sum("n") + 1e-8)).alias("masked_fraction"), F.count_if(F.col("gone") > 0).alias("hit_")).crossJoin(total).select("masked_fraction", (F.col("hit_") / F.col("rows")).alias("seq_masked_fraction"))


def value_loss(tokens: DataFrame, clip: float, mode: str = "token-mean", row: str = "row_id") -> DataFrame:
    """One row: half the clipped squared error of `pred` against `target`, and the part of tokens it clips (old predictions in `value`)."""
    near = F.greatest(F.least(F.col("pred"), F.col("value") + clip), F.col("value") - clip)
    a, b = F.pow(F.col("pred") - F.col("target"), F.lit(2)), F.pow(near - F.col("target"), F.lit(2))
    valued = tokens.select(row, "mask", F.greatest(a, b).alias("loss_t"), ((b > a).cast("double") * F.col("mask")).alias("c_"))
    clipped = valued.agg((F.sum("c_") / (F.sum("mask") + 1e-8)).alias("clip_fraction"))
    return aggregate_loss(valued, "loss_t", "mask", row, mode).select((F.col("loss") / 2).alias("loss")).join(F.broadcast(clipped))


def importance_weights(tokens: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, row: str = "row_id") -> DataFrame:
    """Adds `weight`: the new policy's probability over the old one's (log-ratio within ±20), by token or by
    whole sequence, cut at the threshold and 0 outside the mask; with normalize it has mean 1."""
    if level not in ("token", "sequence") or threshold <= 0:
        raise ValueError(f"no weights for level {level} and threshold {threshold}")
    mask = F.col("mask").cast("double")
    ratio = F.col("logp") - F.col("old")
    if level == "sequence":
        ratio = F.sum(ratio * mask).over(Window.partitionBy(row))
    out = tokens.withColumn("weight", F.least(F.exp(clamp(ratio, -BOUND, BOUND)), F.lit(threshold)) * mask)
    if normalize:
        per = [row] if level == "sequence" else []
        rows = out.groupBy(*per).agg((F.sum("weight") / (F.sum(mask) + 1e-8)).alias("m_"), F.sum(mask).alias("n_"))
        mean = rows.filter("n_ > 0").agg(F.avg("m_").alias("mean_"))
        out = out.join(F.broadcast(mean)).withColumn("weight", F.when(F.col("mean_") > 1e-8, F.col("weight") / F.col("mean_")).otherwise(F.col("weight"))).drop("mean_")
    return out


def off_policy_metrics(tokens: DataFrame, row: str = "row_id") -> DataFrame:
    """One row: perplexities of both policies, KL (direct and k3), their log-perplexity difference, and chi-squared by token and sequence."""
    mask, d = F.col("mask").cast("double"), F.col("logp") - F.col("old")
    rows = tokens.groupBy(row).agg(
        F.sum(mask).alias("n"),
        F.sum(F.col("logp") * mask).alias("new"),
        F.sum(F.col("old") * mask).alias("was"),
        F.sum(d * mask).alias("d"),
        F.sum((F.exp(d) - d - 1) * mask).alias("k3"),
        F.sum(F.exp(2 * clamp(d, -BOUND, BOUND)) * mask).alias("r2"),
    )
    n, all_ = F.col("n") + 1e-8, F.sum("n") + 1e-8
    new, was = F.col("new") / n, F.col("was") / n
    return rows.agg(
        F.avg(F.exp(-new)).alias("training_ppl"), F.avg(-new).alias("training_log_ppl"), F.avg(F.exp(-was)).alias("rollout_ppl"), F.avg(-was).alias("rollout_log_ppl"),
        (-F.sum("d") / all_).alias("kl"), (F.sum("k3") / all_).alias("k3_kl"),
        F.avg(was - new).alias("log_ppl_diff"), F.avg(F.abs(was - new)).alias("log_ppl_abs_diff"), F.max(was - new).alias("log_ppl_diff_max"), F.min(was - new).alias("log_ppl_diff_min"), F.avg(F.exp(was - new)).alias("ppl_ratio"),
        (F.sum("r2") / all_ - 1).alias("chi2_token"), (F.avg(F.exp(2 * clamp(F.col("d"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def effective_sample_size(weighted: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row: weight_mean and effective_sample_size of weights within [1 / threshold, threshold]."""
    mask = F.col("mask").cast("double")
    w = clamp(F.col("weight"), 1 / threshold, threshold)
    n, mean = F.sum(mask) + 1e-8, F.sum(w * mask) / (F.sum(mask) + 1e-8)
    square = F.sum(w * w * mask) / n
    return weighted.agg((F.sum(F.col("weight") * mask) / n).alias("weight_mean"), ((mean + 1e-8) * (mean + 1e-8) / square).alias("effective_sample_size"))
