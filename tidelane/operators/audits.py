"""Buckets, streaks, run lengths, ledgers and validation metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.sequences import borders, seeded_hash


def task_buckets(trials: DataFrame, task: str = "task_id", success: str = "success", complete: str = "complete") -> DataFrame:
    """(task, trials, unresolved, successes, bucket, success_rate): stable_success, stable_failure,
    mixed_success, or environment_or_unscorable where a trial is not complete (its rate is null)."""
    counts = trials.groupBy(task).agg(F.count("*").alias("trials"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("unresolved"), F.count_if(F.coalesce(success, F.lit(False))).alias("successes"))
    known = F.col("unresolved") == 0
    bucket = F.when(~known, "environment_or_unscorable").when(F.col("successes") == F.col("trials"), "stable_success").when(F.col("successes") == 0, "stable_failure").otherwise("mixed_success")
    return counts.withColumns({"bucket": bucket, "success_rate": F.when(known, F.col("successes") / F.col("trials"))})


def breach_streaks(steps: DataFrame, breach: Column, most: int, key: str = "arm", step: str = "step") -> DataFrame:
    """Adds `streak`, the breaching steps in a row up to this one (a gap of steps begins anew), and `halt`, streak >= most."""
    on = F.coalesce(breach, F.lit(False))
    marked = steps.withColumn("on_", on)
    of = Window.partitionBy(key, "on_").orderBy(step)
    marked = marked.withColumn("island_", F.col(step) - F.row_number().over(of))
    streak = F.when(F.col("on_"), F.row_number().over(Window.partitionBy(key, "on_", "island_").orderBy(step))).otherwise(0)
    return marked.withColumn("streak", streak).withColumn("halt", F.col("streak") >= most).drop("on_", "island_")


def mask_runs(mask: str) -> Column:
    """The runs of ones in an array of 0 and 1, as structs of start and end (half-open)."""
    starts = f"filter(sequence(0, size({mask}) - 1), i -> {mask}[i] = 1 AND (i = 0 OR {mask}[greatest(i - 1, 0)] = 0))"
    ends = f"filter(sequence(1, size({mask})), i -> {mask}[i - 1] = 1 AND (i = size({mask}) OR {mask}[least(i, size({mask}) - 1)] = 0))"
    return F.expr(f"CASE WHEN size({mask}) > 0 THEN zip_with({starts}, {ends}, (s, e) -> struct(s AS start, e AS end)) ELSE CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>) END")


def restore_mask(runs: str, length: str) -> Column:
    """The array of 0 and 1 that has these runs."""
    return F.expr(f"CASE WHEN {length} > 0 THEN transform(sequence(0, {length} - 1), i -> CAST(exists({runs}, r -> r.start <= i AND i < r.end) AS INT)) ELSE CAST(array() AS ARRAY<INT>) END")


def fraction_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Adds `held`: whether the key is among the given part, at least one and never all, that
    come first by sha256(seed:key). Keys are compared with the last hash of that part."""
    keys = df.select(key).distinct()
    n = keys.count()
    if n < 2:
        raise ValueError("a split needs two or more keys")
    take = max(1, min(n - 1, round(n * fraction)))
    border = borders(keys.select(seeded_hash(key, seed).alias("hash_")), [take])
    return df.crossJoin(F.broadcast(border)).withColumn("held", seeded_hash(key, seed) <= F.col("borders_")[0]).drop("borders_")


def cyclic_schedule(pool: DataFrame, key: str, seed: int, groups: int, updates: int) -> DataFrame:
    """(update_index, slot, key): the pool by hash rank, over and over, until all updates have their groups.

    Ranks are counted per hash prefix first, so the pool is never in one task. A pool without rows is an error.
    """
    hashed = pool.select(key, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256).alias("h_")).withColumn("p_", F.substring("h_", 1, 3))
    counts = hashed.groupBy("p_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    ranked = hashed.join(F.broadcast(before), "p_").withColumn("place_", F.col("before_") + F.row_number().over(Window.partitionBy("p_").orderBy("h_", key)) - 1)
    n = pool.count()
    if not n or groups <= 0 or updates <= 0:
        raise ValueError("a schedule needs a pool, groups and updates")
    rounds = F.sequence(F.col("place_"), F.lit(groups * updates - 1).cast("long"), F.lit(n).cast("long"))
    slots = ranked.filter(F.col("place_") < groups * updates).select(key, F.explode(rounds).alias("at_"))
    return slots.select((F.col("at_") / groups).cast("long").alias("update_index"), (F.col("at_") % groups).alias("slot"), key)


def budget_ledger(calls: DataFrame, limit: float, key: str = "account", order: str = "call", reserved: str = "reserved", settled: str = "settled") -> DataFrame:
    """Adds `accounted` (the settled amount, or what is reserved while there is none), its running total, and whether the limit held."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = calls.withColumn("accounted", F.coalesce(settled, reserved))
    return out.withColumn("running", F.sum("accounted").over(w)).withColumn("within", F.col("running") <= limit)


def repeated_calls(calls: DataFrame, key: str, signature: str, order: str, write: Column, seen: str, failed: Column | None = None) -> DataFrame:
    """Calls whose signature their key had before in a call that did not fail, the last of which is `previous`, with the successful writes
    between both (`writes_between`) and whether `seen` changed (null where either is null). Failed calls are neither history nor writes, but may
    repeat one. Null signatures are one signature."""
    ok = F.lit(True) if failed is None else ~F.coalesce(failed, F.lit(False))
    wrote = F.when(ok & F.coalesce(write, F.lit(False)), 1).otherwise(0)
    until = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = calls.withColumn("own_", wrote).withColumn("writes_", F.sum("own_").over(until)).withColumn("ok_", ok)
    before = Window.partitionBy(key, signature).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = counted.withColumn("last_", F.last(F.when(F.col("ok_"), F.struct(F.col(order).alias("at"), "writes_", F.col(seen).alias("saw"))), ignorenulls=True).over(before)).filter("last_ IS NOT NULL")
    return last.withColumns({"previous": F.col("last_.at"), "writes_between": F.col("writes_") - F.col("own_") - F.col("last_.writes_"), "changed": F.col("last_.saw") != F.col(seen)}).drop("own_", "writes_", "ok_", "last_")


def ranks(df: DataFrame, by: str, key: str, parts: Iterable[str] = ()) -> DataFrame:
    """Adds `rank` from 1 by falling `by`, ties by key, within parts."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc_nulls_last(by), key)))


#: Numbers drawn at once, for rows of one length.
MOST_DRAWN = 2_000_000


def sizes_of(n: int) -> list[int]:
    """2, 4, 8, … below n, and n."""
    return [] if n <= 1 else [2**k for k in range(1, n.bit_length()) if 2**k < n] + [n]


@lru_cache(maxsize=64)
def _drawn(n: int, size: int, resamples: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, size=(resamples, size), replace=True)


def resampled(values: np.ndarray, votes: np.ndarray | None, size: int, resamples: int, seed: int) -> dict[str, np.ndarray]:
    """Mean and deviation, over seeded resamples with replacement, of the best, the worst and the majority's value:
    one for each row of values, whose numbers are one uid's. Rows of one length are drawn alike."""
    at = _drawn(values.shape[1], size, resamples, seed)
    drawn = {"best": values[:, at].max(axis=2), "worst": values[:, at].min(axis=2)}
    if votes is not None:
        vote = votes[:, at]
        count = (vote[:, :, :, None] == vote[:, :, None, :]).sum(axis=3)
        drawn["maj"] = np.take_along_axis(values[:, at], count.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]  # the first of the most frequent
    return {f"{k}@{size}/{s}": f(np.ascontiguousarray(x), axis=1) for k, x in drawn.items() for s, f in (("mean", np.mean), ("std", np.std))}


def validation_metrics(df: DataFrame, source: str, uid: str, value: str, order: str, pred: str | None = None, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(source, metric, value): metrics of each uid's responses, then their means over uids.

    mean@n and std@n (population) are aggregates. best@k, worst@k and, with predictions,
    maj@k resample a uid's own responses, as many as were drawn for one prompt, in tasks; uids with equally
    many are resampled together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, group in frame.groupby(frame["x_"].map(len)):
                step = max(1, MOST_DRAWN // (resamples * n * (n if pred else 1)))
                for at in range(0, len(group) if n > 1 else 0, step):
                    part = group.iloc[at : at + step]
                    values = np.array([[x["v_"] for x in own] for own in part["x_"]], float)
                    votes = np.array([pd.factorize(np.array([x["p_"] for x in own], object))[0] for own in part["x_"]]) if pred else None
                    for size in sizes_of(n):
                        for metric, got in resampled(values, votes, size, resamples, seed).items():
                            yield pd.DataFrame({source: part[source].array, "metric": metric, "value": got})

    wanted = df.filter(F.col(value).isNotNull()).select(source, uid, F.col(value).cast("double").alias("v_"), F.col(order).alias("o_"), (F.col(pred) if pred else F.lit(None).cast("string")).alias("p_"))
    kind = df.schema[source].dataType.simpleString()
    lists = wanted.groupBy(source, uid).agg(F.array_sort(F.collect_list(F.struct("o_", "v_", "p_"))).alias("x_"))
    drawn = lists.select(source, "x_").mapInPandas(run, f"`{source}` {kind}, metric string, value double")
    each = wanted.groupBy(source, uid).agg(F.count("*").alias("n_"), F.avg("v_").alias("mean"), F.stddev_pop("v_").alias("std"))
    plain = each.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), "n_").alias("metric"), F.col("mean").alias("value")), F.struct(F.when(F.col("n_") > 1, F.concat(F.lit("std@"), "n_")).alias("metric"), F.col("std").alias("value")))).alias("x"))
    return drawn.union(plain.select(source, "x.metric", "x.value").filter("metric is not null")).groupBy(source, "metric").agg(F.avg("value").alias("value"))
