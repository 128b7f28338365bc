"""Whole groups of rollouts: completeness, dealing to workers, and replay of saved group-relative estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.sequences import places


def _wrong(test: Column, text: str, otherwise: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(text)).cast("long")).otherwise(otherwise)


def complete_groups(df: DataFrame, uid: str, row: str, size: int) -> DataFrame:
    """df with group (from 0, in the order of the groups' least rows) and member (from 0, by row). A group that hasn't exactly
    size rows is an error where it is read; a null uid is a group, rows with one row number count each. No rows give no rows.

    Groups are one row each when they are ordered, over counts of ranges, so no task orders the table.
    """
    if size < 1:
        raise ValueError("groups have one row or more")
    own = Window.partitionBy(uid)
    counted = df.withColumn("n_", F.count("*").over(own)).withColumn("first_", F.min(row).over(own))
    counted = counted.withColumn("member", _wrong(F.col("n_") != size, f"a group hasn't {size} rows", (F.row_number().over(own.orderBy(row)) - 1).cast("long")))
    heads = counted.filter("member = 0").select(F.col(uid).alias("of_"), (-F.col("first_")).alias("less_"))
    placed = places(heads, "less_", "of_").select("of_", F.col("place").cast("long").alias("group"))
    return counted.join(placed, F.col(uid).eqNullSafe(F.col("of_"))).drop("of_", "n_", "first_")


def deal_groups(df: DataFrame, uid: str, row: str, size: int, workers: int) -> DataFrame:
    """complete_groups with worker and slot: groups go round to the workers, no group to two of them, and slot numbers a
    worker's rows without gaps. With fewer groups than workers some get none."""
    if workers < 1:
        raise ValueError("give one worker or more")
    dealt = complete_groups(df, uid, row, size)
    turn = F.floor(F.col("group") / workers)
    return dealt.withColumns({"worker": (F.col("group") % workers).cast("int"), "slot": turn * size + F.col("member")})


def replay_estimates(records: DataFrame, uid: str, row: str, size: int, reward: str = "reward", mask: str = "response_mask", saved: str = "advantages", tolerance: float = 1e-5, epsilon: float = 1e-6) -> DataFrame:
    """(uid, row, value, tokens, differences): saved group-relative estimates computed again from their inputs.

    value is (reward - mean) / (sample deviation + epsilon) within the group, tokens the value where mask (array of 0 and 1) is 1; differences has (position, saved, again) for
    each token that is further from the saved one than tolerance, and for each that only one side has. Incomplete groups, rewards that are null or not finite and masks with
    other values, or null, are errors. A null saved array has no tokens. No records give no rows.
    """
    whole = complete_groups(records, uid, row, size)
    own = Window.partitionBy(uid)
    x = F.col(reward).cast("double")
    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    binary = F.coalesce(F.forall(mask, lambda m: F.coalesce(m.isin(0, 1), F.lit(False))), F.lit(False))
    fault = F.when(~sound, F.raise_error(F.lit("a reward isn't finite")).cast("double")).when(~binary, F.raise_error(F.lit("a mask isn't binary")).cast("double"))
    mean = F.avg(x).over(own)
    spread = F.sqrt(F.sum((x - F.col("mean_")) * (x - F.col("mean_"))).over(own) / (size - 1)) if size > 1 else F.lit(float("nan"))
    told = whole.withColumn("mean_", mean).withColumn("spread_", spread)
    told = told.withColumn("value", F.coalesce(fault, (x - F.col("mean_")) / (F.col("spread_") + epsilon)))
    told = told.withColumn("tokens", F.transform(mask, lambda m: F.when(m == 1, F.col("value")).otherwise(0.0)))
    before = F.coalesce(F.col(saved).cast("array<double>"), F.array().cast("array<double>"))
    places_ = F.sequence(F.lit(0), F.greatest(F.size("tokens"), F.size(before)) - 1)
    pairs = F.when(F.greatest(F.size("tokens"), F.size(before)) > 0, F.transform(places_, lambda i: F.struct(i.alias("position"), F.get(before, i).alias("saved"), F.get(F.col("tokens"), i).alias("again")))).otherwise(F.array())
    far = F.filter(pairs, lambda p: F.coalesce(F.abs(p["saved"] - p["again"]) > tolerance, F.lit(True)))
    return told.withColumn("differences", far).select(uid, row, "value", "tokens", "differences")
