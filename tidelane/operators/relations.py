"""Filters, joins and set operations over records, dialogues and rollouts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c.isNull() | (c != v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: F.array_contains(c, v) if isinstance(v, tuple) else c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
}


def condition(key: str, value: object) -> Column:
    """`field=value` or `field__op=value` as a predicate, which Spark pushes to the scan."""
    field, _, op = key.rpartition("__")
    if not field or op not in OPERATORS:
        field, op = key, "eq"
    return OPERATORS[op](F.col(field), value)


def query(df: DataFrame, limit: int | None = None, **constraints) -> DataFrame:
    """The rows that meet all constraints."""
    if missing := {k for k in constraints if k.rpartition("__")[0] not in df.columns and k not in df.columns}:
        raise ValueError(f"no such field: {sorted(missing)}")
    out = reduce(lambda d, kv: d.filter(condition(*kv)), constraints.items(), df)
    return out if limit is None else out.limit(limit)


def query_json(df: DataFrame, constraints: str, limit: int | None = None) -> DataFrame:
    given = json.loads(constraints or "{}")
    if not isinstance(given, dict):
        raise ValueError("constraints must be a JSON object")
    return query(df, limit, **given)


def remove(df: DataFrame, **constraints) -> DataFrame:
    """The rows that don't meet all constraints (a null comparison is not met)."""
    met = reduce(lambda a, b: a & b, (condition(k, v) for k, v in constraints.items()))
    return df.filter(~F.coalesce(met, F.lit(False)))


def add(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and those of rows whose key is new."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti").select(*df.columns))


def update(df: DataFrame, key: str, value: object, **changes) -> DataFrame:
    hit = F.col(key) == value
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in changes.items()})


def align(left: DataFrame, right: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Inner join on key; with strict, a key on one side only is an error."""
    if not strict:
        return left.join(right, key)
    lone = F.raise_error(F.concat(F.lit(f"{key} on one side only: "), F.col(key).cast("string"))).cast("boolean")
    both = left.withColumn("l_", F.lit(True)).join(right.withColumn("r_", F.lit(True)), key, "full_outer")
    return both.filter(F.when(F.col("l_").isNull() | F.col("r_").isNull(), lone).otherwise(True)).drop("l_", "r_")


def group_filter_mask(df: DataFrame, uid: str, score: str, top: float = 1.0) -> DataFrame:
    """Adds `kind` (all_zero, all_one, no_contrast or informative) and `kept`."""
    w = Window.partitionBy(uid)
    low, high = F.min(score).over(w), F.max(score).over(w)
    kind = F.when(high == 0, "all_zero").when(low >= top, "all_one").when(low == high, "no_contrast").otherwise("informative")
    return df.withColumn("kind", kind).withColumn("kept", F.col("kind") == "informative")


def first_informative(df: DataFrame, uid: str, score: str, order: str, target: int, most: int | None = None) -> DataFrame:
    """The rows of the first `target` groups, by first appearance, whose scores differ; of
    the first `most` groups at most. Group counts, not rows, are ranked."""
    groups = df.groupBy(uid).agg(F.min(order).alias("seen_"), (F.min(score) != F.max(score)).alias("differs_"))
    if most is not None:
        groups = groups.orderBy("seen_").limit(most)
    return df.join(groups.filter("differs_").orderBy("seen_").limit(target).select(uid), uid, "left_semi")


def as_of_next(left: DataFrame, right: DataFrame, key: str, at: str, starts: str, value: str) -> DataFrame:
    """left with the first of right, in the same key, that starts at or after `at`.
    One sort of both sides together, latest first, with a running value; no pairs are made."""
    a = left.select(*left.columns, F.col(at).alias("t_"), F.lit(None).cast(right.schema[value].dataType).alias("v_"), F.lit(None).cast(right.schema[starts].dataType).alias("s_"), F.lit(0).alias("side_"))
    b = right.select(*((F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns), F.col(starts).alias("t_"), F.col(value).alias("v_"), F.col(starts).alias("s_"), F.lit(1).alias("side_"))
    ahead = Window.partitionBy(key).orderBy(F.desc("t_"), F.desc("side_"), F.desc("v_")).rowsBetween(Window.unboundedPreceding, 0)
    next_ = F.last(F.when(F.col("side_") == 1, F.struct("s_", "v_")), ignorenulls=True).over(ahead)
    return a.unionByName(b).withColumn("n_", next_).filter("side_ = 0").select(*left.columns, F.col("n_.s_").alias(f"next_{starts}"), F.col("n_.v_").alias(f"next_{value}"))


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points inside half-open spans [start, end) of their key: an equi-join on time buckets,
    each span in as many as it touches, and then the exact test."""
    p = points.withColumn("b_", F.floor(F.col(at) / bucket))
    s = spans.withColumn("b_", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [key, "b_"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("b_")


def leaks(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(id, reason): rows of left that equal a row of right in one of the keys (column: reason); null equals nothing.
    All keys go into one join, by their SHA-256, so that no text is shuffled."""
    told = F.explode(F.array(*(F.struct(F.lit(reason).alias("reason"), F.sha2(F.col(c).cast("string").cast("binary"), 256).alias("key_")) for c, reason in keys.items())))
    asked = left.select("id", told.alias("x")).select("id", "x.reason", "x.key_").filter("key_ IS NOT NULL")
    known = right.select(told.alias("x")).select("x.reason", "x.key_").filter("key_ IS NOT NULL").distinct()
    return asked.join(known, ["reason", "key_"], "left_semi").select("id", "reason")


def pair_calls(calls: DataFrame, receipts: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The k-th call and the k-th receipt with one id are a pair; either side may lack the other."""
    nth = lambda d, side: d.withColumn("k_", F.row_number().over(Window.partitionBy(key, name).orderBy(order))).select(key, name, "k_", F.col(order).alias(side))
    return nth(calls, "call_at").join(nth(receipts, "receipt_at"), [key, name, "k_"], "full_outer").drop("k_")


def zip_columns(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Columns of both, row by row; a column of both must be equal on both sides."""
    shared = [c for c in left.columns if c in right.columns and c != row]
    both = left.join(right.withColumnsRenamed({c: f"{c}_r" for c in shared}), row)
    for c in shared:
        both = both.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"{c}_r")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType))).drop(f"{c}_r")
    return both


def ordered_distinct(*frames: DataFrame, key: str, order: str) -> DataFrame:
    """Keys in the order of their first appearance: frames one after the other, each by order."""
    tagged = [f.select(key, F.struct(F.lit(i).alias("f"), F.col(order).alias("o")).alias("at")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min("at").alias("at")).select(key, F.col("at.f").alias("frame"), F.col("at.o").alias("place"))
