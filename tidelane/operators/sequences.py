"""Segments, running flags, splits, sampling and balanced partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(ticks: DataFrame, key: str, tick: str, active: str, seconds: float = 0.2) -> DataFrame:
    """(key, segment, start_tick, end_tick, start_sec, end_sec) of maximal runs of active ticks, half-open."""
    order = Window.partitionBy(key).orderBy(tick)
    on = ticks.filter(F.col(active)).withColumn("new_", F.coalesce((F.col(tick) - F.lag(tick).over(order)) != 1, F.lit(True)).cast("int"))
    on = on.withColumn("segment", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = on.groupBy(key, "segment").agg(F.min(tick).alias("start_tick"), (F.max(tick) + 1).alias("end_tick"))
    return runs.withColumns({"start_sec": F.col("start_tick") * seconds, "end_sec": F.col("end_tick") * seconds})


def occurrence(df: DataFrame, uid: str, order: str) -> DataFrame:
    """Adds `trial`: how many rows of the group came before."""
    return df.withColumn("trial", F.row_number().over(Window.partitionBy(uid).orderBy(order)) - 1)


def latest(df: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The row with the greatest version of each key; among equals the first by tie."""
    w = Window.partitionBy(key).orderBy(F.desc(version), tie)
    return df.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def running_flag(df: DataFrame, key: str, order: str, hit: Column, name: str) -> DataFrame:
    """Adds whether `hit` held in this row or an earlier one of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.bool_or(F.coalesce(hit, F.lit(False))).over(w))


def until_first(df: DataFrame, key: str, order: str, stop: Column) -> DataFrame:
    """Adds `mask`: 1 up to and with the first row of the key where stop holds, then 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("mask", (F.coalesce(F.sum(stop.cast("int")).over(w), F.lit(0)) == 0).cast("int"))


#: Leading hexadecimal digits of a hash that make a bucket: buckets are counted before any row is ordered.
DIGITS = 4


def seeded_hash(key: str | Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")).cast("binary"), 256)


def borders(hashes: DataFrame, edges: list[int], column: str = "hash_") -> DataFrame:
    """One row, `borders_`: for each edge n the n-th least hash; "" for 0 and "~" beyond the last.

    Running counts of at most 16**DIGITS buckets tell in which bucket an edge lies; only the
    rows of that bucket are ordered.
    """
    prefixed = hashes.select(F.col(column).alias("h_"), F.substring(column, 1, DIGITS).alias("p_"))
    counts = prefixed.groupBy("p_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).cast("long").alias("n")) for i, n in enumerate(edges)))).alias("e")
    cut = counts.withColumn("before_", before).select("p_", "n_", "before_", asked).filter("e.n > before_ AND e.n <= before_ + n_").select("p_", F.col("e.i").alias("i_"), (F.col("e.n") - F.col("before_")).alias("k_"))
    inside = prefixed.join(F.broadcast(cut.select("p_").distinct()), "p_").withColumn("r_", F.row_number().over(Window.partitionBy("p_").orderBy("h_")))
    found = inside.join(F.broadcast(cut), "p_").filter("r_ = k_").agg(F.map_from_entries(F.collect_list(F.struct("i_", "h_"))).alias("m_"))
    return found.select(F.array(*(F.coalesce(F.try_element_at("m_", F.lit(i)), F.lit("~" if n > 0 else "")) for i, n in enumerate(edges))).alias("borders_"))


def hash_rank_split(df: DataFrame, key: str, seed: int, sizes: dict[str, int], rest: str = "reserve") -> DataFrame:
    """Adds `split`: rows in the order of sha256(seed:key) fill each named split to its size.
    Every row's hash is compared with the borders between splits; splits of any size are never ordered."""
    hashed = df.withColumn("hash_", seeded_hash(key, seed))
    named, edge, edges = F.lit(rest), 0, []
    for size in sizes.values():
        edge += size
        edges.append(edge)
    for i, name in reversed(list(enumerate(sizes))):
        named = F.when(F.col("hash_") <= F.col("borders_")[i], name).otherwise(named)
    return hashed.crossJoin(F.broadcast(borders(hashed, edges))).withColumn("split", named).drop("hash_", "borders_")


def repeat_rows(df: DataFrame, times: int | str) -> DataFrame:
    """Each row `times` times (a number or a column), with `copy` from 0."""
    n = F.lit(times) if isinstance(times, int) else F.col(times)
    return df.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def chunk(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds `chunk`: rows by a dense 0-based position column, `size` to a chunk."""
    return df.withColumn("chunk", F.floor(F.col(order) / size))


def workload(length: str) -> Column:
    """Cost of a sequence: linear plus quadratic in its length."""
    return 24576 * F.col(length) + F.col(length) * F.col(length)


#: Ranges of values, and parts of equal values, whose rows are counted before any are ordered.
RANGES, PARTS = 4096, 256


def places(df: DataFrame, value: str, row: str) -> DataFrame:
    """Adds `place`, from 0, by falling value; rows with equal values are in the order of a hash of `row`.

    Counts by value, then by hash within a value, are summed up; windows hold the distinct
    values of a range, or the rows of one value and hash, and never the table.
    """
    v = F.col(value)
    ends = df.agg(F.max(v).cast("double").alias("high_"), F.min(v).cast("double").alias("low_"))
    dealt = df.withColumn("h_", F.pmod(F.xxhash64(row), F.lit(PARTS)))
    own = dealt.groupBy(v.alias("v_"), "h_").agg(F.count("*").alias("n_"))
    each = own.groupBy("v_").agg(F.sum("n_").alias("n_")).crossJoin(F.broadcast(ends))
    each = each.withColumn("range_", F.coalesce(F.floor(F.try_divide((F.col("high_") - F.col("v_")) * RANGES, F.col("high_") - F.col("low_"))), F.lit(0)))
    before = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = each.groupBy("range_").agg(F.sum("n_").alias("n_")).withColumn("over_", before(Window.orderBy("range_"))).drop("n_")
    each = each.join(F.broadcast(ranges), "range_").select("v_", (F.col("over_") + before(Window.partitionBy("range_").orderBy(F.desc("v_")))).alias("from_"))
    start = own.join(each, "v_").select("v_", "h_", (F.col("from_") + before(Window.partitionBy("v_").orderBy("h_"))).alias("from_"))
    same = (dealt[value] == start["v_"]) & (dealt["h_"] == start["h_"])
    at = Window.partitionBy(value, dealt["h_"]).orderBy(row)
    return dealt.join(start, same).withColumn("place", F.col("from_") + F.row_number().over(at) - 1).drop("v_", "h_", "from_")


def snake_partitions(df: DataFrame, cost: str, row: str, parts: int) -> DataFrame:
    """Adds `part`: rows by falling cost are dealt forth and back over equally large parts."""
    turn, at = F.floor(F.col("place") / parts), F.col("place") % parts
    return places(df, cost, row).withColumn("part", F.when(turn % 2 == 0, at).otherwise(parts - 1 - at).cast("int")).drop("place")


def imbalance(df: DataFrame, part: str, cost: str) -> DataFrame:
    loads = df.groupBy(part).agg(F.sum(cost).alias("load"))
    return loads.agg(F.min("load").alias("least"), F.max("load").alias("most"), (F.max("load") - F.min("load")).alias("spread"))
