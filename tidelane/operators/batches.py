"""Rows and columns of batches: picking, padding, reordering, folding, chunks and micro-batches.

A row has a number, `row`, from 0 within its batch or table: positions are data here, as
Spark's rows have no order of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.selection import differencing_partitions, placed


def _known(df: DataFrame, columns: list[str]) -> list[str]:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such column: {missing}")
    return columns


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*_known(df, columns))


def pop_columns(df: DataFrame, columns: list[str], row: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns with the row's number, the rest)."""
    return df.select(row, *(c for c in _known(df, columns) if c != row)), df.drop(*(c for c in columns if c != row))


def rename_columns(df: DataFrame, names: dict[str, str], prefix: str = "") -> DataFrame:
    """df with columns renamed, and then, with a prefix, all of them under prefix/; a name that is taken is an error."""
    out = df.withColumnsRenamed(dict(zip(_known(df, list(names)), names.values())))
    out = out.toDF(*(f"{prefix}/{c}" for c in out.columns)) if prefix else out
    if len(set(out.columns)) < len(out.columns):
        raise ValueError("two columns have one name")
    return out


def rows_at(df: DataFrame, row: str, picks: DataFrame, at: str = "at") -> DataFrame:
    """The rows that picks (at, row) names, in its order and as often; a number that df lacks is an error."""
    found = picks.select(at, row).join(df.withColumn("here_", F.lit(True)), row, "left")
    return found.filter(F.when(F.col("here_"), True).otherwise(F.raise_error(F.lit("no such row")).cast("boolean"))).drop("here_")


def slice_rows(df: DataFrame, row: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, … below stop."""
    if step < 1:
        raise ValueError("a step is 1 or more")
    on = (F.col(row) >= start) & ((F.col(row) - start) % step == 0)
    return df.filter(on if stop is None else on & (F.col(row) < stop))


def reorder(df: DataFrame, row: str, order: DataFrame, to: str = "to") -> DataFrame:
    """df renumbered by order (to, row): row becomes to. It must name every row once (see inverse)."""
    both = order.select(to, row).join(df, row, "full_outer")
    n = Window.partitionBy(row)
    ok = F.col(to).isNotNull() & (F.count("*").over(n) == 1)
    return both.withColumn(to, F.when(ok, F.col(to)).otherwise(F.raise_error(F.lit("not a permutation")).cast(order.schema[to].dataType))).drop(row).withColumnRenamed(to, row)


def inverse(order: DataFrame, row: str, to: str = "to") -> DataFrame:
    """The order that undoes another."""
    return order.select(F.col(row).alias(to), F.col(to).alias(row))


def pad_to_divisor(df: DataFrame, row: str, divisor: int) -> DataFrame:
    """df with `is_padding`, and with its first rows again, over and over, until the number of rows is a multiple of divisor."""
    n = df.count()
    more = -n % divisor if n else 0
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(0, (more - 1) // max(n, 1))))).alias("again_")
    extra = df.filter(F.col(row) < more).select("*", rounds) if more else df.limit(0).withColumn("again_", F.lit(0))
    kind = df.schema[row].dataType
    extra = extra.withColumn(row, (F.lit(n) + F.col("again_") * n + F.col(row)).cast(kind)).filter(F.col(row) < n + more).drop("again_")
    return df.withColumn("is_padding", F.lit(False)).unionByName(extra.withColumn("is_padding", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_padding")).drop("is_padding")


def unfold_columns(df: DataFrame, arrays: list[str], parts: int) -> DataFrame:
    """A row for each of `parts` equally long pieces of the named arrays, with `part`; other columns are repeated."""
    length = F.size(arrays[0])
    ok = reduce(lambda a, b: a & b, ((F.size(c) == length) & (F.size(c) % parts == 0) for c in arrays))
    size = F.when(ok, (length / parts).cast("int")).otherwise(F.raise_error(F.lit("arrays can't be cut into equal parts")).cast("int"))
    cut = df.withColumn("size_", size).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return cut.withColumns({c: F.slice(c, F.col("part") * F.col("size_") + 1, F.col("size_")) for c in arrays}).drop("size_")


def fold_rows(df: DataFrame, row: str, size: int, columns: list[str]) -> DataFrame:
    """(fold, columns as arrays): every `size` rows that follow each other as one."""
    rows = df.groupBy(F.floor(F.col(row) / size).alias("fold")).agg(F.array_sort(F.collect_list(F.struct(row, *columns))).alias("x"))
    return rows.select("fold", *(F.col(f"x.{c}").alias(c) for c in columns))


def unfold_rows(df: DataFrame, row: str, size: int, columns: list[str]) -> DataFrame:
    """The rows that fold_rows folded."""
    rows = df.select("fold", F.posexplode(F.arrays_zip(*columns)).alias("k", "x"))
    return rows.select((F.col("fold") * size + F.col("k")).alias(row), *(F.col(f"x.{c}").alias(c) for c in columns))


def chunks(df: DataFrame, row: str, parts: int) -> DataFrame:
    """Adds `chunk` from 0: equally many rows for each of `parts`, in order; the first chunks have one more."""
    n = df.count()
    size, more = divmod(n, parts)
    first = F.when(F.col(row) < (size + 1) * more, F.floor(F.col(row) / (size + 1))).otherwise(more + F.floor((F.col(row) - (size + 1) * more) / max(size, 1)))
    return df.withColumn("chunk", first.cast("int"))


def minibatches(df: DataFrame, row: str, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Adds epoch, place and batch: every epoch has each row once, in order or by a seeded hash."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return out.withColumn("place", F.col(row)).withColumn("batch", F.floor(F.col("place") / size))
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(row).cast("string")).cast("binary"), 256)
    hashed = out.withColumn("h_", h).withColumn("p_", F.substring("h_", 1, 4))
    counts = hashed.groupBy("epoch", "p_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("epoch").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hashed.join(counts.select("epoch", "p_", before.alias("b_")), ["epoch", "p_"])
    at = F.col("b_") + F.row_number().over(Window.partitionBy("epoch", "p_").orderBy("h_", row)) - 1
    return placed.withColumn("place", at).withColumn("batch", F.floor(F.col("place") / size)).drop("h_", "p_", "b_")


def tiled(df: DataFrame, row: str, times: int) -> DataFrame:
    """The whole table `times` times, one after the other: `place` is copy * rows + row (repeat_rows keeps copies together)."""
    n = df.count()
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("place", F.col("copy") * n + F.col(row))


def sequence_offsets(df: DataFrame, batch: str, row: str, length: str) -> DataFrame:
    """Adds start and end: where a sequence lies when its batch's sequences are laid end to end."""
    past = Window.partitionBy(batch).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(past)
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))


def contiguous_groups(df: DataFrame, batch: str, row: str, uid: str) -> DataFrame:
    """(batch, group, uid, first, n): runs of rows with one uid; a uid that returns later is a new group."""
    order = Window.partitionBy(batch).orderBy(row)
    new = (~F.col(uid).eqNullSafe(F.lag(uid).over(order)) | (F.row_number().over(order) == 1)).cast("int")
    runs = df.withColumn("new_", new).withColumn("group", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(batch, "group").agg(F.first(uid).alias(uid), F.min(row).alias("first"), F.count("*").alias("n"))


def token_batches(df: DataFrame, batch: str, row: str, length: str, most: int, least_batches: int = 1, multiple: int = 1) -> DataFrame:
    """(batch, row, part): each batch in as many parts as its tokens need at `most` a part (at least
    `least_batches`, rounded up to a multiple), of nearly equal work. A longer row is an error."""
    wrong = F.raise_error(F.lit(f"a sequence has more than {most} tokens")).cast("long")
    sized = df.select(batch, row, F.when(F.col(length) <= most, F.col(length)).otherwise(wrong).alias("l_"))
    w = Window.partitionBy(batch)
    need = F.least(F.count("*").over(w), F.greatest(F.lit(least_batches), F.ceil(F.sum("l_").over(w) / most)))
    cost = 24576 * F.col("l_") + F.col("l_") * F.col("l_")
    parts = sized.withColumn("k_", (F.ceil(need / multiple) * multiple).cast("int")).withColumn("c_", cost.cast("double"))
    return differencing_partitions(parts, batch, row, "c_", F.col("k_"))


def greedy_partitions(df: DataFrame, batch: str, row: str, cost: str, parts: int) -> DataFrame:
    """(batch, row, part): each batch's rows, dearest first, to the part that is cheapest so far. One batch, one task."""

    def deal(costs: list, parts: int) -> list[int]:
        load, part = [0.0] * parts, []
        for c in costs:
            p = load.index(min(load))
            load[p] += float(-c)
            part.append(p)
        return part

    dearest = df.select(batch, row, (-F.col(cost)).alias("c_"))
    return placed(dearest, batch, ["c_", row], deal, F.lit(parts), "part").select(batch, row, "part")


def concat(frames: list[DataFrame], metrics: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """All rows, of frames with the same columns; and metrics (name, value) with each name's values as a list, in the frames' order."""
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("frames have different columns")
    rows = reduce(DataFrame.unionByName, frames)
    if metrics is None:
        return rows, None
    tagged = reduce(DataFrame.unionByName, (m.select("name", F.struct(F.lit(i).alias("i"), F.col("value")).alias("v")) for i, m in enumerate(metrics)))
    return rows, tagged.groupBy("name").agg(F.array_sort(F.collect_list("v")).alias("v")).select("name", F.col("v.value").alias("values"))


def to_lists(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, one list for each other column), in order: rows as columns of lists."""
    rest = [c for c in df.columns if c not in (key, order)]
    x = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("x"))
    return x.select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def from_lists(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that to_lists made lists of, numbered from 0 by `order`."""
    rest = [c for c in df.columns if c != key]
    x = df.select(key, F.posexplode(F.arrays_zip(*rest)).alias(order, "x"))
    return x.select(key, order, *(F.col(f"x.{c}").alias(c) for c in rest))


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; a key with two values is an error."""
    clash = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & ~a[k].eqNullSafe(b[k]))
    return F.when(clash, F.raise_error(F.lit("a key has two values")).cast("map<string,string>")).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def padded(values: str, length: int, fill: object, left: bool = False, truncation: str = "error") -> Column:
    """An array of `length`: filled up at an end, or cut on the left, on the right, in the middle, or an error."""
    n = F.size(values)
    lack = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - n))
    full = F.concat(lack, F.col(values)) if left else F.concat(F.col(values), lack)
    half = length // 2
    cuts = {"left": F.slice(values, F.greatest(F.lit(1), n - length + 1), F.lit(length)), "right": F.slice(values, 1, length), "middle": F.concat(F.slice(values, 1, half), F.slice(values, F.greatest(F.lit(1), n - (length - half) + 1), F.lit(length - half)))}
    if truncation not in (*cuts, "error"):
        raise ValueError(f"unknown truncation {truncation}")
    over = F.raise_error(F.lit("a sequence is too long")).cast("array<int>") if truncation == "error" else cuts[truncation]
    return F.when(n <= length, full).otherwise(over)


def without_padding(values: str, mask: str) -> Column:
    """The elements whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])


def suffix_period(values: str, longest: int, times: int) -> Column:
    """The least period, up to `longest`, with which an array ends `times` times over; null if there is none."""
    same = f"slice({values}, size({values}) - p * {times} + 1, p * {times - 1}) = slice({values}, size({values}) - p * {times - 1} + 1, p * {times - 1})"
    return F.expr(f"get(filter(sequence(1, {longest}), p -> p * {times} <= size({values}) AND {same}), 0)")
