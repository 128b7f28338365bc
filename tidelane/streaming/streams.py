"""Stateful streams: a bounded queue, a step guard, resuming, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def monotonic_steps(stream: DataFrame, key: str = "run", step: str = "step", value: str = "value") -> DataFrame:
    """Rows of each key whose step is greater than any before it; the others are passed over.
    The state is one number per key."""

    def guard(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(2**62)
        rows = pd.concat(parts).sort_values("step", kind="stable").drop_duplicates("step")
        rows = rows[rows["step"] > last]
        if len(rows):
            state.update((int(rows["step"].max()),))
        yield rows.assign(key=k[0])[["key", "step", "value"]]

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return named.groupBy("key").applyInPandasWithState(guard, "key string, step long, value double", "last long", "append", GroupStateTimeout.NoTimeout)


def bounded_queue(stream: DataFrame, size: int, take: int, key: str = "queue", item: str = "item") -> DataFrame:
    """A queue per key that keeps its newest `size` items and hands out `take` for each
    micro-batch, oldest first; every row out carries how many were produced and dropped so far."""

    def serve(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, produced, dropped = state.get if state.exists else ([], 0, 0)
        new = sorted(int(x) for p in parts for x in p["item"])
        held, produced = [*held, *new], produced + len(new)
        over = max(0, len(held) - size)
        held, dropped = held[over:], dropped + over
        out, held = held[:take], held[take:]
        state.update((held, produced, dropped))
        yield pd.DataFrame({"key": [k[0]] * len(out), "item": out, "produced": [produced] * len(out), "dropped": [dropped] * len(out)})

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(item).cast("long").alias("item"))
    return named.groupBy("key").applyInPandasWithState(serve, "key string, item long, produced long, dropped long", "held array<long>, produced long, dropped long", "append", GroupStateTimeout.NoTimeout)


def fresh(df: DataFrame, version: str, now: int, most: int) -> DataFrame:
    """Rows no more than `most` versions behind."""
    return df.filter(F.lit(now) - F.col(version) <= most)


def remaining(plan: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is left of a plan when it is resumed."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def event_windows(stream: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` per tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sink_once(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None):
    """Runs through what is there and stops; each micro-batch is written under its own number,
    so that one that is run again replaces itself."""
    default = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return stream.writeStream.foreachBatch(write or default).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches_of(stream: DataFrame, size: int, key: str = "queue", item: str = "item") -> DataFrame:
    """(key, number, items): every `size` items of a key, in the order they came, as one batch; the rest waits in the state."""

    def gather(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ([], 0)
        held = [*held, *sorted(int(x) for p in parts for x in p["item"])]
        whole = len(held) // size
        out = [held[i * size : (i + 1) * size] for i in range(whole)]
        state.update((held[whole * size :], done + whole))
        yield pd.DataFrame({"key": [k[0]] * whole, "number": [done + i for i in range(whole)], "items": out})

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(item).cast("long").alias("item"))
    return named.groupBy("key").applyInPandasWithState(gather, "key string, number long, items array<long>", "held array<long>, done long", "append", GroupStateTimeout.NoTimeout)


def sliding_windows(stream: DataFrame, at: str, window: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` per sliding window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` per session: rows of a key no further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, span: str, late: str) -> DataFrame:
    """Rows of two streams with one key, the right one at or up to `span` after the left; watermarks bound what is kept."""
    a = left.withWatermark(left_at, late)
    b = right.withColumnRenamed(key, "k_").withWatermark(right_at, late)
    return a.join(b, (F.col(key) == F.col("k_")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {span}"))).drop("k_")


def allowed_samples(required: int, threshold: float, sync_step: int) -> int:
    """How many samples may be made before the next sync of parameters."""
    return int(required * (threshold + 1) * sync_step)


def paused(progress: DataFrame, most: int, made: str = "made", queued: str = "queued", capacity: int | None = None) -> DataFrame:
    """Adds `pause`: whether as many samples as allowed were made since the last sync, or the queue is full."""
    full = F.lit(False) if capacity is None else F.col(queued) >= capacity
    return progress.withColumn("pause", (F.col(made) >= most) | full)
