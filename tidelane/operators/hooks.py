"""Registries and hooks: rewards and their managers, retrieval steps, samplers, jobs, caches, anchors and budgets."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from tidelane.functions.documents import _each


class Registry(dict):
    """Functions by name; a name is given once."""

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            if self.setdefault(name, f) is not f:
                raise ValueError(f"{name} is registered already")
            return f

        return add

    def named(self, name: str) -> Callable:
        if name not in self:
            raise ValueError(f"unknown: {name}; known: {sorted(self)}")
        return self[name]


PREPROCESSORS, RETRIEVERS, POSTPROCESSORS = Registry(), Registry(), Registry()
SAMPLERS, DATASETS, MANAGERS = Registry(), Registry(), Registry()


def reward_function(path: str, name: str) -> Callable:
    """The function `name` of a Python file, as (solution, truth) -> float; its source travels with it to the tasks."""
    spec = importlib.util.spec_from_file_location("reward_", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, name, None)):
        raise AttributeError(f"{path} has no function {name}")
    with open(path) as file:
        source = file.read()

    def score(solution: str, truth: str) -> float:
        space = score.__dict__.setdefault("space", {})
        if name not in space:
            exec(compile(source, path, "exec"), space)  # the user's own file
        return float(space[name](solution, truth))

    return score


@MANAGERS.register("naive")
def each_reward(score: Callable, solution: Column, truth: Column) -> Column:
    """score(solution, truth) row by row in Arrow batches; null where either is."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else float(score(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double", ArrowUDFType.SCALAR)(solution, truth)


@MANAGERS.register("batch")
def batch_rewards(score: Callable, solution: Column, truth: Column) -> Column:
    """score(solutions, truths) on whole batches."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(list(score(a.to_pylist(), b.to_pylist())), pa.float64())

    return F.arrow_udf(run, "double", ArrowUDFType.SCALAR)(solution, truth)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to most - buffer tokens, then falling by factor over the buffer's length, and on beyond it."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


@MANAGERS.register("dapo")
def dapo_rewards(score: Callable, solution: Column, truth: Column, length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    return each_reward(score, solution, truth) + overlong_penalty(length, most, buffer, factor)


@MANAGERS.register("prime")
def guarded_rewards(score: Callable, solution: Column, truth: Column, otherwise: float = 0.0) -> Column:
    """Like naive, but a row whose score fails gets `otherwise`. Rows are dealt over tasks, and a task that hangs is Spark's to end."""

    def safe(x: str, y: str) -> float:
        try:
            return float(score(x, y))
        except Exception:  # the user's function may raise anything
            return otherwise

    return each_reward(safe, solution, truth)


def retrieve(df: DataFrame, retrievers: Iterable[str], fuse: Callable, before: Iterable[str] = (), after: Iterable[str] = ()) -> DataFrame:
    """Registered steps one after the other: documents are prepared, each retriever answers, results are fused and worked on."""
    for name in before:
        df = PREPROCESSORS.named(name)(df)
    out = fuse([RETRIEVERS.named(name)(df) for name in retrievers])
    for name in after:
        out = POSTPROCESSORS.named(name)(out)
    return out


def least_score(results: DataFrame, score: float, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Results of a score or more, k of each query at most."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return results.filter(F.col("score") >= score).withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= k).drop("n_")


def ordered_by(df: DataFrame, sampler: str, row: str, **options) -> DataFrame:
    """Adds `place`, a sort key that a registered sampler gives; batches take rows in its order."""
    return df.withColumn("place", SAMPLERS.named(sampler)(F.col(row), **options))


@SAMPLERS.register("easy_first")
def easy_first(row: Column, difficulty: str = "difficulty", seed: int = 0) -> Column:
    return F.struct(F.col(difficulty), F.sha2(F.concat(F.lit(f"{seed}:"), row.cast("string")).cast("binary"), 256))


def dataset(kind: str, *args, **options) -> DataFrame:
    """What a registered kind of dataset reads."""
    return DATASETS.named(kind)(*args, **options)


def jobs(tasks: DataFrame, trials: int, seed: int, task: str = "task_id") -> DataFrame:
    """(task, trial, seed): every trial of every task, with a seed that both and the given seed decide."""
    out = tasks.select(task, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col(task).cast("string"), F.col("trial").cast("string"))
    return out.withColumn("seed", F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % (2**31 - 1))


def cached_embeddings(docs: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with their embedding, the rows that are new to the cache). The cache has (content_hash, embedding); only texts whose
    hash it lacks, each once, go to embed, which adds `embedding` to (content_hash, text)."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    missing = hashed.groupBy("content_hash").agg(F.first(text).alias(text)).join(cache.select("content_hash"), "content_hash", "left_anti")
    new = embed(missing).select("content_hash", "embedding")
    return hashed.join(cache.select("content_hash", "embedding").unionByName(new), "content_hash"), new


def reconciled(ledger: DataFrame, actual: DataFrame, key: str = "account") -> DataFrame:
    """(key, accounted, actual, correction): what an account's calls come to (settled, or else reserved) against what was billed (amount)."""
    sums = ledger.groupBy(key).agg(F.sum(F.coalesce("settled", "reserved")).alias("accounted"))
    return sums.join(actual.select(key, F.col("amount").alias("actual")), key, "full_outer").withColumn("correction", F.coalesce("actual", "accounted") - F.coalesce("accounted", F.lit(0.0)))


def encoded_anchors(states: DataFrame, features: Column, mode: str = "structured") -> DataFrame:
    """Adds `anchor`: the mode and 16 digits of the SHA-256 of the state's canonical features; null where these are."""
    return states.withColumn("anchor", F.concat(F.lit(f"{mode}:"), F.substring(F.sha2(features.cast("binary"), 256), 1, 16)))


def clustered_anchors(states: DataFrame, task: str, row: str, features: str, threshold: float) -> DataFrame:
    """(task, row, anchor): states of a task, in order, join the most alike earlier representative (Jaccard similarity of feature
    sets), or become one. A task's states are as many as its rollouts' steps, and walked through in one task of Spark."""

    def walk(rows: list[dict], least: float) -> list[int]:
        heads, out = [], []
        for at, own in enumerate(set(x[features]) for x in rows):
            best = max(((len(own & h) / max(1, len(own | h)), -i) for i, (_, h) in enumerate(heads)), default=(-1.0, 0))
            if best[0] < least:
                heads.append((at, own))
                best = (1.0, 1 - len(heads))
            out.append(heads[-best[1]][0])
        return out

    listed = states.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(row, features))).alias("rows_"))
    told = listed.withColumn("to_", _each(walk, "array<int>", pa.list_(pa.int32()), F.col("rows_"), F.lit(threshold)))
    pair = F.transform("to_", lambda to, i: F.struct(F.get("rows_", i)[row].alias("row"), F.get("rows_", to)[row].alias("anchor")))
    return told.select(task, F.explode(pair).alias("x")).select(task, F.col("x.row").alias(row), "x.anchor")


def next_arms(rewards: DataFrame, arm: str, reward: str, weight: float = 1.0) -> DataFrame:
    """(arm, n, mean, bound): a curriculum's arms with their upper confidence bounds, the largest of which is drawn from next."""
    seen = rewards.groupBy(arm).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"))
    total = seen.agg(F.sum("n").alias("all_"))
    return seen.crossJoin(F.broadcast(total)).withColumn("bound", F.col("mean") + weight * F.sqrt(2 * F.log("all_") / F.col("n"))).drop("all_")
