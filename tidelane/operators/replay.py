"""Replay of tool actions on a shared base state: read-modify-write steps with preconditions, folded per run and entity.

Nobody copies the base for a run. The actions that a run takes on one entity are folded, in order, from the entity's base
state; what comes out is a delta. A state's identity is an ordered tree of SHA-256 hashes: of an entity's fields, of the
changed entities of a run in order of their keys, and of the base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """One tool: given an entity's state (struct) and the action (struct with its arguments), `allowed` says whether it may run, and
    `effect` gives the fields that change. Without `creates` an entity that doesn't exist is a failure; with it, the tool
    makes the entity, from null fields, and one that exists is a failure. `deletes` leaves nothing of it."""

    allowed: Callable[[Column, Column], Column] = lambda state, action: F.lit(True)
    effect: Callable[[Column, Column], dict[str, Column]] = lambda state, action: {}
    creates: bool = False
    deletes: bool = False


def replayed(state: DataFrame, actions: DataFrame, tools: dict[str, Tool], run: str = "run", entity: str = "entity", step: str = "step", name: str = "name") -> DataFrame:
    """(run, entity, before, after, applied, failed): for each entity that a run acts on, its state before and after
    (structs of state's other columns, null: it doesn't exist) and the steps that changed it or failed.

    state: entity, unique, and its fields. actions: run, step, name, entity and the tools' arguments as further columns. A step whose tool isn't known, whose
    precondition isn't true (false or null) or whose entity is null fails and changes nothing; those after it go on with what is there. Steps with one number
    are taken by name and arguments in order. No actions give no rows; runs without actions have none.

    One shuffle by (run, entity) folds a list as long as a run's actions on one entity; the base is joined once to what is acted on.
    """
    kind, stepped = _fold(state, tools, entity)
    acted = actions.groupBy(run, entity).agg(_taken(actions, run, entity, step, name).alias("taken_"))
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.col("before").cast(kind).alias("now"), empty.alias("applied"), empty.alias("failed"))

    def kept(was: Column, action: Column, may: Column, now: Column) -> Column:
        add = lambda c, test: F.when(test, F.concat(was[c], F.array(action["step"].cast("long")))).otherwise(was[c]).alias(c)
        return F.struct(now.alias("now"), add("applied", may), add("failed", ~may))

    done = _based(acted, state, entity).withColumn("x_", F.aggregate("taken_", start, stepped(kept)))
    return done.select(run, entity, F.col("before").cast(kind).alias("before"), F.col("x_.now").alias("after"), F.col("x_.applied").alias("applied"), F.col("x_.failed").alias("failed"))


def _taken(actions: DataFrame, run: str, entity: str, step: str, name: str, test: Column | None = None) -> Column:
    """The actions of a group, or those of them that pass the test, in order."""
    rest = [c for c in actions.columns if c not in (run, entity, step, name)]
    action = F.struct(F.col(step).alias("step"), F.col(name).alias("name"), *(F.col(c) for c in rest))
    return F.array_sort(F.collect_list(action if test is None else F.when(test, action)))


def _based(acted: DataFrame, state: DataFrame, entity: str) -> DataFrame:
    fields = [c for c in state.columns if c != entity]
    base = state.select(F.col(entity).alias("of_"), F.struct(*fields).alias("before"))
    return acted.join(base, F.col(entity) == F.col("of_"), "left").drop("of_")


def _fold(state: DataFrame, tools: dict[str, Tool], entity: str) -> tuple[str, Callable]:
    """The type of a state, and what makes a step of a fold: given (was, action, whether it may, the state after it), what the fold carries on."""
    fields = [f for f in state.schema.fields if f.name != entity]
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in fields)}>"
    none = F.lit(None).cast(kind)

    def stepped(kept: Callable[[Column, Column, Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def step(was: Column, action: Column) -> Column:
            now, exists = was["now"], was["now"].isNotNull()
            may, then = F.lit(False), now
            for tool, t in tools.items():
                here = action["name"] == tool
                fits = F.coalesce(t.allowed(now, action), F.lit(False)) & F.col(entity).isNotNull() & (~exists if t.creates else exists)
                change = t.effect(now, action)
                if unknown := change.keys() - {f.name for f in fields}:
                    raise ValueError(f"{tool} changes {unknown}, which entities don't have")
                made = none if t.deletes else F.struct(*(change.get(f.name, now[f.name]).cast(f.dataType).alias(f.name) for f in fields)).cast(kind)
                may, then = F.when(here, fits).otherwise(may), F.when(here, made).otherwise(then)
            return kept(was, action, may, F.when(may, then).otherwise(now).cast(kind))

        return step

    return kind, stepped


def _hash(entity: str, state: Column) -> Column:
    """Of an entity's key and fields; null fields are told from missing ones by their place."""
    said = F.to_json(F.struct(F.col(entity).cast("string").alias("k"), state.alias("v")), {"ignoreNullFields": "false"})
    return F.sha2(said.cast("binary"), 256)


def state_hashes(runs: DataFrame, done: DataFrame, run: str = "run", entity: str = "entity") -> DataFrame:
    """(run, state, changed): for each of runs, the SHA-256 of the hashes of the entities that it leaves otherwise than the base has them, in
    order of their keys, and how many there are. Two runs on one base end in one state if and only if these are equal; a run that
    changes nothing has the hash of nothing."""
    moved = done.filter(~F.col("before").eqNullSafe(F.col("after")))
    each = moved.select(run, F.struct(F.col(entity).cast("string").alias("k"), _hash(entity, F.col("after")).alias("h")).alias("x"))
    tree = each.groupBy(run).agg(F.array_sort(F.collect_list("x")).alias("x"))
    found = runs.select(run).distinct().join(tree, run, "left")
    said = F.concat_ws("\n", F.transform(F.coalesce("x", F.array().cast("array<struct<k:string,h:string>>")), lambda e: e["h"]))
    return found.select(run, F.sha2(said.cast("binary"), 256).alias("state"), F.greatest(F.size("x"), F.lit(0)).cast("long").alias("changed"))


def base_hash(state: DataFrame, entity: str = "entity", digits: int = 3) -> DataFrame:
    """(hash, entities): one row, the SHA-256 of the base state by a tree: entities by their hash's first digits, and these
    buckets in order. Two tables are one state if the hashes are equal."""
    fields = [F.col(c) for c in state.columns if c != entity]
    each = state.select(_hash(entity, F.struct(*fields)).alias("h"))
    part = each.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))).cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    top = part.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"))
    return top.select(F.sha2(F.concat_ws("\n", F.transform("x", lambda e: F.concat(e["p"], F.lit(":"), e["h"]))).cast("binary"), 256).alias("hash"), "entities")


def compared_runs(state: DataFrame, actions: DataFrame, gold: DataFrame, tools: dict[str, Tool], run: str = "run", entity: str = "entity", step: str = "step", name: str = "name") -> DataFrame:
    """(run, equal, reward, failed, gold_failed, differing): for each run of actions or gold, whether both end in one state, 1.0 or 0.0 for
    that, the failed steps of each, and the keys of entities that end otherwise, in order. A gold action that fails is counted
    and not hidden. A run that only one side has is compared with the base as it was; a null is no run.

    Both sides' actions on an entity are folded in one row, from the one base state, so two runs end in one state if none of their entities differs. gold has the
    columns of actions."""
    kind, stepped = _fold(state, tools, entity)
    both = actions.withColumn("gold_", F.lit(False)).unionByName(gold.withColumn("gold_", F.lit(True))).filter(F.col(run).isNotNull())
    side = lambda test: _taken(actions, run, entity, step, name, test)
    acted = both.groupBy(run, entity).agg(side(~F.col("gold_")).alias("a_"), side(F.col("gold_")).alias("b_"))
    start = F.struct(F.col("before").cast(kind).alias("now"), F.lit(0).cast("long").alias("failed"))
    kept = lambda was, action, may, now: F.struct(now.alias("now"), F.when(may, was["failed"]).otherwise(was["failed"] + F.lit(1).cast("long")).alias("failed"))
    done = _based(acted, state, entity).withColumns({c: F.aggregate(c, start, stepped(kept)) for c in ("a_", "b_")})
    other = F.when(~F.col("a_.now").eqNullSafe(F.col("b_.now")), F.col(entity).cast("string"))
    told = done.groupBy(run).agg(F.sum("a_.failed").alias("failed"), F.sum("b_.failed").alias("gold_failed"), F.array_sort(F.collect_list(other)).alias("differing"))
    equal = F.size("differing") == 0
    return told.select(run, equal.alias("equal"), equal.cast("double").alias("reward"), "failed", "gold_failed", "differing")
