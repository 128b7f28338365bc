"""Scores of a dialogue's tool calls against gold actions: ordered one-to-one matching, tiers and turn rewards.

A gold action pays for one call that does exactly what it asks for, the first call first.
Calls and gold actions that are exactly alike form classes of their own, so the n-th
successful call of a class is paid by the class's n-th gold action: matching, repeats and the
last observation of a call are numbers and lags within a class. No dialogue is walked through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import documents as D

TIERS = ["error", "gold_exact", "gold_read", "gold_write", "duplicate", "soft_match", "read_only", "state_change", "generic", "unknown", "message"]


@dataclass(frozen=True)
class Tools:
    """Names of the tools that read, that write, and that hand the dialogue over."""

    reads: frozenset[str] = frozenset()
    writes: frozenset[str] = frozenset()
    handoffs: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Rules:
    """How calls are matched and paid. `execution`: by strict equality of the arguments as they take effect, where a repeated
    read whose observation changed is no duplicate; otherwise by their identity, empty entries aside. `split`:
    gold reads and gold writes are tiers of their own. `neutral_handoffs`: a handover is generic (execution only). `soft`: overlap pays a soft match (1 + overlap)
    times its weight. `mean`: a turn gets its calls' mean and not their sum."""

    weights: dict[str, float] = field(default_factory=dict)
    execution: bool = False
    split: bool = False
    neutral_handoffs: bool = False
    soft: str = "overlap"
    mean: bool = False


def _any(name: Column, names: frozenset[str]) -> Column:
    return name.isin(*names) if names else F.lit(False)


def _weight(tier: Column, weights: dict[str, float]) -> Column:
    missing = F.raise_error(F.concat(F.lit("no weight for "), tier)).cast("double")
    for name, weight in weights.items():
        missing = F.when(tier == name, F.lit(float(weight))).otherwise(missing)
    return missing


def _known(df: DataFrame, arguments: Column, strict: bool) -> DataFrame:
    """Adds `members_`, null where the arguments are no object, and `class_`, the same for the same call."""
    told = df.withColumn("members_", D.member_texts(arguments, strict))
    said = F.coalesce(F.concat(F.lit("object\n"), F.array_join("members_", "\n")), F.concat(F.lit("text\n"), F.coalesce(arguments, F.lit(""))))
    return told.withColumn("class_", F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("name")), F.lit("")), F.lit("\n"), said), 256))


def _asked(gold: DataFrame, key: str, strict: bool) -> DataFrame:
    """(of_, asked_): a dialogue's gold actions whose arguments are objects, an entry of asked_ for each class of them with its places in order."""
    wanted = _known(gold, F.col("arguments"), strict)
    each = wanted.groupBy(F.col(key).alias("of_"), "class_").agg(F.first("name").alias("name"), F.first("members_").alias("members"), F.array_sort(F.collect_list("place_")).alias("places"))
    return each.filter("members IS NOT NULL").groupBy("of_").agg(F.collect_list(F.struct(F.col("class_").alias("class"), "name", "members", "places")).alias("asked_"))


def _overlap(members: Column, name: Column, asked: Column) -> Column:
    """The largest part of a gold action's members that a call of its name has; null where it has none."""
    part = lambda g: F.when(g["name"] == name, F.try_divide(F.size(F.array_intersect(g["members"], members)), F.size(g["members"])))
    most = F.array_max(F.transform(asked, part))
    return F.when(most > 0, most)


def score_calls(calls: DataFrame, gold: DataFrame, rules: Rules, tools: Tools, key: str = "id", order: str = "step", place: str = "place", effective: Column | None = None) -> DataFrame:
    """calls with tier, matched (the place of the gold action that pays, else null), overlap, evidence and reward.

    calls: key, order (tells a dialogue's calls apart), name, arguments (JSON text), error (boolean, not null) and, for
    execution rules, observation (text) and truncated (boolean), which may be missing. gold: key, place, name, arguments (JSON objects).
    `effective` gives the arguments of calls as they take effect, null where they are invalid; gold's are
    taken as they are. Columns of calls that have an added one's name are replaced. Errors neither match nor count as repeats. Null arguments are none: such a call is
    unknown under execution rules, and else matches nothing. Null keys match nothing. A dialogue without
    gold has no gold tiers; no calls give no rows. Rows with equal key and order are numbered in any order.

    One join by dialogue, whose gold actions are one row of classes, and one sort by (dialogue, class) that numbers its calls. Arguments are
    read once. A dialogue is worked on in one task, by its calls times its different gold actions.
    """
    for tier in rules.weights:
        if tier not in TIERS:
            raise ValueError(f"no tier {tier}")
    extra = {"observation": F.lit(None).cast("string"), "truncated": F.lit(False)}
    calls = calls.drop("tier", "matched", "overlap", "evidence", "reward").withColumns({c: v for c, v in extra.items() if c not in calls.columns})
    arguments = F.col("arguments") if effective is None or not rules.execution else effective
    wanted = _asked(gold.withColumn("place_", F.col(place)), key, rules.execution)
    told = _known(calls, arguments, rules.execution).join(wanted, F.col(key) == F.col("of_"), "left").drop("of_")
    paying = F.get(F.filter("asked_", lambda g: g["class"] == F.col("class_")), F.lit(0))["places"]
    told = told.withColumns({"pays_": F.when(F.col("members_").isNotNull(), paying), "overlap": _overlap(F.col("members_"), F.col("name"), F.col("asked_"))}).drop("asked_")

    failed = F.when(F.col("error").isNull(), F.raise_error(F.lit("a call doesn't say whether it failed")).cast("boolean")).otherwise(F.col("error"))
    valid = F.col("members_").isNotNull() if rules.execution else F.lit(True)
    told = told.withColumn("counts_", ~failed & valid)
    reads = _any(F.col("name"), tools.reads)
    if rules.execution:
        told = told.withColumn("seen_", D.observed(F.when(F.col("counts_") & reads & ~F.coalesce("truncated", F.lit(False)), F.col("observation"))))
    else:
        told = told.withColumn("seen_", F.lit(None).cast("string"))
    alike = Window.partitionBy(key, "class_", "counts_").orderBy(order)
    told = told.withColumns({"nth_": F.row_number().over(alike), "last_": F.lag("seen_").over(alike)})

    paid = told.withColumn("matched", F.when(F.col("counts_"), F.get("pays_", F.col("nth_") - 1))).drop("pays_")
    shown = F.coalesce("overlap", F.lit(0.0)) if not rules.execution else F.when(F.col("counts_"), F.coalesce("overlap", F.lit(0.0))).otherwise(0.0)

    again = F.col("nth_") > 1
    evidence = F.when(~again, "first_success")
    if rules.execution:
        unknown = F.col("seen_").isNull() | F.col("last_").isNull()
        evidence = evidence.when(~reads, "same_execution_arguments").when(unknown, "read_response_unavailable").when(F.col("seen_") == F.col("last_"), "read_response_unchanged").otherwise("read_response_changed")
        evidence = F.when(failed, "execution_error").when(~valid, "invalid_successful_arguments").otherwise(evidence)
    else:
        evidence = F.when(failed, "execution_error").otherwise(evidence.otherwise("same_arguments"))
    gold_tier = F.lit("gold_exact")
    if rules.split:
        gold_tier = F.when(reads, "gold_read").when(_any(F.col("name"), tools.writes), "gold_write").otherwise("gold_exact")
    repeat = F.when(F.col("evidence") == "read_response_unavailable", "unknown").when(F.col("evidence") == "read_response_changed", "read_only").otherwise("duplicate")
    writes = _any(F.col("name"), tools.writes | tools.handoffs)
    tier = F.when(failed, "error").when(~valid, "unknown")
    if rules.execution and rules.neutral_handoffs:
        tier = tier.when(_any(F.col("name"), tools.handoffs), "generic")
    tier = tier.when(F.col("matched").isNotNull(), gold_tier).when(again, repeat).when(F.col("overlap") > 0, "soft_match").when(reads, "read_only").when(writes, "state_change").otherwise("unknown")
    scored = paid.withColumn("overlap", shown).withColumn("evidence", evidence).withColumn("tier", tier)
    more = F.when(F.col("tier") == "soft_match", 1 + F.col("overlap")).otherwise(1.0) if rules.soft == "overlap" else F.lit(1.0)
    return scored.withColumn("reward", _weight(F.col("tier"), rules.weights) * more).drop("members_", "class_", "counts_", "seen_", "nth_", "last_")


def turn_rewards(turns: DataFrame, scored: DataFrame, rules: Rules, key: str = "id", turn: str = "turn", order: str = "step") -> DataFrame:
    """turns (key, turn) with reward and tiers in order of the calls; one without calls is a message."""
    called = scored.groupBy(key, turn).agg(F.sum("reward").alias("sum_"), F.count("*").alias("n_"), F.array_sort(F.collect_list(F.struct(order, "tier"))).alias("of_"))
    joined = turns.join(called, [key, turn], "left")
    paid = F.col("sum_") / F.col("n_") if rules.mean else F.col("sum_")
    out = joined.withColumn("reward", F.when(F.col("n_").isNull(), F.lit(float(rules.weights["message"]))).otherwise(paid))
    return out.withColumn("tiers", F.coalesce(F.transform("of_", lambda x: x["tier"]), F.array(F.lit("message")))).drop("sum_", "n_", "of_")
