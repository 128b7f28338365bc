"""Dialogues, tool calls and speech: lookups, running states, segments by attribute, policy checks and replay."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAST = (Window.unboundedPreceding, 0)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key; none, or several, is an error, raised where the result is read."""
    found = df.filter(F.col(key) == value)
    n = found.agg(F.count("*").alias("n_"))
    ok = F.when(F.col("n_") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{key} {value}: rows "), F.col("n_").cast("string"))).cast("boolean"))
    return n.filter(ok).join(found, how="left").drop("n_")


def lookup_all(df: DataFrame, **values: str) -> DataFrame:
    """Rows that have all values, whatever their case."""
    return df.filter(reduce(lambda a, b: a & b, (F.lower(F.col(k).cast("string")) == v.lower() for k, v in values.items())))


def lookup_through(parents: DataFrame, children: DataFrame, value: object, own: str, ids: str, child: str, column: str) -> DataFrame:
    """Parents that have the value in `own`, or whose array `ids` names a child with it in `column`."""
    through = children.filter(F.col(column) == value).select(F.col(child).alias("id_")).distinct()
    links = parents.withColumn("id_", F.explode_outer(ids)).join(through, "id_", "left_semi").drop("id_")
    return parents.filter(F.col(own) == value).unionByName(links).distinct()


def flights(df: DataFrame, day: str, origin: str | None = None, destination: str | None = None, after: str | None = None) -> DataFrame:
    """Flights that are available on a day (dates: map from day to a struct with status), with that day's entry as `on_day`;
    between the given places and not before a time (HH:MM:SS), where these are given."""
    out = df.withColumn("on_day", F.try_element_at("dates", F.lit(day))).filter("on_day.status = 'available'")
    for c, v in (("origin", origin), ("destination", destination)):
        out = out if v is None else out.filter(F.col(c) == v)
    return out if after is None else out.filter(F.col("departs") >= after)


def newest(df: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """The last rows by a column, newest first."""
    return df.orderBy(F.desc(by), tie).limit(limit)


def sorted_by(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Rows in the order of several columns (name, rising); nulls last."""
    return df.orderBy(*(F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order))


def submissions(df: DataFrame, organization: str | None = None, trajectories: bool | None = None) -> DataFrame:
    """Leaderboard rows of an organisation, whatever its case, and with or without trajectories."""
    out = df if organization is None else df.filter(F.lower("organization") == organization.lower())
    return out if trajectories is None else out.filter(F.coalesce("trajectories", F.lit(False)) == trajectories)


def mapped(df: DataFrame, column: str, values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the value that the table has for the column; null where it has none. A key given twice is an error."""
    one = F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.lit("a key is given twice")).cast(values.schema[value].dataType))
    return df.join(values.groupBy(F.col(key).alias("k_")).agg(one.alias(name)), F.col(column) == F.col("k_"), "left").drop("k_")


def known_mask(messages: DataFrame, key: str, order: str, facts: dict[str, Column]) -> DataFrame:
    """Adds `known`: bit i is set once the i-th fact was seen, in this message or an earlier one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(*PAST)
    return messages.withColumn("known", sum((F.max(F.coalesce(c, F.lit(False)).cast("int")).over(w) * F.lit(1 << i) for i, c in enumerate(facts.values())), F.lit(0)))


def confirmations(messages: DataFrame, key: str, order: str, asks: Column, agrees: Column, acts: Column) -> DataFrame:
    """Adds asked, confirmed (an agreement after the last question, with no act since) and unconfirmed (an act without
    that); messages have a role that the conditions look at."""
    w = Window.partitionBy(key).orderBy(order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(*PAST)
    last = lambda c, over: F.max(F.when(F.coalesce(c, F.lit(False)), F.col(order))).over(over)
    asked, agreed, acted = last(asks, so_far), last(agrees, so_far), last(acts, before)
    sure = (agreed > asked) & (acted.isNull() | (acted < agreed))
    return messages.withColumns({"asked": asked.isNotNull(), "confirmed": F.coalesce(sure, F.lit(False)), "unconfirmed": F.coalesce(acts, F.lit(False)) & ~F.coalesce(sure, F.lit(False))})


def early_writes(messages: DataFrame, key: str, order: str, write: Column, described: Column, reply: Column) -> DataFrame:
    """(key, early): whether a write comes before the first reply that follows a description."""
    first = lambda c, name: F.min(F.when(F.coalesce(c, F.lit(False)), F.col(order))).alias(name)
    told = messages.groupBy(key).agg(first(described, "d_"), first(write, "w_"))
    after = messages.join(told, key).groupBy(key).agg(F.first("w_").alias("w_"), F.min(F.when(F.coalesce(reply, F.lit(False)) & (F.col(order) > F.col("d_")), F.col(order))).alias("r_"))
    return after.select(key, (F.col("w_").isNotNull() & (F.col("r_").isNull() | (F.col("w_") < F.col("r_")))).alias("early"))


def unread_writes(calls: DataFrame, key: str, order: str, write: Column, read: Column) -> DataFrame:
    """(key, repeated, unread): whether a signature occurs twice, and whether no read follows the last write."""
    same = calls.groupBy(key, "signature").agg(F.count("*").alias("n_")).groupBy(key).agg((F.max("n_") > 1).alias("repeated"))
    last = calls.groupBy(key).agg(F.max(F.when(write, F.col(order))).alias("w_"), F.max(F.when(read, F.col(order))).alias("r_"))
    return same.join(last, key).select(key, "repeated", F.coalesce(F.col("w_") > F.coalesce("r_", F.lit(-1)), F.lit(False)).alias("unread"))


def observations(messages: DataFrame, key: str, order: str, kind: Column, error: Column) -> DataFrame:
    """Adds last_observation (the kind of the last tool message so far) and errors (how many of them failed)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(*PAST)
    return messages.withColumns({"last_observation": F.last(kind, ignorenulls=True).over(w), "errors": F.sum(F.coalesce(error, F.lit(False)).cast("int")).over(w)})


def attribute_segments(ticks: DataFrame, key: str, tick: str, attribute: str, seconds: float = 0.2) -> DataFrame:
    """(key, attribute, start_tick, end_tick, start_sec, end_sec) of maximal runs of ticks with one attribute of an array
    (sound effects may overlap), half-open."""
    each = ticks.select(key, tick, F.explode(F.array_distinct(attribute)).alias("attribute"))
    island = each.withColumn("i_", F.col(tick) - F.row_number().over(Window.partitionBy(key, "attribute").orderBy(tick)))
    runs = island.groupBy(key, "attribute", "i_").agg(F.min(tick).alias("start_tick"), (F.max(tick) + 1).alias("end_tick")).drop("i_")
    return runs.withColumns({"start_sec": F.col("start_tick") * seconds, "end_sec": F.col("end_tick") * seconds})


def segment_attributes(segments: DataFrame, ticks: DataFrame, key: str, other: str, flags: Iterable[str] = (), tick: str = "tick") -> DataFrame:
    """segments (key, start_tick, end_tick) with other_at_start and other_at_end (whether the other speaks in the first tick, and
    in the first one after the last; false where there is none), and for each flag whether a tick within has it."""
    names = list(flags)
    own = segments.select(key, "start_tick", "end_tick", F.explode(F.sequence("start_tick", "end_tick")).alias(tick))
    seen = own.join(ticks.select(key, tick, other, *names), [key, tick], "left")
    inside = F.col(tick) < F.col("end_tick")
    on = lambda c, at: F.coalesce(F.max(F.when(at, F.col(c))), F.lit(False))
    return seen.groupBy(key, "start_tick", "end_tick").agg(on(other, F.col(tick) == F.col("start_tick")).alias("other_at_start"), on(other, F.col(tick) == F.col("end_tick")).alias("other_at_end"), *(on(n, inside).alias(n) for n in names))


def without_tail(segments: DataFrame, key: str, last_tick: DataFrame) -> DataFrame:
    """Segments without those of one tick that end with their dialogue (last_tick: key, last): an artefact of hanging up."""
    return segments.join(last_tick, key, "left").filter(F.coalesce((F.col("end_tick") - F.col("start_tick") > 1) | (F.col("end_tick") <= F.col("last")), F.lit(True))).drop("last")


def interruptions(users: DataFrame, ticks: DataFrame, key: str, window: int, tick: str = "tick", other: str = "agent") -> DataFrame:
    """(key, start_tick, interrupts, yield_tick): user segments that begin while the other speaks, and the first tick within the
    window in which it is silent (null: it goes on)."""
    talk = ticks.select(key, F.col(tick).alias("t_"), F.col(other).alias("o_"))
    near = users.withColumn("t_", F.explode(F.sequence("start_tick", F.col("start_tick") + window - 1))).join(talk, [key, "t_"], "left")
    began = F.coalesce(F.max(F.when(F.col("t_") == F.col("start_tick"), F.col("o_"))), F.lit(False))
    quiet = F.min(F.when(~F.col("o_"), F.col("t_")))
    return near.groupBy(key, "start_tick").agg(began.alias("interrupts"), quiet.alias("q_")).select(key, "start_tick", "interrupts", F.when(F.col("interrupts"), F.col("q_")).alias("yield_tick"))


def responses(users: DataFrame, agents: DataFrame, key: str, window: int) -> DataFrame:
    """(key, start_tick, end_tick, response_tick, latency): the first agent segment that begins from the user's start to
    `window` ticks after its end, and its distance from the end; null without one. Segments are joined by pieces of time."""
    size = window + 50
    u = users.withColumn("b_", F.explode(F.sequence(F.floor(F.col("start_tick") / size), F.floor((F.col("end_tick") + window) / size))))
    a = agents.select(key, F.col("start_tick").alias("a_"), F.floor(F.col("start_tick") / size).alias("b_"))
    met = u.join(a, [key, "b_"], "left").withColumn("a_", F.when((F.col("a_") >= F.col("start_tick")) & (F.col("a_") <= F.col("end_tick") + window), F.col("a_")))
    return met.groupBy(key, "start_tick", "end_tick").agg(F.min("a_").alias("response_tick")).withColumn("latency", F.col("response_tick") - F.col("end_tick"))


def voice_metrics(events: DataFrame, *keys: str) -> DataFrame:
    """By keys: user turns, how many were answered and rates of answers and yields, mean and sample deviation of latencies.
    events: response_tick, latency, interrupts, yield_tick."""
    n, hits = F.count("*"), F.count_if(F.col("interrupts"))
    return events.groupBy(*keys).agg(n.alias("turns"), F.count("response_tick").alias("answered"), (F.count("response_tick") / n).alias("response_rate"), hits.alias("interruptions"), F.try_divide(F.count("yield_tick"), hits).alias("yield_rate"), F.avg("latency").alias("latency_mean"), F.stddev_samp("latency").alias("latency_std"))


def visible(messages: str) -> Column:
    """The visible part of messages (structs): role, content, name and tool_calls, with event ids m000, m001, …"""
    return F.transform(messages, lambda m, i: F.struct(F.format_string("m%03d", i).alias("event_id"), m["role"].alias("role"), m["content"].alias("content")))


def with_answer(messages: str, content: Column, thinking: Column) -> Column:
    """messages with the assistant's answer at the end: its content ("" for null), its thinking kept apart as `reasoning`."""
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("reasoning")))
    return F.array_append(plain, F.struct(F.lit("assistant").alias("role"), F.coalesce(content, F.lit("")).alias("content"), F.when(thinking != "", thinking).alias("reasoning")))


def opening(instructions: Column, messages: str) -> Column:
    """The first user message, or, where there is none, the instructions."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], instructions)


def paid_beyond_allowance(df: DataFrame, allowances: DataFrame, member: str, cabin: str, people: str, total: str) -> DataFrame:
    """Adds free and expected (max(0, total - free)), from the allowance (member, cabin, free) for each person; null where it isn't known."""
    known = allowances.select(F.col("member").alias("m_"), F.col("cabin").alias("c_"), F.col("free").alias("f_"))
    out = df.join(known, (F.col(member) == F.col("m_")) & (F.col(cabin) == F.col("c_")), "left").withColumn("free", F.col("f_") * F.col(people))
    return out.withColumn("expected", F.when(F.col("free").isNotNull(), F.greatest(F.lit(0), F.col(total) - F.col("free")))).drop("m_", "c_", "f_")


def causal_checks(calls: DataFrame, seen: DataFrame, key: str, order: str, entity: str, value: str, said: str) -> DataFrame:
    """calls with `known` (what was last observed of their entity, strictly before them) and status: satisfied, violated or unknown."""
    a = seen.select(key, order, entity, F.col(value).alias("v_"), F.lit(None).cast(calls.schema[said].dataType).alias("s_"), F.lit(0).alias("call_"))
    b = calls.select(key, order, entity, F.lit(None).cast(seen.schema[value].dataType).alias("v_"), F.col(said).alias("s_"), F.lit(1).alias("call_"))
    w = Window.partitionBy(key, entity).orderBy(order, F.desc("call_")).rowsBetween(Window.unboundedPreceding, -1)
    known = a.union(b).withColumn("known", F.last("v_", ignorenulls=True).over(w)).filter("call_ = 1")
    status = F.when(F.col("known").isNull() | F.col("s_").isNull(), "unknown").when(F.col("known") == F.col("s_"), "satisfied").otherwise("violated")
    return known.select(key, order, entity, F.col("s_").alias(said), "known", status.alias("status"))


def receipt_violations(calls: DataFrame, receipts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, call, kind): orphan (a receipt without an open call), id_mismatch (the k-th receipt answers another id than the k-th
    call), duplicate (a call's id occurs before), unfinished (a call without a receipt). Both have an id."""
    nth = lambda d, p: d.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("k_"), F.col(order).alias(f"{p}_at"), F.col("id").alias(f"{p}_id"))
    both = nth(calls, "c").join(nth(receipts, "r"), [key, "k_"], "full_outer")
    again = F.row_number().over(Window.partitionBy(key, "id").orderBy(order)) > 1
    twice = calls.withColumn("again_", again).filter("again_").select(key, F.col(order).alias("at"), F.lit("duplicate").alias("kind"))
    kind = F.when(F.col("c_at").isNull(), "orphan").when(F.col("r_at").isNull(), "unfinished").when(F.col("r_at") < F.col("c_at"), "out_of_order").when(F.col("c_id") != F.col("r_id"), "id_mismatch")
    return both.select(key, F.coalesce("c_at", "r_at").alias("at"), kind.alias("kind")).filter("kind IS NOT NULL").union(twice)


def schema_findings(calls: DataFrame, schemas: DataFrame, key: str) -> DataFrame:
    """(key, kind, name): unknown_tool, missing (a required argument isn't there), unexpected (an argument that the tool
    doesn't take) and wrong_type, for calls (tool, arguments: map of JSON texts) under schemas (tool, argument, type, required)."""
    tools = schemas.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("argument", F.struct("type", "required")))).alias("spec_"))
    joined = calls.join(tools, "tool", "left")
    unknown = joined.filter("spec_ IS NULL").select(key, F.lit("unknown_tool").alias("kind"), F.col("tool").alias("name"))
    known = joined.filter("spec_ IS NOT NULL")
    lacks = known.select(key, F.lit("missing").alias("kind"), F.explode(F.map_keys(F.map_filter("spec_", lambda k, s: s["required"] & ~F.map_contains_key("arguments", k)))).alias("name"))
    more = known.select(key, F.lit("unexpected").alias("kind"), F.explode(F.map_keys(F.map_filter("arguments", lambda k, _: ~F.map_contains_key("spec_", k)))).alias("name"))
    first = lambda v: F.substring(F.trim(v), 1, 1)
    of = lambda v: F.when(first(v) == '"', "string").when(first(v) == "{", "object").when(first(v) == "[", "array").when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?[0-9]+$"), "integer").otherwise("number")
    fits = lambda v, t: (of(v) == t) | (t == "number") & (of(v) == "integer")
    wrong = known.select(key, F.lit("wrong_type").alias("kind"), F.explode(F.map_keys(F.map_filter("arguments", lambda k, v: F.map_contains_key("spec_", k) & ~fits(v, F.try_element_at("spec_", k)["type"])))).alias("name"))
    return unknown.union(lacks).union(more).union(wrong)


def replay(state: DataFrame, actions: DataFrame, run: str, key: str, order: str, value: str) -> DataFrame:
    """(run, key, value) of every run's database after its actions: the last write of a key, or what the state has; a null
    write deletes. Only written keys are stored for a run; the others are the state's."""
    last = actions.groupBy(run, key).agg(F.max_by(F.struct(value), order).alias("w_"))
    runs = actions.select(run).distinct()
    return last.select(run, key, F.col(f"w_.{value}").alias(value)).join(runs, run)


def outcome_hashes(state: DataFrame, actions: DataFrame, run: str, key: str, order: str, value: str) -> DataFrame:
    """(run, changes, hash): a hash of what each run changed, against the state: equal for runs that leave equal databases,
    whatever the way there. Writes of what is there already change nothing."""
    written = replay(state, actions, run, key, order, value)
    both = written.join(state.select(key, F.col(value).alias("was_")), key, "left")
    real = both.filter(~F.col(value).eqNullSafe(F.col("was_")))
    sums = real.groupBy(run).agg(F.count("*").alias("changes"), F.bit_xor(F.xxhash64(key, F.coalesce(F.col(value).cast("string"), F.lit("\x00gone")))).alias("hash"))
    return actions.select(run).distinct().join(sums, run, "left").select(run, F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("hash", F.lit(0)).alias("hash"))


def same_outcome(state: DataFrame, predicted: DataFrame, gold: DataFrame, run: str, key: str, order: str, value: str) -> DataFrame:
    """(run, reward): 1 where a run's actions leave the database that the gold actions leave, else 0. Runs of either side count."""
    a = outcome_hashes(state, predicted, run, key, order, value).select(run, F.struct("changes", "hash").alias("a_"))
    b = outcome_hashes(state, gold, run, key, order, value).select(run, F.struct("changes", "hash").alias("b_"))
    none = F.struct(F.lit(0).cast("long").alias("changes"), F.lit(0).cast("long").alias("hash"))
    return a.join(b, run, "full_outer").select(run, (F.coalesce("a_", none) == F.coalesce("b_", none)).cast("double").alias("reward"))
