"""Raw rows of unlike shapes as rows of one shape, over VARIANT: flat rows, rows with a whole simulation, rows with trajectory facts.

Rows come as JSON texts. Parts may be objects or JSON texts of objects. What is missing is unknown, not zero; what
contradicts its shape makes the row a failure of a named kind and never stops the others.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.json_schema import bound
from tidelane.operators.evaluation import FAILURES, INFRASTRUCTURE, LIMITS, SCORABLE

# Names that labels go by.
INFRA_ENDS = (*INFRASTRUCTURE, "simulator_error")
INFRA_KINDS = ("infrastructure", "infrastructure_error", "simulator_error")
#: How often a mark is repeated before a text counts as a repetition.
MARKS = r"(?:✅\s*){20,}"
VARIANTS = "array<variant>"
WHOLES = {"OBJECT": "map<string,variant>", "ARRAY": VARIANTS}


def _fields(value: Column) -> Column:
    """An object's fields as a map, read once; null for anything else."""
    return F.try_variant_get(value, "$", WHOLES["OBJECT"])


def _at(fields: Column, path: str) -> Column:
    """A part by its name among fields; null where there is none, or a JSON null. Spark's own paths throw where there is none, which takes longer than all else."""
    first, _, rest = path.partition(".")
    part = F.try_element_at(fields, F.lit(first))
    return _at(_fields(part), rest) if rest else bound(part, lambda x: F.when(~F.is_variant_null(x), x))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _shape(value: Column, kind: str) -> Column:
    """Whether it is an OBJECT, an ARRAY, a STRING or a BOOLEAN. What holds others isn't read to its depth, as its schema would be."""
    as_ = lambda v, t: F.try_variant_get(v, "$", t).isNotNull()
    if kind in WHOLES:
        return as_(value, WHOLES[kind])
    return bound(value, lambda v: F.when(v.isNull() | as_(v, WHOLES["OBJECT"]) | as_(v, WHOLES["ARRAY"]), F.lit(False)).otherwise(F.schema_of_variant(v).startswith(kind)))


def _opened(value: Column) -> Column:
    """The fields of an object, or of the text of one; nothing and empty text have none; null for anything else."""
    empty = F.create_map().cast(WHOLES["OBJECT"])
    text = lambda v: bound(_text(v), lambda t: F.when(t == "", empty).otherwise(_fields(F.try_parse_json(t))))
    return bound(value, lambda v: F.when(v.isNull(), empty).when(_shape(v, "STRING"), text(v)).otherwise(_fields(v)))


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", VARIANTS)


def _true(value: Column) -> Column:
    return bound(value, lambda v: _shape(v, "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))


def _said(value: Column) -> Column:
    """Whether a value is other than null, false, zero and empty."""
    return F.coalesce(~F.to_json(value).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _call(call: Column) -> Column:
    """Of a call's fields."""
    name = lambda part: bound(part, lambda v: F.when(_shape(v, "STRING"), bound(_text(v), lambda t: F.when(t != "", t))))
    read = lambda text: F.coalesce(F.to_json(F.try_parse_json(text)), F.to_json(F.struct(text.alias("invalid_json_arguments"))))
    arguments = lambda given: F.when(_shape(given, "STRING"), bound(_text(given), read)).otherwise(F.coalesce(F.to_json(given), F.lit("null")))
    told = lambda f: F.struct(
        F.coalesce(name(_at(f, "name")), name(_at(call, "tool_name"))).alias("name"), bound(_at(f, "arguments"), arguments).alias("arguments"), _true(_at(call, "error")).alias("error")
    )
    return bound(F.coalesce(_fields(_at(call, "function")), call), told)


def normalized_rows(rows: DataFrame, raw: str, reads: list[str], writes: list[str], kind: str = "rollout") -> DataFrame:
    """rows with problem, record_kind, task_id, trajectory_id, sample_group_uid, trial, seed, global_step, source_dialog_id, termination_reason,
    failure_category, score, eligibility_category, scored, evaluation_trial_complete, success, labels (sorted), tool_evidence_source,
    tool_names, tool_call_count, read_call_count, write_call_count, initial_db_hash, final_db_hash and text_length.

    raw holds a JSON object. kind is rollout or demonstration (which has no score, scoring or outcome). problem names what is wrong with a row, the first of: "not an object", "normalized
    already", "<part> must be an object", "<part> must be a list", "message must be an object", "call without a name", "reward must be a finite number", "unscored run has an outcome"; the row's other new columns are null
    then. A null raw isn't an object. Rows stay rows of their own however often they are repeated; columns with new ones' names are replaced. All of it is column
    expressions: no shuffle, and no Python.
    """
    if kind not in ("rollout", "demonstration"):
        raise ValueError(f"no kind {kind}")
    v = F.col("v_")
    rollout = F.lit(kind == "rollout")
    df = rows.withColumn("v_", _fields(F.try_parse_json(raw))).withColumn("sim_", _opened(_at(v, "simulation")))
    df = df.withColumn("info_", _opened(_at(F.col("sim_"), "info"))).withColumn("facts_", _opened(F.coalesce(_at(v, "trajectory_facts_json"), _at(F.col("info_"), "trajectory_facts"))))
    sim, info, facts = F.col("sim_"), F.col("info_"), F.col("facts_")
    df = df.withColumns({"term_": _opened(_at(facts, "terminal")), "id_": _opened(_at(facts, "identity")), "paid_": _opened(_at(sim, "reward_info")), "traj_": _opened(_at(v, "trajectory_json"))})
    term, identity = F.col("term_"), F.col("id_")
    df = df.withColumn("elig_", _opened(F.coalesce(_at(v, "execution_eligibility"), _at(term, "execution_eligibility"))))
    elig = F.col("elig_")

    simulated = F.coalesce(F.size(sim) > 0, F.lit(False))
    holder = F.when(simulated, sim).otherwise(v)
    df = df.withColumns({"turns_": F.try_element_at(facts, F.lit("turns")), "messages_": F.try_element_at(holder, F.lit("messages"))})
    df = df.withColumns({c: F.transform(_list(F.col(of)), _fields) for c, of in (("told_", "turns_"), ("said_", "messages_"))})
    turns, messages = F.col("told_"), F.col("said_")
    told = F.coalesce(F.forall(turns, lambda t: t.isNotNull() & _shape(_at(t, "tool_calls"), "ARRAY")), F.lit(False))
    none = F.array().cast(VARIANTS)
    assistants = F.filter(messages, lambda m: F.coalesce(_text(_at(m, "role")) == "assistant", F.lit(False)))
    of_turns = F.flatten(F.transform(turns, lambda t: _list(_at(t, "tool_calls"))))
    of_messages = F.flatten(F.transform(assistants, lambda m: F.coalesce(_list(_at(m, "tool_calls")), none)))
    by_hand = _list(_at(F.col("traj_"), "tool_calls"))
    source = F.when(told, "trajectory_facts").when(F.col("messages_").isNotNull(), F.when(simulated, "simulation.messages").otherwise("messages")).when(by_hand.isNotNull(), "trajectory_json").otherwise("unavailable")
    found = F.when(told, of_turns).when(F.col("messages_").isNotNull(), of_messages).when(by_hand.isNotNull(), by_hand)
    df = df.withColumn("tool_evidence_source", source).withColumn("calls_", F.transform(found, lambda c: bound(_fields(c), _call)))
    calls = F.col("calls_")

    end = F.coalesce(*(_text(_at(x, "termination_reason")) for x in (v, sim, term)))
    failure = F.coalesce(_text(_at(v, "failure_category")), _text(_at(term, "failure_category")))
    paid = F.coalesce(_at(v, "score"), _at(v, "reward"), _at(F.col("paid_"), "reward"), _at(term, "reward"))
    df = df.withColumns({"end_": end, "failure_": failure, "score_": F.when(~_shape(paid, "BOOLEAN"), F.try_variant_get(paid, "$", "double")), "paid_at_": paid.isNotNull()})
    score = F.col("score_")
    finite = F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))
    infra = F.coalesce(F.col("end_").isin(*INFRA_ENDS), F.lit(False)) | F.coalesce(F.col("failure_").isin(*INFRA_KINDS), F.lit(False)) | _said(_at(v, "error")) | F.coalesce(_text(_at(elig, "category")) == "infrastructure_error", F.lit(False))
    scorable, known = (F.coalesce(F.col("end_").isin(*x), F.lit(False)) for x in (SCORABLE, (*SCORABLE, *FAILURES)))
    limit, fallback = (F.coalesce(F.col("end_").isin(*x), F.lit(False)) for x in (LIMITS, FAILURES))

    parts = {"simulation": sim, "simulation.info": info, "trajectory_facts": facts, "terminal": term, "identity": identity, "simulation.reward_info": F.col("paid_"), "execution_eligibility": elig}
    listed = lambda c: c.isNull() | _shape(c, "ARRAY")
    bad_list = F.coalesce(F.exists(assistants, lambda m: ~listed(_at(m, "tool_calls")) & _said(_at(m, "tool_calls"))), F.lit(False))
    used = F.col("tool_evidence_source").isin("messages", "simulation.messages")
    problem = F.when(v.isNull(), "not an object").when(_said(_at(v, "record_kind")) | _said(_at(v, "analysis_version")), "normalized already")
    for name, part in parts.items():
        problem = problem.when(part.isNull(), f"{name} must be an object")
    problem = (
        problem.when(~listed(F.col("turns_")), "turns must be a list").when(used & ~_shape(F.col("messages_"), "ARRAY"), "messages must be a list")
        .when(used & F.coalesce(F.exists(messages, lambda m: m.isNull()), F.lit(False)), "message must be an object").when(used & bad_list, "tool_calls must be a list")
        .when(F.col("traj_").isNull() & F.col("tool_evidence_source").isin("unavailable", "trajectory_json"), "trajectory_json must be an object").when(F.coalesce(F.exists(calls, lambda c: c["name"].isNull()), F.lit(False)), "call without a name")
        .when(F.col("paid_at_") & ~finite, "reward must be a finite number").when(rollout & ~scorable & F.coalesce(score != 0, F.lit(False)), "unscored run has an outcome")
    )

    df = df.withColumns({"problem": problem, "infra_": infra})
    infra = F.col("infra_")
    not_false = lambda x: ~(_shape(x, "BOOLEAN") & ~_true(x))
    official = rollout & score.isNotNull() & scorable & ~infra & not_false(_at(v, "scored")) & not_false(_at(term, "scored")) & not_false(_at(elig, "officially_scored"))
    complete = rollout & score.isNotNull() & known & ~infra & not_false(_at(elig, "evaluation_trial_complete")) & (official | fallback)
    first_hash = F.coalesce(*(_text(_at(x, "initial_db_hash")) for x in (v, info, term)))
    last_hash = F.coalesce(_text(_at(v, "db_hash")), _text(_at(info, "final_db_hash")), _text(_at(info, "db_hash")), _text(_at(term, "db_hash")))
    df = df.withColumns({"scored": official, "evaluation_trial_complete": complete, "initial_db_hash": first_hash, "final_db_hash": last_hash, "names_": F.transform(calls, lambda c: c["name"])})
    complete, names = F.col("evaluation_trial_complete"), F.col("names_")
    success = F.when(complete, F.abs(score - 1) <= 1e-6)
    content = F.array_join(F.transform(assistants, lambda m: F.when(_said(_at(m, "content")), _text(_at(m, "content"))).otherwise(F.lit(""))), "\n")
    output = F.when(_said(_at(v, "output")), _text(_at(v, "output"))).otherwise(F.lit(""))
    df = df.withColumns({"success": success, "text_": F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, content).otherwise(output)})

    lost = complete & ~F.col("success")
    wrote = F.transform(names, lambda n, i: F.when(n.isin(*writes), i))
    last_write = F.array_max(wrote)
    read_after = F.exists(F.transform(names, lambda n, i: n.isin(*reads) & (i > F.coalesce(last_write, F.lit(-1)))), lambda x: x)
    signatures = F.transform(calls, lambda c: F.struct(c["name"], c["arguments"]))
    failed_message = F.coalesce(F.exists(messages, lambda m: F.coalesce(_text(_at(m, "role")) == "tool", F.lit(False)) & _true(_at(m, "error"))), F.lit(False))
    any_turn = lambda f: F.coalesce(F.exists(turns, f), F.lit(False))
    is_ = lambda c, *names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    labels = {
        "infrastructure_error": ~complete & infra, "unresolved": ~complete & ~infra, "agent_generation_failure": is_("end_", "agent_error") | is_("failure_", "agent_error"),
        "tool_execution_error": is_("failure_", "tool_errors") | is_("end_", "tool_error", "too_many_errors") | F.coalesce(F.exists(calls, lambda c: c["error"]), F.lit(False)) | failed_message,
        "turn_or_time_limit": is_("end_", "max_steps", "timeout"), "length_or_context_limit": is_("end_", "context_window_exceeded", "length") | any_turn(lambda t: F.coalesce(_text(_at(t, "finish_reason")) == "length", F.lit(False))),
        "repetition_detected": F.col("text_").rlike(MARKS) | any_turn(lambda t: _said(_at(t, "generation_guard"))),
        "db_changed_on_failure": lost & (F.col("initial_db_hash") != F.col("final_db_hash")), "db_unchanged_on_failure": lost & (F.col("initial_db_hash") == F.col("final_db_hash")),
        "no_tool_calls_observed_on_failure": lost & (F.size(calls) == 0), "write_attempt_on_failure": lost & last_write.isNotNull(),
        "repeated_call_signature": F.size(signatures) != F.size(F.array_distinct(signatures)), "write_attempt_without_later_read": last_write.isNotNull() & ~F.coalesce(read_after, F.lit(False)),
    }
    named = F.array_compact(F.array(*(F.when(rollout & F.coalesce(test, F.lit(False)) & (calls.isNotNull() if name in ("repeated_call_signature", "no_tool_calls_observed_on_failure") else F.lit(True)), F.lit(name)) for name, test in labels.items())))
    category = F.when(infra | is_("end_", *INFRASTRUCTURE), "infrastructure_error").when(scorable, "officially_scored").when(limit, "budget_limit").when(known, "unscored_failure").otherwise("unknown_termination")
    count = lambda of: F.when(names.isNotNull(), F.size(F.filter(names, lambda n: n.isin(*of)))).cast("long")
    pick = lambda *paths: F.coalesce(*(_text(_at(x, p)) for x, p in paths))
    columns = {
        "record_kind": F.lit(kind), "task_id": pick((v, "task_id"), (identity, "task_id"), (sim, "task_id")), "trajectory_id": pick((identity, "trajectory_id"), (sim, "id")), "sample_group_uid": pick((identity, "sample_group_uid")),
        "trial": pick((v, "trial"), (identity, "trial"), (sim, "trial")), "seed": pick((v, "seed"), (identity, "seed"), (sim, "seed")), "global_step": pick((identity, "global_step"), (v, "step")), "source_dialog_id": pick((v, "metadata.source_dialog_id")),
        "termination_reason": F.col("end_"), "failure_category": F.col("failure_"), "score": F.when(rollout, score), "eligibility_category": category, "scored": F.col("scored"), "evaluation_trial_complete": complete, "success": F.col("success"), "labels": F.array_sort(named),
        "tool_evidence_source": F.col("tool_evidence_source"), "tool_names": names, "tool_call_count": F.when(names.isNotNull(), F.size(names)).cast("long"), "read_call_count": count(reads), "write_call_count": count(writes),
        "initial_db_hash": F.col("initial_db_hash"), "final_db_hash": F.col("final_db_hash"), "text_length": F.length("text_").cast("long"),
    }
    kept = [c for c in rows.columns if c not in columns and c != "problem"]
    return df.select(*kept, "problem", *(F.when(F.col("problem").isNull(), x).alias(name) for name, x in columns.items()))
