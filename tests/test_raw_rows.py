"""Rows of unlike shapes against a plain reading of them."""

import json
import math
import random
import re

import pytest

from tidelane.operators import raw_rows as W

READS, WRITES = ["look", "list"], ["change", "cancel"]
INFRA = ("infrastructure_error", "unexpected_error", "simulator_error")
LIMITS = ("max_steps", "timeout", "context_window_exceeded", "length")
FALLBACK = (*LIMITS, "too_many_errors", "agent_error", "user_error")


def opened(x, name):
    if x in (None, ""):
        return {}
    try:
        x = json.loads(x) if isinstance(x, str) else x
    except ValueError:
        x = None
    if not isinstance(x, dict):
        raise ValueError(f"{name} must be an object")
    return x


def first(*xs):
    return next((x for x in xs if x is not None), None)


def called(c):
    f = c["function"] if isinstance(c.get("function"), dict) else c
    name = f.get("name") or c.get("tool_name")
    if not name:
        raise ValueError("call without a name")
    a = f.get("arguments")
    if isinstance(a, str):
        try:
            a = json.loads(a)
        except ValueError:
            a = {"invalid_json_arguments": a}
    return name, json.dumps(a, sort_keys=True), c.get("error") is True


def plain(row):
    if row.get("analysis_version"):
        raise ValueError("normalized already")
    sim = opened(row.get("simulation"), "simulation")
    info = opened(sim.get("info"), "simulation.info")
    facts = opened(first(row.get("trajectory_facts_json"), info.get("trajectory_facts")), "trajectory_facts")
    term, ident = opened(facts.get("terminal"), "terminal"), opened(facts.get("identity"), "identity")
    paid = opened(sim.get("reward_info"), "simulation.reward_info")
    holder, turns = sim or row, facts.get("turns")
    messages = holder.get("messages")
    if turns is not None and not isinstance(turns, list):
        raise ValueError("turns must be a list")
    if turns is not None and all(isinstance(t.get("tool_calls"), list) for t in turns):
        raw, source = [c for t in turns for c in t["tool_calls"]], "trajectory_facts"
    elif messages is not None:
        if not isinstance(messages, list):
            raise ValueError("messages must be a list")
        raw, source = [c for m in messages if m["role"] == "assistant" for c in m.get("tool_calls") or []], "simulation.messages" if sim else "messages"
    else:
        by_hand = opened(row.get("trajectory_json"), "trajectory_json").get("tool_calls")
        raw, source = (by_hand, "trajectory_json") if isinstance(by_hand, list) else (None, "unavailable")
    calls = None if raw is None else [called(c) for c in raw]
    messages = messages or []
    text = "\n".join(m.get("content") or "" for m in messages if m["role"] == "assistant") if messages else row.get("output") or ""
    end = first(row.get("termination_reason"), sim.get("termination_reason"), term.get("termination_reason"))
    why = first(row.get("failure_category"), term.get("failure_category"))
    start, stop = first(row.get("initial_db_hash"), info.get("initial_db_hash")), first(row.get("db_hash"), info.get("final_db_hash"), term.get("db_hash"))
    score = first(row.get("score"), row.get("reward"), paid.get("reward"), term.get("reward"))
    if isinstance(score, bool) or score is not None and not math.isfinite(float(score)):
        raise ValueError("reward must be a finite number")
    if end not in ("agent_stop", "user_stop") and score not in (None, 0):
        raise ValueError("unscored run has an outcome")
    infra = end in INFRA or why in ("infrastructure", "simulator_error") or bool(row.get("error"))
    scored = score is not None and end in ("agent_stop", "user_stop") and not infra and row.get("scored") is not False
    complete = score is not None and not infra and (scored or end in FALLBACK)
    success = abs(score - 1) <= 1e-6 if complete else None
    labels = set() if complete else {"infrastructure_error" if infra else "unresolved"}
    add = lambda test, name: labels.add(name) if test else None
    names = None if calls is None else [c[0] for c in calls]
    add("agent_error" in (end, why), "agent_generation_failure")
    add(why == "tool_errors" or end in ("tool_error", "too_many_errors") or any(c[2] for c in calls or []) or any(m["role"] == "tool" and m.get("error") is True for m in messages), "tool_execution_error")
    add(end in ("max_steps", "timeout"), "turn_or_time_limit")
    add(end in ("context_window_exceeded", "length") or any(t.get("finish_reason") == "length" for t in turns or []), "length_or_context_limit")
    add(re.search(r"(?:✅\s*){20,}", text) or any(t.get("generation_guard") for t in turns or []), "repetition_detected")
    if complete and not success:
        add(start and stop, "db_changed_on_failure" if start != stop else "db_unchanged_on_failure")
        add(calls == [], "no_tool_calls_observed_on_failure")
        add(set(names or []) & set(WRITES), "write_attempt_on_failure")
    if calls is not None:
        add(len({c[:2] for c in calls}) != len(calls), "repeated_call_signature")
        at = max((i for i, n in enumerate(names) if n in WRITES), default=None)
        add(at is not None and not set(names[at + 1 :]) & set(READS), "write_attempt_without_later_read")
    return {"task_id": first(row.get("task_id"), ident.get("task_id"), sim.get("task_id")), "score": score, "scored": scored, "evaluation_trial_complete": complete, "success": success, "termination_reason": end, "failure_category": why, "labels": sorted(labels), "tool_names": names, "tool_evidence_source": source, "text_length": len(text), "initial_db_hash": start, "final_db_hash": stop}


def some(rng):
    pick = lambda **of: {k: x for k, v in of.items() if (x := rng.choice(v)) is not ...}
    call = lambda: rng.choice([{"function": {"name": rng.choice([*READS, *WRITES]), "arguments": rng.choice(['{"b": 1, "a": 2}', "not json", {"a": 2, "b": 1}])}}, {"name": "look", "error": rng.choice([True, False])}, {"tool_name": "change"}, {"name": ""} if rng.random() < 0.1 else {"name": "list"}])
    calls = lambda: [call() for _ in range(rng.randint(0, 3))]
    message = lambda: {"role": rng.choice(["assistant", "user", "tool"]), **pick(content=["hé", None, "✅ " * 25, ...], tool_calls=[calls(), None, ...], error=[True, ..., ..., ...])}
    messages = lambda: [message() for _ in range(rng.randint(0, 4))]
    ends = ["agent_stop", "user_stop", "agent_stop", *FALLBACK, *INFRA, "odd", None, ...]
    wrap = lambda x: rng.choice([x, json.dumps(x)])
    common = {"termination_reason": ends, "task_id": ["t", ..., None]}
    facts = lambda: wrap(pick(turns=[[pick(tool_calls=[calls(), calls(), ...], finish_reason=["length", "stop", ...], generation_guard=[..., ..., "x"]) for _ in range(2)], ..., ..., "no list" if rng.random() < 0.2 else ...], terminal=[wrap(pick(reward=[0, ...], termination_reason=ends, failure_category=["agent_error", ...])), ...], identity=[{"task_id": "i"}, ...]))
    sim = lambda: pick(info=[wrap(pick(trajectory_facts=[facts(), ...], initial_db_hash=["h", ...], final_db_hash=["h", "g", ...])), ...], messages=[messages(), ..., {} if rng.random() < 0.2 else ...], reward_info=[wrap({"reward": rng.choice([0, 1, 0.5, None])}), ...], **common)
    return pick(simulation=[wrap(sim()), ..., ..., "", "[1]" if rng.random() < 0.1 else ...], trajectory_facts_json=[facts(), ..., ...], messages=[messages(), ...], score=[0, 0.0, 1, ..., ..., True if rng.random() < 0.1 else ...], reward=[..., 0], failure_category=["tool_errors", "simulator_error", ..., ..., ...], scored=[False, True, ..., ...], error=["boom", "", ..., ..., ...], db_hash=["h", ...], output=["text", ...], trajectory_json=[wrap({"tool_calls": calls()}), ..., "{"], analysis_version=[..., ..., ..., ..., ..., ..., "v2"], **common)


def test_rows_are_those_of_a_plain_reading(spark):
    rng = random.Random(7)
    rows = [some(rng) for _ in range(400)]
    frame = spark.createDataFrame([(k, json.dumps(r), "x") for k, r in enumerate(rows)], "k long, raw string, labels string")
    got = {r.k: r for r in W.normalized_rows(frame, "raw", READS, WRITES).collect()}
    problems = set()
    for k, row in enumerate(rows):
        try:
            want, problem = plain(row), None
        except ValueError as e:
            want, problem = {}, str(e)
        problems.add(problem)
        assert got[k].problem == problem, (row, got[k])
        assert {c: got[k][c] for c in want} == want, row
    assert len(problems) >= 8 and sum(got[k].problem is None for k in got) > 100


def test_other_rows(spark):
    frame = spark.createDataFrame([("[1]",), ("{",), (None,), ('{"messages": [{"role": "assistant", "content": "ab"}], "score": 1}',)], "raw string")
    got = W.normalized_rows(frame, "raw", READS, WRITES, "demonstration").collect()
    assert [r.problem for r in got] == ["not an object"] * 3 + [None]
    assert (got[3].score, got[3].success, got[3].labels, got[3].text_length, got[3].scored) == (None, None, [], 2, False)
    assert W.normalized_rows(frame.limit(0), "raw", READS, WRITES).count() == 0
    with pytest.raises(ValueError, match="no kind"):
        W.normalized_rows(frame, "raw", READS, WRITES, "other")


def test_parts_are_taken_from_maps(spark, sf_dir):
    """A VARIANT path to a part that isn't there throws in each row."""
    from tidelane.plans import checks

    plan = checks.QUERIES["normalized_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" in plan and ", $." not in plan
