"""Dialogue audits against a walk that carries its state along."""

import hashlib
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tidelane.operators import dialogue_audit as A

MESSAGES = "id string, event long, role string, content string, name string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"


def walk(rows):
    out, pending, texts, ids = [], [], [], set()
    users, bookings = {}, {}
    for m in rows:
        event, role, content = m[1], m[2], m[3] or ""
        if role != "tool" and pending:
            out.append((event, "missing_tool_receipt", "contradiction"))
            pending = []
        if role == "user":
            texts.append(content)
        elif role == "tool":
            if not pending:
                out.append((event, "orphan_tool_receipt", "contradiction"))
                continue
            call = pending.pop(0)
            if m[4] and m[4] != call[1] or call[0] and m[5] != call[0]:
                out.append((event, "tool_receipt_mismatch", "contradiction"))
                continue
            texts.append(content)
            try:
                said = json.loads(content)
            except ValueError:
                continue
            if not isinstance(said, dict):
                continue
            if said.get("error") or said.get("is_error"):
                out.append((event, "tool_error_response", "review"))
            elif call[1] == "get_user_details" and said.get("user_id"):
                users[said["user_id"]] = said
            if not said.get("error") and said.get("reservation_id") and "cabin" in said:
                bookings[said["reservation_id"]] = said
        elif role == "assistant":
            for call in m[6] or []:
                try:
                    args = json.loads(call[2])
                    assert isinstance(args, dict) and call[1]
                except (ValueError, TypeError, AssertionError):
                    out.append((event, "invalid_arguments", "contradiction"))
                    continue
                if call[0] and call[0] in ids:
                    out.append((event, "duplicate_tool_call_id", "contradiction"))
                ids.add(call[0])
                pending.append(call)
                if call[1] not in A.WRITES:
                    continue
                for key in A.IDENTIFIERS:
                    if args.get(key) and not any(str(args[key]) in t for t in texts):
                        out.append((event, "write_identifier_absent_from_prior_user_or_tool", "unknown"))
                prior = bookings.get(args.get("reservation_id"), {})
                legs = lambda d: [(f.get("flight_number"), f.get("date")) for f in d.get("flights", [])]
                if call[1] == "update_reservation_flights" and prior.get("cabin") == "basic_economy" and legs(prior) != legs(args):
                    out.append((event, "basic_economy_flight_change", "contradiction" if args.get("cabin") == "basic_economy" else "review"))
                if call[1] == "update_reservation_passengers" and prior and "passengers" in args and len(args["passengers"]) != len(prior.get("passengers", [])):
                    out.append((event, "passenger_count_change", "contradiction"))
                if call[1] == "update_reservation_baggages" and prior and args.get("total_baggages", 9) < prior.get("total_baggages", 0):
                    out.append((event, "baggage_removal", "contradiction"))
                if call[1] in ("book_reservation", "update_reservation_flights"):
                    book = call[1] == "book_reservation"
                    user = users.get(args.get("user_id") if book else prior.get("user_id"), {})
                    for p in [x.get("payment_id") for x in args.get("payment_methods", [])] if book else [args.get("payment_id")]:
                        if not user or not p or p not in user["payment_methods"]:
                            out.append((event, "payment_profile_membership", "unknown" if not user or not p else "contradiction"))
    if pending:
        out.append((rows[-1][1], "unfinished_tool_calls", "contradiction"))
    return out


def dialogue(rng, d):
    rows, last = [], []
    uid, rid, pid = (lambda: f"u{rng.randint(1, 2)}"), (lambda: f"R{rng.randint(1, 3)}"), (lambda: f"p{rng.randint(1, 3)}")
    flights = lambda: [{"flight_number": f"F{rng.randint(1, 2)}", "date": "d", "price": rng.random()} for _ in range(rng.randint(0, 2))]
    for event in range(rng.randint(0, 16)):
        role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "tool", "system"])
        if role == "tool":
            call = last.pop(0) if last and rng.random() < 0.9 else (None, "look", "{}")
            booking = {"reservation_id": rid(), "cabin": rng.choice(["basic_economy", "basic_economy", None]), "flights": flights(), "passengers": [1] * rng.randint(0, 2), "total_baggages": rng.randint(0, 3), "user_id": uid()}
            body = rng.choice([{"user_id": uid(), "payment_methods": {pid(): {}, pid(): {}}}, booking, booking, booking, {"error": rng.choice(["no", "", None, 0, False])}, {"is_error": True, "user_id": uid(), "payment_methods": {}}, [1], "text"])
            rows.append((f"d{d}", event, role, json.dumps(body) if rng.random() < 0.95 else None, rng.choice([call[1], call[1], None, "other"]), call[0] if rng.random() < 0.9 else "c99", None))
        elif role == "assistant":
            calls = []
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                name = rng.choice([*A.WRITES, "update_reservation_flights", "update_reservation_flights", "get_user_details", "get_user_details", "get_reservation_details"])
                args = {"user_id": uid(), "reservation_id": rid(), "payment_id": pid(), "cabin": rng.choice(["basic_economy", "economy"]), "flights": flights(), "passengers": [1] * rng.randint(0, 2), "total_baggages": rng.randint(0, 3), "payment_methods": [{"payment_id": pid()}] * rng.randint(0, 2)}
                args = {k: v for k, v in args.items() if rng.random() < 0.85}
                calls.append((rng.choice([None, f"c{rng.randint(1, 30)}"]), name, json.dumps(args) if rng.random() < 0.93 else rng.choice(["[1]", "{", None])))
            last = [c for c in calls if c[2] and c[2][:2] not in ("[1", "{") or c[2] == "{}"]
            rows.append((f"d{d}", event, role, "said", None, None, calls or None))
        else:
            rows.append((f"d{d}", event, role, rng.choice([f"I am {uid()} and pay by {pid()}", f"change {rid()}", None]), None, None, None))
    return rows


def test_findings_are_those_of_a_walk(spark):
    rng = random.Random(11)
    rows = [m for d in range(250) for m in dialogue(rng, d)]
    frame = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("x") for c in ("kind", "status", "position", "block", "nth")})
    got = Counter((r.id, r.event, r.kind, r.status) for r in A.audit_dialogues(frame, A.WRITES, A.IDENTIFIERS, A.ENTITIES, A.RULES).collect())
    want = Counter()
    for d in {m[0] for m in rows}:
        want.update((d, *x) for x in walk([m for m in rows if m[0] == d]))
    assert got - want == Counter() and want - got == Counter()
    assert {k for _, _, k, _ in want} >= {r.kind for r in A.RULES} | {"tool_error_response", "unfinished_tool_calls", "missing_tool_receipt", "orphan_tool_receipt", "tool_receipt_mismatch", "invalid_arguments", "duplicate_tool_call_id"}
    assert A.audit_dialogues(frame.limit(0), A.WRITES, A.IDENTIFIERS, A.ENTITIES, A.RULES).count() == 0


def test_supervision_executions_and_summary(spark):
    call = ("c1", "look", '{"b": 1, "a": 2}')
    rows = [("x", 0, "user", "hi", None, None, None), ("x", 1, "assistant", None, None, None, [call]), ("x", 2, "tool", "seen", "look", "c1", None), (None, 0, "tool", "stray", None, None, None), ("y", 0, "assistant", "", None, None, [call, call])]
    m = spark.createDataFrame(rows, MESSAGES)
    sha = hashlib.sha256(b"seen").hexdigest()
    kinds = lambda **how: sorted((r.id, r.event, r.kind) for r in A.audit_dialogues(m.filter("id = 'x'"), [], A.IDENTIFIERS, **how).collect())
    marked = lambda *events: spark.createDataFrame([("x", e) for e in events], "id string, event long")
    assert kinds() == kinds(supervision=marked(1)) == []
    assert kinds(supervision=marked(1, 1)) == kinds(supervision=marked(0)) == kinds(supervision=marked(7)) == [("x", 0, "invalid_supervision_indices")]
    stored = lambda text, h: spark.createDataFrame([("x", 0, "look", text, h)], "id string, place long, name string, arguments string, response_sha256 string")
    assert kinds(executions=stored('{"a": 2, "b": 1}', sha)) == []
    assert kinds(executions=stored('{"a": 2, "b": 1}', "0")) == kinds(executions=stored("{}", sha)) == [("x", 0, "stored_execution_receipt_mismatch")]
    calls = A.tool_calls(m)
    summary = {r.id: (r.assistant_messages, r.multicall_batches, r.tool_calls, r.first_tool, r.supervised_calls) for r in A.dialogue_summary(m.filter("id IS NOT NULL"), calls, marked(1)).collect()}
    assert summary == {"x": (1, 0, 1, "look", 1), "y": (1, 1, 2, "look", 0)}
    assert [(r.id, r.event, r.kind) for r in A.audit_dialogues(m, [], A.IDENTIFIERS).collect() if r.kind == "unfinished_tool_calls"] == [("y", 0, "unfinished_tool_calls")]


def test_messages_are_shuffled_once(spark, sf_dir):
    """What is shuffled are line items to number them, alike wherever messages are used and so done once, and the values that are looked for."""
    from tidelane.plans import audits

    plan = audits.QUERIES["dialogue_findings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("Exchange ")[1].split(", ENSURE")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "l_orderkey" not in s]) <= 2


def test_calls_stay_open_until_the_next_message(spark):
    ask = ("x", 1, "assistant", None, None, None, [("c1", "look", "{}"), (None, "see", "{}")])
    m = spark.createDataFrame([("x", 0, "tool", "early", "look", "c1", None), ask, ("x", 2, "tool", "a", "look", "c1", None), ("x", 3, None, "no role", None, None, None), ("x", 4, "tool", "b", "other", None, None), ("x", 5, "tool", "c", None, None, None), ("x", 6, *ask[2:]), ("x", 7, "system", "", None, None, None)], MESSAGES)
    got = sorted((r.event, r.kind, r.detail) for r in A.audit_dialogues(m, [], A.IDENTIFIERS).collect())
    assert got == [(0, "orphan_tool_receipt", {}), (4, "tool_receipt_mismatch", {"expected": "see"}), (5, "orphan_tool_receipt", {}), (6, "duplicate_tool_call_id", {"call_id": "c1"}), (7, "missing_tool_receipt", {"pending": "look,see"})]
