"""Audits of whole dialogues: receipts of tool calls, where identifiers come from, and rules on what is known before a write.

The state that a walk through a dialogue would carry is said with windows and joins. A
tool message answers the calls of the last message before it that isn't one, in order, so
receipts are paired by ordinals within such blocks. Where an identifier comes from is the
first event whose text has it. What is known of an entity at a call is the last receipt
about it before the call: an as-of join by a window over receipts and calls together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDING = ["event", "kind", "status", "detail"]


@dataclass(frozen=True)
class Entity:
    """What receipts tell of: objects with the id field, those of one tool if one is named, with all the fields of `needs`."""

    field: str
    tool: str | None = None
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """A check of calls of the named tools. `known` gives the id of each entity that the rule looks up, from the call's
    arguments and from what was looked up before it; `check` gets arguments and receipts, JSON texts and null where nothing
    is known, and returns structs of status and detail (map of texts), one for each finding."""

    kind: str
    tools: tuple[str, ...]
    known: dict[str, Callable[[Column, dict[str, Column]], Column]]
    check: Callable[[Column, dict[str, Column]], Column]


def field(document: Column, path: str) -> Column:
    """A scalar or part of a JSON text, as text; null where there is none."""
    return F.get_json_object(document, f"$.{path}")


def _is_object(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(document)).startswith("OBJECT"), F.lit(False))


def _truth(document: Column, name: str) -> Column:
    """Whether a key has a value other than null, false, zero or an empty one."""
    value = F.to_json(F.try_variant_get(F.try_parse_json(document), f"$.{name}", "variant"))
    return F.coalesce(~value.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def detail_of(**parts: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _said(test: Column, kind: str, status: str, event: str | Column = "event", /, **detail: Column) -> Column:
    """A finding where the test is true, else null."""
    at = F.col(event) if isinstance(event, str) else event
    found = detail_of(**detail) if detail else F.expr("CAST(map() AS map<string,string>)")
    return F.when(test, F.struct(at.alias("event"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), found.alias("detail")))


def _found(df: DataFrame, of: str, *said: Column) -> DataFrame:
    return df.select(of, F.explode_outer(F.array(*said)).alias("x")).filter("x IS NOT NULL").select(of, "x.*")  # outer: Spark would first filter by what is exploded


def _finding(df: DataFrame, of: str, kind: str, status: str, event: str | Column = "event", /, **detail: Column) -> DataFrame:
    return _found(df, of, _said(F.lit(True), kind, status, event, **detail))


def tool_calls(messages: DataFrame, key: str = "id") -> DataFrame:
    """(key, event, position, call_id, name, arguments, valid) of the assistants' calls. A call is valid if it has a name and its
    arguments are a JSON object."""
    calls = messages.filter("role = 'assistant'").select(key, "event", F.posexplode("tool_calls").alias("position", "x"))
    calls = calls.select(key, "event", "position", F.col("x.id").alias("call_id"), "x.name", "x.arguments")
    return calls.withColumn("valid", F.col("name").isNotNull() & _is_object(F.col("arguments")))


def answered_messages(messages: DataFrame, key: str = "id") -> DataFrame:
    """messages (key, event, role, content) with what is open: `block` (event, told_, asked: valid calls) is the last message up to this one that is no tool's, `before`
    the one before this, told_ the tool messages up to this one, and `last` whether the dialogue ends. Of a block's calls, the first
    (told_ - block's told_) are answered. One pass over a dialogue in order."""
    turn = Window.partitionBy(key).orderBy("event")
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = F.transform("tool_calls", lambda x, i: F.when(x["name"].isNotNull() & _is_object(x["arguments"]), F.struct(i.alias("position"), x["name"].alias("name"), x["id"].alias("call_id"))))
    asked = F.when(F.col("role") == "assistant", F.array_compact(placed))
    told = messages.withColumn("told_", F.count_if(F.col("role") == "tool").over(upto))
    here = F.when(F.col("role") != "tool", F.struct("event", "told_", F.coalesce(asked, F.array().cast("array<struct<position:int,name:string,call_id:string>>")).alias("asked")))
    told = told.withColumn("here_", here).withColumns(
        {"block": F.last("here_", ignorenulls=True).over(upto), "before": F.last("here_", ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1)), "last": F.lead(F.lit(1)).over(turn).isNull()}
    )
    return told.drop("here_", "tool_calls")


def _met(answered: DataFrame) -> DataFrame:
    """Answered messages with nth, call_ and status, which are null for others than tool messages."""
    tool, call = F.col("role") == "tool", F.col("call_")
    told = answered.withColumn("nth", F.when(tool, F.col("told_") - F.coalesce("block.told_", F.lit(0))))
    told = told.withColumn("call_", F.get("block.asked", (F.col("nth") - 1).cast("int")))
    named = lambda c: c.isNotNull() & (c != "")
    other = (named(F.col("name")) & (F.col("name") != call["name"])) | (named(call["call_id"]) & ~F.col("tool_call_id").eqNullSafe(call["call_id"]))
    return told.withColumn("status", F.when(tool, F.when(call.isNull(), "orphan").when(other, "mismatch").otherwise("paired")))


def receipts(answered: DataFrame, key: str = "id") -> DataFrame:
    """(key, event, content, block, nth, said_name, said_id, call_event, position, name, call_id, status) of the tool messages among answered messages: status is orphan,
    mismatch or paired. block is the last event before it that is no tool message, whose nth call it answers."""
    return _met(answered).filter("role = 'tool'").select(
        key, "event", F.coalesce("content", F.lit("")).alias("content"), F.col("block.event").alias("block"), "nth", F.col("name").alias("said_name"), F.col("tool_call_id").alias("said_id"),
        F.when(F.col("call_").isNotNull(), F.col("block.event")).alias("call_event"), "call_.position", "call_.name", "call_.call_id", "status",
    )


def receipt_findings(answered: DataFrame, calls: DataFrame, key: str = "id") -> DataFrame:
    """Findings on calls and answered messages as such: invalid arguments, repeated ids, orphans, mismatches, errors, missing and unfinished ones."""
    named = F.coalesce(F.col("valid") & (F.col("call_id") != ""), F.lit(False))
    again = calls.withColumn("named_", named).withColumn("k_", F.row_number().over(Window.partitionBy(key, "named_", "call_id").orderBy("event", "position")))
    failed = (F.col("status") == "paired") & _is_object(F.col("content")) & (_truth(F.col("content"), "error") | _truth(F.col("content"), "is_error"))
    got = lambda block: (F.col("told_") - F.col(f"{block}.told_")).cast("int")
    short = lambda block: got(block) < F.size(f"{block}.asked")
    names = lambda block: F.array_join(F.slice(F.col(f"{block}.asked.name"), got(block) + 1, F.size(f"{block}.asked")), ",")
    parts = [
        _found(
            again, key,
            _said(~F.col("valid"), "invalid_arguments", "contradiction", batch_position=F.col("position")),
            _said(F.col("named_") & (F.col("k_") > 1), "duplicate_tool_call_id", "contradiction", call_id=F.col("call_id")),
        ),
        _found(
            _met(answered), key,
            _said(F.col("status") == "orphan", "orphan_tool_receipt", "contradiction"),
            _said(F.col("status") == "mismatch", "tool_receipt_mismatch", "contradiction", expected=F.col("call_.name")),
            _said(failed, "tool_error_response", "review", tool=F.col("call_.name")),
            _said((F.col("role") != "tool") & short("before"), "missing_tool_receipt", "contradiction", pending=names("before")),
            _said(F.col("last") & short("block"), "unfinished_tool_calls", "contradiction", pending=names("block")),
        ),
    ]
    return reduce(DataFrame.union, parts)


def supervision_findings(messages: DataFrame, supervision: DataFrame, key: str = "id") -> DataFrame:
    """supervision (key, event): one finding for a dialogue in which an event is named twice, or is no assistant's message."""
    named = supervision.groupBy(key, "event").agg(F.count("*").alias("n_"))
    own = messages.filter("role = 'assistant'").select(key, "event", F.lit(True).alias("own_")).distinct()
    wrong = named.join(own, [key, "event"], "left").filter("n_ > 1 OR own_ IS NULL").select(key).distinct()
    return _finding(wrong, key, "invalid_supervision_indices", "contradiction", F.lit(0).cast("long"))


def provenance_findings(messages: DataFrame, calls: DataFrame, answered: DataFrame, writes: list[str], identifiers: list[str], key: str = "id") -> DataFrame:
    """Identifiers of writing calls that no user's text and no paired receipt before the call has. A value is looked for once in
    each text of its dialogue, however often it is used."""
    texts = messages.filter("role = 'user' AND content IS NOT NULL").select(key, "event", "content").union(answered.filter("status = 'paired'").select(key, "event", "content"))
    used = calls.filter(F.col("valid") & F.col("name").isin(writes)).select(key, "event", "position", "name", F.explode(F.array(*(F.struct(F.lit(i).alias("field"), field(F.col("arguments"), i).alias("value")) for i in identifiers))).alias("x"))
    used = used.select(key, "event", "position", "name", "x.field", "x.value").filter("value IS NOT NULL AND value NOT IN ('', 'false', '0')")
    asked = used.select(F.col(key).alias("of_"), "value").distinct()
    first = asked.join(texts, (F.col("of_") == F.col(key)) & F.contains("content", "value")).groupBy(F.col("of_").alias(key), "value").agg(F.min("event").alias("since_"))
    told = used.unionByName(first, allowMissingColumns=True).withColumn("since_", F.max("since_").over(Window.partitionBy(key, "value"))).filter("event IS NOT NULL")
    late = told.filter("since_ IS NULL OR since_ >= event")
    return _finding(late, key, "write_identifier_absent_from_prior_user_or_tool", "unknown", tool=F.col("name"), key=F.col("field"), value=F.col("value"), batch_position=F.col("position"))


def known_before(asked: DataFrame, told: DataFrame, key: str, event: str, on: str, value: str) -> DataFrame:
    """asked with `value` and `value`_event: told's last value with the same key and `on` at an earlier event, null if there is none."""
    columns = asked.columns
    late = asked.withColumns({value: F.lit(None).cast("string"), "from_": F.lit(None).cast("long"), "told_": F.lit(1)})
    early = told.select(key, event, on, value, F.col(event).cast("long").alias("from_"), F.lit(0).alias("told_"))
    before = Window.partitionBy(key, on).orderBy(event, F.desc("told_")).rowsBetween(Window.unboundedPreceding, -1)  # at one event, calls come first
    both = late.unionByName(early, allowMissingColumns=True)
    seen = both.withColumn("x_", F.last(F.when(F.col("told_") == 0, F.struct(value, "from_")), ignorenulls=True).over(before)).filter("told_ = 1")
    return seen.select(*columns, F.when(F.col(on).isNotNull(), F.col(f"x_.{value}")).alias(value), F.when(F.col(on).isNotNull(), F.col("x_.from_")).alias(f"{value}_event"))


def rule_findings(calls: DataFrame, answered: DataFrame, entities: dict[str, Entity], rules: list[Rule], key: str = "id") -> DataFrame:
    """What the rules find on valid calls, with the events of the receipts they looked at."""
    paired = answered.filter((F.col("status") == "paired") & _is_object(F.col("content")) & ~_truth(F.col("content"), "error"))
    parts = []
    for rule in rules:
        at = calls.filter(F.col("valid") & F.col("name").isin(*rule.tools)).select(key, "event", "position", "name", "arguments")
        seen: dict[str, Column] = {}
        for name, chosen in rule.known.items():
            entity = entities[name]
            about = paired if entity.tool is None else paired.filter((F.col("name") == entity.tool) & ~_truth(F.col("content"), "is_error"))
            for need in entity.needs:
                about = about.filter(F.try_variant_get(F.try_parse_json("content"), f"$.{need}", "variant").isNotNull())
            about = about.filter(_truth(F.col("content"), entity.field)).select(key, "event", field(F.col("content"), entity.field).alias("on_"), F.col("content").alias(name))
            at = known_before(at.withColumn("on_", chosen(F.col("arguments"), seen)), about, key, "event", "on_", name).drop("on_")
            seen[name] = F.col(name)
        found = at.withColumn("f_", F.explode(rule.check(F.col("arguments"), seen)))
        events = F.map_concat("f_.detail", detail_of(tool=F.col("name"), **{f"{n}_event": F.col(f"{n}_event") for n in rule.known}))
        parts.append(found.select(key, "event", F.lit(rule.kind).alias("kind"), F.col("f_.status").alias("status"), events.alias("detail")))
    return reduce(DataFrame.union, parts)


def execution_findings(calls: DataFrame, answered: DataFrame, executions: DataFrame, key: str = "id") -> DataFrame:
    """executions (key, place, name, arguments, response_sha256), what was stored of a dialogue: one finding where it isn't, in order, what the valid calls and their
    paired receipts say. Dialogues without stored executions aren't compared."""
    from tidelane.functions.documents import canonical_text

    got = answered.filter("status = 'paired'").select(F.col(key).alias("of_"), "call_event", F.col("position").alias("place_"), F.sha2(F.col("content").cast("binary"), 256).alias("sha_"))
    said = calls.filter("valid").join(got, (F.col(key) == F.col("of_")) & (F.col("event") == F.col("call_event")) & (F.col("position") == F.col("place_")), "left")
    said = said.select(key, F.struct("event", "position").alias("at"), F.sha2(F.to_json(F.struct("name", canonical_text(F.col("arguments")).alias("a"), "sha_")), 256).alias("hash"))
    stored = executions.select(key, F.struct(F.col("place").cast("long").alias("event"), F.lit(0).alias("position")).alias("at"), F.sha2(F.to_json(F.struct("name", canonical_text(F.col("arguments")).alias("a"), F.col("response_sha256").alias("sha_"))), 256).alias("hash"))
    ordered = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias(name))
    wrong = ordered(stored, "want_").join(ordered(said, "said_"), key, "left").filter("said_ IS NULL OR said_ != want_")
    return _finding(wrong, key, "stored_execution_receipt_mismatch", "contradiction", F.lit(0).cast("long"))


def dialogue_summary(messages: DataFrame, calls: DataFrame, supervision: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A row for each dialogue: assistants' messages, valid calls, messages with several calls, the first tool and supervised calls."""
    said = messages.groupBy(key).agg(F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.count_if((F.col("role") == "assistant") & (F.size(F.coalesce("tool_calls", F.array())) > 1)).alias("multicall_batches"))
    if supervision is None:
        marked = calls.withColumn("marked_", F.lit(False))
    else:
        marked = calls.join(supervision.select(key, "event").distinct().withColumn("marked_", F.lit(True)), [key, "event"], "left")
    called = marked.filter("valid").groupBy(key).agg(F.count("*").alias("tool_calls"), F.min(F.struct("event", "position", "name"))["name"].alias("first_tool"), F.count_if("marked_").alias("supervised_calls"))
    return said.join(called, key, "left").fillna(0, ["tool_calls", "supervised_calls"])


def audit_dialogues(
    messages: DataFrame, writes: list[str], identifiers: list[str], entities: dict[str, Entity] | None = None, rules: list[Rule] | None = None, supervision: DataFrame | None = None, executions: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """(key, event, kind, status, detail) of everything found in dialogues; status is contradiction, review or unknown.

    messages: key, event (long, unique in a dialogue, in order), role (user, assistant, tool or another), content, name and
    tool_call_id (of tool messages), and tool_calls (array of id, name, arguments: JSON text; null: none). Other columns don't
    matter. Null content is empty; a null key is no dialogue and finds nothing. Dialogues without findings give no rows.
    Repeated rows count as further messages. Work is by dialogue, a dialogue's texts against its written identifiers,
    so a dialogue is taken to be as long as a dialogue is. Nothing but messages is shuffled, by dialogue: what is
    told by two tables is joined by the dialogue alone, or by windows over both.
    """
    messages = messages.filter(F.col(key).isNotNull()).select(key, "event", "role", "content", "name", "tool_call_id", "tool_calls")
    calls = tool_calls(messages, key)
    walked = answered_messages(messages, key)
    answered = receipts(walked, key)
    parts = [receipt_findings(walked, calls, key), provenance_findings(messages, calls, answered, writes, identifiers, key)]
    if rules:
        parts.append(rule_findings(calls, answered, entities or {}, rules, key))
    if supervision is not None:
        parts.append(supervision_findings(messages, supervision, key))
    if executions is not None:
        parts.append(execution_findings(calls, answered, executions, key))
    return reduce(DataFrame.union, parts)


# Rules on bookings of flights.

ENTITIES = {"user": Entity("user_id", "get_user_details"), "reservation": Entity("reservation_id", None, ("cabin",))}
WRITES = ["book_reservation", "cancel_reservation", "send_certificate", "update_reservation_baggages", "update_reservation_flights", "update_reservation_passengers"]
IDENTIFIERS = ["user_id", "reservation_id", "payment_id"]
_LEGS = "flights array<struct<flight_number string, date string>>"


def finding_if(test: Column, status: Column, detail: Column) -> Column:
    return F.when(test, F.array(F.struct(status.alias("status"), detail.alias("detail"))))


def _cabin_keeps_flights(said: Column, known: dict[str, Column]) -> Column:
    before, legs = known["reservation"], lambda d: F.coalesce(F.from_json(d, _LEGS)["flights"], F.array())
    wanted = field(said, "cabin")
    basic = F.lit("basic_economy")
    return finding_if((field(before, "cabin") == basic) & (legs(before) != legs(said)), F.when(wanted == basic, "contradiction").otherwise("review"), detail_of(requested_cabin=wanted, prior_cabin=field(before, "cabin")))


def _passengers_stay(said: Column, known: dict[str, Column]) -> Column:
    n = lambda d: F.coalesce(F.json_array_length(field(d, "passengers")), F.lit(0))
    asked = field(said, "passengers").isNotNull() & known["reservation"].isNotNull()
    return finding_if(asked & (n(said) != n(known["reservation"])), F.lit("contradiction"), detail_of(before=n(known["reservation"]), after=n(said)))


def _bags_stay(said: Column, known: dict[str, Column]) -> Column:
    n = lambda d: F.from_json(d, "total_baggages bigint")["total_baggages"]
    return finding_if(n(said) < n(known["reservation"]), F.lit("contradiction"), detail_of(before=n(known["reservation"]), after=n(said)))


def _own_payment(several: bool) -> Callable[[Column, dict[str, Column]], Column]:
    def check(said: Column, known: dict[str, Column]) -> Column:
        one = F.array(field(said, "payment_id"))
        ids = F.transform(F.coalesce(F.from_json(said, "payment_methods array<struct<payment_id string>>")["payment_methods"], F.array()), lambda p: p["payment_id"]) if several else one
        owned = F.coalesce(F.json_object_keys(field(known["user"], "payment_methods")), F.array())
        unsure = lambda p: known["user"].isNull() | p.isNull() | (p == "")
        status = lambda p: F.when(unsure(p), "unknown").when(~F.array_contains(owned, p), "contradiction")
        return F.filter(F.transform(ids, lambda p: F.struct(status(p).alias("status"), detail_of(payment_id=p).alias("detail"))), lambda x: x["status"].isNotNull())

    return check


RULES = [
    Rule("basic_economy_flight_change", ("update_reservation_flights",), {"reservation": lambda a, _: field(a, "reservation_id")}, _cabin_keeps_flights),
    Rule("passenger_count_change", ("update_reservation_passengers",), {"reservation": lambda a, _: field(a, "reservation_id")}, _passengers_stay),
    Rule("baggage_removal", ("update_reservation_baggages",), {"reservation": lambda a, _: field(a, "reservation_id")}, _bags_stay),
    Rule("payment_profile_membership", ("book_reservation",), {"user": lambda a, _: field(a, "user_id")}, _own_payment(True)),
    Rule("payment_profile_membership", ("update_reservation_flights",), {"reservation": lambda a, _: field(a, "reservation_id"), "user": lambda _, k: field(k["reservation"], "user_id")}, _own_payment(False)),
]
