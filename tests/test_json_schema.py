"""Compiled schemas against a plain validator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelane.functions.json_schema import call_findings, schema_findings

SCHEMA = {
    "$defs": {"leg": {"type": "object", "properties": {"no": {"type": "string", "pattern": "^F[0-9]+$"}, "day": {"type": "integer", "minimum": 1, "maximum": 31}}, "required": ["no"], "additionalProperties": False}},
    "type": "object", "title": "booking", "required": ["id", "cabin"],
    "properties": {
        "id": {"type": ["string", "null"], "minLength": 2, "maxLength": 4}, "cabin": {"enum": ["basic", "first", 1, None, [1]]}, "legs": {"type": "array", "items": {"$ref": "#/$defs/leg"}, "minItems": 1, "maxItems": 2},
        "pay": {"anyOf": [{"type": "number", "exclusiveMinimum": 0}, {"const": "free"}]}, "tags": {"type": "object", "additionalProperties": {"type": "boolean"}},
    },
}


def kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def plain(s, v, path, root):
    if s is True:
        return []
    if "$ref" in s:
        return plain(root["$defs"][s["$ref"].split("/")[-1]], v, path, root)
    out, k = [], kind(v)
    fits = lambda t: k == t or t == "integer" and k == "number" and v == int(v)
    if "type" in s and not any(map(fits, [s["type"]] if isinstance(s["type"], str) else s["type"])):
        out.append((path, "type"))
    same = lambda a, b: kind(a) == kind(b) and a == b
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        out.append((path, "enum"))
    if "const" in s and not same(v, s["const"]):
        out.append((path, "const"))
    for word, bad in (("minimum", lambda x: v < x), ("maximum", lambda x: v > x), ("exclusiveMinimum", lambda x: v <= x)):
        if word in s and k == "number" and bad(s[word]):
            out.append((path, word))
    for word, bad in (("minLength", lambda x: len(v) < x), ("maxLength", lambda x: len(v) > x), ("pattern", lambda x: not re.search(x, v))):
        if word in s and k == "string" and bad(s[word]):
            out.append((path, word))
    for word, bad in (("minItems", lambda x: len(v) < x), ("maxItems", lambda x: len(v) > x)):
        if word in s and k == "array" and bad(s[word]):
            out.append((path, word))
    if k == "object":
        out += [(path, f"required: {n}") for n in s.get("required", []) if n not in v]
        for n, x in v.items():
            if n in s.get("properties", {}):
                out += plain(s["properties"][n], x, f"{path}/{n}", root)
            elif s.get("additionalProperties") is False:
                out.append((path, f"additional: {n}"))
            elif "additionalProperties" in s:
                out += plain(s["additionalProperties"], x, f"{path}/{n}", root)
    if k == "array" and "items" in s:
        out += [y for i, x in enumerate(v) for y in plain(s["items"], x, f"{path}/{i}", root)]
    if "anyOf" in s and all(plain(x, v, path, root) for x in s["anyOf"]):
        out.append((path, "anyOf"))
    return out


def test_findings_are_those_of_a_plain_validator(spark):
    rng = random.Random(1)
    odd = lambda: rng.choice([1, 1.0, 2.5, -3, True, None, "", "ab", "abcde", "F12", "basic", "free", [], [1], {}, {"a": True}, {"a": 1, "b c": False}])
    leg = lambda: {k: v for k, v in (("no", rng.choice(["F1", "G", odd()])), ("day", rng.choice([1, 31, 40, 2.0, odd()])), ("more", 1)) if rng.random() < 0.6}
    docs = [{k: v for k, v in (("id", rng.choice(["abc", odd()])), ("cabin", rng.choice(["first", odd()])), ("legs", rng.choice([[leg() for _ in range(rng.randint(0, 3))], odd()])), ("pay", odd()), ("tags", odd()), ("x", odd())) if rng.random() < 0.8} for _ in range(300)]
    texts = [json.dumps(d) for d in [*docs, *(odd() for _ in range(30))]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", schema_findings(F.col("t"), SCHEMA).alias("f")).collect()
    for r in got:
        assert sorted((x.path, x.finding) for x in r.f) == sorted(plain(SCHEMA, json.loads(r.t), "", SCHEMA)), r.t
    assert sum(not r.f for r in got) > 0


def test_bad_texts_tools_and_schemas(spark):
    df = spark.createDataFrame([("look", '{"n": 1}'), ("look", "{"), ("look", None), ("else", "{}"), (None, "{}")], "name string, a string")
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}
    got = [[x.finding for x in r.f] for r in df.select(call_findings(F.col("name"), F.col("a"), {"look": schema}).alias("f")).collect()]
    assert got == [[], ["not JSON"], ["not JSON"], ["unknown tool"], ["unknown tool"]]
    assert df.select(schema_findings(F.lit(None).cast("string"), schema).alias("f")).first().f is None
    for bad, said in (({"oneOf": []}, "isn't supported"), ({"type": "date"}, "no type"), ({"properties": {"a": {"$ref": "#"}}}, "refers to itself"), ({"$ref": "other.json"}, "own definitions")):
        with pytest.raises(ValueError, match=said):
            schema_findings(F.col("a"), bad)
    assert [x.finding for x in df.limit(1).select(schema_findings(F.col("a"), False).alias("f")).first().f] == ["not allowed"]


def test_a_text_is_read_and_parsed_once(spark, sf_dir):
    from tidelane.plans import checks

    plan = checks.QUERIES["schema_findings"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string({") <= 2
