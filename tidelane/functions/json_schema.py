"""JSON Schema as column expressions: a schema is compiled once, on the driver, to one expression over VARIANT values.

Understood: type (one or several), properties, required, additionalProperties (true, false or a schema), items, enum, const, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, minItems, maxItems, anyOf, allOf and $ref to the schema's own
definitions; titles, descriptions, defaults and examples say nothing. Any other keyword is an error, so that none is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds that schema_of_variant begins with, by JSON Schema's type.
KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}
SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format"}
FINDING = "array<struct<path:string,finding:string>>"
#: How deep a schema may refer to itself.
MOST_DEPTH = 12


def bound(value: Column, said: Callable[[Column], Column]) -> Column:
    """said(value), with value computed once a row however often said uses it: as a lambda's variable and not as its expression."""
    return F.get(F.transform(F.array(value), said), F.lit(0))


def _found(test: Column, path: Column, said: Column | str) -> Column:
    text = F.lit(said) if isinstance(said, str) else said
    return F.when(test, F.array(F.struct(path.alias("path"), text.alias("finding")))).otherwise(F.array().cast(FINDING))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(FINDING)


def _is(shape: Column, amount: Column, kind: str) -> Column:
    """shape is schema_of_variant's, amount the value as a double."""
    if kind not in KINDS:
        raise ValueError(f"no type {kind}")
    some = reduce(lambda a, b: a | b, (shape.startswith(k) for k in KINDS[kind]))
    if kind == "integer":  # 1.0 is one too
        some = some | (_is(shape, amount, "number") & (amount == F.floor(amount)))
    return some


def _same(value: Column, shape: Column, is_number: Column, amount: Column, wanted: object) -> Column:
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return is_number & F.coalesce(amount == float(wanted), F.lit(False))
    if isinstance(wanted, str):
        return F.coalesce(shape.startswith("STRING") & (F.try_variant_get(value, "$", "string") == wanted), F.lit(False))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _step(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"keys with quotes or backslashes aren't supported: {name!r}")
    return f"$['{name}']"


def _compiled(schema: object, root: dict, value: Column, path: Column, depth: int) -> Column:
    """The findings on a value; it, its shape and each property are bound once."""
    if schema is True or schema is False or schema == {}:
        return _told(schema, root, value, F.lit(""), path, depth)
    shaped = F.struct(value.alias("value"), F.schema_of_variant(value).alias("shape"))
    return bound(shaped, lambda x: _told(schema, root, x["value"], x["shape"], path, depth))


def _told(schema: object, root: dict, value: Column, shape: Column, path: Column, depth: int) -> Column:
    if depth > MOST_DEPTH:
        raise ValueError(f"the schema refers to itself more than {MOST_DEPTH} times")
    if schema is True or schema == {}:
        return _joined([])
    if schema is False:
        return _found(F.lit(True), path, "not allowed")
    if "$ref" in schema:
        at: object = root
        if not schema["$ref"].startswith("#"):
            raise ValueError(f"only the schema's own definitions are known, not {schema['$ref']}")
        for part in schema["$ref"].lstrip("#").strip("/").split("/") if schema["$ref"] != "#" else []:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        rest = {k: v for k, v in schema.items() if k != "$ref"}
        return _joined([_compiled(at, root, value, path, depth + 1), _told(rest, root, value, shape, path, depth)])
    here = lambda s, v, p: _compiled(s, root, v, p, depth + 1)
    child = lambda name: F.try_variant_get(value, _step(name), "variant")
    below = lambda name: F.concat(path, F.lit(f"/{name}"))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    items = F.try_variant_get(value, "$", "array<variant>")
    is_object, is_array, is_string, is_number = (_is(shape, number, k) for k in ("object", "array", "string", "number"))
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    bounds: dict[str, Callable[[object], Column]] = {
        "minimum": lambda x: is_number & (number < x), "maximum": lambda x: is_number & (number > x), "exclusiveMinimum": lambda x: is_number & (number <= x), "exclusiveMaximum": lambda x: is_number & (number >= x),
        "minLength": lambda x: is_string & (F.length(text) < x), "maxLength": lambda x: is_string & (F.length(text) > x), "pattern": lambda x: is_string & ~text.rlike(x),
        "minItems": lambda x: is_array & (F.size(items) < x), "maxItems": lambda x: is_array & (F.size(items) > x), "const": lambda x: ~_same(value, shape, is_number, number, x), "enum": lambda x: ~reduce(lambda a, b: a | b, (_same(value, shape, is_number, number, v) for v in x), F.lit(False)),
    }
    parts: list[Column] = []
    for word, said in schema.items():
        if word == "type":
            kinds = [said] if isinstance(said, str) else said
            parts.append(_found(~reduce(lambda a, b: a | b, (_is(shape, number, k) for k in kinds)), path, "type"))
        elif word in bounds:
            parts.append(_found(F.coalesce(bounds[word](said), F.lit(False)), path, word))
        elif word == "required":
            parts += [_found(is_object & child(n).isNull(), path, f"required: {n}") for n in said]
        elif word == "properties":
            one = lambda n, s: bound(child(n), lambda c: F.when(c.isNotNull(), here(s, c, below(n))).otherwise(_joined([])))
            parts += [F.when(is_object, one(n, s)).otherwise(_joined([])) for n, s in said.items()]
        elif word == "additionalProperties":
            known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
            others = F.array_except(keys, known)
            outside = lambda given: F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: F.array_contains(given, k))
            if said is False:
                parts.append(F.when(is_object, F.transform(others, lambda k: F.struct(path.alias("path"), F.concat(F.lit("additional: "), k).alias("finding")))).otherwise(_joined([])))
            elif said is not True and said != {}:
                entries = F.coalesce(F.map_entries(bound(others, outside)), F.array().cast("array<struct<key:string,value:variant>>"))
                parts.append(F.when(is_object, F.flatten(F.transform(entries, lambda e: here(said, e["value"], F.concat(path, F.lit("/"), e["key"]))))).otherwise(_joined([])))
        elif word == "items":
            parts.append(F.when(is_array, F.flatten(F.transform(items, lambda x, i: here(said, x, F.concat(path, F.lit("/"), i.cast("string")))))).otherwise(_joined([])))
        elif word == "allOf":
            parts += [here(s, value, path) for s in said]
        elif word == "anyOf":
            parts.append(_found(~reduce(lambda a, b: a | b, (F.size(here(s, value, path)) == 0 for s in said)), path, "anyOf"))
        elif word not in SILENT:
            raise ValueError(f"the keyword {word} isn't supported")
    return _joined(parts)


def schema_findings(document: Column, schema: dict | bool) -> Column:
    """array of (path, finding): where a JSON text (or VARIANT column) breaks the schema, in the order in which the schema says so; path is / before each key or place. A text that isn't
    JSON has the one finding "not JSON"; null gives null. The expression grows with the schema, not with the data, and runs in the JVM; a text is parsed once."""
    told = lambda v: _compiled(schema, schema if isinstance(schema, dict) else {}, v, F.lit(""), 0)
    return F.when(document.isNotNull(), bound(F.try_parse_json(document), lambda v: F.when(v.isNull(), _found(F.lit(True), F.lit(""), "not JSON")).otherwise(told(v))))


def call_findings(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """schema_findings of a tool's arguments by its schema; a tool without one has the finding "unknown tool"."""
    out = _found(F.lit(True), F.lit(""), "unknown tool")
    for tool, schema in schemas.items():
        out = F.when(name == tool, schema_findings(F.coalesce(arguments, F.lit("")), schema)).otherwise(out)
    return out
