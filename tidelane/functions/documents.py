"""JSON documents and answers: canonical forms, comparison, redaction, extraction and arithmetic.

What needs recursion runs on Arrow batches of JSON text; the rest are column expressions.
"""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def _each(f: Callable, kind: str, out: pa.DataType, *columns: Column) -> Column:
    """f of the rows' Python values, null where one is null, as an Arrow batch function. A value of a single column is worked on once in a batch."""

    def run(*arrays: pa.Array) -> pa.Array:
        if len(arrays) == 1:
            coded = arrays[0].dictionary_encode()
            return pa.array(map(f, coded.dictionary.to_pylist()), out).take(coded.indices)
        rows = zip(*(a.to_pylist() for a in arrays))
        return pa.array([None if any(x is None for x in r) else f(*r) for r in rows], out)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR)(*columns)


#: JSON text with keys in order and no spare white space.
canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def canonical_text(document: Column) -> Column:
    """JSON text with keys in order and no spare white space; an error where it isn't JSON."""
    return _each(lambda x: canonical(json.loads(x)), "string", pa.string(), document)


def json_hash(document: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_text(document).cast("binary"), 256)


def decoded(document: Column, what: str = "field") -> Column:
    """A JSON object as map<string, string>, a JSON null and a null as an empty one; any other JSON is an error."""
    kind = F.substring(F.trim(document), 1, 1)
    other = F.raise_error(F.lit(f"{what} isn't an object")).cast("map<string,string>")
    empty = F.expr("CAST(map() AS map<string,string>)")
    return F.when(document.isNull() | (F.trim(document) == "null"), empty).when(kind == "{", F.coalesce(F.from_json(document, "map<string,string>"), other)).otherwise(other)


def first_known(*columns: Column) -> Column:
    return F.coalesce(*columns)


def typed_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are equal in types and list order, whatever the order of keys."""
    return F.coalesce(canonical_text(a) == canonical_text(b), a.isNull() & b.isNull())


def matched_arguments(actual: Column, expected: Column, keys: Column | None = None) -> Column:
    """(exact, partial) for maps of canonical JSON texts: all equal, or those in `keys`; and the part of these (or of the expected ones) that are."""
    on = F.coalesce(keys, F.map_keys(expected)) if keys is not None else F.map_keys(expected)
    same = F.size(F.filter(on, lambda k: F.map_contains_key(actual, k) & F.map_contains_key(expected, k) & (actual[k] == expected[k])))
    whole = F.array_sort(F.map_entries(actual)) == F.array_sort(F.map_entries(expected))
    exact = whole if keys is None else F.when(keys.isNull(), whole).otherwise(same == F.size(on))
    return F.struct(exact.alias("exact"), F.coalesce(F.try_divide(same, F.size(on)), F.lit(0.0)).alias("partial"))


def _numeric(value: object) -> bool:
    return isinstance(value, (int, float, Decimal))


def _decimal(value: object) -> str:
    """A number's digits and power of ten, one text for all ways of writing it; true is 1."""
    sign, digits, power = Decimal(str(int(value) if isinstance(value, bool) else value)).as_tuple()
    if not isinstance(power, int):  # nan and the infinities
        return str(value)
    text = "".join(map(str, digits))
    kept = text.rstrip("0")
    return f"{'-' if sign else ''}{kept.lstrip('0')}e{power + len(text) - len(kept)}" if kept else "0"


def _folded(value: object, scalar: Callable, array: Callable, record: Callable) -> object:
    """A JSON value from its leaves up, without recursion: array and record get a value and what became of its parts."""
    out: list = []
    todo = [(value, False)]
    while todo:
        v, seen = todo.pop()
        if not isinstance(v, (dict, list)):
            out.append(scalar(v))
        elif seen:
            parts = out[len(out) - len(v) :]
            del out[len(out) - len(v) :]
            out.append(record(v, dict(zip(v, parts))) if isinstance(v, dict) else array(v, parts))
        else:
            todo.append((v, True))
            todo.extend((x, False) for x in reversed(v.values() if isinstance(v, dict) else v))
    return out[0]


def _braces(parts: dict[str, str]) -> str:
    return "{" + ",".join(f"{json.dumps(k)}:{parts[k]}" for k in sorted(parts)) + "}"


def _same(value: object) -> str:
    """A text that is equal for values that are: numbers by their amount, objects without order."""
    return _folded(value, lambda v: _decimal(v) if _numeric(v) else json.dumps(v), lambda _, parts: f"[{','.join(parts)}]", lambda _, parts: _braces(parts))


DIFFERENCE = "path:string,expected:string,actual:string,kind:string"


def _equal(a: object, b: object) -> bool:
    """Whether `_same` is, without writing it."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            if x.keys() != y.keys():
                return False
            todo.extend((v, y[k]) for k, v in x.items())
        elif isinstance(x, list) and isinstance(y, list):
            if len(x) != len(y):
                return False
            todo.extend(zip(x, y))
        elif not (type(x) is type(y) and x == y) and not (_numeric(x) and _numeric(y) and _decimal(x) == _decimal(y)):
            return False
    return True


def _differences(expected: str, actual: str) -> list[dict]:
    todo: list[tuple[list[str], object, object]] = [([], json.loads(expected), json.loads(actual))]
    out = []
    while todo:
        path, a, b = todo.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            todo.extend(([*path, k], a[k], b[k]) for k in a.keys() & b.keys())
            out += [([*path, k], canonical(a[k]) if k in a else None, canonical(b[k]) if k in b else None, "missing_key") for k in a.keys() ^ b.keys()]
        elif not _equal(a, b):
            lists = isinstance(a, list) and isinstance(b, list)
            kind = "value" if not lists else "list_order_only" if sorted(map(canonical, a)) == sorted(map(canonical, b)) else "list_content"
            out.append((path, canonical(a), canonical(b), kind))
    return [{"path": "".join(f"/{k}" for k in path), "expected": a, "actual": b, "kind": kind} for path, a, b, kind in sorted(out, key=lambda x: x[0])]


def differences(expected: Column, actual: Column) -> Column:
    """Where two JSON texts differ, in order of the paths: path, both values, and kind (missing_key, list_order_only,
    list_content or value). A key that one object lacks is named once, with all below it; lists are compared
    whole. Null where either is null."""
    kinds = [(c.split(":")[0], pa.string()) for c in DIFFERENCE.split(",")]
    return _each(_differences, f"array<struct<{DIFFERENCE}>>", pa.list_(pa.struct(kinds)), expected, actual)


#: Keys whose values are secret, and the end of others.
SECRETS, SECRET_END = {"api_key", "password", "secret", "access_token", "auth_token", "token"}, "_api_key"


def _masked(pairs: list[tuple[str, object]]) -> dict:
    return dict((k, "[REDACTED]") if (low := k.lower()) in SECRETS or low.endswith(SECRET_END) else (k, v) for k, v in pairs)


def redacted(document: Column) -> Column:
    """Canonical JSON text with secrets replaced at every depth, as its objects are read."""
    return _each(lambda x: canonical(json.loads(x, object_pairs_hook=_masked)), "string", pa.string(), document)


def _numbers(text: str) -> list[dict]:
    todo = [("", json.loads(text))]
    out = []
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{path}/{k}", v[k]) for k in v)
        elif path and _numeric(v) and abs(v) < float("inf"):
            out.append({"key": path[1:], "value": float(v)})
    return out


def scalar_metrics(document: Column) -> Column:
    """The finite numbers of a JSON object by path, as a map; booleans are 0 and 1. What is in lists is left out."""
    found = _each(_numbers, "array<struct<key:string,value:double>>", pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())])), document)
    return F.map_from_entries(found)


NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")


def _identity(value: object) -> str:
    told = lambda v: v is not None and v not in ("", [], {})

    def scalar(v: object) -> str:
        if isinstance(v, bool) or v is None:
            return json.dumps(v)
        if isinstance(v, str):
            return f"#{_decimal(v.strip())}" if NUMBER.fullmatch(v.strip()) else json.dumps(v)
        if not Decimal(v).is_finite():
            raise ValueError("numbers must be finite")
        return f"#{_decimal(v)}"

    def array(v: list, parts: list[str]) -> str:
        kept = [p for x, p in zip(v, parts) if told(x)]
        return f"[{','.join(sorted(kept) if all(isinstance(x, dict) for x in v) else kept)}]"

    def record(v: dict, parts: dict[str, str]) -> str:
        return _braces({k: p for k, p in parts.items() if told(v[k])})

    return _folded(value, scalar, array, record) if isinstance(value, (dict, list)) else scalar(value)


def _members(text: str, strict: bool) -> list[tuple[str, str]] | None:
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=None if strict else Decimal)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    if strict:
        return [(k, canonical(v)) for k, v in sorted(value.items())]
    return [(k, _identity(v)) for k, v in sorted(value.items()) if v is not None and v not in ("", [], {})]


def _refuse(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def members(document: Column, strict: bool = True) -> Column:
    """A JSON object as map<string, string> of its keys, in order, to texts that are equal for equal values: strictly, in types and
    order of lists, or as `identity` has it, without empty entries. Null for other JSON and for text that is none."""
    return _each(lambda x: _members(x, strict), "map<string,string>", pa.map_(pa.string(), pa.string()), document)


def member_texts(document: Column, strict: bool = True) -> Column:
    """As `members`, but an array of one text for each key with its value, in order of the keys: two objects share as many members as these arrays do."""

    def told(text: str) -> list[str] | None:
        found = _members(text, strict)
        return None if found is None else [f"{json.dumps(k)}:{v}" for k, v in found]

    return _each(told, "array<string>", pa.list_(pa.string()), document)


def observed(text: Column) -> Column:
    """A text that is equal for equal observations: canonical where it is JSON, else the text as a JSON
    string. Null where it is blank or has an infinite number or none."""

    def told(x: str) -> str | None:
        try:
            value = json.loads(x)
        except ValueError:
            return canonical(x) if x.strip() else None
        try:
            return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return _each(told, "string", pa.string(), text)


def identity(document: Column) -> Column:
    """A text that is equal for equal JSON: types are kept apart (numbers in text count as numbers), numbers
    are exact decimals, empty entries are left out and lists of objects are sorted. Infinite numbers are an error."""
    return _each(lambda x: _identity(json.loads(x, parse_float=Decimal)), "string", pa.string(), document)


OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _calculated(text: str) -> str | None:
    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    if len(text) > 1000 or not re.fullmatch(r"[0-9+\-*/(). ]*", text):
        return None
    try:
        return str(round(float(value(ast.parse(text.strip(), mode="eval").body)), 2))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def calculated(expression: Column) -> Column:
    """The value of digits, + - * / and brackets, rounded to two places, as text; null for anything else."""
    return _each(_calculated, "string", pa.string(), expression)


def numeric_answer(text: Column, mode: str = "strict") -> Column:
    """The last number after ####, or in flexible mode the last number at all, of the last 300 characters; null if there is none."""
    if mode not in ("strict", "flexible"):
        raise ValueError(f"unknown mode {mode}")
    tail = F.right(text, F.lit(300))
    if mode == "strict":
        found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"))
        return F.regexp_replace(F.get(found, F.size(found) - 1), "[,$]", "")
    found = F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)")), lambda x: ~x.isin("", "."))
    return F.get(found, F.size(found) - 1)


def scored(source: Column, scorers: dict[str, Column], default: Column | None = None) -> Column:
    """The score that the row's source asks for; a source without one is an error, or takes the default."""
    out = F.raise_error(F.concat(F.lit("no score for "), F.coalesce(source, F.lit("null")))).cast("double") if default is None else default
    for name, score in scorers.items():
        out = F.when(source == name, score).otherwise(out)
    return out


def communicated(messages: str, needles: str) -> Column:
    """For each needle whether an assistant message (structs of role and content) has it, ignoring case and commas in numbers."""
    said = F.transform(F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].isNotNull()), lambda m: F.replace(F.lower(m["content"]), F.lit(","), F.lit("")))
    return F.transform(needles, lambda n: F.exists(said, lambda s: F.contains(s, F.lower(n))))


def valid_date(text: Column) -> Column:
    """Whether a text is a calendar date, YYYY-MM-DD."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text).isNotNull(), F.lit(False))


def age(birth: Column, on: Column) -> Column:
    """Full years."""
    return F.floor(F.months_between(on, birth) / 12).cast("int")


def matching_blocks_ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's similarity of two texts."""
    return _each(matching_blocks_ratio, "double", pa.float64(), a, b)


def common_characters(a: str, b: str) -> int:
    """The length of the longest common subsequence, by a bit for each character of a: no fewer than match in blocks."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = left = (1 << len(a)) - 1
    for c in b:
        met = left & at.get(c, 0)
        left = (left + met | left - met) & every
    return len(a) - left.bit_count()


def near_duplicate(a: Column, b: Column, threshold: float = 0.88, ratio: Column | None = None) -> Column:
    """Whether two normalised texts are alike by their sets of words or in sequence. Texts whose lengths
    rule the latter out never reach Python, and none does where their sequence_ratio is at hand."""
    words = lambda t: F.array_distinct(F.array_remove(F.split(t, " "), ""))
    x, y = words(a), words(b)
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
    some = (F.length(a) > 0) & (F.length(b) > 0)
    fits = 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))
    asked = some & (jaccard < threshold) & fits
    ratio = sequence_ratio(F.when(asked, a), F.when(asked, b)) if ratio is None else F.when(asked, ratio)
    return F.coalesce(some & ((jaccard >= threshold) | (ratio >= threshold)), F.lit(False))
