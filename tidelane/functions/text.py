"""Scalar text functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def normalize_reason(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mask_entities(text: Column) -> Column:
    """Lower case, with ISO dates, and words of five or more of a-z, 0-9 and _ that have both a
    letter and a digit, as <ENTITY>."""
    # Fixed value: what the reference's leakage audit masks.
    entity = r"\b\d{4}-\d{2}-\d{2}\b|\b(?=[a-z0-9_]{5,}\b)(?=[a-z0-9_]*[a-z])(?=[a-z0-9_]*\d)[a-z0-9_]+\b"
    return F.regexp_replace(F.lower(text), entity, "<ENTITY>")


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of words between spaces; 0 where both are empty."""
    x, y = (F.array_distinct(F.array_remove(F.split(t, " "), "")) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, white space as one space."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, answer: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(answer)).cast("int")


def contains_match(prediction: Column, answer: Column) -> Column:
    return F.contains(normalize_answer(prediction), normalize_answer(answer)).cast("int")


def last_answer(text: Column) -> Column:
    """What the last <answer> element holds, trimmed; null if there is none."""
    return F.trim(F.element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>")), -1))


def last_number(text: Column) -> Column:
    """The last number of the last 300 characters, without thousands separators; null if there is none."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(-?[0-9][0-9.,]*)"))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), "[,$]", ""))


def metric_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_./-]+", "_")


def stable_seed(text: Column) -> Column:
    """An integer below 2**31 - 1 from the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % (2**31 - 1)


def tags(text: Column, patterns: dict[str, str], names: Column | None = None, by_name: dict[str, str] | None = None) -> Column:
    """Sorted tags whose pattern the lower-case text has, and those that action names (an array) stand for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(t)) for t, p in patterns.items())))
    if names is not None:
        known = F.create_map(*(F.lit(x) for kv in (by_name or {}).items() for x in kv))
        found = F.concat(found, F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.try_element_at(known, n))))
    return F.array_sort(F.array_distinct(found))


def primary_tag(tags_: Column, several: str = "multi_goal", none: str = "lookup_or_policy") -> Column:
    return F.when(F.size(tags_) > 1, several).when(F.size(tags_) == 1, F.get(tags_, F.lit(0))).otherwise(none)


def entities(actions: str, keys: tuple[str, ...] = ("user_id", "reservation_id")) -> Column:
    """Sorted values that actions (structs with a map `arguments`) have under the keys."""
    each = F.flatten(F.transform(actions, lambda a: F.map_values(F.map_filter(a["arguments"], lambda k, _: k.isin(*keys)))))
    return F.array_sort(F.array_distinct(F.array_compact(each)))


def mutations(actions: str, writes: tuple[str, ...]) -> Column:
    """Sorted names of the actions that write."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(actions, lambda a: a["name"].isin(*writes)), lambda a: a["name"])))


def measured(text: Column, measure: Callable[[str], int]) -> Column:
    """measure(text) in Arrow batches, for instance a tokenizer's count; null where it fails or the text is null."""

    def size(t: str | None) -> int | None:
        try:
            return None if t is None else int(measure(t))
        except Exception:  # a row that can't be measured is dropped by the filter, whatever is wrong with it
            return None

    return F.arrow_udf(lambda a: pa.array([size(t) for t in a.to_pylist()], pa.int64()), "long", ArrowUDFType.SCALAR)(text)


def within_length(df: DataFrame, text: str, most: int, measure: Callable[[str], int]) -> DataFrame:
    """Rows of at most so many tokens; those that can't be measured go."""
    return df.filter(measured(F.col(text), measure) <= most)


def partial_entropy(rows: str, vocabulary: int, window: int) -> Column:
    """What the first alternatives of the first `window` tokens (an array of arrays of log-probabilities) add to
    their entropies, summed up, over the logarithm of the vocabulary. The rest of the vocabulary isn't known, and
    probabilities are taken as they are. No tokens, or a token without alternatives, are an error."""
    wrong = F.raise_error(F.lit("no token distributions")).cast("double")
    each = F.transform(F.slice(rows, 1, window), lambda r: -F.aggregate(r, F.lit(0.0), lambda s, x: s + F.when(x > float("-inf"), F.exp(x) * x).otherwise(0.0)))
    ok = (F.size(rows) > 0) & ~F.exists(F.slice(rows, 1, window), lambda r: F.size(r) <= 0)
    return F.when(ok, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / math.log(vocabulary)).otherwise(wrong)


def branch_probability(base: float, weight: float, change: Column) -> Column:
    """base plus weight times the entropy's change, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + weight * change))
