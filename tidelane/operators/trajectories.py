"""Facts of trajectories: spans of generated tokens, what of them was retained, and what a record can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retained_spans(df: DataFrame, ids: str, mask: str, spans: str) -> DataFrame:
    """df with problem, retained (spans cut to the tokens there are) and discarded (tokens that each span lost).

    ids and mask are arrays of a trajectory's tokens, spans an array of (start, end), end excluded, of the turns that the model wrote. problem is null where all is well, or the first of:
    "mask isn't binary and aligned", "invalid span", "spans overlap or include observations", "spans do not cover generated tokens".
    Retained spans must be, each once, the places where mask is 1. Null arrays are empty; no spans are right for a trajectory without generated tokens.
    """
    n = F.size(F.coalesce(ids, F.array()))
    marks, told = F.coalesce(mask, F.array().cast("array<int>")), F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int>>"))
    cut = F.transform(told, lambda s: F.struct(F.least(s["start"], n).alias("start"), F.least(s["end"], n).alias("end")))
    places = F.flatten(F.transform(cut, lambda s: F.when(s["start"] < s["end"], F.sequence(s["start"], s["end"] - 1)).otherwise(F.array().cast("array<int>"))))
    written = F.filter(F.transform(marks, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    out = df.withColumns({"retained": cut, "places_": places, "written_": written})
    aligned = (F.size(marks) == n) & F.forall(marks, lambda m: F.coalesce(m.isin(0, 1), F.lit(False)))
    valid = F.forall(told, lambda s: F.coalesce((s["start"] >= 0) & (s["start"] <= s["end"]), F.lit(False)))
    once = (F.size("places_") == F.size(F.array_distinct("places_"))) & (F.size(F.array_except("places_", "written_")) == 0)
    problem = (
        F.when(~aligned, "mask isn't binary and aligned").when(~valid, "invalid span").when(~once, "spans overlap or include observations")
        .when(F.size("places_") != F.size("written_"), "spans do not cover generated tokens")
    )
    lost = F.transform(F.arrays_zip(told.alias("a"), F.col("retained").alias("b")), lambda x: (x["a"]["end"] - x["a"]["start"] - (x["b"]["end"] - x["b"]["start"])).cast("long"))
    return out.withColumns({"problem": problem, "discarded": lost}).drop("places_", "written_")


def capabilities(df: DataFrame, ids: str, logprobs: str, turns: str) -> DataFrame:
    """df with complete_logprobs (one for each token, and every turn says that it has its own) and finish_reasons, the number of turns that say why they ended.
    turns is an array of structs with generated_logprobs_available and finish_reason; a null array has no turns."""
    own = F.coalesce(F.col(turns), F.array().cast(df.schema[turns].dataType))
    has: Column = F.forall(own, lambda t: F.coalesce(t["generated_logprobs_available"], F.lit(False)))
    complete = F.coalesce(F.col(logprobs).isNotNull() & (F.size(logprobs) == F.size(F.coalesce(ids, F.array()))) & has, F.lit(False))
    return df.withColumns({"complete_logprobs": complete, "finish_reasons": F.size(F.filter(own, lambda t: t["finish_reason"].isNotNull())).cast("long")})
