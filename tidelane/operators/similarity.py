"""Exact similarity joins of texts.

Texts are alike by the Jaccard similarity of their words, or in sequence (twice the matching characters over both lengths).

By words: a set of n words and another at the threshold t have n / t words together at most, and differ in (1 - t) n / t. If words are dealt
by hash to one class more than that, some class holds the same words in both: texts are joined by the words of a class. At low thresholds classes have few words, and an inverted
index is used: a pair has at least c words in common, and of a text with n words, by rising frequency over all texts, one of the first n - c + 1 is then among the other text's first ones.

In sequence: texts are dealt out by length, and all pairs whose lengths fit are compared by counts of letters, at some nanoseconds each, and then by
their longest common subsequence (functions/likeness). At these thresholds a pair need share short runs only, which very many unlike texts share as well, and whose index is several times the texts.
So the work is the square of the number of texts, but little of it for each pair, and a task holds one length's texts of the other side.

Runs, as an index for those who want one (_by_runs): let a pair have M matching characters in blocks, and U others. Between two blocks lies one of
the others at least, so there are U + 1 blocks at most, and M - (q - 1)(U + 1) runs of q characters or more are within blocks.
At a similarity of t, with s characters in both texts, this is at least f s - (q - 1), f = t / 2 - (q - 1)(1 - t).
Runs are ordered by their frequency in the other texts and then by place. The first run that the blocks share is then among both texts' first ones in the same
block, so its places differ by U at most, before and behind it together. Runs that no other text has come first and are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.documents import sequence_ratio
from tidelane.functions.likeness import banded
from tidelane.functions.text import normalize_reason, token_jaccard


def _ranked(parts: DataFrame) -> DataFrame:
    """parts (side, id, n, ...; part) with `rank` in its text, by rising frequency over both sides."""
    often = parts.groupBy("part").agg(F.count("*").alias("often_"))
    order = Window.partitionBy("side", "id").orderBy("often_", "part")
    return parts.join(often, "part").withColumn("rank", F.row_number().over(order))


def _met(first: DataFrame, fits: Column) -> DataFrame:
    """(a, b) of the texts of both sides that share one of their first parts."""
    a = first.filter("side = 'a'").select(F.col("id").alias("a"), F.col("n").alias("n_a"), "part")
    b = first.filter("side = 'b'").select(F.col("id").alias("b"), F.col("n").alias("n_b"), "part")
    return a.join(b, "part").filter(fits).select("a", "b").distinct()


def _by_hash(texts: DataFrame) -> DataFrame:
    """(id, said) of the different texts, dealt out by id: one exchange, which what is joined on id uses again."""
    return texts.groupBy(F.xxhash64("said").alias("id")).agg(F.collect_set("said").alias("said")).select("id", F.explode("said").alias("said"))


def _words() -> Column:
    return F.array_distinct(F.filter(F.split("said", " "), lambda w: w != ""))


def _by_words(texts: DataFrame, threshold: float) -> DataFrame:
    words = texts.select("side", "id", _words().alias("w"))
    parts = words.select("side", "id", F.size("w").alias("n"), F.explode("w").alias("part"))
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return _met(_ranked(parts).filter(F.col("rank") <= kept), F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)


def _by_runs(texts: DataFrame, threshold: float, q: int, low: float, high: float) -> DataFrame:
    """Candidates among pairs of low to below high characters together, by runs of q."""
    f = threshold / 2 - (q - 1) * (1 - threshold)
    sized = texts.select("side", "id", "said", F.length("said").alias("n"))
    least, most = F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("n") * (2 - threshold) / threshold + 1e-9)
    sized = sized.filter((F.col("n") >= q) & (F.col("n") + most >= low) & (F.col("n") + least < high))
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - (q - 1)), lambda i: F.xxhash64(F.substring("said", i, F.lit(q))))
    parts = sized.select("side", "id", "n", F.posexplode(runs).alias("pos", "part"))
    often = parts.filter("side = 'b'").groupBy("part").agg(F.count("*").alias("often_"))
    own = Window.partitionBy("side", "id")
    ranked = parts.join(often, "part").withColumn("kept_", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("often_", "part", "pos")))
    common = F.greatest(F.lit(1), F.ceil(f * F.greatest(F.col("n") + least, F.lit(low)) - (q - 1) - 1e-9))
    first = ranked.filter(F.col("rank") <= F.col("kept_") - common + 1)
    together = F.col("n_a") + F.col("n_b")
    fits = (together >= low) & (together < high) & (2 * F.least("n_a", "n_b") >= threshold * together - 1e-9)
    shift = F.abs(F.col("p_a") - F.col("p_b")) + F.abs((F.col("n_a") - F.col("p_a")) - (F.col("n_b") - F.col("p_b")))
    of = lambda p: first.filter(f"side = '{p}'").select(F.col("id").alias(p), F.col("n").alias(f"n_{p}"), F.col("pos").alias(f"p_{p}"), "part")
    return of("a").join(of("b"), "part").filter(fits & (shift <= (1 - threshold) * together + 1e-6)).select("a", "b").distinct()


def _by_classes(texts: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the texts that hold the same words of some class. Classes are as many as the size of a's set of words asks for; sizes above 32 go by steps of a twentieth."""
    step = lambda n: F.when(n <= 32, n).otherwise(33 + F.floor(F.log(n / 32) / math.log(1.05))).cast("int")
    words = lambda df, i: df.select(F.col("id").alias(i), F.array_sort(F.transform(_words(), lambda w: F.xxhash64(w))).alias("w")).withColumn("n", F.size("w"))

    def keyed(df: DataFrame, i: str) -> DataFrame:
        most = F.when(F.col("step") <= 32, F.col("step")).otherwise(F.floor(32 * F.pow(F.lit(1.05), F.col("step") - 32)) + 1)
        df = df.withColumn("classes", F.floor((1 - threshold) / threshold * most + 1e-9).cast("int") + 1)
        of = lambda k: F.xxhash64("step", k, F.filter("w", lambda w: F.pmod(w, F.col("classes")) == k))
        return df.select(i, F.explode(F.transform(F.sequence(F.lit(0), F.col("classes") - 1), of)).alias("key"))

    a = words(texts, "a").withColumn("step", step(F.col("n")))
    n = F.col("n")
    b = words(others, "b").withColumn("step", F.explode(F.sequence(step(F.ceil(n * threshold - 1e-9)), step(F.floor(n / threshold + 1e-9)))))
    return keyed(a, "a").join(keyed(b, "b"), "key").select("a", "b").distinct()


def _in_sequence(texts: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the different texts alike in sequence. A text of a goes to the band of its length, and one of b to all that fit."""
    width, n = math.log(max(1.02, (2 / threshold - 1) ** (1 / 6))), F.length("said")
    band = lambda n: F.floor(F.log(n) / width).cast("int")
    least, most = F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9)
    a = texts.select(band(n).alias("band"), F.lit(True).alias("mine"), "said")
    b = others.select(F.explode(F.sequence(band(least), band(most))).alias("band"), F.lit(False).alias("mine"), "said")
    # A number is given, as few bytes are much work here, and Spark would leave them to few tasks.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = a.union(b).repartition(parts, "band").sortWithinPartitions("band", "mine")
    return dealt.mapInArrow(banded(threshold), "a string, b string, similarity double")


def similar_texts(texts: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): all pairs of one of texts (a) and one of others (b), both columns `said` of normalised, non-empty texts
    (letters a-z, digits and single spaces), whose greater similarity reaches the threshold (above 0, at most 1).

    Equal texts are pairs of similarity 1, and repeated ones are compared once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    texts, others = _by_hash(texts), _by_hash(others)
    if threshold >= 0.8:
        found = _by_classes(texts, others, threshold)
    else:
        side = lambda df, name: df.select(F.lit(name).alias("side"), "id", "said")
        found = _by_words(side(texts, "a").union(side(others, "b")), threshold)
    told = lambda df, i, c: df.select(F.col("id").alias(i), F.col("said").alias(c))
    pairs = found.join(told(texts, "a", "x"), "a").join(told(others, "b", "y"), "b")
    words = F.when(F.col("x") == F.col("y"), 1.0).otherwise(token_jaccard(F.col("x"), F.col("y")))
    by_words = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), words.alias("similarity")).filter(F.col("similarity") >= threshold)
    return by_words.union(_in_sequence(texts, others, threshold)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def closest_texts(df: DataFrame, text: str, blocked: DataFrame, key: str, threshold: float = 0.88, order: str | None = None) -> DataFrame:
    """(key, blocked, similarity): of the blocked texts, the one most like each row's, where the likeness, of sets of
    words or in sequence, reaches the threshold. Texts are compared normalised. Ties go to the least `order` of blocked, or without one to
    the greatest text. Rows without such a text, null or empty ones, give no row; repeated texts are compared once; repeated rows give repeated rows.
    """
    listed = blocked.select(F.col("text").alias("blocked"), normalize_reason(F.col("text")).alias("b_"), *([F.col(order).alias("order_")] if order else [])).filter("b_ != ''")
    best = F.min_by("blocked", F.struct("order_", "blocked")) if order else F.max("blocked")
    first = listed.groupBy("b_").agg(best.alias("blocked"), (F.min("order_") if order else F.lit(0)).alias("order_"))
    rows = df.select(key, normalize_reason(F.col(text)).alias("a_")).filter("a_ != ''")
    pairs = similar_texts(rows.select(F.col("a_").alias("said")), first.select(F.col("b_").alias("said")), threshold)
    named = pairs.join(first, F.col("b") == F.col("b_"))
    rank = F.struct((-F.col("similarity")).alias("less"), "order_")
    if order:
        top = named.groupBy("a").agg(F.min_by(F.struct("blocked", "similarity"), F.struct(rank, "blocked")).alias("x"))
    else:
        top = named.groupBy("a").agg(F.max_by(F.struct("blocked", "similarity"), F.struct("similarity", "blocked")).alias("x"))
    # Rows are joined by two hashes of the text, which would be sent once more.
    hashed = lambda t: [F.xxhash64(t).alias("h_"), F.xxhash64(F.lit("text"), t).alias("g_")]
    return rows.select(key, *hashed("a_")).join(top.select(*hashed("a"), "x"), ["h_", "g_"]).select(key, "x.blocked", "x.similarity")


def best_matches(df: DataFrame, others: DataFrame, key: str, other: str, lexical: bool = False, eligible: str | None = None) -> DataFrame:
    """(key, other, exact, jaccard, same[, lexical]): for each row the most alike of others, by equal reasons, then the Jaccard similarity
    of tags, then equal actions, then (if asked for) the reasons' likeness in sequence; ties by the least other.

    Both sides have reason (normalised), tags and actions (arrays); `eligible` names a boolean column of others that must hold. A row
    that shares neither a tag nor its reason with any of others stays, with other null. Keys are unique on each side.

    Sets of tags are compared, not rows: rows with one set are one, and so the pairs of a tag that
    very many rows have are as many as its different sets. Of the best sets' rows only those with equal actions go on, if there are any.
    """
    if eligible:
        others = others.filter(F.col(eligible))
    side = lambda d, k, p: d.select(F.col(k).alias(p), F.col("reason").alias(f"{p}_reason"), F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias(f"{p}_tags"), F.array_sort("actions").alias(f"{p}_acts"))
    a, b = side(df, key, "a"), side(others, other, "b")
    whole = a
    if not lexical:  # rows alike in all three are one, and so are those of others, of which the least counts
        parts = lambda p: [f"{p}_reason", f"{p}_tags", f"{p}_acts"]
        a = whole.groupBy(*parts("a")).agg(F.min("a").alias("a"))
        b = b.groupBy(*parts("b")).agg(F.min("b").alias("b"))
    kinds = lambda d, p: d.select(f"{p}_tags").distinct()
    each = lambda d, p: kinds(d, p).select(f"{p}_tags", F.explode(f"{p}_tags").alias("tag_"))
    shared = each(a, "a").join(each(b, "b"), "tag_").groupBy("a_tags", "b_tags").agg(F.count("*").alias("n_"))
    shared = shared.withColumn("jaccard", F.col("n_") / (F.size("a_tags") + F.size("b_tags") - F.col("n_")))
    top = Window.partitionBy("a_tags")
    nearest = shared.withColumn("top_", F.max("jaccard").over(top)).filter("jaccard = top_").select("a_tags", "b_tags", "jaccard")

    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("a_tags", "b_tags")), F.size(F.array_union("a_tags", "b_tags"))), F.lit(0.0))
    same = F.col("a_acts") == F.col("b_acts")
    said = a.join(b, F.col("a_reason") == F.col("b_reason")).withColumns({"exact": F.lit(True), "jaccard": jaccard, "same": F.coalesce(same, F.lit(False))})
    columns = ["a", "a_reason", "b", "b_reason", "exact", "jaccard", "same"]
    rank = F.struct("jaccard", F.col("same").cast("int"))
    said = said.withColumn("top_", F.max(rank).over(Window.partitionBy("a"))).filter(rank == F.col("top_")).select(columns)
    rest = a.join(said.select("a").distinct(), "a", "left_anti").join(nearest, "a_tags")
    alike = rest.join(b, ["b_tags"]).filter(same).withColumns({"exact": F.lit(False), "same": F.lit(True)}).select(columns)
    other_acts = rest.join(alike.select("a").distinct(), "a", "left_anti")
    if lexical:
        lone = other_acts.join(b, ["b_tags"])
    else:
        least = b.groupBy("b_tags").agg(F.min_by(F.struct("b", "b_reason"), "b").alias("x_")).select("b_tags", "x_.*")
        lone = other_acts.join(least, ["b_tags"])
    found = said.union(alike).union(lone.withColumns({"exact": F.lit(False), "same": F.lit(False)}).select(columns))
    out = ["exact", "jaccard", "same"]
    if lexical:
        words = found.select(F.col("a_reason").alias("p_"), F.col("b_reason").alias("q_")).distinct().withColumn("lexical", sequence_ratio(F.col("p_"), F.col("q_")))
        found = found.join(words, F.col("a_reason").eqNullSafe(F.col("p_")) & F.col("b_reason").eqNullSafe(F.col("q_")))
        out.append("lexical")
        best = found.groupBy("a").agg(F.min_by(F.struct("b", *out), F.struct(F.coalesce(-F.col("lexical"), F.lit(1.0)).alias("less"), "b")).alias("x"))
    else:
        best = found.groupBy("a").agg(F.min_by(F.struct("b", *out), "b").alias("x"))
    if lexical:
        return whole.select("a").join(best, "a", "left").select(F.col("a").alias(key), F.col("x.b").alias(other), *(f"x.{c}" for c in out))
    best = a.join(best, "a").select(*(F.col(c).alias(f"{c}_") for c in parts("a")), "x")
    met = reduce(lambda m, c: m & F.col(c).eqNullSafe(F.col(f"{c}_")), parts("a"), F.lit(True))
    return whole.join(best, met, "left").select(F.col("a").alias(key), F.col("x.b").alias(other), *(f"x.{c}" for c in out))
