"""Choosing and checking training records: likeness to blocked texts, matches, greedy choices, splits, decisions."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.documents import matching_blocks_ratio
from tidelane.functions.text import normalize_reason
from tidelane.operators import similarity
from tidelane.operators.sequences import seeded_hash

#: Rows that a greedy choice goes through in one task; of more, each step is a pass over all partitions.
MOST_POOL = 200_000
#: Rows that a diverse selection takes at a time.
STEP = 1000
#: Held-out entities of several words, which are looked for in every text; more is an error.
MOST_LISTED = 20_000


def _bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows")
    return df


closest, best_matches = similarity.closest_texts, similarity.best_matches


class _Buckets:
    """Buckets of reasons, each by its first one, and how many rows each has."""

    def __init__(self, threshold: float, cap: int) -> None:
        self.threshold, self.cap, self.all = threshold, cap, []

    def best(self, text: str, since: int = 0, so_far: tuple | None = None) -> tuple:
        """(score, number) of the bucket most like a text; the number is null if none reaches the threshold."""
        words, best = set(text.split()), so_far or (self.threshold, None)
        for i in range(since, len(self.all)):
            other, own, _ = self.all[i]
            if not text or not other:
                continue
            score = 1.0 if text == other else len(words & own) / len(words | own)
            if score < 1 and 2 * min(len(text), len(other)) >= max(best[0], score) * (len(text) + len(other)):
                score = max(score, matching_blocks_ratio(text, other))
            if score > best[0] or score == best[0] and best[1] is None:
                best = (score, i)
        return best

    def full(self, number: int | None) -> bool:
        return number is not None and self.all[number][2] >= self.cap

    def add(self, text: str, number: int | None) -> int:
        if number is None:
            number = len(self.all)
            self.all.append([text, set(text.split()), 0])
        self.all[number][2] += 1
        return number


def diverse_selection(df: DataFrame, key: str, reason: str, seed: int, size: int, threshold: float, cap: int = 1) -> DataFrame:
    """(key, place, bucket): rows in the order of sha256(seed:key) join the most alike bucket of reasons
    (represented by its first), if they reach the threshold, and are passed over once it has `cap`. Pools of any size.

    Each round asks which reasons have a full bucket, takes the next rows of other reasons, STEP at a time, and goes through these in order. A reason without
    a place can get one only by a new bucket, so a round that left reasons out ends with the row that opens one.
    """
    size = size if cap > 0 else 0
    pool = df.select(F.col(key).alias("k_"), F.coalesce(normalize_reason(F.col(reason)), F.lit("")).alias("r_"), seeded_hash(key, seed).alias("h_"))
    pool = pool.withColumn("u_", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    state, out, after, step = _Buckets(threshold, cap), [], ("", 0), max(STEP, size)
    while len(out) < size:
        rows = pool.filter((F.col("h_") > after[0]) | (F.col("h_") == after[0]) & (F.col("u_") > after[1]))
        left_out = False
        if state.all:

            @F.pandas_udf("boolean")
            def blocked(texts: pd.Series) -> pd.Series:
                return pd.Series([state.full(state.best(t)[1]) for t in texts])

            reasons = rows.select("r_").distinct().withColumn("full_", blocked("r_")).persist(StorageLevel.DISK_ONLY)
            left_out = not reasons.filter("full_").isEmpty()
            rows = rows.join(reasons.filter("NOT full_"), "r_") if left_out else rows
        found = rows.orderBy("h_", "u_").limit(step).select("k_", "r_", "h_", "u_").collect()
        known = {}
        for k, text, *after in found:
            since, best = known.get(text, (0, None))
            best = state.best(text, since, best)
            known[text] = (len(state.all), best)
            if state.full(best[1]):
                continue
            opened = best[1] is None
            out.append((k, len(out), state.add(text, best[1])))
            if len(out) == size or opened and left_out:
                break
        else:
            if len(found) < step:
                break
    pool.unpersist()
    schema = pool.select(F.col("k_").alias(key), F.lit(0).alias("place"), F.lit(0).alias("bucket")).schema
    return df.sparkSession.createDataFrame(out, schema)


class _Balance:
    """Ranks rows of classes (category, stratum, entities) by what was taken before."""

    def __init__(self) -> None:
        self.categories, self.strata, self.used = Counter(), Counter(), Counter()

    def rank(self, category, stratum, entities) -> tuple:
        return self.categories[category], self.strata[category, stratum], sum(self.used[e] for e in entities)

    def take(self, category, stratum, entities) -> None:
        self.categories[category] += 1
        self.strata[category, stratum] += 1
        self.used.update(entities)


class _Cover:
    """Ranks rows of classes (tools, how many rows of the pool have each of them, category) by the deficits left."""

    def __init__(self, least: int, goals: dict[str, int] | None) -> None:
        self.least, self.goals, self.seen, self.categories = least, goals, Counter(), Counter()

    def rank(self, tools, has, category) -> tuple:
        goals, seen = self.goals, self.seen
        lacks = sum(1 / n for t, n in zip(tools, has) if seen[t] < min(self.least, n) and (goals is None or seen[t]))
        unseen = sum(1 / n for t, n in zip(tools, has) if not seen[t]) if goals is not None else 0
        need = max(0, goals.get(category, 0) - self.categories[category]) / max(1, goals.get(category, 0)) if goals is not None else 0
        return -unseen, -need, -lacks

    def take(self, tools, has, category) -> None:
        self.seen.update(tools)
        self.categories[category] += 1


def _hashable(x):
    return tuple(x) if isinstance(x, (list, np.ndarray)) else x


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """(class, place in it, -merit, hash, key) of each row."""
    of = [c for c in frame.columns if c.startswith("of_")]
    for own, n, m, h, k in zip(frame[of].itertuples(index=False, name=None), frame["n_"], frame["m_"], frame["h_"], frame["k_"]):
        yield tuple(map(_hashable, own)), n, -m, h, k


def _one_by_one(pool: DataFrame, key: str, size: int, state: _Balance | _Cover) -> DataFrame:
    """(key, place): `size` rows of pool (k_, m_, h_, and columns of_... that make a row's class), one after the other: of the class
    that the state ranks first after all rows before, then of the greatest m_ and the least h_.

    What was taken before ranks classes only, and the rows of a class go in the order of m_ and h_. So no class gives more than its first `size` rows, and only these
    are kept. At most MOST_POOL of them are gone through in one task; of more, each step asks every partition for its best row.
    """
    if size < 1:
        return pool.limit(0).select(F.col("k_").alias(key), F.lit(0).alias("place"))
    of = [c for c in pool.columns if c.startswith("of_")]
    order = Window.partitionBy(*of).orderBy(F.desc("m_"), "h_")
    heads = pool.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= size)
    heads = heads.persist(StorageLevel.DISK_ONLY)
    schema = pool.select(F.col("k_").alias(key), F.lit(0).alias("place")).schema

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        classes, out = defaultdict(list), []
        for own, n, m, h, k in _rows(frame):
            classes[own].append((m, h, n, k))
        waiting = {own: sorted(rows, key=lambda r: r[2], reverse=True) for own, rows in classes.items()}
        while waiting and len(out) < size:
            own = min(waiting, key=lambda c: (*state.rank(*c), *waiting[c][-1][:2]))
            out.append((waiting[own].pop()[3], len(out)))
            state.take(*own)
            if not waiting[own]:
                del waiting[own]
        return pd.DataFrame(out, columns=schema.names)

    if heads.count() <= MOST_POOL:
        return heads.groupBy().applyInPandas(choose, schema)
    gone, out = Counter(), []

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for frame in frames:
            for at, (own, n, m, h, k) in enumerate(_rows(frame)):
                if n == gone[own] + 1:
                    mine = (*state.rank(*own), m, h)
                    if first is None or mine < first[0]:
                        first = (mine, frame.iloc[at : at + 1])
        if first:
            yield first[1]

    while len(out) < size:
        tops = [r for r in heads.mapInPandas(best, heads.schema).collect()]
        told = [(tuple(_hashable(r[c]) for c in of), r) for r in tops]
        if not told:
            break
        own, r = min(told, key=lambda x: (*state.rank(*x[0]), -x[1]["m_"], x[1]["h_"]))
        out.append((r["k_"], len(out)))
        gone[own] += 1
        state.take(*own)
    heads.unpersist()
    return pool.sparkSession.createDataFrame(out, schema)


def balanced_selection(df: DataFrame, key: str, size: int, seed: int, category: str = "category", stratum: str = "stratum", entities: str = "entities", merit: str = "merit") -> DataFrame:
    """(key, place): one row after the other, of the category and then the stratum with the fewest so far, then
    with the least used entities, the greatest merit and the least sha256(seed:key). Pools of any size."""
    own = F.array_sort(F.array_distinct(entities))
    pool = df.select(F.col(key).alias("k_"), F.col(category).cast("string").alias("of_c"), F.col(stratum).cast("string").alias("of_s"), own.alias("of_e"), F.coalesce(F.col(merit).cast("double"), F.lit(float("-inf"))).alias("m_"), seeded_hash(key, seed).alias("h_"))
    return _one_by_one(pool, key, size, _Balance())


def covering_selection(df: DataFrame, key: str, size: int, seed: int, tools: str = "tools", least: int = 5, goals: dict[str, int] | None = None, category: str = "category") -> DataFrame:
    """(key, place): rows that fill deficits first. A tool that fewer than `least` chosen rows have (or all rows
    that have it) counts 1 over how many rows of the pool have it; with goals by category, the most
    wanting category comes before that, and rows with a tool not seen yet before both; ties by sha256(seed:key). Pools of any size."""
    c = F.col(category).cast("string") if goals is not None else F.lit("")
    pool = df.select(F.col(key).alias("k_"), F.array_sort(F.array_distinct(tools)).alias("of_a"), c.alias("of_c"), F.lit(0.0).alias("m_"), seeded_hash(key, seed).alias("h_"))
    sets = pool.groupBy("of_a").agg(F.count("*").alias("n"))
    each = sets.select("of_a", "n", F.posexplode("of_a").alias("at", "tool"))
    has = each.groupBy(F.col("tool").alias("tool_")).agg(F.sum("n").alias("has"))
    met = each.join(has, F.col("tool").eqNullSafe(F.col("tool_"))).groupBy(F.col("of_a").alias("a_")).agg(F.array_sort(F.collect_list(F.struct("at", "has"))).alias("x"))
    counted = pool.join(met, F.col("of_a") == F.col("a_"), "left").withColumn("of_b", F.coalesce(F.col("x.has"), F.array().cast("array<bigint>")))
    return _one_by_one(counted.select("k_", "of_a", "of_b", "of_c", "m_", "h_"), key, size, _Cover(least, goals))


def extension(pool: DataFrame, chosen: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows of the pool whose signature (an array, whatever its order) no chosen row has, one (the least key) for each new one."""
    known = chosen.select(F.array_sort(signature).alias("s_")).distinct()
    fresh = pool.withColumn("s_", F.array_sort(signature)).join(known, "s_", "left_anti").join(chosen.select(key), key, "left_anti")
    return fresh.withColumn("n_", F.row_number().over(Window.partitionBy("s_").orderBy(key))).filter("n_ = 1").drop("s_", "n_")


def group_split(df: DataFrame, key: str, group: str, bucket: str, seed: int, part: float, lock: str = "lock", protected: Iterable = ()) -> DataFrame:
    """(key, split): whole groups to train or validation, so that each bucket's validation comes as near as it can to its part.

    Groups locked to a split stay there; the others, in the order of sha256(seed:group), go to
    validation while that brings it nearer. Rows without a group, and those of protected
    groups or of groups with a row without a bucket, are held. A group locked to both is an
    error; one with rows of several buckets (numbers) goes to the largest. Group sizes, not
    rows, are walked through, a bucket at a time.
    """
    rows = df.select(key, F.col(group).alias("g_"), F.col(bucket).alias("b_"), F.col(lock).alias("l_"))
    both = F.raise_error(F.concat(F.lit("locked to both splits: "), F.col("g_").cast("string"))).cast("string")
    groups = rows.filter("g_ IS NOT NULL").groupBy("g_").agg(F.count("*").alias("n_"), F.max("b_").alias("b_"), F.count_if(F.col("b_").isNull()).alias("u_"), F.when(F.countDistinct("l_") > 1, both).otherwise(F.max("l_")).alias("l_"))
    guarded = F.col("g_").isin(list(protected)) if protected else F.lit(False)
    held = guarded | (F.col("u_") > 0)
    total = groups.filter(~held).groupBy("b_").agg(F.floor(F.sum("n_") * part + 0.5).alias("t_"), F.coalesce(F.sum(F.when(F.col("l_") == "validation", F.col("n_"))), F.lit(0)).alias("v_"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        target, now, out = rows["t_"].iloc[0], rows["v_"].iloc[0], []
        for n in rows.sort_values("h_")["n_"]:
            take = abs(now + n - target) < abs(now - target)
            now += n * take
            out.append("validation" if take else "train")
        return rows.sort_values("h_")[["g_"]].assign(s_=out)

    kind = df.schema[group].dataType.simpleString()
    free = groups.filter(~held & F.col("l_").isNull()).join(total, "b_").select("g_", "b_", "n_", "t_", "v_", seeded_hash("g_", seed).alias("h_")).groupBy("b_").applyInPandas(fill, f"g_ {kind}, s_ string")
    placed = free.unionByName(groups.filter(~held & F.col("l_").isNotNull()).select("g_", F.col("l_").alias("s_")))
    return rows.join(placed, "g_", "left").select(key, F.coalesce("s_", F.lit("held")).alias("split"))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """df; a key that is null or occurs twice is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("n_", n).filter(F.when((F.col("n_") == 1) & F.col(key).isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"{key} isn't unique: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).drop("n_")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits) of the keys that more than one split has; none where splits are disjoint."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def evidence(samples: DataFrame, reviews: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """samples with their review's and token counts' columns; the three must have the same keys, each once."""
    tables = [unique_keys(t, key).withColumn(f"has{i}_", F.lit(True)) for i, t in enumerate((samples, reviews, tokens))]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), tables)
    whole = F.col("has0_") & F.col("has1_") & F.col("has2_")
    lone = F.raise_error(F.concat(F.lit("evidence isn't whole: "), F.col(key).cast("string"))).cast("boolean")
    return joined.filter(F.when(whole, True).otherwise(lone)).drop("has0_", "has1_", "has2_")


def comparable_pairs(df: DataFrame, key: str, *blocks: str, size: int = 1000) -> DataFrame:
    """(left, right): pairs with equal blocks (cohort, task, policy, database), left less than right. Rows of a block
    meet in pieces of `size`, dealt over tasks; pairs are what is asked for, so blocks should be small."""
    n = Window.partitionBy(*blocks)
    part = F.pmod(F.xxhash64(key), F.ceil(F.count("*").over(n) / size))
    rows = df.select(key, *blocks, part.alias("p_"))
    a, b = rows.select(F.col(key).alias("left"), *blocks, F.col("p_").alias("a_")), rows.select(F.col(key).alias("right"), *blocks, F.col("p_").alias("b_"))
    most = rows.groupBy(*blocks).agg(F.max("p_").alias("m_"))
    a = a.join(most, list(blocks)).withColumn("b_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_").cast("long")))).drop("m_", "a_")
    return a.join(b.withColumn("b_", F.col("b_").cast("long")), [*blocks, "b_"]).filter("left < right").select("left", "right")


def dedup_ledger(df: DataFrame, key: str, content: Column, *facts: str) -> DataFrame:
    """(identity, kept, aliases, n, facts as sorted sets): one row for each SHA-256 of the content, with the least key, all its
    keys and every value of the facts. Copies are as many as a record's aliases."""
    rows = df.withColumn("identity", F.sha2(content.cast("binary"), 256))
    return rows.groupBy("identity").agg(F.min(key).alias("kept"), F.array_sort(F.collect_set(key)).alias("aliases"), F.count("*").alias("n"), *(F.array_sort(F.collect_set(f)).alias(f) for f in facts))


def flagged(df: DataFrame, flags: dict[str, Column], name: str = "flags") -> DataFrame:
    """Adds `flags`, the names of the conditions that hold, in their order, and `accepted`, whether none does; null doesn't hold."""
    return df.withColumn(name, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))).withColumn("accepted", F.size(name) == 0)


def reviewed(df: DataFrame, reviews: DataFrame, key: str, identity: str, flags: dict[str, Column]) -> DataFrame:
    """df ⟕ reviews with flags and accepted; a row without a review, or with one of another content (reviewed_ identity), is an error."""
    joined = df.join(unique_keys(reviews, key).withColumnRenamed(identity, "reviewed_"), key, "left")
    why = F.when(F.col("reviewed_").isNull(), "no review: ").when(F.col("reviewed_") != F.col(identity), "a review of other content: ")
    ok = F.when(why.isNull(), True).otherwise(F.raise_error(F.concat(why, F.col(key).cast("string"))).cast("boolean"))
    return flagged(joined.filter(ok), flags).drop("reviewed_")


def decided(df: DataFrame, decisions: DataFrame, key: str, identity: str) -> DataFrame:
    """df with `decision` (keep or drop): decisions (key, identity, decision, reason) must have every row once, its identity and a reason."""
    joined = unique_keys(df, key).join(unique_keys(decisions, key).withColumnsRenamed({identity: "i_", "decision": "d_", "reason": "r_"}), key, "full_outer")
    why = (
        F.when(F.col("d_").isNull(), "undecided: ").when(F.col(identity).isNull(), "decided, but not there: ").when(F.col("i_") != F.col(identity), "another content: ")
        .when(~F.col("d_").isin("keep", "drop") | (F.coalesce("r_", F.lit("")) == ""), "no keep or drop with a reason: ")
    )
    checked = F.when(why.isNull(), F.col("d_")).otherwise(F.raise_error(F.concat(why, F.col(key).cast("string"))))
    return joined.withColumn("decision", checked).drop("i_", "d_", "r_")


def split_collisions(df: DataFrame, split: str, entities: str, text: str, held: str = "validation", train: str = "train") -> DataFrame:
    """(entity, kind): entities of held-out rows that training rows have too (shared), or have in their text (in_text).
    Words of texts are joined with entities; entities that aren't one word are looked for in blocks of a stated, bounded list."""
    own = df.select(F.col(split).alias("s_"), F.explode(F.array_distinct(entities)).alias("entity")).distinct()
    asked = own.filter(F.col("s_") == held).select("entity").filter("entity != ''")
    shared = asked.join(own.filter(F.col("s_") == train).select("entity"), "entity", "left_semi").select("entity", F.lit("shared").alias("kind"))
    texts = df.filter((F.col(split) == train) & F.col(text).isNotNull())
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), 1))).alias("entity")).distinct()
    plain = F.col("entity").rlike("^[A-Za-z0-9_]+$")
    inside = asked.filter(plain).join(words, "entity", "left_semi")
    rest = F.broadcast(_bounded(asked.filter(~plain), MOST_LISTED, "entities of several words"))
    hit = texts.select(text).join(rest, F.contains(F.col(text), F.col("entity"))).select("entity").distinct()
    return shared.union(inside.union(hit).distinct().select("entity", F.lit("in_text")))


def cohort_summary(df: DataFrame, cohort: str, flags: str = "flags") -> DataFrame:
    """(cohort, n, accepted, blocked, first_flag): rows without and with blocking flags, and the most frequent flag (the first by name among equals)."""
    n = df.groupBy(cohort).agg(F.count("*").alias("n"), F.count_if(F.size(flags) == 0).alias("accepted"))
    top = df.select(cohort, F.explode(flags).alias("f_")).groupBy(cohort, "f_").agg(F.count("*").alias("c_")).groupBy(cohort).agg(F.min_by("f_", F.struct(-F.col("c_"), "f_")).alias("first_flag"))
    return n.join(top, cohort, "left").withColumn("blocked", F.col("n") - F.col("accepted"))
