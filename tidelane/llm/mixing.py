"""Operator 8: mixing sources to target weights by hierarchical budgets. DataFrame functions only.

A budget of tokens goes down a tree of domain, language and source. At each node it is
shared out by weight; a child that cannot use its share (its leaves hold too few tokens
for MAX_EPOCHS) keeps what it can use, and its siblings share the rest. Only when all
siblings are full does the shortage go to the node's own siblings: a node's limit is the
sum of its leaves'. A leaf takes whole epochs of its documents, and then, of one more
epoch in an order of its own, the documents that fit the rest of the budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import as_given, cut, set_aside, small, table

#: What the registered query takes: the order's seed, epochs, and the weights of the tree's levels.
SEED = 17
MAX_EPOCHS = 4
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 6, "de": 3, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
WEIGHTS = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
LEVELS = ["domain", "lang_", "source_"]
NEEDED = {"doc_id", "text", "lang", "source"}
#: Digits of the order's hash that make a bucket: prefix sums go over buckets first.
DIGITS = 3
NONE = "(none)"


def domain_of(source: str = "source") -> Column:
    """The tables name no domain: here it is the source's number modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("domain")).otherwise(F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")).cast("long") % 4).cast("string")))


def _weight(level: int, weights: dict[str | tuple[str, ...], int]) -> Column:
    """A child's weight: that of its whole path, or else of its name, or else 1."""
    listed = F.lit(1)
    for name, weight in sorted(weights.items(), key=lambda kv: isinstance(kv[0], tuple)):
        if not isinstance(weight, int) or weight < 1:
            raise ValueError(f"weights are whole numbers from 1 on, not {weight!r} of {name!r}")
        path = name if isinstance(name, tuple) else (name,)
        here = zip(LEVELS[level + 1 - len(path) : level + 1], path, strict=True)
        listed = F.when(reduce(lambda a, b: a & b, (F.col(c) == x for c, x in here)), weight).otherwise(listed)
    return listed.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `share`: the part of `budget` (equal for all children of a parent) that a child
    with `weight` and `limit` gets.

    Ordered by limit / weight, the children that stay at their limit come first: a child
    does so if its limit is no more than its weighted part of what those before it leave.
    The others share the rest by weight, rounded down to whole tokens.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rank = of.orderBy(F.col("limit") / F.col("weight"), child)
    before = F.coalesce(F.sum("limit").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("limit") * heavier <= (F.col("budget") - before) * F.col("weight")
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(of), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(of)
    part = F.expr("(left_ * weight) div open_weight")
    shared = children.withColumn("full", full).withColumn("left_", left).withColumn("open_weight", open_weight)
    return shared.withColumn("share", F.when(F.col("full"), F.col("limit")).otherwise(part)).drop("full", "left_", "open_weight", "budget")


def leaf_budgets(leaves: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, weights: tuple[dict, dict, dict] = WEIGHTS) -> DataFrame:
    """(domain, lang_, source_, available, share) for leaves with their available tokens.
    Without a budget, as many tokens are given out as there are."""
    leaves = leaves.withColumn("limit", F.col("available") * max_epochs)
    total = leaves.agg(F.coalesce(F.lit(budget).cast("long"), F.sum("available")).alias("budget"))
    at = leaves.groupBy("domain").agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(0, weights[0]))
    at = share_out(at.crossJoin(total), [], "domain").select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang_").agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(1, weights[1]))
    at = share_out(langs.join(at, "domain"), ["domain"], "lang_").select("domain", "lang_", F.col("share").alias("budget"))
    sources = leaves.withColumn("weight", _weight(2, weights[2])).join(at, ["domain", "lang_"])
    return share_out(sources, ["domain", "lang_"], "source_").select(*LEVELS, "available", "share")


def _placed(docs: DataFrame, domain: Column) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.withColumns({"domain": domain, "lang_": none("lang"), "source_": none("source"), "n_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def _ordered(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the place in the order of the leaf's last epoch, and its bucket."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).cast("binary"))
    return docs.withColumn("order_", key).withColumn("bucket", F.substring("order_", 1, DIGITS))


def mix_sources(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, weights: tuple[dict, dict, dict] = WEIGHTS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """The rows of docs that are taken, with `domain`, `n_tokens` and `repeats`, how often each is taken.

    budget is in tokens (None: as many as there are). weights has a dict for each level of the
    tree, domain, language and source: a child's target weight among its siblings, a whole
    number from 1 on, by its name, or by its path ("domain0", "en") where that is to differ;
    children that aren't listed weigh 1. seed gives the order of epochs. domain is a column of
    docs' doc_id, text, lang and source (None: domain_of).

    docs has doc_id, text, lang and source; other columns stay, whatever their names, and any
    named domain, n_tokens or repeats are replaced. Tokens are words between ASCII white space. A null
    language or source is a leaf of its own. Texts without tokens are never taken. Repeated
    rows are taken together or not at all; among rows with one doc_id the order follows
    the text's hash. Of the last epoch go the documents whose running total fits the budget, so a leaf
    falls short of it by less than one document. No rows give no rows.

    Totals are pre-aggregated by leaf and bucket, and running totals go over buckets; only
    rows of the one bucket in which a leaf's budget ends are ordered one by one.
    """
    docs = docs.drop("domain", "n_tokens", "repeats")
    domain = domain_of() if domain is None else domain
    placed = cut(_placed(docs.select("doc_id", "text", "lang", "source"), domain).filter("n_tokens > 0").select("doc_id", F.xxhash64("text").alias("text_key"), *LEVELS, "n_tokens"))
    leaves = cut(placed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")))
    given = leaf_budgets(leaves, budget, max_epochs, weights)
    given = small(given.select(*LEVELS, F.expr("share div available").alias("epochs"), (F.col("share") % F.col("available")).alias("rest")))

    filled = _ordered(placed.join(given, LEVELS), seed)
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = filled.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    last = small(totals.filter("before <= rest AND before + n > rest").select(*LEVELS, F.col("bucket").alias("last"), (F.col("rest") - F.col("before")).alias("room")))
    fine = Window.partitionBy(*LEVELS).orderBy("order_", "doc_id", "text_key")
    edge = filled.join(last, LEVELS).filter("bucket = last").withColumn("upto", F.sum("n_tokens").over(fine))  # equal rows count together
    edge = edge.filter("upto <= room").groupBy(F.col("doc_id").alias("of_"), F.col("text_key").alias("key_"), *(F.col(c).alias(f"{c}k_") for c in LEVELS)).agg(F.count("*").alias("fit"))
    edge = small(edge)

    rows = _ordered(_placed(set_aside(docs, NEEDED), domain).filter("n_tokens > 0").join(given, LEVELS).join(last, LEVELS, "left"), seed)
    same = rows["doc_id"].eqNullSafe(edge["of_"]) & (F.xxhash64(rows["text"]) == edge["key_"])
    for c in LEVELS:
        same = same & (rows[c] == edge[f"{c}k_"])
    rows = rows.join(edge, same & (rows["bucket"] == rows["last"]), "left")
    more = F.when(F.col("bucket") < F.col("last"), 1).when(F.col("fit").isNotNull(), 1).otherwise(0)
    taken = rows.withColumn("repeats", (F.col("epochs") + more).cast("long")).filter("repeats > 0")
    return taken.select(*as_given(docs.columns, NEEDED), "domain", "n_tokens", "repeats")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "repeats")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(name: str, table_: str, parent: str, child: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}1 AS (SELECT *, cap * sum(weight) OVER ({by} ORDER BY cap / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM {table_}),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN filled THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0)) * weight) // (sum(weight) FILTER (NOT filled) OVER ({by})) END AS share FROM {name}1)"""


ORACLE_SQL = {
    "op8_mix_sources": rf"""
WITH d0 AS (SELECT doc_id, lang, source, coalesce(lang, '{NONE}') AS lang_, coalesce(source, '{NONE}') AS source_, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS num,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN num = '' THEN 'domain' ELSE 'domain' || CAST(CAST(num AS BIGINT) % 4 AS VARCHAR) END AS domain FROM d0 WHERE n_tokens > 0),
leaf AS (SELECT domain, lang_, source_, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
c1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(sum(available) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_share_sql("s1", "c1", "", "domain")},
c2 AS (SELECT domain, lang_, CAST(sum(leaf.cap) AS BIGINT) AS cap, {_case("lang_", LANG_WEIGHTS)} AS weight, any_value(s1.share) AS budget FROM leaf JOIN s1 USING (domain) GROUP BY domain, lang_),
{_share_sql("s2", "c2", "domain", "lang_")},
c3 AS (SELECT leaf.*, {_case("source_", SOURCE_WEIGHTS)} AS weight, s2.share AS budget FROM leaf JOIN s2 USING (domain, lang_)),
{_share_sql("s3", "c3", "domain, lang_", "source_")},
g AS (SELECT domain, lang_, source_, share // available AS epochs, share % available AS rest FROM s3),
o AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang_, source_ ORDER BY md5('{SEED}:' || CAST(CAST(epochs AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), doc_id
  ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN g USING (domain, lang_, source_))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM o WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
}
