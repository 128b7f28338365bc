"""Queries over scored tool calls: an order is a dialogue, its line items are the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import scoring as S
from tidelane.plans.rollouts import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOOLS = S.Tools(reads=frozenset({"look", "status"}), writes=frozenset({"change"}), handoffs=frozenset({"transfer"}))
WEIGHTS = {"error": -0.1, "gold_exact": 1.0, "gold_read": 0.7, "gold_write": 0.9, "duplicate": -0.2, "soft_match": 0.5, "read_only": 0.0, "state_change": -0.1, "generic": 0.0, "unknown": 0.0, "message": 0.05}
LOOSE = S.Rules(WEIGHTS)
STRICT = S.Rules(WEIGHTS, execution=True, split=True, neutral_handoffs=True, mean=True)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    name = F.element_at(F.array(*map(F.lit, ("look", "change", "status", "transfer", "other"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return line.select(F.col("l_orderkey").alias("id"), step.alias("step"), name.alias("name"), (F.col("l_partkey") % 2).alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("supp"), F.col("l_linestatus").alias("status"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("supp") % 11 == 0, F.format_string('["%s", %d]', "flag", "part")).otherwise(F.format_string('{"part": %d, "flag": "%s", "items": [{"k": 2}, {"j": "%s"}]}', "part", "flag", "flag"))
    seen = F.when(F.col("supp") % 7 == 0, F.lit(" ")).otherwise(F.format_string('{"stock": %d}', F.col("supp") % 2))
    return _steps(spark, sf_dir).select("id", "step", F.floor((F.col("step") - 1) / 3).alias("turn"), "name", text.alias("arguments"), (F.col("qty") < 6).alias("error"), seen.alias("observation"), (F.col("qty") > 48).alias("truncated"))


def _gold(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """Gold actions are the calls with a status of F; every third one asks for another flag."""
    flag = F.when(F.col("supp") % 3 == 0, F.lit("Q")).otherwise(F.col("flag"))
    text = F.format_string(part, "part", flag, "flag")
    return _steps(spark, sf_dir).filter("status = 'F'").select("id", F.col("step").alias("place"), "name", text.alias("arguments"))


_STEPS = """s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step,
  ['look', 'change', 'status', 'transfer', 'other'][l_linenumber % 5 + 1] AS name, l_partkey % 2 AS part, l_returnflag AS flag, l_quantity < 6 AS error, l_quantity > 48 AS cut, l_suppkey AS supp, l_linestatus AS status FROM lineitem),
c AS (SELECT *, supp % 11 = 0 AS odd, CASE WHEN supp % 7 = 0 OR cut THEN NULL ELSE supp % 2 END AS seen FROM s),
g AS (SELECT id, step AS place, name, part, CASE WHEN supp % 3 = 0 THEN 'Q' ELSE flag END AS flag, flag AS item FROM s WHERE status = 'F'),
gn AS (SELECT *, row_number() OVER (PARTITION BY id, name, part, flag, item ORDER BY place) AS nth FROM g),"""
_OVERLAP = "o AS (SELECT c.id, c.step, max(((c.part = g.part)::INT + (c.flag = g.flag)::INT + (c.flag = g.item)::INT) / 3) AS overlap FROM c JOIN g ON c.id = g.id AND c.name = g.name WHERE NOT c.odd GROUP BY ALL)"
_LOOSE = f"""WITH {_STEPS}
n AS (SELECT *, row_number() OVER (PARTITION BY id, name, odd, part, flag, error ORDER BY step) AS nth FROM c), {_OVERLAP},
t AS (SELECT n.id, n.step, n.name, gn.place AS matched, coalesce(o.overlap, 0.0) AS overlap, CASE WHEN n.error THEN 'error' WHEN gn.place IS NOT NULL THEN 'gold_exact' WHEN n.nth > 1 THEN 'duplicate' WHEN o.overlap > 0 THEN 'soft_match'
  WHEN n.name IN ('look', 'status') THEN 'read_only' WHEN n.name IN ('change', 'transfer') THEN 'state_change' ELSE 'unknown' END AS tier
  FROM n LEFT JOIN gn ON NOT n.error AND NOT n.odd AND gn.id = n.id AND gn.name = n.name AND gn.part = n.part AND gn.flag = n.flag AND gn.item = n.flag AND gn.nth = n.nth LEFT JOIN o ON o.id = n.id AND o.step = n.step),
r AS (SELECT *, CASE tier WHEN 'error' THEN -0.1 WHEN 'gold_exact' THEN 1.0 WHEN 'duplicate' THEN -0.2 WHEN 'soft_match' THEN 0.5 * (1 + overlap) WHEN 'state_change' THEN -0.1 ELSE 0.0 END AS reward FROM t)"""
_STRICT = f"""WITH {_STEPS}
n AS (SELECT *, row_number() OVER w AS nth, lag(CASE WHEN name IN ('look', 'status') THEN seen END) OVER w AS last FROM c WINDOW w AS (PARTITION BY id, name, odd, part, flag, error ORDER BY step)), {_OVERLAP},
e AS (SELECT n.*, gn.place AS matched, o.overlap AS part_of, CASE WHEN n.error THEN 'execution_error' WHEN n.odd THEN 'invalid_successful_arguments' WHEN n.nth = 1 THEN 'first_success' WHEN n.name NOT IN ('look', 'status') THEN 'same_execution_arguments'
  WHEN n.seen IS NULL OR n.last IS NULL THEN 'read_response_unavailable' WHEN n.seen = n.last THEN 'read_response_unchanged' ELSE 'read_response_changed' END AS evidence
  FROM n LEFT JOIN gn ON NOT n.error AND NOT n.odd AND gn.id = n.id AND gn.name = n.name AND gn.part = n.part AND gn.flag = n.flag AND gn.item = n.flag AND gn.nth = n.nth LEFT JOIN o ON o.id = n.id AND o.step = n.step),
t AS (SELECT id, step, name, matched, CASE WHEN error OR odd THEN 0.0 ELSE coalesce(part_of, 0.0) END AS overlap, evidence, CASE WHEN error THEN 'error' WHEN odd THEN 'unknown' WHEN name = 'transfer' THEN 'generic'
  WHEN matched IS NOT NULL THEN CASE WHEN name IN ('look', 'status') THEN 'gold_read' WHEN name = 'change' THEN 'gold_write' ELSE 'gold_exact' END
  WHEN nth > 1 THEN CASE evidence WHEN 'read_response_unavailable' THEN 'unknown' WHEN 'read_response_changed' THEN 'read_only' ELSE 'duplicate' END
  WHEN part_of > 0 THEN 'soft_match' WHEN name IN ('look', 'status') THEN 'read_only' WHEN name = 'change' THEN 'state_change' ELSE 'unknown' END AS tier FROM e),
r AS (SELECT *, CASE tier WHEN 'error' THEN -0.1 WHEN 'gold_exact' THEN 1.0 WHEN 'gold_read' THEN 0.7 WHEN 'gold_write' THEN 0.9 WHEN 'duplicate' THEN -0.2 WHEN 'soft_match' THEN 0.5 * (1 + overlap) WHEN 'state_change' THEN -0.1 ELSE 0.0 END AS reward FROM t)"""
_ROUNDED = "round(overlap, 6)::DOUBLE AS overlap, round(reward, 6)::DOUBLE AS reward"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "step", "name", "matched", "tier", F.round("overlap", 6).alias("overlap"), F.round("reward", 6).alias("reward"), *more)


@query(f"{_LOOSE} SELECT id, step, name, matched, tier, {_ROUNDED} FROM r")
def call_tiers(spark, sf_dir):
    """By identity: gold actions write their numbers as text and have an empty entry, which don't matter."""
    gold = _gold(spark, sf_dir, '{"items": [{"k": "2.0"}, {}, {"j": "%3$s"}], "part": "%1$d", "flag": "%2$s", "none": []}')
    return _shown(S.score_calls(_calls(spark, sf_dir), gold, LOOSE, TOOLS))


@query(f"{_STRICT} SELECT id, step, name, matched, tier, {_ROUNDED}, evidence FROM r")
def executed_call_tiers(spark, sf_dir):
    """As the calls take effect, with the last observation of every read."""
    gold = _gold(spark, sf_dir, '{"items": [{"k": 2}, {"j": "%3$s"}], "part": %1$d, "flag": "%2$s"}')
    return _shown(S.score_calls(_calls(spark, sf_dir), gold, STRICT, TOOLS), "evidence")


@query(
    f"""{_STRICT}, m AS (SELECT id, (step - 1) // 3 AS turn, round(avg(reward), 6)::DOUBLE AS reward, string_agg(tier, ',' ORDER BY step) AS tiers FROM r GROUP BY ALL),
a AS (SELECT o_orderkey AS id, unnest([0, 1, 2]) AS turn FROM orders)
SELECT a.id, a.turn, coalesce(reward, 0.05) AS reward, coalesce(tiers, 'message') AS tiers FROM a LEFT JOIN m USING (id, turn)"""
)
def turn_scores(spark, sf_dir):
    gold = _gold(spark, sf_dir, '{"items": [{"k": 2}, {"j": "%3$s"}], "part": %1$d, "flag": "%2$s"}')
    scored = S.score_calls(_calls(spark, sf_dir), gold, STRICT, TOOLS)
    turns = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("turn"))
    got = S.turn_rewards(turns, scored, STRICT)
    return got.select("id", "turn", F.round("reward", 6).alias("reward"), F.array_join("tiers", ",").alias("tiers"))
