"""Queries over replayed actions: an order is a run, its line items act on one of three shelves of a nation's store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import replay as R
from tidelane.plans.rollouts import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOOLS = {
    "take": R.Tool(lambda s, a: s["stock"] >= a["qty"], lambda s, a: {"stock": s["stock"] - a["qty"], "sold": s["sold"] + a["qty"]}),
    "put_back": R.Tool(lambda s, a: s["sold"] >= a["qty"], lambda s, a: {"stock": s["stock"] + a["qty"], "sold": s["sold"] - a["qty"]}),
    "label": R.Tool(effect=lambda s, a: {"label": a["flag"]}),
    "clear": R.Tool(lambda s, a: s["sold"] == 0, deletes=True),
    "open": R.Tool(effect=lambda s, a: {"stock": a["qty"], "sold": F.lit(0)}, creates=True),
}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    return n.filter("n % 6 != 5").select(F.col("n").alias("entity"), (F.col("n") * 3 % 40 + 20).alias("stock"), F.lit(0).cast("long").alias("sold"), F.lit(None).cast("string").alias("label"))


def _actions(spark: SparkSession, sf_dir: str, gold: bool) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    line = read(spark, sf_dir, "lineitem").withColumn("step", step)  # before the rest, so that both sides share the shuffle
    at = F.array(*map(F.lit, ("take", "put_back", "take", "label", "clear", "open", "lose")))
    qty = F.col("l_quantity").cast("long") % 30
    name = F.get(at, (F.col("l_suppkey") % 7).cast("int"))
    return line.select(F.col("l_orderkey").alias("run"), "step", name.alias("name"), (F.col("l_orderkey") % 23 + F.col("l_partkey") % 2).alias("entity"), (F.when(F.col("l_partkey") % 10 == 3, qty + 1).otherwise(qty) if gold else qty).alias("qty"), F.col("l_returnflag").alias("flag"))


def _folded(name: str, qty: str) -> str:
    """SQL that takes the actions one after the other: state s of each run and entity after each step."""
    may = """CASE a.name WHEN 'take' THEN f.there AND f.stock >= a.qty WHEN 'put_back' THEN f.there AND f.sold >= a.qty WHEN 'label' THEN f.there WHEN 'clear' THEN f.there AND f.sold = 0 WHEN 'open' THEN NOT f.there ELSE false END"""
    then = lambda c, **at: f"CASE WHEN NOT ({may}) THEN f.{c} {' '.join(f'WHEN a.name = {k!r} THEN {v}' for k, v in at.items())} ELSE f.{c} END"
    return f"""{name}a AS (SELECT *, row_number() OVER (PARTITION BY run, entity ORDER BY step) AS k FROM (SELECT run, step, name, entity, {qty} AS qty, flag FROM acts)),
{name}f AS (SELECT DISTINCT run, entity, 0::BIGINT AS k, st.entity IS NOT NULL AS there, st.stock, st.sold, NULL::VARCHAR AS label, '' AS applied, '' AS failed FROM {name}a LEFT JOIN st USING (entity)
  UNION ALL SELECT f.run, f.entity, a.k, {then("there", clear="false", open="true")}, {then("stock", take="f.stock - a.qty", put_back="f.stock + a.qty", clear="NULL", open="a.qty")},
  {then("sold", take="f.sold + a.qty", put_back="f.sold - a.qty", clear="NULL", open="0")}, {then("label", label="a.flag", clear="NULL", open="NULL")}, f.applied || CASE WHEN {may} THEN ',' || a.step ELSE '' END, f.failed || CASE WHEN {may} THEN '' ELSE ',' || a.step END
  FROM {name}f f JOIN {name}a a ON a.run = f.run AND a.entity = f.entity AND a.k = f.k + 1),
{name} AS (SELECT DISTINCT ON (run, entity) * FROM {name}f ORDER BY run, entity, k DESC)"""


_ACTS = """WITH RECURSIVE st AS (SELECT n_nationkey::BIGINT AS entity, n_nationkey * 3 % 40 + 20 AS stock, 0::BIGINT AS sold FROM nation WHERE n_nationkey % 6 <> 5),
acts AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step, ['take', 'put_back', 'take', 'label', 'clear', 'open', 'lose'][l_suppkey % 7 + 1] AS name,
  l_orderkey % 23 + l_partkey % 2 AS entity, l_quantity::BIGINT % 30 AS qty, l_returnflag AS flag, l_partkey % 10 = 3 AS more FROM lineitem)"""


@query(f"{_ACTS}, {_folded('x', 'qty')} SELECT run, entity, there, stock, sold, label, applied[2:] AS applied, failed[2:] AS failed FROM x")
def replayed_states(spark, sf_dir):
    done = R.replayed(_state(spark, sf_dir), _actions(spark, sf_dir, False), TOOLS)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return done.select("run", "entity", F.col("after").isNotNull().alias("there"), "after.stock", "after.sold", "after.label", text("applied"), text("failed"))


@query(
    f"""{_ACTS}, {_folded('x', 'qty')}, {_folded('y', 'CASE WHEN more THEN qty + 1 ELSE qty END')},
d AS (SELECT x.run, x.entity, x.there IS DISTINCT FROM y.there OR x.stock IS DISTINCT FROM y.stock OR x.sold IS DISTINCT FROM y.sold OR x.label IS DISTINCT FROM y.label AS other, len(string_split(x.failed, ',')) - 1 AS lost, len(string_split(y.failed, ',')) - 1 AS gold_lost FROM x JOIN y USING (run, entity))
SELECT run, NOT bool_or(other) AS equal, (NOT bool_or(other))::INT::DOUBLE AS reward, sum(lost)::BIGINT AS failed, sum(gold_lost)::BIGINT AS gold_failed, coalesce(string_agg(entity::VARCHAR, ',' ORDER BY entity::VARCHAR) FILTER (other), '') AS differing FROM d GROUP BY run"""
)
def replayed_runs(spark, sf_dir):
    got = R.compared_runs(_state(spark, sf_dir), _actions(spark, sf_dir, False), _actions(spark, sf_dir, True), TOOLS)
    return got.withColumn("differing", F.array_join("differing", ","))
