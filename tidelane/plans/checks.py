"""Queries that check documents and trajectories made of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions.json_schema import call_findings
from tidelane.operators import groups as G
from tidelane.operators import raw_rows as W
from tidelane.operators import sensitivity as V
from tidelane.operators import trajectories as J
from tidelane.plans.rollouts import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_ORDER = {
    "$defs": {"amount": {"type": "number", "exclusiveMinimum": 0}},
    "type": "object", "required": ["key", "status", "more"], "additionalProperties": False,
    "properties": {
        "key": {"type": "integer", "maximum": 5000}, "status": {"enum": ["F", "O"]}, "price": {"$ref": "#/$defs/amount"}, "list": {"type": "array", "items": {"type": "integer"}},
        "more": {"type": "object", "required": ["time"], "properties": {"date": {"type": "string", "pattern": "^199"}}},
    },
}


@query("""SELECT o_orderkey, '' AS path, 'unknown tool' AS finding FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, '', 'not JSON' FROM orders WHERE o_orderkey % 11 = 1
UNION ALL (WITH o AS (SELECT * FROM orders WHERE o_orderkey % 11 > 1) SELECT o_orderkey, '/key', 'maximum' FROM o WHERE o_orderkey > 5000
UNION ALL SELECT o_orderkey, '/status', 'enum' FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, '/price', 'type' FROM o WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, '/price', 'exclusiveMinimum' FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, '/list/1', 'type' FROM o WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, '/more', 'required: time' FROM o WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, '', 'additional: zip' FROM o WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, '/more/date', 'pattern' FROM o WHERE year(o_orderdate) >= 2000)""")
def schema_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    price = F.when(k % 3 == 0, F.format_string('"%d"', F.col("o_custkey"))).when(k % 3 == 1, F.lit("0")).otherwise(F.format_string("%d.50", F.col("o_custkey")))
    second = F.when(F.col("o_custkey") % 2 == 0, F.lit('"x"')).otherwise(F.lit("7"))
    tail = F.concat(F.when(k % 4 == 0, F.lit(', "time": 1')).otherwise(""), F.lit("}"), F.when(k % 5 == 0, F.lit(', "zip": null')).otherwise(""), F.when(k % 11 == 1, F.lit("")).otherwise("}"))
    text = F.format_string('{"key": %d, "status": "%s", "price": %s, "list": [1, %s], "more": {"date": "%s"%s', k, "o_orderstatus", price, second, F.to_date("o_orderdate").cast("string"), tail)
    found = call_findings(F.when(k % 11 == 0, "ship").otherwise("order"), text, {"order": _ORDER})
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select("o_orderkey", "x.path", "x.finding")  # outer: Spark would first filter by what is exploded


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 4 + 2 AS a, o_orderkey % 3 + 1 AS b FROM orders), s AS (SELECT *, 2 * a + b AS n FROM o)
SELECT k, CASE WHEN k % 7 = 0 THEN 'spans overlap or include observations' WHEN k % 7 = 1 THEN 'spans do not cover generated tokens' WHEN k % 7 = 2 THEN 'invalid span' END AS problem,
  CASE WHEN k % 7 > 2 THEN least(a, a + b + a - b) || ',' || least(a, a) END AS kept, CASE WHEN k % 7 > 2 THEN (k % 2)::BIGINT END AS discarded FROM s""")
def trajectory_spans(spark, sf_dir):
    """Two spans of a tokens with b observed ones between; the last one may go one token further than what was retained."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4 + 2).alias("a"), (F.col("o_orderkey") % 3 + 1).alias("b"))
    of = F.col("k") % 7
    mask = F.concat(F.array_repeat(F.lit(1), F.col("a").cast("int")), F.array_repeat(F.lit(0), F.col("b").cast("int")), F.array_repeat(F.lit(1), F.col("a").cast("int")))
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    first = span(F.lit(0), F.when(of == 0, F.col("a") + 1).when(of == 1, F.col("a") - 1).otherwise(F.col("a")))
    last = span(F.when(of == 2, -1).otherwise(F.col("a") + F.col("b")), 2 * F.col("a") + F.col("b") + F.col("k") % 2)
    got = J.retained_spans(o.withColumns({"mask": mask, "ids": mask, "spans": F.array(first, last)}), "ids", "mask", "spans")
    size = F.array_join(F.transform("retained", lambda s: (s["end"] - s["start"]).cast("string")), ",")
    return got.select("k", "problem", F.when(F.col("problem").isNull(), size).alias("kept"), F.when(F.col("problem").isNull(), F.aggregate("discarded", F.lit(0).cast("long"), lambda s, x: s + x)).alias("discarded"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 AS shape, 't' || o_custkey AS task, CASE o_orderstatus WHEN 'F' THEN 'user_stop' WHEN 'O' THEN 'max_steps' ELSE 'infrastructure_error' END AS ended,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey % 2 WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS score FROM orders),
p AS (SELECT *, ended <> 'user_stop' AND score = 1 AS bad, ended <> 'infrastructure_error' AS complete FROM o), q AS (SELECT *, complete AND score = 0 AS lost FROM p)
SELECT k, CASE WHEN bad THEN 'unscored run has an outcome' END AS problem, CASE WHEN NOT bad THEN task END AS task_id, CASE WHEN NOT bad THEN score::DOUBLE END AS score,
  CASE WHEN NOT bad THEN CASE ended WHEN 'user_stop' THEN 'officially_scored' WHEN 'max_steps' THEN 'budget_limit' ELSE 'infrastructure_error' END END AS category, CASE WHEN NOT bad THEN ended = 'user_stop' END AS scored,
  CASE WHEN NOT bad AND complete THEN score = 1 END AS success, CASE WHEN NOT bad THEN concat_ws(',', CASE WHEN NOT complete THEN 'infrastructure_error' END, CASE WHEN lost AND shape = 2 THEN 'no_tool_calls_observed_on_failure' END,
  CASE WHEN shape = 1 THEN 'repeated_call_signature' END, CASE WHEN ended = 'max_steps' THEN 'turn_or_time_limit' END, CASE WHEN lost AND shape < 2 THEN 'write_attempt_on_failure' END, CASE WHEN shape = 0 THEN 'write_attempt_without_later_read' END) END AS labels,
  CASE WHEN NOT bad THEN ['messages', 'simulation.messages', 'trajectory_facts'][shape + 1] END AS source, CASE WHEN NOT bad THEN CASE shape WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END::BIGINT END AS calls FROM q""")
def normalized_rows(spark, sf_dir):
    """Orders as flat rows, as simulations and as trajectory facts in a text, made one shape."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    end = F.when(F.col("o_orderstatus") == "F", "user_stop").when(F.col("o_orderstatus") == "O", "max_steps").otherwise("infrastructure_error")
    score = F.when(F.col("o_orderstatus") == "F", cust % 2).when(k % 10 == 0, 1).otherwise(0)
    flat = F.format_string('{"task_id": "t%d", "score": %d, "termination_reason": "%s", "messages": [{"role": "assistant", "tool_calls": [{"name": "look"}, {"function": {"name": "change", "arguments": "{}"}}]}]}', cust, score, end)
    whole = F.format_string('{"simulation": {"task_id": "t%d", "termination_reason": "%s", "reward_info": {"reward": %d.0}, "messages": [{"role": "assistant", "tool_calls": [{"name": "change"}, {"name": "look"}, {"tool_name": "look"}]}, {"role": "user"}]}}', cust, end, score)
    inner = F.format_string('{"identity": {"task_id": "t%d"}, "terminal": {"reward": %d, "termination_reason": "%s"}, "turns": [{"tool_calls": []}]}', cust, score, end)
    facts = F.to_json(F.struct(inner.alias("trajectory_facts_json")))
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, flat).when(k % 3 == 1, whole).otherwise(facts).alias("raw"))
    got = W.normalized_rows(rows, "raw", ["look"], ["change"])
    return got.select("k", "problem", "task_id", "score", F.col("eligibility_category").alias("category"), "scored", "success", F.array_join("labels", ",").alias("labels"), F.col("tool_evidence_source").alias("source"), F.col("tool_call_count").alias("calls"))


@query("""WITH r AS (SELECT l_quantity AS a, l_discount * 100 AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 100 ELSE 0 END AS c, (l_returnflag = 'R')::INT AS y, l_linestatus = 'F' AS ok FROM lineitem),
k AS (SELECT 'recorded' AS rows, * FROM r UNION ALL SELECT 'scored', * FROM r WHERE ok), m AS (SELECT *, CASE WHEN m % 2 = 1 THEN a ELSE 0 END + CASE WHEN m // 2 % 2 = 1 THEN b ELSE 0 END + CASE WHEN m // 4 = 1 THEN c ELSE 0 END AS x FROM k, (SELECT unnest(range(1, 8)) AS m))
SELECT rows, concat_ws('+', CASE WHEN m % 2 = 1 THEN 'quantity' END, CASE WHEN m // 2 % 2 = 1 THEN 'discount' END, CASE WHEN m // 4 = 1 THEN 'tax' END) AS subset, count(*) AS n, sum(y)::DOUBLE AS successes, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS deviation, round(corr(x, y), 6) AS correlation FROM m GROUP BY rows, m""")
def subset_sensitivity(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 100).alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linestatus") == "F").alias("ok"))
    got = V.subset_correlations(rows, ["quantity", "discount", "tax"], "y", "ok")
    return got.select("rows", F.array_join("subset", "+").alias("subset"), "n", "successes", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"), F.round("correlation", 6).alias("correlation"))


@query("SELECT o_orderkey, o_orderkey % 4 AS member, o_orderkey // 4 AS \"group\", (o_orderkey // 4 % 7)::INT AS worker, o_orderkey // 4 // 7 * 4 + o_orderkey % 4 AS slot FROM orders")
def dealt_groups(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("g"), F.floor(F.col("o_orderkey") / 4)).alias("uid"))
    return G.deal_groups(o, "uid", "o_orderkey", 4, 7).drop("uid")


@query("""WITH g AS (SELECT o_orderkey AS k, o_orderkey // 4 AS g, o_custkey % 5 AS reward FROM orders), v AS (SELECT k, (reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6) AS v FROM g WINDOW w AS (PARTITION BY g))
SELECT k, round(v, 5) AS value, CASE k % 6 WHEN 1 THEN '0' WHEN 2 THEN '2' ELSE '' END AS wrong FROM v""")
def replayed_estimates(spark, sf_dir):
    """Saved estimates of which some are off by a tenth, and some lack the last token."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 4).alias("g"), (F.col("o_custkey") % 5).alias("reward"), F.array(F.lit(1), F.lit(0), F.lit(1)).alias("response_mask"))
    own = Window.partitionBy("g")
    value = (F.col("reward") - F.avg("reward").over(own)) / (F.stddev_samp("reward").over(own) + 1e-6)
    said = o.withColumn("v", value).withColumn("advantages", F.when(F.col("k") % 6 == 1, F.array(F.col("v") + 0.1, F.lit(0.0), F.col("v"))).when(F.col("k") % 6 == 2, F.array(F.col("v"), F.lit(0.0))).otherwise(F.array("v", F.lit(0.0), "v")))
    got = G.replay_estimates(said, "g", "k", 4)
    return got.select("k", F.round("value", 5).alias("value"), F.array_join(F.transform("differences", lambda d: d["position"].cast("string")), ",").alias("wrong"))
