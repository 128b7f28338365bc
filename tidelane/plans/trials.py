"""Queries over evaluations: trials are orders (a customer is a task), checks are their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import evaluation as V
from tidelane.plans.credits import rounded
from tidelane.plans.rollouts import TRIALS, read, trials

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REASONS = ["agent_stop", "user_stop", "max_steps", "too_many_errors", "infrastructure_error", "other"]
_RUN = f"s AS (SELECT o_orderkey AS sim_id, o_custkey AS task_id, {_REASONS}[o_orderkey % 6 + 1] AS reason, CASE WHEN o_orderkey % 6 < 2 AND o_orderkey % 5 < 2 THEN 1.0 ELSE 0.0 END AS reward, o_totalprice / 1000 AS cost, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS db_match, CASE o_orderkey % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'not_needed' END AS auth FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    reward = F.when((k % 6 < 2) & (k % 5 < 2), 1.0).otherwise(0.0)
    return read(spark, sf_dir, "orders").select(
        k.alias("sim_id"), F.col("o_custkey").alias("task_id"), pick(_REASONS, k % 6).alias("termination_reason"), reward.alias("reward"), (F.col("o_totalprice") / 1000).alias("cost"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("db_match"), pick(["succeeded", "failed", "not_needed", None, None], k % 5).alias("auth")
    )


_CHECK = "c AS (SELECT l_orderkey AS sim_id, l_quantity > 10 AS matched, CASE WHEN l_linenumber % 2 = 0 THEN 'read' ELSE 'write' END AS kind, ['DB', 'ACTION', 'COMMUNICATE'][l_linenumber % 3 + 1] AS component, CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END AS reward FROM lineitem)"


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    component = F.get(F.array(*map(F.lit, ["DB", "ACTION", "COMMUNICATE"])), (F.col("l_linenumber") % 3).cast("int"))
    hit = F.col("l_quantity") > 10
    return li.select(F.col("l_orderkey").alias("sim_id"), hit.alias("matched"), F.when(F.col("l_linenumber") % 2 == 0, "read").otherwise("write").alias("kind"), component.alias("component"), hit.cast("double").alias("reward"))


@query(f"WITH {_RUN} SELECT sim_id, CASE reason WHEN 'infrastructure_error' THEN 'infrastructure_error' WHEN 'agent_stop' THEN 'officially_scored' WHEN 'user_stop' THEN 'officially_scored' WHEN 'max_steps' THEN 'budget_limit' WHEN 'too_many_errors' THEN 'unscored_failure' ELSE 'unknown_termination' END AS category, reason IN ('agent_stop', 'user_stop') AS officially_scored, reason NOT IN ('infrastructure_error', 'other') AS eligible FROM s")
def execution_eligibility(spark, sf_dir):
    return V.eligibility(runs(spark, sf_dir)).select("sim_id", "category", "officially_scored", "eligible")


@query(f"WITH {_RUN} SELECT sim_id, CASE WHEN reward > 0 THEN 'none' WHEN reason = 'max_steps' THEN 'turn_limit' WHEN reason = 'too_many_errors' THEN 'tool_errors' WHEN reason = 'infrastructure_error' THEN 'infrastructure' WHEN reason = 'other' THEN 'unfinished' WHEN sim_id % 7 > 3 THEN 'tool_errors' ELSE 'wrong_outcome' END AS failure FROM s")
def failure_categories(spark, sf_dir):
    errors = F.when(F.col("sim_id") % 7 > 3, 1).otherwise(0)
    return runs(spark, sf_dir).select("sim_id", V.failure_category(F.col("reward"), F.col("termination_reason"), errors).alias("failure"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def source_isolation(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").filter("o_orderstatus != 'P'")
    return V.trainable_only(o, "o_orderstatus", ["F", "O"])


@query(f"WITH {TRIALS} SELECT task_id, trial, o_orderkey AS seed, CASE WHEN o_orderkey % 5 > 1 THEN reward END AS reward, CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'failed' ELSE 'scored' END AS status FROM t")
def checked_plan(spark, sf_dir):
    t = trials(spark, sf_dir).select("task_id", F.col("trial").cast("long").alias("trial"), F.col("o_orderkey").alias("seed"), "reward", F.lit("agent_stop").alias("termination_reason"))
    return V.checked_results(t, t.filter("seed % 5 > 1"), t.filter("seed % 5 = 1"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS strict, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS lenient FROM orders)
SELECT 'strict' AS metric, count(*) AS planned, count(*) AS scored, true AS complete, round(avg(strict), 6) AS solve_rate, count(*) FILTER (lenient > strict) AS only_lenient FROM t UNION ALL SELECT 'lenient', count(*), count(*), true, round(avg(lenient), 6), count(*) FILTER (lenient > strict) FROM t""")
def dual_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6 == 0).cast("int").alias("strict"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("lenient"))
    return rounded(V.dual_summary(o), "solve_rate")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def task_enrichment(spark, sf_dir):
    tasks = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("task_id"), "c_name", "c_mktsegment")
    sims = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id"))
    return V.task_info(sims, tasks).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"WITH {TRIALS} SELECT task_id, c_name, n, c, c / n AS pass_hat_1, CASE WHEN n >= 2 THEN round(c * (c - 1) / (n * (n - 1)), 6) END AS pass_hat_2 FROM tc JOIN customer ON task_id = c_custkey".replace("c / n AS", "round(c / n, 6) AS"))
def task_pass_table(spark, sf_dir):
    tasks = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), "c_name")
    return rounded(V.pass_table(trials(spark, sf_dir), tasks, (1, 2)), "pass_hat_1", "pass_hat_2")


_PART = ", ".join(f"count(*) FILTER ({on} AND matched) AS {n}_correct, count(*) FILTER ({on}) AS {n}_count, round(count(*) FILTER ({on} AND matched) / nullif(count(*) FILTER ({on}), 0), 6) AS {n}_proportion" for n, on in (("total", "true"), ("read", "kind = 'read'"), ("write", "kind = 'write'")))


@query(f"WITH {_CHECK} SELECT sim_id, {_PART} FROM c GROUP BY sim_id")
def partial_action_rewards(spark, sf_dir):
    return rounded(V.partial_actions(checks(spark, sf_dir), "sim_id"), "total_proportion", "read_proportion", "write_proportion")


@query(f"WITH {_CHECK}, p AS (SELECT sim_id, coalesce(product(reward) FILTER (component = 'DB'), 1) AS DB, coalesce(product(reward) FILTER (component = 'ACTION'), 1) AS ACTION FROM c GROUP BY sim_id) SELECT sim_id, DB, ACTION, DB * ACTION AS reward FROM p")
def recombined_rewards(spark, sf_dir):
    return V.component_rewards(checks(spark, sf_dir), ["DB", "ACTION"])


@query(f"""WITH {_RUN}, {_CHECK}, p AS (SELECT sim_id, component, product(reward) AS r FROM c GROUP BY ALL), w AS (SELECT sim_id, coalesce(max(r) FILTER (component = 'DB'), 1) AS db, coalesce(max(r) FILTER (component = 'COMMUNICATE'), 1) AS co FROM p GROUP BY 1)
SELECT sim_id, CASE WHEN reason NOT IN ('agent_stop', 'user_stop') THEN 0.0 WHEN sim_id % 4 = 0 THEN 1.0 ELSE coalesce(db, 1) * coalesce(co, 1) END AS reward, CASE WHEN reason IN ('agent_stop', 'user_stop') AND sim_id % 4 <> 0 THEN 2 ELSE 0 END AS components FROM s LEFT JOIN w USING (sim_id)""")
def simulation_rewards(spark, sf_dir):
    basis = F.when(F.col("sim_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("DB"), F.lit("COMMUNICATE")))
    out = V.simulation_reward(runs(spark, sf_dir).withColumn("basis", basis), checks(spark, sf_dir))
    return out.select("sim_id", "reward", F.coalesce(F.size("breakdown"), F.lit(0)).alias("components"))


@query(f"WITH {_RUN} SELECT sim_id, CASE WHEN reason IN ('agent_stop', 'user_stop') AND sim_id % 2 = 0 THEN CASE WHEN sim_id % 3 = task_id % 3 THEN 1.0 ELSE 0.0 END * 0.5 ELSE reward END AS selected FROM s")
def terminal_rewards(spark, sf_dir):
    basis = F.when(F.col("sim_id") % 2 == 0, F.array(F.lit("DB"), F.lit("ACTION"))).otherwise(F.array(F.lit("ACTION")))
    r = runs(spark, sf_dir).withColumns({"scored": F.lit(True), "basis": basis, "breakdown": F.create_map(F.lit("DB"), F.lit(1.0), F.lit("ACTION"), F.lit(0.5)), "predicted_hash": F.col("sim_id") % 3, "reference_hash": F.col("task_id") % 3})
    return V.terminal_reward(r, "outcome").select("sim_id", "selected")


_SEV = ["critical", "minor", None, "odd", "critical_helped"]


@query("""WITH e AS (SELECT o_custkey AS sim_id, o_orderkey AS no, CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE 'user' END AS source, coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' WHEN 3 THEN 'odd' WHEN 4 THEN 'critical_helped' END, 'unknown') AS sev, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 11 END AS pos FROM orders),
f AS (SELECT *, (source = 'agent' AND sev = 'critical') OR (source = 'user' AND sev LIKE 'critical_%') AS crit, coalesce(CAST(pos AS DOUBLE), 'infinity'::DOUBLE) AS p FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY sim_id, crit ORDER BY p, no) AS r FROM f)
SELECT sim_id, coalesce(max(CASE WHEN source = 'agent' AND crit THEN sev END), max(CASE WHEN source = 'agent' AND sev = 'minor' THEN sev END), min_by(sev, no) FILTER (source = 'agent'), 'none') AS max_agent_severity,
  coalesce(max_by(sev, no) FILTER (source = 'user' AND crit), max(CASE WHEN source = 'user' AND sev = 'minor' THEN sev END), min_by(sev, no) FILTER (source = 'user'), 'none') AS max_user_severity, coalesce(max(CASE WHEN crit AND r = 1 THEN source END), 'none') AS first_critical_source FROM k GROUP BY sim_id""")
def review_severities(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sim_id"), k.alias("no"), F.when(k % 2 == 0, "agent").otherwise("user").alias("source"), F.get(F.array(*map(F.lit, _SEV)), (k % 5).cast("int")).alias("severity"), F.when(k % 3 != 0, k % 11).alias("position"))
    return V.review_severity(o)


@query(f"""WITH {_RUN}, {_CHECK}, r AS (SELECT * FROM s WHERE reason <> 'infrastructure_error'), t AS (SELECT task_id, count(*) AS n, count(*) FILTER (reward = 1) AS c FROM r GROUP BY 1),
p AS (SELECT count(*) AS total_tasks, CASE WHEN min(n) >= 1 THEN round(avg(c / n), 6) END AS pass_hat_1, CASE WHEN min(n) >= 2 THEN round(avg(c * (c - 1) / (n * (n - 1))), 6) END AS pass_hat_2 FROM t),
a AS (SELECT count(*) FILTER (kind = 'read' AND matched) AS read_correct, count(*) FILTER (kind = 'read') AS read_count, count(*) FILTER (kind = 'write' AND matched) AS write_correct, count(*) FILTER (kind = 'write') AS write_count FROM c JOIN r USING (sim_id)),
k AS (SELECT count(*) AS total_simulations, round(avg(reward), 6) AS avg_reward, round(avg(cost), 4) AS avg_agent_cost, count(*) FILTER (db_match) AS db_match, count(*) FILTER (NOT db_match) AS db_mismatch, count(*) FILTER (db_match IS NULL) AS db_not_checked, count(*) FILTER (auth = 'succeeded') AS auth_succeeded, count(*) FILTER (auth = 'failed') AS auth_failed, count(*) FILTER (auth = 'not_needed') AS auth_not_needed, count(*) FILTER (auth IS NULL) AS auth_not_checked,
  count(*) FILTER (reason = 'user_stop') AS termination_user_stop, count(*) FILTER (reason = 'agent_stop') AS termination_agent_stop, count(*) FILTER (reason = 'max_steps') AS termination_max_steps, count(*) FILTER (reason = 'too_many_errors') AS termination_error FROM r)
SELECT *, round(read_correct / read_count, 6) AS read_proportion, round(write_correct / write_count, 6) AS write_proportion, (SELECT count(*) FROM s WHERE reason = 'infrastructure_error') AS infra_errors FROM k, p, a""")
def agent_metrics(spark, sf_dir):
    out = V.agent_metrics(runs(spark, sf_dir), checks(spark, sf_dir), (1, 2))
    return rounded(rounded(out, "avg_reward", "pass_hat_1", "pass_hat_2", "read_proportion", "write_proportion"), "avg_agent_cost", digits=4)


@query(f"""WITH {TRIALS}, k AS (SELECT c_mktsegment AS intent, c, n FROM tc JOIN customer ON task_id = c_custkey WHERE c_mktsegment <> 'MACHINERY'), d AS (SELECT DISTINCT c_mktsegment AS intent FROM customer),
g AS (SELECT intent, count(*) AS tasks, avg(c / n) AS a, stddev_samp(c / n) AS s FROM k GROUP BY 1) SELECT intent, coalesce(tasks, 0) AS tasks, round(coalesce(a, 0), 6) AS pass_hat_1, round(s, 6) AS pass_hat_1_std FROM d LEFT JOIN g USING (intent)""")
def pass_by_intent(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("intent"))
    out = V.grouped_pass(trials(spark, sf_dir).join(c.filter("intent != 'MACHINERY'"), "task_id"), ["intent"], [1], domain=c)
    return rounded(out, "pass_hat_1", "pass_hat_1_std")


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_tax END), 6) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_tax END), 6) AS O, count(*) AS frequency FROM lineitem GROUP BY 1")
def action_pivot(spark, sf_dir):
    return rounded(V.pivot_rates(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], F.col("l_tax")), "F", "O")


@query("WITH k AS (SELECT o_orderstatus, o_orderkey % 3 AS kind, count(*) AS n FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM k")
def failure_shares(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("kind", F.col("o_orderkey") % 3)
    return rounded(V.shares(o, "kind", "o_orderstatus"), "share")


@query("SELECT l_returnflag, CAST(least(floor(l_quantity / 50 * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def binned_accuracy(spark, sf_dir):
    out = V.binned(read(spark, sf_dir, "lineitem").withColumn("part", F.col("l_quantity") / 50), "part", 10, "l_returnflag")
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("""WITH m AS (SELECT o_orderstatus AS llm, l_orderkey AS run, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice END AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey), r AS (SELECT llm, run, CASE WHEN count(*) = count(cost) THEN sum(cost) END AS c FROM m GROUP BY ALL)
SELECT llm, count(c) AS runs, round(avg(c), 2) AS mean_cost, round(sum(c), 2) AS total_cost FROM r GROUP BY 1""")
def run_costs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    m = li.select(F.col("o_orderstatus").alias("llm"), F.col("l_orderkey").alias("run"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice")).alias("cost"))
    out = V.costs(m, "run", "llm")
    return out.select("llm", "runs", F.round("mean_cost", 2).alias("mean_cost"), F.round("total_cost", 2).alias("total_cost"))


@query("""WITH t AS (SELECT o_custkey AS task_id, o_orderstatus AS e, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS r FROM orders), p AS (SELECT task_id, avg(r) FILTER (e = 'F') AS F, avg(r) FILTER (e = 'O') AS O FROM t GROUP BY 1)
SELECT task_id, round(F, 6) AS F, round(O, 6) AS O, CASE WHEN F IS NULL OR O IS NULL THEN 'missing' WHEN F = 1 AND O = 1 THEN 'all_solved' WHEN F <= 1e-6 AND O <= 1e-6 THEN 'none_solved' ELSE 'mixed' END AS label FROM p""")
def task_reward_matrix(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("experiment"), (F.col("o_orderkey") % 2 == 0).cast("double").alias("reward"))
    return rounded(V.reward_matrix(o, ["F", "O"]), "F", "O")


@query("WITH p AS (SELECT o_orderstatus AS panel, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice END AS score, 1 AS n FROM orders) SELECT panel, round(avg(score), 3) AS score, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1")
def cross_domain_panel(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("panel"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")).alias("score"), F.lit(1).alias("n"))
    return rounded(V.cross_domain(o, ["score"], ["n"], "panel"), "score", digits=3)


@query("""WITH m AS (SELECT user_id AS run, event_id AS o, CASE WHEN event_type = 'click' THEN 'assistant' WHEN event_type = 'view' THEN 'tool' ELSE 'user' END AS role, event_id % 2 AS cid, event_id % 5 = 0 AS err FROM events),
w AS (SELECT run, o, cid, CASE WHEN role = 'assistant' THEN 1 ELSE -1 END AS s, err FROM m WHERE role <> 'user'), l AS (SELECT *, sum(s) OVER (PARTITION BY run, cid ORDER BY o ROWS UNBOUNDED PRECEDING) AS level FROM w),
f AS (SELECT *, s < 0 AND level < least(0, coalesce(min(level) OVER (PARTITION BY run, cid ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lone FROM l),
t AS (SELECT run, count(*) FILTER (s > 0) AS calls, count(*) FILTER (s < 0 AND NOT lone) AS responses, count(*) FILTER (s < 0 AND NOT lone AND err) AS errors, count(*) FILTER (lone) AS unattributed FROM f GROUP BY run)
SELECT run, count(*) AS messages, count(*) FILTER (role = 'assistant') AS assistant_messages, coalesce(any_value(calls), 0) AS calls, coalesce(any_value(responses), 0) AS responses, coalesce(any_value(errors), 0) AS errors, coalesce(any_value(unattributed), 0) AS unattributed FROM m LEFT JOIN t USING (run) GROUP BY run""")
def trajectory_metrics(spark, sf_dir):
    e, cid = read(spark, sf_dir, "events"), (F.col("event_id") % 2).cast("string")
    role = F.when(F.col("event_type") == "click", "assistant").when(F.col("event_type") == "view", "tool").otherwise("user")
    return V.trajectory_metrics(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("turn"), role.alias("role"), F.array(cid).alias("calls"), cid.alias("call_id"), (F.col("event_id") % 5 == 0).alias("error")), "run")


@query("""WITH u AS (SELECT o_orderpriority_ AS arm, dim, CASE dim WHEN 'a' THEN CASE o_orderkey % 4 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'violated' WHEN 2 THEN 'unclear' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'satisfied' ELSE 'violated' END END AS status FROM (SELECT *, o_orderstatus AS o_orderpriority_ FROM orders), (VALUES ('a'), ('b')) v(dim))
SELECT arm, dim AS dimension, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'unclear') AS other, count(*) FILTER (status IS NULL) AS unjudged, round(count(*) FILTER (status = 'satisfied') / count(*) FILTER (status IN ('satisfied', 'violated')), 6) AS rate, count(*) = count(*) FILTER (status IN ('satisfied', 'violated')) AS whole FROM u GROUP BY ALL""")
def rubric_slices(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, "satisfied").when(k % 4 == 1, "violated").when(k % 4 == 2, "unclear")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("arm"), a.alias("a"), F.when(k % 3 == 0, "satisfied").otherwise("violated").alias("b"))
    return rounded(V.status_slices(o, ["a", "b"], "arm"), "rate")


@query("""WITH c AS (SELECT o_orderstatus AS arm, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['k' || (o_custkey % 2), 'k' || (o_orderkey % 2)] END AS kinds FROM orders)
SELECT arm, kind, count(*) AS n FROM (SELECT arm, unnest(CASE WHEN len(kinds) = 0 THEN ['none'] ELSE list_distinct(kinds) END) AS kind FROM c) GROUP BY ALL""")
def finding_summary(spark, sf_dir):
    name = lambda c: F.concat(F.lit("k"), (F.col(c) % 2).cast("string"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("arm"), F.when(F.col("o_orderkey") % 3 != 0, F.array(name("o_custkey"), name("o_orderkey"))).alias("kinds"))
    return V.findings(o, "kinds", "arm")


@query("SELECT l_orderkey AS key, round(sum(l_quantity), 3) AS total, round(coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0), 3) AS even, round(coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 1), 0), 3) AS odd FROM lineitem GROUP BY 1")
def reward_decomposition(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("component"), F.col("l_quantity").cast("double").alias("value"))
    return rounded(V.decomposed(li, li.groupBy("key").agg(F.sum("value").alias("total")), "key", ["even", "odd"]), "total", "even", "odd", digits=3)


@query("""WITH a AS (SELECT c_custkey AS field, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS field, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(a.field, b.field) AS field, a.v AS baseline, b.v AS treatment FROM a FULL JOIN b ON a.field = b.field WHERE a.field IS NULL OR b.field IS NULL OR a.v IS DISTINCT FROM b.v""")
def protocol_mismatches(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field"), F.col("c_mktsegment").alias("value"))
    return V.protocol_mismatches(c.filter("field % 5 != 0"), c.filter("field % 7 != 0").withColumn("value", F.when(F.col("field") % 3 != 0, F.col("value"))))


@query("""WITH t AS (SELECT c_custkey AS task_id, arm, CASE WHEN (c_custkey * arm_n) % 7 < 3 THEN 1.0 ELSE 0.0 END AS r FROM customer, (VALUES ('baseline', 1), ('one', 2), ('two', 5)) v(arm, arm_n)), m AS (SELECT arm, t.r, b.r AS b FROM t JOIN (SELECT task_id, r FROM t WHERE arm = 'baseline') b USING (task_id))
SELECT arm, count(*) AS tasks, round(avg(r), 6) AS mean, round(avg(r - b), 6) + 0.0 AS difference, count(*) FILTER (r > b) AS better, count(*) FILTER (r < b) AS worse FROM m GROUP BY arm""")
def multi_arm_report(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    arms = [c.select("task_id", F.lit(a).alias("arm"), ((F.col("task_id") * n) % 7 < 3).cast("double").alias("reward")) for a, n in (("baseline", 1), ("one", 2), ("two", 5))]
    return rounded(V.arm_report(arms[0].union(arms[1]).union(arms[2])), "mean", "difference")


@query("SELECT 'test_score/' || o_orderstatus AS metric, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS value FROM orders GROUP BY 1")
def source_score_means(spark, sf_dir):
    return rounded(V.source_means(read(spark, sf_dir, "orders"), "o_orderstatus", (F.col("o_orderkey") % 3 == 0).cast("double")), "value")
