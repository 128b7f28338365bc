"""Evaluations: plan checks, eligibility, rewards from their components, agent and trajectory metrics, comparisons."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.aggregates import is_success, pass_at_k, pass_hat_k, task_pass

# Reasons for which a run ends, by what they mean.
SCORABLE = ("agent_stop", "user_stop")
INFRASTRUCTURE = ("infrastructure_error", "unexpected_error")
LIMITS = ("max_steps", "timeout", "context_window_exceeded", "length")
FAILURES = (*LIMITS, "too_many_errors", "agent_error", "user_error")


def _error(text: str | Column, kind: str = "boolean") -> Column:
    return F.raise_error(F.lit(text) if isinstance(text, str) else text).cast(kind)


def eligibility(df: DataFrame, reason: str = "termination_reason", reward: str = "reward", exception: str | None = None) -> DataFrame:
    """Adds category (officially_scored, budget_limit, unscored_failure, infrastructure_error or
    unknown_termination), officially_scored and eligible. A reward that isn't finite, or a
    positive one for a run that can't be scored, is an error."""
    r = F.coalesce(F.col(reason), F.lit(""))
    infra = r.isin(*INFRASTRUCTURE) | (F.coalesce(F.col(exception), F.lit(False)) if exception else F.lit(False))
    scorable, known = r.isin(*SCORABLE), r.isin(*SCORABLE, *FAILURES)
    category = F.when(infra, "infrastructure_error").when(scorable, "officially_scored").when(r.isin(*LIMITS), "budget_limit").when(known, "unscored_failure").otherwise("unknown_termination")
    x = F.col(reward).cast("double")
    wrong = F.when(F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf"))), _error("an outcome isn't finite", "string")).when(~scorable & (x != 0), _error("an unscored run has an outcome", "string"))
    return df.withColumns({"category": F.coalesce(wrong, category), "officially_scored": scorable & ~infra, "eligible": known & ~infra})


def failure_category(reward: Column, reason: Column, tool_errors: Column) -> Column:
    """What kept a run from its reward: none, turn_limit, tool_errors, agent_error, infrastructure, user_transfer, unfinished or wrong_outcome."""
    return (
        F.when(reward > 0, "none").when(reason.isin("max_steps", "timeout"), "turn_limit").when(reason == "too_many_errors", "tool_errors").when(reason.isin("agent_error", "context_window_exceeded"), "agent_error")
        .when(reason.isin(*INFRASTRUCTURE), "infrastructure").when(reason == "user_error", "user_transfer").when(~F.coalesce(reason.isin(*SCORABLE), F.lit(False)), "unfinished").when(tool_errors > 0, "tool_errors").otherwise("wrong_outcome")
    )


def trainable_only(df: DataFrame, source: str, allowed: Iterable[str]) -> DataFrame:
    """df; a row of another source is an error."""
    ok = F.coalesce(F.col(source).isin(list(allowed)), F.lit(False))
    return df.filter(F.when(ok, True).otherwise(_error(F.concat(F.lit("not to be trained on: "), F.coalesce(F.col(source), F.lit("null"))))))


def checked_results(plan: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """(task_id, trial, seed, reward, status) for every planned trial: scored, failed or missing.

    All three have task_id, trial and seed, results a reward and a termination_reason. A trial
    planned, scored or failed twice, one that isn't planned, another seed than planned, a
    reward that isn't finite and an infrastructure error among results are errors.
    """
    key = ["task_id", "trial"]
    both = results.select(*key, F.col("seed").alias("seed_"), F.col("reward").cast("double").alias("reward"), F.col("termination_reason").alias("why_"), F.lit("scored").alias("status"))
    both = both.unionByName(errors.select(*key, F.col("seed").alias("seed_"), F.lit(None).cast("double").alias("reward"), F.lit(None).cast("string").alias("why_"), F.lit("failed").alias("status")))
    seen = both.groupBy(*key).agg(F.count("*").alias("n_"), *(F.first(c).alias(c) for c in ("seed_", "reward", "why_", "status")))
    planned = plan.groupBy(*key).agg(F.count("*").alias("p_"), F.first("seed").alias("seed"))
    name = F.concat_ws("/", *key)
    joined = planned.join(seen, key, "full_outer")
    wrong = (
        F.when(F.col("p_").isNull(), F.concat(F.lit("not planned: "), name)).when(F.col("p_") > 1, F.concat(F.lit("planned twice: "), name)).when(F.col("n_") > 1, F.concat(F.lit("scored twice: "), name))
        .when(F.col("seed") != F.col("seed_"), F.concat(F.lit("another seed: "), name)).when(F.col("why_") == "infrastructure_error", F.concat(F.lit("infrastructure error scored: "), name))
        .when((F.col("status") == "scored") & (F.col("reward").isNull() | F.isnan("reward") | (F.abs("reward") == float("inf"))), F.concat(F.lit("not finite: "), name))
    )
    checked = F.when(wrong.isNull(), F.coalesce("status", F.lit("missing"))).otherwise(_error(wrong, "string"))
    return joined.select(*key, "seed", "reward", checked.alias("status"))


def dual_summary(trials: DataFrame, strict: str = "strict", lenient: str = "lenient") -> DataFrame:
    """(metric, planned, scored, complete, solve_rate) for two scores of the same trials, and how many
    only the lenient one accepts. Scores are 0 or 1, the strict one never above the other; a
    solve rate is null unless every planned trial has both."""
    ok = F.col(strict).isin(0, 1) & F.col(lenient).isin(0, 1) & (F.col(strict) <= F.col(lenient))
    checked = trials.filter(F.when(F.col(strict).isNull() & F.col(lenient).isNull() | F.coalesce(ok, F.lit(False)), True).otherwise(_error("scores aren't 0 or 1, or not nested")))
    rows = checked.unpivot([], [strict, lenient], "metric", "value")
    more = checked.agg(F.count_if(F.col(lenient) > F.col(strict)).alias("only_lenient"))
    n, k = F.count("*"), F.count("value")
    return rows.groupBy("metric").agg(n.alias("planned"), k.alias("scored"), (n == k).alias("complete"), F.when(n == k, F.avg("value")).alias("solve_rate")).crossJoin(F.broadcast(more))


def task_info(simulations: DataFrame, tasks: DataFrame, key: str = "task_id", required: bool = False) -> DataFrame:
    """simulations with their task's columns; a task that isn't known gives nulls, or, if required, an error."""
    known = simulations.join(tasks.withColumn("known_", F.lit(True)), key, "left")
    return known.filter(F.when(F.col("known_"), True).otherwise(_error("a task isn't known") if required else F.lit(True))).drop("known_")


def pass_table(trials: DataFrame, tasks: DataFrame, ks: Iterable[int], key: str = "task_id") -> DataFrame:
    """tasks with their trials, successes and pass_hat_k."""
    counts = task_pass(trials, ks, key)
    return tasks.join(counts.select(key, "n", "c", *(f"pass_hat_{k}" for k in ks)), key)


def partial_actions(checks: DataFrame, *keys: str, matched: str = "matched", kind: str = "kind") -> DataFrame:
    """For total, read and write actions: right ones, number, and proportion (null where there is none)."""
    out = []
    for name, on in (("total", F.lit(True)), ("read", F.col(kind) == "read"), ("write", F.col(kind) == "write")):
        right, n = F.count_if(on & F.col(matched)), F.count_if(on)
        out += [right.alias(f"{name}_correct"), n.alias(f"{name}_count"), F.try_divide(right, n).alias(f"{name}_proportion")]
    return checks.groupBy(*keys).agg(*out)


def component_rewards(checks: DataFrame, basis: Iterable[str], key: str = "sim_id", component: str = "component", reward: str = "reward") -> DataFrame:
    """(key, components, reward): the product of each component's checks (1 without any), and of the components in the basis."""
    basis = list(basis)
    each = {c: F.coalesce(F.product(F.when(F.col(component) == c, F.col(reward))), F.lit(1.0)) for c in basis}
    rows = checks.groupBy(key).agg(*(v.alias(c) for c, v in each.items()))
    return rows.withColumn("reward", reduce(lambda a, b: a * b, (F.col(c) for c in basis), F.lit(1.0)))


def simulation_reward(sims: DataFrame, checks: DataFrame, key: str = "sim_id", basis: str = "basis", reason: str = "termination_reason") -> DataFrame:
    """(key, reward, breakdown): 0 where a run didn't stop by itself, 1 where the task has no basis (an
    array of components), and else the product of the basis' components, each the product of its checks."""
    each = checks.groupBy(key, "component").agg(F.product("reward").alias("r_")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("component", "r_"))).alias("m_"))
    joined = sims.join(each, key, "left")
    parts = F.transform(basis, lambda c: F.struct(c.alias("component"), F.coalesce(F.try_element_at("m_", c), F.lit(1.0)).alias("reward")))
    stopped, empty = F.coalesce(F.col(reason).isin(*SCORABLE), F.lit(False)), F.coalesce(F.size(basis), F.lit(0)) <= 0
    total = F.when(~stopped, 0.0).when(empty, 1.0).otherwise(F.aggregate(parts, F.lit(1.0), lambda a, p: a * p["reward"]))
    return joined.select(key, total.alias("reward"), F.when(stopped & ~empty, parts).alias("breakdown"))


def terminal_reward(df: DataFrame, protocol: str = "native") -> DataFrame:
    """Adds `selected`: the native reward, or (outcome) for scored runs with DB in their basis the product
    of the basis with DB replaced by whether both outcome hashes are equal.
    df has reward, scored, termination_reason, basis, breakdown (map), predicted_hash, reference_hash."""
    if protocol not in ("native", "outcome"):
        raise ValueError(f"unknown protocol {protocol}")
    if protocol == "native":
        return df.withColumn("selected", F.col("reward"))
    same = (F.col("predicted_hash") == F.col("reference_hash")).cast("double")
    product = F.aggregate("basis", F.lit(1.0), lambda a, c: a * F.when(c == "DB", same).otherwise(F.element_at("breakdown", c)))
    applies = F.col("scored") & F.col("termination_reason").isin(*SCORABLE) & F.array_contains("basis", "DB")
    return df.withColumn("selected", F.when(applies, product).otherwise(F.col("reward")))


SEVERITIES = {"agent": ("critical",), "user": ("critical_helped", "critical_hindered")}


def review_severity(errors: DataFrame, key: str = "sim_id") -> DataFrame:
    """(key, max_agent_severity, max_user_severity, first_critical_source) of reviewed errors (source,
    severity, position, no): critical before minor before the first other one, `none` without
    any; of several critical ones the user's last counts, and the first by position gives its source."""
    severity = F.coalesce("severity", F.lit("unknown"))
    place = F.struct(F.coalesce(F.col("position").cast("double"), F.lit(float("inf"))), "no")
    top = {}
    for who, critical in SEVERITIES.items():
        mine = F.col("source") == who
        worst = F.max_by(F.when(mine & severity.isin(*critical), severity), F.when(mine & severity.isin(*critical), F.col("no")))
        minor = F.max(F.when(mine & (severity == "minor"), "minor"))
        other = F.min_by(F.when(mine, severity), F.when(mine & (severity != "none"), F.col("no")))
        top[f"max_{who}_severity"] = F.coalesce(worst, minor, other, F.lit("none"))
    critical = reduce(lambda a, b: a | b, ((F.col("source") == w) & severity.isin(*c) for w, c in SEVERITIES.items()))
    first = F.min_by(F.when(critical, F.col("source")), F.when(critical, place))
    return errors.groupBy(key).agg(*(v.alias(k) for k, v in top.items()), F.coalesce(first, F.lit("none")).alias("first_critical_source"))


def agent_metrics(sims: DataFrame, checks: DataFrame, ks: Iterable[int] = (1, 2, 4)) -> DataFrame:
    """One row over runs that infrastructure didn't end: average reward and cost, pass_hat_k (k up to the
    least number of trials of a task, else null), actions, DB match, authentication, and how runs ended.

    sims: sim_id, task_id, reward, cost, termination_reason, db_match (null: not checked), auth
    (null: not checked). checks: sim_id, matched, kind.
    """
    ks = list(ks)
    real = sims.filter(F.col("termination_reason").isNull() | (F.col("termination_reason") != "infrastructure_error"))
    by_task = real.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(is_success(F.col("reward"))).alias("c"))
    passes = by_task.agg(F.count("*").alias("total_tasks"), F.min("n").alias("least_"), *(F.avg(pass_hat_k(F.col("n"), F.col("c"), k)).alias(f"p_{k}") for k in ks))
    passes = passes.select("total_tasks", *(F.when(F.col("least_") >= k, F.col(f"p_{k}")).alias(f"pass_hat_{k}") for k in ks))
    ended = {"user_stop": ("user_stop",), "agent_stop": ("agent_stop",), "max_steps": ("max_steps",), "error": ("too_many_errors", "agent_error", "user_error")}
    auth = F.col("auth")
    total = real.agg(
        F.count("*").alias("total_simulations"), F.avg("reward").alias("avg_reward"), F.avg("cost").alias("avg_agent_cost"),
        F.count_if(F.col("db_match")).alias("db_match"), F.count_if(~F.col("db_match")).alias("db_mismatch"), F.count_if(F.col("db_match").isNull()).alias("db_not_checked"),
        F.count_if(auth == "succeeded").alias("auth_succeeded"), F.count_if(auth == "failed").alias("auth_failed"), F.count_if(~auth.isin("succeeded", "failed")).alias("auth_not_needed"), F.count_if(auth.isNull()).alias("auth_not_checked"),
        *(F.count_if(F.col("termination_reason").isin(*of)).alias(f"termination_{k}") for k, of in ended.items()),
    )
    acts = partial_actions(checks.join(real.select("sim_id"), "sim_id", "left_semi")).drop("total_correct", "total_count", "total_proportion")
    infra = sims.agg(F.count_if(F.col("termination_reason") == "infrastructure_error").alias("infra_errors"))
    return total.join(passes).join(acts).join(infra)


def grouped_pass(trials: DataFrame, by: Iterable[str], ks: Iterable[int], task: str = "task_id", reward: str = "reward", domain: DataFrame | None = None) -> DataFrame:
    """By the columns `by` (intent, persona, number of actions): tasks, and mean and sample deviation
    over tasks of pass_hat_k. With `domain`, its rows without tasks appear with zeros."""
    by, ks = list(by), list(ks)
    tasks = trials.groupBy(*by, task).agg(F.count(reward).alias("n"), F.count_if(is_success(F.col(reward))).alias("c"))
    hat = {k: pass_hat_k(F.col("n"), F.col("c"), k) for k in ks}
    out = tasks.groupBy(*by).agg(F.count("*").alias("tasks"), *(x for k in ks for x in (F.avg(hat[k]).alias(f"pass_hat_{k}"), F.stddev_samp(hat[k]).alias(f"pass_hat_{k}_std"))))
    return out if domain is None else domain.select(*by).distinct().join(out, by, "left").fillna(0, ["tasks", *(f"pass_hat_{k}" for k in ks)])


def pivot_rates(df: DataFrame, rows: list[str], column: str, names: list, value: Column, frequency: bool = True) -> DataFrame:
    """Mean of value by rows and, as columns, by the given names of `column`; and how often each row occurs."""
    rates = df.groupBy(*rows).pivot(column, names).agg(F.avg(value))
    return rates.join(df.groupBy(*rows).agg(F.count("*").alias("frequency")), rows) if frequency else rates


def shares(df: DataFrame, category: str, *keys: str) -> DataFrame:
    """(keys, category, n, share): how often each category occurs, and its part of its key's rows."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, F.lit(0))))


def binned(df: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """(keys, bin, n): values of 0 to 1 in equally wide bins, 1 in the last."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def costs(messages: DataFrame, run: str, *keys: str, cost: str = "cost") -> DataFrame:
    """By keys: mean and sum of runs' costs; a run with a message of unknown cost has none."""
    runs = messages.groupBy(*keys, run).agg(F.when(F.count_if(F.col(cost).isNull()) == 0, F.sum(cost)).alias("c_"))
    return runs.groupBy(*keys).agg(F.count("c_").alias("runs"), F.avg("c_").alias("mean_cost"), F.sum("c_").alias("total_cost"))


def reward_matrix(trials: DataFrame, names: list[str], task: str = "task_id", experiment: str = "experiment", reward: str = "reward") -> DataFrame:
    """A row for each task with the mean reward of each experiment, and `label`: all_solved, none_solved, mixed or missing."""
    wide = trials.groupBy(task).pivot(experiment, names).agg(F.avg(reward))
    each = [F.col(f"`{n}`") for n in names]
    lacks, solved = reduce(lambda a, b: a | b, (c.isNull() for c in each)), [is_success(c) for c in each]
    label = F.when(lacks, "missing").when(reduce(lambda a, b: a & b, solved), "all_solved").when(reduce(lambda a, b: a & b, (c <= 1e-6 for c in each)), "none_solved").otherwise("mixed")
    return wide.withColumn("label", label)


def cross_domain(panel: DataFrame, means: list[str], counts: list[str], *keys: str) -> DataFrame:
    """The mean over domains of the means (nulls are passed over) and the sum of the counts."""
    return panel.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in means), *(F.sum(c).alias(c) for c in counts))


def trajectory_metrics(messages: DataFrame, run: str = "conv_id", order: str = "turn") -> DataFrame:
    """(run, messages, assistant_messages, calls, responses, errors, unattributed): a tool message answers
    the call of its id that was made before it and isn't answered yet.

    messages: run, order, role, calls (array of ids), call_id, error (null: not said).
    """
    past = (Window.unboundedPreceding, 0)
    made = messages.select(run, order, F.explode(F.when(F.col("role") == "assistant", F.col("calls"))).alias("id_"), F.lit(1).alias("s_"), F.lit(None).cast("boolean").alias("e_"))
    said = messages.filter(F.col("role") == "tool").select(run, order, F.col("call_id").alias("id_"), F.lit(-1).alias("s_"), F.col("error").alias("e_"))
    walk = made.union(said)
    # With calls as steps up and answers as steps down, an answer below all before it has no call.
    at = Window.partitionBy(run, "id_").orderBy(order, F.desc("s_"))
    level = walk.withColumn("level_", F.sum("s_").over(at.rowsBetween(*past)))
    low = level.withColumn("low_", F.least(F.lit(0), F.coalesce(F.min("level_").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    lone = (F.col("s_") < 0) & ((F.col("level_") < F.col("low_")) | F.col("id_").isNull())
    tools = low.groupBy(run).agg(F.count_if(F.col("s_") > 0).alias("calls"), F.count_if((F.col("s_") < 0) & ~lone).alias("responses"), F.count_if(~lone & F.col("e_")).alias("errors"), F.count_if(lone).alias("unattributed"))
    plain = messages.groupBy(run).agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))
    return plain.join(tools, run, "left").fillna(0, ["calls", "responses", "errors", "unattributed"])


def status_slices(rows: DataFrame, dimensions: list[str], *keys: str) -> DataFrame:
    """(keys, dimension, satisfied, violated, other, unjudged, rate): how dimensions were judged, and the
    satisfied part of the decisive verdicts; `whole` says whether all rows have one."""
    long = rows.unpivot(list(keys), dimensions, "dimension", "status")
    s, good, bad = F.col("status"), F.count_if(F.col("status") == "satisfied"), F.count_if(F.col("status") == "violated")
    none = F.count_if(s.isNull())
    return long.groupBy(*keys, "dimension").agg(good.alias("satisfied"), bad.alias("violated"), (F.count("*") - good - bad - none).alias("other"), none.alias("unjudged"), F.try_divide(good, good + bad).alias("rate"), (good + bad == F.count("*")).alias("whole"))


def findings(cases: DataFrame, kinds: str, *keys: str) -> DataFrame:
    """(keys, kind, n): cases that have a kind of finding; a case may have several, and `none` without any."""
    of = F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, F.array_distinct(kinds)).otherwise(F.array(F.lit("none")))
    return cases.select(*keys, F.explode(of).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def decomposed(parts: DataFrame, totals: DataFrame, key: str, names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, names, total): components (component, value) as columns; a total that they don't add up to is an error."""
    wide = parts.groupBy(key).pivot("component", names).agg(F.sum("value")).fillna(0.0, names)
    both = totals.select(key, F.col("total").cast("double").alias("total")).join(wide, key, "left").fillna(0.0, names)
    ok = F.abs(reduce(lambda a, b: a + b, (F.col(n) for n in names)) - F.col("total")) < tolerance
    return both.filter(F.when(ok, True).otherwise(_error("components don't add up to the total")))


def protocol_mismatches(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(field, baseline, treatment) of the settings (field, value) in which two runs differ; null equals null, and a field that one lacks differs."""
    a, b = baseline.select("field", F.struct(F.col("value")).alias("a")), treatment.select("field", F.struct(F.col("value")).alias("b"))
    both = a.join(b, "field", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("field", F.col("a.value").alias("baseline"), F.col("b.value").alias("treatment"))


def arm_report(trials: DataFrame, arm: str = "arm", task: str = "task_id", reward: str = "reward", base: str = "baseline") -> DataFrame:
    """(arm, tasks, mean, difference, better, worse): each arm's mean over tasks of mean rewards, and against
    the base arm the mean difference and the tasks that went up and down. All arms need the same tasks."""
    means = trials.groupBy(arm, task).agg(F.avg(reward).alias("m_"))
    own = means.filter(F.col(arm) == base).select(task, F.col("m_").alias("b_"))
    n = own.agg(F.count("*").alias("n_"))
    both = means.join(own, task, "left").filter(F.when(F.col("b_").isNotNull(), True).otherwise(_error("arms have different tasks")))
    d = F.col("m_") - F.col("b_")
    out = both.groupBy(arm).agg(F.count("*").alias("tasks"), F.avg("m_").alias("mean"), F.avg(d).alias("difference"), F.count_if(d > 1e-9).alias("better"), F.count_if(d < -1e-9).alias("worse"))
    return out.crossJoin(F.broadcast(n)).filter(F.when(F.col("tasks") == F.col("n_"), True).otherwise(_error("arms have different tasks"))).drop("n_")


def source_means(responses: DataFrame, source: str, score: Column) -> DataFrame:
    """(metric, value): the mean score of each source's responses, named test_score/source."""
    return responses.groupBy(F.concat(F.lit("test_score/"), F.col(source)).alias("metric")).agg(F.avg(score).alias("value"))


def best_of(trials: DataFrame, k: int, task: str = "task_id", reward: str = "reward") -> DataFrame:
    """One row: pass@k over tasks with k trials or more."""
    counts = trials.groupBy(task).agg(F.count(reward).alias("n"), F.count_if(is_success(F.col(reward))).alias("c"))
    return counts.agg(F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias("pass_at_k"))
