"""Queries over training updates: rejection masks, losses, group filters and batch metrics, from lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import estimators as E
from tidelane.operators import policy as P
from tidelane.operators import training as N
from tidelane.plans.credits import LOSS_SQL, POLICIES, policies, rounded
from tidelane.plans.rollouts import ROLLOUTS, read, rollouts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policies() with `pos`, the line's number and keys, which tell a row's tokens apart."""
    li = read(spark, sf_dir, "lineitem")
    pos = F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("row_id"), pos.alias("pos"), (-(F.col("l_tax") * 5 + 0.125)).alias("logp"), (-(F.col("l_discount") * 4 + 0.125)).alias("old"), ((F.col("l_quantity") - 25) / 10).alias("adv"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"))


REJECTION = {"token_k1": "0.8_1.2", "token_k2": 0.05, "token_k3": 0.05, "seq_sum_k1": "0.6_1.7", "seq_sum_k2": 0.1, "seq_sum_k3": 0.1, "seq_mean_k1": 1.1, "seq_mean_k2": 0.02, "seq_mean_k3": 0.02, "seq_max_k2": 0.04, "seq_max_k3": 0.04}
_DIV = "d AS (SELECT *, logp - old AS lr, old - logp AS k1, 0.5 * (logp - old) * (logp - old) AS k2, exp(logp - old) - 1 - (logp - old) AS k3 FROM t)"


def _rejection_sql(name: str, bound) -> str:
    level, _, kind = name.rpartition("_")
    low, _, high = str(bound).rpartition("_")
    stat = {"token": kind, "seq_sum": f"sum({kind} * m) OVER w", "seq_mean": f"sum({kind} * m) OVER w / (sum(m) OVER w + 1e-8)", "seq_max": f"coalesce(max(CASE WHEN m > 0 THEN {kind} END) OVER w, 0)"}[level]
    test = f"x <= ln({high}) AND x >= ln({low or f'1.0 / {high}'})" if kind == "k1" else f"x <= {high}"
    return f"SELECT '{name}' AS option, CAST(sum(CASE WHEN {test} THEN m ELSE 0 END) AS BIGINT) AS kept FROM (SELECT m, {stat} AS x FROM d WINDOW w AS (PARTITION BY row_id))"


@query(f"WITH {POLICIES}, {_DIV} " + " UNION ALL ".join(_rejection_sql(*kv) for kv in REJECTION.items()))
def rejection_masks(spark, sf_dir):
    out = None
    for name, bound in REJECTION.items():
        one = P.rejection_mask(policies(spark, sf_dir), {name: bound}).agg(F.lit(name).alias("option"), F.sum("mask").cast("long").alias("kept"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {POLICIES}, {_DIV}, k AS (SELECT row_id, m, CASE WHEN k2 <= 0.05 AND sum(k3 * m) OVER w / (sum(m) OVER w + 1e-8) <= 0.02 THEN m ELSE 0 END AS n FROM d WINDOW w AS (PARTITION BY row_id)),
r AS (SELECT row_id, sum(m) AS m, sum(m - n) AS g FROM k GROUP BY row_id) SELECT round(sum(g) / (sum(m) + 1e-8), 6) AS masked_fraction, round(count(*) FILTER (g > 0) / count(*), 6) AS seq_masked_fraction FROM r""")
def rejection_metrics(spark, sf_dir):
    t = placed(spark, sf_dir)
    return rounded(P.rejected(t, P.rejection_mask(t, {"token_k2": 0.05, "seq_mean_k3": 0.02})), "masked_fraction", "seq_masked_fraction")


@query(f"""WITH {POLICIES}, {_DIV}, k AS (SELECT *, CASE WHEN k2 <= 0.05 THEN m ELSE 0 END AS n, exp(logp - old) AS ratio FROM d)
SELECT 'reinforce' AS kind, round(sum(-adv * logp * least(ratio, 2) * m * n) / sum(n), 6) AS loss, round(sum((old - logp) * n) / (sum(n) + 1e-8), 6) AS kl FROM k UNION ALL
SELECT 'ppo_clip', round(sum(({LOSS_SQL["vanilla"][0]}) * n) / sum(n), 6), round(sum((old - logp) * n) / (sum(n) + 1e-8), 6) FROM k""")
def bypass_losses(spark, sf_dir):
    t = policies(spark, sf_dir)
    out = [P.bypass_loss(t, kind, {"level": "token"}, {"token_k2": 0.05}).select(F.lit(kind).alias("kind"), "loss", "kl") for kind in ("reinforce", "ppo_clip")]
    return rounded(out[0].union(out[1]), "loss", "kl")


@query(f"WITH {POLICIES}, s AS (SELECT sum(-adv * logp * m) AS a FROM t GROUP BY row_id HAVING sum(m) > 0) SELECT round(avg(a), 6) AS reinforce, round(avg(a) / 7, 6) AS normed FROM s")
def reinforce_loss(spark, sf_dir):
    t = policies(spark, sf_dir)
    a = P.policy_loss("reinforce", t, "seq-mean-token-sum").select(F.col("loss").alias("reinforce"))
    b = P.aggregate_loss(t.withColumn("loss_t", -F.col("adv") * F.col("logp")), "loss_t", "mask", "row_id", "seq-mean-token-sum-norm", scale=7).select(F.col("loss").alias("normed"))
    return rounded(a.crossJoin(b), "reinforce", "normed")


_LOGITS = "[l_discount * 10, l_tax * 10, l_quantity / 50]"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {_LOGITS} AS z, l_linenumber % 3 AS y FROM lineitem), p AS (SELECT *, list_sum([exp(x) FOR x IN z]) AS s FROM l),
e AS (SELECT *, ln(s) - list_sum([x * exp(x) FOR x IN z]) / s AS h, z[y + 1] - ln(s) AS lp, list_sum([exp(2 * x) FOR x IN z]) / (s * s) AS sq FROM p)
SELECT l_linenumber, round(sum(h) / count(*), 6) AS entropy, round(avg(lp), 6) AS logp, round(avg(sq), 6) AS squares FROM e GROUP BY 1""")
def entropy_loss(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_linenumber", F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("logits"), (F.col("l_linenumber") % 3).cast("int").alias("label"))
    out = li.groupBy("l_linenumber").agg(F.avg(P.entropy("logits")).alias("entropy"), F.avg(P.label_logp("logits", "label")).alias("logp"), F.avg(P.sum_of_squares("logits")).alias("squares"))
    return rounded(out, "entropy", "logp", "squares")


_GROUPS = f"{ROLLOUTS}, k AS (SELECT uid, count(*) AS n, CASE WHEN count(*) <> 4 THEN 'incomplete' WHEN max(s) <= 0 THEN 'all_zero' WHEN min(s) >= 40 - 1e-9 OR max(s) - min(s) <= 1e-9 THEN 'all_one' ELSE 'informative' END AS kind, uid % 5 AS step FROM r GROUP BY uid)"
_STATS = "count(*) AS candidate_groups, CAST(sum(n) AS BIGINT) AS candidate_rollouts, count(*) FILTER (kind = 'informative') AS effective_groups, CAST(coalesce(sum(n) FILTER (kind = 'informative'), 0) AS BIGINT) AS effective_rollouts, count(*) FILTER (kind = 'all_zero') AS all_zero_groups, count(*) FILTER (kind = 'all_one') AS all_one_groups, count(*) FILTER (kind = 'incomplete') AS incomplete_groups, 1 - count(*) FILTER (kind = 'informative') / count(*) AS d_bar"


@query(f"WITH {_GROUPS}, s AS (SELECT step, {_STATS} FROM k GROUP BY step) SELECT * REPLACE (round(d_bar, 6) AS d_bar), round(candidate_groups / effective_groups, 6) AS inverse_one_minus_d_bar FROM s")
def group_filter_stats(spark, sf_dir):
    groups = N.classify_groups(rollouts(spark, sf_dir), reward="score", size=4, top=40.0).withColumn("step", F.col("uid") % 5)
    return rounded(N.filter_stats(groups, "step"), "d_bar", "inverse_one_minus_d_bar")


@query(f"WITH {_GROUPS}, s AS (SELECT step, {_STATS} FROM k GROUP BY step) SELECT count(*) AS updates, CAST(sum(candidate_groups) AS BIGINT) AS candidate_groups, CAST(sum(effective_groups) AS BIGINT) AS effective_groups, CAST(sum(all_zero_groups) AS BIGINT) AS all_zero_groups, CAST(sum(all_one_groups) AS BIGINT) AS all_one_groups, round(avg(d_bar), 6) AS d_bar_mean, round(max(d_bar), 6) AS d_bar_max, round(avg(1 / greatest(1e-9, 1 - d_bar)), 6) AS inverse_one_minus_d_bar_mean FROM s")
def merged_filter_stats(spark, sf_dir):
    groups = N.classify_groups(rollouts(spark, sf_dir), reward="score", size=4, top=40.0).withColumn("step", F.col("uid") % 5)
    return rounded(N.merge_filter_stats(N.filter_stats(groups, "step")), "d_bar_mean", "d_bar_max", "inverse_one_minus_d_bar_mean")


@query("""WITH t AS (SELECT l_orderkey // 4 AS uid, l_orderkey AS row_id, CASE WHEN l_quantity < 40 THEN 0 ELSE l_quantity END AS adv, CASE WHEN l_linenumber % 3 <> 0 THEN 1 ELSE 0 END AS mask FROM lineitem),
f AS (SELECT uid FROM t GROUP BY uid HAVING count(DISTINCT row_id) = 4), g AS (SELECT uid, max(CASE WHEN abs(adv) > 1e-12 AND mask > 0 THEN 1 ELSE 0 END) AS keep FROM t JOIN f USING (uid) GROUP BY uid)
SELECT row_id, CAST(sum(mask * keep) AS BIGINT) AS tokens FROM t JOIN g USING (uid) GROUP BY row_id""")
def advantage_filter(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    t = li.select(F.floor(F.col("l_orderkey") / 4).alias("uid"), F.col("l_orderkey").alias("row_id"), F.when(F.col("l_quantity") < 40, 0.0).otherwise(F.col("l_quantity")).alias("adv"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"))
    whole = t.groupBy("uid").agg(F.countDistinct("row_id").alias("n")).filter("n = 4").select("uid")
    return N.advantage_filter(t.join(whole, "uid"), 4).groupBy("row_id").agg(F.sum("mask").cast("long").alias("tokens"))


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_quantity").alias("score"), F.sum("l_tax").alias("reward"), F.sum((F.col("l_quantity") > 30).cast("int")).alias("response_length"), F.count("*").alias("prompt_length"))
    tokens = li.select(F.col("l_orderkey").alias("row_id"), F.col("l_discount").alias("adv"), (F.col("l_quantity") / 10).alias("ret"), F.col("l_tax").alias("value"), (F.col("l_linenumber") % 2).alias("mask"))
    return rows, tokens


_SPANS = [("score", "score", " FILTER (rl > 0)"), ("rewards", "reward", " FILTER (rl > 0)"), ("response_length", "rl", ""), ("response_length_non_aborted", "rl", " FILTER (rl > 0)"), ("prompt_length", "pl", "")]


def _spans(spans) -> str:
    return ", ".join(f"round(avg({c}){f}, 5) AS {n}_mean, max({c}){f} AS {n}_max, min({c}){f} AS {n}_min" for n, c, f in spans)


@query(f"""WITH r AS (SELECT l_orderkey, sum(l_quantity) AS score, round(sum(l_tax), 6) AS reward, CAST(count(*) FILTER (l_quantity > 30) AS BIGINT) AS rl, count(*) AS pl FROM lineitem GROUP BY 1),
a AS (SELECT {_spans(_SPANS)}, round(avg(CASE WHEN rl = 5 THEN 1.0 ELSE 0 END), 5) AS response_length_clip_ratio, round(avg(CASE WHEN rl = 5 THEN 1.0 ELSE 0 END) FILTER (rl > 0), 5) AS response_length_non_aborted_clip_ratio, round(avg(CASE WHEN rl = 0 THEN 1.0 ELSE 0 END), 5) AS aborted_ratio, round(avg(CASE WHEN pl = 7 THEN 1.0 ELSE 0 END), 5) AS prompt_length_clip_ratio FROM r),
t AS (SELECT l_discount AS adv, l_quantity / 10 AS ret, l_tax AS value FROM lineitem WHERE l_linenumber % 2 = 1),
b AS (SELECT {_spans([("advantages", "adv", ""), ("returns", "ret", ""), ("values", "value", "")])}, round(1 - var_samp(ret - value) / (var_samp(ret) + 1e-5), 5) AS vf_explained_var FROM t) SELECT * FROM a, b""")
def data_metrics(spark, sf_dir):
    out = N.data_metrics(*batch(spark, sf_dir), 5, 7)
    return rounded(out, *(c for c, kind in out.dtypes if kind in ("double", "decimal") or kind.startswith("decimal")), digits=5)


@query("""WITH n AS (SELECT count(*) AS p, count(*) FILTER (l_quantity > 30) AS r FROM lineitem), t AS (SELECT event_type AS stage, sum(value) AS s FROM events GROUP BY 1),
u AS (SELECT CASE stage WHEN 'click' THEN 'gen' WHEN 'view' THEN 'adv' ELSE stage END AS stage, s FROM t) SELECT stage, round(s, 3) AS timing_s, round(s * 1000 / CASE stage WHEN 'gen' THEN r WHEN 'adv' THEN p + r END, 5) AS timing_per_token_ms FROM u, n""")
def timing_metrics(spark, sf_dir):
    stage = F.when(F.col("event_type") == "click", "gen").when(F.col("event_type") == "view", "adv").otherwise(F.col("event_type"))
    timings = read(spark, sf_dir, "events").groupBy(stage.alias("stage")).agg(F.sum("value").alias("seconds"))
    out = N.timing_metrics(timings, batch(spark, sf_dir)[0])
    return out.select("stage", F.round("timing_s", 3).alias("timing_s"), F.round("timing_per_token_ms", 5).alias("timing_per_token_ms"))


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS total_num_tokens, 12.5 AS time_per_step, round(sum(l_quantity) / 100, 4) AS throughput FROM lineitem")
def throughput_metrics(spark, sf_dir):
    out = N.throughput(read(spark, sf_dir, "lineitem"), 12.5, 8, "l_quantity")
    return out.select(F.col("total_num_tokens").cast("long").alias("total_num_tokens"), "time_per_step", F.round("throughput", 4).alias("throughput"))


@query("""WITH t AS (SELECT l_orderkey AS row_id, -(l_discount * 4 + 0.125) AS logp, l_tax + 0.3 AS sq, (l_quantity - 25) / 10 AS adv, CASE WHEN l_linenumber % 3 <> 0 THEN 1.0 ELSE 0 END AS m, 1 + l_tax AS r FROM lineitem),
w AS (SELECT *, 1 - 2 * exp(logp) + sq AS w FROM t), k AS (SELECT row_id, sum(adv * m) / (sum(m) + 1e-8) AS a, sum(w * r * r * m) AS w, sum(w * m) AS w0, sum(r * m) / (sum(m) + 1e-8) AS r FROM w GROUP BY row_id)
SELECT 0.25 AS signal_strength, round(avg(r * r * a * a * greatest(w0, 0)), 5) AS total_power, round(greatest(0, (avg(r * r * a * a * greatest(w0, 0)) - 0.25) / (count(*) - 1)), 8) AS pure_noise, round(avg(a * a), 5) AS expected_a_squared, round(avg(w), 5) AS expected_w FROM k""")
def variance_proxies(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("row_id"), (-(F.col("l_discount") * 4 + 0.125)).alias("logp"), (F.col("l_tax") + 0.3).alias("squares"), ((F.col("l_quantity") - 25) / 10).alias("adv"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"), (1 + F.col("l_tax")).alias("w"))
    out = N.variance_proxies(t, 0.5, weight="w")
    return rounded(rounded(out, "total_power", "expected_a_squared", "expected_w", digits=5), "pure_noise", digits=8)


@query("""WITH v AS (SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'mean' WHEN 'view' THEN 'max' WHEN 'purchase' THEN 'sum' ELSE 'min' END AS kind, event_id % 2 AS rank, event_id // 2 AS step, value FROM events),
p AS (SELECT name, step FROM v GROUP BY ALL HAVING count(*) = 2), s AS (SELECT name, kind, step, avg(value) AS a, min(value) AS l, max(value) AS h FROM v JOIN p USING (name, step) GROUP BY ALL)
SELECT name, round(CASE kind WHEN 'mean' THEN avg(a) WHEN 'sum' THEN sum(a) WHEN 'min' THEN min(l) ELSE max(h) END, 4) AS value FROM s GROUP BY name, kind""")
def declared_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "mean").when(F.col("event_type") == "view", "max").when(F.col("event_type") == "purchase", "sum").otherwise("min")
    v = e.select(F.col("event_type").alias("name"), kind.alias("kind"), (F.col("event_id") % 2).alias("rank"), F.floor(F.col("event_id") / 2).alias("step"), "value")
    pairs = v.groupBy("name", "step").count().filter("count = 2").select("name", "step")
    return rounded(N.declared_metrics(v.join(pairs, ["name", "step"])), "value", digits=4)


_NAMES = ["timing_s/step", "reward/mean", "length/max", "length/min", "tokens/total", "version", "score", "other"]


@query(f"""WITH v AS (SELECT {_NAMES}[event_id % 8 + 1] AS name, event_id AS o, value, user_id % 7 AS n FROM events)
SELECT name, round(CASE name WHEN 'timing_s/step' THEN sum(value) WHEN 'length/max' THEN max(value) WHEN 'length/min' THEN min(value) WHEN 'tokens/total' THEN sum(value) WHEN 'version' THEN max_by(value, o) WHEN 'score' THEN sum(value * n) / sum(n) ELSE avg(value) END, 4) AS value FROM v GROUP BY name""")
def window_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = e.select(F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8).cast("int")).alias("name"), F.col("event_id").alias("order"), "value", (F.col("user_id") % 7).alias("samples"))
    return rounded(N.window_metrics(v, {"last": ["version"], "weighted_avg": ["score"]}), "value", digits=4)


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, max(value) FILTER (k = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS at_part, round(median(value), 6) AS median FROM v GROUP BY 1""")
def index_quantiles(spark, sf_dir):
    return rounded(N.index_quantiles(read(spark, sf_dir, "events"), "value", "event_type"), "median")


@query("""WITH p AS (SELECT o_orderkey % 3 = 0 AS same, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice > 150000 END AS predicted FROM orders)
SELECT count(*) AS n, count(predicted) AS decided, count(*) - count(predicted) AS abstained, count(*) FILTER (predicted = same) AS right, count(*) FILTER (predicted AND NOT same) AS false_merges, count(*) FILTER (NOT predicted AND same) AS missed_merges, round(count(*) FILTER (predicted = same) / count(predicted), 6) AS accuracy, round(count(predicted) / count(*), 6) AS coverage FROM p""".replace(" AS right", ' AS "right"'))
def pair_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 == 0).alias("same"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 150000).alias("predicted"))
    return rounded(N.pair_metrics(o), "accuracy", "coverage")


@query("SELECT o_orderstatus AS status, l_shipmode AS name, CAST(sum(l_linenumber) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL".replace("l_shipmode", "CAST(l_suppkey % 5 AS VARCHAR)"))
def merged_counters(spark, sf_dir):
    name = (F.col("l_suppkey") % 5).cast("string")
    maps = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", name.alias("k")).agg(F.sum("l_linenumber").alias("v")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("counters"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status")).join(maps, "l_orderkey")
    return N.merged_counters(rows, "counters", "status").withColumn("n", F.col("n").cast("long"))


@query("SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 5) AS even, count(value) FILTER (user_id % 2 = 0) AS even_n, round(avg(value) FILTER (value > 50), 5) AS large, count(value) FILTER (value > 50) AS large_n FROM events GROUP BY 1")
def conditional_means(spark, sf_dir):
    of = {"even": F.when(F.col("user_id") % 2 == 0, F.col("value")), "large": F.when(F.col("value") > 50, F.col("value"))}
    return rounded(N.conditional_means(read(spark, sf_dir, "events"), of, "event_type"), "even", "large", digits=5)


@query("""WITH x AS (SELECT l_orderkey AS row_id, avg(abs(l_discount - l_tax)) FILTER (l_linenumber % 3 <> 0) AS difference, avg(CASE WHEN l_partkey % 3 <> l_suppkey % 3 THEN 1.0 ELSE 0 END) FILTER (l_linenumber % 3 <> 0) AS differing FROM lineitem GROUP BY 1)
SELECT row_id, round(difference, 6) AS difference, round(differing, 6) AS differing FROM x""")
def array_differences(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    x = F.collect_list(F.struct(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("m"), (F.col("l_partkey") % 3).alias("p"), (F.col("l_suppkey") % 3).alias("q"))).alias("x")
    rows = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(x).select("row_id", "x.a", "x.b", "x.m", "x.p", "x.q")
    return rounded(rows.select("row_id", N.logp_difference("a", "b", "m").alias("difference"), N.token_differences("p", "q", "m").alias("differing")), "difference", "differing")


@query()
def bootstrap_metric(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return N.bootstrap_metric(e.filter("event_type = 'purchase'"), "user_id", "value", "event_id", 4)


@query("""WITH b AS (SELECT l_orderkey AS row_id, l_quantity > 20 AS on_, l_orderkey % 6 AS step, l_linenumber % 3 <> 0 AS before, l_linenumber % 3 = 1 AS after FROM lineitem)
SELECT step, count(*) FILTER (before) AS tokens_before, count(*) FILTER (after) AS tokens_after, count(*) FILTER (before AND on_) AS signal_before, count(*) FILTER (after AND on_) AS signal_after, round(count(*) FILTER (after AND on_) / count(*) FILTER (before AND on_), 6) AS kept_signal FROM b GROUP BY step""")
def signal_audit(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("pos", F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    t = li.select(F.col("l_orderkey").alias("row_id"), "pos", (F.col("l_orderkey") % 6).alias("step"), F.when(F.col("l_quantity") > 20, 1.0).otherwise(0.0).alias("adv"), (F.col("l_linenumber") % 3).alias("k"))
    out = N.signal_audit(t.withColumn("mask", (F.col("k") != 0).cast("int")), t.withColumn("mask", (F.col("k") == 1).cast("int")))
    return rounded(out, "kept_signal")


@query("SELECT o_orderkey, CAST(ceil(o_orderkey / 50.0) * 50 AS BIGINT) AS boundary FROM orders")
def budget_boundaries(spark, sf_dir):
    return N.budget_boundary(read(spark, sf_dir, "orders"), 50, "o_orderkey").select("o_orderkey", "boundary")


@query("""WITH o AS (SELECT o_orderkey, [CAST(o_custkey % 4 AS VARCHAR), CAST(o_orderkey % 4 AS VARCHAR)] AS t, o_totalprice / 1000 AS v FROM orders), a AS (SELECT count(*) AS n, sum(v) AS s FROM o),
e AS (SELECT tier, count(*) AS support, sum(v) AS t FROM (SELECT v, unnest(list_distinct(t)) AS tier FROM o) GROUP BY tier)
SELECT tier, round(support / n, 6) AS present, support, round(t / support, 4) AS mean_with, round((s - t) / (n - support), 4) AS mean_without, round(CASE WHEN support >= 10 AND n - support >= 10 THEN CASE WHEN abs(t / support - (s - t) / (n - support)) < 0.5 THEN 0 ELSE t / support - (s - t) / (n - support) END END, 4) + 0.0 AS weight FROM e, a""")
def tier_calibration(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.array((F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 4).cast("string")).alias("tiers"), (F.col("o_totalprice") / 1000).alias("v"))
    return rounded(rounded(N.tier_calibration(o, "tiers", "v", 10, 0.5), "mean_with", "mean_without", "weight", digits=4), "present")


@query("""WITH RECURSIVE x AS (SELECT l_orderkey AS row_id, l_quantity AS r, l_discount AS v, CASE WHEN l_linenumber % 3 <> 0 THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC) AS k FROM lineitem),
f AS (SELECT row_id, k, CASE WHEN m = 1 THEN CAST(r - v AS DOUBLE) ELSE 0.0 END AS a, CASE WHEN m = 1 THEN CAST(v AS DOUBLE) ELSE 0.0 END AS nv, CAST(v AS DOUBLE) AS v, m FROM x WHERE k = 1
UNION ALL SELECT x.row_id, x.k, CASE WHEN x.m = 1 THEN x.r + 0.9 * f.nv - x.v + 0.9 * 0.8 * f.a ELSE f.a END, CASE WHEN x.m = 1 THEN x.v ELSE f.nv END, x.v, x.m FROM f JOIN x ON x.row_id = f.row_id AND x.k = f.k + 1),
s AS (SELECT avg(a) FILTER (m = 1) AS mu, var_samp(a) FILTER (m = 1) AS va FROM f) SELECT row_id, round(sum(a + v), 3) AS total_return, round(sum((a - mu) / sqrt(va + 1e-8)), 4) + 0.0 AS advantage FROM f, s GROUP BY row_id""")
def masked_gae(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))).alias("x"))
    rows = li.select("row_id", F.col("x.l_quantity").alias("rewards"), F.col("x.l_discount").alias("values"), F.expr("transform(x, y -> CAST(y.l_linenumber % 3 != 0 AS INT))").alias("mask"))
    out = E.advantage("gae", rows, gamma=0.9, lam=0.8).groupBy("row_id").agg(F.sum("return").alias("total_return"), F.sum("advantage").alias("advantage"))
    return rounded(rounded(out, "total_return", digits=3), "advantage", digits=4)
