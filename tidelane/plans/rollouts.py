"""Queries over rollouts (lineitem: an order is a group) and trials (orders: a customer is a task)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import aggregates as A
from tidelane.operators import estimators as E
from tidelane.operators import relations as R
from tidelane.operators import sequences as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(column: str) -> Column:
    """Rounded for comparison, without negative zeros."""
    return (F.round(column, 8) + 0.0).alias(column)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, row_id, score (0 for a third), length."""
    li = read(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_quantity") % 3 == 0, 0.0).otherwise(F.col("l_quantity") * (1 - F.col("l_discount")))
    return li.select(F.col("l_orderkey").alias("uid"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("row_id"), score.alias("score"), (F.col("l_partkey") % 50 + 1).alias("length"))


ROLLOUTS = """r0 AS (SELECT l_orderkey AS uid, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS row_id, CASE WHEN l_quantity % 3 = 0 THEN 0.0 ELSE l_quantity * (1 - l_discount) END AS score, l_partkey % 50 + 1 AS length FROM lineitem),
r AS (SELECT *, CAST(score AS DOUBLE) AS s FROM r0),
g AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS mu, stddev_samp(s) OVER w AS sd FROM r WINDOW w AS (PARTITION BY uid))"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, trial, reward (1, 0 or nearly 1)."""
    o = read(spark, sf_dir, "orders")
    reward = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 1.0 - 5e-7).otherwise(0.0)
    return S.occurrence(o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey"), reward.alias("reward")), "task_id", "o_orderkey")


TRIALS = """t AS (SELECT o_custkey AS task_id, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 - 5e-7 ELSE 0.0 END AS reward, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial FROM orders),
tc AS (SELECT task_id, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 2) AS c FROM t GROUP BY task_id)"""


def _advantage(name: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.advantage(name, rollouts(spark, sf_dir), **options).select("row_id", tidy("advantage"))

    return run


ADVANTAGES = {
    "grpo_advantage": ("grpo", {}, "CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - mu) / (sd + 1e-6) END", ""),
    "grpo_centred": ("grpo", {"by_std": False}, "CASE WHEN n = 1 THEN s ELSE s - mu END", ""),
    "grpo_vectorized_advantage": ("grpo_vectorized", {}, "CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - mu) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END", ""),
    "rloo_advantage": ("rloo", {}, "CASE WHEN n = 1 THEN s ELSE (n * s - n * mu) / (n - 1) END", ""),
    "rloo_vectorized_advantage": ("rloo_vectorized", {}, "CASE WHEN n = 1 THEN 0 ELSE (n * s - n * mu) / (n - 1) END", ""),
    "opo_advantage": ("opo", {}, "CASE WHEN n = 1 THEN s ELSE s - sum(length * s) OVER (PARTITION BY uid) / sum(length) OVER (PARTITION BY uid) END", ""),
    "gpg_advantage": ("gpg", {}, "(SELECT count(*) / count(*) FILTER (s <> 0) FROM r) * CASE WHEN n = 1 THEN s ELSE s - mu END", ""),
    "episode_advantage": ("episode", {}, "s - mu", ""),
    "reinforce_baseline_advantage": (
        "reinforce_plus_plus_baseline",
        {},
        "(c - m) / sqrt(v + 1e-8)",
        ", b AS (SELECT *, CASE WHEN n = 1 THEN s ELSE s - mu END AS c FROM g), k AS (SELECT sum(length) AS n, sum(length * c) / sum(length) AS m, sum(length * c * c) AS q FROM b), z AS (SELECT b.*, k.m, (k.q / k.n - k.m * k.m) * k.n / (k.n - 1) AS v FROM b, k)",
    ),
}
for _name, (_kind, _options, _sql, _more) in ADVANTAGES.items():
    QUERIES[_name] = _advantage(_kind, **_options)
    SQL[_name] = f"WITH {ROLLOUTS}{_more} SELECT row_id, round(CAST({_sql} AS DOUBLE), 8) + 0.0 AS advantage FROM {'z' if _more else 'g'}"


@query(f"WITH {ROLLOUTS}, x AS (SELECT *, row_number() OVER w AS k, s - lead(s) OVER w AS lead_ FROM g WHERE n > 1 WINDOW w AS (PARTITION BY uid ORDER BY s DESC, row_id)) SELECT row_id, round(CASE WHEN k = 1 THEN lead_ / (sd + 1e-6) ELSE 0 END, 8) + 0.0 AS advantage FROM x")
def grpo_passk_advantage(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("uid"))).filter("n > 1").drop("n")
    return E.advantage("grpo_passk", df).select("row_id", tidy("advantage"))


@query(f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE s - avg(s) OVER w END, 8) + 0.0 AS advantage FROM g WINDOW w AS (PARTITION BY length * 1000 + uid % 10)")
def step_anchor_advantage(spark, sf_dir):
    steps = rollouts(spark, sf_dir).withColumn("anchor", F.col("length") * 1000 + F.col("uid") % 10)
    return E.step_advantage(steps, "score").select("row_id", tidy("advantage"))


def _sequences(spark, sf_dir):
    """One row per order: arrays over its lines."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))).alias("x"))
    return li.select("uid", F.col("x.l_quantity").alias("rewards"), F.col("x.l_discount").alias("values"), F.expr("transform(x, y -> CAST(y.l_linenumber % 3 != 0 AS INT))").alias("mask"))


@query("WITH RECURSIVE x AS (SELECT l_orderkey AS uid, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC) AS k FROM lineitem), f AS (SELECT uid, k, CAST(q AS DOUBLE) AS v FROM x WHERE k = 1 UNION ALL SELECT x.uid, x.k, x.q + 0.5 * f.v FROM f JOIN x ON x.uid = f.uid AND x.k = f.k + 1) SELECT uid, round(max_by(v, k), 4) AS first_return, round(sum(v), 4) AS total FROM f GROUP BY uid")
def discounted_returns(spark, sf_dir):
    out = _sequences(spark, sf_dir).select("uid", E.discounted_returns("rewards", 0.5).alias("r"))
    return out.select("uid", F.round(F.element_at("r", 1), 4).alias("first_return"), F.round(F.aggregate("r", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("WITH RECURSIVE x AS (SELECT l_orderkey AS uid, l_quantity AS q, l_discount AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC) AS k FROM lineitem), f AS (SELECT uid, k, CAST(v AS DOUBLE) AS nv, CAST(q - v AS DOUBLE) AS a FROM x WHERE k = 1 UNION ALL SELECT x.uid, x.k, x.v, x.q + 0.9 * f.nv - x.v + 0.9 * 0.8 * f.a FROM f JOIN x ON x.uid = f.uid AND x.k = f.k + 1) SELECT uid, round(sum(a), 4) AS total FROM f GROUP BY uid")
def gae_advantage(spark, sf_dir):
    out = _sequences(spark, sf_dir).select("uid", E.gae("rewards", "values", 0.9, 0.8).alias("a"))
    return out.select("uid", F.round(F.aggregate("a", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("SELECT l_orderkey * 100 + l_linenumber AS row_id, round(d, 6) AS k1, round(0.5 * d * d, 6) AS k2, round(exp(-d) + d - 1, 6) AS k3 FROM (SELECT *, l_discount - l_tax AS d FROM lineitem)")
def kl_penalties(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    est = lambda k: F.round(E.kl_penalty(k, "l_discount", "l_tax"), 6).alias(k)
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"), est("k1"), est("k2"), est("k3"))


def _pass_sql(k: int) -> str:
    at = "1.0" + "".join(f" * (n - c - {i}) / greatest(n - {i}, 1)" for i in range(k))
    hat = "1.0" + "".join(f" * greatest(c - {i}, 0) / greatest(n - {i}, 1)" for i in range(k))
    return f"CASE WHEN n >= {k} THEN CASE WHEN n - c < {k} THEN 1.0 ELSE 1 - {at} END END AS pass_at_{k}, CASE WHEN n >= {k} THEN {hat} END AS pass_hat_{k}"


KS = (1, 2, 4)
_PASS = f"p AS (SELECT task_id, n, c, {', '.join(_pass_sql(k) for k in KS)} FROM tc)"
_ROUNDED = ", ".join(f"round(pass_{x}_{k}, 6) AS pass_{x}_{k}" for k in KS for x in ("at", "hat"))


@query(f"WITH {TRIALS}, {_PASS} SELECT task_id, n, c, {_ROUNDED} FROM p")
def task_pass_k(spark, sf_dir):
    out = A.task_pass(trials(spark, sf_dir), KS)
    return out.select("task_id", "n", "c", *(F.round(f"pass_{x}_{k}", 6).alias(f"pass_{x}_{k}") for k in KS for x in ("at", "hat")))


@query(f"WITH {TRIALS}, {_PASS} SELECT count(*) AS tasks, " + ", ".join(f"round(avg(pass_{x}_{k}), 6) AS pass_{x}_{k}" for k in KS for x in ("at", "hat")) + " FROM p")
def macro_pass_k(spark, sf_dir):
    out = A.macro_pass(trials(spark, sf_dir), KS)
    return out.select("tasks", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"WITH {TRIALS} SELECT count(*) AS planned, count(*) FILTER (trial < 20) AS scored, count(*) = count(*) FILTER (trial < 20) AS complete, CASE WHEN count(*) = count(*) FILTER (trial < 20) THEN round(avg(reward), 6) END AS mean_reward, CASE WHEN count(*) = count(*) FILTER (trial < 20) THEN round(avg(CASE WHEN o_orderkey % 3 <> 2 THEN 1.0 ELSE 0.0 END), 6) END AS solve_rate FROM t")
def trial_summary(spark, sf_dir):
    t = trials(spark, sf_dir)
    out = A.trial_summary(t.select("task_id", "trial"), t.filter("trial < 20"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_reward", "solve_rate")})


@query(f"WITH {ROLLOUTS} SELECT uid, n, round(CASE WHEN n > 1 THEN m ELSE 0 END, 5) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(v, 1e-6)) ELSE 1 END, 5) AS std FROM (SELECT uid, count(*) AS n, avg(s) AS m, var_samp(s) AS v FROM r GROUP BY uid)")
def group_mean_std(spark, sf_dir):
    return A.group_mean_std(rollouts(spark, sf_dir), "uid", "score").select("uid", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN count(*) OVER w < 2 OR max(s) OVER w = min(s) OVER w THEN 0 ELSE (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-6) END, 8) + 0.0 AS normalized FROM r WINDOW w AS (PARTITION BY uid)")
def group_normalize(spark, sf_dir):
    return A.group_normalize(rollouts(spark, sf_dir), "uid", "score").select("row_id", tidy("normalized"))


@query(f"WITH {ROLLOUTS}, v AS (SELECT uid, length % 4 AS vote, count(*) AS votes, min(row_id) AS first, first(score ORDER BY row_id, score) AS score FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, first) AS n FROM v) SELECT uid, vote, votes, CAST(score AS DOUBLE) AS score FROM k WHERE n = 1")
def majority_vote(spark, sf_dir):
    return A.majority_vote(rollouts(spark, sf_dir).withColumn("vote", F.col("length") % 4), "uid", "vote", "score", "row_id")


@query(f"WITH {ROLLOUTS}, m AS (SELECT s, CASE WHEN length % 2 = 0 THEN 1.0 ELSE 0.0 END AS k FROM r), a AS (SELECT sum(k) AS n, sum(s * k) AS t, sum(s * s * k) AS q FROM m) SELECT round(t, 3) AS masked_sum, round(t / (n + 1e-8), 5) AS masked_mean, round((q / n - t / n * (t / n)) * n / (n - 1), 4) AS masked_var FROM a")
def masked_statistics(spark, sf_dir):
    out = A.masked_stats(rollouts(spark, sf_dir).withColumn("mask", (F.col("length") % 2 == 0).cast("int")), "score", "mask")
    return out.select(F.round("masked_sum", 3).alias("masked_sum"), F.round("masked_mean", 5).alias("masked_mean"), F.round("masked_var", 4).alias("masked_var"))


@query(f"WITH {ROLLOUTS}, m AS (SELECT uid, s, CASE WHEN length % 3 = 0 THEN 0.0 ELSE 1.0 END AS k FROM r), p AS (SELECT uid, sum(s * k) AS t, sum(k) AS n FROM m GROUP BY uid HAVING sum(k) > 0) SELECT 'seq-mean-token-mean' AS mode, round(avg(t / (n + 1e-8)), 5) AS loss FROM p UNION ALL SELECT 'seq-mean-token-sum', round(avg(t), 5) FROM p UNION ALL SELECT 'token-mean', round(sum(s * k) / sum(k), 5) FROM m")
def loss_aggregation(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("mask", (F.col("length") % 3 != 0).cast("int"))
    modes = ["seq-mean-token-mean", "seq-mean-token-sum", "token-mean"]
    parts = [A.aggregate_loss(df, "score", "mask", "uid", m).select(F.lit(m).alias("mode"), F.round("loss", 5).alias("loss")) for m in modes]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {ROLLOUTS}, k AS (SELECT uid, CASE WHEN max(s) = 0 THEN 'all_zero' WHEN min(s) >= 1000 THEN 'all_one' WHEN min(s) = max(s) THEN 'no_contrast' ELSE 'informative' END AS kind, count(*) AS n FROM r GROUP BY uid) SELECT kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n_rows FROM k GROUP BY kind")
def dynamic_filter(spark, sf_dir):
    out = R.group_filter_mask(rollouts(spark, sf_dir), "uid", "score", 1000.0)
    return out.groupBy("kind").agg(F.countDistinct("uid").alias("groups"), F.count("*").alias("n_rows"))


@query(f"WITH {ROLLOUTS}, k AS (SELECT uid, min(row_id) AS seen, min(s) <> max(s) AS d FROM r GROUP BY uid), f AS (SELECT uid FROM (SELECT * FROM k ORDER BY seen LIMIT 500) WHERE d ORDER BY seen LIMIT 100) SELECT row_id, uid FROM r WHERE uid IN (SELECT uid FROM f)")
def fixed_informative_prefix(spark, sf_dir):
    return R.first_informative(rollouts(spark, sf_dir), "uid", "score", "row_id", 100, 500).select("row_id", "uid")


@query("SELECT l_returnflag, count(*) AS n, 1.0 AS coverage, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 5) AS mean, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1")
def distribution(spark, sf_dir):
    out = A.distribution(read(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 5)})


@query("SELECT l_shipmode_ AS name, round(CASE WHEN l_shipmode_ LIKE '%max%' THEN max(l_tax) WHEN l_shipmode_ LIKE '%min%' THEN min(l_tax) ELSE avg(l_tax) END, 6) AS value FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'loss/max' WHEN 1 THEN 'loss/min' ELSE 'loss' END AS l_shipmode_ FROM lineitem) GROUP BY 1")
def reduce_metrics(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    li = read(spark, sf_dir, "lineitem").select(F.when(k == 0, "loss/max").when(k == 1, "loss/min").otherwise("loss").alias("name"), "l_tax")
    return A.reduce_metrics(li, "name", "l_tax").withColumn("value", F.round("value", 6))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
def pearson(spark, sf_dir):
    return A.correlation(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("correlation", F.round("correlation", 6))


@query("SELECT count(*) AS n, round(corr(x, y), 6) AS correlation FROM (SELECT l_quantity - avg(l_quantity) OVER w AS x, l_tax - avg(l_tax) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))")
def within_group_correlation(spark, sf_dir):
    return A.association(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_tax").withColumn("correlation", F.round("correlation", 6))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 5) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 5) AS O FROM lineitem GROUP BY 1")
def action_rate_pivot(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return out.select("l_returnflag", F.round("F", 5).alias("F"), F.round("O", 5).alias("O"))


@query()
def paired_bootstrap(spark, sf_dir):
    means = trials(spark, sf_dir).groupBy("task_id").agg(F.avg(F.when(F.col("trial") % 2 == 0, F.col("reward"))).alias("baseline"), F.avg(F.when(F.col("trial") % 2 == 1, F.col("reward"))).alias("treatment"))
    return A.paired_bootstrap(means)


_HASH = "SELECT *, row_number() OVER (ORDER BY sha256('42:' || CAST(o_orderkey AS VARCHAR))) AS n FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN n <= 1000 THEN 'train' WHEN n <= 1300 THEN 'selection' ELSE 'reserve' END AS split FROM ({_HASH})")
def hash_ranked_split(spark, sf_dir):
    return S.hash_rank_split(read(spark, sf_dir, "orders"), "o_orderkey", 42, {"train": 1000, "selection": 300}).select("o_orderkey", "split")


@query(f"WITH {TRIALS} SELECT task_id, o_orderkey, trial FROM t")
def sampling_identities(spark, sf_dir):
    return trials(spark, sf_dir).select("task_id", "o_orderkey", F.col("trial").cast("long").alias("trial"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return S.latest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, unnest(range(0, l_linenumber)) AS copy FROM lineitem")
def repeat_rows(spark, sf_dir):
    return S.repeat_rows(read(spark, sf_dir, "lineitem"), "l_linenumber").select("l_orderkey", "l_linenumber", F.col("copy").cast("long").alias("copy"))


@query("WITH p AS (SELECT p_partkey, 24576 * p_size + p_size * p_size AS cost FROM part), q AS (SELECT *, row_number() OVER (ORDER BY cost DESC, p_partkey) - 1 AS k FROM p) SELECT CAST(CASE WHEN k // 8 % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS INT) AS part, CAST(sum(cost) AS BIGINT) AS load, count(*) AS n FROM q GROUP BY 1")
def balanced_partitions(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", S.workload("p_size").cast("long").alias("cost"))
    return S.snake_partitions(p, "cost", "p_partkey", 8).groupBy("part").agg(F.sum("cost").alias("load"), F.count("*").alias("n"))
