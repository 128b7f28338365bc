"""Queries over turns and tokens (an order's lines), policies, and audits of trials and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import audits as D
from tidelane.operators import credit as C
from tidelane.operators import estimators as E
from tidelane.operators import policy as P
from tidelane.operators import sequences as S
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


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded for comparison, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid (four orders), row_id (order), pos, reward, mask, energy."""
    li = read(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")) - 1
    return li.select(
        F.floor(F.col("l_orderkey") / 4).alias("uid"), F.col("l_orderkey").alias("row_id"), place.alias("pos"), F.col("l_quantity").alias("reward"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"), (F.col("l_discount") + F.col("l_tax") + 0.125).alias("energy")
    )


TOKENS = """x AS (SELECT l_orderkey // 4 AS uid, l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS pos, l_quantity AS reward,
CAST(l_linenumber % 3 <> 0 AS INT) AS mask, l_discount + l_tax + 0.125 AS energy FROM lineitem)"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: rewards and mask in order."""
    rows = tokens(spark, sf_dir).groupBy("uid", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "reward", "mask"))).alias("x"))
    return rows.select("uid", "row_id", F.col("x.reward").alias("rewards"), F.col("x.mask").alias("mask"))


@query(f"""WITH {TOKENS}, k AS (SELECT uid, row_id, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL),
ep AS (SELECT *, CASE WHEN count(*) OVER w < 2 OR max(n) OVER w = min(n) OVER w THEN 0 ELSE (n - avg(n) OVER w) / (stddev_pop(n) OVER w + 1e-6) END AS episode FROM k WINDOW w AS (PARTITION BY uid)),
g AS (SELECT a.uid, a.row_id, a.pos, sum(b.reward * pow(0.5, b.pos - a.pos)) AS s FROM x a JOIN x b ON a.row_id = b.row_id AND b.pos >= a.pos GROUP BY ALL),
r AS (SELECT g.*, episode, s + pow(0.5, n - pos) * n AS ret FROM g JOIN ep USING (uid, row_id))
SELECT row_id, pos AS turn, round(ret, 6) + 0.0 AS turn_return, round(CAST(episode AS DOUBLE), 6) + 0.0 AS episode,
  round(CASE WHEN count(*) OVER w < 2 OR max(ret) OVER w = min(ret) OVER w THEN 0 ELSE (ret - avg(ret) OVER w) / (stddev_pop(ret) OVER w + 1e-6) END + 0.25 * episode, 6) + 0.0 AS advantage FROM r WINDOW w AS (PARTITION BY uid, pos)""")
def turn_credit(spark, sf_dir):
    rows = arrays(spark, sf_dir).select("uid", "row_id", F.col("rewards").alias("turn_rewards"), F.size("rewards").cast("double").alias("outcome"))
    out = C.turn_credit(rows, gamma=0.5, outcome_weight=0.25).select("row_id", F.col("turn").cast("long").alias("turn"), "turn_return", "episode", "advantage")
    return rounded(out, "turn_return", "episode", "advantage")


@query(f"""WITH RECURSIVE {TOKENS}, y AS (SELECT row_id, reward AS r, mask AS m, row_number() OVER (PARTITION BY row_id ORDER BY pos DESC) AS k, pos FROM x),
f AS (SELECT row_id, k, pos, CAST(r AS DOUBLE) AS g, m FROM y WHERE k = 1 UNION ALL SELECT y.row_id, y.k, y.pos, y.r + 0.5 * f.g * f.m, y.m FROM f JOIN y ON y.row_id = f.row_id AND y.k = f.k + 1),
z AS (SELECT sum(m) AS n, sum(g * m) / sum(m) AS mu, sum(g * g * m) AS q FROM f)
SELECT row_id, pos, round(g, 6) AS token_return, round((g - mu) / sqrt((q / n - mu * mu) * n / (n - 1) + 1e-8) * m, 6) + 0.0 AS advantage FROM f, z""")
def reinforce_plus_plus(spark, sf_dir):
    out = C.reinforce_plus_plus(arrays(spark, sf_dir), gamma=0.5).withColumn("pos", F.col("pos").cast("long"))
    return rounded(out, "token_return", "advantage")


@query(f"WITH {TOKENS} SELECT row_id, pos, round(sum(reward * mask) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 20.0 * mask, 6) + 0.0 AS advantage FROM x")
def remax_advantage(spark, sf_dir):
    rows = arrays(spark, sf_dir).withColumn("baseline", F.lit(20.0))
    out = rows.select("row_id", F.posexplode(C.remax("rewards", "baseline", "mask")).alias("pos", "advantage"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "advantage")


@query(f"""WITH {TOKENS}, o AS (SELECT *, sum(reward * mask) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g, sum(energy * mask) OVER (l ROWS UNBOUNDED PRECEDING) AS w, sum(mask) OVER (PARTITION BY row_id) AS len FROM x WINDOW l AS (PARTITION BY row_id ORDER BY pos)),
q AS (SELECT uid, row_id, any_value(len) AS len FROM o GROUP BY ALL), t AS (SELECT uid, count(*) AS n, list_reverse_sort(list(len)) AS top FROM q GROUP BY uid),
b AS (SELECT o.*, n, top, sum(g * w * mask) OVER p / (sum(w * mask) OVER p + 1e-8) AS base FROM o JOIN t USING (uid) WINDOW p AS (PARTITION BY uid, pos))
SELECT row_id, pos, round(g, 6) + 0.0 AS token_return, round((g - CASE WHEN n = 1 OR (len = top[1] AND top[2] < len AND pos >= top[2]) THEN 0 ELSE base END) * mask, 6) + 0.0 AS advantage FROM b""")
def token_baseline_advantage(spark, sf_dir):
    out = C.token_baseline(tokens(spark, sf_dir), zero_tail=True).select("row_id", F.col("pos").cast("long").alias("pos"), "token_return", "advantage")
    return rounded(out, "token_return", "advantage")


@query(f"WITH {TOKENS} SELECT row_id, pos, round(10.0 * pow(0.5, count(*) OVER (PARTITION BY row_id) - 1 - pos), 8) AS value FROM x")
def step_returns(spark, sf_dir):
    steps = tokens(spark, sf_dir).withColumn("outcome", F.lit(10.0))
    out = C.step_returns(steps, step="pos", gamma=0.5).select("row_id", F.col("pos").cast("long").alias("pos"), "value")
    return rounded(out, "value", digits=8)


@query(f"""WITH {ROLLOUTS}, h AS (SELECT row_id, uid, length, s, CAST(length AS DOUBLE) AS s2 FROM r),
a AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN s / (1 + 1e-6) ELSE (s - avg(s) OVER w) / (stddev_samp(s) OVER w + 1e-6) END + 0.5 * CASE WHEN count(*) OVER w = 1 THEN s2 / (1 + 1e-6) ELSE (s2 - avg(s2) OVER w) / (stddev_samp(s2) OVER w + 1e-6) END AS t FROM h WINDOW w AS (PARTITION BY uid)),
z AS (SELECT sum(length) AS n, sum(length * t) / sum(length) AS mu, sum(length * t * t) AS q FROM a)
SELECT row_id, round((t - mu) / sqrt((q / n - mu * mu) * n / (n - 1) + 1e-8), 6) + 0.0 AS advantage FROM a, z""")
def gdpo_advantage(spark, sf_dir):
    rows = rollouts(spark, sf_dir).withColumn("score2", F.col("length").cast("double"))
    return rounded(E.advantage("gdpo", rows, scores=("score", "score2"), weights=(1.0, 0.5)).select("row_id", "advantage"), "advantage")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("row_id"), (-(F.col("l_tax") * 5 + 0.125)).alias("logp"), (-(F.col("l_discount") * 4 + 0.125)).alias("old"), ((F.col("l_quantity") - 25) / 10).alias("adv"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"))


POLICIES = """t AS (SELECT l_orderkey AS row_id, -(l_tax * 5 + 0.125) AS logp, -(l_discount * 4 + 0.125) AS old, (l_quantity - 25) / 10 AS adv, CASE WHEN l_linenumber % 3 <> 0 THEN 1.0::DOUBLE ELSE 0 END AS m FROM lineitem),
u AS (SELECT *, exp(logp - old) AS ratio, exp(logp) AS p, exp(old) AS q, sum((logp - old) * m) OVER w / greatest(sum(m) OVER w, 1) AS mean FROM t WINDOW w AS (PARTITION BY row_id)),
v AS (SELECT *, q * (old - logp) + (1 - q) * ln((1 - q + 1e-8) / (1 - p + 1e-8)) AS bkl, CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END AS tau FROM u)"""
_CUT = "greatest(0.8, least(1.2, ratio))"
_TV = "CASE WHEN adv > 0 THEN p - q <= 0.2 ELSE p - q >= -0.2 END"
_KL = "CASE WHEN adv > 0 THEN bkl <= 0.2 OR p <= q ELSE bkl <= 0.2 OR p >= q END"
#: name: loss of a token, whether it was clipped, whether from below.
LOSS_SQL = {
    "vanilla": (f"CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * ratio, -adv * {_CUT})) ELSE greatest(-adv * ratio, -adv * {_CUT}) END", f"-adv * {_CUT} > -adv * ratio", f"adv < 0 AND greatest(-adv * ratio, -adv * {_CUT}) > -adv * 3"),
    "dppo_tv": (f"-adv * least(ratio, 20) * logp * CASE WHEN {_TV} THEN 1 ELSE 0 END", f"NOT {_TV}", f"ratio > 20 AND {_TV}"),
    "dppo_kl": (f"-adv * least(ratio, 20) * logp * CASE WHEN {_KL} THEN 1 ELSE 0 END", f"NOT ({_KL})", f"ratio > 20 AND ({_KL})"),
    "gspo": ("greatest(-adv * exp(mean), -adv * greatest(0.8, least(1.2, exp(mean))))", "-adv * greatest(0.8, least(1.2, exp(mean))) > -adv * exp(mean)", "false"),
    "sapo": ("-(4 / tau) / (1 + exp(-tau * (ratio - 1))) * adv", "false", "false"),
    "gpg": ("-logp * adv", "false", "false"),
    "cispo": (f"-{_CUT} * adv * logp", f"ratio <> {_CUT}", "false"),
}


def _loss_sql(name: str) -> str:
    loss, clipped, lower = LOSS_SQL[name]
    value = f"(SELECT avg(a) FROM (SELECT sum(({loss}) * m) / (sum(m) + 1e-8) AS a FROM v GROUP BY row_id HAVING sum(m) > 0))" if name in P.BY_SEQUENCE else f"sum(({loss}) * m) / sum(m)"
    share = lambda x: f"sum(CASE WHEN {x} THEN m ELSE 0 END) / (sum(m) + 1e-8)"
    return f"SELECT '{name}' AS name, round({value}, 6) AS loss, round({share(clipped)}, 6) AS clip_fraction, round({share(lower)}, 6) AS clip_fraction_lower, round(sum((old - logp) * m) / (sum(m) + 1e-8), 6) AS kl FROM v"


_GEO = """SELECT 'geo_mean' AS name, round(avg(-a / (n + 1e-8) * exp(s / (n + 1e-8))), 6) AS loss, round(sum(c) / (sum(n) + 1e-8), 6) AS clip_fraction, round(sum(l) / (sum(n) + 1e-8), 6) AS clip_fraction_lower, round(sum(k) / (sum(n) + 1e-8), 6) AS kl
FROM (SELECT row_id, sum(m) AS n, sum(adv * m) AS a, sum(m * CASE WHEN adv > 0 THEN least(logp - old, 0.2) WHEN adv < 0 THEN greatest(logp - old, -0.2) ELSE 0 END) AS s,
  sum(CASE WHEN adv > 0 AND (logp - old > 0.2 OR logp - old < -0.2) THEN m ELSE 0 END) AS c, sum(CASE WHEN adv < 0 AND (logp - old > 0.2 OR logp - old < -0.2) THEN m ELSE 0 END) AS l, sum((old - logp) * m) AS k FROM v GROUP BY row_id)"""


@query(f"WITH {POLICIES} " + " UNION ALL ".join([*map(_loss_sql, LOSS_SQL), _GEO]))
def policy_losses(spark, sf_dir):
    t = policies(spark, sf_dir)
    out = None
    for name in [*LOSS_SQL, "geo_mean"]:
        one = P.policy_loss(name, t).select(F.lit(name).alias("name"), "loss", "clip_fraction", "clip_fraction_lower", "kl")
        out = one if out is None else out.union(one)
    return rounded(out, "loss", "clip_fraction", "clip_fraction_lower", "kl")


@query(f"""WITH {POLICIES}, e AS (SELECT m, adv, old, logp, power(logp - adv, 2) AS a, power(greatest(least(logp, old + 0.1), old - 0.1) - adv, 2) AS b FROM t)
SELECT round(0.5 * sum(greatest(a, b) * m) / sum(m), 6) AS loss, round(sum(CASE WHEN b > a THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction FROM e""")
def value_loss(spark, sf_dir):
    t = policies(spark, sf_dir).withColumnsRenamed({"logp": "pred", "old": "value", "adv": "target"})
    return rounded(P.value_loss(t, 0.1), "loss", "clip_fraction")


@query(f"""WITH {POLICIES}, s AS (SELECT row_id, sum((logp - old) * m) AS d, sum(m) AS n FROM t GROUP BY row_id), w AS (SELECT row_id, least(exp(d), 2) AS w, n FROM s), k AS (SELECT avg(n * w / (n + 1e-8)) AS mu FROM w WHERE n > 0)
SELECT row_id, round(w / mu, 6) AS weight, CAST(n AS BIGINT) AS n FROM w, k WHERE n > 0""")
def sequence_weights(spark, sf_dir):
    out = P.importance_weights(policies(spark, sf_dir), "sequence", normalize=True)
    return rounded(out.groupBy("row_id").agg(F.max("weight").alias("weight"), F.sum("mask").alias("n")).filter("n > 0"), "weight")


@query(f"""WITH {POLICIES}, w AS (SELECT m, least(ratio, 2) * m AS w FROM u), c AS (SELECT m, w, greatest(0.5, least(2, w)) AS k FROM w), a AS (SELECT sum(k * m) / (sum(m) + 1e-8) AS mu, sum(k * k * m) / (sum(m) + 1e-8) AS sq, sum(w * m) / (sum(m) + 1e-8) AS wm FROM c)
SELECT round(wm, 6) AS weight_mean, round((mu + 1e-8) * (mu + 1e-8) / sq, 6) AS effective_sample_size FROM a""")
def effective_sample_size(spark, sf_dir):
    return rounded(P.effective_sample_size(P.importance_weights(policies(spark, sf_dir))), "weight_mean", "effective_sample_size")


_OFF = ["training_ppl", "training_log_ppl", "rollout_ppl", "rollout_log_ppl", "kl", "k3_kl", "log_ppl_diff", "log_ppl_abs_diff", "log_ppl_diff_max", "log_ppl_diff_min", "ppl_ratio", "chi2_token", "chi2_seq"]


@query(f"""WITH {POLICIES}, s AS (SELECT sum(m) AS n, sum(logp * m) / (sum(m) + 1e-8) AS a, sum(old * m) / (sum(m) + 1e-8) AS b, sum((logp - old) * m) AS d, sum((ratio - (logp - old) - 1) * m) AS k, sum(ratio * ratio * m) AS r FROM u GROUP BY row_id)
SELECT round(avg(exp(-a)), 6) AS training_ppl, round(avg(-a), 6) AS training_log_ppl, round(avg(exp(-b)), 6) AS rollout_ppl, round(avg(-b), 6) AS rollout_log_ppl, round(-sum(d) / (sum(n) + 1e-8), 6) AS kl, round(sum(k) / (sum(n) + 1e-8), 6) AS k3_kl,
round(avg(b - a), 6) AS log_ppl_diff, round(avg(abs(b - a)), 6) AS log_ppl_abs_diff, round(max(b - a), 6) AS log_ppl_diff_max, round(min(b - a), 6) AS log_ppl_diff_min, round(avg(exp(b - a)), 6) AS ppl_ratio, round(sum(r) / (sum(n) + 1e-8) - 1, 6) AS chi2_token, round(avg(exp(2 * d)) - 1, 6) AS chi2_seq FROM s""")
def off_policy_metrics(spark, sf_dir):
    return rounded(P.off_policy_metrics(policies(spark, sf_dir)), *_OFF)


@query("""WITH c AS (SELECT o_custkey AS task_id, count(*) AS trials, count(*) FILTER (o_orderkey % 11 = 0) AS unresolved, count(*) FILTER (o_orderstatus = 'F') AS successes FROM orders GROUP BY 1)
SELECT *, CASE WHEN unresolved > 0 THEN 'environment_or_unscorable' WHEN successes = trials THEN 'stable_success' WHEN successes = 0 THEN 'stable_failure' ELSE 'mixed_success' END AS bucket, CASE WHEN unresolved = 0 THEN round(successes / trials, 6) END AS success_rate FROM c""")
def task_buckets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderkey") % 11 != 0).alias("complete"))
    return D.task_buckets(o).withColumn("success_rate", F.round("success_rate", 6))


@query("""WITH t AS (SELECT user_id AS arm, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value > 20 AS b FROM events), s AS (SELECT arm, event_id, k + k // 7 AS step, coalesce(b, false) AS b FROM t),
i AS (SELECT *, step - row_number() OVER (PARTITION BY arm, b ORDER BY step) AS island FROM s), r AS (SELECT *, CASE WHEN b THEN row_number() OVER (PARTITION BY arm, b, island ORDER BY step) ELSE 0 END AS streak FROM i)
SELECT arm, event_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS halt FROM r""")
def breach_streaks(spark, sf_dir):
    e = S.occurrence(read(spark, sf_dir, "events").withColumnRenamed("user_id", "arm"), "arm", "event_id")
    out = D.breach_streaks(e.withColumn("step", F.col("trial") + F.floor(F.col("trial") / 7)), F.col("value") > 20, 3)
    return out.select("arm", "event_id", F.col("streak").cast("long").alias("streak"), "halt")


@query(f"""WITH {TOKENS}, i AS (SELECT row_id, pos, pos - row_number() OVER (PARTITION BY row_id ORDER BY pos) AS island FROM x WHERE mask = 1)
SELECT row_id, min(pos) AS start, max(pos) + 1 AS "end", true AS restored FROM i GROUP BY row_id, island""")
def mask_runs(spark, sf_dir):
    runs = arrays(spark, sf_dir).withColumn("runs", D.mask_runs("mask"))
    same = (D.restore_mask("runs", "size(mask)") == F.col("mask")).alias("restored")
    return runs.select("row_id", F.explode("runs").alias("r"), same).select("row_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"), "restored")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR))) <= round(0.1 * count(*) OVER ()) AS held FROM orders")
def fraction_split(spark, sf_dir):
    return D.fraction_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1, 7)


@query("""WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('42:' || CAST(s_suppkey AS VARCHAR))) - 1 AS k, count(*) OVER () AS n FROM supplier), a AS (SELECT unnest(range(0, 320)) AS i)
SELECT i // 8 AS update_index, i % 8 AS slot, s_suppkey FROM a JOIN p ON a.i % p.n = p.k""")
def cyclic_schedule(spark, sf_dir):
    return D.cyclic_schedule(read(spark, sf_dir, "supplier"), "s_suppkey", 42, 8, 40)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice - 1 ELSE o_totalprice END AS accounted FROM orders)
SELECT o_custkey, o_orderkey, round(sum(accounted) OVER w, 2) AS running, sum(accounted) OVER w <= 500000 AS within FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def budget_ledger(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("settled", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") - 1))
    out = D.budget_ledger(o, 500000, "o_custkey", "o_orderkey", "o_totalprice")
    return rounded(out.select("o_custkey", "o_orderkey", "running", "within"), "running", digits=2)


@query("""WITH w AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS seen, event_id % 7 <> 0 AS ok, CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN 1 ELSE 0 END AS own FROM events),
n AS (SELECT *, sum(own) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM w),
l AS (SELECT *, max(CASE WHEN ok THEN event_id END) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM n)
SELECT l.user_id, l.event_id, previous, CAST(l.n - l.own - p.n AS BIGINT) AS writes_between, p.seen <> l.seen AS changed FROM l JOIN n p ON p.user_id = l.user_id AND p.event_id = previous""")
def repeated_calls(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("seen", F.floor("value"))
    return D.repeated_calls(e, "user_id", "event_type", "event_id", F.col("event_type") == "purchase", "seen", F.col("event_id") % 7 == 0).select("user_id", "event_id", "previous", "writes_between", "changed")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def segment_ranks(spark, sf_dir):
    return D.ranks(read(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", ["c_mktsegment"]).select("c_custkey", F.col("rank").cast("long").alias("rank"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("source"), F.col("o_custkey").alias("uid"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query()
def validation_metrics(spark, sf_dir):
    """Means, deviations, best, worst and majority values at N, for three sources."""
    return D.validation_metrics(_responses(spark, sf_dir), "source", "uid", "o_totalprice", "o_orderkey", "o_orderstatus", resamples=200)
