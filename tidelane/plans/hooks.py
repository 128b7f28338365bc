"""Queries over rewards, jobs, caches, budgets, fused retrieval and windows of event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import hooks as H
from tidelane.operators import retrieval as V
from tidelane.plans.credits import rounded
from tidelane.plans.rollouts import read
from tidelane.sources import files
from tidelane.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, trial, ('0x' || substr(sha256('7:' || c_custkey || ':' || trial), 1, 8))::BIGINT % 2147483647 AS seed FROM customer, (VALUES (0), (1), (2)) v(trial)")
def evaluation_jobs(spark, sf_dir):
    return H.jobs(read(spark, sf_dir, "customer"), 3, 7, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS naive, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS batch, round(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END + least(-(o_orderkey % 100 - 60) / 20.0 * 0.5, 0), 6) AS dapo, CASE WHEN o_orderkey % 10 = 0 THEN -1.0 WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS guarded FROM orders")
def managed_rewards(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 100).alias("length"), F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise(F.col("o_orderstatus")).alias("some"))
    a, truth = F.col("o_orderstatus"), F.lit("F")
    same = lambda x, y: float(x == y)

    def broken(x: str, y: str) -> float:
        if x == "bad":
            raise ValueError(x)
        return float(x == y)

    out = o.select(
        "o_orderkey", H.each_reward(same, a, truth).alias("naive"), H.batch_rewards(lambda xs, ys: [float(x == y) for x, y in zip(xs, ys)], a, truth).alias("batch"),
        H.dapo_rewards(same, a, truth, F.col("length"), 80, 20, 0.5).alias("dapo"), H.guarded_rewards(broken, F.col("some"), truth, -1.0).alias("guarded"),
    )
    return rounded(out, "dapo")


@query("SELECT count(*) AS docs, count(DISTINCT sha256(coalesce(text, ''))) FILTER (sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)) AS new, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total FROM documents")
def embedding_cache(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    embed = lambda x: x.withColumn("embedding", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    none = spark.createDataFrame([], "content_hash string, embedding long")
    _, cache = H.cached_embeddings(d.filter("doc_id % 3 = 0"), none, embed)
    every, new = H.cached_embeddings(d, cache, embed)
    return every.agg(F.count("*").alias("docs"), F.sum("embedding").alias("total")).crossJoin(new.agg(F.count("*").alias("new")))


@query("WITH l AS (SELECT o_custkey AS account, sum(CASE WHEN o_orderkey % 3 = 0 THEN 5.0 ELSE o_orderkey % 4 END) AS accounted FROM orders GROUP BY 1) SELECT account, accounted, accounted + account % 2 AS actual, CAST(account % 2 AS DOUBLE) AS correction FROM l")
def budget_reconciled(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.lit(5.0).alias("reserved"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 4).cast("double")).alias("settled"))
    billed = o.groupBy("account").agg((F.sum(F.coalesce("settled", "reserved")) + F.first(F.col("account") % 2)).alias("amount"))
    return H.reconciled(o, billed)


@query("""WITH a AS (SELECT s_nationkey AS q, s_suppkey AS d, s_acctbal AS s FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 5000.0 FROM supplier WHERE s_suppkey % 2 = 0), m AS (SELECT q, d, max(s) AS s FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS n FROM m) SELECT q AS query_id, d AS doc_id, s AS score FROM r WHERE n <= 3 AND s >= 1000""")
def fused_retrieval(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("doc_id"), F.col("s_acctbal").cast("double").alias("score"))
    both = V.fuse([s, s.filter("doc_id % 2 = 0").withColumn("score", F.lit(5000.0))], 3)
    return H.least_score(both, 1000.0, 3).select("query_id", "doc_id", "score")


@query("SELECT o_orderkey, 'structured:' || substr(sha256(o_orderstatus || '/' || (o_custkey % 5)), 1, 16) AS anchor FROM orders")
def encoded_anchors(spark, sf_dir):
    features = F.concat_ws("/", "o_orderstatus", (F.col("o_custkey") % 5).cast("string"))
    return H.encoded_anchors(read(spark, sf_dir, "orders"), features).select("o_orderkey", "anchor")


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey % 3) AS anchors FROM orders GROUP BY 1")
def clustered_anchors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array((F.col("o_orderkey") % 3).cast("string"), F.lit("x")).alias("f"))
    out = H.clustered_anchors(o, "o_custkey", "o_orderkey", "f", 0.9)
    return out.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("anchor").alias("anchors"))


@query("WITH t AS (SELECT c_mktsegment AS arm, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), a AS (SELECT sum(n) AS a FROM t) SELECT arm, n, round(m, 4) AS mean, round(m + 2 * sqrt(2 * ln(a) / n), 4) AS bound FROM t, a")
def curriculum_arms(spark, sf_dir):
    return rounded(H.next_arms(read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "arm"), "arm", "c_acctbal", 2.0), "mean", "bound", digits=4)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, sha256('0:' || c_custkey)) AS place FROM customer QUALIFY place <= 20")
def curriculum_order(spark, sf_dir):
    from pyspark.sql import Window

    c = H.ordered_by(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "easy_first", "c_custkey", difficulty="c_nationkey")
    first = c.orderBy("place").limit(20)  # a report of the first batch
    return first.withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long")).select("c_custkey", "place")


@query("SELECT 'qa' AS data_source, o_orderkey AS \"index\", CAST(o_orderkey * 7 AS VARCHAR) AS ground_truth, 'How many? Answer with ####.' AS content FROM orders")
def unified_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("How many?").alias("question"), F.format_string("so #### %d", F.col("o_orderkey") * 7).alias("answer"))
    return files.unified(o, "qa", "question", "answer", "Answer with ####.", row="o_orderkey").select("data_source", "index", "ground_truth", F.get("prompt", F.lit(0))["content"].alias("content"))


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "value")


_T = "e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, epoch(ts) AS x, value FROM events)"


@query(f"WITH {_T} SELECT t - t % 3600 AS start_sec, count(*) AS n, round(sum(value), 3) AS total FROM e GROUP BY 1")
def tumbling_windows(spark, sf_dir):
    out = streams.event_windows(_events(spark, sf_dir), "at", "1 hour", "10 minutes")
    return out.select(F.unix_timestamp("start").alias("start_sec"), "n", F.round("total", 3).alias("total"))


@query(f"WITH {_T} SELECT t - t % 1800 - k AS start_sec, user_id, count(*) AS n, round(sum(value), 3) AS total FROM e, (VALUES (0), (1800)) v(k) GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    out = streams.sliding_windows(_events(spark, sf_dir), "at", "1 hour", "30 minutes", "10 minutes", "user_id")
    return out.select(F.unix_timestamp("start").alias("start_sec"), "user_id", "n", F.round("total", 3).alias("total"))


@query(f"WITH {_T}, g AS (SELECT *, CASE WHEN x - lag(x) OVER w < 7200 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_sec, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    out = streams.sessions(_events(spark, sf_dir), "at", "2 hours", "10 minutes", "user_id")
    return out.select("user_id", F.unix_timestamp("start").alias("start_sec"), "n", F.round("total", 3).alias("total"))


@query(f"WITH e AS (SELECT user_id, event_id, event_type, epoch(ts) AS x FROM events) SELECT a.event_id AS click, b.event_id AS purchase FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.x >= a.x AND b.x <= a.x + 1800")
def stream_join(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    a, b = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), "at"), e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("at").alias("b_at"))
    return streams.joined_within(a, b, "user_id", "at", "b_at", "30 MINUTES", "10 minutes").select("click", "purchase")
