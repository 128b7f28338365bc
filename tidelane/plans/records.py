"""Queries over records, dialogues, documents and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import text as T
from tidelane.operators import aggregates as A
from tidelane.operators import relations as R
from tidelane.operators import retrieval as V
from tidelane.operators import sequences as S
from tidelane.plans.rollouts import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer%' AND c_nationkey <> 3")
def document_filter(spark, sf_dir):
    return R.query(read(spark, sf_dir, "customer"), c_acctbal__gte=1000, c_mktsegment__in=("BUILDING", "MACHINERY"), c_name__startswith="Customer", c_nationkey__ne=3).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def document_filter_json(spark, sf_dir):
    return R.query_json(read(spark, sf_dir, "customer"), '{"c_acctbal__lt": 0, "c_mktsegment": "BUILDING"}').select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_acctbal < 0")
def document_mutations(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    kept = R.update(R.remove(c, c_acctbal__lt=0), "c_custkey", 7, c_acctbal=0.0)
    moved = R.query(c, c_acctbal__lt=0).withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return R.add(kept, moved.union(kept), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def case_insensitive_lookup(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007"))).select("c_custkey", "c_name")


@query("SELECT a.o_custkey AS task_id, a.b AS baseline, c.b AS treatment FROM (SELECT o_custkey, round(avg(o_totalprice), 6) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, round(avg(o_totalprice), 6) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) c ON a.o_custkey = c.o_custkey")
def align_by_task(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    arm = lambda s, name: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("task_id")).agg(F.round(F.avg("o_totalprice"), 6).alias(name))
    return R.align(arm("F", "baseline"), arm("O", "treatment"), "task_id")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_alignment(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name").join(s.select("key").distinct(), "key", "left_semi")
    return R.align(s, n, "key", strict=True).select("s_suppkey", "n_name")


@query("WITH a AS (SELECT doc_id AS id, text, md5(coalesce(text, '')) AS h, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS i FROM documents) SELECT id, 'same hash' AS reason FROM a WHERE h IN (SELECT h FROM a WHERE id % 2 = 1) AND id % 2 = 0 UNION ALL SELECT id, 'same intent' FROM a WHERE i IN (SELECT i FROM a WHERE id % 2 = 1) AND id % 2 = 0")
def exact_leakage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), T.normalize_reason(F.coalesce("text", F.lit(""))).alias("i"))
    return R.leaks(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), {"h": "same hash", "i": "same intent"})


_EV = "e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, value FROM events)"


@query(f"WITH {_EV} SELECT a.event_id, min(b.t) AS next_t FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.t >= a.t WHERE a.event_type = 'click' GROUP BY a.event_id")
def as_of_forward(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    out = R.as_of_next(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), e.filter("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("next_id")), "user_id", "t", "t", "next_id")
    return out.select("event_id", "next_t")


@query(f"WITH {_EV} SELECT p.event_id, s.event_id AS span_id FROM e p JOIN e s ON p.user_id = s.user_id AND s.event_type = 'view' AND p.t >= s.t AND p.t < s.t + 3600 WHERE p.event_type = 'click'")
def interval_join(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    spans = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("start"), (F.col("t") + 3600).alias("end"))
    return R.within(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), spans, "user_id", "t", "start", "end", 3600.0).select("event_id", "span_id")


@query(f"WITH {_EV}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE event_type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE event_type = 'purchase') SELECT coalesce(c.user_id, r.user_id) AS user_id, c.event_id AS call_at, r.event_id AS receipt_at FROM c FULL JOIN r ON c.user_id = r.user_id AND c.k = r.k")
def call_receipt_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("name", F.lit("tool"))
    return R.pair_calls(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "name", "event_id").drop("name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def zip_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return R.zip_columns(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("WITH k AS (SELECT o_custkey AS user_id, 0 AS frame, min(o_orderkey) AS place FROM orders GROUP BY 1 UNION ALL SELECT user_id, 1, min(event_id) FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM k) SELECT user_id, frame, place FROM n WHERE r = 1")
def ordered_distinct_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("n"))
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"))
    return R.ordered_distinct(o, e, key="user_id", order="n")


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def key_intersection(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(read(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tick, event_type IN ('click', 'view') AS active FROM events), o AS (SELECT user_id, tick, tick - row_number() OVER (PARTITION BY user_id ORDER BY tick) AS island FROM t WHERE active) SELECT user_id, min(tick) AS start_tick, max(tick) + 1 AS end_tick, round(min(tick) * 0.2, 4) AS start_sec, round((max(tick) + 1) * 0.2, 4) AS end_sec FROM o GROUP BY user_id, island")
def speech_segments(spark, sf_dir):
    e = S.occurrence(read(spark, sf_dir, "events"), "user_id", "event_id")
    ticks = e.select("user_id", F.col("trial").cast("long").alias("tick"), F.col("event_type").isin("click", "view").alias("active"))
    return S.segments(ticks, "user_id", "tick", "active").select("user_id", "start_tick", "end_tick", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


@query("SELECT conv_id, turn, bool_or(coalesce(text LIKE '%?%' OR text LIKE '%that%', false)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS known FROM conversations")
def running_known_flag(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return S.running_flag(c, "conv_id", "turn", F.col("text").contains("?") | F.col("text").contains("that"), "known").select("conv_id", "turn", "known")


@query("SELECT user_id, event_id, CASE WHEN coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask FROM events")
def response_mask(spark, sf_dir):
    return S.until_first(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "mask")


@query("SELECT event_type, min_by(value, event_id) AS first, max_by(value, event_id) AS last, max(value) AS max, round(avg(value), 5) AS mean FROM events GROUP BY 1")
def telemetry_summary(spark, sf_dir):
    return A.first_last(read(spark, sf_dir, "events"), "event_type", "event_id", "value").withColumn("mean", F.round("mean", 5))


@query("SELECT coalesce(event_type, 'unknown') AS category, count(*) AS n FROM events GROUP BY 1")
def categorical_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS reason, regexp_replace(text, '[^A-Za-z0-9_./-]+', '_', 'g') AS metric FROM documents")
def normalized_reasons(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_reason(F.col("text")).alias("reason"), T.metric_name(F.col("text")).alias("metric"))


@query("WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations), s AS (SELECT conv_id, turn, list_distinct([x FOR x IN string_split(text, ' ') IF x <> '']) AS a, list_distinct([x FOR x IN string_split(reply, ' ') IF x <> '']) AS b FROM c WHERE reply IS NOT NULL AND text IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity FROM s")
def turn_similarity(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.filter("reply IS NOT NULL AND text IS NOT NULL").select("conv_id", "turn", F.round(T.token_jaccard(F.col("text"), F.col("reply")), 6).alias("similarity"))


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, CAST({_NORMAL.format('p_name')} = {_NORMAL.format('p_type')} AS INT) AS em, CAST(contains({_NORMAL.format('p_name')}, {_NORMAL.format('p_brand')}) AS INT) AS sub FROM part")
def answer_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", T.exact_match(F.col("p_name"), F.col("p_type")).alias("em"), T.contains_match(F.col("p_name"), F.col("p_brand")).alias("sub"))


@query("SELECT o_orderkey, ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 2147483647 AS seed FROM orders")
def stable_seeds(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.stable_seed(F.col("o_orderkey").cast("string")).alias("seed"))


def _queries(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF x <> ''] AS words FROM documents), z AS (SELECT count(*) AS n, avg(len(words)) AS m FROM w),
tf AS (SELECT doc_id, len(words) AS l, unnest(words) AS term FROM w), c AS (SELECT doc_id, l, term, count(*) AS tf FROM tf GROUP BY ALL),
d AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM c, z GROUP BY term), a AS (SELECT avg(idf) AS mi FROM d),
q AS (SELECT item_id AS query_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> '']) AS term FROM benchmark WHERE item_id % 50 = 0),
s AS (SELECT query_id, doc_id, sum(CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))) AS score FROM q JOIN d USING (term) JOIN c USING (term), z, a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""")
def bm25_top_k(spark, sf_dir):
    out = V.bm25(read(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS score FROM v, v q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""")
def cosine_top_k(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    out = V.cosine(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return out.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)the\\w+')) AS BIGINT) AS score FROM documents WHERE len(regexp_extract_all(text, '(?i)the\\w+')) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def grep_top_k(spark, sf_dir):
    return V.grep(read(spark, sf_dir, "documents"), r"the\w+", 20).withColumn("score", F.col("score").cast("long"))


@query("SELECT s_nationkey, s_suppkey, s_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3")
def leaderboard_top_models(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey"), "s_suppkey", F.col("s_acctbal").alias("score"))
    return V._top(s, "s_nationkey", "s_suppkey", 3).select("s_nationkey", "s_suppkey", F.col("score").alias("s_acctbal"), F.col("rank").cast("long").alias("rank"))
