"""Queries over dialogues, tool calls, speech and replayed state, made from events, orders and customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.operators import dialogues as G
from tidelane.operators import sequences as S
from tidelane.plans.credits import rounded
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


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, sf_dir):
    return G.lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3")
def conjunctive_lookup(spark, sf_dir):
    return G.lookup_all(read(spark, sf_dir, "customer"), c_mktsegment="Building", c_nationkey="3").select("c_custkey")


@query("SELECT DISTINCT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'P' OR o_orderstatus = 'P'")
def child_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ids = o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(ids, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return G.lookup_through(c, o, "P", "c_mktsegment", "ids", "o_orderkey", "o_orderstatus").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 AND o_orderstatus = 'F' AND o_custkey % 24 >= 8")
def flight_search(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.struct(F.when(k % 3 == 1, "available").otherwise("delayed").alias("status"))
    f = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("origin"), F.lit("X").alias("destination"), F.format_string("%02d:00:00", F.col("o_custkey") % 24).alias("departs"), F.create_map(F.lit("2024-05-15"), status).alias("dates"))
    return G.flights(f, "2024-05-15", "F", "X", "08:00:00").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
def newest_bills(spark, sf_dir):
    return G.newest(read(spark, sf_dir, "orders").filter("o_custkey = 7"), "o_orderdate", "o_orderkey", 3).select("o_orderkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def multi_key_sort(spark, sf_dir):
    return G.sorted_by(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ("s_nationkey", True), ("s_acctbal", False))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def leaderboard_filters(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "organization").withColumn("trajectories", F.col("c_custkey") % 2 == 0)
    return G.submissions(c, "Building", True).select("c_custkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def mapped_column(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    return G.mapped(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", "c_name", "c_name").select("o_orderkey", "c_name")


_W = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) {_W} + 2 * max(CASE WHEN value > 50 THEN 1 ELSE 0 END) {_W} AS INT) AS known, last(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) {_W} AS last_observation, CAST(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) {_W} AS BIGINT) AS errors FROM events")
def message_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a = G.known_mask(e, "user_id", "event_id", {"clicked": F.col("event_type") == "click", "large": F.col("value") > 50})
    return G.observations(a, "user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")), F.col("value") > 90).select("event_id", "known", "last_observation", "errors")


@query(f"""WITH t AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) {_W} AS q, max(CASE WHEN event_type = 'click' THEN event_id END) {_W} AS y, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM events)
SELECT event_id, coalesce(y > q AND (d IS NULL OR d < y), false) AS confirmed, event_type = 'purchase' AND NOT coalesce(y > q AND (d IS NULL OR d < y), false) AS unconfirmed FROM t""")
def confirmation_flags(spark, sf_dir):
    is_ = lambda x: F.col("event_type") == x
    return G.confirmations(read(spark, sf_dir, "events"), "user_id", "event_id", is_("view"), is_("click"), is_("purchase")).select("event_id", "confirmed", "unconfirmed")


@query("""WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS d, min(event_id) FILTER (event_type = 'purchase') AS w FROM events GROUP BY 1), r AS (SELECT user_id, any_value(w) AS w, min(event_id) FILTER (event_type = 'click' AND event_id > d) AS r FROM events JOIN f USING (user_id) GROUP BY 1)
SELECT user_id, w IS NOT NULL AND (r IS NULL OR w < r) AS early FROM r""")
def early_writes(spark, sf_dir):
    is_ = lambda x: F.col("event_type") == x
    return G.early_writes(read(spark, sf_dir, "events"), "user_id", "event_id", is_("purchase"), is_("view"), is_("click"))


@query("""WITH s AS (SELECT user_id, event_type, floor(value / 10) AS s, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT user_id, max(n) > 1 AS repeated FROM s GROUP BY 1), l AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS w, max(event_id) FILTER (event_type = 'view') AS r FROM events GROUP BY 1)
SELECT user_id, repeated, coalesce(w > coalesce(r, -1), false) AS unread FROM k JOIN l USING (user_id)""")
def unread_writes(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("signature", F.struct("event_type", F.floor(F.col("value") / 10)))
    return G.unread_writes(e, "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "view")


_TICKS = "k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tick, event_id % 2 = 0 AS u, event_id % 3 = 0 AS a, event_type FROM events)"


def ticks(spark, sf_dir):
    e = S.occurrence(read(spark, sf_dir, "events"), "user_id", "event_id")
    return e.select("user_id", F.col("trial").cast("long").alias("tick"), (F.col("event_id") % 2 == 0).alias("user"), (F.col("event_id") % 3 == 0).alias("agent"), "event_type")


@query(f"""WITH {_TICKS}, e AS (SELECT user_id, tick, unnest([event_type, 'x' || tick % 2]) AS attribute FROM k), i AS (SELECT *, tick - row_number() OVER (PARTITION BY user_id, attribute ORDER BY tick) AS i FROM e)
SELECT user_id, attribute, min(tick) AS start_tick, max(tick) + 1 AS end_tick, round(min(tick) * 0.2, 4) AS start_sec, round((max(tick) + 1) * 0.2, 4) AS end_sec FROM i GROUP BY user_id, attribute, i""")
def effect_segments(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("effects", F.array("event_type", F.concat(F.lit("x"), (F.col("tick") % 2).cast("string"))))
    return rounded(G.attribute_segments(t, "user_id", "tick", "effects"), "start_sec", "end_sec", digits=4)


_SEG = f"{_TICKS}, o AS (SELECT user_id, tick, tick - row_number() OVER (PARTITION BY user_id ORDER BY tick) AS i FROM k WHERE u), s AS (SELECT user_id, min(tick) AS start_tick, max(tick) + 1 AS end_tick FROM o GROUP BY user_id, i)"


def segments(spark, sf_dir, who="user"):
    return S.segments(ticks(spark, sf_dir), "user_id", "tick", who).select("user_id", "start_tick", "end_tick")


@query(f"""WITH {_SEG} SELECT s.user_id, start_tick, end_tick, coalesce(bool_or(k.a) FILTER (k.tick = start_tick), false) AS other_at_start, coalesce(bool_or(k.a) FILTER (k.tick = end_tick), false) AS other_at_end, coalesce(bool_or(k.event_type = 'click') FILTER (k.tick < end_tick), false) AS clicked
FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.tick BETWEEN start_tick AND end_tick GROUP BY ALL""")
def segment_attributes(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("clicked", F.col("event_type") == "click")
    return G.segment_attributes(segments(spark, sf_dir), t, "user_id", "agent", ["clicked"])


@query(f"WITH {_SEG}, l AS (SELECT user_id, max(tick) AS last FROM k GROUP BY 1) SELECT s.* FROM s JOIN l USING (user_id) WHERE end_tick - start_tick > 1 OR end_tick <= last")
def hangup_filter(spark, sf_dir):
    last = ticks(spark, sf_dir).groupBy("user_id").agg(F.max("tick").alias("last"))
    return G.without_tail(segments(spark, sf_dir), "user_id", last)


@query(f"""WITH {_SEG}, n AS (SELECT s.user_id, start_tick, coalesce(bool_or(k.a) FILTER (k.tick = start_tick), false) AS interrupts, min(k.tick) FILTER (NOT k.a) AS q FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.tick BETWEEN start_tick AND start_tick + 4 GROUP BY ALL)
SELECT user_id, start_tick, interrupts, CASE WHEN interrupts THEN q END AS yield_tick FROM n""")
def interruption_events(spark, sf_dir):
    return G.interruptions(segments(spark, sf_dir), ticks(spark, sf_dir), "user_id", 5)


_RESP = f"{_SEG}, p AS (SELECT user_id, tick, tick - row_number() OVER (PARTITION BY user_id ORDER BY tick) AS i FROM k WHERE a), g AS (SELECT user_id, min(tick) AS a FROM p GROUP BY user_id, i), m AS (SELECT s.user_id, start_tick, end_tick, min(a) AS r FROM s LEFT JOIN g ON g.user_id = s.user_id AND a BETWEEN start_tick AND end_tick + 6 GROUP BY ALL)"


@query(f"WITH {_RESP} SELECT user_id, start_tick, end_tick, r AS response_tick, r - end_tick AS latency FROM m")
def response_events(spark, sf_dir):
    return G.responses(segments(spark, sf_dir), segments(spark, sf_dir, "agent"), "user_id", 6)


@query(f"""WITH {_RESP}, n AS (SELECT s.user_id, start_tick, coalesce(bool_or(k.a) FILTER (k.tick = start_tick), false) AS interrupts, min(k.tick) FILTER (NOT k.a) AS q FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.tick BETWEEN start_tick AND start_tick + 4 GROUP BY ALL), e AS (SELECT *, CASE WHEN interrupts THEN q END AS y FROM m JOIN n USING (user_id, start_tick))
SELECT user_id % 4 AS panel, count(*) AS turns, count(r) AS answered, round(count(r) / count(*), 6) AS response_rate, count(*) FILTER (interrupts) AS interruptions, round(count(y) / nullif(count(*) FILTER (interrupts), 0), 6) AS yield_rate, round(avg(r - end_tick), 6) AS latency_mean, round(stddev_samp(r - end_tick), 6) AS latency_std FROM e GROUP BY 1""")
def voice_metrics(spark, sf_dir):
    u, t = segments(spark, sf_dir), ticks(spark, sf_dir)
    events = G.responses(u, segments(spark, sf_dir, "agent"), "user_id", 6).join(G.interruptions(u, t, "user_id", 5), ["user_id", "start_tick"])
    return rounded(G.voice_metrics(events.withColumn("panel", F.col("user_id") % 4), "panel"), "response_rate", "yield_rate", "latency_mean", "latency_std")


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL) SELECT conv_id, count(*) + 1 AS n, 'm' || lpad(CAST(max(i) AS VARCHAR), 3, '0') AS last_id, coalesce(min_by(text, i) FILTER (role = 'user'), 'none') AS opening FROM m GROUP BY 1""")
def message_projection(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    answered = G.with_answer("messages", F.lit(None).cast("string"), F.lit("thought"))
    last = F.element_at(G.visible("messages"), -1)["event_id"]
    return m.select("conv_id", F.size(answered).cast("long").alias("n"), last.alias("last_id"), F.coalesce(G.opening(F.lit("none"), "messages"), F.lit("none")).alias("opening"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END * (o_custkey % 3) AS free, CASE WHEN o_orderstatus IN ('F', 'O') THEN greatest(0, o_orderkey % 7 - CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END * (o_custkey % 3)) END AS expected FROM orders")
def bag_allowances(spark, sf_dir):
    table = spark.createDataFrame([("F", "economy", 2), ("O", "economy", 1)], "member string, cabin string, free int")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("economy").alias("cab"), (F.col("o_custkey") % 3).alias("people"), (F.col("o_orderkey") % 7).alias("bags"))
    return G.paid_beyond_allowance(o, table, "o_orderstatus", "cab", "people", "bags").select("o_orderkey", F.col("free").cast("long").alias("free"), F.col("expected").cast("long").alias("expected"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_id % 4 AS v, last(CASE WHEN event_type = 'view' THEN event_id % 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM events)
SELECT event_id, known, CASE WHEN known IS NULL THEN 'unknown' WHEN known = v THEN 'satisfied' ELSE 'violated' END AS status FROM e WHERE event_type = 'purchase'""")
def causal_checks(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lit("x").alias("entity"), (F.col("event_id") % 4).alias("v"))
    return G.causal_checks(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "user_id", "event_id", "entity", "v", "v").select("event_id", "known", "status")


@query("""WITH c AS (SELECT user_id, event_id, event_id % 3 AS id, row_number() OVER w AS k, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) > 1 AS again FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, event_id, event_id % 3 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), j AS (SELECT coalesce(c.user_id, r.user_id) AS user_id, c.event_id AS ca, r.event_id AS ra, c.id AS ci, r.id AS ri FROM c FULL JOIN r ON c.user_id = r.user_id AND c.k = r.k)
SELECT user_id, coalesce(ca, ra) AS at_, CASE WHEN ca IS NULL THEN 'orphan' WHEN ra IS NULL THEN 'unfinished' WHEN ra < ca THEN 'out_of_order' ELSE 'id_mismatch' END AS kind FROM j WHERE ca IS NULL OR ra IS NULL OR ra < ca OR ci <> ri UNION ALL SELECT user_id, event_id, 'duplicate' FROM c WHERE again""")
def receipt_violations(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("id", F.col("event_id") % 3)
    out = G.receipt_violations(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", "event_id")
    return out.select("user_id", F.col("at").alias("at_"), "kind")


@query("""SELECT o_orderkey, 'unknown_tool' AS kind, 'gone' AS name FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'missing', 'id' FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT o_orderkey, 'unexpected', 'more' FROM orders WHERE o_orderkey % 5 IN (1, 2) UNION ALL SELECT o_orderkey, 'wrong_type', 'id' FROM orders WHERE o_orderkey % 5 = 3""")
def schema_audit(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    arguments = F.when(k == 1, F.create_map(F.lit("more"), F.lit("1"))).when(k == 2, F.create_map(F.lit("id"), F.lit("7"), F.lit("more"), F.lit("true"))).when(k == 3, F.create_map(F.lit("id"), F.lit('"7"'))).otherwise(F.create_map(F.lit("id"), F.lit("7"), F.lit("note"), F.lit('"x"')))
    calls = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "gone").otherwise("book").alias("tool"), arguments.alias("arguments"))
    schemas = spark.createDataFrame([("book", "id", "integer", True), ("book", "note", "string", False)], "tool string, argument string, type string, required boolean")
    return G.schema_findings(calls, schemas, "o_orderkey")


@query("""WITH a AS (SELECT o_custkey AS run, o_orderkey % 5 AS key, arg_max(o_orderkey % 3, o_orderkey) AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS run, o_orderkey % 5 AS key, arg_max(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE 1 END, o_orderkey) AS v FROM orders GROUP BY ALL),
j AS (SELECT run, key, a.v AS x, b.v AS y FROM a JOIN b USING (run, key)) SELECT run, CASE WHEN bool_and(x = y) THEN 1.0 ELSE 0.0 END AS reward FROM j GROUP BY run""")
def replayed_outcomes(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 5).alias("key"), F.col("o_orderkey").alias("step"), (F.col("o_orderkey") % 3).alias("value"))
    gold = a.withColumn("value", F.when(F.col("run") % 2 == 0, F.col("value")).otherwise(F.lit(1)))
    state = spark.range(5).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("value"))
    return G.same_outcome(state, a, gold, "run", "key", "step", "value")
