"""Queries over audited dialogues: an order's line items are its messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import dialogue_audit as A
from tidelane.plans.rollouts import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    line = read(spark, sf_dir, "lineitem").withColumn("event", step)  # before the rest, so that all that is asked of messages shares the shuffle
    of, supp, part = F.col("l_linenumber") % 4, F.col("l_suppkey"), F.col("l_partkey")
    mine = F.when(supp % 5 == 0, F.lit("[1]")).otherwise(F.format_string('{"user_id": "u%d", "bags": %d, "reservation_id": null}', part % 3, supp % 4))
    first = F.struct(F.format_string("c%d", supp % 4).alias("id"), F.lit("change").alias("name"), mine.alias("arguments"))
    second = F.struct(F.lit(None).cast("string").alias("id"), F.lit("look").alias("name"), F.lit("{}").alias("arguments"))
    content = F.when(of == 0, F.format_string("I am u%d", part % 3)).when(of > 1, F.format_string('{"seen": "u%d", "error": %s, "user_id": "u%d", "bags": %d}', part % 3, F.when(supp % 6 == 0, "true").otherwise("false"), supp % 3, part % 5))
    return line.select(
        F.col("l_orderkey").alias("id"), "event", F.when(of == 0, "user").when(of == 1, "assistant").otherwise("tool").alias("role"), content.alias("content"),
        F.when(of > 1, F.when(part % 4 == 0, "look").otherwise("change")).alias("name"), F.when(of > 1, F.format_string("c%d", supp % 4)).alias("tool_call_id"),
        F.when(of == 1, F.when(part % 2 == 0, F.array(first, second)).otherwise(F.array(first))).alias("tool_calls"),
    )


_AUDIT = """WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS event, l_linenumber % 4 AS of_, l_suppkey AS supp, l_partkey AS part FROM lineitem),
c AS (SELECT id, event, 0 AS position, 'change' AS name, 'c' || supp % 4 AS cid, supp % 5 <> 0 AS valid, 'u' || part % 3 AS who, supp % 4 AS bags FROM s WHERE of_ = 1 UNION ALL SELECT id, event, 1, 'look', NULL, true, NULL, NULL FROM s WHERE of_ = 1 AND part % 2 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY id, event ORDER BY position) AS nth FROM c WHERE valid),
t0 AS (SELECT *, max(CASE WHEN of_ < 2 THEN event END) OVER (PARTITION BY id ORDER BY event) AS block, CASE WHEN part % 4 = 0 THEN 'look' ELSE 'change' END AS said FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY id, block ORDER BY event) AS nth FROM t0 WHERE of_ > 1),
a AS (SELECT t.*, v.name, v.position, CASE WHEN v.id IS NULL THEN 'orphan' WHEN t.said <> v.name OR v.cid <> 'c' || t.supp % 4 THEN 'mismatch' ELSE 'paired' END AS status FROM t LEFT JOIN v ON t.id = v.id AND t.block = v.event AND t.nth = v.nth),
n AS (SELECT v.id, v.event, v.name, v.nth, coalesce(g.got, 0) AS got FROM v LEFT JOIN (SELECT id, block, count(*) AS got FROM t GROUP BY ALL) g ON g.id = v.id AND g.block = v.event),
m AS (SELECT id, event, string_agg(name, ',' ORDER BY nth) AS names FROM n WHERE nth > got GROUP BY ALL),
nx AS (SELECT id, event, lead(event) OVER (PARTITION BY id ORDER BY event) AS next, max(event) OVER (PARTITION BY id) AS own FROM s WHERE of_ < 2), z AS (SELECT id, max(event) AS last FROM s GROUP BY id),
x AS (SELECT id, event, 'u' || part % 3 AS who FROM s WHERE of_ = 0 UNION ALL SELECT id, event, 'u' || part % 3 FROM a WHERE status = 'paired' UNION ALL SELECT id, event, 'u' || supp % 3 FROM a WHERE status = 'paired'),
k AS (SELECT v.*, (SELECT arg_max(a.part % 5, a.event) FROM a WHERE a.status = 'paired' AND a.supp % 6 <> 0 AND a.id = v.id AND a.event < v.event AND 'u' || a.supp % 3 = v.who) AS had FROM v WHERE name = 'change')"""


@query(
    f"""{_AUDIT}
SELECT id, event, 'invalid_arguments' AS kind, 'contradiction' AS status, position::VARCHAR AS about FROM c WHERE NOT valid
UNION ALL SELECT id, event, 'duplicate_tool_call_id', 'contradiction', cid FROM (SELECT *, row_number() OVER (PARTITION BY id, cid ORDER BY event, position) AS k FROM v WHERE cid IS NOT NULL) WHERE k > 1
UNION ALL SELECT id, event, 'orphan_tool_receipt', 'contradiction', NULL FROM a WHERE status = 'orphan'
UNION ALL SELECT id, event, 'tool_receipt_mismatch', 'contradiction', name FROM a WHERE status = 'mismatch'
UNION ALL SELECT id, event, 'tool_error_response', 'review', name FROM a WHERE status = 'paired' AND supp % 6 = 0
UNION ALL SELECT m.id, next, 'missing_tool_receipt', 'contradiction', names FROM m JOIN nx USING (id, event) WHERE next IS NOT NULL
UNION ALL SELECT m.id, last, 'unfinished_tool_calls', 'contradiction', names FROM m JOIN nx USING (id, event) JOIN z USING (id) WHERE next IS NULL
UNION ALL SELECT v.id, v.event, 'write_identifier_absent_from_prior_user_or_tool', 'unknown', v.who FROM v WHERE name = 'change' AND NOT EXISTS (SELECT 1 FROM x WHERE x.id = v.id AND x.who = v.who AND x.event < v.event)
UNION ALL SELECT id, event, 'fewer_bags', 'contradiction', had || '>' || bags FROM k WHERE bags < had"""
)
def dialogue_findings(spark, sf_dir):
    """All findings, with a rule of two lines: bags may not become fewer than the user's last receipt says."""
    bags = lambda document: A.field(document, "bags").cast("long")
    fewer = lambda said, known: A.finding_if(bags(said) < bags(known["user"]), F.lit("contradiction"), A.detail_of(about=F.concat_ws(">", bags(known["user"]), bags(said))))
    rule = A.Rule("fewer_bags", ("change",), {"user": lambda said, _: A.field(said, "user_id")}, fewer)
    found = A.audit_dialogues(_messages(spark, sf_dir), ["change"], ["user_id", "reservation_id"], {"user": A.Entity("user_id")}, [rule])
    of = lambda *names: F.coalesce(*(F.col("detail")[n] for n in names))
    named = F.when(F.col("kind") == "tool_error_response", of("tool")).otherwise(of("about", "call_id", "expected", "pending", "value", "batch_position"))
    return found.select("id", "event", "kind", "status", named.alias("about"))


@query(
    f"""{_AUDIT}, r AS (SELECT id, count(*) FILTER (of_ = 1) AS assistant_messages, count(*) FILTER (of_ = 1 AND part % 2 = 0) AS multicall_batches FROM s GROUP BY id), y AS (SELECT id, count(*) AS tool_calls, arg_min(name, (event, position)) AS first_tool FROM v GROUP BY id)
SELECT r.*, coalesce(tool_calls, 0) AS tool_calls, first_tool FROM r LEFT JOIN y USING (id)"""
)
def dialogue_summaries(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    return A.dialogue_summary(messages, A.tool_calls(messages)).drop("supervised_calls")
