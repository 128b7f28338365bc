"""Queries over JSON documents, answers and the choice of records, made from orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.functions import documents as D
from tidelane.functions import text as T
from tidelane.operators import curation as C
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


def _json(spark, sf_dir):
    """Two nested documents of each order, alike but for some keys, values and orders of lists."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    text = F.format_string(
        '{"z": %d, "a": {"status": "%s", "api_key": "x%d", "deep": {"price": %d, "clerk_api_key": "%s", "items": [{"token": "t%d", "n": %d}, %d]}}, "list": [%d, 2], "ok": true, "date": "%s"}',
        "o_custkey", "o_orderstatus", "k", "cents", F.concat(F.lit("clerk "), F.col("o_custkey")), "k", F.col("k") % 7, F.col("k") % 5, F.col("k") % 3, F.to_date("o_orderdate").cast("string"),
    )
    other = F.format_string(
        '{"a": {"api_key": "x%d", "deep": {"items": [%d, {"n": %d, "token": "t%d"}], "price": %d}, "status": "F"}, "date": "%s", "ok": true, "list": [2, %d]}',
        "k", F.col("k") % 5, F.col("k") % 7, "k", F.col("cents") + F.when(F.col("k") % 4 == 0, 1).otherwise(0), "o_orderpriority", F.col("k") % 3,
    )
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", text.alias("doc"), other.alias("other"))


_ITEM = """'{"n":' || o_orderkey % 7 || ',"token":"' || {token} || '"}'"""
_CANON = """'{"a":{"api_key":"' || {key} || '","deep":{"clerk_api_key":"' || {clerk} || '","items":[' || {item} || ',' || o_orderkey % 5 || '],"price":' || cents || '},"status":"' || o_orderstatus || '"},"date":"' || CAST(o_orderdate AS VARCHAR)[1:10] || '","list":[' || o_orderkey % 3 || ',2],"ok":true,"z":' || o_custkey || '}'""".replace("{item}", _ITEM)
_OPEN = _CANON.replace("{key}", "'x' || o_orderkey").replace("{clerk}", "'clerk ' || o_custkey").replace("{token}", "'t' || o_orderkey")
_HIDDEN = _CANON.replace("{key}", "'[REDACTED]'").replace("{clerk}", "'[REDACTED]'").replace("{token}", "'[REDACTED]'")
_CENTS = "(SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


@query(f"SELECT o_orderkey, {_OPEN} AS canonical, sha256({_OPEN}) AS hash FROM {_CENTS}")
def canonical_documents(spark, sf_dir):
    return _json(spark, sf_dir).select("o_orderkey", D.canonical_text(F.col("doc")).alias("canonical"), D.json_hash(F.col("doc")).alias("hash"))


@query(f"SELECT o_orderkey, {_HIDDEN} AS redacted FROM {_CENTS}")
def redacted_documents(spark, sf_dir):
    return _json(spark, sf_dir).select("o_orderkey", D.redacted(F.col("doc")).alias("redacted"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS z, 'true' AS ok, o_orderkey AS chosen FROM orders")
def decoded_documents(spark, sf_dir):
    m = _json(spark, sf_dir).withColumn("m", D.decoded(F.col("doc"), "doc"))
    return m.select("o_orderkey", F.col("m")["z"].alias("z"), F.col("m")["ok"].alias("ok"), D.first_known(F.col("m")["none"].cast("long"), F.col("o_orderkey")).alias("chosen"))


_TOKENED = _ITEM.replace("{token}", "'t' || o_orderkey")


@query(f"""SELECT o_orderkey, '/z' AS path, CAST(o_custkey AS VARCHAR) AS expected, NULL AS actual, 'missing_key' AS kind FROM orders
UNION ALL SELECT o_orderkey, '/a/deep/clerk_api_key', '"clerk ' || o_custkey || '"', NULL, 'missing_key' FROM orders
UNION ALL SELECT o_orderkey, '/list', '[' || o_orderkey % 3 || ',2]', '[2,' || o_orderkey % 3 || ']', 'list_order_only' FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT o_orderkey, '/a/deep/items', '[' || {_TOKENED} || ',' || o_orderkey % 5 || ']', '[' || o_orderkey % 5 || ',' || {_TOKENED} || ']', 'list_order_only' FROM orders
UNION ALL SELECT o_orderkey, '/a/deep/price', CAST(cents AS VARCHAR), CAST(cents + 1 AS VARCHAR), 'value' FROM {_CENTS} WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, '/date', '"' || CAST(o_orderdate AS VARCHAR)[1:10] || '"', '"' || o_orderpriority || '"', 'value' FROM orders
UNION ALL SELECT o_orderkey, '/a/status', '"' || o_orderstatus || '"', '"F"', 'value' FROM orders WHERE o_orderstatus <> 'F'""")
def document_differences(spark, sf_dir):
    d = _json(spark, sf_dir).select("o_orderkey", F.explode(D.differences(F.col("doc"), F.col("other"))).alias("d"))
    return d.select("o_orderkey", "d.*")


@query(f"SELECT o_orderkey, 'z' AS name, CAST(o_custkey AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'ok', 1 FROM orders UNION ALL SELECT o_orderkey, 'a/deep/price', cents FROM {_CENTS}")
def scalar_paths(spark, sf_dir):
    return _json(spark, sf_dir).select("o_orderkey", F.explode(D.scalar_metrics(F.col("doc"))).alias("name", "value"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, o_custkey % 5 AS part, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY ALL")
def identity_classes(spark, sf_dir):
    """Orders whose documents are one value, in two ways of writing it: classes by identity are classes by columns."""
    o = read(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 5)
    plain = F.format_string('{"s": "%s", "of": {"p": "%s", "n": %d}, "all": [{"x": 1.50}, {"y": %d}]}', "o_orderstatus", "o_orderpriority", "part", "part")
    other = F.format_string('{"all": [{"y": "%d.0"}, {}, {"x": 15e-1}], "none": null, "of": {"n": " %d ", "p": "%s", "e": []}, "s": "%s"}', "part", "part", "o_orderpriority", "o_orderstatus")
    told = o.withColumn("same", D.identity(F.when(F.col("o_orderkey") % 2 == 0, plain).otherwise(other)))
    of = told.groupBy(F.sha2("same", 256).alias("class")).agg(F.first("o_orderstatus").alias("status"), F.first("o_orderpriority").alias("priority"), F.first("part").alias("part"), F.count("*").alias("n"), F.min("o_orderkey").alias("least"))
    return of.drop("class")


@query("SELECT o_orderkey, true AS reordered, o_orderkey % 2 = 1 AS typed, o_orderkey % 2 = 0 AS same FROM orders")
def document_identity(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    a = F.format_string('{"n": %d, "x": [], "y": {"b": 1.50, "c": "t"}}', "o_orderkey")
    b = F.format_string('{"y": {"c": "t", "b": 1.5, "e": null}, "n": "%d.0"}', "o_orderkey")
    c = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"n": true}')).otherwise(F.lit('{"n": 1}'))
    return o.select("o_orderkey", (D.identity(a) == D.identity(b)).alias("reordered"), D.typed_equal(c, F.lit('{ "n":1 }')).alias("typed"), (D.identity(c) != D.identity(F.lit('{"n": "1"}'))).alias("same"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS exact, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS partial FROM orders")
def argument_match(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    text = lambda c: c.cast("string")
    a = F.create_map(F.lit("id"), text(F.col("o_orderkey")), F.lit("kind"), F.lit('"x"'))
    b = F.create_map(F.lit("kind"), F.when(F.col("o_orderkey") % 2 == 0, '"x"').otherwise('"y"'), F.lit("id"), text(F.col("o_orderkey")))
    return o.select("o_orderkey", D.matched_arguments(a, b).alias("m")).select("o_orderkey", "m.exact", "m.partial")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE printf('%.1f', (o_orderkey + 2) * 3 / 2.0) END AS value FROM orders")
def arithmetic(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    e = F.when(F.col("o_orderkey") % 5 == 0, F.lit("__import__('os')")).otherwise(F.format_string("(%d + 2) * 3 / 2", "o_orderkey"))
    return o.select("o_orderkey", D.calculated(e).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) || '7' END AS strict, '5.' AS flexible, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS score FROM orders")
def numeric_answers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("so #### %d,7 and 5.", "o_orderkey")).otherwise(F.format_string("so %d and 5.", "o_orderkey"))
    score = D.scored(F.col("o_orderstatus"), {"F": F.lit(1.0), "O": F.lit(0.5)}, F.lit(0.0))
    return o.select("o_orderkey", D.numeric_answer(said).alias("strict"), D.numeric_answer(said, "flexible").alias("flexible"), score.alias("score"))


@query("SELECT conv_id, bool_or(role = 'assistant' AND contains(lower(replace(text, ',', '')), 'the')) AS the, bool_or(role = 'assistant' AND contains(lower(replace(text, ',', '')), 'zzz')) AS zzz FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id".replace("AS the,", "AS \"the\","))
def communication_checks(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages")).withColumn("needles", F.array(F.lit("THE"), F.lit("zzz")))
    got = m.select("conv_id", D.communicated("messages", "needles").alias("x"))
    return got.select("conv_id", F.get("x", F.lit(0)).alias("the"), F.get("x", F.lit(1)).alias("zzz"))


@query("SELECT o_orderkey, o_orderkey % 12 + 1 < 13 AND o_orderkey % 40 + 1 <= 28 AS valid, CAST(2024 - 1990 - CASE WHEN o_orderkey % 12 + 1 > 6 OR o_orderkey % 12 + 1 = 6 AND 15 < 20 THEN 1 ELSE 0 END AS INT) AS age FROM orders")
def date_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.when(k % 40 + 1 <= 28, k % 40 + 1).otherwise(k % 40 + 40)
    text = F.format_string("2024-%02d-%02d", k % 12 + 1, day)
    birth = F.to_date(F.format_string("1990-%02d-20", k % 12 + 1))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.valid_date(text).alias("valid"), D.age(birth, F.to_date(F.lit("2024-06-15"))).alias("age"))


@query("SELECT o_orderkey, '<ENTITY> order ' || CASE WHEN o_orderkey > 9 THEN '<ENTITY>' ELSE 'id_' || o_orderkey END || ' of ab1' AS masked FROM orders")
def masked_entities(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.mask_entities(F.format_string("2024-05-01 Order ID_%d of AB1", "o_orderkey")).alias("masked"))


@query()
def closest_reasons(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'user' AND text IS NOT NULL")
    return rounded(C.closest(c.filter("conv_id % 2 = 1").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "text", c.filter("conv_id % 50 = 0").select("text"), "id", 0.8), "similarity")


@query()
def closest_lines(spark, sf_dir):
    """The line of a 50th of the documents that is most like each line of the others; near copies make many."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    mine = lines.filter("doc_id % 50 != 0").select(F.concat_ws("-", "doc_id", "line_no").alias("id"), "text")
    return rounded(C.closest(mine, "text", lines.filter("doc_id % 50 = 0"), "id", 0.95, order="doc_id"), "similarity")


@query()
def near_duplicate_turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", T.normalize_reason(F.col("text")).alias("a"))
    pairs = c.join(c.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"]).withColumn("r", D.sequence_ratio(F.col("a"), F.col("b")))
    return pairs.select("conv_id", "turn", D.near_duplicate(F.col("a"), F.col("b"), 0.6, F.col("r")).alias("near"), F.round("r", 5).alias("ratio"))


_TAGGED = "t AS (SELECT o_orderkey AS k, 'r' || o_custkey % 50 AS reason, ['a' || o_orderkey % 4, 'b' || o_orderkey % 3] AS tags, ['x' || o_orderkey % 2] AS actions FROM orders)"


def _tagged(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda p, c, n: F.concat(F.lit(p), (c % n).cast("string"))
    return read(spark, sf_dir, "orders").select(k.alias("k"), name("r", F.col("o_custkey"), 50).alias("reason"), F.array(name("a", k, 4), name("b", k, 3)).alias("tags"), F.array(name("x", k, 2)).alias("actions"))


@query(f"""WITH {_TAGGED}, p AS (SELECT a.k, b.k AS other, a.reason = b.reason AS exact, len(list_intersect(a.tags, b.tags)) / len(list_distinct(a.tags || b.tags)) AS jaccard, a.actions = b.actions AS same FROM t a, t b WHERE a.k % 5 = 1 AND b.k % 5 = 2 AND (len(list_intersect(a.tags, b.tags)) > 0 OR a.reason = b.reason)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY exact DESC, jaccard DESC, same DESC, other) AS n FROM p) SELECT k, other, exact, round(jaccard, 6) AS jaccard, same FROM r WHERE n = 1""")
def best_record_matches(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    return rounded(C.best_matches(t.filter("k % 5 = 1"), t.filter("k % 5 = 2").withColumnRenamed("k", "other"), "k", "other"), "jaccard")


@query("SELECT c_mktsegment AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('3:' || c_custkey)) AS r FROM customer) WHERE r <= 4 GROUP BY 1")
def diverse_selection(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = C.diverse_selection(c, "c_custkey", "c_mktsegment", 3, 1000, 0.9, cap=4)
    return out.join(c, "c_custkey").groupBy(F.col("c_mktsegment").alias("reason")).agg(F.count("*").alias("n"))


@query()
def balanced_selection(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 3).alias("stratum"), F.array((F.col("c_nationkey")).cast("string")).alias("entities"), F.col("c_acctbal").alias("merit"))
    return C.balanced_selection(c, "c_custkey", 40, 42)


@query()
def covering_selection(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string"))).alias("tools"), F.col("c_mktsegment").alias("category"))
    return C.covering_selection(c, "c_custkey", 60, 42, least=2)


@query(f"WITH {_TAGGED}, s AS (SELECT k, list_sort(tags || actions) AS s FROM t) SELECT min(k) AS k FROM s WHERE k % 7 = 1 AND s NOT IN (SELECT s FROM s WHERE k % 7 = 2 AND k % 60 < 9) GROUP BY s")
def curriculum_extension(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("k", F.concat("tags", "actions").alias("signature"))
    return C.extension(t.filter("k % 7 = 1"), t.filter("k % 7 = 2 AND k % 60 < 9"), "k", "signature").select("k")


@query("""WITH RECURSIVE g AS (SELECT o_custkey AS g, o_custkey % 3 AS b, count(*) AS n, sha256('42:' || o_custkey) AS h FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h) AS k FROM g), t AS (SELECT b, CAST(floor(sum(n) * 0.25 + 0.5) AS BIGINT) AS t FROM g GROUP BY b),
f AS (SELECT r.b, r.g, k, r.n, t, CAST(CASE WHEN abs(r.n - t) < t THEN r.n ELSE 0 END AS BIGINT) AS now, abs(r.n - t) < t AS v FROM r JOIN t USING (b) WHERE k = 1 UNION ALL SELECT r.b, r.g, r.k, r.n, t, CAST(now + CASE WHEN abs(now + r.n - t) < abs(now - t) THEN r.n ELSE 0 END AS BIGINT), abs(now + r.n - t) < abs(now - t) FROM f JOIN r ON r.b = f.b AND r.k = f.k + 1)
SELECT o_orderkey, o_custkey AS g, CASE WHEN v THEN 'validation' ELSE 'train' END AS split FROM f JOIN orders ON o_custkey = f.g""")
def group_preserving_split(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("g"), (F.col("o_custkey") % 3).cast("int").alias("b"), F.lit(None).cast("string").alias("lock"))
    return C.group_split(o, "o_orderkey", "g", "b", 42, 0.25).select("o_orderkey", "split").join(o.select("o_orderkey", "g"), "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer")
def unique_records(spark, sf_dir):
    return C.unique_keys(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT o_custkey AS key, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_overlap(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return C.overlap(o, "key", "o_orderstatus").select("key", F.array_join("splits", ",").alias("splits"))


@query("SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment FROM customer")
def evidence_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    return C.evidence(c.select("k", "c_name"), c.select("k", "c_acctbal"), c.select("k", "c_mktsegment"), "k")


@query("""WITH r AS (SELECT s_suppkey AS k, s_nationkey AS a, s_suppkey % 2 AS b FROM supplier) SELECT a."k" AS "left", b."k" AS "right" FROM r a JOIN r b ON a.a = b.a AND a.b = b.b AND a.k < b.k""")
def comparable_pairs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 2).alias("b"))
    return C.comparable_pairs(s, "k", "a", "b", size=3)


@query("SELECT sha256(coalesce(text, '')) AS identity, min(doc_id) AS kept, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS aliases, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ',') AS sources FROM documents GROUP BY 1")
def dedup_ledger(spark, sf_dir):
    out = C.dedup_ledger(read(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), "source")
    return out.select("identity", "kept", "n", F.array_join(F.array_sort("aliases").cast("array<string>"), ",").alias("aliases"), F.array_join("source", ",").alias("sources"))


_FLAGS = {"low": "c_acctbal < 0", "odd": "c_custkey % 2 = 1", "named": "c_name LIKE '%7'"}


@query("SELECT c_custkey, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS.items()) + "] IF x IS NOT NULL], ',') AS flags FROM customer")
def reviewed_records(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", F.md5(F.col("c_name").cast("binary")).alias("identity"))
    out = C.reviewed(c, c.select("c_custkey", "identity"), "c_custkey", "identity", {n: F.expr(x) for n, x in _FLAGS.items()})
    return out.select("c_custkey", F.array_join("flags", ",").alias("flags"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'drop' ELSE 'keep' END AS decision FROM customer")
def decided_records(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("identity"), "c_acctbal")
    table = c.select("c_custkey", "identity", F.when(F.col("c_acctbal") < 0, "drop").otherwise("keep").alias("decision"), F.lit("balance").alias("reason"))
    return C.decided(c, table, "c_custkey", "identity").select("c_custkey", "decision")


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'validation' ELSE 'train' END AS s, 'c' || o_custkey AS e, 'order of c' || (o_custkey + 1) || ' here' AS t FROM orders WHERE o_custkey % 4 < 2), v AS (SELECT DISTINCT e FROM r WHERE s = 'validation')
SELECT e AS entity, 'shared' AS kind FROM v WHERE e IN (SELECT e FROM r WHERE s = 'train') UNION ALL SELECT e, 'in_text' FROM v WHERE e IN (SELECT split_part(t, ' ', 3) FROM r WHERE s = 'train')""")
def split_collisions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_custkey % 4 < 2")
    r = o.select(F.when(F.col("o_orderkey") % 5 == 0, "validation").otherwise("train").alias("s"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("e"), F.format_string("order of c%d here", F.col("o_custkey") + 1).alias("t"))
    return C.split_collisions(r, "s", "e", "t")


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (NOT (" + " OR ".join(_FLAGS.values()) + ")) AS accepted, count(*) FILTER (" + " OR ".join(_FLAGS.values()) + ") AS blocked FROM customer GROUP BY 1")
def reuse_screen(spark, sf_dir):
    c = C.flagged(read(spark, sf_dir, "customer"), {n: F.expr(x) for n, x in _FLAGS.items()})
    return C.cohort_summary(c, "c_mktsegment").drop("first_flag")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'baggage,cancel' WHEN 1 THEN 'baggage' WHEN 2 THEN 'cancel' ELSE '' END AS tags, CASE o_orderkey % 4 WHEN 0 THEN 'multi_goal' WHEN 1 THEN 'baggage' WHEN 2 THEN 'cancel' ELSE 'lookup_or_policy' END AS main,
CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'u' || o_custkey ELSE '' END AS entities, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'drop' ELSE '' END AS mutations FROM orders""")
def record_tags(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    call = F.struct(F.when(k.isin(0, 2), "drop").otherwise("look").alias("name"), F.when(k.isin(0, 2), F.create_map(F.lit("user_id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("x"), F.lit("z"))).alias("arguments"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k.isin(0, 1), "My BAGS").otherwise("hello").alias("text"), F.array(call).alias("actions"))
    t = o.withColumn("t", T.tags(F.col("text"), {"baggage": r"\bbags?\b"}, F.transform("actions", lambda a: a["name"]), {"drop": "cancel"}))
    join = lambda c: F.array_join(c, ",")
    return t.select("o_orderkey", join(F.col("t")).alias("tags"), T.primary_tag(F.col("t")).alias("main"), join(T.entities("actions")).alias("entities"), join(T.mutations("actions", ("drop",))).alias("mutations"))


@query("SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) <= 2 AND p_partkey % 5 <> 0")
def length_filter(spark, sf_dir):
    def words(t: str) -> int:
        if t == "broken":
            raise ValueError(t)
        return len(t.split(" "))

    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "broken").otherwise(F.col("p_name")).alias("t"))
    return T.within_length(p, "t", 2, words).select("p_partkey")


@query("WITH v AS (SELECT l_orderkey AS k, -(exp(-l_discount) / 3 * (-l_discount - ln(3)) + exp(-l_tax) / 4 * (-l_tax - ln(4))) AS h FROM lineitem), e AS (SELECT k, 2 * h / ln(1000) AS h FROM v) SELECT k % 9 AS k, round(avg(h), 6) AS entropy, round(avg(greatest(0, least(1, 0.5 + 2 * (h - 0.2)))), 6) AS branch FROM e GROUP BY 1")
def branch_entropy(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    one = F.array(-F.col("l_discount") - F.log(F.lit(3.0)), -F.col("l_tax") - F.log(F.lit(4.0)))
    v = li.select((F.col("l_orderkey") % 9).alias("k"), F.array(one, one, one).alias("x")).withColumn("h", T.partial_entropy("x", 1000, 2))
    return rounded(v.groupBy("k").agg(F.avg("h").alias("entropy"), F.avg(T.branch_probability(0.5, 2.0, F.col("h") - 0.2)).alias("branch")), "entropy", "branch")
