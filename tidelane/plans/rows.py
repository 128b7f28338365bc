"""Queries over the rows and columns of batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.operators import batches as B
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


def numbered(spark, sf_dir):
    """Customers by their keys, which are dense from 0 on."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), "c_name", "c_acctbal")


_N = "n AS (SELECT c_custkey AS row, c_name, c_acctbal FROM customer)"


@query("SELECT c_custkey, c_name FROM customer")
def column_select(spark, sf_dir):
    return B.select_columns(read(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@query("SELECT c_custkey, c_acctbal, 'popped' AS side FROM customer UNION ALL SELECT c_custkey, length(c_name), 'rest' FROM customer")
def column_pop(spark, sf_dir):
    a, b = B.pop_columns(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name"), ["c_acctbal"], "c_custkey")
    return a.select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.lit("popped").alias("side")).union(b.select("c_custkey", F.length("c_name").cast("double"), F.lit("rest")))


@query('SELECT c_custkey AS "batch/id", c_name AS "batch/c_name" FROM customer')
def column_rename(spark, sf_dir):
    return B.rename_columns(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_custkey": "id"}, "batch")


@query(f"WITH {_N}, p AS (SELECT o_orderkey AS spot, o_custkey AS row FROM orders WHERE o_orderkey % 3 = 0) SELECT spot, c_name FROM p JOIN n USING (row)")
def row_picks(spark, sf_dir):
    picks = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("spot"), F.col("o_custkey").alias("row"))
    return B.rows_at(numbered(spark, sf_dir), "row", picks, "spot").select("spot", "c_name")


@query(f"WITH {_N} SELECT row, c_name FROM n WHERE row >= 10 AND row < 100 AND (row - 10) % 7 = 0")
def row_slice(spark, sf_dir):
    return B.slice_rows(numbered(spark, sf_dir), "row", 10, 100, 7).select("row", "c_name")


@query(f"WITH {_N} SELECT (SELECT max(row) FROM n) - row AS row, c_name, row AS back FROM n")
def row_reorder(spark, sf_dir):
    n = numbered(spark, sf_dir)
    last = n.agg(F.max("row").alias("m"))
    order = n.select("row").crossJoin(F.broadcast(last)).select("row", (F.col("m") - F.col("row")).alias("to"))
    back = B.inverse(order, "row").select(F.col("row"), F.col("to").alias("back"))
    return B.reorder(n, "row", order).select("row", "c_name").join(back, "row")


@query(f"WITH {_N}, k AS (SELECT count(*) AS c, (7 - count(*) % 7) % 7 AS more FROM n) SELECT row, c_name, false AS is_padding FROM n UNION ALL SELECT row + c, c_name, true FROM n, k WHERE row < more")
def row_padding(spark, sf_dir):
    return B.pad_to_divisor(numbered(spark, sf_dir), "row", 7).select(F.col("row").cast("long").alias("row"), "c_name", "is_padding")


@query(f"WITH {_N} SELECT row, part, row * 10 + part * 2 AS first, row * 10 + part * 2 + 1 AS second FROM n, (VALUES (0), (1), (2)) v(part)")
def column_unfold(spark, sf_dir):
    rows = numbered(spark, sf_dir).select("row", F.expr("transform(sequence(0, 5), i -> row * 10 + i)").alias("x"))
    out = B.unfold_columns(rows, ["x"], 3)
    return out.select("row", F.col("part").cast("int").alias("part"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@query(f"WITH {_N} SELECT CAST(row // 4 AS BIGINT) AS fold, count(*) AS n, min_by(c_name, row) AS first, max_by(c_name, row) AS last FROM n GROUP BY 1")
def batch_fold(spark, sf_dir):
    out = B.fold_rows(numbered(spark, sf_dir), "row", 4, ["c_name"])
    return out.select("fold", F.size("c_name").cast("long").alias("n"), F.get("c_name", F.lit(0)).alias("first"), F.element_at("c_name", -1).alias("last"))


@query(f"WITH {_N} SELECT row, c_name FROM n")
def batch_unfold(spark, sf_dir):
    n = numbered(spark, sf_dir)
    return B.unfold_rows(B.fold_rows(n, "row", 4, ["c_name"]), "row", 4, ["c_name"])


@query(f"WITH {_N}, k AS (SELECT row, ntile(8) OVER (ORDER BY row) - 1 AS chunk FROM n) SELECT CAST(chunk AS INT) AS chunk, count(*) AS n, min(row) AS first FROM k GROUP BY 1")
def batch_chunks(spark, sf_dir):
    return B.chunks(numbered(spark, sf_dir), "row", 8).groupBy("chunk").agg(F.count("*").alias("n"), F.min("row").alias("first"))


@query(f"WITH {_N}, e AS (SELECT row, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('5:' || epoch || ':' || row), row) - 1 AS place FROM n, (VALUES (0), (1)) v(epoch)) SELECT epoch, CAST(place // 16 AS BIGINT) AS batch, CAST(sum(row) AS BIGINT) AS rows_sum, count(*) AS n FROM e GROUP BY ALL")
def minibatches(spark, sf_dir):
    out = B.minibatches(numbered(spark, sf_dir), "row", 16, 2, 5)
    return out.groupBy("epoch", F.col("batch").cast("long").alias("batch")).agg(F.sum("row").cast("long").alias("rows_sum"), F.count("*").alias("n"))


@query(f"WITH {_N} SELECT row, copy, CAST(copy * (SELECT count(*) FROM n) + row AS BIGINT) AS place FROM n, (VALUES (0), (1), (2)) v(copy)")
def row_tiles(spark, sf_dir):
    return B.tiled(numbered(spark, sf_dir), "row", 3).select("row", F.col("copy").cast("int").alias("copy"), F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey % 9 + 1) OVER w - (o_orderkey % 9 + 1) AS BIGINT) AS start, CAST(sum(o_orderkey % 9 + 1) OVER w AS BIGINT) AS \"end\" FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def sequence_offsets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 9 + 1).alias("length"))
    return B.sequence_offsets(o, "o_custkey", "o_orderkey", "length").select("o_custkey", "o_orderkey", "start", "end")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS grp FROM e)
SELECT user_id, CAST(grp AS BIGINT) AS "group", any_value(event_type) AS event_type, min(event_id) AS first, count(*) AS n FROM g GROUP BY user_id, grp""")
def contiguous_groups(spark, sf_dir):
    return B.contiguous_groups(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT o_custkey AS batch, o_orderkey % 100 + 1 AS l FROM orders), k AS (SELECT batch, sum(l) AS t, count(*) AS n FROM o GROUP BY 1)
SELECT batch, CAST(least(n, ceil(t / 400.0)) AS BIGINT) AS parts, n AS n_rows, CAST(t AS BIGINT) AS tokens FROM k""")
def token_budget_batches(spark, sf_dir):
    """How many parts a customer's orders need; that the parts are near equal is tested on its own."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("l"))
    out = B.token_batches(o, "batch", "o_orderkey", "l", 400).join(o, ["batch", "o_orderkey"])
    return out.groupBy("batch").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n_rows"), F.sum("l").alias("tokens"))


@query("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS k, array_to_string(list(o_orderstatus ORDER BY o_orderkey), ',') AS p,
  string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS back FROM orders GROUP BY 1""")
def row_lists(spark, sf_dir):
    """Lists of each customer's orders, and the rows made of them again."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("p"))
    lists = B.to_lists(o, "o_custkey", "at")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    rows = B.from_lists(lists, "o_custkey", "place").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "k", "p").alias("x")))).alias("x"))
    return lists.select("o_custkey", text("k"), text("p")).join(rows.select("o_custkey", F.array_join("x.x", ",").alias("back")), "o_custkey")


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 100000000 FROM orders")
def batch_concat(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return B.concat([o, o.select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"))])[0]


@query("""WITH v AS (SELECT o_orderkey AS k, range(0, o_orderkey % 6) AS x FROM orders)
SELECT k, CASE WHEN len(x) <= 4 THEN list_concat(list_resize(CAST([] AS BIGINT[]), 4 - len(x), -1), x) ELSE x[len(x) - 3 : len(x)] END AS l, CASE WHEN len(x) <= 4 THEN list_concat(x, list_resize(CAST([] AS BIGINT[]), 4 - len(x), -1)) ELSE x[1:2] || x[len(x) - 1 : len(x)] END AS m FROM v""".replace("SELECT k, CASE", "SELECT k, array_to_string(CASE", 1).replace("END AS l, CASE", "END, ',') AS l, array_to_string(CASE").replace("END AS m", "END, ',') AS m"))
def padded_sequences(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("filter(sequence(0, 5), i -> i < o_orderkey % 6)").alias("x"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return v.select("k", text(B.padded("x", 4, -1, left=True, truncation="left")).alias("l"), text(B.padded("x", 4, -1, truncation="middle")).alias("m"))


@query("""WITH v AS (SELECT o_orderkey AS k, [1, 2, 3] || CASE o_orderkey % 3 WHEN 0 THEN [7, 7, 7] WHEN 1 THEN [4, 5, 4, 5, 4, 5] ELSE [4, 5, 6] END AS x FROM orders)
SELECT k, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS period FROM v""")
def suffix_periods(spark, sf_dir):
    tail = F.when(F.col("k") % 3 == 0, F.array(*map(F.lit, [7, 7, 7]))).when(F.col("k") % 3 == 1, F.array(*map(F.lit, [4, 5, 4, 5, 4, 5]))).otherwise(F.array(*map(F.lit, [4, 5, 6])))
    v = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.concat(F.array(*map(F.lit, [1, 2, 3])), tail).alias("x"))
    return v.select("k", B.suffix_period("x", 3, 3).alias("period"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderkey % 37 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 37 DESC, o_orderkey) AS r FROM orders),
g AS (SELECT o_custkey, o_orderkey, r, 0 AS part, [c, 0, 0] AS loads FROM o WHERE r = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.r, list_position(loads, list_min(loads)) - 1,
  list_transform([1, 2, 3], lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.c ELSE 0 END) FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.r = g.r + 1)
SELECT o_custkey, o_orderkey, CAST(part AS INT) AS part FROM g""")
def greedy_partitions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 37).alias("c"))
    return B.greedy_partitions(o, "o_custkey", "o_orderkey", "c", 3).withColumn("part", F.col("part").cast("int"))
