"""Operator 11: sharding by a k-d tree over the documents' metadata. DataFrame functions only.

A node of the tree that is to become several shards is split in two, along the axis of
metadata on which its documents lie widest apart, at the weighted median of their bytes
(or, for an odd number of shards, at the weighted quantile), until every leaf has its
target bytes. Documents with equal texts lie at one point, that of the least doc_id among
them, and a cut that falls among them moves to their nearer end where that costs a shard
little. All nodes of a level are split in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import small, stored, table

SHARDS = 8
#: Steps of an axis, and bits of a document's place below its step: its text's hash, then its own.
GRID, TEXT_BITS, ROW_BITS = 4096, 32, 16
#: A cut goes to the end of a group of equal texts if no shard gains or loses more than one part in so many.
WHOLE_GROUPS = 100
#: Copies of one row that one step lays out.
LAID = 4096


def category(name: str) -> Column:
    """An axis of names. They have no order, so each lies at its hash; null is one with the empty name."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


def magnitude(name: str) -> Column:
    """An axis of amounts, by their logarithm; null and less than one lie at its start."""
    return F.coalesce(F.least(F.lit(GRID - 1), F.floor(100 * F.ln(F.greatest(F.col(name), F.lit(1)))).cast("int")), F.lit(0))


#: The metadata of `documents`; `size` is the row's size in bytes.
AXES = {"lang": category, "source": category, "size": magnitude}


def _points(docs: DataFrame, axes: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(doc_id, copy, size, crc, text_at, row_at, at array<int>): a row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.withColumn("size", F.octet_length(text).cast("long") + 1)
    read = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), "size", F.crc32(text).alias("crc"), F.array(*(axis(name) for name, axis in axes.items())).alias("at"))
    rows = stored(read).groupBy("doc_id", "key").agg(F.first("size").alias("size"), F.first("crc").alias("crc"), F.min("at").alias("at"), F.count("*").alias("n"))
    rows = stored(rows)
    groups = rows.groupBy("key").agg(F.min(F.struct("doc_id", "at"))["at"].alias("led"), F.min("at").alias("low"), F.max("at").alias("high"))
    rows = rows.join(small(groups.filter("low != high").select("key", "led")), "key", "left").withColumn("at", F.coalesce("led", "at"))
    once = rows.filter("n = 1").withColumn("copy", F.lit(0))
    laid = rows.filter("n > 1").withColumn("part", F.explode(F.expr(f"sequence(0, (n - 1) div {LAID})"))).repartition(F.xxhash64("doc_id", "key", "part"))
    laid = laid.withColumn("copy", F.explode(F.expr(f"sequence(part * {LAID}, least(n, (part + 1) * {LAID}) - 1)")))
    number = lambda digest, digits: F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    own = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    columns = ["doc_id", F.col("copy").cast("long").alias("copy"), "size", "crc", number(F.hex("key"), TEXT_BITS // 4).alias("text_at"), number(own, ROW_BITS // 4).alias("row_at"), "at"]
    return stored(once.select(*columns).unionByName(laid.select(*columns)).withColumn("node", F.lit(0)))


def _narrowed(rows: DataFrame, cuts: DataFrame, digit: Column) -> DataFrame:
    """cuts with `digit`, that digit of the last rows before which a node has no more bytes
    than `wanted`, with the bytes `below` it and `held` by it. rows are those still open."""
    held = rows.withColumn("digit", digit).groupBy("node", "digit").agg(F.sum("size").alias("held"))
    held = held.join(cuts.select("node", F.col("below").alias("under"), "wanted"), "node")
    before = F.col("under") + F.coalesce(F.sum("held").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = held.withColumn("below", before).filter("below <= wanted").groupBy("node").agg(F.max(F.struct("digit", "below", "held")).alias("x"))
    return small(cuts.drop("below", "held").join(least, "node").select("*", "x.*").drop("x"))


def _level(points: DataFrame, nodes: DataFrame, total: int, shards: int, n_axes: int) -> tuple[DataFrame, DataFrame]:
    """Splits every node of more than one shard. A node is named by its first shard; nodes
    are (node, k shards, start: the bytes of all shards before it)."""
    spread = points.groupBy("node").agg(*(F.max(F.col("at")[a]) - F.min(F.col("at")[a]) for a in range(n_axes)))
    widest = F.array_max(F.array(*(F.struct(spread[a + 1].alias("width"), F.lit(-a).alias("axis")) for a in range(n_axes))))["axis"]
    half = F.floor(F.col("k") / 2).cast("int")
    cuts = nodes.filter("k > 1").join(spread.select("node", (-widest).alias("axis")), "node").withColumn("half", half)
    wanted = F.greatest(F.lit(0), F.expr(f"cast({total}L * cast(node + half AS decimal(20)) / {shards} AS decimal(38, 6))").cast("long") - F.col("start"))
    cuts = small(cuts.withColumn("wanted", wanted).withColumn("below", F.lit(0).cast("long")))

    axis, text_low = F.col("at")[F.col("axis")], F.col("text_at") % (1 << 16)
    taken = ["node", "size", "text_at", "row_at"]
    open_rows = lambda: points.join(cuts.drop("below", "held", "digit"), "node")
    cuts = _narrowed(open_rows().select("node", "size", axis.alias("place")), cuts, F.col("place")).withColumnRenamed("digit", "at_axis")
    cuts = _narrowed(open_rows().filter(axis == F.col("at_axis")).select(*taken), cuts, F.shiftright("text_at", 16)).withColumnRenamed("digit", "at_text")
    high = F.shiftright("text_at", 16) == F.col("at_text")
    cuts = _narrowed(open_rows().filter((axis == F.col("at_axis")) & high).select(*taken), cuts, text_low)
    cuts = cuts.withColumn("at_text", F.col("at_text") * (1 << 16) + F.col("digit")).drop("digit")
    upto, past = F.col("wanted") - F.col("below"), F.abs(F.col("below") + F.col("held") - F.col("wanted"))
    whole = F.least(upto, past) * (shards * WHOLE_GROUPS) <= total
    text_place = F.col("at_axis").cast("long") * (1 << TEXT_BITS) + F.col("at_text")
    end = lambda near, step, at: F.when(near, at).otherwise(at + step)
    sides = lambda df, step, at: df.withColumn("cut", end(upto <= past, step, at)).withColumn("left", F.when(upto <= past, F.col("below")).otherwise(F.col("below") + F.col("held")))
    at_ends = sides(cuts.filter(whole), 1 << ROW_BITS, text_place * (1 << ROW_BITS))
    among = cuts.filter(~whole)
    inner = points.join(among.drop("below", "held"), "node").filter((axis == F.col("at_axis")) & (F.col("text_at") == F.col("at_text"))).select(*taken)
    inside = sides(_narrowed(inner, among, F.col("row_at")), 1, text_place * (1 << ROW_BITS) + F.col("digit"))
    done = small(at_ends.unionByName(inside.drop("digit")).select("node", "axis", "half", "cut", "left"))

    place = axis.cast("long") * (1 << (TEXT_BITS + ROW_BITS)) + F.col("text_at") * (1 << ROW_BITS) + F.col("row_at")
    moved = points.join(done, "node", "left").withColumn("node", F.when(place >= F.col("cut"), F.col("node") + F.col("half")).otherwise(F.col("node")))
    split = nodes.join(done, "node", "left")
    parts = split.select("node", F.coalesce("half", "k").alias("k"), "start").union(split.filter("half IS NOT NULL").select(F.col("node") + F.col("half"), F.col("k") - F.col("half"), F.col("start") + F.col("left")))
    return stored(moved.select(points.columns)), small(parts)


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, axes: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    docs has doc_id, text and what the axes read; a column of docs named size is replaced, others don't
    matter. size is the text's UTF-8 bytes and one more (a null text has none, as an empty one). shards are numbered
    from 0; given target_bytes and no shards, there are as many as the bytes need. The law is
    `bytes`: a shard differs from its equal part by no more than about two documents, or two hundredths where
    groups of equal texts stay whole for it. A larger group is cut between its rows, wherever the median is.
    slot numbers a shard's rows without gaps, in the order of a hash; rows with one doc_id and
    one text are numbered as copies, one like another. grown_shard is null, as it belongs to another
    law. With fewer documents than shards some stay empty. No rows give no rows.

    axes give a column's place, a whole number from 0 to below GRID, by the column's name. Bytes are summed by node and digit of a row's
    place before they are shuffled, in four passes a level, so no task holds a node's rows; what is kept of a
    level is one row for each node.
    """
    axes = AXES if axes is None else axes
    points = _points(docs.drop("size"), axes)
    total = points.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("give shards, or target_bytes of 1 or more")
        shards = max(1, -(-total // target_bytes))
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    nodes = docs.sparkSession.createDataFrame([(0, shards, 0)], "node int, k int, start long")
    for _ in range((shards - 1).bit_length()):
        points, nodes = _level(points, nodes, total, shards, len(axes))

    counts = points.groupBy("node", "row_at").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("node").orderBy("row_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = small(counts.select("node", "row_at", before.alias("before")))
    within = F.row_number().over(Window.partitionBy("node", "row_at").orderBy("text_at", "crc", "doc_id", "copy"))
    numbered = points.withColumn("within", within).join(base, ["node", "row_at"])
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("node").alias("shard"), (F.col("before") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, **how: object) -> DataFrame:
    """Writes docs below path, a folder shard=... for each shard, in slot order, and returns the
    manifest. Needs a doc_id and text that no two rows share: others would be written once for each copy, so they are an error."""
    manifest = stored(shard_documents(docs, **how))
    twice = manifest.groupBy("doc_id", "size", "text_crc32").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("rows with one doc_id and one text have no place of their own")
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    at = manifest.select(F.col("doc_id").alias("of_"), F.col("size").alias("size_"), F.col("text_crc32").alias("crc_"), "shard", "slot")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("of_")) & (F.octet_length(text).cast("long") + 1 == F.col("size_")) & (F.crc32(text) == F.col("crc_"))
    placed = docs.join(at, same).drop("of_", "size_", "crc_")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest


def op11_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _level_sql(k: int, n: int) -> str:
    """Level k of the tree, by sorting each node's rows: nodes of n shards, of SHARDS in all."""
    place = f"CASE axis WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END * {1 << 32} + text_at"
    return f"""e{k} AS (SELECT node, max(a0) - min(a0) AS r0, max(a1) - min(a1) AS r1, max(a2) - min(a2) AS r2, sum(size) AS bytes FROM p{k} GROUP BY node),
x{k} AS (SELECT node, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS axis,
  greatest(0, total * (node + {n // 2}) // {SHARDS} - coalesce(sum(bytes) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS wanted, total FROM e{k}, total),
q{k} AS (SELECT p{k}.*, axis, wanted, total, {place} AS place FROM p{k} JOIN x{k} USING (node)),
g{k} AS (SELECT node, place, wanted, total, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY node ORDER BY place) - sum(size) AS below FROM q{k} GROUP BY node, place, wanted, total),
m{k} AS (SELECT DISTINCT ON (node) *, least(wanted - below, abs(below + held - wanted)) * {SHARDS * WHOLE_GROUPS} <= total AS whole FROM g{k} WHERE below <= wanted ORDER BY node, place DESC),
i{k} AS (SELECT q.node, q.row_at, m.wanted, sum(q.size) AS held, any_value(m.below) + sum(sum(q.size)) OVER (PARTITION BY q.node ORDER BY q.row_at) - sum(q.size) AS below
  FROM q{k} q JOIN m{k} m ON q.node = m.node AND q.place = m.place WHERE NOT m.whole GROUP BY q.node, q.row_at, m.wanted),
j{k} AS (SELECT DISTINCT ON (node) * FROM i{k} WHERE below <= wanted ORDER BY node, row_at DESC),
c{k} AS (SELECT m.node, CASE WHEN whole THEN CASE WHEN m.wanted - m.below <= abs(m.below + m.held - m.wanted) THEN m.place ELSE m.place + 1 END ELSE m.place END AS cut,
  CASE WHEN whole THEN 0 WHEN j.wanted - j.below <= abs(j.below + j.held - j.wanted) THEN j.row_at ELSE j.row_at + 1 END AS row_cut FROM m{k} m LEFT JOIN j{k} j USING (node)),
p{k + 1} AS (SELECT q.* EXCLUDE (node, axis, wanted, total, place), CASE WHEN q.place > cut OR q.place = cut AND q.row_at >= row_cut THEN q.node + {n // 2} ELSE q.node END AS node FROM q{k} q JOIN c{k} c USING (node))"""


ORACLE_SQL = {
    "op11_shard_documents": rf"""
WITH bits AS (SELECT range AS c, list_reduce([range] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256)),
crc AS (SELECT list(t ORDER BY c) AS t FROM bits),
d AS (SELECT *, coalesce(text, '') AS said FROM documents),
h AS (SELECT *, md5(said) AS key, octet_length(encode(said)) + 1 AS size, hex(encode(said)) AS hexed FROM d),
g AS (SELECT key, any_value(hexed) AS hexed, arg_min({{'lang': lang, 'source': source}}, doc_id) AS led FROM h GROUP BY key),
k AS (SELECT key, led.lang AS lang, led.source AS source, list_reduce([4294967295] || list_transform(range(length(hexed) // 2), lambda i: ('0x' || hexed[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)) AS state FROM g, crc),
p0 AS (SELECT doc_id, size, key, xor(state, 4294967295) AS crc, row_number() OVER (PARTITION BY doc_id, key) - 1 AS copy, ('0x' || key[1:8])::BIGINT AS text_at,
  ('0x' || md5(coalesce(k.lang, ''))[1:3])::BIGINT AS a0, ('0x' || md5(coalesce(k.source, ''))[1:3])::BIGINT AS a1, least({GRID - 1}, floor(100 * ln(size)))::BIGINT AS a2, 0 AS node FROM h JOIN k USING (key)),
total AS (SELECT sum(size) AS total FROM p0),
p1 AS (SELECT *, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR)[1:4])::BIGINT AS row_at FROM p0),
{", ".join(_level_sql(k, SHARDS >> (k - 1)) for k in range(1, 4))}
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, node::INTEGER AS shard, row_number() OVER (PARTITION BY node ORDER BY row_at, text_at, crc, doc_id, copy) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p4"""
}
