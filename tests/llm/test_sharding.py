"""K-d tree shards: laws, groups, awkward rows, and the SQL on the same rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import docs_of
from tidelane.llm import sharding


def rows_of(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abcdé \n", k=rng.choice([3, 40, 400]))) for _ in range(n)]
    texts[n // 2 :] = [rng.choice(texts[: n // 2]) if rng.random() < 0.3 else t for t in texts[n // 2 :]]
    return list(enumerate(texts))


def checked(got, rows, shards, slack):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    of, size = defaultdict(list), Counter()
    for r in got:
        of[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in of.values())
    part = sum(size.values()) / shards
    assert all(abs(size[s] - part) <= slack for s in range(shards))


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_have_equal_bytes(spark, shards):
    rows = rows_of(600)
    got = sharding.shard_documents(docs_of(spark, rows), shards).collect()
    total = sum(r.size for r in got)
    checked(got, rows, shards, 2 * max(r.size for r in got) + total / shards / 50)
    at = defaultdict(set)
    for r in got:
        at[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in at.values()) <= shards  # groups stay together, but where that would cost too much
    if shards == 3:
        return
    again = sharding.shard_documents(docs_of(spark, random.Random(3).sample(rows, len(rows))).repartition(7), shards).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_one_group_of_copies_and_awkward_rows(spark):
    rows = [(i, "the same text " * 20) for i in range(400)] + rows_of(100, 2) + [(None, None)] * 40 + [(7, "")] * 30 + [(1, "again and again")] * 90
    docs = docs_of(spark, rows)
    for name in ("size", "key", "node", "copy", "at", "crc", "led"):
        docs = docs.withColumn(name, F.lit(name))
    checked(sharding.shard_documents(docs).collect(), rows, 8, 2000)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    few = sharding.shard_documents(docs_of(spark, [(1, "a"), (2, None)])).collect()
    assert sorted(r.doc_id for r in few) == [1, 2]
    by_bytes = sharding.shard_documents(docs, shards=None, target_bytes=20_000).collect()
    assert max(r.shard for r in by_bytes) + 1 == -(-sum(r.size for r in by_bytes) // 20_000)
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=None)
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=0)


def test_long_text(spark):
    rows = [(0, "é" * 300_000), *rows_of(50, 4)]
    checked(sharding.shard_documents(docs_of(spark, rows), 2).collect(), rows, 2, 600_001)
    checked(sharding.shard_documents(docs_of(spark, rows), 1).collect(), rows, 1, 0)


def test_shards_equal_their_sql(spark):
    import duckdb

    rows = [(i, t, "en" if i % 3 else None, f"src{i % 5}") for i, t in rows_of(300, 5)] + [(900 + i, "copies " * 30, "de", "src9") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = con.execute("SELECT doc_id, size, text_crc32, shard, slot FROM (" + sharding.ORACLE_SQL["op11_shard_documents"] + ")").fetchall()
    assert set(sql) == {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs).collect()}


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, rows_of(120, 6))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="place of their own"):
        sharding.write_shards(docs.limit(3).union(docs.limit(3)), str(tmp_path / "twice"), shards=1)
