"""Every query against its SQL on the smallest tables, and operators on the reference's own examples."""

import glob
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelane import catalog
from tidelane.functions import text
from tidelane.operators import aggregates, estimators, relations, retrieval, sequences
from tidelane.sources import files
from tidelane.streaming import streams


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    flat = [tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows]
    return sorted(flat, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rpartition('/')[2].split('.')[0]} AS SELECT * FROM '{path}'")
    want = con.sql(catalog.oracle_sql()[name])
    columns, rows = want.columns, want.fetchall()
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    a, b = _rows(got.columns, [tuple(r) for r in got.collect()]), _rows(columns, rows)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(math.isclose(u, v, abs_tol=2e-5) if isinstance(u, float) or isinstance(v, float) and u is not None and v is not None else u == v for u, v in zip(x, y)), (x, y)


def test_bootstrap_is_seeded(spark, sf_dir):
    run = catalog.queries()["paired_bootstrap"]
    assert run(spark, sf_dir).first() == run(spark, sf_dir).first()
    with pytest.raises(ValueError):
        aggregates.paired_bootstrap(spark.createDataFrame([], "baseline double, treatment double"))


def test_pass_at_k_of_two_tasks(spark):
    rows = [("a", r) for r in (1.0, 1.0, 0.0, 0.0)] + [("b", 0.0)] * 4
    got = aggregates.macro_pass(spark.createDataFrame(rows, "task_id string, reward double"), (1, 2, 4)).first()
    assert [got.pass_at_1, got.pass_hat_1, got.pass_hat_4] == [0.25, 0.25, 0.0]
    assert math.isclose(got.pass_at_2, 5 / 12) and math.isclose(got.pass_hat_2, 1 / 12) and got.pass_at_4 == 0.5
    near = spark.createDataFrame([("t", r) for r in (0.5, 1 - 0.5e-6, 1 + 0.5e-6, 1 - 2e-6)], "task_id string, reward double")
    assert aggregates.macro_pass(near, (1,)).first().pass_at_1 == 0.5


def test_returns_and_advantages(spark):
    row = spark.createDataFrame([([1.0, 0.0, 2.0], [1, 0, 1])], "r array<double>, m array<int>")
    assert row.select(estimators.discounted_returns("r", 0.5, "m")).first()[0] == [2.0, 2.0, 2.0]
    assert row.select(estimators.discounted_returns("r", 0.5)).first()[0] == [1.5, 1.0, 2.0]
    two = spark.createDataFrame([("u", 1, 1.0), ("u", 2, 0.0), ("v", 3, 5.0)], "uid string, row_id long, score double")
    got = {r.row_id: r.advantage for r in estimators.advantage("grpo", two).collect()}
    assert math.isclose(got[1], 0.5 / (math.sqrt(0.5) + 1e-6)) and math.isclose(got[3], 5 / (1 + 1e-6))
    assert {r.row_id: r.advantage for r in estimators.advantage("rloo", two).collect()}[3] == 5.0
    assert {r.row_id: r.advantage for r in estimators.advantage("rloo_vectorized", two).collect()}[3] == 0.0
    with pytest.raises(Exception, match="two or more"):
        estimators.advantage("grpo_passk", two).collect()
    with pytest.raises(ValueError):
        estimators.advantage("none", two)
    with pytest.raises(NotImplementedError):
        estimators.kl_penalty("full")


def test_filters_and_joins(spark):
    df = spark.createDataFrame([(1, "ab", [1]), (2, None, [2]), (3, "b", None)], "id int, s string, xs array<int>")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(relations.query(df, s__ne="ab")) == [2, 3] and ids(relations.query(df, s__contains="b")) == [1, 3]
    assert ids(relations.query(df, id__nin=(1, 3))) == [2] and ids(relations.remove(df, s="ab")) == [2, 3]
    assert relations.query(df, limit=2).count() == 2
    with pytest.raises(ValueError):
        relations.query(df, nothing=1)
    with pytest.raises(ValueError):
        relations.query_json(df, "[1]")
    with pytest.raises(Exception, match="one side"):
        relations.align(df, df.filter("id < 3"), "id", strict=True).collect()
    with pytest.raises(Exception, match="differs"):
        relations.zip_columns(df, df.withColumn("s", F.lit("z")), "id").collect()


def test_split_sizes(spark):
    got = sequences.hash_rank_split(spark.range(100), "id", 7, {"train": 30, "dev": 20}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 30, "dev": 20, "reserve": 50}


def test_text(spark):
    one = spark.createDataFrame([("On 2024-05-01 ref AB12 id XY_901 The cat, a  hat! <answer> x </answer><answer>y</answer> it is 1,234",)], "t string")
    row = one.select(text.mask_entities(F.col("t")).alias("m"), text.normalize_answer(F.lit("The cat, a  hat!")).alias("n"), text.last_answer(F.col("t")).alias("a"), text.last_number(F.col("t")).alias("x")).first()
    assert row.m.startswith("on <ENTITY> ref ab12 id <ENTITY> the cat") and row.n == "cat hat" and row.a == "y" and row.x == "1234"


def test_retrieval_oddities(spark):
    docs = spark.createDataFrame([(1, "a (b"), (2, None), (3, "(b (b")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.grep(docs, "(b", 5).collect()] == [3, 1]
    assert retrieval.bm25(docs, spark.createDataFrame([(1, " ")], "query_id long, text string"), 3).count() == 0
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.score for r in retrieval.cosine(vectors, vectors.filter("vec_id = 2").withColumnRenamed("vec_id", "query_id"), 5).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", ("y", 1)), (1, None, ("x", 2))], "task_id long, a string, z struct<k string, c int>")
    files.write_jsonl(rows, f"{tmp_path}/j")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect())
    assert lines == ['{"a":"b","task_id":2,"z":{"c":1,"k":"y"}}', '{"a":null,"task_id":1,"z":{"c":2,"k":"x"}}']
    with pytest.raises(Exception, match="exists"):
        files.write_jsonl(rows, f"{tmp_path}/j")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": "no"}\n')
    assert [r.line for r in files.broken_lines(spark, f"{tmp_path}/x.jsonl", "a INT").collect()] == ['{"a": "no"}']
    with pytest.raises(Exception):
        files.jsonl(spark, f"{tmp_path}/x.jsonl", "a INT").collect()
    assert files.dataset(spark, f"{tmp_path}/x.jsonl", f"{tmp_path}/x.jsonl", sample=3, seed=1, key="a").count() == 3
    (tmp_path / "db.json").write_text(json.dumps({"users": {"u1": {"name": "n"}, "u2": {"name": None}}}))
    assert {r.id: r.name for r in files.keyed_document(spark, f"{tmp_path}/db.json", "users", "name STRING").collect()} == {"u1": "n", "u2": None}
    hashes = files.content_hashes(spark, f"{tmp_path}/db.json")
    assert hashes.count() == 1 and len(files.tree_hash(hashes).first().sha256) == 64
    paths = spark.createDataFrame([("a/b",), ("a/../b",), ("../x",), ("/etc",), ("a/../../x",)], "p string")
    assert [r[0] for r in paths.select(files.inside(F.col("p"))).collect()] == [True, True, False, False, False]
    files.write_splits(rows.withColumn("split", F.lit("train")), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/manifest").first().n == 2
    assert files.melt(spark.createDataFrame([(1, "c", "r")], "id int, chosen string, rejected string"), ["id"], ["chosen", "rejected"]).count() == 2


def test_streams(spark, tmp_path):
    def through(frames, schema, stream_of, name):
        folder = tmp_path / name
        for k, rows in enumerate(frames):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            source = spark.readStream.schema(schema).parquet(str(folder / "in"))
            streams.sink_once(stream_of(source), str(folder / "out"), str(folder / "ck")).awaitTermination(120)
        return spark.read.parquet(str(folder / "out")).collect()

    got = through([[("r", 1, 1.0), ("r", 3, 2.0)], [("r", 2, 9.0), ("r", 4, 3.0), ("r", 4, 3.0)]], "run string, step long, value double", streams.monotonic_steps, "steps")
    assert sorted(r.step for r in got) == [1, 3, 4]
    got = through([[("q", i) for i in range(5)], [("q", i) for i in range(5, 7)]], "queue string, item long", lambda s: streams.bounded_queue(s, 3, 2), "queue")
    assert sorted((r.item, r.produced, r.dropped) for r in got) == [(2, 5, 2), (3, 5, 2), (4, 7, 2), (5, 7, 2)]
    plan = spark.createDataFrame([("a", 0), ("a", 1)], "task string, trial int")
    assert streams.remaining(plan, plan.filter("trial = 0"), "task", "trial").count() == 1
