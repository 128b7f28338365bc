"""Choices, documents, files and hooks that SQL doesn't say, against brute force and on hand-made cases."""

import difflib
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelane.functions import documents as D
from tidelane.operators import batches, curation, dialogues, evaluation, hooks, policy, relations, sequences, training
from tidelane.sources import files
from tidelane.streaming import streams


def test_closest_against_all_pairs(spark):
    texts = ["change my flight to Monday", "Change my flight to Tuesday!", "cancel the booking", "", None, "change my flight to Monday please", "monday flight my change to"]
    blocked = ["change my flight to monday", "refund the whole booking", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.blocked, round(r.similarity, 6)) for r in curation.closest(df, "text", spark.createDataFrame([(b,) for b in blocked], "text string"), "id", 0.7).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in (t or "").lower()).split())
    want = {}
    for i, t in enumerate(texts):
        best = (0.0, "")
        for b in blocked:
            x, y = norm(t), norm(b)
            if x and y:
                a, c = set(x.split()), set(y.split())
                best = max(best, (1.0 if x == y else max(len(a & c) / len(a | c), difflib.SequenceMatcher(None, x, y).ratio()), b))
        if best[0] >= 0.7:
            want[i] = (best[1], round(best[0], 6))
    assert got == want and len(want) >= 4


def test_near_duplicates(spark):
    rows = [("a b c d", "a b c d"), ("abcdefgh ij", "abcdefgh ik"), ("", "a"), ("one two", "three four five six"), (None, "a")]
    got = [r.n for r in spark.createDataFrame(rows, "a string, b string").select(D.near_duplicate(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [True, True, False, False, False]


def test_greedy_choices(spark):
    rows = [(i, "abc"[i % 3], i % 2, [f"u{i % 4}"], float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, category string, stratum int, entities array<string>, merit double")
    got = [r.id for r in curation.balanced_selection(df, "id", 15, 42).orderBy("place").collect()]
    pool, want, cats, strata, used = list(rows), [], Counter(), Counter(), Counter()
    while len(want) < 15:
        r = min(pool, key=lambda r: (cats[r[1]], strata[r[1:3]], sum(used[e] for e in r[3]), -r[4], hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()))
        pool.remove(r)
        want.append(r[0])
        cats[r[1]] += 1
        strata[r[1:3]] += 1
        used.update(r[3])
    assert got == want
    tools = spark.createDataFrame([(i, ["common"] + (["rare"] if i == 7 else []), "x") for i in range(20)], "id long, tools array<string>, category string")
    assert 7 in {r.id for r in curation.covering_selection(tools, "id", 3, 1, least=1).collect()}
    assert [r.id for r in curation.covering_selection(tools, "id", 1, 1, goals={"x": 3}).collect()] == [7]
    diverse = spark.createDataFrame([(1, "cancel it"), (2, "cancel it!"), (3, "book a seat"), (4, None)], "id long, reason string")
    assert len({r.id for r in curation.diverse_selection(diverse, "id", "reason", 1, 9, 0.9).collect()} & {1, 2}) == 1


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, x string")
    for broken in (
        lambda: curation.unique_keys(df, "id"), lambda: curation.evidence(df.filter("x != 'b'"), df.filter("id = 1 AND x = 'a'"), df.filter("x != 'b'"), "id"), lambda: evaluation.trainable_only(df, "x", ["a"]),
        lambda: dialogues.lookup(df, "id", 1), lambda: dialogues.lookup(df, "id", 9), lambda: batches.rows_at(df, "id", spark.createDataFrame([(0, 5)], "at long, id long")), lambda: relations.align(df, df.filter("id = 1"), "id", strict=True),
        lambda: curation.decided(df.filter("x = 'c'"), spark.createDataFrame([(2, "other", "keep", "why")], "id long, x string, decision string, reason string"), "id", "x"),
    ):
        with pytest.raises(Exception):
            broken().collect()
    plan = spark.createDataFrame([("t", 0, 5), ("t", 1, 6)], "task_id string, trial long, seed long")
    done = lambda *rows: spark.createDataFrame(rows, "task_id string, trial long, seed long, reward double, termination_reason string")
    none = plan.limit(0)
    assert Counter(r.status for r in evaluation.checked_results(plan, done(("t", 0, 5, 1.0, "agent_stop")), none).collect()) == {"scored": 1, "missing": 1}
    for bad in (("t", 0, 9, 1.0, "agent_stop"), ("u", 0, 5, 1.0, "agent_stop"), ("t", 0, 5, float("nan"), "agent_stop"), ("t", 0, 5, 0.0, "infrastructure_error")):
        with pytest.raises(Exception):
            evaluation.checked_results(plan, done(bad), none).collect()
    with pytest.raises(Exception):
        evaluation.checked_results(plan, done(("t", 0, 5, 1.0, "x"), ("t", 0, 5, 1.0, "x")), none).collect()


def test_rejection_options():
    assert policy.rejection_options({"token_k1": 2})["token_k1"] == pytest.approx((-0.693147, 0.693147), abs=1e-5)
    for bad in ({"seq_max_k1": 1}, {"token_k2": "0.1_2"}, {"token_k3": -1}, {"nothing": 1}):
        with pytest.raises(ValueError):
            policy.rejection_options(bad)


def test_metrics_with_large_means(spark):
    from tidelane.operators import aggregates, estimators

    df = spark.createDataFrame([(1e9 + i, 1) for i in range(5)], "v double, w int")
    assert aggregates.masked_stats(df, "v", "w").first().masked_var == pytest.approx(2.5)
    assert estimators.whiten(df, "v", "w").agg(F.max("advantage")).first()[0] == pytest.approx(2 / 2.5**0.5, rel=1e-6)
    assert training.bootstrap_metric(spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2)], "k string, v double, o int"), "k", "v", "o", 2).filter("metric = 'mean'").first()["mean"] == 1.0


def test_places_and_long_arrays(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("double").alias("cost"))
    got = sequences.places(rows, "cost", "row").collect()
    assert sorted(r.place for r in got) == list(range(3000))
    by = [r.cost for r in sorted(got, key=lambda r: r.place)]
    assert by == sorted(by, reverse=True)
    from tidelane.operators import estimators

    long = spark.range(1).select(F.array_repeat(F.lit(1.0), 100_000).alias("r"), F.array_repeat(F.lit(1), 3).alias("m"))
    assert long.select(F.get(estimators.discounted_returns("r", 0.5), F.lit(0)).alias("x")).first().x == pytest.approx(2.0)
    empty = spark.createDataFrame([([],), (None,), ([2.0, 4.0],)], "r array<double>")
    assert [r.x for r in empty.select(estimators.discounted_returns("r", 0.5).alias("x")).collect()] == [[], None, [4.0, 4.0]]


def test_grep_takes_what_spark_takes(spark):
    from tidelane.operators import retrieval

    docs = spark.createDataFrame([(1, "a (?P<n>x) b"), (2, "xx")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.grep(docs, "(?P<n>x)", 5).collect()] == [1]


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id long, x string, v double")
    total = lambda d: d.groupBy("x").agg(F.sum("v").alias("total"))
    files.write_bundle(df, total(df), f"{p}/bundle")
    assert files.verify_bundle(spark, f"{p}/bundle", total).count() == 0
    assert files.verify_bundle(spark, f"{p}/bundle", lambda d: total(d.filter("id = 1"))).count() == 1
    files.replace_state(df.limit(1), f"{p}/state")
    files.replace_state(df, f"{p}/state")
    assert files.read_state(spark, f"{p}/state").count() == 2
    for folder in (True, False):
        files.write_results(df, f"{p}/results{folder}", "id", folder)
    assert files.results(spark, f"{p}/resultsFalse").count() == 2 and files.results(spark, f"{p}/resultsTrue/simulations").count() == 2
    files.write_pivot(df, f"{p}/pivot", ["id"], "x", ["a", "b"], F.sum("v"))
    assert spark.read.option("header", True).csv(f"{p}/pivot").columns == ["id", "a", "b"]
    for name, text in (("kb/one.md", "# Title \nbody"), ("kb/two.txt", "plain"), ("conf.toml", "[a.b]\nx = 1\ny = [2, 3]\n"), ("board/m1/submission.json", '{"name": "m"}'), ("m.jsonl", '{"task_id": "t"}\n')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.doc_id, r.title) for r in files.knowledge_base(spark, f"{p}/kb").collect()} == {("one", "Title"), ("two", "two")}
    assert {(r.section, r.key, r.value) for r in files.toml_document(spark, f"{p}/conf.toml").collect()} == {("a/b", "x", "1"), ("a/b", "y", "[2, 3]")}
    assert files.leaderboard(spark, f"{p}/board", "name STRING").first().submission == "m1"
    assert files.manifest(spark, f"{p}/m.jsonl").count() == 1
    assert files.provenance(spark, {"kb": f"{p}/kb"}).first().files == 2
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/run.json").write_text('{"spec": 1}')
    with pytest.raises(ValueError):
        files.evaluation(spark, f"{p}/ev")
    (tmp_path / "ev/trajectories.jsonl").write_text('{"task_id": "t", "reward": 1.0}\n')
    run, trajectories, errors, hashes = files.evaluation(spark, f"{p}/ev")
    assert run.first().spec == 1 and trajectories.count() == 1 and errors.count() == 0 and hashes.count() == 2
    files.append_log(df, f"{p}/log")
    files.append_log(df, f"{p}/log")
    assert spark.read.json(f"{p}/log").count() == 4
    assert streams.fresh(df, "id", 3, 1).count() == 1


def test_hooks(spark, tmp_path):
    (tmp_path / "reward.py").write_text("def score(solution, truth):\n    return 1.0 if solution == truth else 0.25\n")
    score = hooks.reward_function(str(tmp_path / "reward.py"), "score")
    df = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a")], "s string, t string")
    assert [r.x for r in df.select(hooks.each_reward(score, F.col("s"), F.col("t")).alias("x")).collect()] == [1.0, 0.25, None]
    with pytest.raises(AttributeError):
        hooks.reward_function(str(tmp_path / "reward.py"), "none")
    hooks.RETRIEVERS.register("all")(lambda d: d)
    with pytest.raises(ValueError):
        hooks.RETRIEVERS.register("all")(lambda d: d.limit(1))
    assert hooks.retrieve(df, ["all"], lambda r: r[0]).count() == 3
    with pytest.raises(ValueError):
        hooks.dataset("none")


def test_assembled_batches(spark, tmp_path):
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).select(F.lit("q").alias("queue"), F.col("id").alias("item")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("queue string, item long").parquet(f"{tmp_path}/in")
    streams.sink_once(streams.batches_of(stream, 4), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.number for r in got.collect()) == [0, 1] and all(len(r["items"]) == 4 for r in got.collect())
    assert streams.allowed_samples(100, 0.5, 2) == 300
    assert [r.pause for r in streams.paused(spark.createDataFrame([(300, 0), (10, 9), (10, 1)], "made int, queued int"), 300, capacity=8).collect()] == [True, True, False]


def test_replay(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value long")
    act = lambda *rows: spark.createDataFrame(rows, "run string, key string, step long, value long")
    gold = act(("r", "a", 1, 9), ("s", "b", 1, None), ("t", "a", 1, 1))
    said = act(("r", "a", 1, 5), ("r", "a", 2, 9), ("s", "b", 1, 7), ("u", "a", 1, 1))
    assert {r.run: r.reward for r in dialogues.same_outcome(state, said, gold, "run", "key", "step", "value").collect()} == {"r": 1.0, "s": 0.0, "t": 1.0, "u": 1.0}


def test_knowledge_base_of_json_documents(spark, tmp_path):
    import json

    write = lambda name, **doc: (tmp_path / name).write_text(json.dumps(doc))
    write("a.json", id="one", title="First", content="Text of\none", more=[1])
    write("b.json", id="two", title="Second", content="é")
    write("c.json", id="two", title="Second again", content="")
    assert {tuple(r) for r in files.knowledge_base(spark, str(tmp_path)).collect()} == {("one", "First", "Text of\none"), ("two", "Second again", "")}
    write("d.json", id="three", content="no title")
    with pytest.raises(Exception, match="no id, title or content"):
        files.knowledge_base(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert files.knowledge_base(spark, str(tmp_path / "none")).count() == 0


def test_next_step_takes_one_row_of_each(spark):
    log = spark.createDataFrame([(1, "a"), (3, "b")], "step long, text string")
    rows = spark.createDataFrame([(3, "old"), (4, "y"), (4, "x"), (5, "z"), (5, "z"), (None, "none")], "step long, text string")
    assert sorted(tuple(r) for r in files.next_step(log, rows).collect()) == [(4, "x"), (5, "z")]
    assert sorted(tuple(r) for r in files.next_step(log, rows.repartition(3), order="text").collect()) == [(4, "x"), (5, "z")]
    assert files.next_step(log.limit(0), rows).count() == 3 and files.next_step(log, rows.limit(0)).count() == 0
