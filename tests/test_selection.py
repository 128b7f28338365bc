"""Call credit, covariance losses, resampling, selection and matching: hand-made cases and brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelane.operators import credit, policy, selection


def test_largest_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(selection, "ORDERED", 10)
    rng = random.Random(5)
    rows = [(i, rng.choice([0.0, 1.0, -2.5, rng.random(), rng.expovariate(1e-6)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v double")
    for k in (0, 1, 7, 130, 260, 499, 500, 900):
        want = sorted(i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k])
        assert sorted(r.i for r in selection.largest(df, "v", "i", k).collect()) == want
    assert selection.largest(df.limit(0), "v", "i", 3).count() == 0


def test_resampling_follows_the_weights(spark):
    rows = [("a", i, float(i % 4)) for i in range(2000)] + [("b", 1, 3.0), ("c", 2, 0.0), ("c", 3, None)]
    df = spark.createDataFrame(rows, "batch string, row long, score double")
    for method, share in (("pow", {1: 1 / 14, 2: 4 / 14, 3: 9 / 14}), ("max_min", {0: 0.5, 3: 0.5}), ("max_random", {0: 1 / 7, 1: 1 / 7, 2: 1 / 7, 3: 4 / 7})):
        got = selection.weighted_resample(df, "batch", "row", "score", method).collect()
        assert Counter(r.batch for r in got) == {"a": 2000, "b": 1, "c": 1}
        drawn = Counter(r.row % 4 for r in got if r.batch == "a")
        assert set(drawn) == set(share) and all(abs(drawn[x] / 2000 - p) < 0.05 for x, p in share.items())
        assert [r.row for r in got if r.batch != "a"] in ([1, 2], [2, 1])
    with pytest.raises(ValueError):
        selection.weighted_resample(df, "batch", "row", "score", "other")


def test_capped_selection_equals_taking_one_by_one(spark):
    import hashlib

    rows = [(i, i % 3 if i % 5 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, b int")
    taken, full = [], Counter()
    for i, b in sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()):
        if full[b] < 4 and len(taken) < 10:
            taken.append(i)
            full[b] += 1
    assert sorted(r.i for r in selection.capped_selection(df, "b", "i", 4, 10, 2).collect()) == sorted(taken)


def test_balanced_examples_fill_and_prefer_new_tasks(spark):
    df = spark.createDataFrame([(f"t{i % 3}" if i else None, i, i < 4) for i in range(40)], "task string, i long, win boolean")
    got = selection.balanced_examples(df, "task", "i", F.col("win"), 11).collect()
    assert len(got) == 11 and sum(r.win for r in got) == 4  # only four are there; the others fill up
    few = selection.balanced_examples(df.filter("i > 0"), "task", "i", F.col("win"), 6).collect()
    assert sum(r.win for r in few) == 3 and all(n == 1 for n in Counter((r.win, r.task) for r in few).values())


def test_differencing_partitions(spark):
    rng = random.Random(1)
    rows = [(b, b * 100 + i, float(rng.randint(1, 9999))) for b in range(3) for i in range(24)] + [(9, 900, 5.0)]
    df = spark.createDataFrame(rows, "b long, i long, cost double")
    cost = {i: c for _, i, c in rows}
    for equal in (False, True):
        got = selection.differencing_partitions(df.filter("b < 3"), "b", "i", "cost", 4, equal).collect()
        assert Counter(r.i for r in got) == Counter(i for b, i, _ in rows if b < 3)
        for b in range(3):
            loads = [sum(cost[r.i] for r in got if r.b == b and r.part == p) for p in range(4)]
            assert max(loads) - min(loads) < 0.1 * sum(loads) / 4
            assert not equal or {sum(r.b == b and r.part == p for r in got) for p in range(4)} == {6}
    plain = spark.createDataFrame([(0, i, float(c)) for i, c in enumerate([4, 5, 6, 7, 8])], "b long, i long, cost double")
    parts = {r.i: r.part for r in selection.differencing_partitions(plain, "b", "i", "cost", 2).collect()}
    loads = sorted(sum(c for i, c in enumerate([4, 5, 6, 7, 8]) if parts[i] == p) for p in (0, 1))
    assert loads == [14, 16]  # the method's known outcome for these numbers
    with pytest.raises(Exception, match="evenly"):
        selection.differencing_partitions(df, "b", "i", "cost", 4, True).collect()


def test_actions_match_on_the_arguments_that_count(spark):
    kind = "k long, no long, name string, arguments map<string,string>"
    gold = spark.createDataFrame([(1, 0, "f", {"a": "1", "b": "2"}, None), (1, 1, "f", {"a": "1"}, ["a"]), (1, 2, "g", None, []), (1, 3, "h", {"a": "1"}, None), (1, 4, "f", {"a": "2"}, ["a"]), (2, 5, "f", {"a": "1"}, ["a"])], kind + ", compare_args array<string>")
    calls = spark.createDataFrame([(1, 0, "f", {"a": "1"}), (1, 1, "g", {"z": "9"}), (1, 2, "h", None), (1, 3, "f", {"b": "2", "a": "1"}), (1, 4, "f", {"a": "1", "b": "2"})], kind)
    assert {r.no: r.matched for r in selection.match_actions(gold, calls, "k", "no").collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}
    paid = {r.no: r.paid for r in selection.pay_actions(gold.drop("compare_args"), calls, "k", "no").collect()}
    assert paid == {0: 1, 1: None, 2: None, 3: 0, 4: None}  # the second equal call isn't paid again
    assert selection.match_actions(gold.limit(0), calls, "k", "no").count() == 0


def test_differences_tell_null_from_missing(spark):
    a = spark.createDataFrame([(1, "p", "x"), (1, "q", None), (1, "r", None)], "key long, path string, value string")
    b = spark.createDataFrame([(1, "p", "y"), (1, "q", None), (2, "s", None)], "key long, path string, value string")
    got = {(r.key, r.path): (r.expected, r.actual, r.kind) for r in selection.differences(a, b, "key").collect()}
    assert got == {(1, "p"): ("x", "y", "value"), (1, "r"): (None, None, "missing_key"), (2, "s"): (None, None, "missing_key")}


def test_call_credit_keeps_the_mean_and_names_reasons(spark):
    rows = [("g", 0, 3.0, 3.0, 1.0, [1.0, 2.0], True), ("g", 0, 1.0, 1.0, -1.0, [1.0], True), ("g", 0, 0.0, 0.0, 0.0, [], True), ("g", 1, 2.0, 2.0, 0.5, [2.0], False), ("g", 2, 2.0, 2.0, 0.5, [1.0, 1.0], True)]
    df = spark.createDataFrame(rows, "uid string, turn long, reward double, turn_return double, advantage double, call_rewards array<double>, eligible boolean")
    local = {(r.turn, r.reward): r for r in credit.call_credit(df).collect()}
    scale = (14 / 9) ** 0.5 + 1e-6
    assert local[0, 3.0].call_baseline == 1.25 and local[0, 3.0].call_support == 2
    want = [1 + ((q - 1.25) - (3 - 4 / 3)) / scale for q in (1.0, 2.0)]
    assert all(abs(x - y) < 1e-9 for x, y in zip(local[0, 3.0].call_advantages, want))
    assert [local[k].fallback_reason for k in ((0, 0.0), (1, 2.0), (2, 2.0))] == ["no_calls", "attribution_ineligible", "insufficient_turn_support"]
    residual = {(r.turn, r.reward): r for r in credit.call_credit(df, "residual").collect()}
    assert abs(sum(residual[0, 3.0].call_advantages) / 2 - 1.0) < 1e-9 and residual[0, 1.0].fallback_reason == "single_call"
    with pytest.raises(ValueError):
        credit.call_credit(df, "other")


def test_kl_coefficients_and_covariance_losses(spark):
    updates = spark.createDataFrame([("r", 0, 2.0), ("r", 1, 0.0), ("r", 2, 1.1)], "run string, step long, kl double").withColumn("n", F.lit(10))
    args = ("run", "step", "kl", "n", 0.5, 1.0, 100)
    got = [r.coefficient for r in policy.kl_coefficients(updates, *args).orderBy("step").collect()]
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, [0.51, 0.51 * 0.98, 0.51 * 0.98 * 1.01]))
    assert {r.coefficient for r in policy.kl_coefficients(updates, *args, adaptive=False).collect()} == {0.5}
    rows = [("a", 0, -0.1, -0.1, 3.0, 1), ("a", 1, -3.0, -3.1, -1.0, 1), ("b", 0, -0.2, -0.2, 1.0, 1), ("b", 1, -9.0, -1.0, 50.0, 0)]
    tokens = spark.createDataFrame(rows, "row_id string, pos long, logp double, old double, adv double, mask int")
    kl = policy.policy_loss("kl_cov", tokens).first()
    ratio = 2.718281828459045**0.1
    assert abs(kl.loss - (-3.0 + ratio + 0.1 - 1.0) / 3) < 1e-6 and abs(kl.kl - 0.1 / 3) < 1e-6
    clip = policy.policy_loss("clip_cov", tokens, least=3.0).first()  # only the second token lies between the bounds
    assert abs(clip.loss - (-3.0 - 1.0) / 3) < 1e-6 and abs(clip.clip_fraction - 1 / 3) < 1e-6
    with pytest.raises(ValueError):
        policy.policy_loss("kl_cov", tokens, share=0)


def test_small_groups_share_batches(spark):
    """Groups are lists in Arrow batches, not a pandas call each; parts and anchors are those of one walk, and numbers of parts may differ by batch."""
    from tidelane.operators import batches, hooks

    rows = [(b, i, (i * 7 + b) % 11 + 1, [str(i % 3), "x"]) for b in range(5) for i in range(b + 1)]
    df = spark.createDataFrame(rows, "b long, i long, c long, f array<string>")
    greedy, anchors = batches.greedy_partitions(df, "b", "i", "c", 2), hooks.clustered_anchors(df, "b", "i", "f", 0.9)
    tokens = batches.token_batches(df, "b", "i", "c", 11)
    want, heads = {}, {}
    for b in range(5):
        load = [0, 0]
        for _, i, c, _ in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1])):
            want[b, i] = load.index(min(load))
            load[want[b, i]] += c
        heads |= {(b, i): i % 3 for i in range(b + 1)}
    assert {(r.b, r.i): r.part for r in greedy.collect()} == want
    assert {(r.b, r.i): r.anchor for r in anchors.collect()} == heads
    got = {}
    for r in tokens.collect():
        got.setdefault(r.b, set()).add(r.part)
    assert {b: len(p) for b, p in got.items()} == {b: min(b + 1, -(-sum(r[2] for r in rows if r[0] == b) // 11)) for b in range(5)}
    for out in (greedy, anchors, tokens):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("ArrowEvalPython") == 1


def test_connections_against_brute_force(spark, monkeypatch):
    from datetime import date, datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 2, 28)
    place = lambda: rng.choice("abcd") if rng.random() < 0.95 else None
    asks = [(i, place(), place(), date(2024, 2, 28 + rng.randint(0, 1)) if i % 9 else None) for i in range(60)] + [(None, "a", "b", date(2024, 2, 28))]
    legs = [(i, place(), place(), at := start + timedelta(hours=rng.randint(0, 60)), at + timedelta(hours=rng.randint(1, 20))) for i in range(150)]
    legs += [(None, "a", "c", start, start + timedelta(hours=2)), (900, "c", "b", None, start), (901, "a", "c", start, None), (902, "c", "b", start + timedelta(hours=2), start)]
    asks, legs = asks + asks[:5], legs + legs[:5]  # repeated rows are rows
    want = Counter()
    for q, o, d, day in asks:
        for f, a, via, leaves, at in legs:
            if None not in (o, d, day, leaves, at, via) and a == o and leaves.date() == day:
                want.update((q, f, s) for s, b, to, then, _ in legs if then and b == via and to == d and then.date() == at.date() and then >= at)
    assert len(want) > 500 and any(q is None for q, _, _ in want) and any(f is None for _, f, _ in want)
    requests = spark.createDataFrame(asks, "request long, origin string, destination string, day date")
    flights = spark.createDataFrame(legs, "leg long, origin string, destination string, departs timestamp_ntz, arrives timestamp_ntz")
    for most in (32, 2):
        monkeypatch.setattr(selection, "LISTED", most)
        assert Counter(map(tuple, selection.one_stop(requests, flights, parts=8).collect())) == want


def test_connections_of_one_day_are_dealt_out(spark):
    """One class of requests and legs, whose million pairs a join makes in one task."""
    ids = spark.range(100)
    requests = ids.selectExpr("id AS request", "'a' AS origin", "'c' AS destination", "DATE '2024-02-28' AS day")
    hop = "TIMESTAMP_NTZ '2024-02-28 {}:00:00' AS {}"
    legs = ids.selectExpr("id AS leg", "'a' AS origin", "'b' AS destination", hop.format("01", "departs"), hop.format("02", "arrives"))
    legs = legs.union(ids.selectExpr("id + 100 AS leg", "'b' AS origin", "'c' AS destination", hop.format("02", "departs"), hop.format("03", "arrives")))
    out = selection.one_stop(requests, legs)
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(shares) == 1_000_000 and len(shares) > 16 and max(shares) < 100_000
