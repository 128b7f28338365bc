"""Turn and token credit, policy losses, audits: hand-made cases and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import audits, credit, estimators, policy


def test_turn_credit_and_spans(spark):
    rows = spark.createDataFrame([("g", 0, 1.0, [1.0, 2.0]), ("g", 1, 0.0, [0.0, 0.0]), ("g", 2, 5.0, [])], "uid string, row_id long, outcome double, turn_rewards array<double>")
    got = {(r.row_id, r.turn): r for r in credit.turn_credit(rows, gamma=0.5).collect()}
    assert sorted(got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [got[0, k].turn_return for k in (0, 1)] == [2.25, 2.5]
    assert abs(got[0, 0].episode - 0.999998) < 1e-7 and abs(got[1, 1].episode + 0.999998) < 1e-7
    spans = spark.sql("SELECT 4 AS n, array(named_struct('start', 0, 'end', 2), named_struct('start', 3, 'end', 4)) AS spans, array(2.25D, 2.5D) AS v")
    assert spans.select(credit.on_spans(F.col("n"), "spans", "v").alias("x")).first().x == [2.25, 2.25, 0.0, 2.5]


def test_token_baseline_of_one_and_compacted(spark):
    rows = [("a", 1, p, 1.0, m, 0.5) for p, m in enumerate([1, 0, 1])] + [("b", 2, 0, 2.0, 1, 0.5), ("b", 3, 0, 4.0, 1, 0.5)]
    tokens = spark.createDataFrame(rows, "uid string, row_id long, pos long, reward double, mask int, energy double")
    got = {(r.row_id, r.pos): r.advantage for r in credit.token_baseline(tokens, zero_tail=True).collect()}
    assert got[1, 0] == 2 and got[1, 1] == 0 and got[1, 2] == 1  # alone: no baseline
    assert abs(got[2, 0] + 1) < 1e-6 and abs(got[3, 0] - 1) < 1e-6
    assert sorted((r.row_id, r.pos) for r in credit.compact(tokens).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]


def test_whitened_values_have_mean_0_and_deviation_1(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.random(), rng.randint(0, 3)) for _ in range(200)], "v double, w int")
    x = np.array([(r.advantage, r.w) for r in estimators.whiten(df, "v", "w").collect()])
    mean = (x[:, 0] * x[:, 1]).sum() / x[:, 1].sum()
    assert abs(mean) < 1e-9 and abs((x[:, 0] ** 2 * x[:, 1]).sum() / (x[:, 1].sum() - 1) - 1) < 1e-6


def test_unknown_names_and_settings(spark):
    df = spark.createDataFrame([(1, -0.1, -0.2, 1.0, 1)], "row_id long, logp double, old double, adv double, mask int")
    for bad in (lambda: policy.policy_loss("nothing", df), lambda: policy.importance_weights(df, "page"), lambda: policy.importance_weights(df, threshold=0), lambda: policy.register("gpg")(lambda: None)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        audits.fraction_split(df, "row_id", 0.5, 1)
    with pytest.raises(ValueError):
        audits.cyclic_schedule(df.limit(0), "row_id", 1, 2, 2)


def test_losses_ignore_masked_tokens(spark):
    rows = [(1, -0.1, -0.3, 1.0, 1), (1, -9.0, -0.1, 5.0, 0), (2, -0.5, -0.2, -1.0, 1)]
    df = spark.createDataFrame(rows, "row_id long, logp double, old double, adv double, mask int")
    for name in [*policy.LOSSES, "geo_mean"]:
        a, b = policy.policy_loss(name, df).first(), policy.policy_loss(name, df.filter("mask = 1")).first()
        assert a.loss == pytest.approx(b.loss) and a.kl == pytest.approx(b.kl), name


def test_streak_restarts_at_a_gap(spark):
    steps = spark.createDataFrame([("x", s, v) for s, v in [(1, 9), (2, 9), (4, 9), (5, 9), (6, 9), (7, 0), (8, None)]], "arm string, step long, v int")
    got = {r.step: (r.streak, r.halt) for r in audits.breach_streaks(steps, F.col("v") > 5, 3).collect()}
    assert got == {1: (1, False), 2: (2, False), 4: (1, False), 5: (2, False), 6: (3, True), 7: (0, False), 8: (0, False)}


def test_mask_runs_round_trip(spark):
    masks = [[], [0], [1], [1, 1, 0, 1], [0, 1, 1], [1, 0, 0, 1, 1, 1]]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(masks)], "k long, mask array<int>").withColumn("runs", audits.mask_runs("mask"))
    got = {r.k: r for r in df.withColumn("back", audits.restore_mask("runs", "size(mask)")).collect()}
    assert all(got[k].back == m for k, m in enumerate(masks))
    assert [tuple(x) for x in got[3].runs] == [(0, 2), (3, 4)]


def test_validation_metrics_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(s, f"{s}{u}", k, rng.random(), rng.choice("AB")) for s in "xy" for u in range(3) for k in range(5 if u else 1)]
    df = spark.createDataFrame(rows, "source string, uid string, k long, v double, pred string")
    got = {(r.source, r.metric): r.value for r in audits.validation_metrics(df, "source", "uid", "v", "k", "pred", resamples=50, seed=7).collect()}
    want: dict = {}
    for uid in {r[1] for r in rows}:
        own = [(r[3], r[4]) for r in rows if r[1] == uid]
        n, values = len(own), np.array([v for v, _ in own])
        out = {f"mean@{n}": values.mean()} | ({f"std@{n}": values.std()} if n > 1 else {})
        for size in ([2, 4, 5] if n == 5 else []):
            draws = np.random.RandomState(7).choice(n, (50, size))
            maj = []
            for d in draws:
                votes = Counter(own[i][1] for i in d)
                top = max(votes, key=votes.get)
                maj.append(next(own[i][0] for i in d if own[i][1] == top))
            for name, x in (("best", values[draws].max(1)), ("worst", values[draws].min(1)), ("maj", np.array(maj))):
                out |= {f"{name}@{size}/mean": x.mean(), f"{name}@{size}/std": x.std()}
        for k, v in out.items():
            want.setdefault((uid[0], k), []).append(v)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())


def test_validation_metrics_resample_uids_together(spark):
    """Uids with equally many responses are one array, so that draws are made once a length and not once a uid."""
    df = spark.range(4000).selectExpr("'s' AS source", "id % 1000 AS uid", "id AS k", "cast(id % 97 AS double) AS v", "cast(id % 3 AS string) AS pred")
    plan = audits.validation_metrics(df, "source", "uid", "v", "k", "pred", resamples=20, seed=7)
    assert "MapInPandas" in plan._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    values, votes = np.random.RandomState(1).rand(30, 6), np.random.RandomState(2).randint(0, 3, (30, 6))
    whole = audits.resampled(values, votes, 4, 50, 7)
    for i in range(30):
        one = audits.resampled(values[i : i + 1], votes[i : i + 1], 4, 50, 7)
        assert all(one[k][0] == whole[k][i] for k in whole) and len(whole) == 6


def test_bootstrap_reduces_all_resamples_at_once(monkeypatch):
    from tidelane.operators import training

    drawn = np.random.RandomState(3).rand(200, 7)
    want = {n: np.apply_along_axis(f, 1, drawn) for n, f in training.REDUCERS.items()} | {"first": drawn[:, 0]}
    assert np.array_equal(training._reduced(lambda x: x[0], drawn), want["first"])
    monkeypatch.setattr(np, "apply_along_axis", None)
    assert all(np.array_equal(training._reduced(f, drawn), want[n]) for n, f in training.REDUCERS.items())
