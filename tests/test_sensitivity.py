"""Correlations of all subsets of components against numpy."""

import itertools
import random

import numpy as np
import pytest

from tidelane.operators.sensitivity import subset_correlations


def test_all_subsets(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, 1.0, -2.5, None]), rng.random() * 1e6, 3.0, rng.choice([0.0, 1.0, None]), rng.choice([True, False, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, ok boolean")
    got = {(r.rows, tuple(r.subset)): r for r in subset_correlations(df, ["a", "b", "c"], "y", "ok").collect()}
    assert len(got) == 14
    for kind in ("recorded", "scored"):
        some = [r for r in rows if r[3] is not None and (kind == "recorded" or r[4])]
        y = np.array([r[3] for r in some])
        for size in (1, 2, 3):
            for own in itertools.combinations(range(3), size):
                x = np.array([sum(r[i] or 0.0 for i in own) for r in some])
                r = got[kind, tuple("abc"[i] for i in own)]
                assert (r.n, r.successes) == (len(some), y.sum()) and np.isclose(r.mean, x.mean()) and np.isclose(r.deviation, x.std(), atol=1e-6)
                assert r.correlation is None if x.std() == 0 else np.isclose(r.correlation, np.corrcoef(x, y)[0, 1])
    none = subset_correlations(df.limit(0), ["a", "b"], "y").collect()
    assert [(r.rows, r.n, r.correlation) for r in none] == [("recorded", 0, None)] * 3
    with pytest.raises(ValueError, match="different components"):
        subset_correlations(df, ["a", "a"], "y")
