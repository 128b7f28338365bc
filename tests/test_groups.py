"""Whole groups: completeness, dealing and replayed estimates."""

import numpy as np
import pytest

from tidelane.operators import groups as G


def test_groups_stay_whole(spark):
    uids = ["b", "a", "b", "c", "a", "c", None, None]
    df = spark.createDataFrame(list(enumerate(uids)), "k long, uid string")
    got = {r.k: (r.group, r.member, r.worker, r.slot) for r in G.deal_groups(df, "uid", "k", 2, 3).collect()}
    assert got == {0: (0, 0, 0, 0), 2: (0, 1, 0, 1), 1: (1, 0, 1, 0), 4: (1, 1, 1, 1), 3: (2, 0, 2, 0), 5: (2, 1, 2, 1), 6: (3, 0, 0, 2), 7: (3, 1, 0, 3)}
    with pytest.raises(Exception, match="hasn't 3 rows"):
        G.complete_groups(df, "uid", "k", 3).collect()
    assert G.deal_groups(df.limit(0), "uid", "k", 2, 3).count() == 0
    for size, workers in ((0, 1), (2, 0)):
        with pytest.raises(ValueError):
            G.deal_groups(df, "uid", "k", size, workers)


def test_replay_names_each_difference(spark):
    rewards = [1.0, 0.0, 0.0, 3.0]
    v = (np.array(rewards) - 1) / (np.std(rewards, ddof=1) + 1e-6)
    kind = "uid string, k long, reward double, response_mask array<int>, advantages array<double>"
    rows = [("g", 0, 1.0, [1, 0], [float(v[0]), 0.0]), ("g", 1, 0.0, [1, 1], [float(v[1]), 0.5]), ("g", 2, 0.0, [1], None), ("g", 3, 3.0, [], [9.0])]
    got = {r.k: r for r in G.replay_estimates(spark.createDataFrame(rows, kind), "uid", "k", 4).collect()}
    assert np.allclose([got[k].value for k in range(4)], v) and got[0].differences == []
    assert [(d.position, d.saved, d.again is None) for d in got[1].differences] == [(1, 0.5, False)]
    assert [(d.position, d.saved) for d in got[2].differences] == [(0, None)] and [(d.position, d.saved, d.again) for d in got[3].differences] == [(0, 9.0, None)]
    for bad, said in (((None, [1]), "finite"), ((float("nan"), [1]), "finite"), ((1.0, [2]), "binary"), ((1.0, None), "binary")):
        with pytest.raises(Exception, match=said):
            G.replay_estimates(spark.createDataFrame([("g", 0, *bad, None), ("g", 1, 0.0, [1], None)], kind), "uid", "k", 2).collect()
