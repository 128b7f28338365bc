"""Replay of actions against a walk over dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import replay as R

TOOLS = {
    "take": R.Tool(lambda s, a: s["stock"] >= a["n"], lambda s, a: {"stock": s["stock"] - a["n"]}),
    "note": R.Tool(effect=lambda s, a: {"note": a["text"]}),
    "drop": R.Tool(deletes=True),
    "make": R.Tool(effect=lambda s, a: {"stock": a["n"]}, creates=True),
}
STATE, ACTIONS = "entity string, stock long, note string", "run string, step long, name string, entity string, n long, text string"


def walk(state, actions):
    db, out = {k: [s, t] for k, s, t in state}, []
    for _, step, name, entity, n, text in sorted(actions, key=lambda a: a[1]):
        row = db.get(entity)
        if name == "take" and row and row[0] is not None and n is not None and row[0] >= n:
            row[0] -= n
        elif name == "note" and row:
            row[1] = text
        elif name == "drop" and row:
            del db[entity]
        elif name == "make" and not row and entity is not None:
            db[entity] = [n, None]
        else:
            out.append((entity, step))
    return {k: tuple(v) for k, v in db.items()}, out


def test_replay_is_the_walk(spark):
    rng = random.Random(6)
    state = [("a", 5, None), ("b", 0, "x"), ("c", None, None)]
    draw = lambda r: [(f"r{r}", s, rng.choice([*TOOLS, "take", "take", "other"]), rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 3, None]), rng.choice(["x", "y", None])) for s in range(rng.randint(0, 9))]
    ours, gold = [draw(r) for r in range(80)], [draw(r) for r in range(80)]
    for r in range(0, 80, 3):
        gold[r] = list(ours[r])
    frame = lambda rows: spark.createDataFrame([a for x in rows for a in x], ACTIONS)
    base = spark.createDataFrame(state, STATE)
    done = R.replayed(base, frame(ours), TOOLS).collect()
    walks = [walk(state, x) for x in ours]
    for r in done:
        db, failed = walks[int(r.run[1:])]
        assert (tuple(r.after) if r.after else None) == db.get(r.entity)
        assert sorted(r.failed) == sorted(s for e, s in failed if e == r.entity)
    assert len(done) == sum(len({a[3] for a in x}) for x in ours)
    got = {r.run: r for r in R.compared_runs(base, frame(ours), frame(gold), TOOLS).collect()}
    equal = 0
    for k, (mine, theirs) in enumerate(zip(walks, [walk(state, x) for x in gold])):
        if not ours[k] and not gold[k]:
            continue
        r = got[f"r{k}"]
        differing = sorted(e for e in mine[0].keys() | theirs[0].keys() if mine[0].get(e) != theirs[0].get(e))
        assert r.differing == differing and r.equal == (not differing) and r.reward == float(not differing)
        assert (r.failed, r.gold_failed) == (len(mine[1]), len(theirs[1]))
        equal += r.equal
    assert 26 <= equal < 80


def test_hashes_tell_states_apart(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], STATE)
    same = lambda df: R.base_hash(df).first()
    assert same(base) == same(base.orderBy(F.desc("entity"))) and same(base).entities == 2
    assert same(base).hash != same(base.withColumn("note", F.coalesce("note", F.lit("")))).hash != same(base.limit(0)).hash
    act = lambda *rows: spark.createDataFrame(rows, ACTIONS)
    runs = spark.createDataFrame([("p",), ("q",), ("none",)], "run string")
    done = R.replayed(base, act(("p", 0, "note", "a", 0, "x"), ("p", 1, "note", "a", 0, None), ("q", 0, "note", "b", 0, None)), TOOLS)
    by = {r.run: (r.state, r.changed) for r in R.state_hashes(runs, done).collect()}
    assert by["p"] == by["none"] and by["p"][1] == 0 and by["q"][1] == 1 and by["q"][0] != by["p"][0]
    assert R.replayed(base, act(("p", 0, "note", "a", 0, "x")).limit(0), TOOLS).count() == 0
    with pytest.raises(ValueError, match="don't have"):
        R.replayed(base, act(("p", 0, "note", "a", 0, "x")), {"note": R.Tool(effect=lambda s, a: {"other": a["n"]})})


def test_both_sides_are_folded_together(spark, sf_dir):
    """One fold for both sides: what shuffles is the numbering of each side's steps, which are equal and done once."""
    from tidelane.plans import replays

    plan = replays.QUERIES["replayed_runs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan
    base = spark.createDataFrame([("a", 5, None)], STATE)
    ours = spark.createDataFrame([("r", 1, "take", "a", 2, None), (None, 1, "take", "a", 1, None), ("only", 1, "take", None, 1, None)], ACTIONS)
    gold = spark.createDataFrame([("r", 1, "take", "a", 2, None), ("r", 2, "take", "a", 9, None), ("new", 1, "drop", "a", None, None)], ACTIONS)
    got = {r.run: tuple(r)[1:] for r in R.compared_runs(base, ours, gold, TOOLS).collect()}
    assert got == {"r": (True, 1.0, 0, 1, []), "only": (True, 1.0, 1, 0, []), "new": (False, 0.0, 0, 0, ["a"])}
