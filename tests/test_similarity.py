"""Similarity joins and best matches against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import similarity as S


def norm(text):
    return " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in (text or "").lower()).split())


def likeness(x, y):
    a, b = set(x.split()), set(y.split())
    return 1.0 if x == y else max(len(a & b) / len(a | b), difflib.SequenceMatcher(None, x, y).ratio())


def texts_of(rng, n):
    words = ["".join(rng.choices("abcde1", k=rng.randint(1, 7))) for _ in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(n // 3)]
    while len(out) < n:
        t = list(rng.choice(out))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 2)] = rng.choices("abcde f1", k=rng.randint(0, 2))
        out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.88, 0.95, 1.0])
def test_similar_texts_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    a, b = ({norm(t) for t in texts_of(rng, 130)} - {""} for _ in range(2))
    b |= set(list(a)[:20])
    some = list(a)
    b |= {norm(t + " x") for t in some[20:40]} | {norm(" ".join(reversed(t.split()))) for t in some[40:60]}
    frame = lambda x: spark.createDataFrame([(t,) for t in sorted(x)], "said string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in S.similar_texts(frame(a), frame(b), threshold).collect()}
    want = {(x, y): round(s, 9) for x in a for y in b if (s := likeness(x, y)) >= threshold}
    assert got == want and len(want) >= 20


def test_plan_has_no_cross_join(spark):
    frame = spark.createDataFrame([("a b c",)], "said string")
    plan = S.similar_texts(frame, frame, 0.88)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError, match="threshold"):
        S.similar_texts(frame, frame, 0.0)


def test_closest_takes_the_first_of_ties(spark):
    blocked = spark.createDataFrame([(2, "the same words"), (1, "The same words!"), (3, "words same the"), (4, None), (5, "")], "place long, text string")
    rows = [(1, "the same words"), (1, "the same words"), (2, "same the words"), (3, None), (4, "!"), (None, "the same words")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(((r.id, r.blocked, r.similarity) for r in S.closest_texts(df, "text", blocked, "id", 0.9, order="place").collect()), key=str)
    assert got == sorted([(1, "The same words!", 1.0), (1, "The same words!", 1.0), (2, "The same words!", 1.0), (None, "The same words!", 1.0)], key=str)
    assert S.closest_texts(df.limit(0), "text", blocked, "id").count() == S.closest_texts(df, "text", blocked.limit(0), "id").count() == 0


@pytest.mark.parametrize("lexical", [False, True])
def test_best_matches_are_those_of_all_pairs(spark, lexical):
    rng = random.Random(3)
    reasons = [norm(t) for t in texts_of(rng, 30)]
    row = lambda k: (k, rng.choice(reasons) if rng.random() < 0.9 else None, rng.sample("abcdefgh", rng.randint(0, 3)), rng.choices("xyz", k=rng.randint(0, 2)), rng.random() < 0.7)
    left, right = [row(k) for k in range(80)], [row(k) for k in range(60)]
    left += [(90, "nothing like it", ["q"], [], True), (91, None, None, ["x"], True)]
    schema = "k long, reason string, tags array<string>, actions array<string>, ok boolean"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("k", "other")
    got = {r.k: tuple(r)[1:] for r in S.best_matches(a, b, "k", "other", lexical=lexical, eligible="ok").collect()}
    for k, reason, tags, actions, _ in left:
        best = None
        for o, reason_, tags_, actions_, ok in right:
            s, t = set(tags or []), set(tags_ or [])
            exact = reason is not None and reason == reason_
            if ok and (exact or s & t):
                like = difflib.SequenceMatcher(None, reason, reason_).ratio() if reason is not None and reason_ is not None else None
                mine = (exact, len(s & t) / len(s | t) if s | t else 0.0, sorted(actions) == sorted(actions_), *([like] if lexical else []))
                rank = (tuple(-1.0 if x is None else x for x in mine), -o)
                best = max(best, (rank, o, mine)) if best else (rank, o, mine)
        want = (best[1], *best[2]) if best else (None,) * (5 if lexical else 4)
        assert tuple(round(x, 9) if isinstance(x, float) else x for x in got[k]) == tuple(round(x, 9) if isinstance(x, float) else x for x in want), k


def test_best_matches_compare_kinds_of_rows(spark):
    """Rows alike in reason, tags and actions are one; ten thousand million pairs of rows would not end."""
    kind = lambda i: (None if i % 3 == 0 else "said", {"t"} if i % 3 != 1 else set(), None if i % 5 == 0 else "x")
    frame = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "IF(id % 3 = 0, NULL, 'said') AS reason", "IF(id % 3 = 1, NULL, array('t')) AS tags", "IF(id % 5 = 0, NULL, array('x')) AS actions")
    want = {}
    for i in range(15):
        (reason, tags, act), found = kind(i), []
        for j in range(15):
            reason_, tags_, act_ = kind(j)
            exact = reason is not None and reason == reason_
            if exact or tags & tags_:
                found.append((not exact, -(len(tags & tags_) / max(1, len(tags | tags_))), not (act is not None and act == act_), j))
        first = min(found)
        want[i] = (first[3], not first[0], -first[1], not first[2])
    got = S.best_matches(frame(100_000, "k"), frame(100_000, "other"), "k", "other").groupBy((F.col("k") % 15).alias("i"), "other", "exact", "jaccard", "same").count().collect()
    assert {r.i: (r.other, r.exact, r.jaccard, r.same) for r in got} == want and len(got) == 15 and sum(r["count"] for r in got) == 100_000


def test_common_characters_bound_the_ratio():
    from tidelane.functions.documents import common_characters, matching_blocks_ratio

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        return row[-1]

    rng = random.Random(8)
    for a, b in zip(texts_of(rng, 60), texts_of(rng, 60)):
        assert common_characters(a, b) == plain(a, b) >= matching_blocks_ratio(a, b) * (len(a) + len(b)) / 2 - 1e-9


def test_runs_at_other_places_are_no_candidates(spark):
    """Texts made of the same long words in another order share runs, but far from their places."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(30)]
    turned = [" ".join(words[k:] + words[:k]) for k in (0, 1, 2, 10, 11, 12, 13)]
    near = turned[0][:100] + "x" + turned[0][100:]
    frame = spark.createDataFrame([("a", i, t) for i, t in enumerate(turned[:3])] + [("b", i, t) for i, t in enumerate([*turned[3:], near])], "side string, id long, said string")
    assert {tuple(r) for r in S._by_runs(frame, 0.95, 8, 64.0, float("inf")).collect()} >= {(0, 4)}
    assert not {r.b for r in S._by_runs(frame, 0.95, 8, 64.0, float("inf")).collect()} & {0, 1, 2, 3}


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_likeness_is_that_of_all_pairs_in_any_batches(threshold, monkeypatch):
    """Long texts, few at once, and batches that end within a band or a side; texts of b come first in each."""
    import pyarrow as pa

    from tidelane.functions import likeness as L

    rng = random.Random(5)
    base = [" ".join(norm("".join(rng.choices("abcdefgh1", k=rng.randint(2, 8)))) for _ in range(n)) for n in (3, 6, 60, 250)]
    near = lambda t: norm("".join(c if rng.random() > 0.015 else rng.choice(["", "x", c + "y"]) for c in t))
    mine, theirs = [near(t) for t in base * 3], [near(t) for t in base * 4] + base
    assert max(map(len, mine)) > L.LONGEST
    monkeypatch.setattr(L, "CHARACTERS", 700)
    monkeypatch.setattr(L, "PAIRS", 16)
    monkeypatch.setattr(L, "LOT", 5)
    monkeypatch.setattr(L, "FEW", 2)
    rows = [(band, side, t) for band in (4, 7, 9) for side, texts in ((False, theirs), (True, mine)) for t in texts if (band, side) != (7, False)]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.string()))]
    whole = pa.RecordBatch.from_arrays(columns, ["band", "mine", "said"])
    batches = [whole.slice(k, 7) for k in range(0, len(rows), 7)]
    got = sorted(r for x in L.banded(threshold)(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns)))
    want = sorted((x, y, s) for x in mine for y in theirs if x != y and (s := difflib.SequenceMatcher(None, x, y).ratio()) >= threshold)
    assert got == sorted(want * 2) and len(want) >= 5


def test_texts_are_not_sent_as_runs(spark):
    """closest_lines: a row for each place of a text took several times the texts' bytes on disk."""
    said = [f"{'abcdefgh'[i % 8]}{i} and then {i * 7919} of them were seen near the {i * 31} mills" for i in range(300)]
    a, b = spark.createDataFrame([(t,) for t in said], "said string"), spark.createDataFrame([(t + " again",) for t in said[::10]], "said string")
    plan = S.similar_texts(a, b, 0.9)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
    assert {(r.a, r.b) for r in S.similar_texts(a, b, 0.9).collect()} == {(x, y) for x in said for y in (t + " again" for t in said[::10]) if likeness(x, y) >= 0.9}


def test_words_are_met_by_classes(spark):
    """Sets of words at the very threshold, of sizes about the steps of classes, in any order and with repeated words."""
    pairs, threshold = [], 0.8
    for n in [*range(1, 14), 31, 32, 33, 34, 40, 63, 64, 100, 101]:
        words = [f"w{n}x{k}" for k in range(n)]
        most = int((1 - threshold) / threshold * n + 1e-9)  # so many more words, and the pair is at the threshold
        more = words + [f"v{n}x{k}" for k in range(most)]
        pairs.append((" ".join(words), " ".join(reversed(more + words[:2]))))
    found = {}
    for flip in (False, True):
        x, y = (spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "i long, said string").withColumn("id", F.xxhash64("said")) for k in ((1, 0) if flip else (0, 1)))
        met = S._by_classes(x, y, threshold)
        found[flip] = met.join(x, met.a == x.id).select("i", "b").join(y.drop("i"), F.col("b") == y.id).select("i").distinct().count()
    assert found == {False: len(pairs), True: len(pairs)}


def test_common_lengths_of_many_pairs_at_once():
    """closest_reasons: pairs were taken one by one."""
    import numpy as np
    import pyarrow as pa

    from tidelane.functions.documents import common_characters
    from tidelane.functions.likeness import Counted, common_lengths

    rng = random.Random(11)
    a, b = ([norm(t) or "a" for t in texts_of(rng, 40)] + ["".join(rng.choices("ab 1z", k=n)) for n in (51, 52, 53, 104, 105, 300)] for _ in range(2))
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    got = common_lengths(Counted([pa.array(a[:9]), pa.array(a)[9:]]), i, Counted([pa.array(b)]), j)
    want = [common_characters(a[p], b[q]) for p, q in zip(i, j)]
    assert got.tolist() == want
    for least in (0.5, 0.8, 0.95):
        asked = np.array([least * (len(a[p]) + len(b[q])) for p, q in zip(i, j)])
        some = common_lengths(Counted([pa.array(a)]), i, Counted([pa.array(b)]), j, asked)
        assert [x for x, y in zip(some, asked) if 2 * x >= y] == [x for x, y in zip(want, asked) if 2 * x >= y]
        assert all(x in (0, w) for x, w in zip(some, want)) and 0 in some
