"""Greedy choices from pools of any size against one loop over all rows."""

import hashlib
import random
from collections import Counter

import pytest

from tidelane.functions.documents import matching_blocks_ratio
from tidelane.operators import curation


def hashed(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def chosen(df, key="id"):
    return [r[key] for r in df.orderBy("place").collect()]


@pytest.mark.parametrize("most", [5, 1000])
def test_greedy_choices_of_large_pools(spark, monkeypatch, most):
    monkeypatch.setattr(curation, "MOST_POOL", most)
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.randint(0, 1), rng.sample(["u", "v", "w", "x"], rng.randint(0, 2)), float(rng.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, category string, stratum int, entities array<string>, merit double")
    pool, want, cats, strata, used = list(rows), [], Counter(), Counter(), Counter()
    while len(want) < 12:
        r = min(pool, key=lambda r: (cats[r[1]], strata[r[1:3]], sum(used[e] for e in r[3]), -r[4], hashed(42, r[0])))
        pool.remove(r)
        want.append(r[0])
        cats[r[1]] += 1
        strata[r[1:3]] += 1
        used.update(r[3])
    assert chosen(curation.balanced_selection(df, "id", 12, 42)) == want
    has = Counter(t for r in rows for t in r[3])
    for goals in (None, {"a": 3, "b": 1}):
        pool, want, seen, cats = list(rows), [], Counter(), Counter()

        def rank(r):
            own = sorted(r[3])
            lacks = sum(1 / has[t] for t in own if seen[t] < min(2, has[t]) and (goals is None or seen[t]))
            unseen = sum(1 / has[t] for t in own if not seen[t]) if goals else 0
            need = max(0, goals.get(r[1], 0) - cats[r[1]]) / max(1, goals.get(r[1], 0)) if goals else 0
            return -unseen, -need, -lacks, hashed(7, r[0])

        while len(want) < 8:
            r = min(pool, key=rank)
            pool.remove(r)
            want.append(r[0])
            seen.update(r[3])
            cats[r[1]] += 1
        assert chosen(curation.covering_selection(df, "id", 8, 7, tools="entities", least=2, goals=goals)) == want
    assert len(chosen(curation.balanced_selection(df.limit(3), "id", 9, 1))) == 3
    assert chosen(curation.balanced_selection(df, "id", 0, 1)) == chosen(curation.balanced_selection(df.limit(0), "id", 4, 1)) == []


@pytest.mark.parametrize("step", [3, 1000])
def test_diverse_selection_of_large_pools(spark, monkeypatch, step):
    monkeypatch.setattr(curation, "MOST_POOL", 5)
    monkeypatch.setattr(curation, "STEP", step)
    rng = random.Random(9)
    words = ["aa", "bb", "cc", "dd", "ee"]
    rows = [(i, rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 3))), "aa bb", "aa bb cc", "", None] if i > 40 else ["aa bb cc dd", "aa bb"])) for i in range(120)]
    rows += [rows[50], rows[51]]
    df = spark.createDataFrame(rows, "id long, reason string")
    for size, cap, threshold in ((2, 1, 0.6), (500, 2, 0.6), (500, 3, 0.75), (500, 1, 0.95), (5, 0, 0.5)):
        buckets, want = [], []
        for k, text in sorted(rows, key=lambda r: hashed(3, r[0])) if cap else []:
            text, best = text or "", (threshold, None)
            for i, (other, _) in enumerate(buckets):
                if text and other:
                    a, b = set(text.split()), set(other.split())
                    score = 1.0 if text == other else max(len(a & b) / len(a | b), matching_blocks_ratio(text, other))
                    if score > best[0] or score == best[0] and best[1] is None:
                        best = (score, i)
            if best[1] is None:
                buckets.append([text, 0])
                best = (0, len(buckets) - 1)
            if buckets[best[1]][1] < cap:
                buckets[best[1]][1] += 1
                want.append((k, len(want), best[1]))
                if len(want) == size:
                    break
        got = curation.diverse_selection(df, "id", "reason", 3, size, threshold, cap).orderBy("place").collect()
        assert list(map(tuple, got)) == want, (size, cap, threshold)
