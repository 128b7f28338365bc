"""Spelling variants and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import docs_of
from tidelane.llm import resample, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, n, len(close), words.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def test_spelling_variants(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcdeéÀß×ÿ", k=rng.randint(6, 11))) for _ in range(60)]
    bag = []
    for stem in stems:
        bag += [stem] * rng.choice([2, 30, 400])
        for _ in range(6):
            k = rng.randrange(len(stem))
            bag += [rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + "e" + stem[k:], stem[:k] + "a" + stem[k + 1 :], stem.upper(), stem.title()])] * rng.choice([1, 2, 5, 40])
    bag += ["aaaaaaaa"] * 6000 + ["aaaaaaab"] * 300 + ["aaaaaabb"] * 10 + ["abababab"] * 3 + ["ababababa"] * 3
    rng.shuffle(bag)
    texts = [rng.choice([" ", "1", "-", "\n"]).join(bag[k : k + 40]) for k in range(0, len(bag), 40)]
    rows = [*enumerate(texts), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, None), (5, ""), (6, "abcdefgh" * 60_000), (7, "wordone " * 100_000)]
    docs = docs_of(spark, rows)
    for name in ("word", "n", "mask", "size"):
        docs = docs.withColumn(name, F.lit(name))
    want = brute_variants(rows)
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in spelling.spelling_variants(docs).collect()}
    assert got == want and sum(x[0] is not None for x in want.values()) > 50
    assert want["aaaaaabb"][4] == "aaaaaaaa"  # over two steps
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "some words and averyveryverylongword éÀÿ1x" * 3
    pieces = list(spelling._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 5
    find = lambda t: re.findall("[A-Za-zÀ-ÿ]+", t)
    assert [w for p in pieces for w in find(p)] == find(text)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute_resample(rows, target, percent=25, n=2):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(f.encode()) % 10000 for f in grams(text, n)[0])
    for text in target:
        t.update(zlib.crc32(f.encode()) % 10000 for f in grams(text, n)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out, may = [], []
    for i, text in rows:
        f, n_words = grams(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
        if n_words >= 20:
            may.append(len(out) - 1)
    may.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, out[k][1], out[k][2]))
    rank = {k: place + 1 for place, k in enumerate(may[: percent * len(may) // 100])}
    return Counter((*x, rank.get(k)) for k, x in enumerate(out))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_importance_resample(spark, n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdeéßZ9", k=rng.randint(1, 9))) for _ in range(800)] + ["x" * 300]
    rows = [(i, rng.choice([" ", "\n", ", ", "_"]).join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 200])))) for i in range(200)]
    rows += [(None, None), (None, rows[9][1]), (None, rows[9][1]), (300, ""), (5, rows[5][1]), (5, rows[5][1]), (6, rows[7][1]), (301, "word and words " * 12_000), (302, "w" * 70_000 + " é" * 50_000), (303, " . " * 40_000), (304, rows[50][1] * 60)]
    target = [" ".join(rng.choices(vocabulary[:200], k=60)) for _ in range(20)] + [None, ""]
    docs = docs_of(spark, rows)
    for name in ("row", "own", "weight", "score", "rank"):
        docs = docs.withColumn(name, F.lit(name))
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in resample.importance_resample(docs, items, n=n).collect())
    assert got == brute_resample(rows, target, n=n)


def test_resample_without_rows_or_target(spark):
    docs = docs_of(spark, [(i, f"words of text number {i} " * 6) for i in range(9)])
    items = spark.createDataFrame([], "text string")
    assert resample.importance_resample(docs.limit(0), items).count() == 0
    assert sorted(r.rank for r in resample.importance_resample(docs, items, percent=50).collect() if r.rank) == [1, 2, 3, 4]
    drawn = resample.resampled(docs, items, percent=100)
    assert drawn.count() == 9 and set(docs.columns) < set(drawn.columns)


def test_chunks_carry_and_own():
    rng = random.Random(3)
    for n in (1, 2, 4):
        for _ in range(40):
            text = "".join(rng.choices("ab é.", k=rng.randint(0, 300))).encode()
            offsets = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            parts = list(resample.chunks(text, n, 20))
            assert b"".join(p[:own] for p, own in parts) == text
            data, at = np.frombuffer(b"".join(p for p, _ in parts), np.uint8), offsets([p for p, _ in parts])
            got = Counter(int(c) for _, crc in resample.features(data, at, np.array([own for _, own in parts], np.int64), n) for c in crc)
            assert got == Counter(zlib.crc32(g.encode()) for g in grams(text.decode(), n)[0])
