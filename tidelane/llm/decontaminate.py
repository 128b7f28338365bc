"""Operator 2: benchmark decontamination by SimHash windows. DataFrame functions only.

Windows as long as an item stand at every word of a document. A window whose shingles have
a weighted similarity of THRESHOLD with an item shares so many shingles with it that it can
be told, before any fingerprint is made, which windows can't: those that hold too few
shingles of items of that length, wherever in the window and in the item they stand. All
other windows, and the items, get 64-bit SimHash fingerprints, whose BLOCKS blocks are the
join keys. Fingerprints within RADIUS differ in FLIPS bits at most in one block or more, and
an item is in the index under every such value of each block, so the join finds all of
them. Pairs within RADIUS are verified on their weighted shingles.
"""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import cut, small, table

WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits, with a deviation of 2.9.
RADIUS = 20
#: Bits that a block may differ in; of so many blocks, one is within that where all are within RADIUS.
FLIPS = 2
BLOCKS = RADIUS // (FLIPS + 1) + 1
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def words_of(text: str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str) -> Column:
    """A hash of every run of five words, in order and with repeats."""
    return F.expr(f"CASE WHEN size({words}) >= {WORDS} THEN transform(sequence(1, size({words}) - {WORDS - 1}), i -> xxhash64(slice({words}, i, {WORDS}))) ELSE array() END")


def simhash(shingles: str) -> Column:
    """64 bits; each is set where more than half of the shingles, by weight, have it set. It is
    never null, and says so: else Spark computes it once more, to filter nulls before joins."""
    bits = F.expr(
        f"aggregate(sequence(0, 63), 0L, (fp, b) -> fp | CASE WHEN 2 * size(filter({shingles}, h -> (shiftrightunsigned(h, b) & 1L) = 1L)) > size({shingles}) THEN shiftleft(1L, b) ELSE 0L END)"
    )
    return F.coalesce(bits, F.lit(0).cast("long"))


def blocks_of(fp: str) -> Column:
    """BLOCKS runs of bits that together are the fingerprint."""
    return F.array(*(F.expr(f"shiftrightunsigned({fp}, {lo}) & {2 ** (hi - lo) - 1}L") for lo, hi in pairwise(EDGES)))


def probes_of(fp: str) -> Column:
    """For each block, every value that differs from it in FLIPS bits or fewer."""
    flips = [[sum(1 << b for b in some) for n in range(FLIPS + 1) for some in combinations(range(hi - lo), n)] for lo, hi in pairwise(EDGES)]
    return F.array(*(F.expr(f"transform(array({', '.join(f'{x}L' for x in own)}), x -> x ^ shiftrightunsigned({fp}, {lo}) & {2 ** (hi - lo) - 1}L)") for own, (lo, hi) in zip(flips, pairwise(EDGES))))


def starts_of(hits: str, n: str, length: str) -> Column:
    """First words of all windows of n words that can reach THRESHOLD: hits are the places, in
    order, of the document's shingles that an item of n words has; length is its number of shingles.

    A window of m shingles needs 2 * T / (1 + T) * m of them in common with an item of m. One that
    an end of the document cuts off needs T * m. So c hits from the i-th on in less than m
    places allow the starts from the last of them, less m, to the first of them.
    """
    m = f"({n} - {WORDS - 1})"
    reach = lambda c: f"flatten(transform(filter(CASE WHEN size({hits}) >= {c} THEN sequence(0, size({hits}) - {c}) ELSE array() END, i -> {hits}[i + {c} - 1] - {hits}[i] < {m}), i -> sequence({hits}[i + {c} - 1] - {m} + 1, {hits}[i])))"
    whole, part = (f"CAST(greatest(1, ceil({x} * {m} - 1e-9)) AS INT)" for x in (2 * THRESHOLD / (1 + THRESHOLD), THRESHOLD))
    inside = f"s BETWEEN 0 AND {length} - {m}"
    return F.expr(f"array_distinct(concat(filter({reach(whole)}, s -> {inside}), filter({reach(part)}, s -> NOT ({inside}))))")


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of least over sum of greatest weights, a shingle's weight being how often it occurs."""
    plain = F.expr(f"size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b})")
    common = F.expr(f"size(array_intersect({a}, {b}))")
    counted = F.expr(f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    both = F.when(plain, common).otherwise(counted)
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): for each document and item, the best window.

    docs has doc_id and text, items has item_id and text; other columns are ignored. A row
    is returned where a window of the item's length, at any word (cut at the document's
    ends), has a weighted similarity of five-word shingles of 0.8 or more and fingerprints
    within RADIUS; start counts words from 0, and of equally good windows the first is named.
    Texts that are null or have fewer than five words match nothing, on either side. Repeated rows count as one document, rows
    with equal doc_id and other texts as different ones (text_key tells them apart); null
    ids stay null. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("words")).filter(F.size("words") >= WORDS)
    items = items.select("item_id", F.size("words").alias("n"), shingles_of("words").alias("item")).distinct()
    items = cut(items.withColumn("item_no", F.monotonically_increasing_id()).withColumn("item_fp", simhash("item")))

    known = items.select("n", F.explode("item").alias("h")).distinct()
    words = docs.select("doc_id", "text_key", words_of("text").alias("words")).withColumn("length", F.size("words") - (WORDS - 1))
    hits = words.select("doc_id", "text_key", "length", F.posexplode(shingles_of("words")).alias("at", "h")).join(small(known), "h")
    hits = hits.groupBy("doc_id", "text_key", "length", "n").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    windows = hits.select("doc_id", "text_key", "n", starts_of("hits", "n", "length").alias("starts")).filter(F.size("starts") > 0)
    laid = small(windows.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("key")).agg(F.collect_list(F.struct("starts", "n")).alias("windows")))

    cuts = F.expr("flatten(transform(windows, w -> transform(w.starts, s -> struct(s AS start, w.n AS n, slice(words, greatest(s, 0) + 1, w.n + least(s, 0)) AS words))))")
    printed = (
        docs.join(laid, docs["doc_id"].eqNullSafe(laid["of"]) & (docs["text_key"] == laid["key"]))
        .select("doc_id", "text_key", "windows", words_of("text").alias("words"))
        .select("doc_id", "text_key", F.explode(cuts).alias("w"))
        .select("doc_id", "text_key", "w.start", "w.n", F.col("w.words").alias("words"))
        .select("doc_id", "text_key", "start", "n", shingles_of("words").alias("shingles"))
        .withColumn("fp", simhash("shingles"))
    )
    index = items.select("item_no", "n", "item_fp", F.posexplode(probes_of("item_fp")).alias("k", "near")).select("item_no", "n", "item_fp", "k", F.explode("near").alias("bits"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    within = F.array(*(F.bit_count(apart.bitwiseAND(F.lit((1 << hi) - (1 << lo) - (1 << 64 if hi == 64 else 0)).cast("long"))) <= FLIPS for lo, hi in pairwise(EDGES)))
    pairs = (
        printed.select("doc_id", "text_key", "start", "n", "shingles", "fp", F.posexplode(blocks_of("fp")).alias("k", "bits"))
        .join(small(index), ["n", "k", "bits"])
        .filter((F.bit_count(apart) <= RADIUS) & (F.array_position(within, True) == F.col("k") + 1))  # each pair once
        .join(small(items.select("item_no", "item_id", "item")), "item_no")
        .withColumn("similarity", weighted_jaccard("shingles", "item"))
        .filter(F.col("similarity") >= THRESHOLD)
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.greatest("start", F.lit(0)).alias("start")))
    return pairs.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best")).select("doc_id", "text_key", "item_id", F.col("best.start").cast("long").alias("start"), F.round(-F.col("best.s"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found, with all of their columns."""
    found = small(contaminated(docs, items).select(F.col("doc_id").alias("of"), F.col("text_key").alias("key")).distinct())
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["of"]) & (F.xxhash64(docs["text"]) == found["key"]), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


ORACLE_SQL = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
i AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
ish AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS place, w FROM i WHERE len(w) >= 5),
ip AS (SELECT item_id, n, place, array_to_string(w[place + 1 : place + 5], ' ') AS g FROM ish),
dsh AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, w FROM d WHERE len(w) >= 5),
dp AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS g FROM dsh),
hit AS (SELECT DISTINCT dp.doc_id, dp.pos, ip.item_id, ip.n FROM dp JOIN ip USING (g)),
win AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(pos - n + 5, pos + 1)) AS start FROM hit),
ww AS (SELECT win.*, unnest(range(greatest(start, 0), greatest(start, 0) + n + least(start, 0) - 4)) AS pos FROM win),
wc AS (SELECT ww.doc_id, ww.item_id, ww.start, g, count(*) AS c FROM ww JOIN dp USING (doc_id, pos) GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ip GROUP BY ALL),
isz AS (SELECT item_id, sum(c) AS total FROM ic GROUP BY ALL),
s AS (SELECT wc.doc_id, wc.item_id, wc.start, sum(wc.c) AS total, sum(least(wc.c, coalesce(ic.c, 0))) AS common FROM wc LEFT JOIN ic USING (item_id, g) GROUP BY ALL),
r AS (SELECT doc_id, item_id, greatest(start, 0) AS start, common / (s.total + isz.total - common) AS sim FROM s JOIN isz USING (item_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS rn FROM r WHERE sim >= 0.8)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, round(CAST(sim AS DOUBLE), 6) AS similarity FROM b WHERE rn = 1"""
}
