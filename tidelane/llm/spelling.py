"""Operator 12: spelling variants of words, by bands of letter-parity masks.

Bit i of a word's mask says whether the letters of class i occur in it an odd number of
times. One inserted or deleted letter flips one bit and a replaced one flips two at most, so
of three bands of a mask at least one stays as it was. Words are joined on an equal band, for each of the two
lengths that one edit can lead to; one edit also leaves a half of the word alone, which goes into the key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import cut, small, stored, table
from tidelane.llm.resample import CRC_SQL, _lower, crc_sql

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A word's form occurs so many times as often as the word.
TIMES = 10
#: A run loses a letter where this divides its hash.
LOSES = 31
BANDS, BAND_BITS = 3, 10
#: Characters of a text that are searched at a time, and words that a task counts before it hands them on.
PIECE, HELD = 1 << 18, 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _runs(letters: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{letters},}}")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that begin and end outside of words."""
    at, letter = 0, re.compile("[^A-Za-zÀ-ÿ]")
    while at < len(text):
        stop = letter.search(text, at + PIECE)
        end = stop.end() if stop else len(text)
        yield text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): runs of enough letters, some of which have lost one."""
    found: Counter[str] = Counter()
    runs = _runs(LEAST_LETTERS)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for piece in _pieces(text.as_py()):
                for run, n in Counter(runs.findall(piece.encode().translate(LOWER).decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % LOSES == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                    if len(run) >= LEAST_LETTERS:
                        found[run] += n
                if len(found) >= HELD:
                    yield out()
                    found.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough, counted over all texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_parity(word: str = "word") -> Column:
    """The mask: a letter of code c has bit c div 3 of band c % 3, so that frequent letters are spread over the bands."""
    bits = F.transform(F.split(word, ""), lambda x: F.ascii(x))
    place = lambda c: (c % BANDS * BAND_BITS + F.floor(c / BANDS) % BAND_BITS).cast("int")
    return F.aggregate(bits, F.lit(0), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), place(c))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words (word, n) one edit apart, b as long as a or one longer, each once.

    A key is a band, the lengths of both words and a half that they share: with an edit in the first
    half the last letters stay, or else the first. Of several keys that a pair shares, the first gives it.
    """
    words = words.select("word", "n", letter_parity().alias("mask"), F.length("word").alias("size"))
    band = lambda mask, k: F.call_function("shiftright", mask, F.lit(k * BAND_BITS)).bitwiseAND((1 << BAND_BITS) - 1)

    def keys(short: int, grows: int) -> DataFrame:
        """Each word as the shorter (or equal) of a pair or the longer; `short` is the length of the shorter.
        Where a letter is added one bit flips, so that one of any two bands stays and the third isn't needed."""
        of, kept = F.col("size") - short, F.floor((F.col("size") - short) / 2).cast("int")
        first, last = F.substring(F.col("word"), F.lit(1), kept), F.substring(F.col("word"), -(of - kept), of - kept)
        each = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), band(F.col("mask"), k).alias("bits"), half.alias("half")) for k in range(BANDS - grows) for side, half in enumerate((first, last))]
        return words.select("word", "n", "mask", "size", of.alias("of"), F.lit(grows).alias("grows"), F.explode(F.array(*each)).alias("x")).select("*", "x.*").drop("x")

    left = keys(0, 0).union(keys(0, 1)).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("m_a"), F.col("size").alias("s_a"), "of", "grows", "k", "side", "bits", "half")
    right = keys(0, 0).union(keys(1, 1)).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("m_b"), F.col("size").alias("s_b"), "of", "grows", "k", "side", "bits", "half")
    apart = F.col("m_a").bitwiseXOR(F.col("m_b"))
    flips = F.bit_count(apart)
    fits = ((F.col("grows") == 1) & (flips == 1)) | ((F.col("grows") == 0) & (flips <= 2) & (F.col("a") < F.col("b")))
    first_band = F.coalesce(*(F.when(band(apart, k) == 0, F.lit(k)) for k in range(BANDS)))
    kept = F.floor(F.col("of") / 2).cast("int")
    same_first = F.substring(F.col("a"), F.lit(1), kept) == F.substring(F.col("b"), F.lit(1), kept)
    told = (F.col("k") == first_band) & ((F.col("side") == 0) | ~same_first)
    return left.join(right, ["of", "grows", "k", "side", "bits", "half"]).filter(fits & told).filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts of docs (doc_id, text; other columns don't matter).

    Words are maximal runs of letters, Latin-1 ones too, with A-Z in lower case, of seven letters or more, that occur twice or
    more; a run whose hash with its doc_id is divisible by 31 has lost a letter. n_near counts the words that
    are one edit apart. form is the most frequent of them (ties: the least in code-point order) where it has `times` the word's n, and root is where
    forms lead to. Null and empty texts have no words; a null doc_id hashes as an empty one; repeated rows count again; no rows give no rows.

    Texts are read once and counted in tasks; the words alone are shuffled. Counts of forms grow tenfold at
    each step, so forms end after a step for each digit of the largest count.
    """
    words = stored(word_counts(docs))
    pairs = stored(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left").withColumn("is_form", -F.col("best.less") >= times * F.col("n"))
    known = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("IF(is_form, best.near, NULL)").alias("form"), F.expr("IF(is_form, -best.less, NULL)").alias("form_n")))
    root = cut(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("on"))
        further = cut(root.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        root = further.drop("moved")
        if further.filter("moved").isEmpty():
            break
    return known.join(small(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op12_spelling_variants": rf"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS said FROM documents),
r AS (SELECT doc_id, {_lower("said")} AS run, count(*) AS n FROM d GROUP BY ALL), x AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS hexed FROM r WHERE length(run) >= {LEAST_LETTERS}),
h AS (SELECT run, n, {crc_sql("hexed")} AS h FROM x, crc_table),
c AS (SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM c WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
i AS (SELECT word, n, size, unnest(range(size)) AS i FROM w), l AS (SELECT *, substr(word, 1, i) || substr(word, i + 2) AS less FROM i),
p AS (SELECT x.word AS a, y.word AS b, y.n AS n FROM l x JOIN l y USING (i, less) WHERE x.word <> y.word
  UNION SELECT l.word, w.word, w.n FROM l JOIN w ON w.word = l.less UNION SELECT w.word, l.word, l.n FROM l JOIN w ON w.word = l.less),
q AS (SELECT a, count(DISTINCT b) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM p GROUP BY a),
k AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN q ON q.a = w.word),
o(word, root, step) AS (SELECT word, word, 0 FROM k UNION ALL SELECT o.word, k.form, step + 1 FROM o JOIN k ON k.word = o.root WHERE k.form IS NOT NULL)
SELECT k.word, form, (SELECT arg_max(o.root, o.step) FROM o WHERE o.word = k.word) AS root, n, n_near, form_n FROM k"""
}
