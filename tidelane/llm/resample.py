"""Operator 13: importance resampling towards a target's distribution of word n-grams.

Documents and targets become counts of hashed features, and a document's weight is the
mean gain of its features. Long texts are skew: they are split at word boundaries into
chunks that carry the next n - 1 words with them. A chunk owns the positions that begin in
it, so each feature is counted once, and chunks' counts and weights are summed by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import cut, small, stored, table

WORDS, BUCKETS = 2, 10_000
LEAST_WORDS = 20
#: The drawn part of the documents that have enough words, in hundredths, and the draw's seed.
PERCENT, SEED = 25, 7
#: Bytes of a text from which on it is split, and of a chunk.
CHUNK = 64 << 10
#: Bytes of text that numpy takes at a time, and of a word that it takes byte by byte.
BLOCK, LONG_WORD = 256 << 10, 64

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
LETTER = (_byte >= 128) | (_byte >= 48) & (_byte <= 57) | (_byte >= 97) & (_byte <= 122)
LETTER |= (_byte >= 65) & (_byte <= 90)
CRC = _byte.astype(np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
ALL = np.uint32(0xFFFFFFFF)


def _next(data: bytes, at: int, letter: bool) -> int:
    """The first place from `at` on that holds a letter, or none; the end if there is none such."""
    while at < len(data):
        hit = np.flatnonzero(LETTER[np.frombuffer(data, np.uint8, min(4096, len(data) - at), at)] == letter)
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return len(data)


def chunks(data: bytes, n: int = WORDS, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about `size` bytes, each with the number of its own bytes; after these
    it carries the next n - 1 words. Words are never split."""
    at = 0
    while at < len(data):
        end = _next(data, at + size, False) if at + size < len(data) else len(data)
        carried, to = [], end
        for _ in range(n - 1):
            begin = _next(data, to, True)
            to = _next(data, begin, False)
            carried.append(data[begin:to])
        yield data[at:end] + b"".join(b" " + w for w in carried if w), end - at
        at = end


def _split(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("text")):
                for part, (piece, own) in enumerate(chunks(text.as_buffer().to_pybytes(), n)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([doc.as_py()], pa.int64()), pa.array([part]), pa.array([own]), pa.array([piece.decode()])], ["row", "doc_id", "part", "own", "text"])

    return run


def pieces(docs: DataFrame, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, own, text) of the texts that stay whole, and of the chunks of long ones, which
    are dealt out and stored. `row` tells rows apart."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    long = docs.filter(size > CHUNK).mapInArrow(_split(n), "row long, doc_id long, part long, own long, text string")
    return docs.filter(size <= CHUNK).select("row", "doc_id", size.alias("own"), "text"), stored(long.repartition("row", "part").drop("part"))


def fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 registers after each span of data, byte by byte over all spans at once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, at, s = size[order], starts[order], state[order]
    long = int(np.searchsorted(-size, -LONG_WORD))
    for i in range(long):
        s[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(s[i] ^ ALL)) ^ 0xFFFFFFFF
    for k in range(int(size[long]) if long < len(size) else 0):
        m = int(np.searchsorted(-size, -k))
        s[long:m] = CRC[(s[long:m] ^ data[at[long:m] + k]) & 255] ^ (s[long:m] >> 8)
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, n: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece number and CRC-32 of the features of 1, 2 ... n words that begin in a piece's own bytes."""
    data = LOWER[data]
    letter = LETTER[data]
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] |= letter[edge]
    end[edge - 1] |= letter[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    piece = np.searchsorted(offsets, starts, side="right") - 1
    mine = starts - offsets[piece] < own[piece]
    at = np.flatnonzero(mine)
    state = np.full(len(at), ALL, np.uint32)
    for k in range(n):
        if k:
            stay = (at + k < len(starts)) & (piece[np.minimum(at + k, len(starts) - 1)] == piece[at]) if len(starts) else np.zeros(0, bool)
            at, state = at[stay], state[stay]
            state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        state = fed(state, data, starts[at + k], ends[at + k])
        yield piece[at], state ^ ALL


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    own, i = batch.column("own").to_numpy(), 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], own[i:j]
        i = j


def _counted(n: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets, own in _blocks(batch):
                for _, crc in features(data, offsets, own, n):
                    count += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    return run


def _weighed(n: int, gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets, own in _blocks(batch):
                n_words, n_features, gains = None, np.zeros(j - i, np.int64), np.zeros(j - i)
                for piece, crc in features(data, offsets, own, n):
                    n_features += np.bincount(piece, minlength=j - i)
                    n_words = n_features.copy() if n_words is None else n_words
                    gains += np.bincount(piece, gain[crc % np.uint32(len(gain))], minlength=j - i)  # whole numbers, far below 2**53
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(n_words), pa.array(n_features), pa.array(gains.astype(np.int64))], ["row", "doc_id", "n_words", "n_features", "gains"]
                )

    return run


def bucket_counts(whole: DataFrame, split: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any."""
    run, kind = _counted(n, buckets), "bucket long, n long"
    return whole.mapInArrow(run, kind).union(split.mapInArrow(run, kind)).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(ours: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the logarithm of target over ours, each
    count and one more, rounded down."""
    n = lambda df, name: df.select("bucket", F.col("n").alias(name))
    both = ours.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(n(ours, "s"), "bucket", "left").join(n(target, "t"), "bucket", "left").fillna(0)
    both = both.crossJoin(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    up = lambda part, other: (F.col(part) + 1).cast("double") * (F.col(other) + buckets).cast("double")
    return both.select("bucket", F.floor(1000 * F.ln(up("t", "all_s") / up("s", "all_t"))).alias("gain"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank is null where it isn't drawn.

    docs has doc_id and text, target has text; other columns don't matter. Features are runs of
    1 to n words, in lower case (A-Z), a word being what ASCII other than letters and digits separates. A text
    without words, or null, has none and weight 0. Of the rows with least_words or more, `percent` in a hundred are
    drawn, rounded down, by Gumbel top-k: highest score first, ties to the smaller doc_id. A null doc_id draws
    as an empty one and comes first in ties. Repeated rows have one score, and each a rank of its own. Without
    target, docs' own rare buckets gain; no rows give no rows.

    Texts are read twice, as the gains need all counts first; what is shuffled is chunks of long texts,
    a count for each bucket and task, and one short row for each document. The gains are `buckets` numbers.
    """
    whole, split = pieces(docs, n)
    counts = bucket_counts(whole, split, n, buckets)
    told = target.select(F.lit(0).cast("long").alias("doc_id"), target["text"])
    gain = np.zeros(buckets)
    for r in bucket_gains(cut(counts), bucket_counts(*pieces(told, n), n, buckets), buckets).collect():  # as many rows as buckets
        gain[r.bucket] = r.gain
    run, kind = _weighed(n, gain), "row long, doc_id long, n_words long, n_features long, gains long"
    parts = split.mapInArrow(run, kind).groupBy("row", "doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum("gains").alias("gains"))
    summed = whole.mapInArrow(run, kind).unionByName(parts)
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gains - pmod(gains, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = summed.select("doc_id", "n_features", mean.alias("weight"), (F.col("n_words") >= least_words).alias("may")).withColumn("score", F.col("weight") + luck)
    scored = stored(scored)

    may = scored.filter("may").groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a few ten thousand different scores, whatever the rows
    scores = scored.filter("may").groupBy("score").agg(F.count("*").alias("n"))
    scores = scores.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    drawn = small(scores.withColumn("drawn", F.expr(f"all * {percent} div 100")).filter("above < drawn").drop("all"))
    before = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = may.join(drawn, "score").withColumn("from", F.col("above") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = placed.select("doc_id", "n_features", "weight", "score", "drawn", F.explode(F.expr("sequence(from + 1, from + n)")).alias("rank")).withColumn("rank", F.expr("IF(rank <= drawn, rank, NULL)")).drop("drawn")
    others = scored.join(drawn.select("score", F.lit(True).alias("in_")), "score", "left").filter("NOT may OR in_ IS NULL")
    return ranked.union(others.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of docs that are drawn, with their weight and rank. Needs doc_ids that no two rows share."""
    drawn = importance_resample(docs, target, **how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("of_"), "weight", "rank")
    drawn = small(drawn)
    return docs.drop("weight", "rank").join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("of_"))).drop("of_")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: What SQL needs for CRC-32: the table of bytes, by the rule.
CRC_SQL = """crc_bytes AS (SELECT range AS c, list_reduce([range] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256)),
crc_table AS (SELECT list(t ORDER BY c) AS t FROM crc_bytes)"""


def crc_sql(hexed: str) -> str:
    """SQL for the CRC-32 of bytes in hexadecimal, where crc_table is joined."""
    at = f"('0x' || {hexed}[2 * i + 1:2 * i + 2])::BIGINT"
    return f"xor(list_reduce([4294967295] || list_transform(range(length({hexed}) // 2), lambda i: {at}), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL = {
    "op13_importance_resample": rf"""
WITH {CRC_SQL},
d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
f AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
e AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
u AS (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM e)), x AS (SELECT f, hex(encode(f)) AS hexed FROM u),
k AS (SELECT f, {crc_sql("hexed")} % {BUCKETS} AS bucket FROM x, crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM e JOIN k USING (f) GROUP BY bucket),
g AS (SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(coalesce(s, 0)) OVER () + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (sum(coalesce(t, 0)) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gains FROM f JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(ws) >= {LEAST_WORDS} AS may, coalesce(n_features, 0) AS n_features, CASE WHEN w.doc_id IS NULL THEN 0 ELSE (gains - ((gains % n_features) + n_features) % n_features) // n_features END AS weight,
  ('0x' || sha256('{SEED}:' || d.doc_id::VARCHAR)[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM c),
o AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (may) OVER () AS n FROM r)
SELECT doc_id, n_features, weight::BIGINT AS weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM o"""
}
