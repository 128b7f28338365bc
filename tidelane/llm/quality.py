"""Operator 1: quality rules by repetition coverage.

Rolling hashes of word windows of several lengths measure how much of a text lies
inside windows, and inside lines, that the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelane.llm.common import table
from tidelane.llm.textnum import U64, Block, blocks, mix, prefix, span_hash

#: Words in a window, and the largest share of a text's word characters that may lie in windows found twice or more.
NGRAM_SHARE = {5: 0.40, 8: 0.30, 13: 0.25}
#: The largest share of a text's characters that may lie in lines equal to an earlier line.
LINE_SHARE = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_SHARE)
)


def _lines(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines that hold a word."""
    breaks = np.flatnonzero(b.data == 10)
    full = b.offsets[1:] > b.offsets[:-1]
    starts = np.unique(np.concatenate([b.offsets[:-1][full], breaks + 1]))
    starts = starts[starts < len(b.data)]
    ends = np.append(breaks, len(b.data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(ends, b.offsets[b.doc_of(starts) + 1])
    worded = np.searchsorted(b.starts, starts) < np.searchsorted(b.starts, ends)
    return starts[worded], ends[worded]


def measure(b: Block) -> dict[str, np.ndarray]:
    """Counts for each document of the block."""
    total = lambda doc, x: np.bincount(doc, weights=x, minlength=b.n).astype(np.int64)
    points, symbols = prefix((b.data & 0xC0) != 0x80), prefix(SYMBOLS[b.data])
    chars, salt = points[b.ends] - points[b.starts], mix(np.arange(1, b.n + 1, dtype=U64))
    out = {
        "n_words": b.n_words.astype(np.int64),
        "word_chars": total(b.doc, chars),
        "n_symbols": symbols[b.offsets[1:]] - symbols[b.offsets[:-1]],
    }
    starts, ends = _lines(b)
    doc = b.doc_of(starts)
    again = pd.Series(span_hash(b.data, starts, ends) ^ salt[doc]).duplicated().to_numpy()
    out["n_dup_lines"] = total(doc, again)
    out["dup_line_chars"] = total(doc, again * (points[ends] - points[starts]))
    out["chars"] = points[b.offsets[1:]] - points[b.offsets[:-1]]
    words = b.word_hashes()
    for n in NGRAM_SHARE:
        at, h = b.windows(words, n)
        twice = at[pd.Series(h ^ salt[b.doc[at]]).duplicated(keep=False).to_numpy()]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + n, -1)
        inside = np.cumsum(edge)[:-1] > 0
        out[f"dup_{n}gram_chars"] = total(b.doc, inside * chars)
        if n == 8:
            out["n_repeat_words"] = total(b.doc, inside)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, b in blocks(batch.column("text")):
            m = measure(b)
            m["base_failed"] = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            bad = m["dup_line_chars"] > LINE_SHARE * m["chars"]
            for n, share in NGRAM_SHARE.items():
                bad |= m[f"dup_{n}gram_chars"] > share * m["word_chars"]
            m["kept"] = ~m["base_failed"] & ~bad
            names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(m[x]) for x in names)], ["doc_id", *names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id long, text string; other columns are ignored).

    Counts follow words `[^\\x20\\x09-\\x0D]+` of the whole text; a null or empty text
    has no words and fails. Repeated rows give repeated rows; no rows give no rows; a
    null doc_id stays null. Each text is measured alone in its block, so there is no
    shuffle and memory is bounded by a batch and its longest text.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_batches, SCHEMA)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [x.column("kept") for x in _batches([pa.RecordBatch.from_arrays([batch.column("text"), batch.column("text")], ["doc_id", "text"])])]
        yield batch.append_column("kept", pa.concat_arrays(kept) if kept else pa.array([], pa.bool_()))


def with_quality(docs: DataFrame) -> DataFrame:
    """docs with the verdict `kept` beside each row, in one pass (a column of that name is replaced)."""
    docs = docs.drop("kept")
    return docs.mapInArrow(_kept, T.StructType([*docs.schema.fields, T.StructField("kept", T.BooleanType())]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _share_sql(n: int) -> str:
    """Characters of each document's words inside windows of n words that it has twice."""
    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    return f"""g{n} AS (SELECT doc_id, i, chars, {gram} AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t{n} AS (SELECT doc_id, i, chars, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM g{n}),
i{n} AS (SELECT doc_id, chars, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM t{n}),
s{n} AS (SELECT doc_id, sum(inside) AS words, sum(inside * chars) AS chars FROM i{n} GROUP BY doc_id)"""


_SHARES = " OR ".join(f"coalesce(s{n}.chars, 0) > {share} * word_chars" for n, share in NGRAM_SHARE.items())
ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p0 AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d), p AS (SELECT *, length(word) AS chars FROM p0),
b AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars FROM p GROUP BY doc_id),
{", ".join(_share_sql(n) for n in NGRAM_SHARE)},
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
l2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l1 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1), 0) AS dup_line_chars FROM l2 GROUP BY doc_id),
m AS (SELECT d.doc_id, length(text) AS chars, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(s8.words, 0) AS n_repeat_words, {", ".join(f"coalesce(s{n}.chars, 0) AS dup_{n}gram_chars" for n in NGRAM_SHARE)},
  coalesce(n_words, 0) < 20 OR 100 * coalesce(s8.words, 0) > 30 * coalesce(n_words, 0) AS base_failed, {_SHARES} OR coalesce(dup_line_chars, 0) > {LINE_SHARE} * length(text) AS bad
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in NGRAM_SHARE)})
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(dup_{n}gram_chars AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_SHARE)} FROM m"""
}
