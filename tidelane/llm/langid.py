"""Operator 5: language identification by mixture inference.

A document is a mixture of languages. Expectation-maximisation estimates the proportions
from the likelihoods of the document's byte n-grams; a set of languages is chosen by
likelihood less a penalty for every further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import table
from tidelane.llm.textnum import blocks

#: Bytes in an n-gram, bits of its hash, and the count that each n-gram is given beforehand.
GRAM, BITS, PRIOR = 4, 16, 0.5
ROUNDS = 10
#: Bytes of text that are worked on at once; a longer document goes alone, and whole.
BLOCK = 1 << 18
#: A further language must raise the log-likelihood by this much times log(n-grams), and hold this share.
PENALTY, LEAST_SHARE = 2.0, 0.05
PREDICTED = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"


def letters(text: str) -> Column:
    """Lower-case letters, other runs as one space; padded so that each word has its n-grams,
    and that a single letter has one."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", " ")), F.lit(" " * (GRAM - 2)))


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, document, n-gram) for blocks of documents; n-grams stay within one document."""
    for i, j, b in blocks(texts, BLOCK):
        n = len(b.data) - GRAM + 1
        if n <= 0:
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        x = np.zeros(n, np.uint32)
        for k in range(GRAM):
            x = (x << np.uint32(8)) | b.data[k : n + k]
        at = np.arange(n)
        doc = np.repeat(np.arange(b.n), np.diff(b.offsets))[:n]
        stay = at + GRAM <= b.offsets[doc + 1]
        yield i, j, doc[stay], ((x[stay] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        langs, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros((len(langs), 1 << BITS), np.int64)
        for i, _, doc, x in grams(batch.column("text")):
            counts += np.bincount(code[i + doc] * (1 << BITS) + x, minlength=counts.size).reshape(counts.shape)
        lang, gram = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in lang], pa.string()), pa.array(gram), pa.array(counts[lang, gram])], ["lang", "gram", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every hashed n-gram in each, from all rows of docs
    (text, lang) that have both. The driver receives at most 2**BITS numbers per language."""
    known = docs.filter("text is not null and lang is not null").select("lang", letters("text").alias("text"))
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(counts.column("lang")).to_pylist())
    at = {x: k for k, x in enumerate(langs)}
    table_ = np.full((1 << BITS, len(langs)), PRIOR)
    for lang in langs:
        part = counts.filter(pc.equal(counts.column("lang"), lang))
        table_[part.column("gram").to_numpy(), at[lang]] += part.column("n").to_numpy()
    return langs, np.log(table_ / table_.sum(axis=0)).astype(np.float32)


def _mixture(p: np.ndarray, count: np.ndarray, begin: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every document under its allowed languages."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(count, begin)[:, None]
    for _ in range(ROUNDS):
        part = p * share[doc]
        part *= (count / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, begin) / total
    return share, np.add.reduceat(count * np.log((p * share[doc]).sum(axis=1)), begin)


def infer(doc: np.ndarray, gram: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the documents that occur in doc: their numbers, proportions under all languages,
    and proportions under the chosen set."""
    key, count = np.unique(doc * (1 << BITS) + gram, return_counts=True)
    doc, gram = key >> BITS, key & ((1 << BITS) - 1)
    has, begin, doc = *np.unique(doc, return_index=True), np.unique(doc, return_inverse=True)[1]
    n_langs, count = logp.shape[1], count.astype(np.float64)
    low = logp[gram].astype(np.float64)
    top = low.max(axis=1)
    p = np.exp(low - top[:, None])  # relative, so that products don't vanish
    alone = np.add.reduceat(count[:, None] * (low - top[:, None]), begin)
    full, best = _mixture(p, count, begin, doc, np.ones((len(has), n_langs)))
    n = np.log(np.maximum(np.add.reduceat(count, begin), 2)) * PENALTY
    chosen = np.eye(n_langs)[alone.argmax(axis=1)]
    value = alone.max(axis=1)
    open_ = np.flatnonzero(best - n > value)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    for k in range(2, n_langs + 1):
        some = open_[(np.sort(full[open_], axis=1)[:, -k] >= LEAST_SHARE)] if len(open_) else open_
        if not len(some):
            break
        rows = np.flatnonzero(np.isin(doc, some))
        d = np.searchsorted(some, doc[rows])
        share, gain = _mixture(p[rows], count[rows], np.unique(d, return_index=True)[1], d, (rank[some] < k).astype(float))
        better = gain - (k - 1) * n[some] > value[some]
        chosen[some[better]], value[some[better]] = share[better], (gain - (k - 1) * n[some])[better]
    return has, full, chosen


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares) for each row of docs (doc_id long, text string).

    lang_pred is the language with the largest share in the chosen set, the first by name
    among equals; score is its share when all languages are allowed; langs and shares are
    the chosen set. Texts that are null or have no letter, and all texts when nothing was
    learned, are `und` with score 0 and no languages. Repeated rows give repeated rows; no
    rows give no rows; a null doc_id stays null. Other columns are ignored.
    """
    logp = logp.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worded = batch.column("worded").to_numpy(zero_copy_only=False)
            for i, j, doc, gram in grams(batch.column("text")):
                stay = worded[i + doc]
                pred, score, names, shares = ["und"] * (j - i), [0.0] * (j - i), [[]] * (j - i), [[]] * (j - i)
                if stay.any() and langs:
                    has, full, chosen = infer(doc[stay], gram[stay], logp)
                    for d, all_, own in zip(has.tolist(), full, chosen):
                        top, some = int(own.argmax()), np.flatnonzero(own > 0)
                        pred[d], score[d] = langs[top], min(1.0, float(all_[top]))
                        names[d], shares[d] = [langs[k] for k in some], own[some].tolist()
                arrays = [batch.column("doc_id").slice(i, j - i), pa.array(pred), pa.array(score), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "langs", "shares"])

    worded = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("worded")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), worded, letters("text").alias("text")).mapInArrow(run, PREDICTED)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, logp = fit(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), langs, logp).withColumn("held_out", held_out())
