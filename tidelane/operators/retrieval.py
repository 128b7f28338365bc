"""Lexical and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

K1, B, EPSILON = 1.5, 0.75, 0.25


def _top(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 8)), doc)  # sums differ in their last bits by order
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Rows of a side that is broadcast; it is counted first, and shuffled beyond.
BROADCAST_ROWS = 200_000
#: Vectors that a matrix product takes at once, on either side.
VECTORS = 4096


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, doc, score, rank): Okapi BM25 over lower-case words between white space.

    A negative idf is replaced by EPSILON times the mean idf of all terms. A document counts
    once for each of its distinct terms, added up before the shuffle; after the scan, postings
    of the queries' terms alone are shuffled. Blank queries find nothing.
    """
    words = lambda t: F.array_remove(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), "")
    split = docs.select(doc, words(F.col("text")).alias("words"))
    size = split.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_length"))
    df = split.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    asked = queries.select(query, F.explode(words(F.col("text"))).alias("term"))
    wanted = _small(asked.select("term").distinct())
    counts = split.select(doc, F.size("words").alias("length"), F.explode("words").alias("term")).join(wanted, "term", "left_semi").groupBy(doc, "length", "term").agg(F.count("*").alias("tf"))
    mean_idf = df.agg(F.avg("idf").alias("mean_idf"))
    terms = df.join(wanted, "term", "left_semi").crossJoin(F.broadcast(mean_idf)).withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scores = counts.join(terms, "term").join(_small(asked), "term").groupBy(query, doc).agg(F.sum(weight).alias("score"))
    return _top(scores, query, doc, k)


def _matrices(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(ids, rows): blocks of VECTORS rows at most as one row, vectors of length 1 in float64; norm 0 stays 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                flat = part.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                norm = np.linalg.norm(flat, axis=1, keepdims=True)
                flat = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(key))
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat.tobytes()], pa.binary())], ["ids", "rows"])

    return df.filter(F.col("embedding").isNotNull()).select(key, "embedding").mapInArrow(pack, f"ids array<{kind}>, rows binary")


def cosine(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): the nearest vectors of each of a stated set of queries; a
    vector of norm 0 has similarity 0, one that is null is passed over. All vectors have one length.

    Both sides are dealt into blocks, and every block of vectors meets every block of
    queries in one matrix product, of which each query's best k go on.
    """
    kinds = vectors.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    v = _matrices(vectors, key, kinds[0])
    q = _matrices(queries, query, kinds[1]).select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    out = StructType([StructField(query, queries.schema[query].dataType), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q_ids = (batch.column(c)[i].values for c in ("ids", "q_ids"))
                left, right = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1) for c, n in (("rows", ids), ("q_rows", q_ids)))
                score = right @ left.T
                by_id = pc.sort_indices(ids).to_numpy()
                order = by_id[np.argsort(-np.round(score[:, by_id], 8), axis=1, kind="stable")[:, :k]]
                of = np.repeat(np.arange(len(q_ids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(of)), ids.take(pa.array(order.ravel())), pa.array(score[of, order.ravel()])], out.names)

    return _top(v.crossJoin(q).mapInArrow(best, out), query, key, k)


def grep(docs: DataFrame, pattern: str, k: int, doc: str = "doc_id") -> DataFrame:
    """(doc, score): documents by number of matches, case ignored; a pattern that Spark can't
    compile is searched for as it stands."""
    if not compiles(docs.sparkSession, f"(?i){pattern}"):
        pattern = "".join(rf"\{c}" if c in r"\.[]{}()<>*+-=!?^$|#&~" else c for c in pattern)
    found = docs.select(doc, F.regexp_count("text", F.lit(f"(?i){pattern}")).alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), doc).limit(k)


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern is one of Spark's own (Java's) regular expressions: tried on one empty row."""
    try:
        spark.range(1).select(F.regexp_count(F.concat(F.lit(""), F.col("id").cast("string")), F.lit(pattern))).collect()
    except PySparkException as error:
        if "PATTERN" in str(error) or "regex" in str(error).lower():
            return False
        raise
    return True


def fuse(results: list[DataFrame], k: int, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Results of several retrievers: the best score of each document, and then the top k."""
    every = results[0].select(query, doc, "score")
    for r in results[1:]:
        every = every.unionByName(r.select(query, doc, "score"))
    return _top(every.groupBy(query, doc).agg(F.max("score").alias("score")), query, doc, k)
