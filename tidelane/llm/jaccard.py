"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts with equal sets form one class at once.
MinHash bands link the classes into families; within a family, pairs are compared a
few MinHash values at a time, dropped when the posterior probability of reaching the
threshold falls below a tolerance, and otherwise verified on the whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import cut, small, table
from tidelane.llm.components import connected_components
from tidelane.llm.textnum import BASE, U64, Block, blocks, mix

WORDS, THRESHOLD = 5, 0.8
#: Bands of rows: a pair at the threshold shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: MinHash values compared between two looks at the posterior, and the posterior below which a pair goes.
STEP, TOLERANCE = 16, 1e-9
#: Members of a family in a block; a larger family is compared block by block, in as many tasks.
MEMBERS = 256
#: Members of small families that one task group takes together.
GROUP = 400

_FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


@functools.cache
def least_matches(step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n: the fewest equal values among n for which P(Jaccard >= threshold) >= tolerance.
    Under a uniform prior that posterior is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in range(step, BANDS * ROWS + 1, step):
        m, p = 0, (1 - threshold) ** (n + 1)
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every distinct shingle of each document, in document order.
    A document of one to four words has one shingle, all of its words."""
    words = b.word_hashes()
    at, h = b.windows(words, WORDS)
    doc = b.doc[at]
    for n in range(1, WORDS):
        of = np.flatnonzero(b.n_words == n)
        x = np.full(len(of), n, U64)
        for k in range(n):
            x = x * U64(BASE & (2**64 - 1)) + words[b.first_word[of] + k]
        doc, h = np.concatenate([doc, of]), np.concatenate([h, mix(x)])
    first = ~pd.Series(h ^ mix(np.arange(1, b.n + 1, dtype=U64))[doc]).duplicated().to_numpy()
    doc, h = doc[first], h[first]
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def minhashes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS MinHash values for each run of h that begins at `begin`."""
    x, out = (h >> U64(32)).astype(np.uint32), np.empty((len(begin), BANDS * ROWS), np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(x * factor, begin)
    return out


def _keys(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run as a set."""
    return np.add.reduceat(mix(h), begin).view(np.int64), np.bitwise_xor.reduceat(mix(h * U64(3)), begin).view(np.int64)


SKETCH = "doc_id long, sa long, sb long, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=U64))
    for batch in batches:
        for i, j, b in blocks(batch.column("text")):
            doc, h = shingles(b)
            has, begin = np.unique(doc, return_index=True)
            none = np.ones(b.n, bool)
            none[has] = False
            sa, sb, bands = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64), np.zeros((0, BANDS), np.int64)
            if len(has):
                sa[has], sb[has] = _keys(h, begin)
                sig, acc = minhashes(h, begin).reshape(-1, BANDS, ROWS).astype(U64), salt
                for r in range(ROWS):
                    acc = mix(acc ^ sig[:, :, r])
                bands = acc.view(np.int64)
            ends = np.concatenate([[0], np.cumsum(~none) * BANDS]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(sa, mask=none), pa.array(sb, mask=none), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                ["doc_id", "sa", "sb", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, b in blocks(batch.column("text")):
            doc, h = shingles(b)
            has, begin = np.unique(doc, return_index=True)
            if len(has):
                sa, sb = _keys(h, begin)
                sig = minhashes(h, begin).astype(np.uint16)
                sets = np.split(h, begin[1:])
                yield pa.RecordBatch.from_arrays([pa.array(sa), pa.array(sb), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["sa", "sb", "sig", "shingles"])


def likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of sig that the posterior does not rule out."""
    same = np.zeros(len(a), np.int64)
    for n, least in least_matches().items():
        same += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(axis=1)
        stay = same >= least
        a, b, same = a[stay], b[stay], same[stay]
    return a, b


def exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the Jaccard similarity of sets a and b reaches the threshold, on all shingles."""
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark, out = np.zeros(ids.max() + 1, bool), np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        own = ids[begin[a[run[0]]] : begin[a[run[0]] + 1]]
        mark[own] = True
        other = b[run]
        flat = np.concatenate([ids[begin[x] : begin[x + 1]] for x in other])
        both = np.add.reduceat(mark[flat].astype(np.int64), np.concatenate([[0], np.cumsum(size[other])[:-1]]))
        out[run] = both >= THRESHOLD * (len(own) + size[other] - both) - 1e-9
        mark[own] = False
    return out


LINKS = "sa long, sb long, root long, links long"


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Of each family, or of each pair of a family's blocks: every member's number of linked
    documents and the least member that links lead to."""
    out = []
    for (_, i, j), rows in group.groupby(["family", "i", "j"], sort=False):
        rows = rows.drop_duplicates(["sa", "sb"])
        sig = np.stack([np.frombuffer(x, np.uint16) for x in rows["sig"]])
        sets = [np.frombuffer(x, U64) for x in rows["shingles"]]
        block, copies, sa = rows["block"].to_numpy(), rows["copies"].to_numpy(), rows["sa"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        if i == j:
            a, b = a[a < b], b[a < b]
        a, b = likely(sig, a, b)
        if len(a):
            link = exact(sets, a, b)
            a, b = a[link], b[link]
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        root, was = sa.copy(), None
        while was is None or (root != was).any():
            was = root.copy()
            np.minimum.at(root, a, was[b])
            np.minimum.at(root, b, was[a])
        out.append(pd.DataFrame({"sa": sa, "sb": rows["sb"].to_numpy(), "root": root, "links": links.astype(np.int64)})[links > 0])
    return pd.concat(out) if out else pd.DataFrame({x.split()[0]: pd.Series(dtype="int64") for x in LINKS.split(", ")})


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs (doc_id long, text string; other columns are ignored).

    A link joins two documents whose sets of five-word shingles (words between ASCII white
    space, as they stand) have a Jaccard similarity of 0.8 or more; n_links counts a
    document's partners, copies included, and class_id is the least doc_id that links lead
    to. A text of one to four words is one shingle; texts without words, and nulls, link to
    nothing and are classes of their own. Repeated rows are copies of each other, a null
    doc_id gives a null class_id only where the whole class has none, and no rows give no rows.

    Copies are counted once, before any pair is made. Sketches, not texts, are shuffled;
    whole sets travel for members of families alone, each as often as its family has blocks.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sketch = cut(docs.mapInArrow(_sketch, SKETCH))
    classes = sketch.filter("sa is not null").groupBy("sa", "sb").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    bands = sketch.select("sa", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("sa").alias("low"), F.max("sa").alias("high")).filter("low < high").select("band", "low")
    near = bands.join(small(shared), "band").filter("sa != low").select(F.col("sa").alias("a"), F.col("low").alias("b"))
    family = connected_components(near)
    members = cut(classes.join(family.select(F.col("node").alias("sa"), F.col("root").alias("family")), "sa"))
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("n"))
    dealt = members.join(sizes, "family").withColumn("block", F.pmod(F.hash("sb", "sa"), F.col("n")))
    wanted = small(members.select(F.col("first").alias("doc_id")).distinct())
    mine = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").mapInArrow(_sets, "sa long, sb long, sig binary, shingles binary")
    groups = members.count() // GROUP + 1
    pairs = F.expr("transform(sequence(0, n - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS j))")
    compared = (
        mine.join(dealt, ["sa", "sb"])
        .withColumn("pair", F.explode(pairs))
        .select("sa", "sb", "sig", "shingles", "copies", "family", "block", "pair.i", "pair.j", F.when(F.col("n") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.xxhash64("family", "pair")).alias("key"))
        .groupBy("key")
        .applyInPandas(_compare, LINKS)
    )
    compared = cut(compared)
    root = connected_components(compared.select(F.col("sa").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("sa", "sb").agg(F.sum("links").alias("links"))
    known = classes.join(links, ["sa", "sb"], "left").join(root.withColumnRenamed("node", "sa"), "sa", "left")
    known = cut(known.select("sa", "sb", "first", F.coalesce("root", "sa").alias("root"), F.when(F.col("root").isNull(), F.col("sb")).alias("alone"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = known.groupBy("root", "alone").agg(F.min("first").alias("class_id"))
    known = known.join(least, (known["root"] == least["root"]) & known["alone"].eqNullSafe(least["alone"])).select("sa", "sb", "class_id", "n_links")
    return sketch.select("doc_id", "sa", "sb").join(known, ["sa", "sb"], "left").select(
        "doc_id", F.when(F.col("sa").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) >= 5),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 10 * both_ >= 8 * (cx.n + cy.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, member) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.member),
m AS (SELECT doc_id, min(member) AS class_id FROM r GROUP BY doc_id)
SELECT m.doc_id, class_id, (SELECT count(*) FROM e WHERE e.x = m.doc_id) AS n_links FROM m"""
}
