"""The pipeline's stages in order, each on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, docs_of
from tidelane.llm import jaccard, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        if k == 0:
            assert {r.doc_id for r in docs.collect()} == kept
        if k == 2:
            leads = {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in before.collect()])}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(leads)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= before.count()
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in docs.collect()}


def test_stages_on_awkward_rows(spark, sf_dir):
    line = "one more line of words that is long enough to be kept by all of the rules there are in this test {}"
    texts = [None, "", " \n ", "one", *("\n".join(line.format(x) + f" {x}" * 5 for x in (f"w{i}a", f"w{i}b", f"w{i}c")) for i in range(6))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[5]), (None, texts[6]), (None, None)]
    docs = docs_of(spark, rows)
    for name in ("kept", "lines_", "sa", "words", "n_tokens", "repeats", "of", "lead", "n", "class_id"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() <= docs.count()
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.columns == corpus_pipeline.COLUMNS and none.count() == 0
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, docs.limit(0), sf_dir).count() == 0
    assert all(r.text and r.repeats >= 1 for r in last(spark, docs, sf_dir).collect())
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.decontaminate_stage(spark, docs, sf_dir).collect()) == sorted(i or -1 for i, _ in rows)
    assert not any(r.text is None or len(r.text.split()) < 20 for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect())


def test_one_of_repeated_rows_stays(spark, sf_dir):
    rows = docs_of(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words")])
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, rows, sf_dir).collect()) == [1, 3]
    assert jaccard.jaccard_join(rows).count() == 4
