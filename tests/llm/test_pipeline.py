"""The pipeline: each stage works on what the one before kept, and keeps the columns of documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= before
        before = now
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert shards.count() == docs.count() and {r.shard for r in shards.collect()} <= set(range(8))


def test_stages_on_awkward_rows(spark):
    long = " ".join(f"word{i % 211}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27), (None, "no id here", "en", None, 10), (4, long, "en", "a", 9), (5, long + " end", "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score", "h", "node", "size", "copies", "key", "_h", "shard", "_id", "_copies", "_rows", "_own", "_nth", "_th", "_of", "_doc", "_source", "class_id", "class_h", "own_id", "row", "place", "at", "part", "_v", "_print", "q7", "zz top")
    for c in clashing:
        docs = docs.withColumn(c, F.concat(F.lit(f"mine {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for df, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and (n or out.count() == 0), name
            assert all(r[c] == f"mine {c} {'none' if r.doc_id is None else r.doc_id}" for r in out.collect() for c in clashing), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == n
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == sorted([(1, 0), (3, 27), (0, 10), (4, len(long))])
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == len(rows)
