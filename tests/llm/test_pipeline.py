"""The corpus pipeline, stage by stage, on odd rows and on the smallest tables."""

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, fn) in enumerate(P.STAGES):
        fn(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    private = spark.read.parquet(str(tmp_path / "pii")).filter(F.col("text").rlike(r"[a-z0-9]@[a-z]|\+1 \("))
    assert private.isEmpty()
    assert P.run(spark, SF).count() == sizes[-1]


def test_stages_on_odd_rows_and_on_none(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "src1", 0, 1.0), (2, "good words " * 20, "en", "src1", 5, 1.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double")
    for df in (docs, docs.limit(0)):
        for i, (_, fn) in enumerate(P.STAGES):
            out = fn(spark, df, SF)
            assert out.count() <= 2 * len(rows) and (i == len(P.STAGES) - 1 or out.columns == df.columns)
