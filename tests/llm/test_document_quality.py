"""Quality classifier and quality rules."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm import quality_classifier as C
from folioquery.llm import quality_rules as R
from folioquery.llm.common import HashCache, read

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, kept int"
ODD = [None, "", "   \n", "one", "a b c d e f g h i j", "w " * 50_000, "x#y|z " * 12, "line\nline\nline\n"]


def odd_rows(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", None, None)], DOCS)


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    model = C.fit(docs, C.labelled_sample(spark, SF))
    got = C.classify(docs, model).join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.predicted == held.quality).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    assert model.pairs and got.score.between(0, 1).all()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    sample = [r.doc_id for r in C.labelled_sample(spark, SF).collect()]
    assert sample and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in sample)


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction only
    model = C.train(x, y)
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_repeated_ids_add_no_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(1, 9)] * 2 + [(1, f"other {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(C, "train", lambda x, y: seen.append((x.tolist(), y.tolist())))
    C.fit(docs.repartition(4), labels)
    C.fit(docs.repartition(2), labels)
    assert len(seen[0][0]) == 8 and seen[0] == seen[1]


def test_classifier_on_odd_rows(spark):
    docs = odd_rows(spark)
    model = C.fit(docs, spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int"))
    got = C.classify(docs, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    none = C.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in C.classify(docs, none).collect()} == {0.5}
    assert C.classify(docs.limit(0), model).count() == 0


def plain_metrics(text):
    """Base facts by their definition."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, spots = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            spots.update(k + d for k in at for d in range(5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(spots) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(spots), failed


@pytest.mark.parametrize("text", [
    *ODD, "a b c d e a b c d e", "a a a a a a a", "p q r s t u p q r s t v w x y", "é ü\u00a0ö\x1fz " * 4,
    "l1\n l1\nl1\n\n \nl1", "\u2028 x y z " * 6,
])
def test_base_rules_equal_their_definition(text):
    got = R.describe(text, HashCache(), np.zeros(R.BUCKETS))
    assert got[:6] == plain_metrics(text)
    assert got[7] == (not got[5])


def test_rules_catch_junk_and_keep_clean(spark):
    got = R.judge_documents(read(spark, SF, "documents"), SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    method = got[~got.base_failed]
    assert method[method.quality == 1].kept.mean() > 0.99
    assert method[method.quality == 0].kept.mean() < 0.2


def test_ratios_by_hand(spark):
    docs = spark.createDataFrame([(1, "good word"), (2, "bad word"), (3, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    counts = R.bucket_counts(docs, trusted).toPandas()
    # 7 and 6 n-grams of three and four bytes in nine, 6 and 5 in eight
    assert (counts.raw.sum(), counts.target.sum()) == (24, 13)
    ratio = R.log_ratios(counts)
    of = {t: R.describe(t, HashCache(), ratio)[6] for t in ("good word", "bad word")}
    assert of["good word"] > of["bad word"]
    assert not R.log_ratios(counts.assign(target=0)).any()


def test_rules_on_odd_rows(spark):
    docs = odd_rows(spark)
    got = docs.select("doc_id", R.verdict(F.col("text"), np.zeros(R.BUCKETS)).alias("m")).select("doc_id", "m.*").collect()
    assert len(got) == len(ODD) + 2
    kept = R.keep_good(docs, SF)
    assert kept.columns == docs.columns and kept.count() <= len(ODD) + 2
    assert R.judge_documents(docs.limit(0), SF).count() == 0


def test_every_trusted_document_counts(spark, tmp_path):
    spark.range(31_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    want = [i for i in range(31_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    trusted = R.trusted_ids(spark, str(tmp_path))
    docs = spark.range(31_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    assert len(want) > 20_000 and R.bucket_counts(docs, trusted).toPandas().target.sum() == len(want)


def test_buckets_grow_with_the_corpus():
    assert [R.bucket_bits(n) for n in (0, 1 << 27, 1 << 33, 1 << 40)] == [14, 14, 17, 21]
    assert R.ngram_buckets("some text of a corpus", 21).max() >= R.BUCKETS
    assert R.describe("good words", HashCache(), np.ones(1 << 17))[6] == 1
