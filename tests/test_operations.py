"""Index files, the attempt ledger, the reply log, and judge metrics that are no numbers."""

import json
import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioquery.operators import evaluation, indexing, models
from folioquery.streaming import ingest as I

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers and models run in tasks


class Unit:
    def embed(self, texts):
        return [(i, [1.0, 0.0]) for i in range(len(texts))]


def test_index_reads_only_buckets_of_asked_reports_and_splits_large_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "FILE_CHUNKS", 10)
    rows = [("big", i, f"t{i}") for i in range(45)] + [(f"r{j}", i, "x y") for j in range(40) for i in range(2)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id long, text string").withColumn("length_tokens", F.lit(2))
    path = str(tmp_path / "index")
    assert {r.status for r in indexing.update_index(chunks, path, Unit(), "m").collect()} == {"indexed"}
    asked = spark.createDataFrame([("big",), ("unknown",)], "doc_id string")
    lexical, vectors, meta = indexing.read_index(spark, path, asked)
    assert (lexical.count(), vectors.count(), [r.doc_id for r in meta.collect()]) == (45, 45, ["big"])
    current = indexing.asked_reports(spark, path, asked)
    opened = {r.file for r in indexing.opened_files(spark, path, "lexical", current).collect()}
    everything = {r.file for r in indexing.opened_files(spark, path, "lexical").collect()}
    assert 5 <= len(opened) < len(everything) and opened <= everything  # 45 chunks, ten to a file


def test_rows_without_a_snapshot_are_not_read(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "x")], "doc_id string, chunk_id long, text string").withColumn("length_tokens", F.lit(1))
    path = str(tmp_path / "index")
    indexing.update_index(chunks, path, Unit(), "m").collect()
    # a run that died before it published its batch
    spark.read.parquet(f"{path}/lexical").drop("batch", "bucket").withColumn("doc_id", F.lit("dead")).write.partitionBy().parquet(
        f"{path}/lexical/batch=7/bucket=1")
    assert {r.doc_id for r in indexing.indexed_reports(spark, path).collect()} == {"a"}
    assert {r.route for r in indexing.read_index(spark, path)[0].collect()} == {"a"}


class Refuses:
    def embed(self, texts):
        raise RuntimeError("no")


def test_a_run_without_a_sound_report_leaves_no_index(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "x")], "doc_id string, chunk_id long, text string").withColumn("length_tokens", F.lit(1))
    path = str(tmp_path / "index")
    assert [r.status for r in indexing.update_index(chunks, path, Refuses(), "m").collect()] == ["failed"]
    assert indexing.indexed_reports(spark, path).count() == 0
    assert [r.status for r in indexing.update_index(chunks, path, Unit(), "m").collect()] == ["indexed"]


def test_one_question_without_a_vector_costs_no_other_its_own(spark):
    from folioquery.operators.enrichment import embed_texts

    class Picky:
        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("cannot")
            return [(i, [3.0, 4.0]) for i in range(len(texts))][:: -1]

    class Short:
        def embed(self, texts):
            return [(0, [1.0])] * (len(texts) - 1)

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "q string").coalesce(1)
    got = {r.q: (r.embedding, r.embedding_error) for r in embed_texts(df, "q", Picky()).collect()}
    assert got["bad"] == (None, "ValueError: cannot") and got["good"][1] is None and got[None][1] is None
    assert got["good"][0] == pytest.approx([0.6, 0.8])
    assert all(r.embedding is None and r.embedding_error for r in embed_texts(df, "q", Short()).collect())


def files(spark, names):
    return spark.createDataFrame([(f"/in/{n}.pdf", n, "s", n.encode()) for n in names], "source string, doc_id string, sha1 string, content binary")


def refuse_bad(content):
    if content.startswith(b"bad"):
        raise ValueError("bad")
    return [{"type": "text", "page_idx": 0, "text": "t", "text_level": None, "table_caption": None, "table_body": None,
             "image_caption": None, "img_path": None}]


def test_ledger_over_restarts_and_retries(spark, tmp_path):
    out, box = str(tmp_path / "out"), str(tmp_path / "box")

    def run(names, reader=refuse_bad, **kw):
        files(spark, names).coalesce(1).write.mode("append").parquet(box)
        I.run_ingest(spark.readStream.schema(files(spark, ["x"]).schema).option("maxFilesPerTrigger", 1).parquet(box), out, reader, stall_limit=2, **kw)

    def state():
        return {r.doc_id: (r.tries, r.status) for r in I.attempts(spark, out).collect()}

    run(["a", "bad1"])
    assert state() == {"a": (1, "accepted"), "bad1": (1, "failed")}
    run(["b", "bad2", "a"])  # a is known: it is passed over, and counts no attempt
    assert state() == {"a": (1, "accepted"), "bad1": (1, "failed"), "b": (1, "accepted"), "bad2": (1, "failed")}
    given = files(spark, ["a", "b", "bad1", "bad2"])
    cured = I.retry_failed(given.where("doc_id <> 'bad1'"), out, lambda c: refuse_bad(b"ok"), max_tries=3)
    assert cured >= 1 and state()["bad2"] == (2, "accepted")
    assert I.retry_failed(given, out, refuse_bad, max_tries=3) == 2 and state()["bad1"] == (3, "failed")
    assert [r.doc_id for r in I.dead_letters(spark, out).collect()] == ["bad1"]
    assert I.retry_failed(given, out, refuse_bad, max_tries=3) == 0


def test_run_stops_when_nothing_comes_of_it(spark, tmp_path):
    out, box = str(tmp_path / "out"), str(tmp_path / "box")
    for i in range(5):
        files(spark, [f"bad{i}"]).coalesce(1).write.mode("append").parquet(box)
    stream = lambda: spark.readStream.schema(files(spark, ["x"]).schema).option("maxFilesPerTrigger", 1).parquet(box)
    with pytest.raises(Exception, match="without a report"):
        I.run_ingest(stream(), out, refuse_bad, stall_limit=3)
    assert I.attempts(spark, out).count() == 3
    I.run_ingest(stream(), out, lambda c: refuse_bad(b"ok"), stall_limit=3)  # goes on where it stopped
    assert {r.status for r in I.attempts(spark, out).collect()} <= {"accepted", "failed"} and I.ingested(spark, out).count() >= 2


class Fails:
    def __init__(self, bad):
        self.bad = bad

    def reply(self, request):
        if request["text"] in self.bad:
            raise RuntimeError("no")
        return json.dumps({"said": request["text"]})


def test_reply_log_is_compacted_without_loss(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], "id int, text string")

    def ask(rows, bad):
        return models.ask_durably(rows, ["id"], Fails(bad), ["text"], models.check_object, path, batches=2, retries=1)

    def held():
        return {r.id: (r.outcome.error is None, r.calls) for r in models.latest_replies(spark, path, ["id"]).collect()}

    assert models.latest_replies(spark, path, ["id"]) is None
    models.compact_replies(spark, path, ["id"])
    ask(df.where("id < 3"), {"a"})
    models.compact_replies(spark, path, ["id"])
    assert held() == {0: (False, 1), 1: (True, 1), 2: (True, 1)}
    ask(df, {"d"})
    assert held() == {0: (True, 2), 1: (True, 1), 2: (True, 1), 3: (False, 1)}
    models.compact_replies(spark, path, ["id"])
    got = ask(df, set())
    assert held() == {0: (True, 2), 1: (True, 1), 2: (True, 1), 3: (True, 2)}
    assert {(r.id, json.loads(r.outcome.reply)["said"]) for r in got.collect()} == set(enumerate("abcd"))


class Marks:
    def reply(self, request):
        q = request["user_input"]
        return json.dumps({"faithfulness": {"a": math.nan, "b": "0.5", "c": "none", "d": 1}[q], "context_precision": 0.25})


def test_marks_that_are_no_numbers_count_in_no_mean(spark):
    answers = spark.createDataFrame([(q, "x") for q in "abcd"] + [("e", "N/A"), ("f", "x")], "question string, final_answer string")
    gold = answers.select("question", F.array(F.struct(F.lit("x").alias("text"))).alias("golds"))
    contexts = spark.createDataFrame([(q, 0, "t") for q in "abcde"], "question string, ordinal int, text string")
    rows = {r.verdict: r for r in evaluation.judge_report(answers, gold, contexts, Marks()).collect()}
    assert {v: r.n_rows for v, r in rows.items()} == {"rated": 4, "na": 1, "no_contexts": 1, "all": 6}
    assert (rows["all"].faithfulness, rows["all"].n_faithfulness, rows["rated"].context_precision) == (0.75, 2, 0.25)
    assert rows["all"].answer_relevancy is None and rows["na"].faithfulness is None
