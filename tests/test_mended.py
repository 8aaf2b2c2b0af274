"""Faults that were found by probing, each with the rows that showed it."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioquery.operators import enrichment, lexical, models, vectors
from folioquery.operators.elements import attach_company
from folioquery.operators.parents import parent_pages
from folioquery.operators.runner import run_chain
from folioquery.session import is_local
from folioquery.sources import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model stand-in runs in tasks


def test_candidates_without_a_page_keep_their_context(spark):
    cands = spark.createDataFrame([("d", None, 1), ("d", 2, 2)], "doc_id string, page int, rank int")
    pages = spark.createDataFrame([("d", None, "loose"), ("d", 2, "two"), ("e", None, "x")],
                                  "doc_id string, page int, text string")
    got = [(r.page, r.page_rank, r.text) for r in parent_pages(cands, pages, []).orderBy("page_rank").collect()]
    assert got == [(None, 1, "loose"), (2, 2, "two")]


def test_last_metadata_row_of_a_file_counts(spark):
    docs = spark.createDataFrame([("x", "in/a.pdf"), ("y", "in/b.pdf")], "doc_id string, source_pdf string")
    meta = spark.createDataFrame([("a.pdf", "old", 0), ("old/a.pdf", "new", 5), ("a.pdf", "mid", 2)],
                                 "filename string, company string, csv_ord long")
    assert {r.doc_id: r.company for r in attach_company(docs, meta).collect()} == {"x": "new", "y": None}


def test_a_failed_write_leaves_the_stage_as_it_was(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.write_stage(spark.range(3), path)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        stages.write_stage(bad, path)
    assert stages.read_stage(spark, path).count() == 3
    stages.write_stage(spark.range(5), path)
    assert stages.read_stage(spark, path).count() == 5


def test_stage_files_with_blanks_in_their_names(spark, tmp_path):
    (tmp_path / "A b.json").write_text('{"n": 1}')
    (tmp_path / "c%20d.json").write_text('{"n": 2}')
    got = stages.json_documents(spark, str(tmp_path), "n int").collect()
    assert {(r.doc_id, r.n) for r in got} == {("A b", 1), ("c%20d", 2)}


class Sizes:
    """Vectors whose size the text names."""

    def embed(self, texts):
        return [(i, [1.0] * int(t)) for i, t in enumerate(texts)]


def test_vectors_of_another_size_are_refused(spark):
    chunks = spark.createDataFrame(
        [("a", 0, "3", 1), ("a", 1, "3", 1), ("b", 0, "2", 1), ("b", 1, "3", 1)],
        "doc_id string, chunk_id long, text string, length_tokens int")
    got = enrichment.embed_chunks(chunks, Sizes(), batch_size=1)
    complete, failed = enrichment.embedded_documents(got)
    assert {r.doc_id for r in complete.collect()} == {"a"}
    assert [(r.doc_id, r.error) for r in failed.collect()] == [("b", "ValueError: a vector of size 2")]
    got = enrichment.embed_chunks(chunks, Sizes(), batch_size=1, dims=2)
    assert {(r.doc_id, r.chunk_id) for r in got.where("error is null").collect()} == {("b", 0)}


def test_sparse_ids_do_not_make_more_blocks(spark):
    rng = np.random.default_rng(1)
    vs = rng.normal(size=(300, 6))
    ids = [int(i) * 1_000_003 for i in range(300)]
    chunks = spark.createDataFrame([("r", i, v.tolist()) for i, v in zip(ids, vs)],
                                   "route string, chunk_id long, embedding array<double>")
    asks = spark.createDataFrame([("r", q, vs[q].tolist()) for q in range(5)],
                                 "route string, question_id int, embedding array<double>")
    hits = vectors.cosine_topk(chunks, asks, 7, chunks_per_block=50, questions_per_block=2)
    for q in range(5):
        scores = np.round(vs @ vs[q], 6)
        want = [ids[k] for k in np.lexsort((ids, -scores))[:7]]
        assert [r.chunk_id for r in hits.where(F.col("question_id") == q).orderBy("rank").collect()] == want


def test_no_plan_deals_rows_in_turn_or_by_route_alone(spark):
    chunks = spark.createDataFrame([("r", 1, "x y")], "route string, chunk_id long, text string")
    hits = lexical.bm25_topk(lexical.build_index(chunks), chunks.select("route", F.col("chunk_id").alias("question_id"), "text"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [route#" in x]
    assert joins and "RoundRobin" not in plan
    # only the tables with one row per route (LeftOuter: sizes and vocabulary sizes) meet by route alone
    assert not [x for x in joins if "LeftOuter" not in x and "," not in x.split("]")[0]]


def test_only_local_sessions_may_use_a_local_folder():
    assert is_local("local") and is_local("local[4]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("spark://host:7077") and not is_local("yarn")


def test_a_chain_stops_at_the_first_failure(spark, tmp_path):
    path = str(tmp_path / "a")

    def broken():
        raise ValueError("no input")

    got = run_chain(spark, [("a", lambda: stages.write_stage(spark.range(2), path)), ("b", broken), ("c", broken)])
    assert [tuple(r) for r in got.collect()] == [("a", "done", None), ("b", "failed", "ValueError: no input"), ("c", "not run", None)]
    assert stages.read_stage(spark, path).count() == 2


class Counted:
    """Counts its calls in a file; the text ``poison`` ends the task unless it has been cured."""

    def __init__(self, path, cured):
        self.path, self.cured = path, cured

    def reply(self, request):
        with open(self.path, "a") as f:
            f.write(request["text"] + "\n")
        if request["text"] == "poison" and not self.cured:
            raise SystemExit("killed")
        if request["text"] == "odd" and not self.cured:
            raise ValueError("no reply")
        return '{"ok": 1}'


def test_a_killed_model_stage_goes_on_where_it_stopped(spark, tmp_path):
    texts = [f"t{i}" for i in range(40)] + ["poison", "odd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    log, run = str(tmp_path / "calls"), str(tmp_path / "run")
    parts = {r.text: r.p for r in df.select("text", F.pmod(F.xxhash64("id"), F.lit(8)).alias("p")).collect()}
    with pytest.raises(Exception):
        models.ask_durably(df, ["id"], Counted(log, False), ["text"], models.check_object, run, batches=8, retries=1)
    kept = {t for t in texts if parts[t] < parts["poison"]} - {"odd"}
    assert kept and spark.read.parquet(run).where("outcome.error is null").count() == len(kept)
    open(log, "w").close()
    got = models.ask_durably(df, ["id"], Counted(log, True), ["text"], models.check_object, run, batches=8, pool=3)
    assert {(r.outcome.reply, r.outcome.error) for r in got.collect()} == {('{"ok": 1}', None)} and got.count() == len(texts)
    assert sorted(open(log).read().split()) == sorted(set(texts) - kept)
    open(log, "w").close()
    models.ask_durably(df, ["id"], Counted(log, True), ["text"], models.check_object, run, batches=8)
    assert open(log).read() == ""


def test_rows_to_skip_are_not_asked(spark, tmp_path):
    log = str(tmp_path / "calls")
    df = spark.createDataFrame([("a", True), ("b", False)], "text string, no boolean")
    got = {r.text: r.outcome for r in models.ask(df, Counted(log, True), ["text"], models.check_object, skip="no").collect()}
    assert open(log).read() == "b\n" and (got["a"].reply, got["a"].error, got["a"].attempts) == (None, None, 0)
