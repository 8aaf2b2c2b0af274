"""Ingestion, model stages and question answering with scripted models."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioquery.operators import answering, enrichment, ingestion, models
from folioquery.plans import derived
from folioquery.sources import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers and models run in tasks

# ---- ingestion ----------------------------------------------------------------


def files(spark, names):
    return spark.createDataFrame(
        [(f"raw/{n}.pdf", n, f"sha-{n}", n.encode()) for n in names],
        "source string, doc_id string, sha1 string, content binary")


def read_pages(content, n):
    name = content.decode()
    if name == "closed":
        raise ingestion.OpenFailed("not a document")
    if name == "crash":
        raise KeyError("boom")
    return {"blank": ["", " "], "empty": []}.get(name, ["good text"] * 9)[:n]


def read_layout(content):
    if content == b"broken":
        raise RuntimeError("layout crashed")
    return [{"type": "text", "page_idx": 0, "text": content.decode(), "text_level": None,
             "table_caption": None, "table_body": None, "image_caption": None, "img_path": None}]


def test_every_file_gets_one_result(spark):
    names = ["good", "blank", "empty", "closed", "crash", "broken", "done"]
    done = spark.createDataFrame([("done",)], "doc_id string")
    meta = spark.createDataFrame([("Good Co", "eval/good.pdf", 0)], "company string, filename string, csv_ord long")
    results, reports = ingestion.ingest(files(spark, names), done, read_layout, read_pages, meta, out="o")
    got = {r.doc_id: r for r in results.collect()}
    assert {k: (r.status, r.error_code) for k, r in got.items()} == {
        "good": ("accepted", None), "blank": ("rejected", "DOCUMENT_QUALITY_REJECTED"),
        "empty": ("rejected", "DOCUMENT_QUALITY_REJECTED"), "closed": ("rejected", "DOCUMENT_QUALITY_REJECTED"),
        "crash": ("failed", "QUALITY_CHECK_FAILED"), "broken": ("failed", "PDF_PARSE_FAILED"),
        "done": ("skipped", None)}
    assert got["empty"].quality.error_code == "PDF_NO_PAGES"
    assert got["closed"].quality.error_code == "PDF_OPEN_FAILED"
    assert got["good"].quality.sample_pages == 5 and got["good"].output_path == "o/good"
    assert "layout crashed" in got["broken"].message and got["broken"].quality.passed
    assert got["done"].quality is None
    assert [(r.doc_id, r.company, r.sha1) for r in reports.collect()] == [("good", "Good Co", "sha-good")]


def test_quality_gate_can_be_off(spark):
    none = spark.createDataFrame([], "doc_id string")
    results, _ = ingestion.ingest(files(spark, ["blank"]), none, read_layout)
    row = results.first()
    assert (row.status, row.quality) == ("accepted", None)


# ---- prose rewriting ------------------------------------------------------------


class Script:
    """Replies per input text; an exception instance is raised."""

    def __init__(self, replies):
        self.replies = replies

    def reply(self, request):
        out = self.replies[request["text"]]
        if isinstance(out, Exception):
            raise out
        return json.dumps({"transformed_text": out}) if isinstance(out, str) else json.dumps(out)


def test_rewriting_keeps_numbers_and_survives_failures(spark):
    rows = [("d", 0, "content", "Revenue was $1,234."), ("d", 1, "serialized_table", "t"),
            ("d", 2, "content", "lost 55"), ("d", 3, "content", "down"), ("d", 4, "content", "odd"),
            ("d", 5, "content", "bare")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id long, type string, text string") \
        .withColumn("length_tokens", F.lit(10))
    script = Script({"Revenue was $1,234.": " Clean: $1,234. ", "lost 55": "lost", "down": RuntimeError("offline"),
                     "odd": {"other": 1}, "bare": "  "})
    out = enrichment.rewrite_chunks(chunks, script, "m")
    got = {r.chunk_id: r for r in out.collect()}
    assert got[0].text == "Clean: $1,234." and got[0].original_text == "Revenue was $1,234."
    assert got[0].transform.status == "transformed" and got[0].length_tokens == 7
    assert got[1].transform is None and got[1].text == "t"
    assert (got[2].text, got[2].transform.status, got[2].transform.reason, got[2].original_text) == (
        "lost 55", "validation_failed", "numeric_tokens_missing: 55", None)
    assert got[3].transform.status == "failed" and "offline" in got[3].transform.reason
    assert got[4].transform.status == "failed" and got[4].text == "odd"
    assert got[5].transform.reason == "empty_transformed_text"
    counts = {r.status: r.n for r in enrichment.transform_counts(out).collect()}
    assert counts == {"transformed": 1, "validation_failed": 2, "failed": 2}
    # A second run leaves the done chunk alone and tries the others again.
    assert {r.chunk_id for r in stages.pending_chunks(out).collect()} == {2, 3, 4, 5}
    again = enrichment.rewrite_chunks(out, Script({k: k for k in script.replies}), "m2")
    got = {r.chunk_id: r.transform.model for r in again.where("transform is not null").collect()}
    assert got == {0: "m", 2: "m2", 3: "m2", 4: "m2", 5: "m2"}


class Flaky:
    """Fails until the given attempt."""

    def __init__(self, good_at):
        self.good_at, self.calls = good_at, 0

    def reply(self, request):
        self.calls += 1
        if self.calls < self.good_at:
            raise ValueError("try again")
        return "{}"

    def usage(self, request, reply):
        return 3, 2


def test_retries_and_usage(spark):
    df = spark.createDataFrame([("x",)], "text string").coalesce(1)
    ok = models.ask(df, Flaky(3), ["text"], models.check_object).first().outcome
    assert (ok.error, ok.attempts, ok.tokens_in, ok.tokens_out) == (None, 3, 3, 2)
    bad = models.ask(df, Flaky(9), ["text"], models.check_object)
    assert bad.first().outcome.attempts == 3 and "try again" in bad.first().outcome.error
    assert models.usage_totals(bad).first().n_failed == 1
    with pytest.raises(ValueError):
        models.ask(df, Flaky(1), ["text"], models.check_object, retries=0)


@pytest.mark.parametrize("kind,value,good", [
    ("name", "x", True), ("name", ["x"], False), ("names", ["x"], True), ("names", "N/A", True),
    ("number", 5.5, True), ("number", True, False), ("boolean", False, True), ("boolean", "N/A", True),
    ("boolean", "yes", False), ("essay", "x", False)])
def test_answer_check(kind, value, good):
    reply = {"final_answer": value, "step_by_step_analysis": "", "reasoning_summary": "", "relevant_pages": [1]}
    if good:
        models.check_answer(reply, {"kind": kind})
    else:
        with pytest.raises(ValueError):
            models.check_answer(reply, {"kind": kind})


@pytest.mark.parametrize("ranks", [[{"reasoning": "r", "relevance_score": 1.1}], [], [{"relevance_score": 0.5}]])
def test_ranking_check(ranks):
    with pytest.raises(ValueError):
        models.check_rankings({"block_rankings": ranks}, {"texts": ["a"]})


def test_picture_class(spark):
    rows = [("TYPE: **Chart\nDATA: HAS_DATA",), ("type: Photo data: none",), ("nothing",)]
    kind, data = enrichment.picture_class(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(kind, data).collect()]
    assert got == [("chart", "HAS_DATA"), ("photo", "NO_DATA"), ("other", "NO_DATA")]


# ---- ranking and answering ----------------------------------------------------------


class BadRanker:
    def reply(self, request):
        if "b10" in request["texts"]:
            return json.dumps({"block_rankings": []})
        return json.dumps({"block_rankings": [{"reasoning": "r", "relevance_score": 0.5}] * len(request["texts"])})


def test_failed_rating_request_counts_zero(spark):
    rows = [("t", "q", i + 1, f"b{i}", 1.0 - i / 20) for i in range(12)]
    cands = spark.createDataFrame(rows, "task_id string, question string, rank int, text string, score double")
    out = {r.rank: r.relevance_score for r in answering.rank_candidates(cands, BadRanker(), top_n=12).collect()}
    assert out == {**{i: 0.5 for i in range(1, 11)}, 11: 0.0, 12: 0.0}


def test_sub_questions_fall_back_by_position(spark):
    df = spark.createDataFrame([({"b": "for b", "other": "zz"},), (None,)], "m map<string,string>")
    pick = answering.sub_question(F.col("m"), F.lit("a"), F.lit(1), F.lit("Which?"))
    assert [r[0] for r in df.select(pick).collect()] == ["zz", "For a, Which?"]
    pick = answering.sub_question(F.col("m"), F.lit("b"), F.lit(1), F.lit("Which?"))
    assert df.select(pick).first()[0] == "for b"


class EchoKind:
    """Answers with the report text's first number, citing a page that was not given."""

    def reply(self, request):
        return json.dumps({
            "step_by_step_analysis": "", "reasoning_summary": "r", "relevant_pages": [99],
            "final_answer": 7 if request["kind"] == "number" else "seven"})


class FailingCombiner:
    def reply(self, request):
        raise RuntimeError("no combination")


def test_question_paths(spark):
    texts = {"a": ["alpha revenue 7", "alpha people"], "b": ["beta revenue 9"]}
    chunks = spark.createDataFrame(
        [(d, i, "content", i + 1, t, 3) for d, ts in texts.items() for i, t in enumerate(ts)],
        "doc_id string, chunk_id long, type string, page int, text string, length_tokens int")
    pages = chunks.select("doc_id", "page", F.concat(F.lit("page of "), "text").alias("text"))
    questions = spark.createDataFrame(
        [(1, "alpha revenue?", "number", ["a"]), (2, "which is larger?", "name", ["a", "b"]),
         (3, "who?", "name", []), (4, "alpha?", "essay", ["a"])],
        "question_id int, question string, kind string, doc_ids array<string>")
    sha = spark.createDataFrame([("a", "sa")], "doc_id string, sha1 string")
    vectors, failed = enrichment.embedded_documents(
        enrichment.embed_chunks(chunks, models.HashingEmbedder(16)))
    assert failed.isEmpty()
    kit = answering.Models(answerer=EchoKind(), embedder=models.HashingEmbedder(16))
    got = {r.question_id: r for r in
           answering.answer_questions(questions, chunks, pages, vectors, sha, kit).collect()}
    assert (got[1].final_answer, got[1].relevant_pages, got[1].error) == ("7", [1, 2], None)
    assert [tuple(r) for r in got[1].references] == [("sa", 1), ("sa", 2)]
    assert got[1].contexts[0] == "page of alpha revenue 7"
    assert (got[2].final_answer, got[2].relevant_pages) == ("a", [])
    assert got[2].sub_answers == {"a": "7", "b": "7"}
    assert {tuple(r) for r in got[2].references} == {("sa", 1), ("sa", 2), ("", 1)}
    assert len(got[2].contexts) == 3
    assert (got[3].final_answer, got[3].error) == ("N/A", None)
    assert got[4].final_answer == "N/A" and "unknown kind" in got[4].error and got[4].references == []
    kit = answering.Models(answerer=EchoKind(), combiner=FailingCombiner(), embedder=models.HashingEmbedder(16))
    row = answering.answer_questions(
        questions.where("question_id = 2"), chunks, pages, vectors, sha, kit).first()
    assert row.final_answer == "N/A" and "no combination" in row.error


# ---- sources -----------------------------------------------------------------------------


def test_files_of_every_stage(spark, tmp_path):
    (tmp_path / "meta.csv").write_text('﻿"sha1","company","filename"\n"s","A ""x"" Inc.","dev/A.pdf"\n', "utf-8")
    meta = stages.company_metadata(spark, str(tmp_path / "meta.csv")).first()
    assert (meta.sha1, meta.company, meta.filename) == ("s", 'A "x" Inc.', "dev/A.pdf")
    (tmp_path / "q.json").write_text(json.dumps(
        [{"text": "", "question": "a?", "schema": "name"}, {"text": "b?", "kind": "number"}, {"text": "c?"}]))
    rows = stages.questions(spark, str(tmp_path / "q.json"), limit=3).orderBy("question_id").collect()
    assert [(r.question, r.kind) for r in rows] == [("a?", "name"), ("b?", "number"), ("c?", "name")]
    folder = tmp_path / "layout" / "rep"
    folder.mkdir(parents=True)
    (folder / "rep_content_list.json").write_text(json.dumps([{"type": "text", "page_idx": 0, "text": "x"}]))
    layout = stages.layout_files(spark, str(tmp_path / "layout")).first()
    assert layout.doc_id == "rep" and layout.entries[0].text == "x"
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    pdf = stages.pdf_files(spark, str(tmp_path)).first()
    assert pdf.doc_id == "b" and len(pdf.sha1) == 40


def test_resume_helpers(spark):
    tables = spark.createDataFrame([("d", f"t{i}", None if i != 1 else "x") for i in range(12)],
                                   "doc_id string, table_id string, serialized string")
    assert [r.table_id for r in stages.pending_tables(tables, 2).orderBy("table_id").collect()] == ["t0", "t2"]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, n int")
    assert {tuple(r) for r in stages.merge_latest(old, new, ["doc_id"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_html_reader():
    from folioquery.sources.html import page_entries

    got = page_entries(
        "<html><head><title>no</title></head><body><nav><li>menu</li></nav><h2>Head &amp; more</h2><p>One<br>two"
        "<p>three<table><caption>Cap</caption><tr><td>1</td></tr></table><img src='i.png' alt='Pic'></body>")
    brief = [(e["type"], e["text"], e["text_level"], e["table_body"], e["img_path"]) for e in got]
    assert brief == [
        ("discarded", "menu", None, None, None), ("text", "Head & more", 2, None, None),
        ("text", "One two", None, None, None), ("text", "three", None, None, None),
        ("table", None, None, "<table><tr><td>1</td></tr></table>", None), ("image", None, None, None, "i.png")]
    assert got[4]["table_caption"] == ["Cap"] and got[5]["image_caption"] == ["Pic"]


def test_derived_rules_cover_every_element_type(spark):
    types = {r.type for r in derived.report_elements(spark, "/root/testdata/sf0.001").select("type").distinct().collect()}
    assert types == {"heading", "paragraph", "table", "picture", "equation"}


class FailsOn:
    def __init__(self, word):
        self.word, self.good = word, models.HashingEmbedder(8)

    def embed(self, texts):
        if any(self.word in t for t in texts):
            raise RuntimeError("refused")
        return self.good.embed(texts)


def test_index_resumes_and_rebuilds(spark, tmp_path):
    from folioquery.operators import lexical
    from folioquery.operators.indexing import read_index, update_index

    rows = [("a", 0, "one two"), ("a", 1, "two three"), ("b", 0, "bad words"), ("c", 0, "x"), ("c", 2, "y")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id long, text string") \
        .withColumn("length_tokens", F.lit(2))
    path = str(tmp_path / "index")
    status = {r.doc_id: r.status for r in update_index(chunks, path, FailsOn("bad"), "m1").collect()}
    assert status == {"a": "indexed", "b": "failed", "c": "failed"}
    status = {r.doc_id: r.status for r in update_index(chunks, path, FailsOn("none"), "m2").collect()}
    assert status == {"a": "skipped", "b": "indexed", "c": "failed"}
    update_index(chunks.where("doc_id = 'a'"), path, FailsOn("none"), "m3", force=True)
    index, vectors, meta = read_index(spark, path)
    assert {(r.doc_id, r.n_chunks, r.dims, r.model) for r in meta.collect()} == {("a", 2, 8, "m3"), ("b", 1, 8, "m2")}
    assert vectors.count() == 3 and index.count() == 3
    asked = spark.createDataFrame([("a", 1, "three")], "route string, question_id int, text string")
    assert {r.chunk_id for r in lexical.bm25_topk(index, asked, 5).collect()} == {0, 1}


class Judge:
    def reply(self, request):
        return json.dumps({"faithfulness": 0.5, "answer_relevancy": None, "context_precision": 1})


def test_judge_metrics(spark):
    from folioquery.operators import evaluation

    rows = spark.createDataFrame([("q", ["c"], "r", "g")],
                                 "user_input string, retrieved_contexts array<string>, response string, reference string")
    rated = evaluation.rate_answers(rows, Judge())
    names = ["faithfulness", "answer_relevancy", "context_precision"]
    assert tuple(evaluation.metric_means(rated, names).first()) == (0.5, None, 1.0)
