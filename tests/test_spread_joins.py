"""Tables that grow with questions, chunks or terms are joined by a shuffle, however small their files are."""

import re

from pyspark.sql import functions as F

from folioquery.operators import answering, blocks, enrichment, lexical, models, routing
from folioquery.sources import tables

GROWING = {"question_id", "task_id", "chunk_id", "term", "page", "_page", "rank"}


def broadcast_keys(plan):
    """Names of the keys of every join that would send a side to all tasks."""
    joins = re.findall(r"BroadcastHashJoin (.*)", re.sub(r"xxhash64\(.*?\)", "salt", plan))
    return [set(re.findall(r"(\w+)#\d+", keys)) for keys in joins]


def test_answers_send_no_growing_table_to_every_task(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return tables.stage(df, name)

    for module in (answering, enrichment, lexical, models, routing):
        monkeypatch.setattr(module, "stage", seen)
    chunks = tables.stage(spark.createDataFrame(
        [(d, i, i + 1, f"{d} account {i} holds {7 * i}", 5) for d in ("alpha", "beta") for i in range(4)],
        "doc_id string, chunk_id long, page int, text string, length_tokens int"), "chunks")
    metadata = spark.createDataFrame([("alpha", "alpha.pdf", 0), ("beta", "beta.pdf", 1)], "company string, filename string, csv_ord long")
    asked = spark.createDataFrame(
        [(1, "account 2 of alpha?", "number"), (2, "which holds more, alpha or beta?", "name")],
        "question_id int, question string, kind string")
    routed = routing.route_questions(tables.stage(asked, "asked"), routing.vocabulary(metadata, chunks))
    plans.append(("routed", routed._jdf.queryExecution().executedPlan().toString()))
    vectors, _ = enrichment.embedded_documents(enrichment.embed_chunks(chunks, models.HashingEmbedder()))
    sha = spark.createDataFrame([("alpha", "sa")], "doc_id string, sha1 string")
    answers = answering.answer_questions(
        tables.stage(routed, "given"), chunks, chunks.select("doc_id", "page", "text"), vectors, sha)
    plans.append(("answers", answers._jdf.queryExecution().executedPlan().toString()))
    found = {r.question_id: r.doc_ids for r in answers.collect()}
    assert found == {1: ["alpha"], 2: ["alpha", "beta"]}
    assert {"vectors", "sparse-topk", "block-terms", "candidates", "answers"} <= {name for name, _ in plans}
    sent = [(name, keys & GROWING) for name, plan in plans for keys in broadcast_keys(plan) if keys & GROWING]
    assert not sent


def test_facts_of_routes_meet_their_rows_in_a_shuffle(spark):
    rows = tables.stage(spark.range(100).select(F.lit("r").alias("route"), F.col("id").alias("chunk_id")), "rows")
    facts = tables.stage(spark.createDataFrame([("r", 7)], "route string, n int"), "facts")
    joined = blocks.with_route_facts(rows, facts, "chunk_id")
    assert not broadcast_keys(joined._jdf.queryExecution().executedPlan().toString())
    assert joined.agg(F.count("*"), F.sum("n")).first()[:] == (100, 700)
