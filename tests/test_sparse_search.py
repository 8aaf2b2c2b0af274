"""The sparse search against the ranking function over every chunk, and its plan."""

import random
import re

import pytest
from test_retrieval import bm25

from folioquery.operators import lexical

WORDS = [f"w{i}" for i in range(60)]


def zipf(rng, n):
    return " ".join(WORDS[min(int(rng.paretovariate(0.7)) - 1, 59)] for _ in range(n))


def search(spark, chunks, asks, k):
    index = lexical.build_index(spark.createDataFrame(chunks, "route string, chunk_id long, text string").repartition(3))
    hits = lexical.bm25_topk(index, spark.createDataFrame(asks, "route string, question_id int, text string"), k)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault((r.route, r.question_id), []).append((r.chunk_id, r.score))
    return got, index


def right(got, chunks, asks, k):
    for route, q, text in asks:
        texts = {i: t for r, i, t in chunks if r == route}
        want = sorted(bm25(texts, text).items(), key=lambda p: (-p[1], p[0]))[:k]
        assert [c for c, _ in got[route, q]] == [c for c, _ in want], (route, q)
        assert [s for _, s in got[route, q]] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 8)])
def test_pruned_search_equals_all_scores(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical, "SEED_POSTINGS", 1)
    monkeypatch.setattr(lexical, "IDLE_SHARE", 1.0)
    rng = random.Random(seed)
    chunks = [("a", i, zipf(rng, rng.randint(0, 30))) for i in range(220)] + [("b", i, zipf(rng, 5)) for i in range(6)]
    # verbatim passages, repeated terms, terms nobody has, and none at all
    asks = [("a", q, chunks[q * 7][2]) for q in range(12)] + [("a", 90, "w0 w0 w1 w59 w59"), ("a", 91, "nowhere"), ("a", 92, ""), ("b", 0, "w0 w3")]
    got, _ = search(spark, chunks, asks, k)
    right(got, chunks, asks, k)


def test_ties_at_zero_and_negative_weights(spark):
    # "half" is in exactly half of the chunks: its idf is 0, so its matches tie with chunks that match nothing
    chunks = [("z", i, "half x" + str(i) if i % 2 else "y" + str(i)) for i in range(40)]
    # one word everywhere: the mean idf is negative and so are all weights
    chunks += [("n", i, "same") for i in range(30)]
    asks = [("z", 0, "half"), ("z", 1, "half x7"), ("n", 0, "same"), ("n", 1, "other")]
    got, _ = search(spark, chunks, asks, 10)
    right(got, chunks, asks, 10)


def test_plan_has_no_row_for_a_chunk_without_a_match(spark):
    rng = random.Random(4)
    chunks = [("a", i, zipf(rng, 12)) for i in range(60)]
    _, index = search(spark, chunks, [("a", 0, "w1 w2")], 3)
    hits = lexical.bm25_topk(index, spark.createDataFrame([("a", 0, "w1 w2")], "route string, question_id int, text string"), 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapGroups" not in plan and "CoGroup" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_postings_are_summed_in_blocks(spark, monkeypatch):
    """Many small blocks of chunks and questions give the best of all; nothing is dealt out by question and chunk."""
    monkeypatch.setattr(lexical, "CHUNKS_PER_BLOCK", 9)
    monkeypatch.setattr(lexical, "QUESTIONS_PER_BLOCK", 3)
    plans, stage = {}, lexical.stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(lexical, "stage", seen)
    rng = random.Random(7)
    chunks = [("a", i, zipf(rng, rng.randint(0, 12))) for i in range(150)] + [("b", i, "w1 x") for i in range(5)]
    chunks += [("a", 150, "lonely")]
    asks = [("a", q, chunks[q * 11][2] + " w2 w2") for q in range(10)] + [("a", 90, "lonely"), ("a", 91, "w0"), ("b", 0, "x y")]
    got, _ = search(spark, chunks, asks, 6)
    right(got, chunks, asks, 6)
    assert not re.search(r"partitioning\([^)]*question_id#\d+, chunk_id#", plans["sparse-topk"])
