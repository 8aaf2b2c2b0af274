import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators import fusion, lexical, rerank, vectors

WORDS = "alpha beta gamma delta eps zeta eta theta iota the of and 12 1,000".split()


def bm25(chunks, query):
    toks = {c: re.findall(r"\d+(?:[.,]\d+)*|[a-z][a-z0-9]*", t.lower()) for c, t in chunks.items()}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for c, t in toks.items():
        s = 0.0
        for w in re.findall(r"\d+(?:[.,]\d+)*|[a-z][a-z0-9]*", query.lower()):
            f = t.count(w)
            s += idf.get(w, 0.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        out[c] = round(s, 6)
    return out


@pytest.mark.parametrize("per_block", [3, 1000])
def test_bm25_equals_brute_force(spark, per_block):
    rng = random.Random(7)
    routes = {r: {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for i in range(n)}
              for r, n in (("a", 40), ("b", 7))}
    asks = [("a", 0, "the alpha alpha beta"), ("a", 1, "nothing here"), ("b", 2, "12 zeta of 1,000"),
            ("b", 0, "gamma")]
    chunks = spark.createDataFrame([(r, i, t) for r, c in routes.items() for i, t in c.items()],
                                   "route string, chunk_id long, text string")
    questions = spark.createDataFrame(asks, "route string, question_id int, text string")
    index = lexical.build_index(chunks)
    hits = lexical.bm25_topk(index, questions, 10, chunks_per_block=per_block, questions_per_block=1)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault((r.route, r.question_id), []).append((r.chunk_id, r.score))
    for route, q, text in asks:
        want = sorted(bm25(routes[route], text).items(), key=lambda p: (-p[1], p[0]))[:10]
        assert [c for c, _ in got[route, q]] == [c for c, _ in want]
        assert [s for _, s in got[route, q]] == pytest.approx([s for _, s in want], abs=2e-6)


def test_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vs = rng.normal(size=(90, 8))
    vs[10] = vs[20] = vs[30]  # copies: the lower id comes first
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    chunks = spark.createDataFrame([("r", i, v.astype("float32").tolist()) for i, v in enumerate(vs)],
                                   "route string, chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([("r", i, vs[i].astype("float32").tolist()) for i in (0, 20)],
                                  "route string, question_id int, embedding array<float>")
    hits = vectors.cosine_topk(chunks, asked, 5, chunks_per_block=13, questions_per_block=1)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    f = vs.astype("float32").astype("float64")
    for q in (0, 20):
        s = np.round(f @ f[q], 6)
        assert got[q] == sorted(range(90), key=lambda i: (-s[i], i))[:5]
    assert got[20][:3] == [10, 20, 30]


def test_fusion_rules(spark):
    schema = "question_id int, route string, chunk_id long, score double"
    vec = spark.createDataFrame([(1, "r", 1, 0.9), (1, "r", 2, 0.5), (2, "r", 1, 0.3), (2, "r", 4, 0.3)], schema)
    bm = spark.createDataFrame([(1, "r", 2, 4.0), (1, "r", 3, 2.0), (2, "r", 5, 0.0)], schema)
    rows = {(r.question_id, r.chunk_id): (r.rank, r.score_vec, r.score_bm25, r.score)
            for r in fusion.fuse_hits(vec, bm).collect()}
    assert rows[1, 1] == (1, 1.0, 0.0, 0.6)
    assert rows[1, 2] == (2, 0.0, 1.0, 0.4)
    assert rows[1, 3] == (3, 0.0, 0.0, 0.0)
    # Lists without spread become all ones.
    assert rows[2, 1][1] == rows[2, 4][1] == 1.0 and rows[2, 5][2] == 1.0
    assert all(0 <= r[3] <= 1 for r in rows.values())


def test_rerank_order_and_weak_flag(spark):
    rows = [(1, 1, 0.8, 0.1), (1, 2, 0.8, 0.1), (1, 3, 0.1, 1.0), (1, 4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "task_id int, rank int, score double, relevance_score double")
    out = rerank.combine_rankings(df, ["task_id"], top_n=3).orderBy("rerank").collect()
    assert [(r.rank, r.combined_score) for r in out] == [(3, 0.73), (1, 0.31), (2, 0.31)]
    weak = df.groupBy("task_id").agg(rerank.weak_evidence(F.col("relevance_score")).alias("w")).first().w
    assert weak is False
    off = df.groupBy("task_id").agg(rerank.weak_evidence(F.lit(0.1), 0).alias("w")).first().w
    assert off is False


@pytest.mark.parametrize("seg_len", [4, 9, 1024])
def test_embedding_batches_equal_plain_packing(spark, seg_len):
    rng = random.Random(seg_len)
    docs = {k: [rng.choice([1, 5, 20, 90]) for _ in range(rng.randint(1, 60))] for k in range(6)}
    docs[9] = [10] * 50
    rows = [(k, i, t) for k, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_id long, length_tokens int")
    out = vectors.embedding_batches(df, batch_size=4, budget=60, seg_len=seg_len)
    got = {}
    for r in out.collect():
        got[r.doc_id, r.chunk_id] = r.batch_start
    for k, ts in docs.items():
        start, n, tok = 0, 0, 0
        for i, t in enumerate(ts):
            if n and (n >= 4 or tok + t > 60):
                start, n, tok = i, 0, 0
            n, tok = n + 1, tok + t
            assert got[k, i] == start
