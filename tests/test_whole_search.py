"""The registered searches against every document and every vector, not one source of them."""

import numpy as np
import pytest
from test_retrieval import bm25

from folioquery.plans import QUERIES

ASKED = {3: "alpha beta", 21: "gamma", 7: "zeta alpha"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 documents of few, unknown and no sources; the best hits lie anywhere."""
    rng = np.random.default_rng(11)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 9))), "en", (None, "web", "src3", "src1")[i % 4]) for i in range(60)]
    vectors = rng.normal(size=(60, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    out = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(
        f"{out}/embeddings.parquet")
    return out, {i: t for i, t, _, _ in docs}, vectors.astype("float32").astype(float)


def hits(frame):
    got = {}
    for r in frame.orderBy("rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    return got


def test_bm25_meets_every_document(spark, folder):
    path, texts, _ = folder
    got = hits(QUERIES["bm25_topk"](spark, path))
    for q, text in ASKED.items():
        want = sorted(bm25(texts, text).items(), key=lambda p: (-p[1], p[0]))[:30]
        assert [c for c, _ in got[q]] == [c for c, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


def test_cosine_meets_every_vector(spark, folder):
    path, _, x = folder
    got = hits(QUERIES["cosine_topk"](spark, path))
    for q in ASKED:
        want = sorted(enumerate(np.round(x @ x[q], 6)), key=lambda p: (-p[1], p[0]))[:30]
        assert [c for c, _ in got[q]] == [c for c, _ in want]
