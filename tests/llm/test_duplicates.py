"""Min-max hashing, spherical caps and components against brute force."""

import random

import numpy as np
import pytest

from folioquery.llm import caps, minhash
from folioquery.llm.components import connected_components
from folioquery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}


def near_copies(rng, count=60, base=120):
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    rows, text = [], None
    for i in range(count):
        if i % 12 == 0:
            text = rng.choices(words, k=base)
        copy = list(text)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(base)] = rng.choice(words)
        rows.append((i * 7, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block,hubs", [(4, 1), (4, 16), (3, 2), (128, 16)])
@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_equals_brute_force(spark, monkeypatch, block, hubs, percent):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    rng = random.Random(block + percent)
    rows = near_copies(rng)
    rows += [(1001, rows[3][1]), (1002, rows[3][1].upper()), (1003, "a b"), (1004, "A  B"), (1005, None), (1006, ""),
             (1007, " \n"), (1008, "long " * 30_000), (1009, "\u00c4 b"), (1010, "\u00e4 b")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == brute(rows, percent)


def test_minhash_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_minhash"](spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, 85).items()}


def test_minhash_of_nothing_and_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "p q r"), (4, "p q r"), (4, "p q r"), (None, "other text")], "doc_id long, text string")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    got = sorted((r.doc_id is None, r.component_id is None, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(False, False, True), (False, False, True), (True, False, False), (True, True, True)]


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "p q r", 0), (2, "p q r", 1), (2, "p q r", 1), (3, None, 2)],
                                 "doc_id long, text string, kept_id int")
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_min_and_max_keys_agree_for_equal_sets_only():
    s = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (minhash.band_keys(s) == minhash.band_keys(s[::-1].copy())).all()
    assert not (minhash.band_keys(s[:40]) == minhash.band_keys(s[200:])).any()


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    got = {r.id: r.component for r in connected_components(
        spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()}
    want = roots({n for p in links for n in p}, links)
    assert got == {n: r for n, r in want.items() if n != 7 or True}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= caps.SIMILARITY
    np.fill_diagonal(near, False)
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(near[k].sum()), root[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [5, 128])
def test_caps_equal_brute_force_but_for_few_links(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(25, 64))
    x = np.concatenate([c + rng.normal(scale=0.16, size=(12, 64)) for c in centres] + [rng.normal(size=(80, 64))])
    x[5] = x[3]
    x[6] = 3 * x[3]
    ids = list(range(0, 3 * len(x), 3))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_duplicates(df).collect()}
    want = brute_vectors(ids, x)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert there > 400 and found >= 0.97 * there and all(got[i][0] <= want[i][0] for i in ids)
    assert got[ids[3]] [0]== want[ids[3]][0]


def test_caps_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute_vectors(rows.vec_id.tolist(), np.stack(rows.embedding).astype(float))
    got = {r.vec_id: r.n_links for r in QUERIES["op10_embedding_dedup"](spark, SF).collect()}
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values()) and len(got) == len(rows)


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10)]
    assert got == sorted(alone + [(1, 4, 1, True), (2, 4, 1, False), (9, 4, 1, False), (9, 4, 1, False), (11, 4, 1, False)])
    assert caps.near_duplicates(df.limit(0)).count() == 0
    assert caps.near_duplicates(df.filter("vec_id = 3")).collect()[0].kept


def test_every_length_is_compared_within_itself(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n, dim in enumerate((64, 63, 3)):
        x = rng.normal(size=(6, dim))
        x[1] = x[0]
        x[2] = 2 * x[0]
        ids = [100 * n + i for i in range(len(x))]
        rows += [(i, v.tolist()) for i, v in zip(ids, x)]
        want |= brute_vectors(ids, x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_duplicates(df).collect()}
    assert got == want


@pytest.mark.parametrize("scale", [
    np.ones(2), np.ones(4), np.ones(8), np.ones(13), np.ones(24), np.ones(33), np.ones(64), np.r_[np.ones(32), np.full(32, 0.05)],
    np.r_[np.ones(8), np.full(56, 0.02)], 1 / np.arange(1, 65),
], ids=["2", "4", "8", "13", "24", "33", "64", "half", "first8", "rank"])
def test_near_pairs_share_a_filter(scale):
    rng = np.random.default_rng(9)
    x, y = (rng.normal(size=(400, len(scale))) * scale for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code = caps.ProductCode(len(scale))
    shared = [np.intersect1d(a, b).size > 0 for a, b in zip(code.decode(x), code.decode(y))]
    assert np.mean(shared) >= 0.95


def test_null_and_repeated_ids_lose_no_text(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [(None, "first text"), (None, "second text"), (None, "second text"), (None, "p q r"), (4, "p q r"), (None, None), (None, " "),
            (5, " ".join(base)), (5, "unlinked words"), (5, "unlinked words"), (3, near), (None, near), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_first(docs).collect()), key=repr)
    want = [(None, "first text"), (None, "second text"), (4, "p q r"), (None, None), (None, " "), (5, "unlinked words"), (9, ""), (9, "")]
    assert [p for p in got if p[1] not in (near, rows[7][1])] == sorted(want, key=repr)
    assert [p for p in got if p[1] in (near, rows[7][1])] in ([(3, near)], [(5, rows[7][1])])
    assert minhash.keep_first(docs.limit(0)).count() == 0
