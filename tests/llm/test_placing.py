"""Packing, mixing and sharding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioquery.llm import mixing, packing, sharding, tokens
from folioquery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sound(rows, capacity):
    """No gaps, no overlaps, nothing beyond the capacity."""
    at = {}
    for seq, offset, length in sorted(rows):
        assert at.get(seq, 0) == offset
        at[seq] = offset + length
        assert at[seq] <= capacity
    return len(at)


def test_packing_query_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    want = {}
    for i, t in texts.items():
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = sound([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert bins <= -(-sum(r.length for r in got) // 2048) + 1


def test_ids_of_runs_are_ids_of_the_text():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    runs = tokens.WordIds(packing.default_tokenizer())
    texts = ["", " a  b\n\nc", "It's 'quoted' don't\tx\u00a0y", "e\u0301 \u0301x \u00c5\u2028\u00e9", "a\x1cb\x85c !!?? 12 3", "\u03a3\u03a3 \u0130", "", "T\u0308 t\u0308",
             "Word. WORD!! \u00c4\u00d6\u00dfe, \u00ff~ x'S. don'T.. a|b |c d| e|| <|endoftext|> f<|endoftext|> g<| \u00c4', h'' i.'s <|ENDOFTEXT|>", "\n", "\t x "]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for size in (1, 40, 10**6):  # a slice for each text, some to a slice, all in one
        got, counts = [], []
        for _, part in tokens.byte_slices(pa.array([*texts, None]), size):
            ids, borders = runs.ids(part)
            got += [ids[a:b].tolist() for a, b in zip(borders, borders[1:])]
            counts += runs.counts(part).tolist()
        assert got == [*want, []] and counts == [len(w) for w in got]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_count(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {length: rng.randint(1, 400) for length in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    if seed == 0:
        counts[capacity] = 5000
    rows = packing.plan(counts, capacity)
    slots = [(seq + r // each, off + r % each * length, length)
             for length, lo, hi, each, seq, off in rows.tolist() for r in range(hi - lo)]
    assert len(slots) == sum(counts.values())
    used = sound(slots, capacity)
    assert used <= -(-sum(n * c for n, c in counts.items()) // capacity) * 1.25 + 1
    assert packing.plan({}, capacity).shape == (0, 6)


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "MIN_SLICE", 2)
    rows = [(1, None, 1), (2, "", 1), (3, "word " * 9000, 1), (3, "word " * 9000, 1), (None, "x", 1)] + [(i, "same text", 0) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(packing.tokenize(docs)).collect()
    sound([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.length)
    assert by[1] == by[2] == [1] and sorted(by[3]) == sorted([2048] * 8 + [809] * 2) and by[None] == [2]
    assert packing.pack(packing.tokenize(docs.limit(0))).count() == 0
    ids = packing.tokenize(docs.filter("doc_id = 2"), with_ids=True).first().ids
    assert bytes(ids) == b"\0\0\0\0"


def test_rake_meets_reachable_targets():
    rng = random.Random(1)
    cells = {(s, la, t): rng.randint(50, 150) for s in "abc" for la in ("en", "fr") for t in ("0", "1", "other")}
    targets = {"source": {"a": 1, "b": 1, "c": 1}, "lang": {"en": 3, "fr": 2}, "topic": {"0": 1, "1": 1}}
    p = mixing.rake(cells, targets, 0.3)
    total = sum(cells.values())
    kept = {k: p[k] * n for k, n in cells.items()}
    assert sum(kept.values()) == pytest.approx(0.3 * total)
    for value in "abc":
        assert sum(n for k, n in kept.items() if k[0] == value) == pytest.approx(0.1 * total)
    assert sum(n for k, n in kept.items() if k[1] == "en") == pytest.approx(0.18 * total)
    other = sum(n for k, n in cells.items() if k[2] == "other")
    assert sum(n for k, n in kept.items() if k[2] == "other") == pytest.approx(0.3 * other)
    assert all(0 <= x <= 1 for x in p.values()) and mixing.rake({}, targets, 0.3) == {}


def test_mixing_query_against_plain_counts(spark):
    got = QUERIES["op4_source_mixing"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    topic = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id").label.astype(str).to_dict()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(docs.text[r.doc_id].split()) and r.topic == topic.get(r.doc_id, "other") for r in got.itertuples())
    cells = got.groupby(["source", "lang", "topic"]).n_tokens.sum().to_dict()
    want = mixing.rake({k: int(n) for k, n in cells.items()}, mixing.TARGETS, mixing.FRACTION)
    assert all(r.probability == pytest.approx(want[r.source, r.lang, r.topic]) for r in got.itertuples())
    again = QUERIES["op4_source_mixing"](spark, SF).toPandas().set_index("doc_id").kept
    assert (got.set_index("doc_id").kept == again).all() and 0.3 < got.kept.mean() < 0.7


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "a b", "src1", "en", "y"), (2, "a b", "src1", "en", "y"), (None, "", "?", "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mix_topic string")
    topic = spark.createDataFrame([(2, "3")], "topic_id long, topic_value string")
    got = mixing.mix(docs, topic).collect()
    assert sorted(r.mix_topic for r in got) == ["3", "3", "other", "other"] and len({r.mix_kept for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(docs.limit(0), topic).count() == 0
    kept = mixing.keep_mixed(docs, SF)
    assert kept.columns == docs.columns and kept.count() <= 4


def test_rows_without_id_are_drawn_one_by_one(spark):
    rows = [(None, f"word number {i}", "src1", "en") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
                     spark.createDataFrame([(1, "3")], "topic_id long, topic_value string"))
    kept = [r.mix_kept for r in got.collect()]
    assert len(kept) == 400 and 140 < sum(kept) < 260 and set(got.columns) >= {"doc", "mix_topic", "mix_probability"}


def test_sharding_query(spark):
    got = QUERIES["op5_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        data = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    load = got.groupby("shard")["size"].sum()
    assert sorted(load.index) == list(range(8)) and load.max() <= 1.01 * load.min()


def test_slot_maps(spark, tmp_path):
    rng = random.Random(2)
    weights = {s: rng.randint(0, 10_000) for s in range(0, 4096, 2)}
    first = sharding.fit(weights, 8)
    load = [sum(w for s, w in weights.items() if first.shard_of[s] == k) for k in range(8)]
    assert max(load) - min(load) <= max(weights.values())
    for s in range(100):  # one shard has grown
        weights[s] = 60_000 if first.shard_of[s] == 0 else weights.get(s, 0)
    second = sharding.rebalance(first, weights)
    moved = [s for s in range(4096) if first.shard_of[s] != second.shard_of[s]]
    after = [sum(w for s, w in weights.items() if second.shard_of[s] == k) for k in range(8)]
    assert 0 < len(moved) < 1000 and max(after) < sum(after) / 8 * 1.05 and second.version == 2
    wider = sharding.rebalance(second, weights, shards=9)
    assert {wider.shard_of[s] for s in range(4096) if wider.shard_of[s] != second.shard_of[s]} == {8}
    with pytest.raises(ValueError):
        sharding.rebalance(first, weights, shards=7)
    path = str(tmp_path / "map")
    first.store(spark, path)
    second.store(spark, path)
    assert sharding.SlotMap.load(spark, path) == second and sharding.SlotMap.load(spark, path, 1) == first


def test_sharding_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "\u00e9" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.place(docs).collect()
    assert sorted((r["size"], r.text_crc32) for r in got)[:3] == [(1, 0)] * 3 and max(r["size"] for r in got) == 200_001
    assert sharding.place(docs.limit(0)).count() == 0
    assert sharding.assign(docs.drop("shard"), sharding.fit({}, 8)).count() == 4
