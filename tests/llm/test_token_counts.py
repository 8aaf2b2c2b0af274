"""Token counts through the digest cache, against the libraries."""

import glob

import pytest

from folioquery.llm import token_counts
from folioquery.llm.queries import QUERIES
from folioquery.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, key string, n_tokens string, lang string"


def library_counts(path, texts):
    texts = [t or "" for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts] if len(texts) < 100 else [
            len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    return [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


def as_rows(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in frame.collect()), key=repr)


def want(path, rows, limit=2048):
    counts = library_counts(path, [r[1] for r in rows])
    return sorted(((r[0], len((r[1] or "").encode()), n, n > limit) for r, n in zip(rows, counts)), key=repr)


def odd_rows():
    texts = [None, "", " ", "\n\t ", "a b", "a  b", " a\nb ", "A B", "a b", "a  b", "x <|endoftext|> y", "x <|ENDOFTEXT|> y",
             "<|endoftext|>", "<| endoftext|>", "café café", "it's  'S", "\x1ca \x1c b\x85", "İΣ ς", "word " * 9000, "z" * 3000]
    return [(i, t, "k", "n", "en") for i, t in enumerate(texts)] + [(None, "a b", "k", None, None)] * 3 + [(4, "a b", None, "n", "en")]


def files(cache):
    return {f for f in glob.glob(f"{cache}/**/*.parquet", recursive=True)}


def cached_rows(spark, cache):
    return spark.read.parquet(cache).count()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, tmp_path, name):
    import public_tokenizers

    path, rows = public_tokenizers.path(name), odd_rows()
    docs = spark.createDataFrame(rows, DDL)
    got = token_counts.count_tokens(docs, str(tmp_path / "cache"), path, limit=100)
    assert as_rows(got) == want(path, rows, 100)
    distinct = {r[1] or "" for r in rows}
    if "word" in name:  # blanks that differ in white space alone share an entry
        distinct = {b" ".join(t.encode().replace(b"\x1c", b"\xff").split()) for t in distinct}
    assert cached_rows(spark, str(tmp_path / "cache")) == len(distinct)


def test_second_call_encodes_nothing_and_a_third_only_what_is_new(spark, tmp_path, monkeypatch):
    cache, path = str(tmp_path / "cache"), default_tokenizer()
    rows = [(i, f"text number {i % 7}", None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    first = as_rows(token_counts.count_tokens(docs, cache, path))
    held = files(cache)
    assert cached_rows(spark, cache) == 7

    def refused(_):
        raise AssertionError("nothing is missing")

    with monkeypatch.context() as m:
        m.setattr(token_counts, "_encoded", refused)
        assert as_rows(token_counts.count_tokens(docs, cache, path)) == first == want(path, rows)
    more = rows + [(99, "something else", None, None, None), (98, "something   else", None, None, None)]
    assert as_rows(token_counts.count_tokens(spark.createDataFrame(more, DDL), cache, path)) == want(path, more)
    assert held <= files(cache) and cached_rows(spark, cache) == 8


def test_counts_come_from_the_cache(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), default_tokenizer()
    docs = spark.createDataFrame([(1, "a b", None, None, None)], DDL)
    token_counts.count_tokens(docs, cache, path)
    planted = spark.read.parquet(cache).withColumn("n_tokens", token_counts.F.lit(77).cast("long")).collect()
    other = str(tmp_path / "other")
    rows = spark.createDataFrame([(bytes(r.key), r.n_tokens) for r in planted], "key binary, n_tokens long")
    token_counts.append(rows, other, token_counts.version_of(path))
    token_counts.append(rows, other, token_counts.version_of(path))  # an append that ran twice
    assert token_counts.count_tokens(docs, other, path).collect()[0].n_tokens == 77


def test_versions_do_not_mix(spark, tmp_path):
    import public_tokenizers

    cache = str(tmp_path / "cache")
    rows = [(1, "Some words here", None, None, None)]
    docs = spark.createDataFrame(rows, DDL)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert as_rows(token_counts.count_tokens(docs, cache, public_tokenizers.path(name))) == want(public_tokenizers.path(name), rows)
    assert cached_rows(spark, cache) == 3


def test_hot_keys_and_many_misses_take_the_other_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "MIN_HOT", 5)
    monkeypatch.setattr(token_counts, "HOT_SHARE", 10)
    monkeypatch.setattr(token_counts, "BROADCAST_KEYS", 0)
    rows = [(i, "the hot text" if i % 3 == 0 else f"own text {i}", None, None, None) for i in range(120)]
    docs = spark.createDataFrame(rows, DDL).repartition(6)
    assert as_rows(token_counts.count_tokens(docs, str(tmp_path / "c"), default_tokenizer())) == want(default_tokenizer(), rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DDL)
    got = token_counts.count_tokens(docs, str(tmp_path / "c"))
    assert got.collect() == [] and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(QUERIES["op13_token_counts"](spark, SF)) == want(default_tokenizer(), rows)
