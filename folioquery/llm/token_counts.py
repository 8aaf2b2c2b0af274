"""Token counts through a cache of content digests.

The cache is a Parquet table (version, key, n_tokens) at a path of the caller's choice. The
version is a digest of the tokenizer: its file, the library that reads it and the rule that
normalises content. The key is the SHA-256 digest of the normalised content. A call looks all
its keys up, encodes one text of each distinct key the cache does not hold, appends the new
counts, and reads every count from the cache. A second call over the same texts encodes
nothing; another version of the tokenizer finds nothing of the first.

Normalisation never changes a count: for a tokenizer that drops white space, runs of ASCII
white space become one blank and those at the ends go; for any other it is the text itself.

Digests and lookups are rows of a few bytes. Whole texts move once, only those of missing
keys, and each task first drops what it has seen, so that a text on a third of all rows is
sent once per task. Keys with more than a thousandth of all rows (there are fewer than a
thousand) meet their counts by a broadcast, all others by an equality join.

An append that is cut off or runs twice leaves nothing or equal rows; readers take one row
per key. Stage tables and the cache lie in folders all executors share.

Defined results: a null text is empty, with 0 bytes and 0 tokens; null, equal and repeated
ids give one row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import stage, text_or_empty
from folioquery.llm.tokens import byte_slices, default_tokenizer, word_ids

LIMIT = 2048
CACHE_DDL = "version string, key binary, n_tokens long"
#: Missing keys (32 bytes each) that are broadcast to the scan; more meet the texts in a shuffle.
BROADCAST_KEYS = 1 << 14
#: A key is hot with more than this share of the rows, and more than MIN_HOT of them.
HOT_SHARE = 1000
MIN_HOT = 1000
BLANKS = r"[\t\n\x0B\f\r ]+"


# ---- tokenizers --------------------------------------------------------------------


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer file turns white space into one blank, lower-cases, and keeps only what lies between."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and spec["model"].get("end_of_word_suffix") == "</w>"
    )


def version_of(path: str) -> str:
    """Digest of a tokenizer: its file, its library's version and the normalisation its counts allow."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    digest = hashlib.sha256(f"{library}\n{'blanks' if drops_white_space(path) else 'exact'}\n".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts of a slice of texts as the library of the file's kind gives them."""
    if drops_white_space(path):
        return word_ids(path).counts
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(texts: list[str]) -> list[int]:
            return [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    return lambda texts: np.array(encode(texts.to_pylist()), np.int64)


# ---- the cache ---------------------------------------------------------------------


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(key, n_tokens) of one version, each key once."""
    rows = spark.read.schema(CACHE_DDL).parquet(cache).filter(F.col("version") == version)
    return rows.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str, version: str) -> None:
    """Add (key, n_tokens) rows to the cache, in the folder of their version."""
    counts.select(F.lit(version).alias("version"), "key", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)


# ---- the operator ------------------------------------------------------------------


def _normalised(text: Column, path: str) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " ")) if drops_white_space(path) else text


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every key of a task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for key in batch.column(0).to_pylist():
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in _unseen(batches):
            parts = [count(texts) for _, texts in byte_slices(batch.column(1))]
            counts = np.concatenate([*parts, np.array([], np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``.

    ``cache`` is a folder all executors share; it is made if it does not exist.
    """
    spark, path = docs.sparkSession, path or default_tokenizer()
    version = version_of(path)
    texts = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _normalised(F.col("text"), path).alias("text")
    ).withColumn("key", F.unhex(F.sha2("text", 256)))
    append(spark.createDataFrame([], "key binary, n_tokens long"), cache, version)

    digests = stage(texts.select("doc_id", "n_bytes", "key"), "digests")
    distinct = stage(digests.groupBy("key").agg(F.count("*").alias("copies")), "distinct-digests")
    missing = stage(distinct.join(cached(spark, cache, version), "key", "left_anti").select("key"), "missing-digests")
    n_missing = missing.count()
    if n_missing:
        asked = texts.select("key", "text")
        if n_missing <= BROADCAST_KEYS:
            asked = asked.join(F.broadcast(missing), "key", "left_semi")
        asked = asked.mapInArrow(_unseen, "key binary, text string")
        # keys are spread evenly, each of a task once; equal texts meet in one task
        asked = asked.join(missing.hint("shuffle_hash"), "key", "left_semi")
        append(asked.mapInArrow(_encoded(path), "key binary, n_tokens long"), cache, version)

    counts = cached(spark, cache, version)
    bound = max(MIN_HOT, digests.count() // HOT_SHARE)
    hot = distinct.filter(F.col("copies") > bound).select("key")  # fewer than HOT_SHARE rows
    often = digests.join(F.broadcast(counts.join(F.broadcast(hot), "key", "left_semi")), "key")
    seldom = digests.join(F.broadcast(hot), "key", "left_anti").join(counts, "key", "left")
    return seldom.unionByName(often).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
