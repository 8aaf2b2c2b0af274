"""Quality rules: text statistics and a log-likelihood ratio of hashed n-grams.

Character n-grams of a text (as UTF-8 bytes) are hashed into buckets. Two multinomials
over the buckets, one of trusted documents and one of the whole corpus, give every bucket
a log ratio. Characters rather than words: a language with few trusted documents is
still well covered by them. A document's score is the mean ratio of its n-grams, and documents below a
fixed score fail. Nothing is drawn at random: equal texts get equal verdicts.

Defined results: a null or empty text has no words, all counts 0, score 0 and fails the
base rules. Repeated rows are judged one by one. With an empty corpus or without trusted
documents every ratio is 0, so only the base rules decide. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import HashCache, held_out, read, shingle_hashes, slices, words

#: Buckets of the multinomials at least; their number follows the root of the corpus's n-grams, as distinct ones do.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (3, 4)
#: N-grams a task holds before it adds them to its counts.
PENDING_NGRAMS = 1 << 20
#: Mean log ratio a document must reach: MIN_SCORE less SHORT_SLACK over the root of its words, as the mean of few
#: n-grams scatters more.
MIN_SCORE = -0.27
SHORT_SLACK = 0.2
MIN_WORDS = 10
#: Percent of the words that may stand in windows of five words found twice or more.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOL = re.compile(r"[#*$%&|<>]")

METRICS = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_()),
])
METRICS_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def bucket_bits(ngrams: int) -> int:
    """Bits of a bucket number for a corpus of so many n-grams."""
    return max(BUCKET_BITS, (max(1, ngrams).bit_length() + 1) // 2)


def ngram_buckets(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of all n-grams of a text; none if it is shorter than the smallest."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    found = []
    for n in NGRAMS:
        if len(b) >= n:
            x = np.full(len(b) - n + 1, n, np.uint32)
            for i in range(n):
                x = x * np.uint32(0x01000193) ^ b[i : len(b) - n + 1 + i]
            x *= np.uint32(0x9E3779B1)
            found.append(x >> np.uint32(32 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words inside windows of five that occur twice or more, the first occurrence included."""
    if len(h) <= WINDOW:
        return 0
    sh = shingle_hashes(h, WINDOW)
    order = np.argsort(sh, kind="stable")
    equal = sh[order][1:] == sh[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(sh), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    depth = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    return int((np.cumsum(depth[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()]
    return len(lines) - len(set(lines))


def describe(text: str | None, cache: HashCache, ratio: np.ndarray) -> tuple:
    """The METRICS of one text."""
    text = text or ""
    w = words(text)
    h = cache.of(w)
    repeat = repeated_words(h)
    failed = len(w) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(w)
    grams = ngram_buckets(text, len(ratio).bit_length() - 1)
    score = float(ratio[grams].mean()) if len(grams) else 0.0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return (
        len(w), chars, len(SYMBOL.findall(text)), duplicate_lines(text), repeat,
        failed, score, not failed and score >= MIN_SCORE - SHORT_SLACK / len(w) ** 0.5,
    )


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the trusted documents: all that are labelled good outside the held-out fold."""
    return (
        read(spark, folder, "labels").filter((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
        .select("doc_id").distinct()
    )


def bucket_counts(docs: DataFrame, trusted: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Corpus and trusted n-gram counts per bucket: bucket, raw, target.

    Each task adds up one array over all its texts and emits it once. The trusted ids
    grow with the corpus: they are never broadcast, and null ids take no part in the join.
    """

    def count(batches):
        total, pending, held = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                for text in texts:
                    pending.append(ngram_buckets(text, bits))
                    held += len(pending[-1])
                    if held >= PENDING_NGRAMS:
                        total += np.bincount(np.concatenate(pending), minlength=1 << bits)
                        pending, held = [], 0
        if held:
            total += np.bincount(np.concatenate(pending), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    def counted(texts: DataFrame) -> DataFrame:
        return texts.select("text").mapInArrow(count, "bucket long, n long")

    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).join(trusted.hint("merge"), "doc_id", "left_semi")
    none = F.lit(0).cast("long")
    return (
        counted(docs).select("bucket", F.col("n").alias("raw"), none.alias("target"))
        .unionByName(counted(known).select("bucket", none.alias("raw"), F.col("n").alias("target")))
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: pd.DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the smoothed trusted and corpus multinomials, per bucket."""
    raw, target = np.ones(buckets), np.ones(buckets)
    if not len(counts) or counts["target"].sum() == 0:
        return np.zeros(buckets)
    np.add.at(raw, counts["bucket"].to_numpy(), counts["raw"].to_numpy())
    np.add.at(target, counts["bucket"].to_numpy(), counts["target"].to_numpy())
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def fit(docs: DataFrame, folder: str) -> np.ndarray:
    """Ratios of a corpus; at most one row per bucket reaches the driver."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(len(NGRAMS) * size)
    return log_ratios(bucket_counts(docs, trusted_ids(docs.sparkSession, folder), bits).toPandas(), 1 << bits)


def verdict(text: Column, ratio: np.ndarray) -> Column:
    """The METRICS of a text column."""

    @F.arrow_udf(METRICS_DDL)
    def judge(array: pa.Array) -> pa.Array:
        cache = HashCache()
        rows = [describe(t, cache, ratio) for part in slices(array) for t in part]
        cols = zip(*rows, strict=True) if rows else [[] for _ in METRICS]
        return pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(cols, METRICS, strict=True)], names=[f.name for f in METRICS]
        )

    return judge(text)


def judge_documents(docs: DataFrame, folder: str) -> DataFrame:
    """One row per document: doc_id and the METRICS."""
    ratio = fit(docs, folder)
    return docs.select("doc_id", verdict(F.col("text"), ratio).alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, folder: str) -> DataFrame:
    """The documents that pass, with their own columns."""
    ratio = fit(docs, folder)
    return docs.filter(verdict(F.col("text"), ratio)["kept"])
