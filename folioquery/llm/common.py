"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.session import ensure_checkpoint_dir
from folioquery.sources.tables import stage

__all__ = [
    "HashCache", "grouped", "held_out", "own_folder", "packed", "read", "slices", "stage", "text_or_empty", "unpacked", "words",
]

#: Rows that are turned into Python objects at a time inside a task.
SLICE_ROWS = 256
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 150_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def packed(docs: DataFrame, *used: str | Column) -> DataFrame:
    """Whole rows in one column ``doc`` beside the columns an operator works on: no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *used)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of ``packed`` again, with some columns changed."""
    return df.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def text_or_empty(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words as runs of characters other than blank and U+0009 to U+000D, in UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def slices(array: pa.Array, rows: int = SLICE_ROWS) -> Iterator[list]:
    """Python values of an Arrow array, some rows at a time."""
    for i in range(0, len(array), rows):
        yield array.slice(i, rows).to_pylist()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by integer keys, each with the borders of its groups.

    A group that runs on into the next batch is held back until it is whole.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        key = np.stack([table.column(k).to_numpy() for k in keys])
        last = int(np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1][-1])
        held = table.slice(last)
        if last:
            yield table.slice(0, last), _borders(key[:, :last])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _borders(key: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, key.shape[1]]


class HashCache(dict):
    """64-bit hashes of byte words; emptied when it holds CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n word hashes, in order; fewer words make one window of all."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out
