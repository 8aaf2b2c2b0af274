"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenized and cut into pieces of at most the capacity. The plan needs only
how many pieces there are of each length: best fit places whole counts, longest first,
into groups of sequences with equal room. Pieces then take the planned slots by their
rank within their length. Ranks are found in slices of a length, so that a length shared
by a third of all pieces is spread over many tasks.

The plan's size depends on the capacity alone: lengths are at most the capacity, every
length adds at most four groups, and a group takes at most sqrt(2 * capacity) distinct
lengths. There are at most RANK_SLICES plus capacity slices.

Defined results: a null or empty text is the single closing token; repeated rows are
packed one by one; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.common import stage
from folioquery.llm.tokens import byte_slices, default_tokenizer, word_ids

CAPACITY = 2048
CLOSING_ID = 0
RANK_SLICES = 8192
#: Slices hold at least so many pieces on average.
MIN_SLICE = 64
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes)."""
    path = path or default_tokenizer()
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_ids(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in byte_slices(batch.column(1)):
                ids, borders = tokenizer.ids(texts)
                rows: list[tuple] = []
                for at, (begin, end) in enumerate(itertools.pairwise(borders.tolist()), first):
                    data = ids[begin:end].tobytes() + closing
                    for piece, b in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[b : b + 4 * capacity]
                        rows.append((
                            doc_ids[at], piece, b // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None
                        ))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    out = docs.select("doc_id", "text").mapInArrow(run, PIECES_DDL)
    return out if with_ids else out.drop("ids")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots for every length: rows (length, first rank, end rank, per sequence, sequence, offset).

    Ranks first to end of a length go to consecutive sequences, ``per sequence`` in each.
    """
    room: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), by room
    rows: list[tuple[int, ...]] = []
    following = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(room, (length,))
            if at < len(room):
                space, first, bins = room.pop(at)
            else:
                space, first = capacity, following
                bins = -(-left // (capacity // length))
                following += bins
            each = space // length
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, rank + full * each, each, first, capacity - space))
                if space - each * length:
                    bisect.insort(room, (space - each * length, first, full))
                rank, left, first, bins = rank + full * each, left - full * each, first + full, bins - full
            if left and bins:
                rows.append((length, rank, rank + left, left, first, capacity - space))
                if space - left * length:
                    bisect.insort(room, (space - left * length, first, 1))
                left, first, bins = 0, first + 1, bins - 1
            if bins:
                bisect.insort(room, (space, first, bins))
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and others)."""
    spark = pieces.sparkSession
    pieces = stage(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity)

    per_slice = max(MIN_SLICE, -(-sum(counts.values()) // RANK_SLICES))
    parts = spark.createDataFrame(
        [(length, -(-n // per_slice)) for length, n in counts.items()], "length long, _slices int"
    )
    # at most ``capacity`` rows
    sliced = pieces.join(F.broadcast(parts), "length").withColumn(
        "_slice", F.pmod(F.xxhash64("_uid"), F.col("_slices")).cast("int")
    )
    sizes = sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")).collect()
    before, total = {}, dict.fromkeys(counts, 0)
    for r in sorted(sizes):
        before[r["length"], r["_slice"]] = total[r["length"]]
        total[r["length"]] += r["n"]
    stride = max((s for _, s in before), default=0) + 1
    keys = np.array([length * stride + s for length, s in before], np.int64)
    order = np.argsort(keys)
    keys, starts = keys[order], np.array(list(before.values()), np.int64)[order]
    # one increasing key (length, first rank) finds a slot by bisection
    span = sum(counts.values()) + 1
    slot_keys = slots[:, 0] * span + slots[:, 1]

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, part: pa.Array, nth: pa.Array) -> pa.Array:
        n = length.to_numpy(zero_copy_only=False)
        rank = starts[np.searchsorted(keys, n * stride + part.to_numpy(zero_copy_only=False))] + (
            nth.to_numpy(zero_copy_only=False) - 1
        )
        s = slots[np.searchsorted(slot_keys, n * span + rank, side="right") - 1]
        nth_bin, nth_in_bin = np.divmod(rank - s[:, 1], s[:, 3])
        return pa.StructArray.from_arrays(
            [pa.array(s[:, 4] + nth_bin), pa.array(s[:, 5] + nth_in_bin * n)], names=["sequence_id", "offset"]
        )

    nth = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_uid"))
    ranked = sliced.withColumn("_nth", nth)
    placed: Column = place("length", "_slice", "_nth")
    kept = [c for c in pieces.columns if c != "_uid"]
    return ranked.withColumn("_place", placed).select(
        *kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )
