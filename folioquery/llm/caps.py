"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it is close
enough to, so near vectors share filters. Directions are structured: the dimensions, after a
fixed random rotation, are cut into blocks with a random code of unit vectors each, and one code word per block
makes a direction (a product code). The filters of a vector are found by list decoding:
block scores are sorted and only combinations that can reach the threshold are visited.

Vectors meet in their filters and cosines are computed in double precision, block against
block. A pair that shares several filters counts in the first of them only. Per vector
and block pair one row leaves a task: its links and the smallest vector of its local
component, never a list of pairs. Equal vectors are one class with a count.

Vectors are compared with those of their own length only; every length has its own filters.

Defined results: null or zero vectors and vectors with null or non-finite components link
with nothing. Repeated rows are copies.
Labels and other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import grouped, stage
from folioquery.llm.components import connected_components
from folioquery.llm.minhash import _roots

SIMILARITY = 0.95
CODE_WORDS = 512
#: Standard deviations of a random direction's score that a filter's threshold lies at.
THRESHOLD = 3.6
#: A vector with fewer filters than this takes its nearest ones instead.
LEAST_FILTERS = 12
#: Shorter vectors are filtered as vectors of this length that end in zeros: a threshold needs this many dimensions.
LEAST_DIM = 64
#: Vectors of one block of a filter.
BLOCK = 128


class ProductCode:
    """Filters of one length: two blocks of CODE_WORDS random unit vectors, in two halves of a random rotation.

    The rotation spreads every vector alike, whichever of its components hold its energy.
    """

    def __init__(self, dim: int, code_words: int = CODE_WORDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = max(dim, LEAST_DIM)
        half = size // 2
        self.words = code_words
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0][:, :dim]
        self.codes = []
        for rows in (turn[:half], turn[half:]):
            c = rng.standard_normal((code_words, len(rows)))
            # code words are turned back once, so no vector has to be turned
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2) @ rows)
        self.threshold = THRESHOLD / np.sqrt(size)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Filters of every unit vector (row), increasing."""
        first, second = x @ self.codes[0].T, x @ self.codes[1].T
        out = []
        for a, b in zip(first, second, strict=True):
            best = b.max()
            rows = np.flatnonzero(a + best >= self.threshold)
            cols = np.flatnonzero(b + a.max() >= self.threshold)
            i, j = np.nonzero(a[rows, None] + b[None, cols] >= self.threshold)
            if len(i) >= LEAST_FILTERS:
                out.append(np.sort(rows[i] * self.words + cols[j]))
                continue
            # the nearest filters lie among the best LEAST_FILTERS words of each block
            k = min(LEAST_FILTERS, self.words)
            rows, cols = np.argpartition(-a, k - 1)[:k], np.argpartition(-b, k - 1)[:k]
            total = (a[rows, None] + b[None, cols]).ravel()
            top = np.argsort(-total, kind="stable")[:LEAST_FILTERS]
            out.append(np.sort(rows[top // k] * self.words + cols[top % k]))
        return out


@lru_cache(maxsize=8)
def product_code(dim: int) -> ProductCode:
    """The code of a length; a worker keeps the last few."""
    return ProductCode(dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_block(
    x: np.ndarray, rep: np.ndarray, copies: np.ndarray, side: np.ndarray, same: bool, here: int, filters: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of one pair of blocks of a filter: vectors, links to vectors of other classes, local roots."""
    order = np.argsort(rep)
    x, rep, copies, side = x[order], rep[order], copies[order], side[order]
    li = np.flatnonzero(side == 0)
    ri = li if same else np.flatnonzero(side == 1)
    if not len(li) or not len(ri):
        return None
    near = x[li] @ x[ri].T >= SIMILARITY
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    # only pairs without an earlier filter in common count here
    earlier = [filters[k][filters[k] < here] for k in order]
    if (flat := np.concatenate(earlier)).size:
        names, at = np.unique(flat, return_inverse=True)
        holds = np.zeros((len(rep), len(names)), np.float32)
        holds[np.repeat(np.arange(len(rep)), [len(f) for f in earlier]), at] = 1
        near &= holds[li] @ holds[ri].T == 0
    p, q = np.nonzero(near)
    if not len(p):
        return None
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, li[p], copies[ri[q]])
    if not same:
        np.add.at(links, ri[q], copies[li[p]])
    root = _roots(len(rep), np.stack([li[p], ri[q]], axis=1))
    linked = links > 0
    return rep[linked], links[linked], rep[root[linked]]


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """compare_block over rows sorted by dim, filter, i, j."""
    for table, borders in grouped(batches, ["dim", "filter", "i", "j"]):
        column = {n: table.column(n).to_numpy() for n in ("filter", "i", "j", "side", "rep", "copies")}
        vectors = table.column("embedding").combine_chunks()
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        at = np.cumsum(np.r_[0, vectors.value_lengths().to_numpy()])
        lists = table.column("filters").combine_chunks()
        names = lists.flatten().to_numpy()
        ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
        out = []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if b - a < 2:
                continue
            got = compare_block(
                _unit(values[at[a] : at[b]].reshape(b - a, -1)), column["rep"][a:b], column["copies"][a:b], column["side"][a:b],
                column["i"][a] == column["j"][a], column["filter"][a], [names[ends[k] : ends[k + 1]] for k in range(a, b)],
            )
            if got:
                out.append(got)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["vec", "links", "root"]
            )


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    all_rows = vectors.select("vec_id", "embedding")
    whole = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False),
    )
    usable = all_rows.filter(whole).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    classes = stage(
        usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim")),
        "caps-classes",
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                rows = part.column("embedding").to_numpy(zero_copy_only=False)
                dims = part.column("dim").to_numpy()
                filters = [None] * len(rows)
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    for k, f in zip(own, product_code(int(dim)).decode(_unit(np.stack(rows[own]))), strict=True):
                        filters[k] = f
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(filters, pa.list_(pa.int32()))], [*part.schema.names, "filters"]
                )

    kind = dict(vectors.dtypes)["embedding"]
    decoded = stage(
        classes.select("rep", "copies", "dim", "embedding").mapInArrow(
            decode, f"rep long, copies long, dim int, embedding {kind}, filters array<int>"
        ), "caps-filters",
    )
    # filters with one vector have nothing to compare; others are cut into blocks
    crowded = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members")
    ).filter("members > 1").drop("members")
    member = decoded.select("rep", "copies", "dim", "embedding", "filters", F.explode("filters").alias("filter")).join(
        crowded, ["dim", "filter"]
    )
    block = F.pmod(F.xxhash64("rep", "filter"), F.col("blocks")).cast("int")
    paired = member.withColumn("block", block).select(
        "rep", "copies", "dim", "embedding", "filters", "filter", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "rep", "copies", "dim", "embedding", "filters", "filter",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    found = stage(
        paired.repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")
        .mapInArrow(compare_groups, "vec long, links long, root long"),
        "caps-links",
    )
    counts = found.groupBy(F.col("vec").alias("rep")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), "caps-components")
    result = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"),
    )
    keyed = all_rows.withColumn("key", F.when(whole, F.col("embedding")))
    return keyed.join(result.withColumnRenamed("embedding", "key"), "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
