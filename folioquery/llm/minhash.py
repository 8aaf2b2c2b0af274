"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. Every permutation gives two
signature values, its minimum and its maximum over the set, so a signature of 2k values
needs k hash evaluations per shingle. Bands of consecutive values propose candidates;
proposals only decide which documents meet. Documents that share a band key, directly or
through others, form a cluster, and inside clusters links are confirmed on the full
sets. Clusters are cut into blocks of bounded size; one task compares two blocks and
returns, per document, the smallest document of its local component: never a list of
pairs. Equal sets are one class throughout, so exact copies cost one set.

A cluster of several blocks first meets a few of its own documents, its hubs. Documents
that hubs link already are one group and are not compared with each other again; only
blocks of different groups, and those of documents without a hub, still meet. A large
group of copies of one text so costs work linear in its size, and no link between
groups is lost.

Defined results: fewer words than a shingle make one shingle of the whole sequence; a
null, empty or blank text has an empty set and is linked with nothing. Repeated rows of
one id are one document with the union of their links (they share the id). Other columns
are ignored. An empty table gives an empty result. A null id never names a group: such a
row is kept unless a row with an id has an equal set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.common import HashCache, grouped, packed, shingle_hashes, slices, stage, unpacked
from folioquery.llm.components import connected_components

SHINGLE_WORDS = 5
#: A band holds the minimum and maximum of PERMUTATIONS_PER_BAND permutations. At the
#: similarity 0.85 a pair shares no band with probability 3e-7, at 0.8 with 2e-4.
BANDS = 48
PERMUTATIONS_PER_BAND = 4
#: Documents of one block of a cluster, and shingles it holds on average at most.
BLOCK_DOCS = 128
BLOCK_SHINGLES = 400_000
#: Hubs of a cluster of several blocks at most.
HUBS = 16

_rng = np.random.default_rng(20240501)
_K = BANDS * PERMUTATIONS_PER_BAND
_XOR = _rng.integers(0, 1 << 32, _K, dtype=np.uint64).astype(np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 32, _K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_MIX = (_rng.integers(0, 1 << 63, (1, 2 * PERMUTATIONS_PER_BAND), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; only A to Z are lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(cache.of(text.encode("utf-8", "replace").lower().split()), SHINGLE_WORDS))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(_K, 0xFFFFFFFF, np.uint32), np.zeros(_K, np.uint32)
    for i in range(0, len(x), 512):
        y = (x[i : i + 512] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    values = np.concatenate(
        [low.reshape(BANDS, -1), high.reshape(BANDS, -1)], axis=1
    ).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(BANDS, np.uint64)
        for j in range(values.shape[1]):
            key = (key ^ values[:, j]) * _MIX[0, j]
            key ^= key >> np.uint64(31)
        return (key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null for the empty set), bands (array of keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                n, keys, bands = [], [], []
                for text in texts:
                    s = shingle_set(text, cache)
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(band_keys(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "set_key", "bands"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.r_[True, value[1:] != value[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return np.zeros((len(left), len(right)))
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out)


def _roots(n: int, links: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, given links (k x 2)."""
    root = np.arange(n)
    while len(links):
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        before = root.copy()
        np.minimum.at(root, links[:, 0], low)
        np.minimum.at(root, links[:, 1], low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def confirm_blocks(
    rep: np.ndarray, side: np.ndarray, same: bool, sets: list[np.ndarray], percent: int
) -> tuple[np.ndarray, np.ndarray] | None:
    """Links of one block pair as (doc, root): every pair at or above the similarity is connected through roots."""
    order = np.argsort(rep)
    rep, side, sets = rep[order], side[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    li = np.flatnonzero(side == 0)
    ri = li if same else np.flatnonzero(side == 1)
    if not len(li) or not len(ri):
        return None
    both = _intersections([sets[k] for k in li], [sets[k] for k in ri])
    union = size[li][:, None] + size[ri][None, :] - both
    x, y = np.nonzero(100 * both >= percent * union)
    links = np.stack([li[x], ri[y]], axis=1)
    root = _roots(len(rep), links[links[:, 0] != links[:, 1]])
    moved = root != np.arange(len(rep))
    return rep[moved], rep[root[moved]]


def confirm_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """confirm_blocks over rows sorted by cluster, i, j."""
    for table, borders in grouped(batches, ["cluster", "i", "j"]):
        i, j, side, rep = (table.column(c).to_numpy() for c in ("i", "j", "side", "rep"))
        shingles = table.column("shingles")
        out = []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if b - a > 1:
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in shingles.slice(a, b - a)]
                out.append(confirm_blocks(rep[a:b], side[a:b], i[a] == j[a], sets, percent))
        if out := [x for x in out if x]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])


def _blocks() -> Column:
    """Blocks that a set of members is cut into."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _hub_pairs(sets: DataFrame, member: DataFrame) -> DataFrame:
    """Hubs against the members of their cluster, a block of members at a time.

    A hub is the member of most band collisions among those of its hash, so a text that
    many are copies of is one.
    """
    hubs = member.groupBy("cluster", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("nth")).agg(
        F.max_by("rep", F.struct("degree", "rep")).alias("rep")
    ).select("rep", F.lit(True).alias("is_hub"))
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return sets.join(hubs.hint("merge"), "rep", "left").select(
        "rep", "cluster", "shingles",
        F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("i"),
        F.lit(-1).alias("j"), F.when(F.col("is_hub"), 0).otherwise(1).alias("side"),
    )


def _block_pairs(sets: DataFrame, member: DataFrame, groups: DataFrame) -> DataFrame:
    """Block against block, but for two blocks of one group of linked documents.

    A cluster has at most HUBS groups, as each holds a hub, and the documents of none.
    """
    grouped_member = member.select("rep", "cluster", "n_shingles").join(
        groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep", "left"
    )
    within = Window.partitionBy("cluster")
    layout = grouped_member.groupBy("cluster", "group").agg(_blocks()).select(
        "cluster", "group", "blocks", F.sum("blocks").over(within).cast("int").alias("total"),
        (F.sum("blocks").over(within.orderBy("group")) - F.col("blocks")).cast("int").alias("start"),
    )
    place = grouped_member.alias("m").join(
        layout.alias("l"), (F.col("m.cluster") == F.col("l.cluster")) & F.col("m.group").eqNullSafe(F.col("l.group"))
    ).select(
        F.col("m.rep"), "start", "total", (F.col("start") + F.col("blocks")).alias("end"),
        F.col("m.group").isNotNull().alias("linked"),
        (F.col("start") + F.pmod(F.xxhash64("m.rep"), F.col("blocks"))).cast("int").alias("block"),
    )
    none = F.array().cast("array<int>")
    before = F.when(F.col("start") > 0, F.sequence(F.lit(0), F.col("start") - 1)).otherwise(none)
    after = F.when(F.col("end") < F.col("total"), F.sequence(F.col("end"), F.col("total") - 1)).otherwise(none)
    others = F.when(F.col("linked"), F.concat(before, after)).otherwise(F.sequence(F.lit(0), F.col("total") - 1))
    return sets.join(place.hint("merge"), "rep").select(
        "rep", "cluster", "shingles", "block", F.explode(others).alias("other")
    ).select(
        "rep", "cluster", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row; links are sets with a Jaccard similarity of percent / 100."""
    sketches = stage(sketch(docs), "minhash-sketch")
    # one representative per distinct set
    classes = stage(
        sketches.filter("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles")),
        "minhash-classes",
    )
    reps = sketches.filter("set_key is not null").select("doc_id", "set_key", "bands").join(
        classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi"
    )
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    ).filter("first < last")
    # at most BANDS first documents per document
    met = stage(
        keyed.join(shared, "key").groupBy("doc_id").agg(F.collect_set("first").alias("firsts"), F.sum("n").alias("degree")),
        "minhash-met",
    )
    meets = met.select(F.col("doc_id").alias("a"), F.explode("firsts").alias("b"))
    clusters = stage(connected_components(meets, "minhash-meets"), "minhash-clusters")

    # blocks: as many per cluster as its documents or shingles ask for
    member = clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")).join(
        classes.select("rep", "n_shingles"), "rep"
    ).join(met.select(F.col("doc_id").alias("rep"), "degree"), "rep")
    member = stage(member, "minhash-members")
    placed = member.join(member.groupBy("cluster").agg(_blocks()), "cluster").select("rep", "cluster", "blocks")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                sets = [shingle_set(t, cache).tobytes() for t in texts]
                part = batch.slice(at, len(texts)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], [*part.schema.names, "shingles"])
                at += len(texts)

    # the members grow with the corpus: they are never broadcast, whatever their number
    sets = stage(
        docs.select("doc_id", "text").join(placed.hint("merge"), F.col("doc_id") == F.col("rep"))
        .select("rep", "cluster", "blocks", "text")
        .mapInArrow(shingled, "rep long, cluster long, blocks int, shingles binary"),
        "minhash-sets",
    )
    wide, wide_member = sets.filter("blocks > 1"), member.join(placed.filter("blocks > 1").select("rep", "blocks"), "rep")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(
            lambda batches: confirm_groups(batches, percent), "a long, b long"
        )

    by_hub = stage(confirmed(_hub_pairs(wide, wide_member)), "minhash-hubs")
    groups = stage(connected_components(by_hub, "minhash-hub-links"), "minhash-groups")
    one = F.lit(0).cast("int")
    narrow = sets.filter("blocks = 1").select("rep", "cluster", "shingles", one.alias("i"), one.alias("j"), one.alias("side"))
    links = by_hub.union(confirmed(narrow.union(_block_pairs(wide, wide_member, groups))))
    joined = connected_components(links, "minhash-links")
    found = classes.select("set_key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    return (
        sketches.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def _row_ids(docs: DataFrame) -> DataFrame:
    """doc and text of every row with row_id: doc_id, but a hash above 2^62 for a null id and for further texts of an id.

    Rows of one id with different texts are so judged apart.
    """
    rows = packed(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    several = stage(
        rows.filter("doc_id is not null").groupBy("doc_id").agg(
            F.min("text_hash").alias("first_hash"), F.max("text_hash").alias("last_hash")
        ).filter("first_hash < last_hash").drop("last_hash"),
        "minhash-repeated-ids",
    )
    high = F.lit(1 << 62)
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(high - 1).bitwiseOR(high)
    other = F.col("doc_id").isNull() | F.coalesce(F.col("text_hash") != F.col("first_hash"), F.lit(False))
    return rows.join(several, "doc_id", "left").select("doc", "text", F.when(other, hashed).otherwise(F.col("doc_id")).alias("row_id"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts, that of the smallest id, and all rows with a blank text; with their own columns."""
    rows = _row_ids(docs)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = rows.filter(worded)
    kept = near_duplicates(texts.select(F.col("row_id").alias("doc_id"), "text"), percent).filter("kept").select(
        F.col("doc_id").alias("row_id")
    ).distinct()
    one = texts.select("doc", "row_id").join(kept, "row_id", "left_semi").dropDuplicates(["row_id"])
    return unpacked(one.select("doc").unionByName(rows.filter(~worded).select("doc")), docs.columns)
