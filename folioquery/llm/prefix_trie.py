"""Prefix trie of rebuilt conversations, by vertical bitmaps.

A turn is known by the first 16 bytes of the SHA-256 digest of its role and text, a prefix by
the turns' digests one after another, a conversation's *path*. Texts never leave the scan.

Equal rebuilt conversations are one class with a size, a least id and the hash of its ids.
The distinct paths are dealt by ranges of their order, so shards hold equal numbers of
classes whatever turn they share, and within a shard in blocks of SHARD classes. A block's
index maps (position, turn) to a bitset of its classes; sizes are kept as bit planes. The
trie is walked depth first: a child's bitset is its parent's and a posting, its members are
counted by intersecting with the planes. Paths of a block are neighbours in order, so only
nodes on its first and last path can have members elsewhere. All other nodes leave the block
complete. Those on the two paths (the border) leave it in parts, which are added up per
node; what a border node's descendants on the border add to its subtree is found by sums
along the border paths, each node counted on one path only.

The hash of a class of a third of all conversations needs its ids in order: they are sorted
by ranges of (class, id), written out as long strings by many tasks, and one task reads only
those strings, one at a time.

Bounds: a block holds SHARD paths, 16 bytes and one number a turn; the turns of one
conversation must fit in a task. Nothing of the corpus reaches the driver.

Defined results: null roles and texts are empty; turns with equal numbers follow by role,
then by the digest of role and text; rows without conv_id belong to no conversation and are
left out; a remainder of a negative id has its sign; other columns are ignored; an empty
table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.common import stage

#: Conversations whose first turns are exchanged, and bound of the number of turns taken over.
FAMILY = 5
TURNS = 9
#: Classes of a block, bytes of their paths, and rows that are sent at a time.
SHARD = 4096
BLOCK_BYTES = 32 << 20
ROWS = 10_000
#: Bytes of a turn's digest.
TURN = 16
#: Characters of ids that a string of ids holds before it is sent.
STRING_CHARS = 1 << 20
NO_IDS = hashlib.sha256(b"").hexdigest()
NODES_DDL = (
    "kind string, path long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, turn_bytes long, ends_sha256 string"
)


# ---- rebuilding ------------------------------------------------------------------------


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests and text bytes of every conversation's rebuilt turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * TURN))
    rows = turns.filter("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n")).alias("t")
    )
    # ascending order puts null turns first
    own = stage(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: t["digest"]).alias("digests"), F.transform("t", lambda t: t["n"]).alias("sizes")
    ), "conversations")
    base = own.select(F.col("conv_id").alias("base_id"), F.col("digests").alias("base_digests"), F.col("sizes").alias("base_sizes"))
    joined = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS).cast("int")
    ).join(base, "base_id", "left")

    def spliced(name: str, kind: str):
        first = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(first, F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0))))

    digests = spliced("digests", "array<binary>")
    return joined.select(
        "conv_id", F.unhex(F.array_join(F.transform(digests, F.hex), "")).alias("path"), spliced("sizes", "array<bigint>").alias("sizes")
    )


# ---- classes of equal conversations -------------------------------------------------------


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a class in this task as strings: (class, first id, ids, their number)."""
    held: list[int] = []
    current, chars = None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))]), pa.array([len(held)], pa.int64())],
            ["class", "first", "ids", "n"],
        )

    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (key != current or chars > STRING_CHARS):
                yield row()
                held, chars = [], 0
            current = key
            held.append(conv_id)
            chars += 20
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, first, n, ends_sha256) from a class's strings in order of their first id."""
    current, least, n, digest, rows = None, 0, 0, None, []

    def sent() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["class", "first", "n", "ends_sha256"]
        )

    for batch in batches:
        for key, first, ids, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is not None and key == current:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if digest is not None:
                rows.append((current, least, n, digest.hexdigest()))
            current, least, n, digest = key, first, count, hashlib.sha256(ids.encode())
        if rows:
            yield sent()
            rows = []
    if digest is not None:
        rows.append((current, least, n, digest.hexdigest()))
        yield sent()


def classes(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes, n, ends_sha256): every distinct path with its least conversation."""
    keyed = conversations.withColumn("class", F.unhex(F.sha2("path", 256)))
    strings = keyed.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInArrow(
        _strings, "class binary, first long, ids string, n long"
    )
    sums = strings.repartition("class").sortWithinPartitions("class", "first").mapInArrow(
        _hashed, "class binary, first long, n long, ends_sha256 string"
    )
    return keyed.join(
        sums.select(F.col("first").alias("conv_id"), "n", "ends_sha256"), "conv_id"
    ).select("conv_id", "path", "sizes", "n", "ends_sha256")


# ---- the walk ---------------------------------------------------------------------------


class Frame:
    """A node on the way of the walk: its classes, those not yet walked, and what its children have added."""

    __slots__ = ("bits", "left", "depth", "digest", "size", "on", "children", "leaves", "saved")

    def __init__(self, bits: int, ending: int, depth: int, digest, size: int, on: tuple[bool, bool]):
        self.bits, self.left, self.depth, self.digest, self.size, self.on = bits, bits & ~ending, depth, digest, size, on
        self.children = self.leaves = self.saved = 0


class Block:
    """Vertical bitmaps over classes (conv_id, path, sizes, n, ends_sha256) with neighbouring paths, in order.

    Bit i is the class with the i-th least conv_id, so the lowest bit of a bitset names its least conversation.
    """

    def __init__(self, rows: list[tuple]):
        self.borders = tuple(_turns(rows[i][1]) for i in (0, -1))
        rows = sorted(rows)
        self.ids, self.sizes, self.ends = [r[0] for r in rows], [r[2] for r in rows], [r[4] for r in rows]
        self.turns = [_turns(r[1]) for r in rows]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ending: dict[int, int] = {}  # depth: classes that end there
        self.planes = [0] * max(r[3] for r in rows).bit_length()
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            for posting in enumerate(turns):
                self.postings[posting] = self.postings.get(posting, 0) | bit
            self.ending[len(turns)] = self.ending.get(len(turns), 0) | bit
            for p in range(len(self.planes)):
                if rows[i][3] >> p & 1:
                    self.planes[p] |= bit

    def members(self, bits: int) -> int:
        return sum((bits & plane).bit_count() << p for p, plane in enumerate(self.planes))

    def walk(self, paths: tuple[int, int]) -> Iterator[tuple]:
        """Rows of NODES_DDL for every node, children first; ``paths`` number the block's first and last path."""
        everything = (1 << len(self.turns)) - 1
        stack = [Frame(everything, self.ending.get(0, 0), 0, hashlib.sha256(), 0, (True, True))]
        while stack:
            f = stack[-1]
            if not f.left:
                stack.pop()
                yield from self._rows(f, stack[-1] if stack else None, paths)
                continue
            i = _lowest(f.left)
            turn = self.turns[i][f.depth]
            bits = f.bits & self.postings[f.depth, turn]
            f.left &= ~bits
            digest = f.digest.copy()
            digest.update(turn)
            on = tuple(o and len(b) > f.depth and b[f.depth] == turn for o, b in zip(f.on, self.borders, strict=True))
            stack.append(Frame(bits, self.ending.get(f.depth + 1, 0), f.depth + 1, digest, self.sizes[i][f.depth], on))

    def _rows(self, f: Frame, parent: Frame | None, paths: tuple[int, int]) -> Iterator[tuple]:
        n, conv_id = self.members(f.bits), self.ids[_lowest(f.bits)]
        ended = f.bits & self.ending.get(f.depth, 0)  # paths differ, so at most one class
        ends = self.ends[_lowest(ended)] if ended else None
        above = parent.digest.digest() if parent else None
        if any(f.on):
            if parent:  # what hangs below the border inside this block
                parent.leaves += f.leaves
                parent.saved += f.saved
            first = 0 if f.on[0] else 1
            yield (
                "border", paths[first], f.digest.digest(), above, conv_id, f.depth, None, n, f.children, f.leaves, f.saved, f.size, ends
            )
            if all(f.on):  # on the other path as well, where it adds nothing
                yield "border", paths[1], f.digest.digest(), above, conv_id, f.depth, None, 0, 0, 0, 0, f.size, None
            return
        leaves, saved = f.leaves or 1, f.saved + (n - 1) * f.size
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        hung = any(parent.on)
        yield (
            "hung" if hung else "inner", paths[0 if parent.on[0] else 1] if hung else None, None, above if hung else None, conv_id,
            f.depth, None if hung else self.ids[_lowest(parent.bits)], n, f.children, leaves, saved, f.size, ends or NO_IDS,
        )


def _turns(path: bytes) -> list[bytes]:
    return [path[i : i + TURN] for i in range(0, len(path), TURN)]


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _walk(shard: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of all blocks of a task, whose classes come in order of their paths."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODES_DDL.split(", "))])

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, block in enumerate(_cut(batches, shard), TaskContext.get().partitionId() << 32):
            rows = Block(block).walk((2 * number, 2 * number + 1))
            while part := list(itertools.islice(rows, at_once)):
                yield sent(part)

    return run


def _cut(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[list[tuple]]:
    """Blocks of at most ``shard`` classes and about BLOCK_BYTES of paths."""
    block: list[tuple] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True):
                if len(block) == shard or held > BLOCK_BYTES:
                    yield block
                    block, held = [], 0
                block.append(row)
                held += len(row[1])
    if block:
        yield block


def trie(turns: DataFrame, shard: int = SHARD, at_once: int = ROWS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text)."""
    distinct = stage(classes(stage(rebuilt(turns), "rebuilt")), "classes")
    rows = stage(
        distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_walk(shard, at_once), NODES_DDL), "trie-nodes"
    )
    border = rows.filter("kind = 'border'")
    # parts of a border node, added up; n_children and the sums below cover what lies inside blocks
    whole = border.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("turn_bytes").alias("turn_bytes"), F.max("ends_sha256").alias("ends_sha256"), F.min("path").alias("owner"),
    )
    below = whole.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    whole = stage(whole.join(below, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    ).drop("more"), "border-nodes")
    # each border node adds to the nodes above it on one path, its owner
    own = F.col("path") == F.col("owner")
    along = Window.partitionBy("path").orderBy(F.desc("depth"))
    sums = border.select("path", "node", "depth").join(whole.select(
        "node", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("turn_bytes")).alias("save")
    ), "node").select(
        "node", F.sum(F.when(own, F.col("leaf")).otherwise(0)).over(along).alias("leaf"),
        F.sum(F.when(own, F.col("save")).otherwise(0)).over(along).alias("save"),
    ).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    on_border = whole.join(sums, "node").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("save"),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_IDS)),
    }).join(above, "parent", "left")
    # a block's nodes meet their parent on the block's own path, so that no parent gathers all its children
    places = border.select("path", F.col("node").alias("parent")).join(above, "parent")
    hung = rows.filter("kind = 'hung'").drop("parent_conv_id").join(places, ["path", "parent"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return rows.filter("kind = 'inner'").select(names).unionByName(hung.select(names)).unionByName(on_border.select(names))


# ---- the same by SQL -----------------------------------------------------------------------

#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id AS c, max(pos) AS n, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {TURNS} AS h FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT c, pos, key, strlen(text) AS size FROM ids JOIN own ON conv_id = base AND pos <= h
  UNION ALL
  SELECT i.c, coalesce(least(i.h, b.n), 0) + o.pos - i.h, o.key, strlen(o.text)
  FROM ids i JOIN own o ON o.conv_id = i.c AND o.pos > i.h LEFT JOIN ids b ON b.c = i.base
),
paths AS (
  SELECT i.c, coalesce(string_agg(r.key, '' ORDER BY r.pos), '') AS path, count(r.key) AS n,
    list(r.size ORDER BY r.pos) AS sizes FROM ids i LEFT JOIN rebuilt r USING (c) GROUP BY i.c
),
members AS (
  SELECT c, d, left(path, 64 * d) AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = n AS last
  FROM (SELECT *, unnest(range(n + 1)) AS d FROM paths)
),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS save,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM members GROUP BY node, d
),
kids AS (SELECT left(node, 64 * (d - 1)) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(node, 64 * up) AS node, sum(save) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT n.*, k.n IS NULL AS leaf, unnest(range(n.d + 1)) AS up FROM nodes n LEFT JOIN kids k USING (node)) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node)
LEFT JOIN nodes p ON n.d > 0 AND p.node = left(n.node, 64 * (n.d - 1))"""
