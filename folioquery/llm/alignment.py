"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Side A encodes blank + text, side B the text (its library adds the blank). Byte offsets where
tokens of both end cut a text into groups; every stretch between neighbouring cuts of either
side lies in one A and one B token and is one link. A blank between characters that are no
white space is always such a common cut, so a slice of texts is cut there and each of its
distinct segments is encoded and aligned once.

Counting. A task gathers (pair, document) records until it holds RECORDS of them, sorts them
side-major (B id, then A id, then document), cuts them by radix of the B id and writes each
part as a run of zstd blocks to a stage table in the shared folder; a lost executor costs
only the runs it had not written. Runs of a part are merged by a heap over their open blocks,
FAN_IN at a time and in as many levels as that takes, which counts every pair; as all pairs
of a B id are neighbours, the merge yields the highest count of each B id as it goes. The
counted pairs of a part then meet its runs again, dealt over as many tasks as the runs' size
asks for, and what each document gains from the part streams back to the document's chunk.

Bounds: a chunk holds RECORDS records, a merge the open blocks of its runs, a part's counts
at most the A ids times the B ids of the part, whatever the corpus. Hot ids make more tasks,
not larger ones. No rows of the corpus reach the driver; it learns one size per part.

Defined results: a text that is null or empty, or that one side's tokens do not spell, has
no tokens and an empty groups_sha256; null, equal and repeated ids give one row each and
count as documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import stage
from folioquery.llm.tokens import IdCache, Pool, byte_slices, gathered, numbered

#: Links a task gathers before it sorts and writes them, and documents of a chunk.
RECORDS = 3_000_000
DOC_BITS = 20
A_BITS = 20
#: Parts of the B ids.
RADIX = 32
#: Pairs of a block, and runs that are merged at a time.
BLOCK = 1 << 16
FAN_IN = 256
#: Bytes of runs that meet the counts of their part in one task.
TASK_BYTES = 16 << 20
#: A blank that may separate segments, and texts with other blanks (as Arrow writes white space).
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
IRREGULAR = f"(^| ){SPACE}|{SPACE}( |$)"
RUNS_DDL = "part int, chunk string, pairs array<binary>, docs array<binary>"
OUT_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
DOCS = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()),
])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- blocks of numbers ---------------------------------------------------------------


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit numbers, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(c) for c in columns], "<u4").tobytes() + planes)


def expanded(blob: bytes, columns: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(data, "<u4", columns).tolist(), 4 * columns, []
    for n in sizes:
        planes = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64))
        at += 8 * n
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending values, the first from 0."""
    return np.diff(values, prepend=0)


# ---- segments -------------------------------------------------------------------------


class Segments:
    """The distinct segments of a slice: token counts, groups, links and the spelling of their groups."""

    def __init__(self, aligner: Aligner, segments: pa.Array):
        texts = segments.to_pylist()
        spelt = [b" " + s.encode() for s in texts]
        a, b = Pool(aligner.a, pa.array([" " + s for s in texts], pa.string())), Pool(aligner.b, segments)
        self.ok = _spells(a, aligner.a_bytes, spelt) & _spells(b, aligner.b_bytes, spelt)
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        ids, ends = [], []
        for pool, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
            kept = pool.ids[np.repeat(self.ok, pool.sizes)].astype(np.int64)
            ids.append(kept)
            ends.append(np.cumsum(table.sizes[kept]))
        segment_ends = np.cumsum(np.where(self.ok, sizes, 0))
        total = int(segment_ends[-1]) if len(segment_ends) else 0
        cut = np.zeros((2, total + 1), bool)
        cut[0, ends[0]] = cut[1, ends[1]] = True
        cuts, common = np.flatnonzero(cut[0] | cut[1]), np.flatnonzero(cut[0] & cut[1])
        before = np.cumsum(cut, axis=1)  # tokens that end at or before an offset
        # the token of a side over a stretch: as many ends lie before the stretch's own
        link_a, link_b = ids[0][before[0, cuts - 1]], ids[1][before[1, cuts - 1]]
        self.pairs = (aligner.side(link_b) << A_BITS) | link_a
        self.n_a, self.n_b = np.where(self.ok, a.sizes, 0), np.where(self.ok, b.sizes, 0)
        self.link_ends = np.searchsorted(cuts, segment_ends, side="right")
        self.n_links = np.diff(self.link_ends, prepend=0)
        self.n_groups = np.diff(np.searchsorted(common, segment_ends, side="right"), prepend=0)
        self.spelling = self._spelling(ids, ends, cut, before, common, segment_ends)

    def _spelling(self, ids, ends, cut, before, common, segment_ends) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every segment."""
        group = np.cumsum(cut[0] & cut[1])
        group_a, group_b = group[ends[0] - 1], group[ends[1] - 1]
        place_a = np.arange(len(ids[0])) + np.r_[0, before[1, common]][group_a]
        place_b = np.arange(len(ids[1])) + before[0, common][group_b]
        n = len(ids[0]) + len(ids[1])
        token, sign = np.empty(n, np.int64), np.empty(n, np.uint8)
        token[place_a], token[place_b] = ids[0], ids[1]
        sign[place_a] = np.where(cut[1, ends[0]], ord("|"), ord(","))
        sign[place_b] = np.where(cut[0, ends[1]], ord(";"), ord(","))
        last = np.zeros(len(cut[0]), bool)
        last[segment_ends] = True
        sign[place_b[last[ends[1]]]] = 0
        digits = len(str(int(token.max()))) if n else 1
        powers = 10 ** np.arange(digits - 1, -1, -1)
        chars = np.empty((n, digits + 1), np.uint8)
        chars[:, :digits] = token[:, None] // powers % 10 + ord("0")
        chars[:, digits] = sign
        shown = np.empty(chars.shape, bool)
        shown[:, :digits] = (token[:, None] >= powers) | (powers == 1)
        shown[:, digits] = sign > 0
        data = chars[shown].tobytes()
        widths = np.r_[0, np.cumsum(shown.sum(axis=1))]
        borders = widths[np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [data[x:y] for x, y in zip(borders, borders[1:], strict=False)]


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)


def _spells(pool: Pool, table: Bytes, spelt: list[bytes]) -> np.ndarray:
    """Whether the tokens of each string are its bytes."""
    ids = pool.ids.astype(np.int64)
    got = table.data[gathered(table.starts[ids], table.sizes[ids])].tobytes()
    ends = np.r_[0, np.cumsum(table.sizes[ids])][np.r_[0, np.cumsum(pool.sizes)]].tolist()
    return np.fromiter((got[x:y] == s for x, y, s in zip(ends, ends[1:], spelt, strict=False)), bool, len(spelt))


class Aligner:
    """Both tokenizers of a worker, with the segments it has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core to a task
        import sentencepiece
        from tokenizers import Tokenizer

        one, two = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        one.encode_special_tokens = True
        one.no_truncation()
        one.no_padding()
        entries = [one.id_to_token(i) or "" for i in range(one.get_vocab_size())]
        letters = _byte_letters()
        self.a_bytes = Bytes([bytes(letters.get(c, 0) for c in e) for e in entries])
        pieces = [two.id_to_piece(i) for i in range(two.get_piece_size())]
        self.b_bytes = Bytes([_piece_bytes(p) for p in pieces])
        #: Without a piece that holds a blank after another character, no token of B crosses one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a = IdCache(lambda strings: [e.ids for e in one.encode_batch_fast(strings, add_special_tokens=False)])
        self.b = IdCache(lambda strings: two.encode(strings, num_threads=1))
        self.span = -(-len(pieces) // RADIX)

    def side(self, b: np.ndarray) -> np.ndarray:
        """B ids numbered part by part."""
        return b % RADIX * self.span + b // RADIX

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Borders of the texts' segments, their numbers, and the distinct ones."""
        if self.cuts and not pc.any(pc.match_substring_regex(texts, IRREGULAR)).as_py():
            lists = pc.split_pattern(texts, " ")
            offsets, parts = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        else:
            cut = [CUT.split(t) if self.cuts else [t] for t in texts.to_pylist()]
            offsets = np.r_[0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
            parts = pa.array([s for c in cut for s in c], pa.string())
        numbers, segments = numbered(parts)
        return offsets - offsets[0], numbers, segments


def _byte_letters() -> dict[str, int]:
    """The printable letter of every byte in a byte-level vocabulary: itself where it is printable, else the next free."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---- runs ------------------------------------------------------------------------------


class Chunk:
    """Documents and records of a task until they are written."""

    def __init__(self):
        self.docs: list[pa.RecordBatch] = []
        self.keys: list[np.ndarray] = []
        self.n_docs = self.n_records = 0

    def add(self, docs: pa.RecordBatch, keys: np.ndarray) -> None:
        self.docs.append(docs)
        self.keys.append(keys)
        self.n_docs += docs.num_rows
        self.n_records += len(keys)

    def rows(self, span: int) -> list[tuple]:
        """The documents' row (part -1) and a run for every part."""
        chunk = uuid.uuid4().hex
        table = pa.Table.from_batches(self.docs, DOCS).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        rows = [(-1, chunk, [], [sink.getvalue().to_pybytes()])]
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        borders = np.searchsorted(keys, np.arange(RADIX + 1) * span << (A_BITS + DOC_BITS))
        for part, (x, y) in enumerate(zip(borders, borders[1:], strict=False)):
            if x < y:
                rows.append((part, chunk, *_run(keys[x:y], times[x:y])))
        return rows


def _run(keys: np.ndarray, times: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Blocks of a run: pairs with their links, and beside each the documents of its pairs with theirs."""
    pair, doc = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1)
    firsts = np.flatnonzero(np.diff(pair, prepend=-1))
    links = np.add.reduceat(times, firsts)
    after = np.diff(doc, prepend=0)
    after[firsts] = doc[firsts]
    ends = np.r_[firsts, len(pair)]
    pairs, docs = [], []
    for x in range(0, len(firsts), BLOCK):
        at = firsts[x : x + BLOCK]
        lo, hi = ends[x], ends[x + len(at)]
        pairs.append(squeezed(steps(pair[at]), links[x : x + BLOCK]))
        docs.append(squeezed(np.diff(ends[x : x + len(at) + 1]), after[lo:hi], times[lo:hi]))
    return pairs, docs


def spilled(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every chunk's documents and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = aligner(path_a, path_b), Chunk()
        for batch in batches:
            for first, texts in byte_slices(batch.column(1)):
                for at in range(0, len(texts), 1 << DOC_BITS):
                    part = texts.slice(at, 1 << DOC_BITS)
                    ids = batch.column(0).slice(first + at, len(part))
                    if chunk.n_docs + len(part) > 1 << DOC_BITS:
                        yield _rows(chunk.rows(both.span))
                        chunk = Chunk()
                    chunk.add(*_aligned(both, ids, part, chunk.n_docs))
                    if chunk.n_records >= RECORDS:
                        yield _rows(chunk.rows(both.span))
                        chunk = Chunk()
        if chunk.n_docs:
            yield _rows(chunk.rows(both.span))

    return docs.select("doc_id", "text").mapInArrow(run, RUNS_DDL)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()))
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "pairs", "docs"])


def _aligned(both: Aligner, ids: pa.Array, texts: pa.Array, first_doc: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the documents, and a key (pair, document) for every link."""
    offsets, numbers, distinct = both.segments(texts)
    seg = Segments(both, distinct)
    n_segments = np.diff(offsets)
    wrong = np.r_[0, np.cumsum(~seg.ok[numbers])]
    ok = (np.diff(wrong[offsets]) == 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)

    def total(of_segment: np.ndarray) -> np.ndarray:
        return np.where(ok, np.diff(np.r_[0, np.cumsum(of_segment[numbers])][offsets]), 0)

    spelt, at, hashes = seg.spelling, numbers.tolist(), []
    for good, x, y in zip(ok.tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
        hashes.append(hashlib.sha256(b";".join([spelt[i] for i in at[x:y]])).hexdigest() if good else "")
    rows = pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), *(pa.array(total(c)) for c in (seg.n_a, seg.n_b, seg.n_groups, seg.n_links)), pa.array(hashes, pa.string())],
        schema=DOCS,
    )
    taken = numbers[np.repeat(ok, n_segments)]
    doc = np.repeat(first_doc + np.flatnonzero(ok), n_segments[ok])
    lengths = seg.n_links[taken]
    links = gathered(seg.link_ends[taken] - lengths, lengths)
    return rows, (seg.pairs[links] << DOC_BITS) | np.repeat(doc, lengths)


# ---- counting --------------------------------------------------------------------------


def heap_merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all runs in order with their links, each pair once.

    The heap holds the last pair of each run's open block. No closed block has a pair below
    its least, so all open pairs up to that one can be counted.
    """
    open_, following, heap = {}, [iter(r) for r in runs], []

    def advance(i: int) -> None:
        blob = next(following[i], None)
        open_.pop(i, None)
        if blob is not None:
            keys, links = expanded(blob, 2)
            keys = np.cumsum(keys)
            open_[i] = (keys, links)
            heapq.heappush(heap, (int(keys[-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        bound = heap[0][0]
        taken = []
        for i, (keys, links) in open_.items():
            n = int(np.searchsorted(keys, bound, side="right"))
            if n:
                taken.append((keys[:n], links[:n]))
                open_[i] = (keys[n:], links[n:])
        keys = np.concatenate([k for k, _ in taken])
        links = np.concatenate([n for _, n in taken])
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[firsts], np.add.reduceat(links, firsts)
        while heap and heap[0][0] == bound:
            advance(heapq.heappop(heap)[1])


def _blocks(keys: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    return [squeezed(steps(keys[x : x + BLOCK]), *(c[x : x + BLOCK] for c in columns)) for x in range(0, len(keys), BLOCK)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches as (values of the first ``keys`` columns, iterator of the other columns), group by group."""
    import itertools

    rows = (row for b in batches for i in range(b.num_rows) for row in zip(*(c.slice(i, 1).to_pylist() for c in b.columns), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, (r[keys:] for r in group)


def counted(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, pairs): all pairs of a part in blocks with their links and whether these are their B id's most."""

    def merge(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (part, group), rows in _groups(batches, 2):
                merged = list(heap_merged([pairs for (pairs,) in rows]))
                keys, links = (np.concatenate(c) for c in zip(*merged, strict=True))
                columns = [links]
                if last:
                    firsts = np.flatnonzero(np.diff(keys >> A_BITS, prepend=-1))
                    most = np.repeat(np.maximum.reduceat(links, firsts), np.diff(np.r_[firsts, len(keys)]))
                    columns.append(links == most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([group], pa.int64()), pa.array([_blocks(keys, *columns)], pa.list_(pa.binary()))],
                    ["part", "grp", "pairs"],
                )

        return run

    level, of = runs.select("part", F.xxhash64("chunk").alias("of"), "pairs"), n_runs
    while True:
        of = -(-of // fan_in)
        level = (
            level.withColumn("grp", F.pmod("of", F.lit(of))).select("part", "grp", "pairs").repartition("part", "grp")
            .sortWithinPartitions("part", "grp").mapInArrow(merge(of <= 1), "part int, grp long, pairs array<binary>")
        )
        if of <= 1:
            return level.select("part", "pairs")
        level = level.select("part", F.xxhash64("grp").alias("of"), "pairs")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, gains): for every run of a part, what its documents gain from the counts of the part."""
    for _, rows in _groups(batches, 2):
        keys = links = best = None
        for kind, chunk, pairs, docs in rows:
            if kind == 0:
                blocks = [expanded(b, 3) for b in pairs]
                keys = np.concatenate([np.cumsum(b[0]) for b in blocks])
                links, best = (np.concatenate([b[i] for b in blocks]) for i in (1, 2))
                continue
            low = high = bests = np.zeros(0)
            for pair_block, doc_block in zip(pairs, docs, strict=True):
                at = np.searchsorted(keys, np.cumsum(expanded(pair_block, 2)[0]))
                sizes, doc, times = expanded(doc_block, 3)
                # documents are differences within their pair
                total = np.cumsum(doc)
                firsts = np.cumsum(sizes) - sizes
                doc = total - np.repeat(total[firsts] - doc[firsts], sizes)
                n = np.repeat(links[at], sizes)
                # sums of doubles are exact: no addend of either half reaches 2 ** 52
                low = _plus(low, np.bincount(doc, (n & 0x3FFFFFF) * times))
                high = _plus(high, np.bincount(doc, (n >> 26) * times))
                bests = _plus(bests, np.bincount(doc, np.repeat(best[at], sizes) * times))
            gained = np.flatnonzero(low + high)
            sums = low.astype(np.int64) + (high.astype(np.int64) << 26)
            gains = squeezed(steps(gained), sums[gained], bests.astype(np.int64)[gained])
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.string()), pa.array([1], pa.int32()), pa.array([gains], pa.binary())], ["chunk", "kind", "blob"]
            )


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    return a + np.pad(b, (0, len(a) - len(b)))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk's documents with all their gains."""
    for _, rows in _groups(batches, 1):
        table = sums = bests = None
        for kind, blob in rows:
            if kind == 0:
                table = pa.ipc.open_stream(blob).read_all().combine_chunks()
                sums, bests = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
            else:
                docs, gained, best = expanded(blob, 3)
                docs = np.cumsum(docs)
                sums[docs] += gained
                bests[docs] += best
        table = table.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))
        names = [c.split()[0] for c in OUT_DDL.split(", ")]
        yield from table.select(names).to_batches()


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, and the corpus counts of its links."""
    if path_a is None or path_b is None:
        path_a, path_b = default_tokenizers()
    written = stage(spilled(docs, path_a, path_b), "alignment-runs")
    chunks = written.filter("part = -1").select("chunk", F.lit(0).alias("kind"), F.col("docs")[0].alias("blob"))
    runs = written.filter("part >= 0")
    sizes = runs.groupBy("part").agg(
        F.count("*").alias("runs"), F.sum(F.aggregate("docs", F.lit(0), lambda n, b: n + F.length(b))).alias("bytes")
    ).collect()  # at most RADIX rows
    counts = counted(runs, max((r["runs"] for r in sizes), default=1), fan_in)
    # tasks of a part: at most RADIX values
    tasks = [1] * RADIX
    for r in sizes:
        tasks[r["part"]] += r["bytes"] // TASK_BYTES
    n_tasks = F.get(F.array(*map(F.lit, tasks)), F.col("part"))
    empty = F.array().cast("array<binary>")
    met = runs.select(
        "part", F.pmod(F.xxhash64("chunk"), n_tasks).alias("task"), F.lit(1).alias("kind"), "chunk", "pairs", "docs"
    ).unionByName(counts.select(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), n_tasks.cast("long") - 1)).alias("task"), F.lit(0).alias("kind"),
        F.lit("").alias("chunk"), "pairs", empty.alias("docs"),
    ))
    gains = met.repartition("part", "task").sortWithinPartitions("part", "task", "kind").mapInArrow(
        _contributions, "chunk string, kind int, blob binary"
    )
    return chunks.unionByName(gains).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_finished, OUT_DDL)
