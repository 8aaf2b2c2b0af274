"""Cross-tokenizer alignment against a plain definition over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from folioquery.llm import alignment
from folioquery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.default_tokenizers()
    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    letters = {c: x for x, c in bytes_to_letters().items()}
    return one, sentencepiece.SentencePieceProcessor(model_file=b), letters


def bytes_to_letters():
    """Letters of a byte-level vocabulary, found with the library: the ByteLevel step maps each byte to one letter."""
    from tokenizers import pre_tokenizers

    step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    known = {}
    for code in [*range(0x80), *range(0x80, 0x800), 0xFFFF, 0x10000, 0x40000, 0x80000, 0xC0000, 0x10FFFF, *range(0x800, 0xD800, 0x40), *range(0xE000, 0xFFFF, 0x40)]:
        raw = chr(code).encode()
        shown = "".join(p for p, _ in step.pre_tokenize_str(chr(code)))
        known.update(zip(raw, shown))
    return known


def tokens(libraries, text):
    one, two, letters = libraries
    want = (" " + text).encode()
    a = [(t, bytes(letters[c] for c in one.id_to_token(t))) for t in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for t in two.encode(text):
        p = two.id_to_piece(t)
        b.append((t, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return [], []
    return a, b


def brute(libraries, rows):
    parts, counts = [], collections.Counter()
    for _, text in rows:
        a, b = tokens(libraries, text or "")
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, lo = [], collections.Counter(), 0
        for hi in common:
            groups.append(",".join(str(t) for (t, _), e in zip(a, ends_a) if lo < e <= hi) + "|" + ",".join(str(t) for (t, _), e in zip(b, ends_b) if lo < e <= hi))
            lo = hi
        j = 0
        for i, (t, x) in enumerate(a):
            begin = ends_a[i] - len(x)
            while j and ends_b[j - 1] > begin:
                j -= 1
            while j < len(b) and ends_b[j] - len(b[j][1]) < ends_a[i]:
                if ends_b[j] > begin:
                    links[t, b[j][0]] += 1
                j += 1
        counts.update(links)
        parts.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, t), n in counts.items():
        most[t] = max(most[t], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, parts):
        out.append((
            doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[1]]),
            sum(n * counts[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        ))
    return sorted(out, key=repr)


def as_rows(frame):
    assert frame.columns == NAMES
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "the", "Über", "é", "é", " ", "  ", "\n", "\t", " ", "▁", "<|endoftext|>", "<s>", "x.y", "12", "🙂", "\x1c", "ﬁ", "​", "1,000", "'s"]
    fixed = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "a \n b", "the▁cat", "<unk> </s>", "word " * 300, "x" * 3000, "İ ﬁ", "　", "a b"]
    return fixed + ["".join(rng.choice(alphabet) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 25))) for _ in range(150)]


@pytest.mark.parametrize("records,fan_in", [(40, 2), (10**9, 256)])
def test_odd_rows(spark, libraries, monkeypatch, records, fan_in):
    monkeypatch.setattr(alignment, "RECORDS", records)
    monkeypatch.setattr(alignment, "TASK_BYTES", 2_000)
    rows = list(enumerate(odd_texts())) + [(None, "the same"), (None, "the same"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, chunk string, part int").repartition(5)
    assert as_rows(alignment.align(docs, fan_in=fan_in)) == brute(libraries, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert as_rows(alignment.align(docs)) == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert as_rows(alignment.align(docs)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_query_over_the_whole_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(QUERIES["op11_alignment"](spark, SF)) == brute(libraries, rows)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_heap_merge_counts_every_pair(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(block)
    want, runs = collections.Counter(), []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 60, rng.integers(1, 50)))
        links = rng.integers(1, 9, len(keys))
        for k, n in zip(keys.tolist(), links.tolist()):
            want[k] += n
        runs.append(alignment._blocks(keys, links))
    got = [(k, n) for ks, ns in alignment.heap_merged(runs) for k, n in zip(ks.tolist(), ns.tolist())]
    assert got == sorted(want.items())


def test_blocks_keep_their_numbers():
    columns = [np.array([0, 5, 2**40]), np.array([], np.int64), np.array([1, 0], bool)]
    assert [c.tolist() for c in alignment.expanded(alignment.squeezed(*columns), 3)] == [[0, 5, 2**40], [], [1, 0]]
