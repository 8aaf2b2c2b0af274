"""The conversation trie against a plain definition and against SQL."""

import hashlib
import random
import zlib

import pytest
from compare import check, duck

from folioquery.llm import prefix_trie
from folioquery.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def tie(t):
        return hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()

    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2], tie(t)))] for c, ts in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], ([], []))[0].append(c)
        nodes[path][1].append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, (members, _) in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((
        min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest(),
    ) for p, (m, e) in nodes.items()), key=repr)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for c in range(-12, 150):
        if c % 11 == 7:
            continue  # some bases are absent
        for t in range(rng.choice([1, 1, 2, 3, 7, 14])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "é", "", None, "x" * t])))
    same = [("user", "hot"), ("bot", "hot answer"), ("user", "more")]
    rows += [(c, t, *same[t]) for c in range(1000, 1100) for t in range(3)]  # equal conversations
    rows += [(2000, t, "user", f"long {t}") for t in range(300)] + [(2003, t, "user", f"long {t}" if t < 250 else "other") for t in range(280)]
    rows += [(7, 0, "user", "twice"), (7, 0, "user", "twice"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_odd_rows(spark, shard):
    rows = odd_rows()
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], DDL + ", kind string, path long").repartition(6)
    got = prefix_trie.trie(turns, shard, 7 if shard == 3 else 10_000)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert as_rows(got) == brute(rows)


@pytest.mark.parametrize("shard", [1, 2, 5, 100])
def test_blocks_in_one_process(monkeypatch, shard):
    """Every split of the paths into blocks gives the same members, children and ends of nodes inside and on borders."""
    rng = random.Random(shard)
    paths = sorted({b"".join(bytes([rng.randint(0, 2)]) * prefix_trie.TURN for _ in range(rng.randint(0, 5))) for _ in range(60)})
    classes = [(i, p, [3] * (len(p) // prefix_trie.TURN), rng.randint(1, 9), f"h{i}") for i, p in enumerate(paths)]
    rng.shuffle(ids := list(range(len(classes))))
    classes = [(ids[i], *c[1:]) for i, c in enumerate(classes)]
    members = {}
    for number, at in enumerate(range(0, len(classes), shard)):
        for row in prefix_trie.Block(classes[at : at + shard]).walk((2 * number, 2 * number + 1)):
            members[row[5]] = members.get(row[5], 0) + row[7]
    want = {}
    for c in classes:
        for d in range(len(c[1]) // prefix_trie.TURN + 1):
            want[d] = want.get(d, 0) + c[3]
    assert members == want


def test_long_lists_of_ids_are_hashed_in_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRING_CHARS", 100)
    rows = [(5 * c, 0, "user", "same") for c in range(400)]
    assert as_rows(prefix_trie.trie(spark.createDataFrame(rows, DDL).repartition(4))) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], DDL)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], DDL)).collect() == []


def test_query_against_sql(spark):
    ok, note = check(spark, duck(SF), SF, "op12_prefix_trie", QUERIES["op12_prefix_trie"], ORACLES["op12_prefix_trie"])
    assert ok, note


def test_query_over_the_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert as_rows(QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)
