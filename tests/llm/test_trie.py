import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plywise.llm import radix, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def slow(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_id(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        again[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        found, todo = [], [p]
        while todo:
            x = todo.pop()
            found.append(x)
            todo += children.get(x, [])
        return found

    out = set()
    for p, convs in members.items():
        tree = below(p)
        ends = ",".join(map(str, sorted(c for c in convs if again[c] == p)))
        out.add((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children.get(p, [])),
                 sum(x not in children for x in tree), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(frame):
    rows = trie.prefix_trie(frame).select(*COLUMNS).collect()
    assert all(t == "bigint" for c, t in trie.prefix_trie(frame.limit(0)).dtypes if c != "ends_sha256")
    return sorted(map(tuple, rows), key=str)


def some_rows(seed, convs=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        kind = rng.random()
        if kind < 0.3:
            turns = [("user", "same start"), ("assistant", "same é answer"), ("user", "end")][: rng.randint(1, 3)]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "", "ü"])) for _ in range(rng.randint(1, 14))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [8_000_000, 400])
def test_as_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(trie, "TREE_BYTES", size)
    monkeypatch.setattr(trie, "CHUNK", 5)
    rows = some_rows(1)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == sorted(slow(rows), key=str)


def test_edge_cases(spark):
    rows = some_rows(2, 40)
    rows += [(None, 0, "user", "nobody's"), (1000, None, None, None), (1000, 0, "user", None), (1000, None, "user", "x"), (1001, 3, "user", "tie"),
             (1001, 3, "user", "tie"), (1001, 3, "assistant", "tie"), (-7, 0, "user", "below zero"), (-5, 0, "user", "base"), (7777, 0, "user", "y" * 300_000)]
    rows += [(2000 + 5 * i, 0, "user", "only") for i in range(40)]
    rows += [(3000, i, "user", str(i % 2)) for i in range(1200)] + [(3001, i, "user", str(i % 2)) for i in range(1199)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.withColumns({c: F.lit(1) for c in ("node", "n", "depth", "turns", "base", "id", "bytes", "saved")})
    assert got(frame) == sorted(slow(rows), key=str)


def test_a_conversation_may_lose_all_turns(spark):
    short = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)  # its base is absent
    rows = [(short, 0, "user", "gone")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_tree_holds_keys_of_all_layouts():
    rng = random.Random(3)
    keys = [bytes([a, b, 7, 7, c]) for a in range(3) for b in range(0, 256, (1, 6, 20)[a]) for c in range(2)]
    keys += [b"", b"\x00", b"\x00\x01", bytes(40), bytes(39) + b"\x01", bytes(40)]
    rng.shuffle(keys)
    tree = radix.Tree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    paths, held, layouts = [], {}, set()
    for above, depth, own, values in tree.walk():
        paths.append((paths[above] if above >= 0 else b"") + own)
        assert len(paths[-1]) == depth
        for v in values:
            held[v] = paths[-1]
    assert held == dict(enumerate(keys))
    todo = [tree.root]
    while todo:
        node = todo.pop()
        if node.kids is not None:
            layouts.add((type(node.kids).__name__, getattr(node.kids, "most", None)))
            todo += [k for _, k in node.kids]
    assert layouts == {("_Sorted", 4), ("_Sorted", 16), ("_Indexed", None), ("_Direct", None)}


def test_query_agrees_with_its_sql(spark, folder_of):
    duckdb = pytest.importorskip("duckdb")
    folder = folder_of(conversations=spark.createDataFrame(some_rows(4), SCHEMA))
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = duckdb.sql(trie.OP12_SQL).project(", ".join(COLUMNS)).fetchall()
    found = trie.op12_trie(spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
