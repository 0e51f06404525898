import random
import zlib
from collections import Counter

from plywise.llm import sharding


def check(rows, got, tolerance=0.01, atom=None):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in shards.values())
    assert all(0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None for r in got)
    total, largest = sum(r.size for r in got), atom or max(r.size for r in got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(abs(x - total / 16) for x in sizes) <= tolerance * total / 16 + largest, sizes


def test_query_balances_bytes_and_keeps_copies_together(spark, make_docs, folder_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 5, 50, 500]) + str(rng.random())) for i in range(3000)]
    rows += [(4000 + i, f"copied text {i % 40}") for i in range(400)] + [(9000, None), (9001, ""), (None, "né"), (5, rows[5][1]), (5, rows[5][1])]
    folder = folder_of(documents=make_docs(rows).withColumnRenamed("lang", "size").withColumnRenamed("source", "shard"))
    got = sharding.op9_sharding(spark, folder).collect()
    check(rows, got)
    places = {}
    text = dict(rows)
    for r in got:
        places.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert sum(len(v) > 1 for v in places.values()) <= 1
    assert sorted(map(str, sharding.op9_sharding(spark, folder).collect())) == sorted(map(str, got))


def test_one_text_with_most_bytes_is_cut_inside(spark, make_docs, folder_of):
    rows = [(i, "the same text, again and again") for i in range(4000)] + [(5000 + i, f"other {i}") for i in range(300)]
    check(rows, sharding.op9_sharding(spark, folder_of(documents=make_docs(rows, 5))).collect())


def test_few_rows_and_none(spark, make_docs, folder_of):
    rows = [(1, "a"), (2, "b" * 100), (3, None)]
    check(rows, sharding.op9_sharding(spark, folder_of(documents=make_docs(rows, 2))).collect())
    assert sharding.op9_sharding(spark, folder_of(documents=make_docs([]))).count() == 0
