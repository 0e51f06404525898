import random
import re

import pytest
from pyspark.sql import functions as F

from plywise.llm import mixing


def slow_targets(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in rest)
        now = {s: left * weight[s] / w for s in rest}
        above = [s for s in rest if now[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return full | now
        full |= {s: 3 * sizes[s] for s in above}


def corpus(rng):
    rows = []
    sources = ["b", "a", "Z", "é", "aa", "tiny", "", "none"]
    for i in range(1500):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources[:5])
        rows.append((i, " ".join(["w"] * rng.choice([1, 3, 40, 400])), s))
    rows += [(5000, "one two", "tiny"), (5001, None, "none"), (5002, "", "none"), (5003, None, None), (5004, "x " * 30000, None),
             (5005, "x " * 3000, ""), (5006, None, "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "a b c", "a")]
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "SHARD", 512)


@pytest.mark.parametrize("blocks", ["production", "small"])
def test_query_meets_its_targets(spark, make_docs, folder_of, request, blocks):
    if blocks == "small":
        request.getfixturevalue("small_blocks")
    rows = corpus(random.Random(6))
    folder = folder_of(documents=make_docs(rows).withColumnRenamed("lang", "rank").withColumnRenamed("n_chars", "size"))
    got = mixing.op6_mixing(spark, folder).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in got) == sorted((i if i is not None else -1, size(t)) for i, t, _ in rows)
    by_source = {}
    for _, t, s in rows:
        by_source[s] = by_source.get(s, 0) + size(t)
    want = slow_targets(by_source)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by_source[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert {s: abs(taken[s] - want[s]) <= 0.5 for s in want} == dict.fromkeys(want, True)
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
    again = mixing.op6_mixing(spark.newSession(), folder).repartition(7).collect()
    assert sorted(again, key=key) == sorted(got, key=key)
    assert mixing.op6_mixing(spark, folder_of(documents=make_docs([]))).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 10 or got != list(range(n))


def test_slots_cover_blocks_evenly_and_shards_follow_targets(spark, small_blocks):
    sizes = spark.createDataFrame([("a", 64_000), ("b", 640), ("c", 100_000), ("d", 0)], "source string, source_size long")
    sources = mixing.targets(sizes)
    target = {r.source: r.target for r in sources.collect()}
    found = mixing.slots(sources).collect()
    for s in "abc":
        own = [r for r in found if r.source == s]
        assert sorted(r.number for r in own) == list(range(len(own)))
        assert sum(r.words for r in own) == round(target[s])
        for e in {r.epoch for r in own}:
            blocks = [r.block for r in own if r.epoch == e]
            assert len(set(blocks)) == len(blocks)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r.source)
    total = sum(target.values())
    for own in list(shards.values())[:-1]:
        if len(own) > 400:
            assert abs(own.count("c") / len(own) - target["c"] / total) < 0.15
