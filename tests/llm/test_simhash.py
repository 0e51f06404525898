import random

import numpy as np
import xxhash

from plywise.llm import simhash


def slow_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query_equals_brute_force(spark, make_docs, folder_of):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "straße", "ÀB"]
    texts = [None, "", " \n\t", "One", "one", "ONE two", "a b c\x1cd e"]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice(" \n\x0b").join(copy))
    texts += texts[20:40] * 3 + ["hot copy of a text"] * 50
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 7 + 3, texts[k]) for i, k in enumerate(order)]
    docs = make_docs(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "root")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, folder_of(documents=docs)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", root[i]) for (i, _), f in zip(rows, fps)}


def test_links_reach_every_pair_within_three_bits(spark):
    rng = random.Random(5)
    fps = {0, 7, (1 << 64) - 1}
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(3):
            base = rng.choice([0, 16, 32, 48])
            for b in rng.sample(range(64), rng.randint(1, 4)) if rng.random() < 0.6 else rng.sample(range(base, base + 16), 3):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components(signed, fps)
    assert {i: got.get(i, i) for i in signed} == want


def test_one_hot_neighbourhood_and_empty_table(spark, make_docs):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ (rng.getrandbits(16) << 16) ^ (1 << rng.randrange(64)) for _ in range(3000)}), np.uint64)
    signed = [int(x) for x in fps.view(np.int64)]
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps))).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    root = fps.view(np.int64).copy()
    while True:
        new = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert [got.get(i, i) for i in signed] == root.tolist()
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_similar_texts_at_four_fifths(spark, make_docs):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, group = [], {}

    def add(words, g):
        group[len(rows)] = g
        rows.append((len(rows), " ".join(words)))

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    for g in range(120):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        add(words, g)
        if g % 2:
            for _ in range(3):
                copy = list(words)
                while len(shingles(copy) & shingles(words)) / len(shingles(copy) | shingles(words)) > 0.87:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                add(copy, g)
    for _ in range(80):  # a group beyond the size that is compared pair by pair
        copy = list(words)
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        add(copy, g)
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One\ntwo"), (None, "one two")]
    got = {r.doc_id: r.component_id for r in simhash.similar(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    want = exact_components(rows[: len(group)])
    assert {i: got[i] for i in group} == want
    assert sum(want[i] != i for i in group) > 240
    assert got[9000] == 9000 and got[9001] == 9001 and got[9002] == got[9003] == got[None] == 9002
    assert simhash.similar(make_docs([])).count() == 0


def shingle_sets(rows):
    found = []
    for _, t in rows:
        words = t.split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return found


def exact_components(rows, similarity=0.8):
    sets, root = shingle_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_similar_equals_brute_force_from_half_to_nine_tenths(spark, make_docs):
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []
    for g in range(150):  # pairs, so that no third text links them
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        target = 0.5 + 0.4 * g / 150
        copy = list(words)
        while True:
            a, b = shingle_sets([(0, " ".join(words)), (1, " ".join(copy))])
            if len(a & b) <= target * len(a | b):
                break
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    want = exact_components(rows)
    assert 20 < sum(want[i] != i for i in want) < 60
    assert {r.doc_id: r.component_id for r in simhash.similar(make_docs(rows)).collect()} == want


def test_texts_of_one_template_stay_apart(spark, make_docs):
    rng = random.Random(18)
    vocabulary = [f"v{i}" for i in range(5000)]
    template = rng.choices(vocabulary, k=200)
    rows = [(i, " ".join(template + rng.choices(vocabulary, k=rng.choice([30, 45, 70, 100])))) for i in range(1500)]
    rows += [(5000 + i, t + " end") for i, t in rows[:20]]
    got = {r.doc_id: r.component_id for r in simhash.similar(make_docs(rows)).collect()}
    assert all(got[5000 + i] == i for i in range(20)) and all(got[i] == i for i in range(1500))
