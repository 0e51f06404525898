import hashlib
import random

import numpy as np

from plywise.llm import parsing
from plywise.llm.common import mixed

M = (1 << 64) - 1


def mix(x):
    return int(mixed(np.array([x & M], np.uint64))[0])


def slow_parse(symbols):
    """One level, symbol by symbol; returns (name, symbols in the phrase)."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    runs = [mix(s + n * 0xD6E8FEB86659FD93) if n > 1 else s for s, n in runs]
    labels = list(runs)
    for _ in range(4):
        new = []
        for i, v in enumerate(labels):
            k = 0 if i == 0 else ((v ^ labels[i - 1]) & -(v ^ labels[i - 1])).bit_length() - 1
            new.append(2 * k + (v >> k & 1))
        labels = new
    starts = [i for i in range(len(runs)) if i == 0 or labels[i] > labels[i - 1] and (i == len(runs) - 1 or labels[i] > labels[i + 1])]
    assert all(a != b for a, b in zip(labels, labels[1:])) and all(0 <= x < 6 for x in labels)
    base = 0x9E3779B97F4A7C15
    names = []
    for a, b in zip(starts, [*starts[1:], len(runs)]):
        names.append(mix(sum(mix(runs[i]) * pow(base, i - a, 1 << 64) for i in range(a, b)) + b - a))
    return names


def slow_fingerprint(text):
    levels = [list(text.encode())]
    for _ in range(parsing.LEVELS):
        levels.append(slow_parse(levels[-1]))
    names = [(k, x) for k in range(1, parsing.LEVELS + 1) for x in levels[k]]
    if not names:
        return bytes(parsing.BINS).hex()
    least = {}
    for k, x in names:
        v = mix(x + (k + 1) * 0x9E3779B97F4A7C15)
        b = v % 16 if k == 1 else 16 + v % 48 if k == 2 else 64 + v % 64
        least[b] = min(v, least.get(b, M))
    found = []
    for b in range(parsing.BINS):
        far = next(d for d in range(parsing.BINS) if (b + d) % parsing.BINS in least)
        found.append(mix(least[(b + far) % parsing.BINS] + far * 0xC2B2AE3D27D4EB4F) >> 56)
    return bytes(found).hex()


def near(a, b):
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b))) / parsing.BINS
    return max((same - 1 / 256) / (1 - 1 / 256), 0.0)


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        a, b, c = (prints.setdefault(x, slow_fingerprint(x)) for x in (t, e, other))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                                                 round(r.near_edited, 9), round(r.near_next, 9))) for r in got)


def corpus():
    rng = random.Random(11)
    words = ["the", "Straße", "ándre", "42", "日本", "re", "ing", "x", "q" * 30, "\n"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 12, 60, 250]))) for _ in range(60)]
    return [*texts, None, "", "a", "ab", "aaaa", "ab" * 300, "z" * 3000, "\U0001f600é" * 9, *texts[:12]]


def test_query_equals_brute_force(spark, make_docs, folder_of, monkeypatch):
    monkeypatch.setattr(parsing, "_STEP_BYTES", 2000)
    rng = random.Random(1)
    rows = list(zip(rng.sample(range(-50, 1000), len(corpus())), corpus()))
    docs = make_docs(rows, 6).withColumnRenamed("lang", "part").withColumnRenamed("source", "tie")
    check(rows, parsing.op7_parsing(spark, folder_of(documents=docs)).collect())


def test_few_rows_equal_ids_and_none(spark, make_docs, folder_of):
    for rows in ([(5, "alone, and followed by itself")], [(5, None)], [(1, "one text here"), (1, "one text here"), (None, "x y z"), (1, "one text here")]):
        check(rows, parsing.op7_parsing(spark, folder_of(documents=make_docs(rows, 2))).collect())
    assert parsing.op7_parsing(spark, folder_of(documents=make_docs([]))).count() == 0


def test_equal_substrings_share_interior_names_at_any_offset():
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefghij ", k=2000))
    texts = ["".join(rng.choices("klmnop", k=n)) + shared + "".join(rng.choices("klmnop", k=50)) for n in (0, 1, 7, 333)]
    for level in (1, 2, 3, 4):
        sets = []
        for t in texts:
            symbols, firsts = np.frombuffer(t.encode(), np.uint8).astype(np.uint64), np.array([0, len(t)])
            for _ in range(level):
                symbols, firsts = parsing.parse(symbols, firsts)
            sets.append(set(symbols.tolist()))
        common = set.intersection(*sets)
        assert len(common) > len(sets[0]) - 14 - 100 / 2**level


def test_edited_texts_are_nearer_than_others(spark, make_docs, folder_of):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(80, 400)))) for i in range(100)]
    got = parsing.op7_parsing(spark, folder_of(documents=make_docs(rows))).collect()
    assert min(r.near_edited for r in got) > max(r.near_next for r in got)
    assert 0.2 < sum(r.near_edited for r in got) / len(got) < 0.45


def test_likeness_has_no_step_at_a_length():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    found = []
    for n in range(10, 130):
        likes = []
        for _ in range(12):
            text = " ".join(rng.choices(words, k=n))
            half = text[: len(text) // 2]
            a, b = (bytes.fromhex(slow_fingerprint(t)) for t in (text, half + " ".join(rng.choices(words, k=n))[: len(half) // 2]))
            likes.append(sum(x == y for x, y in zip(a, b)) / len(a))
        found.append(sum(likes) / len(likes))
    smooth = [sum(found[i : i + 15]) / 15 for i in range(len(found) - 15)]
    assert max(abs(a - b) for a, b in zip(smooth, smooth[10:])) < 0.1
