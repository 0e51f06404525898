import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plywise.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def slow(rows):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(docs):
    return sorted(map(tuple, jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def prose(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(share * len(words)))):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new"], [f"e{rng.randrange(10**6)}"], [words[at], "more"]])
    return words


def some_texts(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    template = prose(rng, 120)
    texts += [template + prose(rng, rng.choice([5, 12, 20, 28, 40])) for _ in range(50)]
    for base in texts[:25]:
        texts += [edited(rng, base, rng.choice([0.005, 0.02, 0.04])) for _ in range(6)]
    star = prose(rng, 150)
    texts += [star] + [edited(rng, star, 0.025) for _ in range(60)]
    texts += [star, [w.upper() for w in star], star[::-1], ["a", "b"], ["a", "b"], ["b", "a"], [], ["a"] * 9, ["a"] * 5]
    rng.shuffle(texts)
    return [" ".join(t) if rng.random() < 0.7 else " \t" + "\n".join(t) + "\x0b" for t in texts]


@pytest.mark.parametrize("rounds, few, heavy", [(5, 2, 1 << 20), (0, 0, 0), (3, 0, 200)])
def test_as_by_brute_force(make_docs, monkeypatch, rounds, few, heavy):
    for name, value in (("_ROUNDS", rounds), ("_FEW", few), ("HEAVY", heavy), ("_BLOCK", 7), ("_COMMON", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = list(enumerate(some_texts(rounds)))
    want = slow(rows)
    assert len({r[2] for r in want}) < len(want) - 150
    assert got(make_docs(rows)) == want


def test_edge_cases(make_docs):
    rng = random.Random(5)
    long = prose(rng, 60_000, 10**6)
    rows = [(1, None), (2, ""), (3, " \t\n"), (3, ""), (4, "One two"), (4, "one TWO"), (5, "é É e"), (6, "É é e"), (None, "one two"), (None, "alone here"),
            (7, " ".join(long)), (8, " ".join(edited(rng, long, 0.001))), (9, " ".join(long) + " end"), (10, "x " * 50_000), (10, "x " * 50_000), (11, "y" * 300_000)]
    docs = make_docs(rows)
    for name in ("name", "node", "size", "token", "rows", "group"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert got(docs) == slow(rows)


def test_empty_table(make_docs):
    assert got(make_docs([])) == []
    assert got(make_docs([None, ""])) == [(0, 0, 0), (1, 0, 1)]


def test_exactly_four_fifths(make_docs):
    words = [f"w{i}" for i in range(13)]  # nine shingles; a word more at both ends of eight
    rows = [(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(["x", *words[1:]])), (4, " ".join([*words, "y"]))]
    assert got(make_docs(rows)) == slow(rows)


def test_a_crowd_costs_a_few_comparisons_a_member(make_docs, monkeypatch):
    rng = random.Random(7)
    base = prose(rng, 150)
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 0.025)) for _ in range(300)]
    compared = []
    plain = jaccard.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    found = got(make_docs(texts))
    assert found == slow(list(enumerate(texts))) and len({r[2] for r in found}) <= 10
    assert sum(compared) < 5 * len(texts), compared


def test_texts_that_share_less_make_no_lists(make_docs, monkeypatch):
    rng = random.Random(11)
    passages = [prose(rng, 40, 10**6) for _ in range(12)]
    texts = [" ".join([*passages[i % 12], *prose(rng, 60, 10**6), *passages[(i + 5) % 12]]) for i in range(60)]
    rows = []
    plain = jaccard._pairs_left

    def counted(lists):
        rows.append(plain(lists))
        return rows[-1]

    monkeypatch.setattr(jaccard, "_pairs_left", counted)
    found = got(make_docs(texts))
    assert found == slow(list(enumerate(texts))) and len({r[2] for r in found}) == len(texts)
    assert rows == [(0, 0)]


@pytest.mark.parametrize("piece, asked", [(1, 1 << 20), (3000, 300), (3000, 0), (1 << 30, 700)])
def test_counts_come_back_to_pieces_of_any_size(make_docs, monkeypatch, piece, asked):
    monkeypatch.setattr(jaccard, "_PIECE", piece)
    monkeypatch.setattr(jaccard, "HEAVY", asked)
    texts = some_texts(3)[:150]
    docs = make_docs(texts, parts=2)
    monkeypatch.setattr(jaccard, "partitions", lambda *_: 3)
    assert got(docs) == slow(list(enumerate(texts)))


def test_levels_of_counts():
    n = np.concatenate([np.arange(1, 3000), 10 ** np.arange(4, 15)])
    level = jaccard._level(n)
    assert np.array_equal(level[:16], n[:16]) and (np.diff(level.astype(int)) >= 0).all()
    assert np.array_equal(jaccard._level(jaccard._count(level)), level)
    assert (jaccard._count(level) <= n).all() or (np.abs(jaccard._count(level) / n - 1) < 0.2).all()


def test_only_compared_texts_are_exchanged(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 50, f"text {i % 50}") for i in range(100)], "node long, text string")
    nodes = spark.createDataFrame([(3,), (7,), (99,)], "node long")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        few = jaccard._compared(texts, nodes)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(jaccard, "_SENT", 2)
        many = jaccard._compared(texts, nodes)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(3, "text 3"), (7, "text 7")]
    finally:
        spark.conf.set(threshold, was)


def test_numbers_of_names(spark):
    names = [bytes(range(16)), b"\xff" * 16, bytes(16), b"\x00" * 7 + b"\x80" + b"\x01" * 8]
    frame = spark.createDataFrame([(n,) for n in names], "name binary")
    clashes = {names[2]: -5}
    found = {bytes(r["name"]): r["n"] for r in frame.select("name", jaccard._numbered(clashes).alias("n")).collect()}
    assert found == {n: jaccard._node(n, clashes) for n in names}
    twins = spark.createDataFrame([(b"a" * 8 + b"b" * 8,), (b"a" * 8 + b"c" * 8,), (b"z" * 16,)], "name binary")
    assert set(jaccard._clashes(twins)) == {b"a" * 8 + b"b" * 8, b"a" * 8 + b"c" * 8}


def test_word_hashes_in_parts(monkeypatch):
    text = " ".join(prose(random.Random(1), 500)).encode()
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "_CUT", 17)
    assert np.array_equal(jaccard.word_hashes(text), whole)


def test_query_agrees_with_its_sql(spark, make_docs, folder_of):
    duckdb = pytest.importorskip("duckdb")
    folder = folder_of(documents=make_docs(some_texts(9)))
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = duckdb.sql(jaccard.OP11_SQL).project("doc_id, n_shingles, component_id").fetchall()
    found = jaccard.op11_jaccard(spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(want)
