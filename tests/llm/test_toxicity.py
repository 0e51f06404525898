import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plywise.llm import toxicity


def slow_segments(scores):
    """All maximal scoring segments by their definition: split at the best segment, and go on left and right of it."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-12):
                    found = (i, j, total)
        if found is None:
            return []
        return best(a, found[0]) + [found] + best(found[1] + 1, b)

    return best(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-1, 1]) * rng.random() for _ in range(rng.randint(1, 25))]
        plus = [i for i, s in enumerate(scores) if s > 0]
        gaps = [sum(scores[a + 1 : b]) for a, b in zip(plus, plus[1:])]
        got = [(plus[a], plus[b], s) for a, b, s in toxicity.segments([scores[i] for i in plus], gaps)]
        want = slow_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


@pytest.fixture
def corpus(spark, make_docs, folder_of):
    rng = random.Random(4)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.choice('xyzuv')}{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "nasty", "ROTTEN"]))
        rows.append((i, " ".join(words)))
        if i % 3 or i % 2:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " .. !\n"), (1003, "vile nasty rotten " * 3000), (1004, "x1 " * 20000), (None, "vile nasty vile")]
    labels += [(1, 0, 0), (2, 1, None), (None, 1, 1), (9999, 1, 1), (1000, 1, 0)]
    docs = make_docs(rows).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "best")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, folder_of(documents=docs, labels=table)


def test_scores_on_held_out_documents(spark, corpus):
    rows, folder = corpus
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(got[i].predicted == (i % 5 == 0) for i in range(600))
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, None)] == [0, 0, 0, 1, 0, 1]
    assert got[1003].n_passages >= 1 and got[1000].n_passages == 0
    again = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)


def test_without_labels_or_documents(spark, make_docs, folder_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.op5_toxicity(spark, folder_of(documents=make_docs(["a b c", None]), labels=none)).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    assert toxicity.op5_toxicity(spark, folder_of(documents=make_docs([]), labels=none)).count() == 0


def test_scores_do_not_depend_on_the_rows_before():
    texts = ["vile", "vile", None, "vile", "vile words vile", "vile words vile", "", "vile vile"]
    table = np.full(toxicity.BUCKETS, -0.1)
    table[toxicity._tokens(pa.array(["vile"]))[4]] = 2.0
    alone = [toxicity._stats(pa.array([t], pa.string()), table)[0].as_py() for t in texts]
    assert [r["best"] for r in alone[:2]] == [2.0, 2.0] and alone[-1]["best"] == 2.0
    for size in range(1, len(texts) + 1):
        got = [r for i in range(0, len(texts), size) for r in toxicity._stats(pa.array(texts[i : i + size], pa.string()), table).to_pylist()]
        for g, w in zip(got, alone):
            assert g["starts"] == w["starts"] and g["ends"] == w["ends"]
            assert g["scores"] == pytest.approx(w["scores"]) and g["best"] == pytest.approx(w["best"])


def test_tokens_are_whole_words_and_pairs_of_characters():
    def tokens(text):
        _, starts, ends, _, buckets = toxicity._tokens(pa.array([text]))
        return [text.encode()[a:b].decode() for a, b in zip(starts, ends)], buckets.tolist()

    for a, b in (("überfahrt", "überfall"), ("международный", "междометие"), ("international", "internal"), ("éèàùx", "éèày")):
        assert tokens(a)[0] == [a] and tokens(a)[1] != tokens(b)[1] and tokens(a.upper() if a.isascii() else a)[1] == tokens(a)[1]
    assert tokens("你好吗 ok在x")[0] == ["你好", "好吗", "吗", "ok", "在", "x"]
    assert tokens("今天很好坏人")[1][4] == tokens("他说坏人")[1][2]
    assert tokens("")[0] == [] and tokens("𠀀𠀁")[0] == ["𠀀𠀁", "𠀁"]
    firsts = toxicity._tokens(pa.array(["a 你好", None, "你", "b"]))[3]
    assert firsts.tolist() == [0, 3, 3, 4, 5]


def test_words_that_share_six_bytes_are_told_apart(spark, make_docs, folder_of):
    rng = random.Random(8)
    for bad, good in (("überfallen", "überfahrt"), ("междометие", "международный"), ("坏人", "好人")):
        rows = []
        for i in range(400):
            words = [f"w{rng.randrange(60)}" for _ in range(30)]
            for _ in range(3):
                word = bad if i % 4 == 0 else good
                words.insert(rng.randrange(30), f"今天我们{word}很多" if len(word) == 2 else word)
            rows.append((i, " ".join(words)))
        labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
        got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder_of(documents=make_docs(rows), labels=labels)).collect()}
        assert all(got[i].predicted == int(i % 4 == 0) for i in got if got[i].held_out)
