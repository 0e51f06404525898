import random
import re
from collections import Counter

import pytest

from plywise.llm import quality


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def junk(rng):
    return " ".join(rng.choice(["$$$", "###", "|", "buy", "win%%%"]) + rng.choice(["", "&&&", "now"]) for _ in range(rng.randint(12, 80)))


def prose(rng):
    return "".join(rng.choice(["the ", "house ", "é lan ", "walks\n", "over ", "green ", "fields. ", "straße "]) + f"w{rng.randrange(300)} " for _ in range(rng.randint(12, 90)))


@pytest.fixture
def corpus(spark, make_docs, folder_of):
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 4 == 0 else prose(rng)) for i in range(400)]
    odd = [None, "", " \n\r\x0b ", "a", "a\nb\na\n\na\n", "a b c d e a b c d e", "x " * 5000, "l1\r\nl1\r\n", "\n", "é é#", "a\x1cb c",
           prose(rng) * 300, "same line here\n" * 4]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(3, rows[3][1]), (None, "no id")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(400) if i % 3] + [(1000, 0, 0), (7, None, 0), (9999, 1, 1), (None, 0, 0)]
    docs = make_docs(rows).withColumnRenamed("lang", "quality").withColumnRenamed("source", "n_words")
    return rows, folder_of(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_base_equals_brute_force_and_model_holds_out(spark, corpus):
    rows, folder = corpus
    got = quality.op2_quality(spark, folder).collect()
    by_row = sorted(((r.doc_id if r.doc_id is not None else -1), tuple(r[k] for k in quality._BASE)) for r in got)
    assert by_row == sorted((i if i is not None else -1, slow_counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0 and not r.base_failed]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in unseen) > 0.97 * len(unseen)
    again = {(r.doc_id, r.n_words): r.quality for r in quality.op2_quality(spark, folder).collect()}
    assert {(r.doc_id, r.n_words): pytest.approx(r.quality, abs=1e-6) for r in got} == again


def test_random_texts_equal_brute_force():
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "é", "#", "|", "a b a b a ", "\x0b", "word\n"], k=rng.randint(0, 60))) for _ in range(500)]
    found = quality.counts(quality.Texts(pa.array(texts)))
    assert [tuple(int(found[k][i]) for k in quality._BASE) for i in range(500)] == [slow_counts(t) for t in texts]


def test_without_labels_or_documents(spark, make_docs, folder_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.op2_quality(spark, folder_of(documents=make_docs(["one two three four five six seven eight nine ten", None]), labels=none)).collect()
    assert sorted((r.n_words, r.kept, r.quality) for r in got) == [(0, False, 0.5), (10, True, 0.5)]
    assert quality.op2_quality(spark, folder_of(documents=make_docs([]), labels=none)).count() == 0
