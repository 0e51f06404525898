import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from plywise import session
from plywise.llm import suffixes


def prose(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, k=n))


def test_stages_and_run(spark, make_docs, folder_of):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randint(60, 200), vocabulary)
        bad = i % 5 == 0
        if bad:
            text += " you vile nasty rotten thing vile nasty"
        rows.append((i, text, f"src{i % 3}"))
        if i % 2 or i % 4 == 0:
            labels.append((i, 1, int(bad)))
    passage = prose(rng, 60, vocabulary)
    rows += [(1000 + i, rows[7][1], "src0") for i in range(5)]  # exact copies
    near = rows[8][1].split()
    near[3] = "changed"
    rows.append((2000, " ".join(near), "src1"))
    rows += [(3000 + i, f"{prose(rng, 150, vocabulary)} {passage} {prose(rng, 150, vocabulary)}", "src2") for i in range(4)]
    odd = [(4000, None, None), (4001, "", "src1"), (None, prose(rng, 50, vocabulary), "src0"), (None, prose(rng, 50, vocabulary), "src0"),
           (4002, "clean", "src1"), (4003, "x " * 5000, "src1"), (5, rows[5][1], "src2"), (11, rows[11][1], "src2"), (11, rows[11][1], "src2")]
    rows += odd
    docs = make_docs(rows)
    folder = folder_of(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "repeated_passages", "mixing", "packing"]
    out = {}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        if name != "packing":
            assert now.schema == docs.schema
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        out[name] = now.collect()
    toxic = {i for i in range(300) if i % 5 == 0}
    want = Counter((i, t) for i, t, _ in rows if i not in toxic)
    assert Counter((r.doc_id, r.text) for r in out["toxicity"]) == want
    kept = Counter(r.doc_id for r in out["near_copies"])
    assert kept.pop(None) == 2 and set(kept.values()) == {1}
    gone = {1000, 1001, 1002, 1003, 1004, 2000, 4001}
    assert set(kept) == {i for i, _, _ in rows if i is not None} - toxic - gone
    # The third stage against the contract, string by string.
    ordered = sorted(((r.doc_id, r.text or "") for r in out["near_copies"]), key=lambda r: (r[0] is None, r[0] or 0))
    nulls = [r for r in ordered if r[0] is None]
    ordered = [r for r in ordered if r[0] is not None]
    seen, expected = set(), {}
    for i, text in ordered:
        data, cover = text.encode(), bytearray(len(text.encode()))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        left = bytes(b for b, c in zip(data, cover) if not c).decode("utf-8", "ignore")
        if left.split():
            expected[i] = left
    got = {r.doc_id: r.text for r in out["repeated_passages"] if r.doc_id is not None}
    assert got == expected and len(nulls) == 2
    assert all(passage not in got[i] for i in (3001, 3002, 3003)) and passage in got[3000]
    assert all(r.n_chars == len(r.text) for r in out["repeated_passages"])
    texts = {r.text for r in out["repeated_passages"]}
    times = Counter(r.text for r in out["mixing"])
    assert set(times) <= texts and max(times.values()) <= 3
    words = Counter()
    for r in out["mixing"]:
        words[r.source] += len(r.text.split())
    total = sum(len(r.text.split()) for r in out["repeated_passages"])
    assert abs(sum(words.values()) - total) < 0.1 * total
    assert set(r.doc_id for r in out["packing"]) == set(r.doc_id for r in out["mixing"])
    again = corpus_pipeline.run(spark, folder).collect()
    starts = [Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) for rows in (again, out["packing"])]
    assert starts[0] == starts[1]


def test_empty_documents(spark, make_docs, folder_of):
    folder = folder_of(documents=make_docs([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_characters_cut_in_part_go_as_a_whole():
    assert suffixes._form("aé".encode()[:-1], "text") == b"a" and suffixes._form(b"a\xff", "bytes") == b"a\xff"


def test_without_usable_labels_all_documents_stay(spark, make_docs, folder_of):
    texts = ["a clean text", "another one", None, "", "words"]
    docs = make_docs(texts).withColumnRenamed("lang", "toxicity").withColumnRenamed("source", "_stats")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(0, 1, None), (99, 1, 1)], [(i, 1, 0) for i in range(5)], [(None, 1, 1)]):
        folder = folder_of(labels=spark.createDataFrame(labels, schema))
        found = corpus_pipeline.toxic(spark, docs, folder)
        assert found.dtypes == docs.dtypes and sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3, 4], labels


def test_near_copies_keep_columns_of_any_name(spark, make_docs):
    rng = random.Random(3)
    base = prose(rng, 100, [f"w{i}" for i in range(500)])
    docs = make_docs([(3, base), (2, base + " end"), (7, "alone"), (None, base.upper()), (8, None), (9, " ")])
    docs = docs.selectExpr("*", "map('a', doc_id) AS _row", "1 AS component", "2 AS _id", "3 AS node", "4 AS rows", "5 AS none")
    found = corpus_pipeline.near_copies(spark, docs, "")
    assert found.dtypes == docs.dtypes
    assert sorted((r.doc_id, r._row["a"]) for r in found.collect()) == [(2, 2), (7, 7), (8, 8)]


def tables(spark):
    return set(Path(session.shared_dir(spark).removeprefix("file:")).iterdir())


def test_stages_leave_no_copy_of_the_texts(spark, make_docs, folder_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80, [f"w{i}" for i in range(900)]), "src0") for i in range(60)]
    rows += [(100 + i, f"{t} end", s) for i, t, s in rows[:20]]
    folder = folder_of(documents=make_docs(rows), labels=spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    was = tables(spark)
    found = corpus_pipeline.near_copies(spark, docs, folder)
    left = tables(spark) - was
    assert [spark.read.parquet(str(p)).columns for p in left] == [["doc_id", "n_shingles", "component", "component_id"]]
    assert sorted(r.doc_id for r in found.collect()) == list(range(60))
    was = tables(spark)
    prepared = corpus_pipeline.prepared(docs, spark, folder, 4)
    assert len(tables(spark) - was) == 1 and prepared.dtypes == docs.dtypes and prepared.count() > 0


def test_tables_of_a_job_go_after_an_error(spark):
    @session.released
    def broken(df):
        session.stored(session.released(lambda x: session.stored(x))(df))
        raise ValueError("broken")

    was = tables(spark)
    with pytest.raises(ValueError, match="broken"):
        broken(spark.range(3))
    assert tables(spark) == was


def test_near_copies_by_ids_and_by_rows_agree(spark, make_docs):
    rng = random.Random(6)
    base = [prose(rng, 90, [f"w{i}" for i in range(700)]) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(200 - i, f"{t} end") for i, t in enumerate(base[:12])] + [(300, None), (301, " "), (302, "alone")]
    by_ids = corpus_pipeline.near_copies(spark, make_docs(rows), "")
    by_rows = corpus_pipeline.near_copies(spark, make_docs([*rows, (302, "alone")]), "")  # an id twice
    assert sorted(map(tuple, by_ids.collect())) == sorted(map(tuple, by_rows.collect()))
    assert sorted(r.doc_id for r in by_ids.collect()) == [*range(30), 300, 302]
