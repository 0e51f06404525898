import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plywise.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(docs):
    rows = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


def some_rows(seed, docs=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    weights = [2 ** rng.randint(0, 6) for _ in bases]
    rows = []
    for i in range(docs):
        words = []
        for w in rng.choices(bases, weights, k=80):
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + "b" + w[at + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i * 7, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("crowd", [2048, 3])
def test_as_by_brute_force(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "BLOCK", 500)
    rows = some_rows(1)
    want = slow(rows)
    assert len(want) > 200 and any(r[2] not in (r[0], r[1]) for r in want)
    assert got(make_docs(rows)) == want


def test_edge_cases(make_docs):
    long = "z" * 30_000
    text = f"{long} {long}y {long} {long}y {long} {long}y y{long} naïve Naïve naïve NAÏVE x×y÷z x×y÷z x×y÷z"
    rows = [(1, text), (None, text), (2, None), (3, ""), (4, "1 2 . ab"), (5, text), (5, text)]
    docs = make_docs(rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit(3))
    assert got(docs) == slow(rows)


def test_ties_go_to_the_least(make_docs):
    rows = [(10, "abcdeY abcdeX abcde " * 3 + "abcdeX abcdeY " * 4)]
    assert got(make_docs(rows)) == slow(rows)


def test_no_words(make_docs):
    assert got(make_docs([])) == set()
    assert got(make_docs([None, "", "a b c"])) == set()


def test_many_forms_in_a_row(make_docs):
    words = ["aaaaa" + "bcdefghi"[:k] for k in range(9)]
    rows = [(i, " ".join([w] * (3 * 2**k))) for i, (k, w) in enumerate(zip(range(9), words))]
    found = got(make_docs(rows))
    assert found == slow(rows)
    assert max(Counter(r[2] for r in found).values()) >= 8


def test_query_agrees_with_its_sql(spark, make_docs, folder_of):
    duckdb = pytest.importorskip("duckdb")
    folder = folder_of(documents=make_docs(some_rows(2, docs=20)))
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = duckdb.sql(spelling.OP13_SQL).project("word, form, root, n, n_near, form_n").fetchall()
    assert {tuple(r) for r in spelling.op13_spelling(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()} == set(want)
