import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plywise.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["a  b\n\n c\x00é  <|endoftext|> 日本 \U0001f600\t x", "  ", "", " \n a", "can't I'LL x's", "\x85\xa0 　z", "1234 567", "=" * 5000, None]


def check(rows, got, reference):
    tokens = [(i, reference(t)) for i, t in rows]
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        assert at == 2048 or at & (at - 1) == 0  # nothing is padded
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    want = Counter()
    ids_of = {}
    for i, ids in tokens:
        ids_of.setdefault(i, []).append(ids)
        want[i] += len(ids)
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == dict(want)
    for i, p in pieces.items():
        for r in p:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                       for ids in ids_of[i])


def test_every_id_lies_in_one_piece(spark, make_docs, folder_of, reference):
    rng = random.Random(3)
    words = ["the", "Straße", "ándre", "42", "tion's", "x\n", "日本", "!!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 20, 300, 3000])))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, "a copied text " * 30) for i in range(200)]
    docs = make_docs(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "ids")
    folder = folder_of(documents=docs)
    check(rows, packing.op8_packing(spark, folder).collect(), reference)


def test_equal_and_missing_ids_and_no_rows(spark, make_docs, folder_of, reference):
    rows = [(1, "one text"), (1, "one text"), (1, "another text of that id"), (None, "no id"), (None, None)]
    check(rows, packing.op8_packing(spark, folder_of(documents=make_docs(rows))).collect(), reference)
    assert packing.op8_packing(spark, folder_of(documents=make_docs([]))).count() == 0


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(side**d))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark, make_docs):
    rng = random.Random(5)
    topics = [[f"{chr(97 + t)}{chr(97 + k)}o" for k in range(20)] for t in range(8)]
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=200))) for i in range(400)]
    keys = {r.doc_id: r.key for r in packing.tokenized(make_docs(rows)).collect()}
    order = sorted(keys, key=keys.get)
    assert sum(a % 8 == b % 8 for a, b in zip(order, order[1:])) > 250
