"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and suffix together reach
the longer length less one. The places of the longer word are cut into segments; the place after the common prefix lies
in one of them, and what stands before and behind that segment is equal in both words. Words meet in the tile of this
prefix and suffix, once for every segment of their own length and of the next one, as the shorter word. In a tile all
pairs are compared at once: code points stand in matrices padded on the right (common prefixes) and on the left (common
suffixes), and blocks of row pairs are taken from them. A pair counts only in the tile whose segment holds the place
after its common prefix, so it counts once, however often it meets.

A tile of many words is cut anew, into segments of one place; such a tile holds at most one word for each letter and one
shorter word. Every other tile is bounded by ``CROWD``. No pair leaves its task: a word's partners are counted, and only
the most frequent one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import partitions, stored

#: The letters that make up runs; all are code points below 256, so a character is one byte in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of a segment, and segments at most: longer words have longer segments.
SEGMENT, MOST_SEGMENTS = 3, 24
#: Words of a tile that are compared with each other; larger tiles are cut anew.
CROWD = 2048
#: Code points of the blocks of pairs that are compared at once.
BLOCK = 4_000_000


def words(docs: DataFrame, least_chars: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """``word`` and ``n``, how often it occurs, for words of at least so many code points and occurrences.

    A word is a maximal run of letters with A-Z in lower case. Where ``modulus`` divides the CRC-32 of
    ``<doc_id>:<run>``, the run loses the code point at that number modulo its length. Null texts have no words, and a
    null doc_id is the empty string there. All runs of all texts count, repeated rows as often as they occur.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_chars},}})"), F.lit(1)))
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    own = own.withColumn("run", F.translate("run", UPPER, UPPER.lower()))
    own = own.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "utf-8")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    counted = own.select(F.when(F.col("h") % modulus == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))


def _segments(longer: Column) -> Column:
    """The segments (s, e) of a word of this length."""
    k = F.least(F.ceil(longer / SEGMENT), F.lit(MOST_SEGMENTS)).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(
        F.floor(longer * i / k).cast("int").alias("s"), F.floor(longer * (i + 1) / k).cast("int").alias("e")))


def _placed(df: DataFrame) -> DataFrame:
    """``key``, the hash of what stands outside of the segment; ``longer``, ``s`` and ``e`` complete the name of a tile."""
    outside = F.xxhash64(F.substring("word", F.lit(1), F.col("s")), F.right(F.col("word"), F.col("longer") - F.col("e")))
    return df.withColumn("key", outside)


def _tiles(vocabulary: DataFrame) -> DataFrame:
    length = F.char_length("word")
    both = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    tiles = _placed(both.select("*", F.explode(_segments(F.col("longer"))).alias("at")).select("word", "n", "longer", "at.*"))
    name = ["longer", "s", "e", "key"]
    crowded = stored(tiles.groupBy(name).agg(F.count("*").alias("rows")).where(F.col("rows") > CROWD).select(name))
    if crowded.isEmpty():
        return tiles
    fine = tiles.join(crowded, name, "left_semi").select("word", "n", "longer", F.explode(F.sequence("s", F.col("e") - 1)).alias("s"))
    return tiles.join(crowded, name, "left_anti").unionByName(_placed(fine.withColumn("e", F.col("s") + 1)))


def _row_pairs(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows (earlier, later) of the same tile, where tiles of these sizes follow each other; in blocks."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    later = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(later):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        a = np.repeat(np.arange(at, to), later[at:to])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - total[at], later[at:to])
        at = to


def _run_lengths(differs: np.ndarray) -> np.ndarray:
    """Places before the first that differs; every row has one."""
    return np.argmax(differs, axis=1)


def near_pairs(longer: int, spelled: np.ndarray, starts: np.ndarray, ends: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of the same tile whose words are one edit apart, in the tile that their pair belongs to.

    ``spelled`` has the words' bytes (Latin-1) with the length ``longer`` or one less, rows sorted by ``tile``.
    """
    left = spelled.view(np.uint8).reshape(len(spelled), longer)
    short = left[:, -1] == 0
    right = np.where(short[:, None], np.roll(left, 1, axis=1), left)[:, ::-1]
    sizes = np.diff(np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]]))
    found = [(np.zeros(0, np.int64),) * 2]
    for a, b in _row_pairs(sizes, max(1, BLOCK // longer)):
        keep = ~(short[a] & short[b])
        a, b = a[keep], b[keep]
        before = _run_lengths(left[a] != left[b])
        keep = (starts[a] <= before) & (before < ends[a])
        a, b, before = a[keep], b[keep], before[keep]
        keep = before + _run_lengths(right[a] != right[b]) >= longer - 1
        found.append((a[keep], b[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and length: how many near words it has in these tiles, and the one with the largest n (ties: the least)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in ("longer", "s", "e", "key")])
    longer = table.column("longer").to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(longer[1:] != longer[:-1]) + 1, [len(longer)]]).tolist()
    for low, high in zip(cuts, cuts[1:]):
        part = table.slice(low, high - low)
        n, s, e, key = (part.column(k).to_numpy() for k in ("n", "s", "e", "key"))
        spelled = np.array([w.encode("latin-1") for w in part.column("word").to_pylist()], f"S{longer[low]}")
        changed = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (key[1:] != key[:-1])
        a, b = near_pairs(int(longer[low]), spelled, s, e, np.concatenate([[0], np.cumsum(changed)]))
        if not len(a):
            continue
        own, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((spelled[other], -n[other], spelled[own]))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], spelled[own][1:] != spelled[own][:-1]]))
        counts = np.diff(np.append(first, len(own)))
        name = lambda rows: pa.array([w.decode("latin-1") for w in spelled[rows].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([name(own[first]), pa.array(counts.astype(np.int64)), pa.array(n[other[first]]), name(other[first])],
                                         names=["word", "n_near", "form_n", "form"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and its near word of the largest n (``form``, ``form_n``; ties: the least) of every word that has one.

    ``vocabulary`` has distinct words with their n.
    """
    spark = vocabulary.sparkSession
    size = vocabulary.agg(F.sum(F.ceil(F.char_length("word") / SEGMENT) * 2 * (F.char_length("word") + 32))).first()[0] or 0
    tiles = _tiles(vocabulary).repartition(partitions(spark, size), "longer", "s", "e", "key")
    found = tiles.mapInArrow(_compared, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word reached by following ``form``, of every word that has a form.

    Every round doubles the steps taken; forms grow at least twofold in n, so few rounds do. The driver sees a flag.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        then = now.select(F.col("word").alias("over"), F.col("root").alias("next"))
        step = stored(now.join(then, F.col("root") == F.col("over"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return now
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, factor: int = 2) -> DataFrame:
    """One row for each word of ``docs`` (doc_id, text): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    The form is the near word of the largest n (ties: the least by code points) if that is at least ``factor`` times the
    word's own n, else null; the root is reached by following forms, and is the word itself where it has none. An empty
    table, and texts that are null, empty or without letters, give no words; further columns are ignored.
    """
    vocabulary = stored(words(docs))
    near = stored(near_words(vocabulary))
    own = vocabulary.join(near, "word", "left")
    named = F.col("form_n") >= factor * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("form")).alias("form"),
                     F.when(named, F.col("form_n")).alias("form_n"))
    own = stored(own)
    found = own.join(roots(own.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(common.table(spark, folder, "documents", "doc_id", "text"))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i))"
#: Independent of the tiles: words meet on what is left after one place is deleted.
OP13_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS MATERIALIZED (SELECT doc_id, translate(r, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY ALL),
bytes AS MATERIALIZED (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
hashed AS MATERIALIZED (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i:
    (ord(substr(x, i, 1)) - CASE WHEN substr(x, i, 1) > '9' THEN 55 ELSE 48 END) * 16
    + ord(substr(x, i + 1, 1)) - CASE WHEN substr(x, i + 1, 1) > '9' THEN 55 ELSE 48 END),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295))::BIGINT AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN vocabulary b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(any_value(n_near), 0) AS n_near, min(other) FILTER (other_n = best AND best >= 2 * n) AS form
  FROM vocabulary v LEFT JOIN near USING (word) LEFT JOIN pairs USING (word) GROUP BY v.word, v.n),
walk AS (SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NOT NULL),
ended AS (SELECT w.word, w.at FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, o.n AS form_n
FROM formed f LEFT JOIN ended e USING (word) LEFT JOIN vocabulary o ON f.form = o.word
"""


common.shipped(__name__)
