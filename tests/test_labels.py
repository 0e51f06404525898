from pyspark.sql import functions as F

from plywise.functions import labels, rewards, stats, text
from plywise.operators.ordering import evenly_spaced


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_risk_score_and_reason(spark):
    df = spark.createDataFrame(
        [(1, "best", 0), (2, "inaccuracy", 75), (3, "mistake", 250), (4, "blunder", 350), (5, "mate_missed", None), (6, "mate_position", None)],
        "i int, k string, c int")
    out = df.select("i", labels.risk(F.col("k"), F.col("c")), labels.score(F.col("k"), F.col("c")), labels.reason_type(F.col("k"), F.col("c")))
    assert rows(out.orderBy("i")) == [
        (1, "good", 100, "none"), (2, "playable", 81, "unknown"), (3, "mistake", 38, "unknown"), (4, "blunder", 12, "material_or_mate"),
        (5, "blunder", 0, "material_or_mate"), (6, "playable", 50, "unknown")]


def test_score_rounds_half_even(spark):
    df = spark.createDataFrame([(2,), (6,), (10,), (14,)], "c int").select(labels.score(F.lit("good"), F.col("c")))
    assert [r[0] for r in df.collect()] == [100, 98, 98, 96]


def test_mate_rules(spark):
    df = spark.createDataFrame([(1, 3, 2), (2, 3, None), (3, None, -2), (4, -2, -4), (5, -4, -2)], "i int, b int, a int")
    out = df.select("i", labels.move_class(F.lit(None).cast("int"), F.col("b"), F.col("a"))).orderBy("i")
    assert [r[1] for r in out.collect()] == ["mate_position", "mate_missed", "mate_missed", "mate_position", "mate_missed"]


def test_wilson_and_rates(spark):
    df = spark.createDataFrame([(0, 0), (3, 10)], "k int, n int").orderBy("n")
    low, high = stats.wilson_low(F.col("k"), F.col("n")), stats.wilson_high(F.col("k"), F.col("n"))
    empty, some = rows(df.select(F.round(low, 4), F.round(high, 4), stats.rate(F.col("k"), F.col("n"))))
    assert empty == (0.0, 0.0, 0.0) and some == (0.1078, 0.6032, 0.3)


def test_reward_values(spark):
    df = spark.createDataFrame(
        [(1, False, False, None, "malformed", None, None), (2, True, False, None, "illegal", "e2e5", None), (3, True, True, 30, "good", "e2e4", "g1f3"),
         (4, True, True, None, "mate_missed", "e2e4", "g1f3"), (5, True, True, None, "mate_position", "g1f3", "g1f3"),
         (6, True, True, 20, "best", "a", "b"), (7, True, True, 300, "mistake", "a", "b"), (8, True, True, 450, "blunder", "a", "b")],
        "i int, p boolean, l boolean, c int, k string, m string, b string")
    make = lambda mode: F.round(rewards.move_reward(*[F.col(x) for x in "plckmb"], rule=rewards.RewardRule(mode)), 6)
    out = rows(df.orderBy("i").select(make("linear"), make("tactical")))
    assert [r[0] for r in out] == [-1.0, -0.5, 0.9, 0.0, 1.0, round(1 - 20 / 300, 6), 0.0, 0.0]
    assert [r[1] for r in out] == [-1.0, -1.0, round(1 - 10 / 60 * 0.4, 6), -1.0, 1.0, 1.0, -0.8, -1.0]


def test_evenly_spaced(spark):
    df = spark.createDataFrame([(1, 20, 4), (2, 3, 9), (3, 7, 1), (4, 0, 3), (5, 5, 0)], "i int, n int, k int")
    out = [r[0] for r in df.orderBy("i").select(evenly_spaced(F.col("n"), F.col("k"))).collect()]
    assert out == [[0, 6, 13, 19], [0, 1, 2], [3], [], []]


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, "reranked:openai:x"), (2, "deliberative:random"), (3, "reranked:"), (4, "qwen:7b")], "i int, n string").orderBy("i")
    base = text.base_identity(F.col("n"))
    out = rows(df.select(base, text.opponent_type(F.col("n")), text.provider(base), text.provider_model(base)))
    assert out == [("openai:x", "model", "openai", "x"), ("random", "random", "local", "random"), ("reranked:", "model", "local", "reranked:"),
                   ("qwen:7b", "model", "local", "qwen:7b")]
    ints = spark.createDataFrame([("5",), (" -7 ",), ("true",), ("1.5",), (None,)], "v string").select(text.lenient_int(F.col("v")))
    assert [r[0] for r in ints.collect()] == [5, -7, None, None, None]
    long = spark.createDataFrame([("a  b\n c",), ("x" * 300,)], "v string").select(text.compact(F.col("v")))
    assert [r[0] for r in long.collect()] == ["a b c", "x" * 219 + "..."]
    tokens = spark.createDataFrame([("",), ("abc",), ("abcde",), (None,)], "v string").select(text.estimate_tokens(F.col("v")))
    assert [r[0] for r in tokens.collect()] == [0, 1, 2, 0]
