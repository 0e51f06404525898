import math

from pyspark.sql import functions as F

from plywise.functions.probability import softmax


def test_weights_are_those_of_the_c_library(spark):
    """All differences of -k/3, -k/4, -k/5 and -k/6 up to 3; the JVM's exponential misses the last place of some."""
    found = spark.createDataFrame([(-(a / b),) for b in (3, 4, 5, 6) for a in range(3 * b)] + [(None,)], "x double").select(
        "x", softmax({"top": F.lit(0.0), "other": F.col("x")})["other"].alias("p")).collect()
    want = lambda x: math.exp(x) / (0.0 + 1.0 + math.exp(x))
    assert all(r["p"] == (None if r["x"] is None else want(r["x"])) for r in found)
