import json

from plywise.functions import text


def test_escapes_are_those_of_json(spark):
    texts = ["", "plain", "é", "a\u00ffb", "日本語 mixed 😀😀 end", "\u0080\u07ff\u0800\uffff\U00010000\U0010ffff", "line\nbreak \u2028", None, "x" * 50_000 + "ß" * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["e"] for r in frame.select("i", text.ascii_escaped(frame["t"]).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == (None if t is None else "".join(c if c < "\x80" else json.dumps(c)[1:-1] for c in t))


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([("é",)], "t string")
    plan = frame.select(text.ascii_escaped(frame["t"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
