import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from plywise.functions import responses


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_response string")
    return [r.asDict() for r in responses.validated_moves(df).orderBy("i").collect()]


def test_accepts_and_rejects(spark):
    out = check(spark, [
        '{"move":"e2e4"}', '```json\n{"move":"e2e4"}\n```', 'I play {"move":" e2e4 ", "rationale":" r "} now', "no json here", 'x {"move": e2e4}',
        "[1, 2]", '{"move": 5}', '{"move":"  "}', '"a {b}"', '[{"move":"e2e4"}]', '{"a":"}","move":"d2d4","strategy_update":{"objective":"o"}} tail',
        '{"move":"a","move":"b"}', '{"move":"e2e4"} {"move":"d2d4"}', 'broken " { "move',
    ])
    assert [r["parse_ok"] for r in out] == [True, True, True, False, False, False, False, False, False, False, True, True, True, False]
    assert [r["move"] for r in out if r["parse_ok"]] == ["e2e4", "e2e4", "e2e4", "d2d4", "b", "e2e4"]
    assert out[2]["rationale"] == "r" and out[10]["strategy_update"] == '{"objective":"o"}'
    assert [r["reason"] for r in out if not r["parse_ok"]] == [
        responses.NO_JSON, responses.NOT_JSON, responses.NOT_OBJECT, responses.NO_MOVE, responses.NO_MOVE, responses.NOT_OBJECT,
        responses.NOT_OBJECT, responses.NO_JSON]
    assert all(r["error_type"] == "malformed_json" for r in out if not r["parse_ok"])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.recursive(st.none() | st.text(max_size=8) | st.integers(), lambda c: st.dictionaries(st.text(max_size=3), c, max_size=2), max_leaves=4), max_size=3),
       st.text(alphabet="abc ]}", max_size=6), st.text(alphabet='abc{"}', max_size=6))
def test_balanced_object_finds_the_first_object(value, before, after):
    text = json.dumps(value)
    assert responses.balanced_object(before + text + after) == text


def test_critic_answers(spark):
    texts = ['so {"risk":"good","blunder":false,"score":140,"reason_type":"none"} ok', '{"risk":"odd","blunder":false,"score":1,"reason_type":"n"}',
             '{"risk":"good","blunder":0,"score":1,"reason_type":"n"}', '{"risk":"good","blunder":true,"score":true,"reason_type":"n"}', "}{", "",
             '{"risk":"good","blunder":true,"score":1.0,"reason_type":"n"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_response string")
    out = [r.predicted for r in responses.validated_critics(df).orderBy("i").collect()]
    assert tuple(out[0]) == ("good", False, 100, "none") and tuple(out[3]) == ("good", True, 1, "n")
    assert [out[i] for i in (1, 2, 4, 5, 6)] == [None] * 5


def test_candidate_list_and_pair_decision(spark):
    df = spark.createDataFrame([('{"candidates":[{"move":" E2E4 ","idea":"x"},7,{"move":3},{"move":"d2d4","idea":4}]}',)], "raw_response string")
    items = responses.listed_candidates(df).first()["items"]
    assert [tuple(i) for i in items] == [(0, "e2e4", "x"), (3, "d2d4", None)]
    pairs = spark.createDataFrame([(1, "a", "b", '{"move":"B"}'), (2, "a", "b", '{"move":"c"}'), (3, "a", "b", "?")], "i int, l string, r string, raw_response string")
    out = responses.pair_decisions(pairs, "l", "r").orderBy("i").select("selected_uci", "candidate_ok", "fallback_reason").collect()
    assert [tuple(r) for r in out] == [("b", True, None), ("a", False, "parsed_move_not_pair_candidate"), ("a", False, "malformed_json")]


def test_object_with_a_number_that_is_none(spark):
    df = spark.createDataFrame([('{"move":"e2e4","x":NaN}',), ('so {"move":"e2e4","x":[-Infinity]} it is',)], "raw_response string")
    assert [(r.parse_ok, r.move) for r in responses.validated_moves(df).collect()] == [(True, "e2e4")] * 2


def test_lists_are_scanned_once(spark):
    """Whatever reads the list's rows, and before they are made; an object in other text needs no scan if its braces are the outermost."""
    texts = ['so {"candidates":[{"move":" E2E4 ","idea":"x"},{"move":7},{"move":"a1"}]} ok', '["a {"]', '{"candidates":[{"move":"b2"}]} or {"candidates":[]}',
             'a } b', '"{}"', "x {} {", '{"candidates":[{"move":"c3","n":NaN}]}', None, "{'a': {\"candidates\":[]}}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_response string")
    rows = responses.listed_candidates(df).select("i", F.inline("items"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("_buried_object(") == 1
    assert sorted((r["i"], r["pos"], r["move"], r["idea"]) for r in rows.collect()) == [
        (0, 0, "e2e4", "x"), (0, 2, "a1", None), (2, 0, "b2", None), (6, 0, "c3", None)]
