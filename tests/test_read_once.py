"""Operators that need their rows several times compute them once."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plywise.operators import candidates, choices, datasets, evaluation, reuse
from plywise.operators.ordering import first_per_key, last_per_key
from plywise.operators.selection import ranked


@pytest.fixture
def counted(spark):
    """A frame whose rows are counted whenever they are computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def count(df, column):
        def touch(value):
            seen.add(1)
            return value

        return df.withColumn(column, F.udf(touch, LongType()).asNondeterministic()(F.col(column)))

    return count, seen


def test_ranked_computes_its_rows_once(spark, counted):
    count, seen = counted
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    places = ranked(count(df, "k"), [F.col("k")], rows_each=300).collect()
    assert all(r["rank"] == r["k"] + 1 for r in places) and len(places) == 1000 and seen.value == 1000


def test_picked_rows_are_exchanged_with_their_order_once(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", None, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert sorted(tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()) == [("a", 1, "x"), ("b", None, "z")]
    assert sorted(tuple(r) for r in last_per_key(df, ["k"], ["o"]).collect()) == [("a", 2, "y"), ("b", 5, "w")]
    assert "min_by" not in first_per_key(df, ["k"], ["o"])._jdf.queryExecution().optimizedPlan().toString()
    with_map = df.withColumn("m", F.create_map("v", "o"))
    assert {r.k: r.m for r in first_per_key(with_map, ["k"], ["o"]).collect()} == {"a": {"x": 1}, "b": {"z": None}}


def test_chosen_positions_compute_their_specs_once(spark, counted):
    count, seen = counted
    specs = spark.range(600).select(F.concat(F.lit("f"), (F.col("id") % 200).cast("string")).alias("fen_before"), F.col("id").alias("seq"))
    specs = count(specs, "seq").withColumn("spec_order", F.struct("seq"))
    assert sorted(r.seq for r in candidates.choose_positions(specs, 3).collect()) == [0, 1, 2, 200, 201, 202, 400, 401, 402]
    assert seen.value == 600


def test_game_specs_equal_the_three_sources(spark):
    make = spark.createDataFrame
    moves = make([(10 * g + p, g, p, f"f{g}-{p}", f"m{p}") for g in (1, 2) for p in (1, 2, 3)] + [(99, 7, 1, "f7", "m1")],
                 "move_id long, game_id long, ply long, fen_before string, accepted_uci string")
    games = make([(1, 4), (2, 5)], "game_id long, run_id long")
    evaluations = make([(11, "blunder", "b1"), (11, "best", "b1"), (12, "good", None), (21, None, "b2"), (21, "good", "b3")],
                       "move_id long, classification string, best_move_uci string")
    talk = ('{"regime":"llm_deliberative","mode":"candidate_pairwise","candidate_legal_moves":["x","y"],'
            '"candidate_raw_response":"{\\"candidates\\":[{\\"move\\":\\"x\\",\\"idea\\":\\"plan\\"}]}"}')
    attempts = make([(1, 1, 11, 1, 1, talk), (2, 1, 11, 1, 2, talk), (3, 2, 22, 2, 1, '{"scorer":"s"}'), (4, 2, None, 2, 1, talk), (5, 2, 21, 1, 1, talk)],
                    "attempt_id long, game_id long, move_id long, ply long, attempt_number int, reranker_metadata string")
    for runs in ((), (5,)):
        apart = candidates.union_specs(candidates.accepted_specs(moves, games, evaluations, runs), candidates.metadata_specs(attempts, games, moves, runs),
                                       candidates.best_specs(moves, games, evaluations, runs))
        together = candidates.game_specs(moves, games, evaluations, attempts, runs)
        assert together.columns == apart.columns
        assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))


def test_capped_samples_compute_their_games_once(spark, counted):
    count, seen = counted
    games = spark.range(1, 301).select(F.col("id").alias("source_game_index"), F.lit(9).cast("long").alias("plies"))
    assert datasets.capped_samples(count(games, "plies"), 4, 41).count() == 11 and seen.value == 300


def test_tactical_gate_computes_its_triggers_once(spark, counted):
    count, seen = counted
    triggers = spark.range(500).select(
        F.lit(0).alias("file_ord"), F.col("id").alias("line_ord"), *[F.lit("x").alias(c) for c in (
            "prompt", "fen", "completion", "move", "gate_source", "parsed_move", "classification")], F.lit(300).alias("centipawn_loss"))
    first = datasets.tactical_gate(count(triggers, "line_ord"), 7).collect()
    assert sorted(r.line_ord for r in first) == list(range(7)) and seen.value == 500


def test_winners_of_choices_with_foreign_votes_and_margins(spark):
    lists = [(0, ["a", "b"]), (1, ["a", "b"]), (2, ["a"]), (3, ["a", "b"])]
    rows = spark.createDataFrame([(i, [(u,) for u in us]) for i, us in lists], "choice_index long, candidates array<struct<uci string>>")
    votes = spark.createDataFrame([(0, "b", 2), (0, "a", 1), (1, "zz", 9), (3, "a", 0), (3, "b", 0)], "choice_index long, uci string, votes long")
    found = {r.choice_index: (r.vote_winner, r.vote_margin_to_first, r.margin_fallback_applied, r.selected_move)
             for r in evaluation.vote_winners(rows, votes, 2).collect()}
    assert found == {0: ("b", 1, True, "a"), 1: ("a", 0, False, "a"), 3: ("a", 0, False, "a")}
    winners = evaluation.vote_winners(rows, votes)
    assert winners._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_lists_exchange_no_hashes_and_first_pairs_equal_all_pairs(spark):
    rows = spark.range(900).select(
        F.concat(F.lit("f"), (F.col("id") % 60).cast("string")).alias("fen_before"), F.concat(F.lit("m"), (F.col("id") % 77).cast("string")).alias("candidate_uci"),
        F.lit("white").alias("side_to_move"), F.lit("S").alias("candidate_san"), F.lit("s").alias("source"),
        F.when(F.col("id") % 7 < 2, "good").otherwise("blunder").alias("risk"), (F.col("id") % 100).cast("int").alias("score"),
        ((F.col("id") * 37) % 700).cast("int").alias("centipawn_loss"), F.lit(None).cast("int").alias("candidate_rank_in_generator"), F.col("id").alias("seq"))
    for cap in (None, 2):
        plan = choices.choice_rows(rows, max_candidates=cap)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(c#" in plan and "collect_list(struct" not in plan
    key = lambda r: (r.position_seq, r.pair_index, r.target_move, r.pair_cpl_gap)
    every = sorted(map(key, choices.pair_rows(rows, 4).collect()))
    for n in (1, 7, len(every), len(every) + 5):
        assert sorted(map(key, choices.pair_rows(rows, 4, max_examples=n).collect())) == every[:n]
    assert len(every) > 40


def test_counters_exchange_only_numbers_of_illegal_moves(spark):
    specs = spark.createDataFrame([("f", "a", "s", 1), ("f", "a", "t", 2), ("f", "b", "s", 3), ("f", "x", "s", 4), ("g", "x", "s", 5), ("g", "y", "s", 6)],
                                  "fen_before string, candidate_uci string, source string, o long").withColumn("spec_order", F.struct("o"))
    legal = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "y")], "fen string, uci string")
    judged = spark.createDataFrame([("f", "a", 10, "best"), ("g", "y", 400, "blunder")], "fen_before string, candidate_uci string, centipawn_loss int, classification string")
    counts = candidates.build_counts(specs, legal, judged, 1)
    assert "hashpartitioning(fen_before#" in (plan := counts._jdf.queryExecution().executedPlan().toString()) and "_bucket#" in plan
    found = {(r.metric, r.key): r.n for r in counts.collect() if r.metric != "by_split"}
    assert found == {("candidates_seen", ""): 6, ("dropped_illegal_candidate", ""): 2, ("dropped_duplicate_candidate", ""): 1, ("dropped_candidate_limit", ""): 1,
                     ("positions_seen", ""): 2, ("rows_written", ""): 2, ("by_source", "s"): 2, ("by_risk", "good"): 1, ("by_risk", "blunder"): 1}


def test_cache_stats_compute_requests_once(spark, counted):
    count, seen = counted
    requests = count(spark.range(300).select("id", (F.col("id") % 40).cast("string").alias("fen"), F.lit("u").alias("uci")), "id").where("id >= 0")
    cache = spark.range(10).select(reuse.evaluation_key(F.col("id").cast("string"), F.lit("u")).alias("key"))
    assert reuse.cache_stats(requests, cache).collect() == [(300, 30, 270)] and seen.value == 300
    assert reuse.cache_stats(requests.limit(0), cache).collect() == [(0, 0, 0)]
    hits, misses = reuse.cache_lookup(requests, cache)
    assert misses.columns == ["key", "fen", "uci"] and (hits.count(), misses.count()) == (80, 30)
