from plywise.operators import evaluation
from plywise.plans import catalog


def test_runtime_votes(spark):
    choices = spark.createDataFrame(
        [(1, [("a",), ("b",), ("c",)]), (2, [("a",)]), (3, [("a",), ("b",)]), (4, [("x",), ("y",), ("z",)])], "choice_index int, candidates array<struct<uci: string>>")
    pairs = [(1, ["a", "b"], "b"), (1, ["a", "c"], "?"), (1, ["b", "c"], "b"), (3, ["a", "b"], None), (4, ["x", "y"], "y"), (4, ["x", "z"], "z"), (4, ["y", "z"], "y")]
    decisions = spark.createDataFrame(pairs, "choice_index int, pair_moves array<string>, parsed_move string")
    names = ("choice_index", "vote_winner", "vote_margin_to_first", "margin_fallback_applied", "selected_move", "decisions", "invalid_count")
    for margin, played in ((0, {1: "b", 2: "a", 3: "a", 4: "y"}), (2, {1: "a", 2: "a", 3: "a", 4: "y"}), (3, {1: "a", 2: "a", 3: "a", 4: "x"})):
        found = {r["choice_index"]: tuple(r[c] for c in names) for r in evaluation.runtime_votes(choices, decisions, margin).collect()}
        assert found == {
            1: (1, "b", 1, margin > 1, played[1], 3, 1), 2: (2, "a", 0, False, "a", 0, 0), 3: (3, "a", 0, False, "a", 1, 1), 4: (4, "y", 2, margin > 2, played[4], 3, 0)}


def test_records_of_requests_without_a_legal_candidate(spark):
    scored = spark.createDataFrame(
        [(1, "a", 2, 0, 400, "mistake", True, None), (1, "b", 1, 1, None, "good", False, 0.5), (3, "c", 1, 0, 900, "blunder", True, None)],
        "request_id long, uci string, multiplicity long, first_index int, centipawn_loss int, classification string, vetoed boolean, ranking_score double")
    requests = spark.createDataFrame([(1, 3), (2, 4), (3, 1)], "request_id long, n_candidates_generated int")
    found = {r["request_id"]: r for r in evaluation.rerank_records(requests, scored, 5, "engine", 300).collect()}
    assert [found[1][c] for c in ("n_legal", "n_distinct_legal", "n_vetoed", "veto_changed_move", "all_vetoed", "chosen_uci", "first_legal_uci")] == [3, 2, 1, True, False, "b", "a"]
    assert [tuple(c)[:2] for c in found[1]["candidates"]] == [("a", 2), ("b", 1)]
    assert found[3]["all_vetoed"] and found[3]["chosen_uci"] == "c" and not found[3]["veto_changed_move"]
    assert [found[2][c] for c in ("n_candidates_generated", "n_legal", "n_vetoed", "veto_changed_move", "all_vetoed", "chosen_uci", "candidates")] == [4, 0, 0, False, False, None, []]


def test_tallies_stand_in_the_order_of_moves(spark):
    votes = spark.createDataFrame([(1, "s16", 1), (1, "s1", 3), (1, "s1a", 0), (2, "b", 2), (2, "a", 0)], "choice_index int, uci string, votes long")
    found = {r["choice_index"]: r["tally"] for r in evaluation.vote_tallies(votes).collect()}
    assert found == {1: "s1=3,s16=1,s1a=0", 2: "a=0,b=2"}


def test_a_log_reads_written_samples_only(spark):
    """Scores are made once, not for the statistics and again for the first samples."""
    for name in ("reward_log_heads", "reward_log_append"):
        log = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert not any("lineitem" in f for f in log.inputFiles()), name
