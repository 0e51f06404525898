import hashlib
import random

from pyspark.sql import functions as F

from plywise.operators import choices, evaluation

START, SECOND = "start w", "second b"
SCHEMA = ("seq long, fen_before string, side_to_move string, candidate_uci string, candidate_san string, source string, risk string, "
          "score int, centipawn_loss int, candidate_rank_in_generator int")


def frame(spark, rows):
    return spark.createDataFrame([(i, fen, "white", u, u.upper(), "arena_move", risk, score, cpl, None) for i, (fen, u, risk, score, cpl) in enumerate(rows)], SCHEMA)


CHOICES = [(START, "e2e4", "playable", 80, 80), (START, "g1f3", "good", 100, 0), (START, "f2f3", "blunder", 0, 500),
           (SECOND, "e7e5", "good", 100, 0), (SECOND, "c7c5", "playable", 80, 80)]


def test_choice_rows(spark):
    df = frame(spark, CHOICES)
    out = choices.choice_rows(df, max_candidates=3).collect()
    assert len(out) == 1 and out[0].target_move == "g1f3" and out[0].candidate_count == 3
    order = sorted(["e2e4", "g1f3", "f2f3"], key=lambda u: hashlib.sha256(f"{START}|{u}".encode()).hexdigest())
    assert [c.uci for c in out[0].candidates] == order and out[0].target_prompt_index == order.index("g1f3") + 1
    drops = {r.metric: r.n for r in choices.choice_drops(df, 2, 3, True).collect()}
    assert drops["positions_written"] == 1 and drops["dropped_no_mixed_risk"] == 1


def test_pair_rows(spark):
    df = frame(spark, CHOICES[:3] + [(START, "b1c3", "mistake", 45, 220)] + CHOICES[3:])
    out = choices.pair_rows(df, pairs_per_position=2, min_gap=100).collect()
    assert sorted(r.target_risk for r in out) == ["good", "playable"]
    drops = {r.metric: r.n for r in choices.pair_drops(df, 2, 100).collect()}
    assert drops["dropped_no_unsafe_candidate"] == 1 and drops["examples_written"] == 2


def _all_pairs(rows, k, gap):
    best = {}
    for seq, (fen, u, risk, score, cpl) in enumerate(rows):
        key = (score, -999999 if cpl is None else -cpl)
        if (fen, u) not in best or key > best[fen, u][0]:
            best[fen, u] = (key, risk, cpl)
    out = {}
    for fen in {f for f, _ in best}:
        items = [(u, *v) for (f, u), v in best.items() if f == fen]
        pairs = []
        for s in (i for i in items if i[2] in ("good", "playable")):
            for w in (i for i in items if i[2] in ("mistake", "blunder")):
                d = None if s[3] is None or w[3] is None else abs(s[3] - w[3])
                if d is not None and d < gap:
                    continue
                b, x = (s, w) if s[1] >= w[1] else (w, s)
                pairs.append((-1 if d is None else d, hashlib.sha256(f"{fen}|{b[0]}|{x[0]}".encode()).hexdigest(), b[0], x[0]))
        for i, p in enumerate(sorted(pairs, reverse=True)[:k]):
            out[fen, i] = (p[2], p[3])
    return out


def test_pairs_equal_brute_force_with_a_hot_position(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        fen = "hot" if i % 3 == 0 else f"f{rng.randrange(40)}"
        cpl = rng.choice([None, *range(0, 600, 7)])
        risk = rng.choice(["good", "playable", "mistake", "blunder"])
        rows.append((fen, f"m{rng.randrange(150 if fen == 'hot' else 12)}", risk, rng.randrange(5) * 20, cpl))
    for k, gap in ((4, 100), (3, 250), (2, 0)):
        out = choices.candidate_pairs(frame(spark, rows), k, gap).collect()
        assert {(r.fen, r.pair_index): (r.better.uci, r.worse.uci) for r in out} == _all_pairs(rows, k, gap)


def test_comparisons_votes_and_report(spark):
    df = frame(spark, CHOICES[:3])
    choice = choices.choice_rows(df, max_candidates=8).withColumn("choice_index", F.lit(0).cast("long"))
    pairs = choices.comparison_rows(choice)
    assert pairs.count() == 3
    preds = pairs.withColumns({"parsed_move": F.when(F.array_contains("pair_moves", "g1f3"), "g1f3").otherwise("zz"), "parse_ok": F.lit(True), "legal_ok": F.lit(True)})
    votes = {r.uci: r.votes for r in evaluation.pair_votes(preds).collect()}
    assert votes == {"g1f3": 2, "e2e4": 0, "f2f3": 0}
    winners = evaluation.vote_winners(choice, evaluation.pair_votes(preds))
    report = evaluation.choice_report(evaluation.judged(choice.join(winners, "choice_index"), "selected_move"), "selected_move", False).first()
    assert report.top1_match == 1 and report.selected_mean_centipawn_loss == 0.0


def test_hard_cases(spark):
    choice = choices.choice_rows(frame(spark, CHOICES[:3]), max_candidates=8).withColumn("example_index", F.lit(0).cast("long"))
    preds = spark.createDataFrame([(0, "f2f3", True, True)], "example_index long, parsed_move string, parse_ok boolean, legal_ok boolean")
    judged = evaluation.judged(evaluation.zip_predictions(choice, preds), "parsed_move")
    case = evaluation.hard_cases(judged, 5).first()
    assert case.categories == ["selected_blunder", "missed_good", "high_regret"] and case.severity == 1500 and case.regret == 500
    cases = judged.select("example_index", "categories", "fen", "side_to_move", F.col("parsed_move").alias("predicted_move"), "target", "candidates",
                          F.col("regret").alias("cpl_regret_vs_oracle"), F.col("delta_first").alias("cpl_delta_vs_first"))
    variants = choices.hard_case_variants(cases, variants=2, seed=1).orderBy("hard_case_variant_index").collect()
    assert [v.hard_case_variant_index for v in variants] == [0, 1] and {v.split for v in variants} == {"hardcase_eval"}


def test_zip_fails_on_different_lengths(spark):
    import pytest

    rows = spark.createDataFrame([(0, "a"), (1, "b")], "example_index long, x string")
    preds = spark.createDataFrame([(0, "p")], "example_index long, y string")
    with pytest.raises(Exception, match="differ in length"):
        evaluation.zip_predictions(rows, preds).agg(F.count("*")).collect()


def test_veto_selection(spark):
    rows = [(1, "e2e4", 2, 0, 450, True, None), (1, "d2d4", 1, 1, 40, False, None), (2, "e2e4", 1, 0, 900, True, None), (2, "d2d4", 1, 1, 350, True, None),
            (3, "e2e4", 1, 0, None, False, 2.1), (3, "d2d4", 1, 1, None, False, 2.8)]
    df = spark.createDataFrame(rows, "request_id long, uci string, multiplicity long, first_index int, centipawn_loss int, vetoed boolean, ranking_score double")
    out = evaluation.veto_selection(df).orderBy("request_id").collect()
    assert [r.chosen_uci for r in out] == ["d2d4"] * 3 and [r.all_vetoed for r in out] == [False, True, False]


def test_probability_ranking(spark):
    rows = [(0, "a", "m1", 0, "blunder", 0, 300, 0.4), (1, "a", "m2", 1, "good", 100, 20, 2.5), (2, "b", "m3", 0, "good", 100, 40, 1.0), (3, "b", "m4", 1, "playable", 60, 170, 2.0)]
    df = spark.createDataFrame(rows, "seq int, fen_before string, candidate_uci string, candidate_rank_in_generator int, risk string, score int, centipawn_loss int, expected_risk_score double")
    r = evaluation.probability_ranking(df.withColumn("target", F.struct("risk", "score"))).first()
    assert (r.selected_mean_centipawn_loss, r.oracle_mean_centipawn_loss, r.first_generator_mean_centipawn_loss) == (95.0, 30.0, 170.0)
    assert (r.first_generator_blunders, r.oracle_match_by_move, r.improved_vs_first_count, r.worsened_vs_first_count, r.tied_first_count) == (1, 1, 1, 1, 0)
