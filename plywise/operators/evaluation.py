"""Scoring of predictions: metrics, rankings, votes, hard cases, rewards, veto selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels
from plywise.functions.rewards import RewardRule, move_reward
from plywise.functions.stats import count_if, mean2, mean_or_null, rate, rate4
from plywise.operators.ordering import counters, frequent, split_lookup, top_per_group
from plywise.operators.selection import first_rows
from plywise.session import stored


# Legality and plain metrics -------------------------------------------------------


def with_legality(rows: DataFrame, legal_moves: DataFrame, fen: str = "fen", move: str = "parsed_move",
                  normalize: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Add ``legal_ok``: the move is in the legal-move relation of its position.

    Captured play lower-cases and trims the move first; offline scoring takes it as written. A position that holds
    most rows is split; ``counts`` (``frequent`` of position and move) saves counting, where it is known.
    """
    text = "_move" if normalize else move
    known = legal_moves.select(F.col("fen").alias(fen), F.col("uci").alias(text)).distinct().withColumn("_legal", F.lit(True))
    keyed = rows.withColumn("_move", F.lower(F.trim(F.col(move)))) if normalize else rows
    joined = split_lookup(keyed, known, [fen, text], counts)
    return joined.withColumn("legal_ok", F.coalesce("_legal", F.lit(False))).drop("_legal", *(["_move"] if normalize else [])).select(
        *[c for c in rows.columns if c != "legal_ok"], "legal_ok")


def prediction_metrics(predictions: DataFrame) -> DataFrame:
    """Examples, parse / legal / exact-match counts and rates, service errors."""
    flag = lambda c: count_if(F.col(c))
    counts = predictions.agg(
        F.count(F.lit(1)).alias("examples"), flag("parse_ok").alias("json_parse_ok"),
        flag("legal_ok").alias("legal_move_ok"), flag("top1_match").alias("top1_match"),
        flag("service_error").alias("service_errors"),
    )
    n = F.col("examples")
    return counts.select(
        "*", rate(F.col("json_parse_ok"), n).alias("json_parse_rate"),
        rate(F.col("legal_move_ok"), n).alias("legal_move_rate"), rate(F.col("top1_match"), n).alias("top1_match_rate"),
    )


def loss_metrics(predictions: DataFrame) -> DataFrame:
    """Prediction metrics with loss classes, mean reward and mean loss."""
    flag = lambda cond: count_if(cond)
    kind = F.col("classification")
    counts = predictions.agg(
        F.count(F.lit(1)).alias("examples"),
        flag(F.col("parse_ok")).alias("json_parse_ok"), flag(F.col("legal_ok")).alias("legal_move_ok"),
        flag(F.col("top1_match")).alias("top1_match"),
        flag(~F.col("parse_ok")).alias("malformed"), flag(F.col("parse_ok") & ~F.col("legal_ok")).alias("illegal"),
        flag(kind == "blunder").alias("blunders"), flag(kind == "mistake").alias("mistakes"),
        flag(kind == "inaccuracy").alias("inaccuracies"),
        F.sum("reward").alias("_reward"), F.sum(F.col("centipawn_loss").cast("long")).alias("_cpl"),
        F.count("centipawn_loss").alias("cpl_scored_legal_moves"),
    )
    n = F.col("examples")
    named = {"json_parse_rate": "json_parse_ok", "legal_move_rate": "legal_move_ok", "top1_match_rate": "top1_match",
             "blunder_rate": "blunders", "mistake_rate": "mistakes", "inaccuracy_rate": "inaccuracies"}
    return counts.select(
        "*", *[rate(F.col(c), n).alias(name) for name, c in named.items()],
        F.coalesce(mean_or_null(F.col("_reward"), n), F.lit(0.0)).alias("mean_reward"),
        mean_or_null(F.col("_cpl"), F.col("cpl_scored_legal_moves")).alias("mean_generated_cpl"),
    ).drop("_reward", "_cpl")


def compare_critic(rows: DataFrame) -> DataFrame:
    """Match flags of ``predicted`` against ``target`` (structs risk, blunder, score, reason_type)."""
    p, t = F.col("predicted"), F.col("target")
    parsed = p.isNotNull()
    return rows.select(
        "*", parsed.alias("parse_ok"),
        F.coalesce(p["risk"] == t["risk"], F.lit(False)).alias("risk_match"),
        F.coalesce(p["blunder"] == t["blunder"], F.lit(False)).alias("blunder_match"),
        F.coalesce((p["risk"] == t["risk"]) & (p["blunder"] == t["blunder"]) & (p["score"] == t["score"])
                   & (p["reason_type"] == t["reason_type"]), F.lit(False)).alias("exact_target_match"),
        F.abs(p["score"] - t["score"]).alias("score_abs_error"),
    )


def critic_metrics(compared: DataFrame) -> DataFrame:
    counts = compared.agg(
        F.count(F.lit(1)).alias("examples"), count_if(F.col("parse_ok")).alias("json_parse_ok"),
        *[count_if(F.col(c)).alias(c) for c in ("risk_match", "blunder_match", "exact_target_match")],
        F.sum("score_abs_error").alias("_error"),
    )
    n = F.col("examples")
    return counts.select(
        "*", rate(F.col("json_parse_ok"), n).alias("json_parse_rate"),
        *[rate(F.col(c), n).alias(f"{c}_rate") for c in ("risk_match", "blunder_match", "exact_target_match")],
        mean_or_null(F.col("_error"), F.col("json_parse_ok")).alias("mean_score_abs_error"),
    ).drop("_error")


def risk_label_metrics(predictions: DataFrame) -> DataFrame:
    """``predicted_risk`` against the target's risk and blunder flag."""
    risk_match = F.col("predicted_risk") == F.col("target.risk")
    blunder_match = (F.col("predicted_risk") == "blunder") == F.col("target.blunder")
    counts = predictions.agg(
        F.count(F.lit(1)).alias("examples"), count_if(risk_match).alias("risk_match"),
        count_if(blunder_match).alias("blunder_match"),
    )
    n = F.col("examples")
    return counts.select("*", *[rate(F.col(c), n).alias(f"{c}_rate") for c in ("risk_match", "blunder_match")])


# Rankings -------------------------------------------------------------------------


def critic_ranking(compared: DataFrame, order: str = "seq") -> DataFrame:
    """Does picking by the critic's score reach the best candidate? Positions without any
    readable prediction are left out; selected blunders count the critic's own label."""
    p, t, seq = F.col("predicted"), F.col("target"), -F.col(order)
    row = F.struct("candidate_uci", "centipawn_loss", p["risk"].alias("said"), t["risk"].alias("truth"))
    by_critic = F.when(p.isNotNull(), F.struct(p["score"].alias("a"), labels.risk_rank(p["risk"]).alias("b"), seq.alias("c")))
    by_truth = F.struct(t["score"].alias("a"), labels.risk_rank(t["risk"]).alias("b"), seq.alias("c"))
    picks = compared.groupBy("fen_before").agg(
        F.max_by(F.when(p.isNotNull(), row), by_critic).alias("selected"), F.max_by(row, by_truth).alias("oracle")
    ).where(F.col("selected").isNotNull())
    return picks.agg(
        F.count(F.lit(1)).alias("positions"),
        mean2(F.col("selected.centipawn_loss")).alias("selected_mean_centipawn_loss"),
        mean2(F.col("oracle.centipawn_loss")).alias("oracle_mean_centipawn_loss"),
        count_if(F.col("selected.said") == "blunder").alias("selected_blunders"),
        count_if(F.col("oracle.truth") == "blunder").alias("oracle_blunders"),
        count_if(F.col("selected.candidate_uci") == F.col("oracle.candidate_uci")).alias("oracle_match_by_move"),
    )


def probability_ranking(predictions: DataFrame, order: str = "seq") -> DataFrame:
    """Selection by expected score against the best and the generator's first candidate."""
    t, seq = F.col("target"), -F.col(order)
    rank = F.coalesce("candidate_rank_in_generator", F.lit(labels.NO_RANK))
    row = F.struct("candidate_uci", "centipawn_loss", t["risk"].alias("truth"))
    by_truth = F.struct(t["score"].alias("a"), labels.risk_rank(t["risk"]).alias("b"),
                        labels.cpl_key(F.col("centipawn_loss")).alias("c"), seq.alias("d"))
    picks = predictions.groupBy("fen_before").agg(
        F.max_by(row, F.struct(F.col("expected_risk_score").alias("a"), (-rank).alias("b"), seq.alias("c"))).alias("selected"),
        F.max_by(row, by_truth).alias("oracle"),
        F.min_by(row, F.struct(rank.alias("a"), F.col(order).alias("b"))).alias("first"),
    )
    s, f = F.col("selected.centipawn_loss"), F.col("first.centipawn_loss")
    mean = lambda r: mean2(F.col(f"{r}.centipawn_loss"))
    blunders = lambda r: count_if(F.col(f"{r}.truth") == "blunder")
    return picks.agg(
        F.count(F.lit(1)).alias("positions"),
        mean("selected").alias("selected_mean_centipawn_loss"), mean("oracle").alias("oracle_mean_centipawn_loss"),
        mean("first").alias("first_generator_mean_centipawn_loss"),
        blunders("selected").alias("selected_blunders"), blunders("oracle").alias("oracle_blunders"),
        blunders("first").alias("first_generator_blunders"),
        count_if(F.col("selected.candidate_uci") == F.col("oracle.candidate_uci")).alias("oracle_match_by_move"),
        count_if(s < f).alias("improved_vs_first_count"), count_if(s > f).alias("worsened_vs_first_count"),
        count_if(s == f).alias("tied_first_count"),
    )


# Choice reports -------------------------------------------------------------------


def zip_predictions(rows: DataFrame, predictions: DataFrame, index: str = "example_index") -> DataFrame:
    """Pair rows and predictions by position; a surplus on either side fails the job."""
    both = rows.withColumn("_row", F.lit(1)).join(predictions.withColumn("_pred", F.lit(1)), index, "full_outer")
    missing = F.col("_row").isNull() | F.col("_pred").isNull()
    error = F.raise_error(F.lit("dataset and predictions differ in length")).cast("boolean")
    return both.where(F.when(missing, error).otherwise(F.lit(True))).drop("_row", "_pred")


def lookup(candidates: Column, uci: Column) -> Column:
    """Candidate of a list by its move; the last one wins, as in a keyed lookup."""
    return F.try_element_at(F.filter(candidates, lambda c: c["uci"] == uci), F.lit(-1))


def prompt_index(candidates: Column, uci: Column) -> Column:
    return F.array_position(F.transform(candidates, lambda c: c["uci"]), uci).cast("int")


def judged(rows: DataFrame, chosen: str, regret_threshold: int = 200) -> DataFrame:
    """Add target, first and selected candidate of each row, regret and hard-case marks."""
    c, move = F.col("candidates"), F.col(chosen)
    named = rows.withColumns({
        "target": lookup(c, F.col("move")), "first": c[0], "selected": lookup(c, move),
        "selected_index": F.when(lookup(c, move).isNotNull(), prompt_index(c, move)),
    })
    s, t, f = F.col("selected"), F.col("target"), F.col("first")
    return named.withColumns({
        "regret": s["centipawn_loss"] - t["centipawn_loss"],
        "delta_first": s["centipawn_loss"] - f["centipawn_loss"],
        "categories": labels.hard_case_categories(
            s["risk"], t["risk"], s["centipawn_loss"], t["centipawn_loss"], regret_threshold),
        "severity": labels.hard_case_severity(s["risk"], s["centipawn_loss"], t["centipawn_loss"]),
    })


def choice_report(judged_rows: DataFrame, chosen: str, with_flags: bool = True) -> DataFrame:
    """One row of rates, mean losses and comparisons with the first candidate."""
    s = F.col("selected")
    aggregates = [F.count(F.lit(1)).alias("examples")]
    if with_flags:
        aggregates += [count_if(F.col(c)).alias(c) for c in ("parse_ok", "legal_ok")]
    aggregates += [
        count_if(s.isNotNull()).alias("candidate_ok"), count_if(F.col(chosen) == F.col("move")).alias("top1_match"),
        mean2(s["centipawn_loss"]).alias("selected_mean_centipawn_loss"),
        mean2(F.col("target.centipawn_loss")).alias("target_oracle_mean_centipawn_loss"),
        mean2(F.col("first.centipawn_loss")).alias("first_prompt_candidate_mean_centipawn_loss"),
        count_if(labels.is_unsafe(s["risk"])).alias("selected_high_risk_count"),
        mean2(F.col("regret")).alias("mean_cpl_regret_vs_oracle"),
        count_if(F.col("delta_first") < 0).alias("improved_vs_first_count"),
        count_if(F.col("delta_first") > 0).alias("worsened_vs_first_count"),
        count_if(F.col("delta_first") == 0).alias("tied_first_count"),
    ]
    n = F.col("examples")
    rates = {"candidate_ok_rate": "candidate_ok", "top1_match_rate": "top1_match"}
    if with_flags:
        rates |= {"parse_rate": "parse_ok", "legal_rate": "legal_ok"}
    return judged_rows.agg(*aggregates).select("*", *[rate4(F.col(c), n).alias(name) for name, c in rates.items()])


def choice_report_counts(judged_rows: DataFrame) -> DataFrame:
    """Histograms behind the report: (metric, key, n), in one pass."""
    s, t = F.col("selected.risk"), F.col("target.risk")
    return counters(judged_rows, {
        "selected_risk": s, "target_risk": t, "first_prompt_risk": F.col("first.risk"),
        "selected_prompt_index": F.col("selected_index"), "target_prompt_index": F.col("target_prompt_index"),
        "risk_transition": F.concat(t, F.lit("->"), s),
    }, {"hard_case": F.col("categories")})


def hard_cases(judged_rows: DataFrame, limit: int, index: str = "example_index") -> DataFrame:
    """The most severe cases, earlier rows first among equals. The order and the rows are two reads, so cases are written once."""
    cases = stored(judged_rows.where(F.size("categories") > 0), "cases")
    return first_rows(cases, [-F.col("severity"), index], limit)


# Votes ----------------------------------------------------------------------------


def pair_votes(pairs: DataFrame) -> DataFrame:
    """Votes per choice and move. A valid answer adds one vote; an invalid one adds none but
    keeps both moves (and their choice) in the result."""
    vote = lambda m: F.struct(m.alias("uci"), F.coalesce(F.col("parsed_move") == m, F.lit(False)).cast("long").alias("vote"))
    exploded = pairs.select(
        F.col("pair_source_choice_index").alias("choice_index"), F.inline(F.transform("pair_moves", vote))
    )
    return exploded.groupBy("choice_index", "uci").agg(F.sum("vote").alias("votes"))


def vote_tallies(votes: DataFrame, index: str = "choice_index") -> DataFrame:
    """The votes of every choice as one text ``move=votes,...`` in the order of its moves."""
    line = lambda v: F.concat_ws("=", v["uci"], v["votes"].cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("uci", "votes")))
    return votes.groupBy(index).agg(F.array_join(F.transform(listed, line), ",").alias("tally"))


def vote_winners(choices: DataFrame, votes: DataFrame, min_margin: int = 0, index: str = "choice_index") -> DataFrame:
    """Winner of every voted choice: most votes, then the earliest candidate. With a margin, a
    winner that does not lead the first candidate by that much gives way to it.

    Candidates and votes are dealt by choice once; there they meet by move, and then all of a choice.
    """
    listed = choices.select(index, F.posexplode(F.transform("candidates", lambda c: c["uci"])).alias("pos", "uci"))
    both = listed.unionByName(votes.select(index, "uci", "votes"), allowMissingColumns=True).repartition(index)
    counted = both.groupBy(index, "uci").agg(F.min("pos").alias("pos"), F.max("votes").alias("votes"))
    return _elected(counted, min_margin, index, voted=True)


def runtime_votes(choices: DataFrame, decisions: DataFrame, min_margin: int = 0, index: str = "choice_index") -> DataFrame:
    """What a pairwise selector plays: every pair adds a vote, an answer that names neither move one for the left move.

    ``decisions(<index>, pair_moves, parsed_move)``. A choice of one candidate has no pair and is that candidate's. Adds
    the winner, its margin, the fallback, the move played, and the numbers of decisions and of invalid answers.
    """
    named = F.coalesce(F.array_contains("pair_moves", F.col("parsed_move")), F.lit(False))
    cast = decisions.select(index, F.when(named, F.col("parsed_move")).otherwise(F.col("pair_moves")[0]).alias("uci"), named.alias("named"))
    votes = cast.groupBy(index, "uci").agg(F.count(F.lit(1)).alias("votes"), count_if(~F.col("named")).alias("_invalid"))
    listed = choices.select(index, F.posexplode(F.transform("candidates", lambda c: c["uci"])).alias("pos", "uci"))
    counted = listed.join(votes, [index, "uci"], "left")
    totals = votes.groupBy(index).agg(F.sum("votes").alias("decisions"), F.sum("_invalid").alias("invalid_count"))
    won = _elected(counted.drop("_invalid"), min_margin, index).join(totals, index, "left")
    return won.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("decisions", "invalid_count")})


def _elected(counted: DataFrame, min_margin: int, index: str, voted: bool = False) -> DataFrame:
    """Winner, margin and fallback of every choice from its candidates (pos, uci) with their votes, NULL for none.

    A move without ``pos`` is no candidate; with ``voted``, it still makes its choice one that has votes, and only these stay.
    """
    votes, listed = F.coalesce("votes", F.lit(0)), F.col("pos").isNotNull()
    out = counted.groupBy(index).agg(
        F.max_by("uci", F.when(listed, F.struct(votes.alias("v"), (-F.col("pos")).alias("p")))).alias("vote_winner"),
        F.max(F.when(listed, votes)).alias("_top"), F.min_by("uci", "pos").alias("_first"), F.min_by(votes, "pos").alias("_first_votes"),
        F.count("votes").alias("_voted"),
    ).where(F.col("_first").isNotNull() & ((F.col("_voted") > 0) | F.lit(not voted)))
    margin = F.col("_top") - F.col("_first_votes")
    fallback = (F.col("vote_winner") != F.col("_first")) & (margin < min_margin)
    return out.select(
        index, "vote_winner", margin.alias("vote_margin_to_first"), fallback.alias("margin_fallback_applied"),
        F.when(fallback, F.col("_first")).otherwise(F.col("vote_winner")).alias("selected_move"),
    )


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Pair-level rates of a pairwise prediction file."""
    named = F.coalesce(F.array_contains("pair_moves", F.col("parsed_move")), F.lit(False))
    counts = pairs.agg(
        F.count(F.lit(1)).alias("pair_examples"), count_if(F.col("parse_ok")).alias("pair_parse_ok"),
        count_if(F.col("legal_ok")).alias("pair_legal_ok"), count_if(named).alias("pair_candidate_ok"),
        count_if(F.col("parsed_move") == F.col("move")).alias("pair_top1_match"),
    )
    n = F.col("pair_examples")
    rates = {"pair_parse_rate": "pair_parse_ok", "pair_legal_rate": "pair_legal_ok",
             "pair_candidate_ok_rate": "pair_candidate_ok", "pair_top1_match_rate": "pair_top1_match"}
    return counts.select("*", *[rate4(F.col(c), n).alias(name) for name, c in rates.items()])


# Reranking ------------------------------------------------------------------------


def collapse_samples(samples: DataFrame) -> DataFrame:
    """Identical moves of a request become one candidate: multiplicity, first index, first text.
    ``samples(request_id, sample_index, uci, raw_response)``, legal moves only."""
    return samples.groupBy("request_id", "uci").agg(
        F.count(F.lit(1)).alias("multiplicity"), F.min("sample_index").alias("first_index"),
        F.min_by("raw_response", "sample_index").alias("raw_response"),
    )


def selection_loss() -> Column:
    return F.coalesce(
        F.col("centipawn_loss").cast("double"), -F.col("ranking_score"), F.when(F.col("vetoed"), 1e6).otherwise(0.0)
    )


def veto_selection(scored: DataFrame) -> DataFrame:
    """Chosen move per request and its telemetry. Safe candidates win by multiplicity, loss and
    order; when every candidate is vetoed, the smallest loss wins."""
    c, safe = F.col, ~F.col("vetoed")
    pick = F.struct("uci", "multiplicity")
    loss = selection_loss().alias("loss")
    grouped = scored.groupBy("request_id").agg(
        F.min_by(F.when(safe, pick), F.when(safe, F.struct((-c("multiplicity")).alias("m"), loss, "first_index"))).alias("safe"),
        F.min_by(pick, F.struct(loss, "first_index")).alias("least_bad"),
        F.min_by("uci", "first_index").alias("first_legal_uci"),
        F.sum("multiplicity").alias("n_legal"), F.count(F.lit(1)).alias("n_distinct_legal"),
        count_if(c("vetoed")).alias("n_vetoed"),
    )
    chosen = F.coalesce("safe", "least_bad")
    return grouped.select(
        "request_id", chosen["uci"].alias("chosen_uci"), chosen["multiplicity"].alias("chosen_multiplicity"),
        "first_legal_uci", "n_legal", "n_distinct_legal", "n_vetoed",
        (chosen["uci"] != c("first_legal_uci")).alias("veto_changed_move"), c("safe").isNull().alias("all_vetoed"),
    )


def rerank_records(requests: DataFrame, scored: DataFrame, configured: int, scorer: str, threshold: int) -> DataFrame:
    """The stored record of every request, one without a legal candidate included: what was configured, generated, legal,
    vetoed and chosen, and the scored candidates in the order in which they came.

    ``requests(request_id, n_candidates_generated)``; ``scored`` as for ``veto_selection``. A request's candidates are the
    distinct moves of its few samples.
    """
    fields = ("uci", "multiplicity", "centipawn_loss", "classification", "vetoed", "ranking_score")
    listed = scored.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("first_index", F.struct(*fields).alias("c")))).alias("_listed"))
    found = requests.join(veto_selection(scored), "request_id", "left").join(listed, "request_id", "left")
    none = {"n_legal": 0, "n_distinct_legal": 0, "n_vetoed": 0, "veto_changed_move": False, "all_vetoed": False}
    kind = f"ARRAY<{scored.select(F.struct(*fields).alias('c')).schema['c'].dataType.simpleString()}>"
    return found.select(
        "request_id", F.lit(scorer).alias("scorer"), F.lit(configured).alias("n_candidates_configured"), F.lit(threshold).alias("veto_cpl_threshold"),
        "n_candidates_generated", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()], "chosen_multiplicity", "chosen_uci", "first_legal_uci",
        F.coalesce(F.transform("_listed", lambda x: x["c"]), F.array().cast(kind)).alias("candidates"),
    )


TELEMETRY = (
    "n_candidates_configured INT, n_candidates_generated INT, n_legal INT, n_distinct_legal INT, n_vetoed INT, "
    "veto_changed_move BOOLEAN, all_vetoed BOOLEAN, chosen_multiplicity INT"
)


def telemetry_report(attempts: DataFrame) -> DataFrame:
    """Averages and shares over stored reranking records."""
    parsed = attempts.where(F.col("reranker_metadata").isNotNull()).select(
        F.from_json("reranker_metadata", TELEMETRY).alias("t")
    ).select("t.*").where(F.col("n_candidates_generated").isNotNull())
    n = F.count(F.lit(1))
    return parsed.agg(
        n.alias("attempts"), F.avg("n_candidates_generated").alias("avg_generated"), F.avg("n_legal").alias("avg_legal"),
        F.avg("n_distinct_legal").alias("avg_distinct_legal"), F.avg("n_vetoed").alias("avg_vetoed"),
        rate(count_if(F.col("veto_changed_move")), n).alias("changed_share"),
        rate(count_if(F.col("all_vetoed")), n).alias("all_vetoed_share"),
        F.avg("chosen_multiplicity").alias("avg_chosen_multiplicity"),
    )


# Rewards --------------------------------------------------------------------------


def reward_samples(rows: DataFrame, cached: DataFrame, best_moves: DataFrame, evaluations: DataFrame,
                   rule: RewardRule = RewardRule(), counts: DataFrame | None = None) -> DataFrame:
    """Score proposals with reuse: a known (fen, move) takes its stored evaluation, a move equal
    to the known best move of its position counts as best, the rest goes to the evaluator.

    ``rows(batch, idx, fen, parsed_move, parse_ok, legal_ok)``; ``cached`` and ``evaluations``
    have (fen, uci, centipawn_loss, classification, best_move_uci), one row of each (fen, uci); ``best_moves(fen, best)``. A
    proposal is the best move where (fen, best) is the proposal, so all that is known is looked up by position and move, for
    which rows are exchanged once, with hot proposals split. ``counts`` (``frequent`` of them) saves writing the rows to count.
    """
    keys = ["fen", "parsed_move"]
    if counts is None:
        rows = stored(rows, "rows")
        counts = frequent(rows, keys)
    tagged = lambda df, p: df.select(
        F.col("fen"), F.col("uci").alias("parsed_move"),
        *[F.col(c).alias(f"{p}_{c}") for c in ("centipawn_loss", "classification", "best_move_uci")], F.lit(True).alias(f"{p}_hit")
    )
    best = best_moves.select("fen", F.col("best").alias("parsed_move")).where("parsed_move IS NOT NULL").distinct().withColumn("_equal", F.lit(True))
    joined = split_lookup(rows, [tagged(cached, "k"), tagged(evaluations, "e"), best], keys, counts)
    hit, equal = F.coalesce("k_hit", F.lit(False)), F.coalesce("_equal", F.lit(False))
    pick = lambda name, best: F.when(hit, F.col(f"k_{name}")).when(equal, best).otherwise(F.col(f"e_{name}"))
    legal = F.col("parse_ok") & F.col("legal_ok")
    known = legal & hit
    is_best = legal & ~known & equal
    scored = joined.withColumns({
        "centipawn_loss": F.when(legal, pick("centipawn_loss", F.lit(0))),
        "best_move_uci": F.when(legal, pick("best_move_uci", F.col("parsed_move"))),
        "classification": F.when(~F.col("parse_ok"), "malformed").when(~F.col("legal_ok"), "illegal")
        .when(legal, pick("classification", F.lit("best"))),
        "cache_hit": known | is_best,
        "evaluated": legal & ~known & ~is_best,
    })
    reward = move_reward(F.col("parse_ok"), F.col("legal_ok"), F.col("centipawn_loss"), F.col("classification"),
                         F.col("parsed_move"), F.col("best_move_uci"), rule)
    return scored.withColumn("reward", F.when(F.col("legal_ok") & is_best, 1.0).otherwise(reward)).select(
        *rows.columns, "centipawn_loss", "best_move_uci", "classification", "reward", "cache_hit", "evaluated"
    )


def reward_batches(samples: DataFrame) -> DataFrame:
    """Statistics per batch."""
    legal = F.col("parse_ok") & F.col("legal_ok")
    counts = samples.groupBy("batch").agg(
        F.count(F.lit(1)).alias("examples"), count_if(~F.col("parse_ok")).alias("malformed"),
        count_if(F.col("parse_ok") & ~F.col("legal_ok")).alias("illegal"), count_if(legal).alias("legal"),
        F.avg("reward").alias("mean_reward"), F.avg(F.when(legal, F.col("centipawn_loss"))).alias("mean_legal_cpl"),
        count_if(F.col("evaluated")).alias("engine_evaluations"), count_if(F.col("cache_hit")).alias("cache_hits"),
    )
    n = F.col("examples")
    return counts.select("*", *[rate(F.col(c), n).alias(f"{c}_fraction") for c in ("malformed", "illegal", "legal")])


def reward_log(samples: DataFrame, stats: DataFrame, first: int) -> DataFrame:
    """Batch statistics with the first samples of each batch as one JSON line. ``samples`` and ``stats``, which is made of
    them, are both read, so they should be a written table. The first are found by their numbers alone, so whole samples
    are not sorted."""
    least = stored(top_per_group(samples.select("batch", "idx"), ["batch"], [F.asc("idx")], first).select(
        F.col("batch").alias("_batch"), F.col("idx").alias("_idx")), "least")
    same = F.col("batch").eqNullSafe(F.col("_batch")) & F.col("idx").eqNullSafe(F.col("_idx"))
    head = top_per_group(samples.join(least, same, "left_semi"), ["batch"], [F.asc("idx")], first)
    fields = ("reward", "parse_ok", "legal_ok", "parsed_move", "centipawn_loss", "best_move_uci", "classification")
    lists = head.groupBy("batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("samples")
    )
    body = F.struct(*[c for c in stats.columns if c != "batch"], "samples")
    return stats.join(lists, "batch").select("batch", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
