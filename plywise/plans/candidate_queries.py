"""Candidate, choice, pair and comparison sets on the supplied tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels
from plywise.operators import candidates as ops
from plywise.operators import choices
from plywise.operators.ordering import HEAVY, counters, dense_index, frequent
from plywise.operators.selection import first_rows
from plywise.plans.board_queries import evaluations
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.registry import query, written
from plywise.plans.sqltext import judged_sql, mean2
from plywise.sources.records import external_candidates

# The capped variants keep so many candidates of a position; the others keep all.
CAP = 3

# Labels -----------------------------------------------------------------------------

_LABELLED = """
SELECT *, CASE WHEN classification IN ('blunder', 'mate_missed') THEN 'blunder' WHEN centipawn_loss IS NULL THEN 'playable'
    WHEN centipawn_loss <= 50 THEN 'good' WHEN centipawn_loss <= 150 THEN 'playable' WHEN centipawn_loss <= 300 THEN 'mistake'
    ELSE 'blunder' END AS risk,
  CAST(CASE WHEN classification = 'mate_missed' THEN 0 WHEN centipawn_loss IS NULL THEN 50
       ELSE greatest(least(round_even(100 - centipawn_loss / 4.0, 0), 100), 0) END AS INT) AS score,
  CASE WHEN classification = 'mate_missed' OR centipawn_loss > 300 THEN 'material_or_mate'
       WHEN classification <> 'blunder' AND centipawn_loss <= 50 THEN 'none' ELSE 'unknown' END AS reason_type,
  CASE CAST('0x' || substr(sha256(fen_before), 1, 2) AS INT) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split
FROM candidates"""


def labelled(fx: Fixtures) -> DataFrame:
    kind, cpl = F.col("classification"), F.col("centipawn_loss")
    return fx.candidates.withColumns({
        "risk": labels.risk(kind, cpl), "score": labels.score(kind, cpl), "reason_type": labels.reason_type(kind, cpl),
        "split": labels.position_split(F.col("fen_before")),
    })


def labelled_sql(body: str, extra: dict[str, str] | None = None, views: tuple[str, ...] = ()) -> str:
    return with_views(["candidates", *views], body, extra={"labelled": _LABELLED, **(extra or {})})


@query("candidate_labels", labelled_sql("SELECT seq, fen_before, risk, score, reason_type, split FROM labelled"))
def candidate_labels(fx: Fixtures) -> DataFrame:
    return labelled(fx).select("seq", "fen_before", "risk", "score", "reason_type", "split")


# Sources and build ------------------------------------------------------------------

_SPECS = """
SELECT 0 AS s, run_id AS o0, game_id AS o1, CAST(ply AS BIGINT) AS o2, 0 AS o3, 0 AS o4, fen_before, accepted_uci AS candidate_uci,
  CASE WHEN classification IN ('blunder', 'mate_missed') THEN 'arena_blunder' ELSE 'arena_move' END AS source,
  CAST(NULL AS INT) AS candidate_rank_in_generator, CAST(NULL AS VARCHAR) AS generator_idea,
  run_id AS source_run_id, game_id AS source_game_id, move_id AS source_move_id, CAST(NULL AS BIGINT) AS source_attempt_id
FROM moves JOIN games USING (game_id) LEFT JOIN (SELECT move_id, classification FROM evaluations) e USING (move_id)
UNION ALL
SELECT 1, run_id, game_id, m.ply, attempt_number, k.rank, fen_before, CASE k.rank WHEN 0 THEN accepted_uci ELSE accepted_uci || 'b' END,
  CASE WHEN m.ply % 2 = 0 THEN 'arena_candidate_pairwise' ELSE 'arena_candidate' END, k.rank,
  CASE k.rank WHEN 0 THEN 'plan ' || m.ply END, run_id, game_id, m.move_id, attempt_id
FROM (SELECT attempt_id, move_id, attempt_number FROM attempts WHERE legal_ok) a JOIN moves m USING (move_id)
JOIN games USING (game_id), (SELECT 0 AS rank UNION ALL SELECT 1) k WHERE l_returnflag = 'A'
UNION ALL
SELECT DISTINCT 2, run_id, game_id, ply, 0, 0, fen_before, best_move_uci, 'stockfish_good', NULL, NULL, run_id, game_id, move_id, NULL
FROM moves JOIN games USING (game_id) JOIN evaluations USING (move_id) WHERE best_move_uci IS NOT NULL
UNION ALL
SELECT 3, seq, 0, 0, 0, 0, fen_before, candidate_uci, CASE WHEN source = 'random_legal' THEN 'policy_sample' ELSE source END,
  candidate_rank_in_generator, NULL, NULL, NULL, NULL, NULL FROM candidates"""


def all_specs(fx: Fixtures) -> DataFrame:
    fx.number_lines()
    return _specs_of(fx, fx.moves, fx.candidates)


def _specs_of(fx: Fixtures, moves: DataFrame, candidates: DataFrame, by_position: bool = False, columns: Sequence[str] = ()) -> DataFrame:
    """All specs, or those of their columns that are asked for."""
    fields = F.struct(
        F.col("fen_before").alias("fen"), F.lit("").alias("candidate_uci"), F.col("candidate_uci").alias("uci"),
        F.when(F.col("source") != "random_legal", F.col("source")).alias("source"),
        F.col("candidate_rank_in_generator").cast("string").alias("candidate_rank_in_generator"),
    )
    foreign = ops.external_specs(external_candidates(candidates.select("seq", F.to_json(fields).alias("value"))), "seq")
    kept = {"columns": ("fen_before", "candidate_uci", *columns)} if columns else {}
    foreign = foreign.select(*kept["columns"], "spec_order") if kept else foreign
    return ops.union_specs(
        ops.game_specs(moves, fx.games, evaluations(fx), fx.attempts, by_position=by_position, **kept),
        foreign.repartition("fen_before") if by_position else foreign)


def of_positions(fx: Fixtures, run: Callable[[DataFrame, DataFrame, DataFrame, bool], DataFrame], columns: Sequence[str] = ()) -> DataFrame:
    """``run(specs, legal moves, candidates, by position)`` of all positions: those of few moves with all three dealt by position, so that
    what meets by position, or by position and move, does so in place; those of many moves, which are counted first, apart."""
    fx.number_lines()
    both = fx.moves.select("fen_before").unionAll(fx.candidates.select("fen_before"))
    heavy = first_rows(frequent(both, ["fen_before"]), [-F.col("_n"), "fen_before"], HEAVY).select("fen_before")
    dealt = lambda keep: run(_specs_of(fx, keep(fx.moves), keep(fx.candidates), True, columns), fx.legal_moves.repartition("fen"),
                             keep(fx.candidates).repartition("fen_before"), True)
    if heavy.isEmpty():
        return dealt(lambda df: df)
    few = F.broadcast(heavy)
    apart = lambda df: df.join(few, "fen_before", "left_semi")
    return dealt(lambda df: df.join(few, "fen_before", "left_anti")).unionByName(
        run(_specs_of(fx, apart(fx.moves), apart(fx.candidates), False, columns), fx.legal_moves, apart(fx.candidates), False))


_SPEC_VIEWS = ["moves", "games", "attempts", "candidates", "legal_moves"]
_SPEC_COLUMNS = ("fen_before, candidate_uci, source, candidate_rank_in_generator, generator_idea, source_run_id, "
                 "source_game_id, source_move_id, source_attempt_id")
_UNIQUE = """
SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY fen_before, candidate_uci ORDER BY s, o0, o1, o2, o3, o4) AS nth
  FROM specs s WHERE (fen_before, candidate_uci) IN (SELECT (fen, uci) FROM legal_moves)) x WHERE nth = 1"""


@query("candidate_specs", judged_sql(_SPEC_VIEWS, f"SELECT {_SPEC_COLUMNS} FROM specs", {"specs": _SPECS}))
def candidate_specs(fx: Fixtures) -> DataFrame:
    return all_specs(fx).drop("spec_order")


@query("unique_candidate_specs", judged_sql(_SPEC_VIEWS, f"SELECT {_SPEC_COLUMNS} FROM uniq", {"specs": _SPECS, "uniq": _UNIQUE}))
def unique_candidate_specs(fx: Fixtures) -> DataFrame:
    return unique_legal(fx).drop("spec_order")


def unique_legal(fx: Fixtures, *columns: str) -> DataFrame:
    """The first spec of every legal (position, move). Legality is a matter of that key alone, so repeats go first; so do
    columns that nobody asks for, as a spec is exchanged whole."""
    return of_positions(fx, lambda specs, legal, rows, by_position: ops.unique_legal_specs(specs, legal), columns)


_CAPPED = f"""
SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY fen_before ORDER BY s, o0, o1, o2, o3, o4) AS place FROM uniq u) x
WHERE place <= {CAP}"""


_CANDIDATE_ROWS = """
SELECT c.fen_before, c.candidate_uci, c.source, l.risk, l.score, l.reason_type, l.split,
  concat('{"risk":"', l.risk, '","blunder":', CASE WHEN l.risk = 'blunder' THEN 'true' ELSE 'false' END, ',"score":', l.score,
         ',"reason_type":"', l.reason_type, '"}') AS target
FROM {chosen} c JOIN labelled l USING (fen_before, candidate_uci)
WHERE l.seq = (SELECT min(seq) FROM candidates k WHERE k.fen_before = l.fen_before AND k.candidate_uci = l.candidate_uci)"""
_ROW_CTES = {"specs": _SPECS, "uniq": _UNIQUE, "capped": _CAPPED, "labelled": _LABELLED}


def labelled_specs(fx: Fixtures, cap: int | None) -> DataFrame:
    names = ["fen_before", "candidate_uci"]

    def chosen(specs: DataFrame, legal: DataFrame, rows: DataFrame, by_position: bool) -> DataFrame:
        judged = ops.unique_legal_specs(specs, legal).join(first_evaluations(rows).withColumn("_judged", F.lit(True)), names, "left")
        return ops.cap_candidates(judged, cap).where("_judged").drop("_judged")

    return ops.label_candidates(of_positions(fx, chosen, ["source"]))


def first_evaluations(rows: DataFrame) -> DataFrame:
    names = ["fen_before", "candidate_uci", "centipawn_loss", "classification"]
    return ops.first_per_key(rows.select(*names, "seq"), names[:2], ["seq"]).drop("seq")


@query("candidate_rows", judged_sql(_SPEC_VIEWS, _CANDIDATE_ROWS.replace("{chosen}", "uniq"), _ROW_CTES))
def candidate_rows(fx: Fixtures) -> DataFrame:
    return labelled_specs(fx, None).select(
        "fen_before", "candidate_uci", "source", "risk", "score", "reason_type", "split", "target")


@query("candidate_rows_capped", judged_sql(_SPEC_VIEWS, _CANDIDATE_ROWS.replace("{chosen}", "capped"), _ROW_CTES))
def candidate_rows_capped(fx: Fixtures) -> DataFrame:
    return labelled_specs(fx, CAP).select(
        "fen_before", "candidate_uci", "source", "risk", "score", "reason_type", "split", "target")


_BUILD_COUNTS = """
SELECT 'candidates_seen' AS metric, '' AS key, count(*) AS n FROM specs
UNION ALL SELECT 'dropped_illegal_candidate', '', count(*) FILTER (fen IS NULL) FROM specs LEFT JOIN legal_moves ON fen = fen_before AND uci = candidate_uci
UNION ALL SELECT 'dropped_duplicate_candidate', '', count(fen) - (SELECT count(*) FROM uniq) FROM specs LEFT JOIN legal_moves ON fen = fen_before AND uci = candidate_uci
UNION ALL SELECT 'dropped_candidate_limit', '', (SELECT count(*) FROM uniq) - (SELECT count(*) FROM capped)
UNION ALL SELECT 'by_risk', risk, count(*) FROM capped JOIN (SELECT fen_before, candidate_uci, arg_min(risk, seq) AS risk FROM labelled GROUP BY 1, 2) USING (fen_before, candidate_uci) GROUP BY 2
UNION ALL SELECT 'positions_seen', '', count(DISTINCT fen_before) FROM uniq
UNION ALL SELECT 'rows_written', '', count(*) FROM capped
UNION ALL SELECT 'by_source', source, count(*) FROM capped GROUP BY 2
UNION ALL SELECT 'by_split', CASE CAST('0x' || substr(sha256(fen_before), 1, 2) AS INT) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END, count(*) FROM capped GROUP BY 2"""


@query("candidate_build_counts", judged_sql(_SPEC_VIEWS, _BUILD_COUNTS, _ROW_CTES))
def candidate_build_counts(fx: Fixtures) -> DataFrame:
    return _build_counts(fx, CAP)


def _build_counts(fx: Fixtures, cap: int | None) -> DataFrame:
    run = lambda specs, legal, rows, by_position: ops.build_counts(specs, legal, first_evaluations(rows), cap, by_position)
    counts = of_positions(fx, run, ["source"])
    return counts.groupBy("metric", "key").agg(F.sum("n").alias("n"))


@query("candidate_build_counts_whole", judged_sql(_SPEC_VIEWS, _BUILD_COUNTS, {**_ROW_CTES, "capped": "SELECT * FROM uniq"}))
def candidate_build_counts_whole(fx: Fixtures) -> DataFrame:
    return _build_counts(fx, None)


@query("first_seen_positions", judged_sql(_SPEC_VIEWS, f"""
SELECT {_SPEC_COLUMNS} FROM uniq WHERE fen_before IN (
  SELECT fen_before FROM (SELECT fen_before, min((s, o0, o1, o2, o3, o4)) AS seen FROM uniq GROUP BY 1) x ORDER BY seen LIMIT 500)""",
    {"specs": _SPECS, "uniq": _UNIQUE}))
def first_seen_positions(fx: Fixtures) -> DataFrame:
    return ops.choose_positions(unique_legal(fx), 500).drop("spec_order")


@query("shuffled_positions", with_views(["candidates"], """
SELECT seq, fen_before, candidate_uci FROM candidates WHERE fen_before IN (
  SELECT fen_before FROM (SELECT DISTINCT fen_before FROM candidates) x ORDER BY sha256('7|' || fen_before) LIMIT 500)"""))
def shuffled_positions(fx: Fixtures) -> DataFrame:
    specs = fx.candidates.select("seq", "fen_before", "candidate_uci", F.struct("seq").alias("spec_order"))
    return ops.choose_positions(specs, 500, shuffle_seed=7).drop("spec_order")


@query("random_legal_specs", with_views(["candidates", "legal_moves"], """
SELECT fen AS fen_before, uci AS candidate_uci, 'random_legal' AS source FROM (
  SELECT fen, uci, row_number() OVER (PARTITION BY fen ORDER BY sha256('11|' || fen || '|' || uci)) AS n
  FROM legal_moves WHERE fen IN (SELECT fen_before FROM candidates)) x WHERE n <= 2"""))
def random_legal_specs(fx: Fixtures) -> DataFrame:
    return ops.random_specs(fx.candidates, fx.legal_moves, 2, 11).select("fen_before", "candidate_uci", "source")


@query("risk_prompts", with_views(["candidates", "legal_moves"], """
SELECT seq, sha256('You are a chess move risk classifier.' || chr(10) || chr(10) || 'Position:' || chr(10) || 'FEN before: ' || fen_before ||
  chr(10) || 'Side to move: ' || side_to_move || chr(10) || 'Candidate move: ' || candidate_uci || ' (' || candidate_san || ')' || chr(10) ||
  'FEN after candidate: ' || fen_before || chr(10) || 'Opponent legal replies: ' || coalesce(CASE WHEN n > 3
     THEN array_to_string(m[1:3], ', ') || ' ... (' || (n - 3) || ' more)' ELSE array_to_string(m, ', ') END, '') || chr(10) || chr(10) ||
  'Classify whether the candidate is tactically safe.' || chr(10) || 'Return JSON only:' || chr(10) ||
  '{"risk":"blunder|mistake|playable|good","blunder":true,"score":0,"reason_type":"material_or_mate"}') AS prompt_hash
FROM candidates LEFT JOIN (SELECT fen, list(uci ORDER BY uci) AS m, count(*) AS n FROM legal_moves GROUP BY 1) l ON fen = fen_before"""))
def risk_prompts(fx: Fixtures) -> DataFrame:
    rows = fx.candidates.withColumn("fen_after", F.col("fen_before"))
    return ops.with_risk_prompt(rows, ops.move_list_texts(fx.legal_moves, 3)).select("seq", F.sha2("prompt", 256).alias("prompt_hash"))


# Signal report ------------------------------------------------------------------------

_ROLES = """
SELECT fen_before, count(*) AS candidates, bool_or(risk IN ('good', 'playable')) AND bool_or(risk IN ('mistake', 'blunder')) AS mixed,
  arg_min(r, seq) FILTER (source IN ('arena_move', 'arena_blunder')) AS final,
  arg_min(r, (candidate_rank_in_generator, seq)) FILTER (source IN ('arena_candidate', 'policy_sample') AND candidate_rank_in_generator IS NOT NULL) AS first,
  arg_max(r, (score, coalesce(-centipawn_loss, -999999), -seq)) AS oracle
FROM (SELECT *, {'uci': candidate_uci, 'risk': risk, 'score': score, 'cpl': centipawn_loss} AS r FROM labelled) x GROUP BY 1"""


def _signal_sql() -> str:
    parts = ["CAST(sum(candidates) AS BIGINT) AS rows", "count(*) AS positions",
             "count(first) AS positions_with_generator_candidates", "count(*) FILTER (mixed) AS mixed_safe_unsafe_positions",
             "min(candidates) AS candidates_min", "max(candidates) AS candidates_max", f"{mean2('candidates')} AS candidates_mean"]
    for role in ("final", "first", "oracle"):
        parts += [f"count({role}) AS {role}_count", f"{mean2(role + '.score')} AS {role}_mean_score", f"{mean2(role + '.cpl')} AS {role}_mean_cpl"]
    for role in ("final", "first"):
        parts += [f"{mean2(f'oracle.score - {role}.score')} AS gain_vs_{role}_mean_score",
                  f"{mean2(f'{role}.cpl - oracle.cpl')} AS gain_vs_{role}_mean_cpl",
                  f"count(*) FILTER (oracle.score > {role}.score) AS improved_vs_{role}_by_score",
                  f"count(*) FILTER ({role}.cpl > oracle.cpl) AS improved_vs_{role}_by_cpl",
                  f"count(*) FILTER ({role}.risk = 'blunder' AND oracle.risk IN ('good', 'playable')) AS {role}_blunder_oracle_safe"]
    return "SELECT " + ", ".join(parts) + " FROM roles"


@query("signal_report", labelled_sql(_signal_sql(), {"roles": _ROLES}))
def signal_report(fx: Fixtures) -> DataFrame:
    return ops.signal_report(labelled(fx))


@query("signal_counts", labelled_sql("""
SELECT 'risk' AS metric, risk AS key, count(*) AS n FROM labelled GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM labelled GROUP BY 2
UNION ALL SELECT 'final_risk', final.risk, count(*) FROM roles WHERE final IS NOT NULL GROUP BY 2
UNION ALL SELECT 'first_risk', first.risk, count(*) FROM roles WHERE first IS NOT NULL GROUP BY 2
UNION ALL SELECT 'oracle_risk', oracle.risk, count(*) FROM roles GROUP BY 2""", {"roles": _ROLES}))
def signal_counts(fx: Fixtures) -> DataFrame:
    return ops.signal_counts(labelled(fx))


@query("role_selections", labelled_sql("""
SELECT fen_before, candidates, mixed, final.uci AS final_uci, first.uci AS first_uci, oracle.uci AS oracle_uci FROM roles""", {"roles": _ROLES}))
def role_selections(fx: Fixtures) -> DataFrame:
    pick = lambda r: F.col(f"{r}.candidate_uci").alias(f"{r}_uci")
    return ops.role_selections(labelled(fx)).select("fen_before", "candidates", "mixed", pick("final"), pick("first"), pick("oracle"))


# Choices ------------------------------------------------------------------------------

_BEST = """
SELECT fen_before AS fen, candidate_uci AS uci, candidate_san AS san, source, risk, score, centipawn_loss AS cpl, candidate_rank_in_generator AS rnk,
  score AS k1, coalesce(-centipawn_loss, -999999) AS k2, coalesce(-candidate_rank_in_generator, -999999) AS k3, first_seq
FROM (SELECT *, row_number() OVER (PARTITION BY fen_before, candidate_uci ORDER BY score DESC, coalesce(-centipawn_loss, -999999) DESC,
        coalesce(-candidate_rank_in_generator, -999999) DESC, seq) AS nth, min(seq) OVER (PARTITION BY fen_before, candidate_uci) AS first_seq
      FROM labelled) x WHERE nth = 1"""
_FACTS = "SELECT fen_before AS fen, arg_max(side_to_move, seq) AS side_to_move, min(seq) AS position_seq FROM candidates GROUP BY 1"
_GATE = """
SELECT fen, count(*) AS n, CASE WHEN count(*) < 2 THEN 'too_few_candidates'
  WHEN NOT (bool_or(risk IN ('good', 'playable')) AND bool_or(risk IN ('mistake', 'blunder'))) THEN 'no_mixed_risk' END AS dropped
FROM best GROUP BY 1"""
_CHOICES = """
SELECT fen, side_to_move, position_seq, CAST(count(*) AS INT) AS candidate_count, list(uci ORDER BY h) AS ucis,
  list({'uci': uci, 'san': san, 'risk': risk, 'score': score, 'cpl': cpl, 'k1': k1, 'k2': k2, 'k3': k3} ORDER BY h) AS cands,
  arg_min(uci, place) AS target_move, arg_min(risk, place) AS target_risk, arg_min(score, place) AS target_score,
  max(cpl) FILTER (place = 1) AS target_centipawn_loss
FROM (SELECT b.*, sha256(fen || '|' || uci) AS h, row_number() OVER (PARTITION BY fen ORDER BY k1 DESC, k2 DESC, k3 DESC, first_seq) AS place
      FROM best b WHERE fen IN (SELECT fen FROM gate WHERE dropped IS NULL)) x JOIN facts USING (fen)
{cut} GROUP BY 1, 2, 3"""
CHOICE_CTES = {"best": _BEST, "facts": _FACTS, "gate": _GATE, "choices": _CHOICES.replace("{cut}", "")}
CAPPED_CTES = {**CHOICE_CTES, "choices": _CHOICES.replace("{cut}", f"WHERE place <= {CAP}")}


# Fields of candidates that rows, reports and comparisons ask for.
_SHOWN = ("uci", "san", "risk", "score", "centipawn_loss", "candidate_rank_in_generator")


def choice_set(fx: Fixtures, with_prompt: bool = False, cap: int | None = None) -> DataFrame:
    return choices.choice_rows(labelled(fx), max_candidates=cap, with_prompt=with_prompt, fields=_SHOWN)


_CHOICE_ROWS = """
SELECT fen, side_to_move, candidate_count, array_to_string(ucis, ',') AS shown, target_move, target_risk, target_score, target_centipawn_loss,
  CAST(list_position(ucis, target_move) AS INT) AS target_prompt_index,
  CASE CAST('0x' || substr(sha256(fen), 1, 2) AS INT) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
  sha256('You are a chess candidate move ranker.' || chr(10) || chr(10) || 'Position:' || chr(10) || 'FEN: ' || fen || chr(10) || 'Side to move: ' ||
    side_to_move || chr(10) || chr(10) || 'Candidate moves:' || chr(10) ||
    array_to_string([i || '. ' || cands[i].uci || ' (' || cands[i].san || ')' FOR i IN range(1, candidate_count + 1)], chr(10)) || chr(10) || chr(10) ||
    'Choose the best move from the candidate list.' || chr(10) || 'Return JSON only:' || chr(10) || '{"move":"<uci>"}') AS prompt_hash
FROM choices"""


def _shown_choices(rows: DataFrame) -> DataFrame:
    return rows.select(
        "fen", "side_to_move", "candidate_count", F.array_join("candidates.uci", ",").alias("shown"), "target_move", "target_risk",
        "target_score", "target_centipawn_loss", "target_prompt_index", "split", F.sha2("prompt", 256).alias("prompt_hash"))


@query("choice_rows", labelled_sql(_CHOICE_ROWS, CHOICE_CTES))
def choice_rows(fx: Fixtures) -> DataFrame:
    return _shown_choices(choice_set(fx, with_prompt=True))


@query("choice_rows_capped", labelled_sql(_CHOICE_ROWS, CAPPED_CTES))
def choice_rows_capped(fx: Fixtures) -> DataFrame:
    return _shown_choices(choice_set(fx, with_prompt=True, cap=CAP))


_CHOICE_COUNTS = """
SELECT 'positions_seen' AS metric, '' AS key, count(*) AS n FROM gate
UNION ALL SELECT 'positions_written', '', count(*) FROM choices
UNION ALL SELECT 'dropped_too_few_candidates', '', count(*) FROM gate WHERE dropped = 'too_few_candidates'
UNION ALL SELECT 'dropped_no_mixed_risk', '', count(*) FROM gate WHERE dropped = 'no_mixed_risk'
UNION ALL SELECT 'dropped_candidate_limit', '', CAST(sum(greatest(n - {most}, 0)) AS BIGINT) FROM gate WHERE dropped IS NULL
UNION ALL SELECT 'by_target_risk', target_risk, count(*) FROM choices GROUP BY 2
UNION ALL SELECT 'by_candidate_count', candidate_count::VARCHAR, count(*) FROM choices GROUP BY 2
UNION ALL SELECT 'by_target_prompt_index', list_position(ucis, target_move)::VARCHAR, count(*) FROM choices GROUP BY 2"""


@query("choice_counts", labelled_sql(_CHOICE_COUNTS.replace("{most}", str(CAP)), CAPPED_CTES))
def choice_counts(fx: Fixtures) -> DataFrame:
    return _choice_counts(fx, CAP)


@query("choice_counts_whole", labelled_sql(_CHOICE_COUNTS.replace("{most}", "n") + """
UNION ALL SELECT 'input_rows', '', count(*) FROM labelled
UNION ALL SELECT 'by_split', CASE CAST('0x' || substr(sha256(fen), 1, 2) AS INT) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END, count(*) FROM choices GROUP BY 2""", CHOICE_CTES))
def choice_counts_whole(fx: Fixtures) -> DataFrame:
    rows = labelled(fx)
    return _choice_counts(fx, None).unionByName(choices.unpivot_counts(rows.agg(F.count("*").alias("input_rows")))).unionByName(
        counters(choice_set(fx), {"by_split": F.col("split")}))


def _choice_counts(fx: Fixtures, cap: int | None) -> DataFrame:
    """Lists are made once and written, as the drops and the rows both read them."""
    lists = written(fx, choices.position_lists(labelled(fx), cap, fields=_SHOWN), "lists")
    rows = counters(choices.choices_of(lists, with_prompt=False), {
        "by_target_risk": F.col("target_risk"), "by_candidate_count": F.col("candidate_count"),
        "by_target_prompt_index": F.col("target_prompt_index")})
    return choices.drops_of(lists, 2, cap, True).unionByName(rows)


# Pairs --------------------------------------------------------------------------------

_PAIRS = """
SELECT *, row_number() OVER (PARTITION BY fen ORDER BY coalesce(gap, -1) DESC, h DESC) - 1 AS pair_index FROM (
  SELECT *, sha256(fen || '|' || b.uci || '|' || w.uci) AS h FROM (
    SELECT fen, abs(s.cpl - u.cpl) AS gap, CASE WHEN (s.k1, s.k2, s.k3) >= (u.k1, u.k2, u.k3) THEN s ELSE u END AS b,
      CASE WHEN (s.k1, s.k2, s.k3) >= (u.k1, u.k2, u.k3) THEN u ELSE s END AS w
    FROM (SELECT fen, x AS s FROM best x WHERE risk IN ('good', 'playable')) s
    JOIN (SELECT fen, x AS u FROM best x WHERE risk IN ('mistake', 'blunder')) u USING (fen)) p
  WHERE gap IS NULL OR gap >= 100) q"""
_SHOWN_PAIR = "sha256(fen || '|' || pair_index || '|' || b.uci) <= sha256(fen || '|' || pair_index || '|' || w.uci)"


@query("pair_rows", labelled_sql(f"""
SELECT fen, CAST(pair_index AS INT) AS pair_index, side_to_move, CASE WHEN {_SHOWN_PAIR} THEN b.uci || ',' || w.uci ELSE w.uci || ',' || b.uci END AS shown,
  b.uci AS target_move, b.risk AS target_risk, b.score AS target_score, b.cpl AS target_centipawn_loss,
  CAST(CASE WHEN {_SHOWN_PAIR} THEN 1 ELSE 2 END AS INT) AS target_prompt_index,
  least(b.risk, w.risk) || '->' || greatest(b.risk, w.risk) AS pair_risks, CAST(gap AS INT) AS pair_cpl_gap
FROM pairs JOIN facts USING (fen) WHERE pair_index < 4""", {"best": _BEST, "facts": _FACTS, "pairs": _PAIRS}))
def pair_rows(fx: Fixtures) -> DataFrame:
    return choices.pair_rows(labelled(fx), 4, with_prompt=False).select(
        "fen", "pair_index", "side_to_move", F.array_join("candidates.uci", ",").alias("shown"), "target_move", "target_risk",
        "target_score", "target_centipawn_loss", "target_prompt_index", "pair_risks", "pair_cpl_gap")


@query("pair_counts", labelled_sql("""
SELECT 'positions_seen' AS metric, '' AS key, count(DISTINCT fen) AS n FROM best
UNION ALL SELECT 'positions_with_pairs', '', count(DISTINCT fen) FROM pairs
UNION ALL SELECT 'examples_written', '', count(*) FILTER (pair_index < 4) FROM pairs
UNION ALL SELECT 'dropped_pair_limit', '', count(*) FILTER (pair_index >= 4) FROM pairs
UNION ALL SELECT 'dropped_no_safe_candidate', '', count(*) FROM sides WHERE safe = 0
UNION ALL SELECT 'dropped_no_unsafe_candidate', '', count(*) FROM sides WHERE safe > 0 AND unsafe = 0
UNION ALL SELECT 'dropped_small_gap_pairs', '', CAST(sum(safe * unsafe) AS BIGINT) - (SELECT count(*) FROM pairs) FROM sides""",
    {"best": _BEST, "pairs": _PAIRS, "sides": """
SELECT fen, count(*) FILTER (risk IN ('good', 'playable')) AS safe, count(*) FILTER (risk IN ('mistake', 'blunder')) AS unsafe FROM best GROUP BY 1"""}))
def pair_counts(fx: Fixtures) -> DataFrame:
    return choices.pair_drops(labelled(fx), 4, 100)


@query("first_pair_examples", labelled_sql("""
SELECT fen, CAST(pair_index AS INT) AS pair_index, b.uci AS target_move FROM pairs JOIN facts USING (fen) WHERE pair_index < 4
ORDER BY position_seq, pair_index LIMIT 1000""", {"best": _BEST, "facts": _FACTS, "pairs": _PAIRS}))
def first_pair_examples(fx: Fixtures) -> DataFrame:
    fx.number_lines()
    return choices.pair_rows(labelled(fx), 4, max_examples=1000, with_prompt=False).select("fen", "pair_index", "target_move")


# Comparisons --------------------------------------------------------------------------

_INDEXED = "SELECT *, row_number() OVER (ORDER BY position_seq) - 1 AS choice_index FROM choices"
_COMPARISONS = """
SELECT choice_index, fen, side_to_move, target_move AS source_choice_move, candidate_count AS source_choice_candidate_count,
  row_number() OVER (PARTITION BY choice_index ORDER BY i, j) - 1 AS pair_index, cands[i] AS l, cands[j] AS r, ucis
FROM indexed, LATERAL (SELECT unnest(range(1, candidate_count + 1)) AS i) a, LATERAL (SELECT unnest(range(i + 1, candidate_count + 1)) AS j) b"""
COMPARISON_CTES = {**CHOICE_CTES, "indexed": _INDEXED, "comparisons": _COMPARISONS}


def indexed_choices(fx: Fixtures) -> DataFrame:
    """Choice rows numbered in input order; written once, as their users read them more than once. What follows from the
    position and its list is not exchanged and written with them."""
    rows = choice_set(fx).select("fen", "side_to_move", "position_seq", "candidates", "move", "target_prompt_index")
    indexed = written(fx, dense_index(written(fx, rows, "choices"), "position_seq", "choice_index"), "indexed")
    return indexed.withColumns({
        "fen_before": F.col("fen"), "split": labels.position_split(F.col("fen")), "candidate_count": F.size("candidates")})


@query("comparison_rows", labelled_sql("""
SELECT choice_index AS pair_source_choice_index, CAST(pair_index AS INT) AS pair_index, fen, source_choice_move, source_choice_candidate_count,
  l.uci || ',' || r.uci AS pair_moves, CASE WHEN lb THEN l.uci ELSE r.uci END AS target_move,
  CASE WHEN hl <= hr THEN l.uci || ',' || r.uci ELSE r.uci || ',' || l.uci END AS shown,
  CAST(CASE WHEN (hl <= hr) = lb THEN 1 ELSE 2 END AS INT) AS target_prompt_index
FROM (SELECT *, (l.k1, l.k2, l.k3) >= (r.k1, r.k2, r.k3) AS lb, sha256(choice_index || '|' || pair_index || '|' || l.uci) AS hl,
        sha256(choice_index || '|' || pair_index || '|' || r.uci) AS hr FROM comparisons) x""", COMPARISON_CTES))
def comparison_rows(fx: Fixtures) -> DataFrame:
    return choices.comparison_rows(indexed_choices(fx), with_prompt=False).select(
        "pair_source_choice_index", "pair_index", "fen", "source_choice_move", "source_choice_candidate_count",
        F.array_join("pair_moves", ",").alias("pair_moves"), "target_move", F.array_join("candidates.uci", ",").alias("shown"),
        "target_prompt_index")


@query("first_comparison_rows", labelled_sql("""
SELECT choice_index AS pair_source_choice_index, CAST(pair_index AS INT) AS pair_index, l.uci || ',' || r.uci AS pair_moves
FROM comparisons WHERE choice_index < 700 ORDER BY choice_index, pair_index LIMIT 1500""", COMPARISON_CTES))
def first_comparison_rows(fx: Fixtures) -> DataFrame:
    return choices.comparison_rows(indexed_choices(fx), max_choice_rows=700, max_pair_rows=1500, with_prompt=False).select(
        "pair_source_choice_index", "pair_index", F.array_join("pair_moves", ",").alias("pair_moves"))


@query("pairwise_prompts", labelled_sql("""
SELECT choice_index AS pair_source_choice_index, CAST(pair_index AS INT) AS pair_index, sha256(
  'You are a chess move safety comparator.' || chr(10) || chr(10) || 'Position:' || chr(10) || 'FEN: ' || fen || chr(10) || 'Side to move: ' || side_to_move ||
  chr(10) || chr(10) || 'Candidate moves:' || chr(10) || '1. ' || a.uci || ' (' || a.san || ')' || chr(10) || '2. ' || b.uci || ' (' || b.san || ')' ||
  chr(10) || chr(10) || 'Choose the safer move from the two candidates.' || chr(10) || 'Return JSON only:' || chr(10) || '{"move":"<uci>"}') AS prompt_hash
FROM (SELECT *, CASE WHEN hl <= hr THEN l ELSE r END AS a, CASE WHEN hl <= hr THEN r ELSE l END AS b FROM (
  SELECT *, sha256(choice_index || '|' || pair_index || '|' || l.uci) AS hl, sha256(choice_index || '|' || pair_index || '|' || r.uci) AS hr
  FROM comparisons) x) y""", COMPARISON_CTES))
def pairwise_prompts(fx: Fixtures) -> DataFrame:
    return choices.comparison_rows(indexed_choices(fx)).select(
        "pair_source_choice_index", "pair_index", F.sha2("prompt", 256).alias("prompt_hash"))


@query("comparison_counts", labelled_sql("""
SELECT 'choice_rows_seen' AS metric, '' AS key, count(*) AS n FROM indexed
UNION ALL SELECT 'choice_rows_written', '', count(*) FROM indexed
UNION ALL SELECT 'skipped_too_few_candidates', '', 0
UNION ALL SELECT 'pair_rows_written', '', count(*) FROM comparisons
UNION ALL SELECT 'by_split', CASE CAST('0x' || substr(sha256(fen), 1, 2) AS INT) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END, count(*)
  FROM indexed GROUP BY 2
UNION ALL SELECT 'by_choice_candidate_count', candidate_count::VARCHAR, count(*) FROM indexed GROUP BY 2
UNION ALL SELECT 'by_pair_target_prompt_index', CASE WHEN (hl <= hr) = ((l.k1, l.k2, l.k3) >= (r.k1, r.k2, r.k3)) THEN '1' ELSE '2' END, count(*) FROM (
  SELECT *, sha256(choice_index || '|' || pair_index || '|' || l.uci) AS hl, sha256(choice_index || '|' || pair_index || '|' || r.uci) AS hr FROM comparisons) x
  GROUP BY 2""", COMPARISON_CTES))
def comparison_counts(fx: Fixtures) -> DataFrame:
    rows = indexed_choices(fx)
    return choices.comparison_counts(rows, choices.comparison_rows(rows, with_prompt=False))
