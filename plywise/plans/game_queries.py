"""Timelines, histories, reports and schedules on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions import prompts, text
from plywise.operators import games as ops
from plywise.operators.candidates import move_list_texts
from plywise.plans.board_queries import evaluations
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.registry import query, rounded
from plywise.plans.sqltext import judged_sql


@query("game_timeline", judged_sql(["moves", "annotations", "attempts", "token_usage"], """
SELECT m.move_id, m.game_id, m.ply, e.evals, n.notes, t.tries FROM moves m
LEFT JOIN (SELECT move_id, string_agg(classification || ':' || coalesce(centipawn_loss::VARCHAR, '-'), ';' ORDER BY evaluation_id) AS evals
           FROM evaluations GROUP BY 1) e USING (move_id)
LEFT JOIN (SELECT move_id, string_agg(persona || '=' || commentary, ';' ORDER BY annotation_id) AS notes FROM annotations GROUP BY 1) n USING (move_id)
LEFT JOIN (SELECT move_id, string_agg(attempt_number || ':' || coalesce(total_tokens::VARCHAR, '-'), ';' ORDER BY attempt_number) AS tries
           FROM attempts LEFT JOIN token_usage USING (attempt_id) WHERE move_id IS NOT NULL GROUP BY 1) t USING (move_id)"""))
def game_timeline(fx: Fixtures) -> DataFrame:
    moves = fx.moves.select("move_id", "game_id", "ply")
    full = ops.timeline(moves, evaluations(fx), fx.annotations, fx.attempts, fx.token_usage)
    or_dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    listed = lambda name, f: F.when(F.col(name).isNotNull(), F.array_join(F.transform(name, f), ";"))
    return full.select(
        "move_id", "game_id", "ply",
        listed("engine_evaluations", lambda e: F.concat_ws(":", e["classification"], or_dash(e["centipawn_loss"]))).alias("evals"),
        listed("annotations", lambda a: F.concat_ws("=", a["persona"], a["commentary"])).alias("notes"),
        listed("attempts", lambda a: F.concat_ws(":", a["attempt_number"].cast("string"), or_dash(a["total_tokens"]))).alias("tries"),
    )


@query("game_runtime_stats", with_views(["moves", "attempts", "token_usage"], """
SELECT game_id, color, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, CAST(sum(retries_used) AS BIGINT) AS retries,
  CAST(coalesce(sum(invalid), 0) AS BIGINT) AS invalid_attempts, CAST(arg_max(tokens, ply) FILTER (tokens IS NOT NULL) AS INT) AS last_usage,
  round(avg(latency_total_ms), 6) AS average_latency_ms
FROM moves LEFT JOIN (SELECT move_id, sum(total_tokens) AS tokens, count(*) FILTER (NOT legal_ok) AS invalid
  FROM attempts LEFT JOIN token_usage USING (attempt_id) WHERE move_id IS NOT NULL GROUP BY 1) t USING (move_id)
GROUP BY 1, 2"""))
def game_runtime_stats(fx: Fixtures) -> DataFrame:
    return rounded(ops.runtime_stats(fx.moves, fx.attempts, fx.token_usage))


@query("move_pairs", with_views(["moves"], """
SELECT game_id, CAST(ceil(ply / 2.0) AS INT) AS number, max(CASE WHEN color = 'white' THEN accepted_san END) AS white,
  max(CASE WHEN color = 'black' THEN accepted_san END) AS black FROM moves GROUP BY 1, 2"""))
def move_pairs(fx: Fixtures) -> DataFrame:
    return ops.move_pairs(fx.moves)


@query("evaluation_series", judged_sql(["moves"], """
SELECT game_id, ply, accepted_san AS label, eval_after_cp AS "after", centipawn_loss AS cpl
FROM moves JOIN evaluations USING (move_id) WHERE eval_after_cp IS NOT NULL OR centipawn_loss IS NOT NULL"""))
def evaluation_series(fx: Fixtures) -> DataFrame:
    return ops.evaluation_series(fx.moves, evaluations(fx))


@query("player_names", with_views(["games", "participants"], """
SELECT game_id, coalesce(w.display_name, 'W' || white_participant_id) AS white_player,
  coalesce(b.display_name, CASE WHEN game_id % 100 <> 0 THEN 'B' || substr(final_fen, 5) END) AS black_player
FROM games LEFT JOIN participants w ON w.participant_id = white_participant_id
LEFT JOIN participants b ON b.participant_id = black_participant_id"""))
def player_names(fx: Fixtures) -> DataFrame:
    return ops.player_names(fx.games, fx.participants).select("game_id", "white_player", "black_player")


@query("first_prompts", with_views(["attempts"], """
SELECT move_id, arg_min(raw_prompt, attempt_number) AS prompt FROM attempts
WHERE move_id IS NOT NULL AND raw_prompt IS NOT NULL GROUP BY move_id"""))
def first_prompts(fx: Fixtures) -> DataFrame:
    return ops.first_prompts(fx.attempts)


_REPORT = """
SELECT g.game_id, '# Match Report — game ' || g.game_id || chr(10) || chr(10) || 'Result: ' || result || chr(10) ||
  'Termination: ' || termination_reason || chr(10) || 'Final FEN: `' || final_fen || '`' || chr(10) || chr(10) || '## PGN' ||
  chr(10) || chr(10) || '```pgn' || chr(10) || pgn || chr(10) || '```' || chr(10) || chr(10) || '## Move Timeline' || chr(10) ||
  chr(10) || '| Ply | Move | Eval | CPL | Retries | Latency | Commentary |' || chr(10) ||
  '| ---: | --- | --- | ---: | ---: | ---: | --- |' || coalesce(body, '') || chr(10) AS report
FROM games g LEFT JOIN (
  SELECT game_id, string_agg(chr(10) || '| ' || ply || ' | ' || accepted_san || ' `' || accepted_uci || '` | ' ||
    coalesce(classification, '—') || ' | ' || coalesce(centipawn_loss::VARCHAR, '—') || ' | ' || retries_used || ' | ' ||
    tenths || ' ms | ' || coalesce(notes, '—') || ' |', '' ORDER BY ply) AS body
  FROM (SELECT *, printf('%d.%d', CAST(cents // 100 AS BIGINT), CAST((cents % 100 + 5) // 10 AS BIGINT) % 10) AS t0,
          CAST((cents + 5) // 100 AS BIGINT) || '.' || CAST((cents + 5) % 100 // 10 AS BIGINT) AS tenths
        FROM (SELECT *, CAST(round(latency_total_ms * 100) AS BIGINT) AS cents FROM moves) c) m
  LEFT JOIN (SELECT move_id, classification, centipawn_loss FROM evaluations) e USING (move_id)
  LEFT JOIN (SELECT move_id, string_agg('**' || persona || ':** ' || commentary, '<br>' ORDER BY annotation_id) AS notes
             FROM annotations GROUP BY 1) n USING (move_id)
  GROUP BY 1) b USING (game_id)"""


@query("match_reports", judged_sql(["games", "moves", "annotations"], _REPORT))
def match_reports(fx: Fixtures) -> DataFrame:
    return ops.match_reports(fx.games, fx.moves, evaluations(fx), fx.annotations)


@query("annotation_backlog", judged_sql(["moves", "annotations"], """
SELECT m.move_id, coalesce(classification, 'not evaluated') AS evaluation_label, sha256(
  'Annotate an already-scored strict chess move.' || chr(10) || 'Do not propose a different move.' || chr(10) ||
  'Persona: aggressive.' || chr(10) || 'FEN before move: ' || fen_before || chr(10) || 'Accepted move: ' || accepted_san || ' / ' ||
  accepted_uci || chr(10) || 'Engine classification: ' || coalesce(classification, 'not evaluated') || chr(10) ||
  'Return concise commentary for a match report.') AS raw_prompt_hash
FROM moves m LEFT JOIN (SELECT move_id, classification FROM evaluations) e USING (move_id)
WHERE m.move_id NOT IN (SELECT move_id FROM annotations WHERE persona = 'aggressive')"""))
def annotation_backlog(fx: Fixtures) -> DataFrame:
    todo = ops.annotation_backlog(fx.moves, fx.annotations, evaluations(fx), "aggressive")
    return todo.select("move_id", "evaluation_label", "raw_prompt_hash")


_MATCHES = """
SELECT s_suppkey AS run_id, CAST(s_nationkey % 5 AS BIGINT) AS suite_id, s_name AS competitor_a,
  'N' || CAST(s_nationkey AS STRING) AS competitor_b,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 23 - 1 AS INT) END AS game_count FROM supplier"""


@query("opening_schedule", with_views(["opening_lines"], """
SELECT run_id, CAST(game_no AS INT) AS game_no, l.name AS opening,
  CASE WHEN slot % 2 = 1 THEN competitor_b ELSE competitor_a END AS white,
  CASE WHEN slot % 2 = 1 THEN competitor_a ELSE competitor_b END AS black
FROM (SELECT m.*, g.game_no, g.game_no % (2 * n) AS slot FROM matches m JOIN (SELECT suite_id, count(*) AS n FROM opening_lines GROUP BY 1) z USING (suite_id),
        LATERAL (SELECT unnest(range(coalesce(m.game_count, 2 * z.n))) AS game_no) g) x
JOIN opening_lines l ON l.suite_id = x.suite_id AND l.line_ord = slot // 2""", extra={"matches": _MATCHES}))
def opening_schedule(fx: Fixtures) -> DataFrame:
    matches = fx.supplier.select(
        F.col("s_suppkey").alias("run_id"), F.pmod("s_nationkey", F.lit(5)).cast("long").alias("suite_id"),
        F.col("s_name").alias("competitor_a"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("competitor_b"),
        F.when(F.pmod("s_suppkey", F.lit(4)) != 0, (F.pmod("s_suppkey", F.lit(23)) - 1).cast("int")).alias("game_count"),
    )
    return ops.opening_schedule(matches, fx.opening_lines)


@query("pair_footprints", with_views(["footprints"], """
SELECT p_partkey, model_a, model_b, total_vram_gb, unknown_models,
  CASE WHEN total_vram_gb > 22.5 THEN 'model_swap_warning' WHEN unknown_models <> '' THEN 'model_footprint_unknown'
       ELSE 'model_pair_fit' END AS event_kind,
  CASE WHEN total_vram_gb > 22.5 THEN 'warning' ELSE 'info' END AS severity
FROM (SELECT p_partkey, p_brand AS model_a, p_type AS model_b, a.vram_gb + b.vram_gb AS total_vram_gb,
        concat_ws(',', CASE WHEN a.vram_gb IS NULL THEN p_brand END, CASE WHEN b.vram_gb IS NULL THEN p_type END) AS unknown_models
      FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE 'Brand#' || (p_size % 30) END AS p_type FROM part) p
      LEFT JOIN footprints a ON a.model = p_brand LEFT JOIN footprints b ON b.model = p_type) x"""))
def pair_footprints(fx: Fixtures) -> DataFrame:
    other = F.when(F.pmod("p_partkey", F.lit(6)) == 0, F.col("p_type")).otherwise(
        F.concat(F.lit("Brand#"), F.pmod("p_size", F.lit(30)).cast("string")))
    pairs = fx.part.select("p_partkey", F.concat(F.lit("reranked:"), "p_brand").alias("competitor_a"), other.alias("competitor_b"))
    return ops.pair_footprints(pairs, fx.footprints, 22.5).select(
        "p_partkey", "model_a", "model_b", "total_vram_gb", F.array_join("unknown_models", ",").alias("unknown_models"),
        "event_kind", "severity")


def _sans(fx: Fixtures) -> DataFrame:
    return fx.moves.select("game_id", "ply", F.col("accepted_san").alias("san"), F.col("accepted_uci").alias("uci"))


_HISTORY = """
SELECT game_id, ply, accepted_san AS san, accepted_uci AS uci,
  coalesce(string_agg(accepted_san, ' ') OVER before, '') AS san_history,
  coalesce(string_agg(accepted_san || '/' || accepted_uci, ', ') OVER own, '') AS own_moves,
  lag(accepted_san || '/' || accepted_uci) OVER (PARTITION BY game_id ORDER BY ply) AS last_opponent_move
FROM moves WINDOW before AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  own AS (PARTITION BY game_id, color ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("move_history", with_views(["moves"], _HISTORY))
def move_history(fx: Fixtures) -> DataFrame:
    return ops.full_history(_sans(fx))


@query("sampled_history", with_views(["moves"], """
SELECT h.* FROM history h JOIN (
  SELECT game_id, n, CASE WHEN n <= 3 THEN range(n) ELSE list_distinct([CAST(round_even(i * (n - 1) / 2.0, 0) AS BIGINT) FOR i IN range(3)]) END AS picks
  FROM (SELECT game_id, count(*) AS n FROM moves GROUP BY 1) c) s USING (game_id)
WHERE list_contains(picks, h.ply - 1)""", extra={"history": _HISTORY}))
def sampled_history(fx: Fixtures) -> DataFrame:
    return ops.sampled_history(_sans(fx), 3)


@query("turn_history", with_views(["turns"], """
SELECT game_id, ply, sha256(san) AS san_hash, sha256(coalesce(string_agg(san, ' ') OVER
  (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history_hash FROM turns"""))
def turn_history(fx: Fixtures) -> DataFrame:
    return ops.full_history(fx.turns.select("game_id", "ply", "san", "uci")).select(
        "game_id", "ply", text.text_hash(F.col("san")).alias("san_hash"), text.text_hash(F.col("san_history")).alias("history_hash"))


@query("retry_features", with_views(["attempts"], """
SELECT attempt_id, game_id, ply, attempt_number, legal_ok, lag(error_type) OVER w AS feedback_error, lag(parsed_move) OVER w AS feedback_move,
  CASE WHEN attempt_number > 1 THEN CAST(4 - attempt_number AS INT) END AS remaining_retries,
  CAST(attempt_number - 1 AS INT) AS failed_before, round(sum(latency_ms) OVER w, 4) AS latency_total_ms
FROM attempts WINDOW w AS (PARTITION BY game_id, ply ORDER BY attempt_number)"""))
def retry_features(fx: Fixtures) -> DataFrame:
    return rounded(ops.retry_features(fx.attempts, 2), 4)


@query("accepted_from_attempts", with_views(["moves"], """
SELECT game_id, ply, retries_used, round(latency_total_ms, 4) AS latency_total_ms FROM moves"""))
def accepted_from_attempts(fx: Fixtures) -> DataFrame:
    return rounded(ops.accepted_from_attempts(fx.attempts), 4)


def _compact_sql(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= 220 THEN {flat} ELSE rtrim(substr({flat}, 1, 219)) || '...' END"


@query("strategy_memory", with_views(["turns"], f"""
SELECT game_id, ply, coalesce(last_value(goal IGNORE NULLS) OVER w, 'Play active legal chess as ' || side ||
    '; develop pieces, keep the king safe, and improve the position.') AS objective,
  'Identify direct checks, captures, and attacks before choosing a move.' AS opponent_threats,
  'Develop undeveloped minor pieces and coordinate queen, rooks, and king safety.' AS pieces_to_improve,
  coalesce(last_value(shun IGNORE NULLS) OVER w,
    'Avoid moving the same piece repeatedly, exposing the king, or repeating positions without purpose.') AS avoid,
  coalesce(last_value(reason) OVER w, '(none)') AS last_rationale
FROM (SELECT game_id, ply, CASE WHEN ply % 2 = 1 THEN 'white' ELSE 'black' END AS side,
        CASE WHEN ply % 3 <> 0 THEN {_compact_sql('san')} END AS goal,
        CASE WHEN ply % 4 = 1 THEN {_compact_sql("'not ' || san")} END AS shun,
        CASE WHEN ply % 5 <> 0 THEN {_compact_sql("'m' || ply || '/' || uci || ': ' || san")}
             ELSE 'm' || ply || '/' || uci || ': no rationale returned' END AS reason FROM turns) t
WINDOW w AS (PARTITION BY game_id, side ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def strategy_memory(fx: Fixtures) -> DataFrame:
    ply = F.col("ply")
    updates = fx.turns.select(
        "game_id", "ply", F.concat(F.lit("m"), ply.cast("string")).alias("san"), "uci",
        F.when(ply % 5 != 0, F.col("san")).alias("rationale"),
        F.when(ply % 3 != 0, F.col("san")).otherwise("  ").alias("objective"),
        F.lit(None).cast("string").alias("opponent_threats"), F.lit(None).cast("string").alias("pieces_to_improve"),
        F.when(ply % 4 == 1, F.concat(F.lit("not "), "san")).alias("avoid"),
    )
    return ops.strategy_memory(updates)


@query("proposal_totals", with_views(["attempts", "token_usage"], """
SELECT game_id * 100 + ply AS request_id, CAST(sum(total_tokens) AS BIGINT) AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, string_agg(raw_prompt, chr(10) || chr(10) ORDER BY attempt_number) AS thinking,
  bool_or(NOT legal_ok) AS thinking_used
FROM attempts LEFT JOIN token_usage USING (attempt_id) GROUP BY 1"""))
def proposal_totals(fx: Fixtures) -> DataFrame:
    rows = fx.attempts.join(fx.token_usage, "attempt_id", "left").select(
        (F.col("game_id") * 100 + F.col("ply")).alias("request_id"), F.col("attempt_number").alias("seq"),
        F.col("total_tokens").alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), "total_tokens",
        F.col("raw_prompt").alias("thinking"), (~F.col("legal_ok")).alias("thinking_used"),
    )
    return ops.proposal_totals(rows)


def _strict_sql(constrained: bool) -> str:
    lines = [line.replace("{{", "{").replace("}}", "}") for line in (
        *prompts.STRICT_HEAD, prompts.STRICT_SHAPE, prompts.STRICT_NOTATION)]
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    parts = [quote(x) for x in lines]
    parts += ["'Side to move: ' || color || '.'", "'Current FEN: ' || fen_before",
              "'SAN history: ' || CASE WHEN san_history = '' THEN '(start position)' ELSE san_history END",
              "'Your prior moves: ' || CASE WHEN own_moves = '' THEN '(none)' ELSE own_moves END",
              "'Last opponent move: ' || coalesce(last_opponent_move, '(none)')"]
    if constrained:
        parts += [quote(x) for x in prompts.STRICT_LEGAL[:3]]
        parts += ["'Legal moves (UCI): ' || coalesce(legal, '')"]
    return " || chr(10) || ".join(parts)


_LEGAL_LISTS = "SELECT fen, string_agg(uci, ', ' ORDER BY uci) AS legal FROM legal_moves GROUP BY 1"


@query("strict_prompts", with_views(["moves", "legal_moves"], f"""
SELECT move_id, sha256(CASE WHEN l_linestatus = 'O' THEN {_strict_sql(True)} ELSE {_strict_sql(False)} END) AS prompt_hash
FROM moves JOIN history USING (game_id, ply) LEFT JOIN lists ON fen = fen_before""",
    extra={"history": _HISTORY, "lists": _LEGAL_LISTS}))
def strict_prompts(fx: Fixtures) -> DataFrame:
    legal = fx.legal_moves.groupBy(F.col("fen").alias("fen_before")).agg(F.collect_set("uci").alias("legal_moves"))
    rows = fx.moves.join(ops.full_history(_sans(fx)).drop("san", "uci"), ["game_id", "ply"]).join(legal, "fen_before", "left")
    values = {c: F.col(c) for c in ("san_history", "own_moves", "last_opponent_move")}
    values |= {"fen": F.col("fen_before"), "side": F.col("color"), "legal_moves": F.coalesce("legal_moves", F.expr("array()"))}
    make = lambda constrained: prompts.strict_prompt(values, constrained=constrained, board=False)
    text_ = F.when(F.col("l_linestatus") == "O", make(True)).otherwise(make(False))
    return rows.select("move_id", F.sha2(text_, 256).alias("prompt_hash"))


@query("token_estimates", """
SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 3) // 4 END AS INT) AS completion_tokens,
  CAST(CASE WHEN n_chars % 3 = 0 THEN n_chars % 100 ELSE (length(source) + 3) // 4 END AS INT) AS prompt_tokens,
  CAST(CASE WHEN n_chars % 3 = 0 THEN n_chars % 100 ELSE (length(source) + 3) // 4 END + (length(text) + 3) // 4 AS INT) AS total_tokens,
  CAST(greatest(8192 - (CASE WHEN n_chars % 3 = 0 THEN n_chars % 100 ELSE (length(source) + 3) // 4 END + (length(text) + 3) // 4), 0) AS INT)
    AS estimated_context_remaining
FROM documents""")
def token_estimates(fx: Fixtures) -> DataFrame:
    reported = F.when(F.pmod("n_chars", F.lit(3)) == 0, F.pmod("n_chars", F.lit(100)).cast("int"))
    none = F.lit(None).cast("int")
    used = text.usage(F.col("source"), F.col("text"), F.lit(8192), reported, none, none)
    return fx.documents.select("doc_id", used.alias("u")).select(
        "doc_id", "u.prompt_tokens", "u.completion_tokens", "u.total_tokens", "u.estimated_context_remaining")


@query("compact_texts", f"""
SELECT doc_id, {_compact_sql('text')} AS compacted FROM documents""")
def compact_texts(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", text.compact(F.col("text")).alias("compacted"))


@query("assistant_texts", """
SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS completion FROM conversations GROUP BY 1""")
def assistant_texts(fx: Fixtures) -> DataFrame:
    chats = fx.conversations.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")))),
                    lambda t: t["m"]).alias("messages"))
    return chats.select("conv_id", text.assistant_text(F.col("messages")).alias("completion"))


@query("legal_move_lists", with_views(["legal_moves"], """
SELECT fen, CASE WHEN n > 4 THEN array_to_string(moves[1:4], ', ') || ' ... (' || (n - 4) || ' more)'
  ELSE array_to_string(moves, ', ') END AS listed
FROM (SELECT fen, list(uci ORDER BY uci) AS moves, count(*) AS n FROM legal_moves GROUP BY 1) x"""))
def legal_move_lists(fx: Fixtures) -> DataFrame:
    return move_list_texts(fx.legal_moves, 4)


def _template_sql(lines: list[str], values: dict[str, str]) -> str:
    """The template as an SQL concatenation, its placeholders replaced by expressions."""
    text_ = chr(10).join(lines)
    for name, expression in values.items():
        text_ = text_.replace("{" + name + "}", "\x01" + expression + "\x01")
    text_ = text_.replace("{{", "{").replace("}}", "}")
    parts = text_.split("\x01")
    return " || ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


_DELIBERATION = {
    "fen": "fen_before", "side_to_move": "color", "san_history": "CASE WHEN san_history = '' THEN '(none)' ELSE san_history END",
    "legal_moves": "coalesce(legal, '')", "candidate_uci": "accepted_uci", "candidate_san": "accepted_san", "candidate_idea": "'none'",
    "fen_after": "fen_before || '+'", "opponent_side": "CASE color WHEN 'white' THEN 'black' ELSE 'white' END",
    "opponent_legal_replies": "coalesce(legal, '')", "n_candidates": "'5'", "candidate_moves": "accepted_uci", "candidate_table": "'{}'",
}


@query("deliberation_prompts", with_views(["moves", "legal_moves"], f"""
SELECT move_id, sha256({_template_sql(prompts.candidate_template(board=False), _DELIBERATION)}) AS candidates,
  sha256({_template_sql(prompts.REVISE, _DELIBERATION)}) AS revise, sha256({_template_sql(prompts.REFUTE, _DELIBERATION)}) AS refute,
  sha256({_template_sql(prompts.FINAL, _DELIBERATION)}) AS final
FROM moves JOIN history USING (game_id, ply) LEFT JOIN lists ON fen = fen_before""", extra={"history": _HISTORY, "lists": _LEGAL_LISTS}))
def deliberation_prompts(fx: Fixtures) -> DataFrame:
    legal = fx.legal_moves.groupBy(F.col("fen").alias("fen_before")).agg(F.collect_set("uci").alias("legal"))
    rows = fx.moves.join(ops.full_history(_sans(fx)).drop("san", "uci"), ["game_id", "ply"]).join(legal, "fen_before", "left")
    listed = text.listed(F.coalesce("legal", F.expr("CAST(array() AS ARRAY<STRING>)")))
    values = {
        "fen": F.col("fen_before"), "side_to_move": F.col("color"), "san_history": prompts.or_none(F.col("san_history")),
        "legal_moves": listed, "opponent_legal_replies": listed, "candidate_uci": F.col("accepted_uci"), "candidate_san": F.col("accepted_san"),
        "candidate_idea": F.lit("none"), "fen_after": F.concat("fen_before", F.lit("+")),
        "opponent_side": F.when(F.col("color") == "white", "black").otherwise("white"), "n_candidates": F.lit(5),
        "candidate_moves": F.col("accepted_uci"), "candidate_table": F.lit("{}"),
    }
    hashed = lambda lines, name: F.sha2(prompts.render(lines, values), 256).alias(name)
    return rows.select("move_id", hashed(prompts.candidate_template(board=False), "candidates"), hashed(prompts.REVISE, "revise"),
                       hashed(prompts.REFUTE, "refute"), hashed(prompts.FINAL, "final"))


# The whole wording of the prompt with memory, repetition and feedback, written out once more for the check.
_RETRY_WORDING = """You are playing a competitive chess game and your goal is to win.
Win by checkmating the opponent's king; if a win is out of reach, play for a draw rather than a loss.
Among the legal moves, choose the strongest one: develop your pieces, fight for the center, keep your own king safe, and never give away material for free.
Before committing, look for checks, captures and threats — both your own tactical chances and the opponent's threats against you.
Return only strict JSON in this exact shape: {{"move":"e2e4","rationale":"short reason","strategy_update":{{"objective":"short updated plan"}}}}.
The move value must be UCI coordinate notation, e.g. e2e4, g1f3, e1g1, e7e8q. Do not use SAN moves like e4, Nf3, O-O, or Qxc4.
Side to move: {side}.
Current FEN: {fen}
SAN history: {san_history}
Your prior moves: {own_moves}
Last opponent move: {last_opponent_move}
ASCII board:
{ascii_board}
Your private strategic memory:
- Objective: {objective}
- Opponent threats: {opponent_threats}
- Pieces to improve: {pieces_to_improve}
- Avoid: {avoid}
- Last own move rationale: {last_rationale}
Update this memory after choosing a move. Keep each field short and concrete.
Repetition warning: {repetition_warning}
Choose exactly one move from this legal move list.
Your move must exactly match one listed UCI move.
If strategic memory conflicts with the legal move list, ignore the memory.
Legal moves (UCI): {legal_moves}
Your previous response was invalid.
Do not repeat this attempted move: {attempted_move}.
Choose a different move that exactly appears in the legal move list.
Previous attempt feedback: {feedback}"""
_PLACEMENT = "'r' || (ply % 6 + 1) || 'k/' || (move_id % 7 + 1) || 'pP/8'"
_RETRY = {
    "side": "color", "fen": f"{_PLACEMENT} || CASE color WHEN 'white' THEN ' w - - 0 1' ELSE ' b - - 0 1' END",
    "san_history": "CASE WHEN san_history = '' THEN '(start position)' ELSE san_history END",
    "own_moves": "CASE WHEN own_moves = '' THEN '(none)' ELSE own_moves END", "last_opponent_move": "coalesce(last_opponent_move, '(none)')",
    "ascii_board": "replace(array_to_string(string_split(list_reduce(range(1, 9), lambda t, k: replace(t, k::VARCHAR, repeat('.', k)), "
                   + _PLACEMENT + "), ''), ' '), ' / ', chr(10))",
    "objective": "'plan ' || ply", "opponent_threats": "accepted_san", "pieces_to_improve": "'knight'", "avoid": "'(none)'",
    "last_rationale": "coalesce(last_opponent_move, '-')", "repetition_warning": "'seen ' || ply % 3 || ' times'", "legal_moves": "coalesce(legal, '')",
    "attempted_move": "CASE WHEN ply % 4 = 0 THEN '(none)' ELSE accepted_uci END",
    "feedback": "concat('{', chr(39), 'error', chr(39), ': ', chr(39), 'illegal_move', chr(39), ', ', chr(39), 'attempted_move', chr(39), ': ', "
                "CASE WHEN ply % 4 = 0 THEN 'None' ELSE concat(chr(39), accepted_uci, chr(39)) END, ', ', chr(39), 'reason', chr(39), ': ', chr(34), 'it', chr(39), 's not legal', "
                "chr(34), ', ', chr(39), 'legal_moves', chr(39), ': [', coalesce(quoted, ''), '], ', chr(39), 'remaining_retries', chr(39), ': ', ply % 3, '}')",
}


def _retry_sql() -> str:
    text_, parts = _RETRY_WORDING, []
    while "{" in text_.replace("{{", "  "):
        at = text_.replace("{{", "  ").index("{")
        end = text_.index("}", at)
        parts += [text_[:at], _RETRY[text_[at + 1 : end]]]
        text_ = text_[end + 1 :]
    parts.append(text_)
    literal = lambda t: "'" + t.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'"
    return " || ".join(f"({p})" if i % 2 else literal(p) for i, p in enumerate(parts))


@query("retry_prompts", with_views(["moves", "legal_moves"], f"""
SELECT move_id, sha256({_retry_sql()}) AS prompt_hash, sha256('{_RETRY_WORDING.replace("{{", "{").replace("}}", "}").replace("'", "''")}') AS template_hash
FROM moves JOIN history USING (game_id, ply) LEFT JOIN lists ON fen = fen_before""",
    extra={"history": _HISTORY, "lists": """
SELECT fen, string_agg(uci, ', ' ORDER BY uci) AS legal, string_agg(chr(39) || uci || chr(39), ', ' ORDER BY uci) AS quoted FROM legal_moves GROUP BY 1"""}))
def retry_prompts(fx: Fixtures) -> DataFrame:
    """The prompt after a rejected answer, with board, memory and a repetition warning, and the hash of its template."""
    legal = fx.legal_moves.groupBy(F.col("fen").alias("fen_before")).agg(F.collect_set("uci").alias("legal"))
    rows = fx.moves.join(ops.full_history(_sans(fx)).drop("san", "uci"), ["game_id", "ply"]).join(legal, "fen_before", "left")
    rows = rows.withColumn("legal", F.coalesce("legal", F.expr("CAST(array() AS ARRAY<STRING>)")))
    ply = F.col("ply")
    digit = lambda c: c.cast("string")
    placement = F.concat(F.lit("r"), digit(ply % 6 + 1), F.lit("k/"), digit(F.col("move_id") % 7 + 1), F.lit("pP/8"))
    attempted = F.when(ply % 4 != 0, F.col("accepted_uci"))
    values = {c: F.col(c) for c in ("san_history", "own_moves", "last_opponent_move")} | {
        "side": F.col("color"), "fen": F.concat(placement, F.when(F.col("color") == "white", " w - - 0 1").otherwise(" b - - 0 1")),
        "objective": F.concat(F.lit("plan "), digit(ply)), "opponent_threats": F.col("accepted_san"), "pieces_to_improve": F.lit("knight"), "avoid": F.lit("(none)"),
        "last_rationale": F.coalesce("last_opponent_move", F.lit("-")), "repetition_warning": F.concat(F.lit("seen "), digit(ply % 3), F.lit(" times")),
        "legal_moves": F.col("legal"), "attempted_move": attempted,
        "feedback": prompts.feedback_text(F.lit("illegal_move"), attempted, F.lit("it's not legal"), F.col("legal"), ply % 3),
    }
    options = {"constrained": False, "feedback": True, "memory": True, "repetition": True}
    return rows.select("move_id", F.sha2(prompts.strict_prompt(values, **options), 256).alias("prompt_hash"),
                       F.lit(prompts.skeleton_hash(prompts.strict_template(**options))).alias("template_hash"))
