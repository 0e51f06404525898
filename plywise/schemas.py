"""Table and record schemas, as Spark DDL. Reads use them; nothing is inferred."""

from __future__ import annotations


# Relational store -----------------------------------------------------------------
TABLES: dict[str, str] = {
    "models": "id BIGINT, provider STRING, name STRING, family STRING, param_size STRING, "
    "modality STRING, is_local BOOLEAN, notes STRING",
    "model_snapshots": "id BIGINT, model_id BIGINT, ollama_digest STRING, quantization STRING, "
    "context_window INT, sampler_params STRING, runtime_version STRING, created_at TIMESTAMP",
    "prompts": "id BIGINT, version STRING, template_hash STRING, mode STRING, legality_mode STRING, notes STRING",
    "opening_suites": "id BIGINT, name STRING, version STRING, notes STRING",
    "opening_lines": "id BIGINT, suite_id BIGINT, eco STRING, name STRING, start_fen STRING, "
    "move_sequence STRING, intended_ply_start INT, pairing_id STRING",
    "benchmark_runs": "id BIGINT, name STRING, config_hash STRING, git_commit STRING, hardware_label STRING, "
    "seed INT, stockfish_version STRING, stockfish_options STRING, prompt_id BIGINT, "
    "opening_suite_id BIGINT, created_at TIMESTAMP",
    "run_participants": "id BIGINT, run_id BIGINT, model_snapshot_id BIGINT, opponent_type STRING, "
    "stockfish_skill INT, uci_limit_strength BOOLEAN, target_elo INT, color_policy STRING, display_name STRING",
    "games": "id BIGINT, run_id BIGINT, white_participant_id BIGINT, black_participant_id BIGINT, "
    "opening_line_id BIGINT, result STRING, termination_reason STRING, final_fen STRING, pgn STRING, "
    "started_at TIMESTAMP, ended_at TIMESTAMP",
    "moves": "id BIGINT, game_id BIGINT, ply INT, color STRING, fen_before STRING, fen_after STRING, "
    "accepted_uci STRING, accepted_san STRING, legal_move_count INT, move_source STRING, "
    "retries_used INT, latency_total_ms DOUBLE",
    "attempts": "id BIGINT, move_id BIGINT, game_id BIGINT, ply INT, attempt_number INT, prompt_id BIGINT, "
    "raw_prompt_hash STRING, raw_prompt STRING, raw_response STRING, parsed_move STRING, parse_ok BOOLEAN, "
    "legal_ok BOOLEAN, error_type STRING, feedback_given STRING, latency_ms DOUBLE, thinking STRING, "
    "thinking_used BOOLEAN, reranker_metadata STRING",
    "token_usage": "attempt_id BIGINT, prompt_tokens INT, completion_tokens INT, total_tokens INT, "
    "estimated_context_window INT, estimated_context_remaining INT, truncation_applied BOOLEAN, cost_usd DOUBLE",
    "engine_evaluations": "id BIGINT, move_id BIGINT, engine_name STRING, engine_version STRING, nodes INT, "
    "depth_reached INT, eval_before_cp INT, eval_after_cp INT, mate_before INT, mate_after INT, "
    "best_move_uci STRING, centipawn_loss INT, classification STRING",
    "move_annotations": "id BIGINT, move_id BIGINT, prompt_id BIGINT, persona STRING, commentary STRING, "
    "raw_prompt_hash STRING, raw_prompt STRING, raw_response STRING, created_at TIMESTAMP",
    "operational_events": "id BIGINT, run_id BIGINT, event_kind STRING, severity STRING, message STRING, "
    "payload STRING, created_at TIMESTAMP",
}

# The id column of these tables is renamed on scan so that joins read naturally.
ID_COLUMNS: dict[str, str] = {
    "models": "model_id",
    "model_snapshots": "model_snapshot_id",
    "prompts": "prompt_id",
    "opening_suites": "opening_suite_id",
    "opening_lines": "opening_line_id",
    "benchmark_runs": "run_id",
    "run_participants": "participant_id",
    "games": "game_id",
    "moves": "move_id",
    "attempts": "attempt_id",
    "engine_evaluations": "evaluation_id",
    "move_annotations": "annotation_id",
    "operational_events": "event_id",
}

# Record sets ----------------------------------------------------------------------
CANDIDATE = (
    "STRUCT<uci: STRING, san: STRING, source: STRING, risk: STRING, score: INT, "
    "centipawn_loss: INT, candidate_rank_in_generator: INT>"
)
CANDIDATE_ROW = (
    "prompt STRING, completion STRING, fen_before STRING, side_to_move STRING, candidate_uci STRING, "
    "candidate_san STRING, fen_after STRING, source STRING, split STRING, legal_move_count INT, "
    "candidate_rank_in_generator INT, generator_idea STRING, source_run_id BIGINT, source_game_id BIGINT, "
    "source_move_id BIGINT, source_attempt_id BIGINT, stockfish_best_uci STRING, centipawn_loss INT, "
    "classification STRING, risk STRING, score INT, reason_type STRING, target STRING"
)
CHOICE_ROW = (
    "prompt STRING, completion STRING, fen STRING, move STRING, fen_before STRING, side_to_move STRING, "
    f"split STRING, candidate_count INT, candidates ARRAY<{CANDIDATE}>, target_move STRING, target_san STRING, "
    "target_prompt_index INT, target_risk STRING, target_score INT, target_centipawn_loss INT"
)
PAIR_ROW = CHOICE_ROW + ", pair_risks STRING, pair_cpl_gap INT"
COMPARISON_ROW = (
    CHOICE_ROW + ", pair_source_choice_index BIGINT, pair_index INT, pair_moves ARRAY<STRING>, "
    "source_choice_move STRING, source_choice_candidate_count INT"
)
PREDICTION = (
    "fen STRING, target_move STRING, raw_response STRING, parsed_move STRING, parse_ok BOOLEAN, "
    "legal_ok BOOLEAN, top1_match BOOLEAN, reward DOUBLE, centipawn_loss INT, best_move_uci STRING, "
    "classification STRING, service_error BOOLEAN"
)
SUPERVISED_EXAMPLE = (
    "prompt STRING, completion STRING, move STRING, san STRING, fen STRING, prompt_version STRING, "
    "prompt_template_hash STRING, legality_mode STRING, split STRING, game_id STRING, source_game_index BIGINT, "
    "ply INT, source STRUCT<event: STRING, site: STRING, date: STRING, round: STRING, white: STRING, "
    "black: STRING, white_elo: STRING, black_elo: STRING, time_control: STRING, termination: STRING>"
)
EXTERNAL_CANDIDATE = (
    "fen_before STRING, fen STRING, candidate_uci STRING, uci STRING, move STRING, source STRING, "
    "candidate_rank_in_generator STRING, generator_idea STRING"
)
ENGINE_RECORD = (
    "STRUCT<engine_name: STRING, engine_version: STRING, nodes: INT, depth_reached: INT, eval_before_cp: INT, "
    "eval_after_cp: INT, mate_before: INT, mate_after: INT, best_move_uci: STRING, centipawn_loss: INT, "
    "classification: STRING>"
)
EVALUATION_CACHE = f"key STRING, fen_before STRING, candidate_uci STRING, evaluation {ENGINE_RECORD}"


def table_schema(name: str) -> str:
    """DDL of one store table."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return TABLES[name]
