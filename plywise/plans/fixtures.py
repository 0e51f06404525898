"""Projections of the supplied tables into the engine's schemas, as SQL that both Spark and the
check database run. A projection reads its whole source table; evaluations, legal moves and footprints leave
rows out, so that look-ups also miss."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from plywise.session import shared_dir

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# How a move with r retries becomes r + 1 attempts, in each dialect.
_ATTEMPTS = {
    "spark": "LATERAL VIEW explode(sequence(1, m.retries_used + 1)) k AS n",
    "duckdb": ", unnest(range(1, m.retries_used + 2)) AS k(n)",
}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ply
FROM lineitem"""),
    "participants": ((), """
SELECT c_custkey AS participant_id, CAST((c_custkey - c_custkey % 2) % 50 AS BIGINT) AS run_id,
       CASE WHEN c_custkey % 10 < 2 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS model_snapshot_id,
       CASE c_custkey % 10 WHEN 0 THEN 'stockfish' WHEN 1 THEN 'random' ELSE 'model' END AS opponent_type,
       CASE WHEN c_custkey % 10 = 9 AND c_mktsegment = 'BUILDING' THEN 'gemma4:12b'
            ELSE c_mktsegment || '-' || CAST(c_custkey % 10 AS STRING) END AS display_name
FROM customer"""),
    "prompts": ((), """
SELECT CAST(r_regionkey AS BIGINT) AS prompt_id, 'strict' AS mode,
       CASE WHEN r_regionkey % 2 = 0 THEN 'open' ELSE 'constrained' END AS legality_mode
FROM region"""),
    "runs": ((), """
SELECT CAST(n_nationkey * 2 AS BIGINT) AS run_id, n_name AS name,
       CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS prompt_id,
       CAST(n_regionkey AS BIGINT) AS opening_suite_id,
       CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS TIMESTAMP) AS created_at
FROM nation"""),
    "snapshots": ((), """
SELECT CAST(n_nationkey AS BIGINT) AS model_snapshot_id,
       CASE n_nationkey % 3 WHEN 0 THEN 'q4' WHEN 1 THEN 'q8' END AS quantization,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(4096 * (1 + n_nationkey % 4) AS INT) END AS context_window,
       '{"temperature":' || CAST(n_nationkey % 2 AS STRING) || ',"top_p":0.9}' AS sampler_params,
       'runtime-' || CAST(n_nationkey % 2 AS STRING) AS runtime_version,
       CAST(DATE '2023-01-01' + CAST(n_nationkey AS INT) AS TIMESTAMP) AS created_at
FROM nation"""),
    "games": ((), """
SELECT o_orderkey AS game_id, CAST((o_custkey - o_custkey % 2) % 50 AS BIGINT) AS run_id,
       o_custkey AS white_participant_id,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey - 1 END
         AS black_participant_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN '*' WHEN o_orderstatus = 'F' THEN '1-0'
            WHEN o_orderstatus = 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'forfeit_invalid' WHEN '5-LOW' THEN 'max_plies'
            ELSE 'checkmate' END AS termination_reason,
       'end-' || o_orderstatus AS final_fen,
       '[Event "x"]' || chr(10) || '[White "W' || CAST(o_custkey AS STRING) || '"]' || chr(10) ||
         '[Black "' || CASE WHEN o_orderkey % 100 = 0 THEN '?' ELSE 'B' || o_orderstatus END || '"]' AS pgn,
       o_orderdate AS started_at
FROM orders"""),
    "moves": (("lines",), """
SELECT l_orderkey * 100 + ply AS move_id, l_orderkey AS game_id, ply,
       CASE WHEN ply % 2 = 1 THEN 'white' ELSE 'black' END AS color,
       'p' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fen_before,
       's' || CAST(l_suppkey AS STRING) AS accepted_uci, 'S' || CAST(l_suppkey AS STRING) AS accepted_san,
       CAST((l_orderkey + ply) % 3 AS INT) AS retries_used, l_extendedprice AS latency_total_ms,
       l_quantity, l_returnflag, l_linestatus
FROM lines"""),
    "raw_evaluations": (("lines",), """
SELECT l_orderkey * 100 + ply AS evaluation_id, l_orderkey * 100 + ply AS move_id,
       CASE WHEN l_tax > 0.075 THEN NULL ELSE CAST(l_partkey % 601 - 300 AS INT) END AS eval_before_cp,
       CASE WHEN l_tax > 0.075 OR l_tax < 0.005 THEN NULL
            ELSE CAST(l_partkey % 601 - 300 - (floor(l_quantity * 8) - 40) AS INT) END AS eval_after_cp,
       CASE WHEN l_tax > 0.075 THEN CAST(l_suppkey % 9 - 4 AS INT) END AS mate_before,
       CASE WHEN l_tax > 0.075 OR l_tax < 0.005 THEN CAST(l_partkey % 9 - 4 AS INT) END AS mate_after,
       CASE WHEN l_discount < 0.005 THEN NULL
            ELSE 's' || CAST((l_suppkey + l_linenumber % 2) AS STRING) END AS best_move_uci
FROM lines WHERE l_returnflag <> 'R' OR l_linestatus <> 'F'"""),
    "attempts": (("moves",), """
SELECT m.move_id * 10 + n AS attempt_id, CASE WHEN n = m.retries_used + 1 THEN m.move_id END AS move_id,
       m.game_id, m.ply, CAST(n AS INT) AS attempt_number,
       NOT (n <= m.retries_used AND (m.ply + n) % 2 = 0) AS parse_ok, n = m.retries_used + 1 AS legal_ok,
       CASE WHEN n <= m.retries_used AND (m.ply + n) % 2 = 0 THEN NULL WHEN n <= m.retries_used THEN 'zz'
            ELSE m.accepted_uci END AS parsed_move,
       CASE WHEN n <= m.retries_used AND (m.ply + n) % 2 = 0 THEN 'malformed_json'
            WHEN n <= m.retries_used THEN 'illegal_move' END AS error_type,
       CASE WHEN n <= m.retries_used AND (m.ply + n) % 2 = 0 THEN 'not json'
            WHEN n <= m.retries_used THEN '{"move":"zz"}'
            WHEN m.ply % 5 = 0 THEN '```json' || chr(10) || '{"move":"' || m.accepted_uci || '"}' || chr(10) || '```'
            WHEN m.ply % 5 = 1 THEN 'I choose {"move":" ' || m.accepted_uci || ' "} here'
            WHEN m.ply % 5 = 2 THEN '{"move":"' || m.accepted_uci || '","rationale":" plan ' || m.accepted_san ||
                 '","strategy_update":{"objective":"hold ' || m.fen_before || '"}}'
            ELSE '{"move":"' || m.accepted_uci || '"}' END AS raw_response,
       CASE WHEN (m.move_id + n) % 9 = 0 THEN NULL ELSE 'play ' || m.fen_before || ' try ' || CAST(n AS STRING) END AS raw_prompt,
       m.latency_total_ms / (m.retries_used + 1) AS latency_ms,
       CASE WHEN n = m.retries_used + 1 AND m.l_returnflag = 'A' THEN
              '{"regime":"llm_deliberative","mode":"' ||
              CASE WHEN m.ply % 2 = 0 THEN 'candidate_pairwise' ELSE 'candidate_critic' END ||
              '","candidate_legal_moves":["' || m.accepted_uci || '","' || m.accepted_uci || 'b"],' ||
              '"candidate_raw_response":"{' || chr(92) || '"candidates' || chr(92) || '":[{' || chr(92) || '"move' ||
              chr(92) || '":' || chr(92) || '"' || m.accepted_uci || chr(92) || '",' || chr(92) || '"idea' || chr(92) ||
              '":' || chr(92) || '"plan ' || CAST(m.ply AS STRING) || chr(92) || '"}]}"}'
            WHEN n = m.retries_used + 1 AND m.l_returnflag = 'N' THEN
              '{"scorer":"stockfish","n_candidates_configured":5,"n_candidates_generated":5,"n_legal":' ||
              CAST(2 + m.ply % 4 AS STRING) || ',"n_distinct_legal":' || CAST(1 + m.ply % 3 AS STRING) ||
              ',"n_vetoed":' || CAST(m.game_id % 3 AS STRING) || ',"veto_changed_move":' ||
              CASE WHEN m.game_id % 5 = 0 THEN 'true' ELSE 'false' END || ',"all_vetoed":' ||
              CASE WHEN m.game_id % 7 = 0 THEN 'true' ELSE 'false' END || ',"chosen_multiplicity":' ||
              CAST(1 + m.game_id % 2 AS STRING) || '}' END AS reranker_metadata
FROM moves m /*ATTEMPTS*/"""),
    "token_usage": (("attempts",), """
SELECT attempt_id, CAST(attempt_id % 5000 AS INT) AS total_tokens FROM attempts WHERE attempt_id % 7 <> 0"""),
    "annotations": (("moves",), """
SELECT move_id * 10 AS annotation_id, move_id,
       CASE WHEN ply % 2 = 0 THEN 'aggressive' ELSE 'technician' END AS persona, 'note ' || accepted_san AS commentary
FROM moves WHERE l_returnflag = 'R'
UNION ALL
SELECT move_id * 10 + 1, move_id, 'positional', 'second ' || accepted_san FROM moves WHERE l_linestatus = 'F'"""),
    "candidates": (("lines",), """
SELECT 'p' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fen_before,
       CASE WHEN l_partkey % 2 = 0 THEN 'white' ELSE 'black' END AS side_to_move,
       's' || CAST(l_suppkey AS STRING) AS candidate_uci, 'S' || CAST(l_suppkey AS STRING) AS candidate_san,
       CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'arena_move' WHEN 'AO' THEN 'arena_blunder'
            WHEN 'NF' THEN 'arena_candidate' WHEN 'NO' THEN 'policy_sample' WHEN 'RF' THEN 'stockfish_good'
            ELSE 'random_legal' END AS source,
       CASE WHEN l_returnflag = 'N' THEN CAST(l_orderkey % 5 AS INT) END AS candidate_rank_in_generator,
       CASE WHEN l_discount < 0.005 THEN NULL ELSE CAST(floor(l_quantity * 8) AS INT) END AS centipawn_loss,
       CASE WHEN l_discount < 0.005 AND l_tax > 0.055 THEN 'mate_missed' WHEN l_discount < 0.005 THEN 'mate_position'
            WHEN floor(l_quantity * 8) <= 20 THEN 'best' WHEN floor(l_quantity * 8) <= 80 THEN 'good'
            WHEN floor(l_quantity * 8) <= 150 THEN 'inaccuracy' WHEN floor(l_quantity * 8) <= 300 THEN 'mistake'
            ELSE 'blunder' END AS classification,
       's' || CAST((l_suppkey + l_linenumber % 2) AS STRING) AS best_move_uci,
       l_orderkey * 100 + ply AS seq
FROM lines"""),
    "legal_moves": ((), """
SELECT DISTINCT 'p' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fen,
       's' || CAST(l_suppkey AS STRING) AS uci
FROM lineitem WHERE l_quantity > 4"""),
    "turns": ((), """
SELECT conv_id AS game_id, CAST(turn + 1 AS INT) AS ply, role, text AS san, 'u' || CAST(turn AS STRING) AS uci
FROM conversations"""),
    "op_events": ((), """
SELECT event_id, CAST(user_id % 8 AS BIGINT) AS run_id, event_type AS event_kind,
       CASE event_type WHEN 'error' THEN 'warning' ELSE 'info' END AS severity, props AS payload
FROM events"""),
    "opening_lines": ((), """
SELECT CAST(n_regionkey AS BIGINT) AS suite_id, n_name AS name,
       CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS line_ord
FROM nation"""),
    "footprints": ((), """
SELECT p_brand AS model, CAST(max(p_size) AS DOUBLE) / 4 AS vram_gb FROM part WHERE p_size > 5 GROUP BY p_brand"""),
}


def _needed(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in (*_needed(VIEWS[name][0]), name):
            if dep not in out:
                out.append(dep)
    return out


def with_views(names: list[str], body: str, dialect: str = "duckdb", extra: dict[str, str] | None = None) -> str:
    """SQL text: the named projections as common table expressions, then the body."""
    parts = [f"{n} AS ({VIEWS[n][1].replace('/*ATTEMPTS*/', _ATTEMPTS[dialect]).strip()})" for n in _needed(names)]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()


class Fixtures:
    """The projections as Spark DataFrames over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.numbered = spark, folder.rstrip("/"), None

    def number_lines(self) -> Fixtures:
        """Numbers the lines of all games once and writes them, for queries that read several of their projections.

        They are numbered by game and written as they lie, in buckets by game, so what meets by game need not move."""
        if self.numbered is None:
            name = f"lines_{uuid4().hex}"
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            lines = self.lines.drop("l_shipdate").write.bucketBy(buckets, "l_orderkey")
            lines.option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
            self.numbered = name
        return self

    def _source(self, table: str) -> str:
        return f"SELECT * FROM parquet.`{self.folder}/{table}.parquet`"

    def raw(self, table: str) -> DataFrame:
        return self.spark.sql(self._source(table))

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.raw(name)
        if name not in VIEWS:
            raise AttributeError(name)
        text = with_views([name], f"SELECT * FROM {name}", "spark")
        if self.numbered is not None:
            text = text.replace(VIEWS["lines"][1].strip(), f"SELECT * FROM {self.numbered}")
        used = [t for t in RAW_TABLES if f"FROM {t}" in text]
        sources = "".join(f"{t} AS ({self._source(t)}),\n" for t in used)
        return self.spark.sql("WITH " + sources + text[len("WITH "):])
