"""Candidate moves per position: sources, dedup, caps, labels, and the signal report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plywise.functions import labels, prompts
from plywise.functions.responses import deliberations
from plywise.functions.stats import count_if, mean2
from plywise.operators.ordering import counters, first_per_key, hash_order, top_per_group
from plywise.operators.selection import first_rows
from plywise.session import stored

#: Buckets over which rows are dealt that belong to no window.
BUCKETS = 4096
SOURCE_ORDER = ("accepted", "metadata", "best", "external", "random")
_SPEC = (
    "fen_before", "candidate_uci", "source", "candidate_rank_in_generator", "generator_idea",
    "source_run_id", "source_game_id", "source_move_id", "source_attempt_id",
)


def of_runs(df: DataFrame, run_ids: Sequence[int]) -> DataFrame:
    """Optional run filter; no ids keep everything."""
    return df.where(F.col("run_id").isin(*run_ids)) if run_ids else df


def _spec(df: DataFrame, kind: str, order: Sequence[Column], **columns: Column) -> DataFrame:
    return df.select(*_spec_columns(kind, order, **columns))


def _spec_columns(kind: str, order: Sequence[Column], **columns: Column) -> list[Column]:
    """Spec columns plus ``spec_order``, an orderable struct (source, then up to five keys)."""
    keys = list(order) + [F.lit(0)] * (5 - len(order))
    position = F.struct(
        F.lit(SOURCE_ORDER.index(kind)).alias("source_ord"),
        *[k.cast("long").alias(f"o{i}") for i, k in enumerate(keys)],
    )
    types = {"candidate_rank_in_generator": "int", "fen_before": "string", "candidate_uci": "string",
             "source": "string", "generator_idea": "string"}
    return [*[columns.get(c, F.lit(None)).cast(types.get(c, "long")).alias(c) for c in _SPEC], position.alias("spec_order")]


def accepted_specs(moves: DataFrame, games: DataFrame, evaluations: DataFrame, run_ids: Sequence[int] = ()) -> DataFrame:
    """The move played in every position, marked when it was a blunder."""
    rows = (
        moves.select("move_id", "game_id", "ply", "fen_before", "accepted_uci")
        .join(of_runs(games.select("game_id", "run_id"), run_ids), "game_id")
        .join(evaluations.select("move_id", "classification"), "move_id", "left")
    )
    c = F.col
    return _spec(
        rows, "accepted", [c("run_id"), c("game_id"), c("ply")],
        fen_before=c("fen_before"), candidate_uci=c("accepted_uci"),
        source=labels.played_source(F.coalesce(c("classification"), F.lit(""))),
        source_run_id=c("run_id"), source_game_id=c("game_id"), source_move_id=c("move_id"),
    )


def metadata_specs(attempts: DataFrame, games: DataFrame, moves: DataFrame, run_ids: Sequence[int] = ()) -> DataFrame:
    """Every legal move a deliberating player listed, with its rank and idea."""
    rows = (
        attempts.where(F.col("reranker_metadata").isNotNull() & F.col("move_id").isNotNull())
        .select("attempt_id", "game_id", "move_id", "ply", "attempt_number", "reranker_metadata")
        .join(of_runs(games.select("game_id", "run_id"), run_ids), "game_id")
        .join(moves.select("move_id", "fen_before").where(F.col("fen_before").isNotNull()), "move_id")
    )
    rows = deliberations(rows).select("*", F.inline("items"))
    same = F.filter("ideas", lambda c: c["move"] == F.col("uci"))
    c = F.col
    return _spec(
        rows, "metadata", [c("run_id"), c("game_id"), c("ply"), c("attempt_number"), c("pos")],
        fen_before=c("fen_before"), candidate_uci=c("uci"), source=labels.metadata_source(c("mode")),
        candidate_rank_in_generator=c("pos"), generator_idea=F.try_element_at(same, F.lit(-1))["idea"],
        source_run_id=c("run_id"), source_game_id=c("game_id"), source_move_id=c("move_id"),
        source_attempt_id=c("attempt_id"),
    )


def best_specs(moves: DataFrame, games: DataFrame, evaluations: DataFrame, run_ids: Sequence[int] = ()) -> DataFrame:
    """The engine's best move of every evaluated position (distinct)."""
    best = evaluations.where(F.col("best_move_uci").isNotNull()).select("move_id", "best_move_uci").distinct()
    rows = (
        moves.select("move_id", "game_id", "ply", "fen_before")
        .join(of_runs(games.select("game_id", "run_id"), run_ids), "game_id").join(best, "move_id")
    )
    c = F.col
    return _spec(
        rows, "best", [c("run_id"), c("game_id"), c("ply")],
        fen_before=c("fen_before"), candidate_uci=c("best_move_uci"), source=F.lit("stockfish_good"),
        source_run_id=c("run_id"), source_game_id=c("game_id"), source_move_id=c("move_id"),
    )


def game_specs(moves: DataFrame, games: DataFrame, evaluations: DataFrame, attempts: DataFrame, run_ids: Sequence[int] = (),
               by_position: bool = False, columns: Sequence[str] = _SPEC) -> DataFrame:
    """The specs of ``accepted_specs``, ``metadata_specs`` and ``best_specs`` together: moves meet their game, evaluations and
    attempts once, and every move gives all its specs.

    Records are parsed first, so only deliberating attempts are exchanged; an attempt belongs to the game of its move. With
    ``by_position``, a move goes to the place of its position before it gives its specs, which then lie by position; that is
    for positions of which none has many moves. ``columns`` leaves other columns of the specs out.
    """
    c, of_move = F.col, Window.partitionBy("move_id").orderBy("best_move_uci", "classification")
    played = moves.select("move_id", "game_id", "ply", "fen_before", "accepted_uci").join(
        of_runs(games.select("game_id", "run_id"), run_ids), "game_id")
    judged = evaluations.select("move_id", "classification", "best_move_uci").where("move_id IS NOT NULL").repartition("move_id").withColumns({
        "_nth": F.row_number().over(of_move),
        "_new": c("best_move_uci").isNotNull() & ~c("best_move_uci").eqNullSafe(F.lag("best_move_uci").over(of_move)),
    })
    parsed = deliberations(attempts.where("reranker_metadata IS NOT NULL AND move_id IS NOT NULL").select(
        "attempt_id", "move_id", "ply", "attempt_number", "reranker_metadata"))
    asked = {"attempt_id": "source_attempt_id", "ideas": "generator_idea"}
    talk = [f for f in ("attempt_id", "ply", "attempt_number", "items", "ideas") if asked.get(f) is None or asked[f] in columns]
    talks = parsed.where(F.size("items") > 0).groupBy("move_id").agg(F.collect_list(F.struct(*talk)).alias("_talks"))
    rows = played.join(judged, "move_id", "left").join(talks, "move_id", "left")
    if by_position:
        rows = rows.repartition("fen_before")
    source = {"source_run_id": c("run_id"), "source_game_id": c("game_id"), "source_move_id": c("move_id")}
    named = [c for c in _SPEC if c in columns and c != "fen_before"]  # the position stays beside, where it lies

    def spec(kind: str, order: Sequence[Column], **values: Column) -> Column:
        every = dict(zip((*_SPEC, "spec_order"), _spec_columns(kind, order, **values)))
        return F.struct(*[every[c] for c in (*named, "spec_order")])

    accepted = spec(
        "accepted", [c("run_id"), c("game_id"), c("ply")], **source, candidate_uci=c("accepted_uci"),
        source=labels.played_source(F.coalesce(c("classification"), F.lit(""))))
    best = spec(
        "best", [c("run_id"), c("game_id"), c("ply")], **source, candidate_uci=c("best_move_uci"), source=F.lit("stockfish_good"))

    def listed(talk: Column) -> Column:
        idea = lambda item: F.try_element_at(F.filter(talk["ideas"], lambda i: i["move"] == item["uci"]), F.lit(-1))["idea"]
        return F.transform(talk["items"], lambda item: spec(
            "metadata", [c("run_id"), c("game_id"), talk["ply"], talk["attempt_number"], item["pos"]], **source,
            candidate_uci=item["uci"], source=labels.metadata_source(item["mode"]), candidate_rank_in_generator=item["pos"],
            **({"generator_idea": idea(item)} if "generator_idea" in columns else {}),
            **({"source_attempt_id": talk["attempt_id"]} if "source_attempt_id" in columns else {})))

    once = F.coalesce(c("_nth"), F.lit(1)) == 1  # of several evaluations of a move
    parts = [F.array(accepted), F.when(c("_new"), F.array(best)),
             F.when(once & c("fen_before").isNotNull(), F.flatten(F.transform("_talks", listed)))]
    return rows.select(F.col("fen_before").cast("string").alias("fen_before"), F.inline(F.flatten(F.array_compact(F.array(*parts)))))


def external_specs(rows: DataFrame, order: str = "line_index") -> DataFrame:
    names = ("fen_before", "candidate_uci", "source", "candidate_rank_in_generator", "generator_idea")
    return _spec(rows, "external", [F.col(order)], **{n: F.col(n) for n in names})


def random_specs(positions: DataFrame, legal_moves: DataFrame, per_position: int, seed: int) -> DataFrame:
    """``per_position`` legal moves of each position, drawn by hash order."""
    rows = legal_moves.select(F.col("fen").alias("fen_before"), "uci").join(
        positions.select("fen_before").distinct(), "fen_before", "left_semi"
    )
    drawn = top_per_group(rows, ["fen_before"], [hash_order(seed, F.col("fen_before"), F.col("uci"))], per_position, "_n")
    return _spec(drawn, "random", [F.col("_n")], fen_before=F.col("fen_before"), candidate_uci=F.col("uci"),
                 source=F.lit("random_legal"))


def union_specs(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def legal_specs(specs: DataFrame, legal_moves: DataFrame) -> DataFrame:
    """Specs whose move is legal in their position."""
    known = legal_moves.select(F.col("fen").alias("fen_before"), F.col("uci").alias("candidate_uci"))
    return specs.join(known, ["fen_before", "candidate_uci"], "left_semi")


def unique_specs(legal: DataFrame) -> DataFrame:
    """First spec of every (position, move). Illegal specs are never remembered by the rule,
    so filtering on legality first gives the same rows."""
    return first_per_key(legal, ["fen_before", "candidate_uci"], ["spec_order"])


def unique_legal_specs(specs: DataFrame, legal_moves: DataFrame) -> DataFrame:
    """The same rows; legality is a matter of the key alone, so repeats go before the look-up."""
    return legal_specs(unique_specs(specs), legal_moves)


def choose_positions(unique: DataFrame, max_positions: int | None, shuffle_seed: int | None = None) -> DataFrame:
    """Positions in first-seen or hash order, up to the maximum. The specs are read for the order and for the rows, so they
    are written once."""
    if max_positions is None:
        return unique
    unique = stored(unique, "unique")
    seen = unique.groupBy("fen_before").agg(F.min("spec_order").alias("_seen"))
    order = F.col("_seen") if shuffle_seed is None else hash_order(shuffle_seed, F.col("fen_before"))
    kept = stored(first_rows(stored(seen, "positions"), [order], max_positions).select("fen_before"), "kept")
    return unique.join(kept, "fen_before", "left_semi")


def cap_candidates(unique: DataFrame, limit: int | None) -> DataFrame:
    return unique if limit is None else top_per_group(unique, ["fen_before"], [F.col("spec_order")], limit)


def label_candidates(specs: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """Join engine results on (fen_before, candidate_uci), unless the specs have them, and derive the training labels."""
    kind, cpl = F.col("classification"), F.col("centipawn_loss")
    rows = (specs if evaluations is None else specs.join(evaluations, ["fen_before", "candidate_uci"])).withColumns({
        "risk": labels.risk(kind, cpl),
        "score": labels.score(kind, cpl),
        "reason_type": labels.reason_type(kind, cpl),
        "split": labels.position_split(F.col("fen_before")),
    })
    target = F.to_json(F.struct("risk", (F.col("risk") == "blunder").alias("blunder"), "score", "reason_type"))
    return rows.withColumn("target", target).withColumn("completion", F.col("target"))


def move_list_texts(legal_moves: DataFrame, limit: int) -> DataFrame:
    """Per position the first ``limit`` moves in order as text, the rest only counted.

    The list is cut before it is gathered, so its length is bounded by the limit.
    """
    sizes = legal_moves.groupBy("fen").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_group(legal_moves.select("fen", "uci"), ["fen"], [F.asc("uci")], limit)
    shown = F.array_join(F.array_sort(F.collect_list("uci")), ", ")
    more = F.concat(F.col("shown"), F.lit(" ... ("), (F.col("n") - limit).cast("string"), F.lit(" more)"))
    lists = top.groupBy("fen").agg(shown.alias("shown")).join(sizes, "fen")
    return lists.select("fen", F.when(F.col("n") > limit, more).otherwise(F.col("shown")).alias("listed"))


def with_risk_prompt(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Add the critic prompt; needs side, san, the position after the move and the texts of
    the opponent's replies (``move_list_texts`` of the positions after)."""
    names = ("fen_before", "side_to_move", "candidate_uci", "candidate_san", "fen_after")
    joined = rows.join(replies.select(F.col("fen").alias("fen_after"), F.col("listed").alias("_replies")), "fen_after", "left")
    values = {**{n: F.col(n) for n in names}, "opponent_legal_replies": F.coalesce("_replies", F.lit(""))}
    return joined.withColumn("prompt", prompts.risk_prompt(values)).drop("_replies")


def build_counts(specs: DataFrame, legal_moves: DataFrame, evaluations: DataFrame, limit: int | None = None, lie_by_position: bool = False) -> DataFrame:
    """Counters of a build over all positions: (metric, key, n).

    One pass: specs become one row for each (position, move) with its number and first spec, legality, place and label
    are looked up once for that row, and every row adds to all counters. Illegal moves have no place, so a position's
    window holds its legal moves only; of the others only their number is exchanged for it, dealt over ``BUCKETS``. Where
    ``lie_by_position``, as all three tables are dealt, nothing is exchanged, and a position's illegal moves follow its legal ones.
    """
    keys = ["fen_before", "candidate_uci"]
    seen = specs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"), F.min(F.struct(F.col("spec_order").alias("first"), "source")).alias("_first")).select(*keys, "seen", "_first.*")
    legal = legal_moves.select(F.col("fen").alias("fen_before"), F.col("uci").alias("candidate_uci")).distinct().withColumn("legal", F.lit(True))
    judged = evaluations.select(*keys, labels.risk(F.col("classification"), F.col("centipawn_loss")).alias("risk"), F.lit(True).alias("judged"))
    rows = seen.join(legal, keys, "left").join(judged, keys, "left")
    if lie_by_position:
        inside = Window.partitionBy("fen_before").orderBy(F.desc_nulls_last("legal"), "first")
    else:
        rows = rows.select(
            "seen", "legal", "judged", *[F.when(F.col("legal"), F.col(c)).alias(c) for c in ("fen_before", "first", "source", "risk")],
            F.when(F.col("legal").isNull(), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).alias("_bucket"))
        inside = Window.partitionBy("fen_before", "_bucket").orderBy("first")
    rows = rows.withColumn("place", F.when(F.col("legal"), F.row_number().over(inside)))
    is_legal, place, one = F.col("legal").isNotNull(), F.col("place"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    kept = is_legal if limit is None else is_legal & (place <= limit)
    written = kept & F.col("judged").isNotNull()
    totals = {
        "candidates_seen": F.col("seen"), "dropped_illegal_candidate": F.when(is_legal, 0).otherwise(F.col("seen")),
        "dropped_duplicate_candidate": F.when(is_legal, F.col("seen") - 1).otherwise(0), "dropped_candidate_limit": one(is_legal & ~kept),
        "positions_seen": one(place == 1), "rows_written": one(kept),
    }
    by = {"by_source": F.col("source"), "by_risk": F.col("risk"), "by_split": labels.position_split(F.col("fen_before"))}
    count = lambda metric, key, n: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    counts = rows.select(F.inline(F.array(*[count(m, F.lit(""), n) for m, n in totals.items()], *[count(m, F.when(written, k), F.lit(1)) for m, k in by.items()])))
    none = specs.sparkSession.range(1).select(F.inline(F.array(*[count(m, F.lit(""), F.lit(0)) for m in totals])))
    return counts.where("key IS NOT NULL").unionByName(none).groupBy("metric", "key").agg(F.sum("n").alias("n"))


# Signal report --------------------------------------------------------------------


def role_selections(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Per position: the move finally played, the generator's first choice and the best one."""
    row = F.struct("candidate_uci", "risk", "score", "centipawn_loss")
    final = F.col("source").isin(*labels.FINAL_SOURCES)
    generated = F.col("source").isin(*labels.GENERATOR_SOURCES) & F.col("candidate_rank_in_generator").isNotNull()
    best_key = F.struct("score", labels.cpl_key(F.col("centipawn_loss")), -F.col(order))
    return rows.groupBy("fen_before").agg(
        F.count(F.lit(1)).alias("candidates"),
        (F.bool_or(labels.is_safe(F.col("risk"))) & F.bool_or(labels.is_unsafe(F.col("risk")))).alias("mixed"),
        F.min_by(F.when(final, row), F.when(final, F.col(order))).alias("final"),
        F.min_by(F.when(generated, row), F.when(generated, F.struct("candidate_rank_in_generator", order))).alias("first"),
        F.max_by(row, best_key).alias("oracle"),
    )


def signal_report(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row: does choosing by label beat what was played and what was generated first?"""
    roles = role_selections(rows, order)
    aggregates = [
        F.sum("candidates").alias("rows"), F.count(F.lit(1)).alias("positions"),
        count_if(F.col("first").isNotNull()).alias("positions_with_generator_candidates"),
        count_if(F.col("mixed")).alias("mixed_safe_unsafe_positions"),
        F.min("candidates").alias("candidates_min"), F.max("candidates").alias("candidates_max"),
        mean2(F.col("candidates")).alias("candidates_mean"),
    ]
    for role in ("final", "first", "oracle"):
        aggregates += _selection(role)
    for role in ("final", "first"):
        aggregates += _gain(role)
        aggregates.append(
            count_if((F.col(f"{role}.risk") == "blunder") & labels.is_safe(F.col("oracle.risk")))
            .alias(f"{role}_blunder_oracle_safe")
        )
    return roles.agg(*aggregates)


def _selection(role: str) -> list[Column]:
    return [
        count_if(F.col(role).isNotNull()).alias(f"{role}_count"),
        mean2(F.col(f"{role}.score")).alias(f"{role}_mean_score"),
        mean2(F.col(f"{role}.centipawn_loss")).alias(f"{role}_mean_cpl"),
    ]


def _gain(role: str) -> list[Column]:
    by_score = F.col("oracle.score") - F.col(f"{role}.score")
    by_cpl = F.col(f"{role}.centipawn_loss") - F.col("oracle.centipawn_loss")
    return [
        mean2(by_score).alias(f"gain_vs_{role}_mean_score"), mean2(by_cpl).alias(f"gain_vs_{role}_mean_cpl"),
        count_if(by_score > 0).alias(f"improved_vs_{role}_by_score"),
        count_if(by_cpl > 0).alias(f"improved_vs_{role}_by_cpl"),
    ]


def signal_counts(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Risk and source histograms of the rows and of each role: (metric, key, n)."""
    plain = counters(rows, {"risk": F.col("risk"), "source": F.col("source")})
    roles = counters(role_selections(rows, order), {f"{r}_risk": F.col(f"{r}.risk") for r in ("final", "first", "oracle")})
    return plain.unionByName(roles)
