"""Choice rows, safe-against-unsafe pairs and pairwise comparisons of candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plywise.functions import labels, prompts
from plywise.functions.stats import count_if
from plywise.operators.ordering import by_key, counters, hash_order, top_per_group
from plywise.operators.selection import first_rows
from plywise.session import stored

_FIELDS = ("uci", "san", "source", "risk", "score", "centipawn_loss", "candidate_rank_in_generator")
_NUMBERS = ("score", "centipawn_loss", "candidate_rank_in_generator")


def candidate_struct(fields: Sequence[str] = _FIELDS) -> Column:
    names = {"uci": "candidate_uci", "san": "candidate_san"}
    return F.struct(*[F.col(names.get(f, f)).cast("int" if f in _NUMBERS else "string").alias(f) for f in fields])


def quality_key(c: Column) -> Column:
    """Orderable quality of a candidate struct: score, small loss, early generator rank."""
    return F.struct(
        c["score"].alias("k1"), labels.cpl_key(c["centipawn_loss"]).alias("k2"),
        labels.generator_rank_key(c["candidate_rank_in_generator"]).alias("k3"),
    )


def best_candidates(rows: DataFrame, order: str = "seq", fields: Sequence[str] = _FIELDS) -> DataFrame:
    """Best row of every (position, move): columns fen, c (candidate struct), first_seq.

    Ties keep the earliest row. An aggregate, so repeated positions shrink before the shuffle.
    """
    picked = rows.select(F.col("fen_before").alias("fen"), "candidate_uci", order, candidate_struct(fields).alias("c"))
    return picked.groupBy("fen", "candidate_uci").agg(
        F.max_by("c", F.struct(quality_key(F.col("c")).alias("q"), (-F.col(order)).alias("o"))).alias("c"),
        F.min(order).alias("first_seq"),
    ).drop("candidate_uci")


def position_facts(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Per position: side to move of its last row and when it was first seen."""
    return rows.groupBy(F.col("fen_before").alias("fen")).agg(
        F.max_by("side_to_move", order).alias("side_to_move"), F.min(order).alias("position_seq")
    )


def gate_positions(best: DataFrame, min_candidates: int, require_mixed: bool) -> DataFrame:
    """Per position: number of distinct moves and the reason it is dropped, if any."""
    risk = F.col("c.risk")
    shape = best.groupBy("fen").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(labels.is_safe(risk)).alias("has_safe"), F.bool_or(labels.is_unsafe(risk)).alias("has_unsafe"),
    )
    return shape.withColumn("dropped", _gate(F.col("n"), min_candidates, require_mixed))


def _gate(n: Column, min_candidates: int, require_mixed: bool) -> Column:
    drop = F.when(n < min_candidates, "too_few_candidates")
    return drop.when(~(F.col("has_safe") & F.col("has_unsafe")), "no_mixed_risk") if require_mixed else drop


def choice_rows(
    rows: DataFrame,
    min_candidates: int = 2,
    max_candidates: int | None = None,
    require_mixed: bool = True,
    max_positions: int | None = None,
    order: str = "seq",
    with_prompt: bool = True,
    fields: Sequence[str] = _FIELDS,
) -> DataFrame:
    """One multiple-choice row per position that passes the gate.

    With ``max_candidates`` the list of a position is cut to the best before it is gathered; without,
    it holds all moves of the position. ``fields`` names those of a candidate that are asked for.
    """
    lists = position_lists(rows, max_candidates, order, fields)
    return choices_of(lists, min_candidates, require_mixed, max_positions, with_prompt)


def position_lists(rows: DataFrame, max_candidates: int | None = None, order: str = "seq", fields: Sequence[str] = _FIELDS) -> DataFrame:
    """The list of every position, the number of its moves, whether some are safe or unsafe, and its target; no gate.

    Rows are dealt by position once; there they become moves and lists. ``fields`` leaves others out of the candidates; those
    of the quality key, the move and the risk must be among them.
    """
    if max_candidates is None:
        return by_key(rows, "fen_before", lambda own: _whole_lists(own, order, fields))
    return by_key(rows, "fen_before", lambda own: _cut_lists(own, max_candidates, order, fields),
                  apart=lambda own: _cut_lists_apart(own, max_candidates, order, fields))


def choices_of(lists: DataFrame, min_candidates: int = 2, require_mixed: bool = True, max_positions: int | None = None, with_prompt: bool = True) -> DataFrame:
    """Choice rows of the lists (``position_lists``) that pass the gate."""
    kept = lists.where(_gate(F.col("distinct_candidates"), min_candidates, require_mixed).isNull())
    return _cut(kept.select("fen", "side_to_move", "position_seq", "distinct_candidates",
                            _in_hash_order("fen", "listed").alias("candidates"), "target"), max_positions, with_prompt)


def _moves(rows: DataFrame, order: str, fields: Sequence[str], last: Column) -> DataFrame:
    """Best row of every (position, move), when it was first seen, and ``last``, the largest of its rows."""
    picked = rows.select(F.col("fen_before").alias("fen"), "candidate_uci", order, "side_to_move", candidate_struct(fields).alias("c"))
    return picked.groupBy("fen", "candidate_uci").agg(
        F.max_by("c", F.struct(quality_key(F.col("c")).alias("q"), (-F.col(order)).alias("o"))).alias("c"),
        F.min(order).alias("first_seq"), F.max(last).alias("last"),
    )


def _shape() -> list[Column]:
    return [
        F.max("last")["side_to_move"].alias("side_to_move"), F.min("first_seq").alias("position_seq"),
        F.count(F.lit(1)).alias("distinct_candidates"),
        F.bool_or(labels.is_safe(F.col("risk"))).alias("has_safe"), F.bool_or(labels.is_unsafe(F.col("risk"))).alias("has_unsafe"),
    ]


def _whole_lists(rows: DataFrame, order: str, fields: Sequence[str]) -> DataFrame:
    """Uncut lists of all positions, from one read: moves, then positions."""
    better = F.struct(quality_key(F.col("c")).alias("q"), (-F.col("first_seq")).alias("o"))
    moves = _moves(rows, order, fields, F.struct(order, "side_to_move")).withColumn("risk", F.col("c.risk"))
    lists = moves.groupBy("fen").agg(*_shape(), F.collect_list("c").alias("listed"), F.max_by("c", better).alias("target"))
    return lists.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_safe", "has_unsafe")})


def _rank() -> list[Column]:
    return [F.desc("c.score"), labels.cpl_key(F.col("c.centipawn_loss")).desc(),
            labels.generator_rank_key(F.col("c.candidate_rank_in_generator")).desc(), F.asc("first_seq")]


def _cut_lists(rows: DataFrame, max_candidates: int, order: str, fields: Sequence[str]) -> DataFrame:
    """Lists cut to the best, of positions whose moves lie in one place."""
    last = F.when(F.col(order).isNotNull(), F.struct(order, "side_to_move"))
    placed = _moves(rows, order, fields, last).withColumn("place", F.row_number().over(Window.partitionBy("fen").orderBy(*_rank())))
    first, kept = F.when(F.col("place") == 1, F.col("c")), F.when(F.col("place") <= max_candidates, F.col("c"))
    cut = placed.select("fen", "first_seq", "last", F.col("c.risk").alias("risk"), first.alias("best"), kept.alias("c"))
    return cut.groupBy("fen").agg(*_shape(), F.collect_list("c").alias("listed"), F.max("best").alias("target"))


def _cut_lists_apart(rows: DataFrame, max_candidates: int, order: str, fields: Sequence[str]) -> DataFrame:
    """The same lists, cut in each task before the best moves of a position meet."""
    best = best_candidates(rows, order, fields)
    shape = gate_positions(best, 0, False).withColumnRenamed("n", "distinct_candidates").drop("dropped")
    top = top_per_group(best, ["fen"], _rank(), max_candidates, "place")
    lists = top.groupBy("fen").agg(
        F.collect_list("c").alias("listed"), F.max(F.when(F.col("place") == 1, F.col("c"))).alias("target"),
    )
    return lists.join(shape, "fen").join(position_facts(rows, order), "fen")


def _in_hash_order(fen: str, listed: str) -> Column:
    """The candidates of a gathered list in the order of their hashes, which are made here, not exchanged."""
    hashed = F.transform(listed, lambda c: F.struct(F.sha2(F.concat_ws("|", F.col(fen), c["uci"]), 256).alias("h"), c.alias("c")))
    return F.transform(F.array_sort(hashed), lambda s: s["c"])


def _cut(lists: DataFrame, max_positions: int | None, with_prompt: bool) -> DataFrame:
    return _finish(first_rows(lists, ["position_seq"], max_positions), prompts.choice_prompt if with_prompt else None)


def _finish(df: DataFrame, prompt, split: Column | None = None) -> DataFrame:
    target = F.col("target")
    position = F.array_position(F.transform("candidates", lambda c: c["uci"]), target["uci"]).cast("int")
    extra = {
        "fen_before": F.col("fen"), "move": target["uci"], "target_move": target["uci"], "target_san": target["san"],
        "split": labels.position_split(F.col("fen")) if split is None else split,
        "candidate_count": F.size("candidates"),
        "target_prompt_index": position, "target_risk": target["risk"], "target_score": target["score"],
        "target_centipawn_loss": target["centipawn_loss"],
        "completion": F.concat(F.lit('{"move":"'), target["uci"], F.lit('"}')),
    }
    if prompt is not None:
        extra["prompt"] = prompt(F.col("fen"), F.col("side_to_move"), F.col("candidates"))
    return df.withColumns(extra).drop("target")


def choice_drops(rows: DataFrame, min_candidates: int, max_candidates: int | None, require_mixed: bool, order: str = "seq") -> DataFrame:
    """Counters of the gate and the cap: (metric, key, n)."""
    gate = by_key(rows, "fen_before", lambda own: gate_positions(best_candidates(own, order), min_candidates, require_mixed))
    return _drops(gate, max_candidates)


def drops_of(lists: DataFrame, min_candidates: int, max_candidates: int | None, require_mixed: bool) -> DataFrame:
    """The same counters from lists (``position_lists``) that are at hand."""
    gate = lists.select(F.col("distinct_candidates").alias("n"), _gate(F.col("distinct_candidates"), min_candidates, require_mixed).alias("dropped"))
    return _drops(gate, max_candidates)


def _drops(gate: DataFrame, max_candidates: int | None) -> DataFrame:
    surplus = F.lit(0).cast("long") if max_candidates is None else F.greatest(F.col("n") - max_candidates, F.lit(0))
    one = gate.agg(
        F.count(F.lit(1)).alias("positions_seen"),
        count_if(F.col("dropped").isNull()).alias("positions_written"),
        count_if(F.col("dropped") == "too_few_candidates").alias("dropped_too_few_candidates"),
        count_if(F.col("dropped") == "no_mixed_risk").alias("dropped_no_mixed_risk"),
        F.coalesce(F.sum(F.when(F.col("dropped").isNull(), surplus)), F.lit(0)).alias("dropped_candidate_limit"),
    )
    return unpivot_counts(one)


def unpivot_counts(one_row: DataFrame) -> DataFrame:
    """Columns of a one-row count frame as (metric, key, n)."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("long").alias("n"))
        for c in one_row.columns
    ])))


# Pairs ----------------------------------------------------------------------------


def _gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def _levels(best: DataFrame) -> DataFrame:
    """Per position and loss value: number of safe and unsafe moves (NULL loss is its own level)."""
    return best.groupBy("fen", F.col("c.centipawn_loss").alias("cpl")).agg(
        count_if(labels.is_safe(F.col("c.risk"))).alias("n_safe"),
        count_if(labels.is_unsafe(F.col("c.risk"))).alias("n_unsafe"),
    )


def pair_counts_by_position(best: DataFrame, min_gap: int) -> DataFrame:
    """Per position: safe and unsafe moves, pairs with a known gap that pass or fail the minimum,
    and pairs without a gap. Counted on loss levels, without forming the pairs."""
    return _counts_of(_levels(best), min_gap)


def _counts_of(levels: DataFrame, min_gap: int) -> DataFrame:
    known = F.col("cpl").isNotNull()
    # NULL losses form their own peer group, which the range frame of a number never reaches.
    near = Window.partitionBy("fen").orderBy("cpl").rangeBetween(-(min_gap - 1), min_gap - 1)
    close = F.when(known, F.col("n_safe") * F.sum("n_unsafe").over(near)) if min_gap > 0 else F.lit(0)
    has = lambda side: F.coalesce(F.sum(F.when(known, F.col(side))), F.lit(0))
    return levels.withColumn("close_pairs", close).groupBy("fen").agg(
        F.sum("n_safe").alias("n_safe"), F.sum("n_unsafe").alias("n_unsafe"),
        (has("n_safe") * has("n_unsafe")).alias("known_pairs"),
        F.coalesce(F.sum("close_pairs"), F.lit(0)).alias("small_gap_pairs"),
    ).select(
        "fen", "n_safe", "n_unsafe", "small_gap_pairs",
        (F.col("known_pairs") - F.col("small_gap_pairs")).alias("gap_pairs"),
        (F.col("n_safe") * F.col("n_unsafe") - F.col("known_pairs")).alias("null_pairs"),
    )


def _edge_levels(levels: DataFrame, min_gap: int, keep: int) -> DataFrame:
    """Level pairs (fen, safe_cpl, unsafe_cpl) that can hold one of the ``keep`` widest pairs.

    A pair outside the ``keep`` lowest or highest levels of either side has at least ``keep``
    pairs with a strictly larger gap, so only those levels are gathered (at most ``2 * keep``
    per side), and of their combinations those with fewer than ``keep`` pairs above them stay.
    """
    side = F.inline(F.array(
        F.struct(F.lit(True).alias("safe"), F.col("n_safe").alias("n")),
        F.struct(F.lit(False).alias("safe"), F.col("n_unsafe").alias("n")),
    ))
    sides = levels.where(F.col("cpl").isNotNull()).select("fen", "cpl", side).where("n > 0")
    rank = lambda order: F.row_number().over(Window.partitionBy("fen", "safe").orderBy(order))
    outer = sides.withColumns({"low": rank(F.asc("cpl")), "high": rank(F.desc("cpl"))}).where(
        (F.col("low") <= keep) | (F.col("high") <= keep)
    )
    level = F.struct("cpl", "n")
    lists = outer.groupBy("fen").agg(
        F.collect_list(F.when(F.col("safe"), level)).alias("s"), F.collect_list(F.when(~F.col("safe"), level)).alias("u")
    ).where((F.size("s") > 0) & (F.size("u") > 0))
    grid = lists.select("fen", F.explode("s").alias("s"), "u").select("fen", "s", F.explode("u").alias("u")).select(
        "fen", F.col("s.cpl").alias("safe_cpl"), F.col("u.cpl").alias("unsafe_cpl"),
        _gap(F.col("s.cpl"), F.col("u.cpl")).alias("gap"), (F.col("s.n") * F.col("u.n")).alias("pairs"),
    ).where(F.col("gap") >= min_gap)
    wider = Window.partitionBy("fen").orderBy(F.desc("gap")).rangeBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("pairs").over(wider), F.lit(0))
    return grid.withColumn("above", above).where(F.col("above") < keep).select("fen", "safe_cpl", "unsafe_cpl")


def candidate_pairs(rows: DataFrame, pairs_per_position: int, min_gap: int = 100, order: str = "seq") -> DataFrame:
    """The widest safe-against-unsafe pairs of every position, ranked; rows are dealt by position once.

    Only loss levels that can reach the top are joined: levels are counted first, so the number
    of formed pairs depends on the cap and on ties at its edge, not on the square of the group.
    Pairs without a gap rank last and are formed only where the others do not fill the cap.
    """
    return by_key(rows, "fen_before", lambda own: _candidate_pairs(own, pairs_per_position, min_gap, order))


def _candidate_pairs(rows: DataFrame, pairs_per_position: int, min_gap: int, order: str) -> DataFrame:
    best = best_candidates(rows, order).drop("first_seq")
    levels = _levels(best)
    counts = _counts_of(levels, min_gap)
    edge = _edge_levels(levels, min_gap, pairs_per_position)
    safe = best.where(labels.is_safe(F.col("c.risk"))).select("fen", F.col("c").alias("s"))
    unsafe = best.where(labels.is_unsafe(F.col("c.risk"))).select("fen", F.col("c").alias("u"))
    s_key = safe.withColumn("safe_cpl", F.col("s.centipawn_loss"))
    u_key = unsafe.withColumn("unsafe_cpl", F.col("u.centipawn_loss"))
    wide = edge.join(s_key, ["fen", "safe_cpl"]).join(u_key, ["fen", "unsafe_cpl"]).select("fen", "s", "u")
    short = counts.where((F.col("gap_pairs") < pairs_per_position) & (F.col("null_pairs") > 0)).select("fen")
    s_short, u_short = safe.join(short, "fen", "left_semi"), unsafe.join(short, "fen", "left_semi")
    s_null = s_short.where(F.col("s.centipawn_loss").isNull()).join(u_short, "fen")
    u_null = s_short.where(F.col("s.centipawn_loss").isNotNull()).join(
        u_short.where(F.col("u.centipawn_loss").isNull()), "fen"
    )
    pairs = wide.unionByName(s_null.select("fen", "s", "u")).unionByName(u_null.select("fen", "s", "u"))
    safe_better = quality_key(F.col("s")) >= quality_key(F.col("u"))
    ranked = pairs.select(
        "fen",
        F.when(safe_better, F.col("s")).otherwise(F.col("u")).alias("better"),
        F.when(safe_better, F.col("u")).otherwise(F.col("s")).alias("worse"),
        _gap(F.col("s.centipawn_loss"), F.col("u.centipawn_loss")).alias("gap"),
    ).withColumn("_h", F.sha2(F.concat_ws("|", "fen", "better.uci", "worse.uci"), 256))
    by_gap = [F.coalesce("gap", F.lit(-1)).desc(), F.desc("_h")]
    top = top_per_group(ranked, ["fen"], by_gap, pairs_per_position, "_place")
    return top.withColumn("pair_index", F.col("_place") - 1).drop("_place", "_h")


def pair_rows(
    rows: DataFrame,
    pairs_per_position: int,
    min_gap: int = 100,
    max_positions: int | None = None,
    max_examples: int | None = None,
    order: str = "seq",
    with_prompt: bool = True,
) -> DataFrame:
    """Two-candidate rows; the safer move of a pair is the target.

    The first examples stand in as many positions with pairs at most, which are found by counting, before pairs are formed.
    """
    if max_examples is not None:
        counts = pair_counts_by_position(best_candidates(rows, order), min_gap).where("gap_pairs + null_pairs > 0")
        seen = stored(counts.join(position_facts(rows, order), "fen").select("fen", "position_seq"), "positions")
        rows = rows.join(first_rows(seen, ["position_seq"], max_examples).select(F.col("fen").alias("fen_before")), "fen_before", "left_semi")
    pairs = candidate_pairs(rows, pairs_per_position, min_gap, order).join(position_facts(rows, order), "fen")
    if max_positions is not None:
        first = first_rows(pairs.groupBy("fen").agg(F.min("position_seq").alias("_s")), ["_s"], max_positions)
        pairs = pairs.join(first.select("fen"), "fen", "left_semi")
    if max_examples is not None:
        pairs = stored(pairs, "pairs")
    pairs = first_rows(pairs, ["position_seq", "pair_index"], max_examples)
    shown = _shown_pair([F.col("fen"), F.col("pair_index")], F.col("better"), F.col("worse"))
    out = pairs.select(
        "fen", "side_to_move", "position_seq", "pair_index", shown.alias("candidates"), F.col("better").alias("target"),
        labels.pair_risk_label(F.col("better.risk"), F.col("worse.risk")).alias("pair_risks"),
        F.col("gap").alias("pair_cpl_gap"),
    )
    return _finish(out, prompts.pairwise_prompt if with_prompt else None)


def _shown_pair(prefix: list[Column], left: Column, right: Column) -> Column:
    key = lambda c: F.sha2(F.concat_ws("|", *[p.cast("string") for p in prefix], c["uci"]), 256)
    return F.when(key(left) <= key(right), F.array(left, right)).otherwise(F.array(right, left))


def pair_drops(rows: DataFrame, pairs_per_position: int, min_gap: int, order: str = "seq") -> DataFrame:
    """Counters of the pairing: (metric, key, n). Nothing is paired to count."""
    c = pair_counts_by_position(best_candidates(rows, order), min_gap)
    no_safe, no_unsafe = F.col("n_safe") == 0, (F.col("n_safe") > 0) & (F.col("n_unsafe") == 0)
    valid = F.col("gap_pairs") + F.col("null_pairs")
    one = c.agg(
        F.count(F.lit(1)).alias("positions_seen"),
        count_if(valid > 0).alias("positions_with_pairs"),
        F.coalesce(F.sum(F.least(valid, F.lit(pairs_per_position))), F.lit(0)).alias("examples_written"),
        count_if(no_safe).alias("dropped_no_safe_candidate"),
        count_if(no_unsafe).alias("dropped_no_unsafe_candidate"),
        F.coalesce(F.sum("small_gap_pairs"), F.lit(0)).alias("dropped_small_gap_pairs"),
        F.coalesce(F.sum(F.greatest(valid - pairs_per_position, F.lit(0))), F.lit(0)).alias("dropped_pair_limit"),
    )
    return unpivot_counts(one)


# Comparisons ----------------------------------------------------------------------


def comparison_rows(
    choices: DataFrame,
    index: str = "choice_index",
    max_choice_rows: int | None = None,
    max_pair_rows: int | None = None,
    with_prompt: bool = True,
) -> DataFrame:
    """All unordered pairs of every choice list, in list order.

    A list holds at most the candidates shown in one prompt, so its pairs are few.
    """
    source = first_rows(choices, [index], max_choice_rows)
    n = F.size("candidates")
    positions = F.sequence(F.lit(0), n - 1)
    later = lambda i: F.filter(positions, lambda j: j > i)
    combos = F.flatten(F.transform(positions, lambda i: F.transform(later(i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pairs = source.where(n >= 2).select(
        "fen", "fen_before", "side_to_move", "split", F.col(index).alias("pair_source_choice_index"),
        F.col("move").alias("source_choice_move"), F.col("candidate_count").alias("source_choice_candidate_count"),
        "candidates", F.posexplode(combos).alias("pair_index", "p"),
    )
    pairs = first_rows(pairs, ["pair_source_choice_index", "pair_index"], max_pair_rows)
    item = lambda k: F.element_at("candidates", F.col(f"p.{k}") + 1)
    named = pairs.select("*", item("i").alias("l"), item("j").alias("r"))
    left_better = quality_key(F.col("l")) >= quality_key(F.col("r"))
    shown = _shown_pair([F.col("pair_source_choice_index"), F.col("pair_index")], F.col("l"), F.col("r"))
    out = named.select(
        "fen", "side_to_move", "pair_source_choice_index", "pair_index",
        F.array("l.uci", "r.uci").alias("pair_moves"), "source_choice_move", "source_choice_candidate_count",
        F.col("split").alias("_split"), shown.alias("candidates"),
        F.when(left_better, F.col("l")).otherwise(F.col("r")).alias("target"),
    )
    return _finish(out, prompts.pairwise_prompt if with_prompt else None, F.col("_split")).drop("_split", "target_san")


def hard_case_variants(cases: DataFrame, variants: int = 1, seed: int = 0, with_prompt: bool = True) -> DataFrame:
    """Regression rows from hard cases: the original order, then reshuffled ones.

    ``cases(example_index, categories, fen, side_to_move, predicted_move, target, candidates,
    cpl_regret_vs_oracle, cpl_delta_vs_first)``.
    """
    kept = cases.withColumn("dropped", hard_case_drop()).where(F.col("dropped").isNull())
    rows = kept.withColumn("hard_case_variant_index", F.explode(F.sequence(F.lit(0), F.lit(max(variants, 1) - 1))))
    shuffled = F.transform(
        F.array_sort(F.transform("candidates", lambda c: F.struct(
            hash_order(seed, F.col("example_index"), F.col("fen"), F.col("hard_case_variant_index"), c["uci"]).alias("h"),
            c.alias("c")))),
        lambda s: s["c"],
    )
    target_uci = F.col("target.uci")
    out = rows.select(
        "fen", "side_to_move", F.col("categories").alias("hard_case_categories"),
        F.col("example_index").alias("hard_case_example_index"), "hard_case_variant_index",
        F.col("predicted_move").alias("hard_case_selected_move"),
        F.col("cpl_regret_vs_oracle").alias("hard_case_cpl_regret_vs_oracle"),
        F.col("cpl_delta_vs_first").alias("hard_case_cpl_delta_vs_first"),
        F.when(F.col("hard_case_variant_index") == 0, F.col("candidates")).otherwise(shuffled).alias("candidates"),
        F.filter("candidates", lambda c: c["uci"] == target_uci)[0].alias("target"),
    )
    return _finish(out, prompts.choice_prompt if with_prompt else None, F.lit("hardcase_eval"))


def hard_case_counts(cases: DataFrame, variants: int = 1) -> DataFrame:
    """(metric, key, n) of the replay set: input, rows, drops by cause, categories, target risks."""
    marked = cases.withColumn("dropped", hard_case_drop())
    kept = marked.where(F.col("dropped").isNull())
    one = marked.agg(
        F.count(F.lit(1)).alias("input_hard_cases"),
        (count_if(F.col("dropped").isNull()) * max(variants, 1)).alias("rows_written"),
        count_if(F.col("dropped") == "too_few_candidates").alias("dropped_too_few_candidates"),
        count_if(F.col("dropped") == "missing_target").alias("dropped_missing_target"),
    )
    named = kept.select(F.explode("categories").alias("category"))
    return unpivot_counts(one).unionByName(counters(named, {"by_category": F.col("category")})).unionByName(
        counters(kept, {"by_target_risk": F.col("target.risk")})
    )


def comparison_counts(choices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(metric, key, n) of an expansion of all choice rows."""
    usable = F.size("candidates") >= 2
    one = choices.agg(
        F.count(F.lit(1)).alias("choice_rows_seen"), count_if(usable).alias("choice_rows_written"),
        count_if(~usable).alias("skipped_too_few_candidates"),
    )
    written = choices.where(usable)
    rows = pairs.agg(F.count(F.lit(1)).alias("pair_rows_written"))
    return (
        unpivot_counts(one).unionByName(unpivot_counts(rows))
        .unionByName(counters(written, {"by_split": F.col("split"), "by_choice_candidate_count": F.col("candidate_count")}))
        .unionByName(counters(pairs, {"by_pair_target_prompt_index": F.col("target_prompt_index")}))
    )


def hard_case_drop() -> Column:
    """Why a hard case cannot be replayed, or NULL."""
    known = F.exists("candidates", lambda c: c["uci"] == F.col("target.uci"))
    return F.when(F.size("candidates") < 2, "too_few_candidates").when(~F.coalesce(known, F.lit(False)), "missing_target")
