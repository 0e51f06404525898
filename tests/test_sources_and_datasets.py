import json
import random

import pytest
from pyspark.sql import functions as F

from plywise.operators import datasets, reuse
from plywise.operators.ordering import dense_index, running_total
from plywise.schemas import ENGINE_RECORD
from plywise.sources import gamefiles, records


def game(event="Rated Blitz game", elo=2100, control="300+3", termination="Normal", plies=20, n=1):
    moves = " ".join(f"{i // 2 + 1}. m{i + 1}" if i % 2 == 0 else f"m{i + 1}" for i in range(plies))
    return (f'[Event "{event}"]\n[Site "s{n}"]\n[White "a"]\n[Black "b"]\n[WhiteElo "{elo}"]\n[BlackElo "2200"]\n'
            f'[TimeControl "{control}"]\n[Termination "{termination}"]\n[Result "1-0"]\n\n{moves} 1-0\n')


def test_read_games_and_funnel(spark, tmp_path):
    (tmp_path / "a.pgn").write_text("\n".join([
        game("Rated Bullet game", n=1), game("Casual Blitz game", n=2), game(elo=1999, n=3), game(n=4)]))
    odd = '[Event "x"]\n[Event "y"]\n[Site "a \\"q\\" b"]\n\n1. e4 {c 1. d4} (1. d4 (1. c4) d5) e5! 2. Nf3 $1 ; rest\n2... Nc6?? *\n'
    (tmp_path / "b.pgn").write_text(odd)
    games = gamefiles.read_games(spark, str(tmp_path)).withColumn("plies", F.size("moves")).orderBy("source_game_index").collect()
    assert [g.source_game_index for g in games] == [1, 2, 3, 4, 5]
    assert games[3].moves == [f"m{i}" for i in range(1, 21)] and games[3].headers["Site"] == "s4"
    assert games[4].moves == ["e4", "e5", "Nf3", "Nc6"] and games[4].headers["Event"] == "y"
    df = spark.createDataFrame([(g.source_game_index, g.headers, g.plies) for g in games[:4]], "i long, h map<string,string>, plies int")
    reason = datasets.skip_reason(F.col("h"), F.col("plies"), 2000, 10)
    out = [r[0] for r in df.orderBy("i").select(reason).collect()]
    assert out == ["time_control_too_fast_or_unknown", "unrated", "elo_below_threshold_or_missing", None]


def test_capped_samples_resamples_the_boundary_game(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randrange(1, 30)) for i in range(1, 400)]
    df = spark.createDataFrame(sizes, "source_game_index long, plies int").repartition(7)
    out = datasets.capped_samples(df, 6, 1000).orderBy("source_game_index").collect()
    expected, total = [], 0
    for index, plies in sizes:
        if total >= 1000:
            break
        k = min(6, 1000 - total)
        picks = (list(range(plies)) if k >= plies else [plies // 2] if k == 1
                 else sorted({round(i * (plies - 1) / (k - 1)) for i in range(k)}))
        expected.append((index, picks))
        total += len(picks)
    assert [(r.source_game_index, r.sample_indices) for r in out] == expected
    assert sum(len(r.sample_indices) for r in out) == 1000


def test_prefix_sums_and_indices(spark):
    rng = random.Random(2)
    keys = sorted(rng.sample(range(10**7), 500))
    values = [rng.randrange(9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, values)), "k long, v long").repartition(5)
    out = running_total(df, "k", "v", "before", width=1000).orderBy("k").collect()
    assert [r.before for r in out] == [sum(values[:i]) for i in range(len(values))]
    assert [r.n for r in dense_index(df, "k", "n", width=777).orderBy("k").collect()] == list(range(500))


def test_splits_are_by_game_and_stable(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("game_id"))
    mark = lambda d: d.withColumn("split", datasets.game_split(F.col("game_id"), 0.25, 9)).distinct()
    one, two = mark(df).collect(), mark(df.repartition(13)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 400
    assert 60 < sum(r.split == "val" for r in one) < 140
    everything = df.withColumn("split", datasets.game_split(F.col("game_id"), 1.0, 9)).select("split").distinct().collect()
    assert [r.split for r in everything] == ["val"]


def test_json_lines_blank_strict_and_limit(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a":1}\n\n   \n{"a":2,"b":"x"}\n{"a":3}\n')
    df = records.read_jsonl(spark, str(path), "a INT, b STRING", strict=True)
    assert sorted(r.a for r in df.collect()) == [1, 2, 3]
    assert sorted(r.a for r in records.read_jsonl(spark, str(path), "a INT, b STRING").where("a is not null").collect()) == [1, 2, 3]
    lines = records.numbered_lines(spark, str(path))
    assert sorted(r.line_index for r in lines.collect()) == [0, 1, 2, 3, 4]
    assert [json.loads(r.value)["a"] for r in records.first_lines(lines, 4).orderBy("line_index").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a INT", strict=True).collect()


def test_external_candidates(spark):
    texts = ['{"fen_before":"","fen":"f","uci":"e2e4","candidate_rank_in_generator":"2"}', '{"fen":"f","move":5}', "[1]", '{"fen":"f","candidate_uci":"a","source":"","candidate_rank_in_generator":true}',
             '{"fen":"f","move":"b","candidate_rank_in_generator":1.5,"generator_idea":"i"}', "broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_index long, value string")
    out = records.external_candidates(df).orderBy("line_index").collect()
    assert [(r.candidate_uci, r.source, r.candidate_rank_in_generator, r.generator_idea) for r in out] == [
        ("e2e4", "policy_sample", 2, None), ("a", "policy_sample", None, None), ("b", "policy_sample", None, "i")]


def test_prediction_files_keep_order(spark, tmp_path):
    for name, moves in (("second", "ab"), ("first", "c")):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"fen": m, "centipawn_loss": 300}) + "\n" for m in moves))
    df = records.read_prediction_files(spark, [str(tmp_path / "second.jsonl"), str(tmp_path / "first.jsonl")], "fen STRING, centipawn_loss INT")
    assert [(r.fen, r.gate_source) for r in df.orderBy("file_ord", "line_ord").collect()] == [("a", "second"), ("b", "second"), ("c", "first")]


def test_cache_counts_each_new_request_once(spark):
    line = lambda k, cpl: json.dumps({"key": k, "evaluation": {"classification": "good", "centipawn_loss": cpl}})
    import hashlib

    key = hashlib.sha256(b"f|e2e4").hexdigest()
    lines = spark.createDataFrame([(0, line(key, 5)), (1, "{bad"), (2, line(key, 120)), (3, "{}")], "line_index long, value string")
    cache = reuse.load_cache(lines, ENGINE_RECORD)
    assert [(r.key, r.evaluation.centipawn_loss) for r in cache.collect()] == [(key, 120)]
    requests = spark.createDataFrame([("f", "e2e4"), ("f", "g1f3"), ("f", "g1f3"), ("g", "e2e4")], "fen string, uci string")
    s = reuse.cache_stats(requests, cache).first()
    assert (s.requests, s.cache_misses, s.cache_hits) == (4, 2, 2)


def test_relabel_modes(spark):
    rows = [(0, "p", "a", "A", "ca", "b", "B", 30, "good"), (1, "p", "c", "C", "cc", "b", "B", 130, "inaccuracy"), (2, "q", "a", "A", "ca", None, None, None, "mate_missed"),
            (3, "r", "a", "A", "ca", "a", "A", None, "mate_position"), (4, "s", "a", "A", "ca", None, None, None, None)]
    df = spark.createDataFrame(rows, "line_index long, prompt string, move string, san string, completion string, best_move_uci string, best_move_san string, human_centipawn_loss int, human_classification string")
    distill = datasets.relabelled(df, "distill").orderBy("line_index").collect()
    assert [(r.line_index, r.move, r.completion) for r in distill] == [(0, "b", '{"move":"b"}'), (3, "a", '{"move":"a"}')]
    assert [r.line_index for r in datasets.relabelled(df, "filter").orderBy("line_index").collect()] == [0, 3]
    s = datasets.relabel_stats(df, "distill").first()
    assert (s.rows_read, s.rows_written, s.dropped_duplicate, s.dropped_no_best_move, s.dropped_invalid_row, s.human_matches_engine) == (5, 2, 1, 1, 1, 1)
    assert s.human_engine_agreement_rate == 0.2 and s.human_avg_cpl == 80.0


def test_position_page(spark):
    moves = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "fen string, seq long").withColumn("origin", F.lit("arena_db"))
    assert datasets.page_positions([moves]).count() == 2
    assert [r.fen for r in datasets.page_positions([moves], offset=1, max_positions=1).collect()] == ["b"]


def test_mining_guards(spark):
    with pytest.raises(ValueError):
        datasets.mined_errors(None, None, None, None, run_ids=None, blunders=False, mate_missed=False, high_mistakes=False)
    with pytest.raises(ValueError):
        datasets.mined_errors(None, None, None, None, run_ids=[])


def test_prediction_folder_keeps_file_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0.jsonl").write_text('{"fen":"a"}\n')
    (folder / "part-1.jsonl").write_text("".join(f'{{"fen":"b{i:04d}"}}\n' for i in range(2000)))
    df = records.read_prediction_files(spark, [str(folder)], "fen STRING")
    assert [r.fen for r in df.orderBy("file_ord", "line_ord").collect()] == ["a", *(f"b{i:04d}" for i in range(2000))]
