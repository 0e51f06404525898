import os

import pytest
from pyspark.sql import functions as F

from plywise.operators import summaries
from plywise.sources import versions
from plywise.sources.versions import Versioned, groups, latest, replace_groups
from plywise.streaming import live


def rows(spark, values, schema="k long, v string"):
    return spark.createDataFrame(values, schema)


def content(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_a_number_is_used_once(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    assert table.rows() is None and table.numbers() == []
    assert table.append(rows(spark, [(1, "a")]), 3)
    assert not table.append(rows(spark, [(1, "again")]), 3) and not table.append(rows(spark, [(9, "late")]), 2)
    assert table.append(rows(spark, [(1, "b"), (2, "c")]), 4)
    assert content(latest(table.rows(), ["k"])) == [(1, "b"), (2, "c")]
    assert content(table.rows(upto=3).drop("part")) == [(1, "a")]


def test_parts_are_merged_and_old_folders_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN", 3)
    table, want = Versioned(spark, str(tmp_path / "t"), ["bucket"]), {}
    for i in range(14):
        new = {k: f"{i}" for k in ((i % 4, i, 50 + i % 2))}
        want |= new
        frame = rows(spark, [(k, v, k % 2) for k, v in new.items()], "k long, v string, bucket int")
        table.append(frame, i, lambda several: latest(several, ["k"]))
        assert {r["k"]: r["v"] for r in latest(table.rows(), ["k"]).collect()} == want
    assert len(table._list(13)["parts"]) <= 5
    assert len(os.listdir(tmp_path / "t" / "data")) <= 10 and table.numbers() == [12, 13]
    plan = table.rows(where=F.col("bucket") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert {r["k"] for r in table.rows(where=F.col("bucket") == 1).collect()} == {k for k in want if k % 2}


def test_readers_see_the_old_or_the_new_table(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    table.replace(rows(spark, [(1, "old"), (2, "old")]))
    before = table.rows()
    with pytest.raises(Exception, match="broken"):
        table.replace(rows(spark, [(1, "new")]).withColumn("v", F.raise_error(F.lit("broken")).cast("string")))
    assert content(table.rows().drop("part")) == [(1, "old"), (2, "old")]
    table.replace(rows(spark, [(3, "new")]))
    assert content(before.drop("part")) == [(1, "old"), (2, "old")]
    assert content(table.rows().drop("part")) == [(3, "new")]


def test_groups_are_replaced_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN", 3)
    table = Versioned(spark, str(tmp_path / "t"))
    want = {}
    for i in range(7):
        new = [(i % 3, f"{i}-{j}") for j in range(i % 2 + 1)]
        want[i % 3] = new
        replace_groups(rows(spark, new), table, "k")
        assert content(groups(table.rows(), "k")) == sorted((x for g in want.values() for x in g), key=str)


def test_two_writers_of_one_number(spark, tmp_path):
    one, two = Versioned(spark, str(tmp_path / "t")), Versioned(spark, str(tmp_path / "t"))
    two.numbers = lambda: []
    one.append(rows(spark, [(1, "one")]), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        two.append(rows(spark, [(1, "two")]), 0)
    assert content(one.rows().drop("part")) == [(1, "one")]


def test_nulls_and_no_rows(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"), ["bucket"])
    table.append(rows(spark, [], "k long, bucket int"), 0)
    assert content(table.rows().drop("part")) == []
    table.append(rows(spark, [(None, None), (1, 2)], "k long, bucket int"), 1)
    assert content(table.rows().drop("part")) == [(1, 2), (None, None)]


def landed(spark, folder, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return lambda: live.stream_files(spark, folder, spark.createDataFrame([], schema).schema, per_batch=1)


def test_newest_games_with_updates_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN", 3)
    batches, state = [], {}
    for b in range(7):
        batch = []
        for g in range(b * 3, b * 3 + 6):  # half of a batch are updates of the last one
            row = (g, g % 2, "*" if b % 2 else "1-0", g * 5 % 17, b)
            state[g] = row
            batch.append(row)
        batches.append(batch)
    schema = "game_id long, run_id long, result string, started_at int, ended_at int"
    folder, table, progress = (str(tmp_path / n) for n in ("landed", "table", "progress"))
    stream = landed(spark, folder, batches, schema)
    live.latest_games(stream(), table, progress, 5)
    want = sorted(state.values(), key=lambda r: (r[3], r[0]))[-5:]
    assert content(live.read_latest(spark, table)) == sorted(want, key=str)
    live.latest_games(stream(), table, progress, 5)  # nothing new has landed
    assert content(live.read_latest(spark, table)) == sorted(want, key=str)
    with pytest.raises(Exception, match="belongs to"):
        live.latest_games(stream(), table, progress + "-other", 5)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    many = [(g, g % 5, "*") for g in range(3000)]
    folder, table, progress = (str(tmp_path / n) for n in ("landed", "table", "progress"))
    stream = landed(spark, folder, [many, [(7, 2, "1-0")], [(7, 2, "*"), (8, 3, "0-1"), (9999, 3, "*")]], "game_id long, run_id long, result string")
    live.match_progress(stream(), table, progress)
    counts = {r["run_id"]: (r["games_started"], r["games_completed"]) for r in live.progress_counts(live.read_latest(spark, table)).collect()}
    assert counts == {0: (600, 0), 1: (600, 0), 2: (600, 1), 3: (601, 1), 4: (600, 0)}
    assert Versioned(spark, table).rows().where("part > 0").count() == 2


def test_summaries_grow_by_changes(spark, tmp_path):
    fact = lambda values, schema: spark.createDataFrame(values, schema)
    games = "game_id long, run_id long, white_participant_id long, black_participant_id long, result string, termination_reason string, ended_at int"
    batches = [
        [(1, 10, 1, 2, "*", "", 0), (2, 10, 1, None, "1-0", "checkmate", 0)],
        [(1, 10, 1, 2, "0-1", "forfeit_invalid", 1)],
        [(3, 20, 3, 4, "1/2-1/2", "checkmate", 2), (2, 10, 2, 1, "1-0", "checkmate", 2), (2, 10, 1, 2, "*", "", 1)],
    ]
    moves = fact([(g * 10 + p, g, "white" if p % 2 else "black", p, p * 1.25) for g in (1, 2, 3) for p in (1, 2, 3)],
                 "move_id long, game_id long, color string, retries_used int, latency_total_ms double")
    evaluated = fact([(11, 30, "good"), (12, 400, "blunder"), (21, None, "best")], "move_id long, centipawn_loss int, classification string")
    attempts = fact([(g * 10 + p, g, p, p != 2, p == 1) for g in (1, 2, 3) for p in (1, 2)], "attempt_id long, game_id long, ply int, parse_ok boolean, legal_ok boolean")
    tokens = fact([(11, 100), (22, 50)], "attempt_id long, total_tokens long")
    folder, table, progress = (str(tmp_path / n) for n in ("landed", "table", "progress"))
    measured = []

    def measure(batch):
        measured.append(sorted(r["game_id"] for r in batch.collect()))
        return summaries.side_measures(batch, moves, evaluated, attempts, tokens)

    live.grow_summaries(landed(spark, folder, batches, games)(), measure, table, progress)
    assert measured == [[1, 2], [1], [2, 3]]
    last = {r[0]: r for r in sorted((r for b in batches for r in b), key=lambda r: r[-1])}
    whole = summaries.total_measures(summaries.side_measures(fact(list(last.values()), games), moves, evaluated, attempts, tokens))
    assert content(live.read_summary_totals(spark, table).where("games_played > 0").select(*whole.columns)) == content(whole)
