"""Game records in portable notation: a block of header tags, then the movetext."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.functions.responses import evaluated_once
from plywise.functions.text import ascii_escaped, strip
from plywise.operators.ordering import dense_index_by

RECORD_START = "[Event "
_HEADER_BLOCK = r'\A((?:\s*\[\w+\s+"[^\n]*"\]\s*\n)*+)'


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Games of text files, split on the header of the next game (splittable scan)."""
    raw = (
        spark.read.option("lineSep", "\n\n" + RECORD_START)
        .text(path)
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    whole = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(
        F.concat(F.lit(RECORD_START), F.col("value"))
    )
    records = raw.where(strip(F.col("value")) != "").withColumn("record", strip(whole))
    indexed = dense_index_by(records, ["_file", "_start"], [F.col("_id")], "source_game_index", start=1)
    return parse_games(indexed.select("source_game_index", "record"), "record")


def parse_games(df: DataFrame, record: str) -> DataFrame:
    """Add ``headers`` (tag map, the last value of a repeated tag) and ``moves`` (mainline
    tokens without comments, numbers, annotations, results and side lines) from a record.

    The text is cut in steps whose results are columns, so later filters and element-wise
    functions read arrays instead of running the patterns again.
    """
    raw = F.col(record)
    block = F.regexp_extract(raw, _HEADER_BLOCK, 1)
    cut = evaluated_once(
        df,
        _lines=F.filter(F.split(block, r"\]\s*\n"), lambda x: F.contains(x, F.lit('"'))),
        _tokens=_tokens(F.substr(raw, F.char_length(block) + 1)),
    )
    name = lambda x: F.trim(F.replace(F.substring_index(x, '"', 1), F.lit("["), F.lit("")))
    inner = lambda x: F.substr(x, F.instr(x, '"') + 1, F.char_length(x) - F.instr(x, '"') - F.instr(F.reverse(x), '"'))
    pairs = F.transform("_lines", lambda x: F.struct(name(x).alias("key"), inner(x).alias("value")))
    count = lambda mark, i: F.size(F.filter(F.slice("_tokens", 1, i + 1), lambda t: t == mark))
    top_level = F.filter("_tokens", lambda t, i: ~t.isin("(", ")") & (count("(", i) == count(")", i)))
    split = evaluated_once(
        cut, _pairs=pairs, _names=F.transform("_lines", name),
        moves=F.when(F.array_contains("_tokens", "("), top_level).otherwise(F.col("_tokens")),
    )
    last = F.filter("_pairs", lambda p, i: ~F.array_contains(F.slice("_names", i + 2, F.size("_names")), p["key"]))
    unique = F.size(F.array_distinct("_names")) == F.size("_names")
    tags = F.map_from_entries(F.when(unique, F.col("_pairs")).otherwise(last))
    return evaluated_once(split, headers=tags).drop(record, "_lines", "_tokens", "_pairs", "_names")


def _tokens(movetext: Column) -> Column:
    """Movetext tokens, with parentheses as tokens of their own."""
    text = F.regexp_replace(movetext, r"(?s)\{.*?\}|(?m);[^\n]*$|(?m)^%[^\n]*$", " ")
    text = F.regexp_replace(text, r"([()])", " $1 ")
    text = F.regexp_replace(text, r"\$\d+|[!?]+", " ")
    text = F.when(movetext.rlike(r"[{;%()$!?]"), text).otherwise(movetext)
    numbered = F.regexp_replace(text, r"(?<![\w-])\d+\.+", " ")
    return F.filter(F.split(F.trim(numbered), r"\s+"), lambda t: ~t.isin("", "1-0", "0-1", "1/2-1/2", "*"))


def tag(headers_: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(headers_, F.lit(name)), F.lit(default))


def player_tag(record: Column, name: str) -> Column:
    """Trimmed header value of a stored record; unknown ('?') and blank read as NULL."""
    value = strip(F.regexp_extract(record, rf'(?m)^\[{name} "(.*)"\]$', 1))
    return F.when(value.isNotNull() & ~value.isin("", "?"), value)


def game_key(headers_: Column, moves: Column) -> Column:
    """16 hex digits over the sorted identity of a game."""
    identity = F.struct(
        tag(headers_, "Black", "?").alias("black"),
        tag(headers_, "Date", "?").alias("date"),
        moves.alias("moves"),
        tag(headers_, "Round", "?").alias("round"),
        tag(headers_, "Site", "?").alias("site"),
        tag(headers_, "White", "?").alias("white"),
    )
    return F.substring(F.sha2(ascii_escaped(F.to_json(identity)), 256), 1, 16)


def source_struct(headers_: Column) -> Column:
    # Output field and the header tag behind it.
    names = {
        "event": "Event", "site": "Site", "date": "Date", "round": "Round", "white": "White", "black": "Black",
        "white_elo": "WhiteElo", "black_elo": "BlackElo", "time_control": "TimeControl", "termination": "Termination",
    }
    return F.struct(*[tag(headers_, header, "?").alias(field) for field, header in names.items()])
