"""Validation of raw model responses. Parsing stays on the JVM (VARIANT); a small Arrow
helper looks for the JSON object of those rows that have one buried in other text. All rows pass
through it, the others as NULL."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plywise.functions.labels import RISK_ORDER
from plywise.functions.text import strip

# Error name and reasons of a rejected response.
MALFORMED = "malformed_json"
ILLEGAL = "illegal_move"
DELIBERATIVE = "llm_deliberative"
NO_JSON = "Response does not contain JSON"
NOT_JSON = "Response is not JSON"
NOT_OBJECT = "Response JSON must be an object"
NO_MOVE = "Response must contain a non-empty move"

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|["{}]', re.DOTALL)


def balanced_object(text: str) -> str | None:
    """First brace-balanced object of a text; braces inside JSON strings do not count."""
    start = text.find("{")
    depth = 0
    for token in _TOKEN.finditer(text, start) if start >= 0 else ():
        piece = token.group()
        if piece == '"':
            return None
        depth += {"{": 1, "}": -1}.get(piece, 0)
        if depth == 0:
            return text[start : token.end()]
    return None


def _no_number(name: str) -> None:
    """NaN and the infinities, which only a lenient parser takes, become null, so the object stays JSON."""


def _object_text(text: str | None) -> str | None:
    """'' = JSON of another kind, '!' = an object that is not JSON, NULL = no object."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_no_number)
    except ValueError:
        part = balanced_object(text)
        if part is None:
            return None
        try:
            value = json.loads(part, parse_constant=_no_number)
        except ValueError:
            return "!"
    return json.dumps(value) if isinstance(value, dict) else ""


@F.pandas_udf(StringType())
def _buried_object(texts: pd.Series) -> pd.Series:
    return texts.map(_object_text, na_action="ignore")


def unfenced(text: Column) -> Column:
    """Trimmed response without a surrounding code fence."""
    trimmed = strip(text)
    fence = r"(?is)\A```(?:json)?\s*(.*?)\s*```\z"
    return F.when(trimmed.rlike(fence), strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)


def _typed(value: Column, path: str, kind: str) -> Column:
    part = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(part) == kind, F.try_variant_get(value, path, "string"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    The optimizer does not push filters below a generator, so later predicates on these columns
    read them instead of repeating the (expensive) expressions.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the JSON object of a text column as VARIANT (NULL when there is none) and, as
    ``<out>_scan``, what the scan of the rows that do not parse directly found.

    Each step is its own projection: an expensive expression that is used several times stays
    a column, so every response is parsed once.
    """
    t = F.col(text)
    # From the first to the last brace; where that parses, it is the first balanced object. A text that has a brace and is
    # JSON of another kind starts with a quote or a bracket.
    start, end = F.instr(t, "{"), F.char_length(t) - F.instr(F.reverse(t), "}") + 1
    outer = F.when((start > 0) & ~t.rlike(r'^[\s"\[]') & F.contains(t, F.lit("}")) & (end > start), F.substr(t, start, end - start + 1))
    whole = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
    staged = df.withColumn("_outer", F.when(whole, t).otherwise(outer)).withColumn("_direct", F.try_parse_json("_outer")).drop("_outer")
    needs_scan = F.col("_direct").isNull() & F.contains(F.col(text), F.lit("{"))
    scanned = staged.withColumn(f"{out}_scan", _buried_object(F.when(needs_scan, F.col(text))))
    found = F.when(~F.col(f"{out}_scan").isin("", "!"), F.col(f"{out}_scan"))
    return scanned.withColumn(out, F.coalesce(F.col("_direct"), F.try_parse_json(found))).drop("_direct")


def validated_moves(df: DataFrame, raw: str = "raw_response", prefix: str = "") -> DataFrame:
    """Add move, parse_ok, error_type, reason, rationale and strategy_update of a response."""
    staged = with_object(df.withColumn("_text", unfenced(F.col(raw))), "_text", "_object")
    value, scan, text = F.col("_object"), F.col("_object_scan"), F.col("_text")
    named = staged.withColumns({
        "_move": strip(_typed(value, "$.move", "STRING")),
        "_update": F.try_variant_get(value, "$.strategy_update", "variant"),
    })
    move = F.col("_move")
    ok = F.coalesce(move != "", F.lit(False))
    other_json = ~F.contains(text, F.lit("{")) & F.try_parse_json(text).isNotNull() & text.rlike(r'^["\[0-9tfn-]')
    reason = (
        F.when(ok, F.lit(None).cast("string"))
        .when(value.isNotNull(), NO_MOVE)
        .when((scan == "") | other_json, NOT_OBJECT)
        .when(scan == "!", NOT_JSON)
        .otherwise(NO_JSON)
    )
    out = {
        "move": F.when(ok, move), "parse_ok": ok, "error_type": F.when(~ok, MALFORMED), "reason": reason,
        "rationale": F.when(ok, strip(_typed(value, "$.rationale", "STRING"))),
        "strategy_update": F.when(ok & _is_object(F.col("_update")), F.to_json(F.col("_update"))),
    }
    done = named.withColumns({prefix + k: v for k, v in out.items()})
    return done.drop("_text", "_object", "_object_scan", "_move", "_update")


def validated_critics(df: DataFrame, raw: str = "raw_response", out: str = "predicted") -> DataFrame:
    """Add struct<risk, blunder, score, reason_type> found between the outermost braces, or NULL."""
    text = F.col(raw)
    start = F.instr(text, "{")
    end = F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    inside = F.when((start > 0) & F.contains(text, F.lit("}")) & (end > start), F.substr(text, start, end - start + 1))
    value = F.col("_critic")
    staged = df.withColumn("_critic", F.try_parse_json(inside)).withColumns({
        "_risk": _typed(value, "$.risk", "STRING"),
        "_blunder": _typed(value, "$.blunder", "BOOLEAN").try_cast("boolean"),
        # A JSON boolean passes for a whole number.
        "_score": F.coalesce(
            _typed(value, "$.score", "BIGINT").try_cast("bigint"),
            _typed(value, "$.score", "BOOLEAN").try_cast("boolean").cast("bigint"),
        ),
        "_reason": _typed(value, "$.reason_type", "STRING"),
    })
    parts = [F.col(c) for c in ("_risk", "_blunder", "_score", "_reason")]
    valid = parts[0].isin(*RISK_ORDER) & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    score = F.greatest(F.least(parts[2], F.lit(100)), F.lit(0)).cast("int")
    record = F.struct(parts[0].alias("risk"), parts[1].alias("blunder"), score.alias("score"), parts[3].alias("reason_type"))
    return staged.withColumn(out, F.when(valid, record)).drop("_critic", "_risk", "_blunder", "_score", "_reason")


def listed_candidates(df: DataFrame, raw: str = "raw_response", out: str = "items") -> DataFrame:
    """Add array<struct<pos, move, idea>> of the ``candidates`` list; moves trimmed, lower-case."""
    staged = with_object(df.withColumn("_text", strip(F.col(raw))), "_text", "_object")
    items = F.try_variant_get(F.col("_object"), "$.candidates", "array<variant>")
    parsed = F.transform(
        items,
        lambda item, i: F.struct(
            i.alias("pos"),
            F.lower(strip(_typed(item, "$.move", "STRING"))).alias("move"),
            _typed(item, "$.idea", "STRING").alias("idea"),
        ),
    )
    listed = evaluated_once(staged, **{out: F.filter(parsed, lambda c: c["move"].isNotNull())})
    return listed.drop("_text", "_object", "_object_scan")


def deliberations(df: DataFrame, metadata: str = "reranker_metadata") -> DataFrame:
    """Add ``items`` array<struct<pos, uci, mode>> of deliberation records (NULL for others) and
    ``ideas`` array<struct<move, idea>> from the raw candidate answer stored inside."""
    record, answer = F.col("_record"), F.col("_answer")
    text = F.coalesce(
        _typed(record, "$.candidate_raw_response", "STRING"),
        F.to_json(F.try_variant_get(record, "$.candidate_raw_response", "variant")),
    )
    staged = evaluated_once(df, _record=F.try_parse_json(F.col(metadata))).withColumn("_answer", F.try_parse_json(text))
    staged = staged.withColumns({"_mode": _typed(record, "$.mode", "STRING"), "_regime": _typed(record, "$.regime", "STRING")})
    moves = F.try_variant_get(record, "$.candidate_legal_moves", "array<variant>")
    listed = F.filter(
        F.transform(moves, lambda m, i: F.struct(
            i.alias("pos"), _typed(m, "$", "STRING").alias("uci"), F.col("_mode").alias("mode"))),
        lambda c: c["uci"].isNotNull(),
    )
    raw = F.try_variant_get(answer, "$.candidates", "array<variant>")
    ideas = F.filter(
        F.transform(raw, lambda c: F.struct(
            _typed(c, "$.move", "STRING").alias("move"), _typed(c, "$.idea", "STRING").alias("idea"))),
        lambda c: c["move"].isNotNull(),
    )
    done = evaluated_once(staged, items=F.when(F.col("_regime") == DELIBERATIVE, listed), ideas=ideas)
    return done.drop("_record", "_answer", "_mode", "_regime")


def pair_decisions(df: DataFrame, left: str, right: str, raw: str = "raw_response") -> DataFrame:
    """Add the move each answer votes for: the named one of the two, else the left, and why."""
    parsed = validated_moves(df, raw, "_answer_")
    answer = F.lower(F.col("_answer_move"))
    named = F.coalesce(F.col("_answer_parse_ok") & answer.isin(F.col(left), F.col(right)), F.lit(False))
    reason = (
        F.when(named, F.lit(None).cast("string"))
        .when(F.col("_answer_parse_ok"), "parsed_move_not_pair_candidate")
        .otherwise(F.col("_answer_error_type"))
    )
    return parsed.withColumns({
        "selected_uci": F.when(named, answer).otherwise(F.col(left)), "parsed_move": F.col("_answer_move"),
        "parse_ok": F.col("_answer_parse_ok"), "candidate_ok": named, "fallback_reason": reason,
    }).drop(*[f"_answer_{c}" for c in ("move", "parse_ok", "error_type", "reason", "rationale", "strategy_update")])


def critic_summaries(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add best_reply, risk, blunder_suspected and critic_reason; unusable fields get defaults."""
    staged = with_object(df.withColumn("_text", strip(F.col(raw))), "_text", "_object")
    value = F.col("_object")
    return staged.withColumns({
        "best_reply": F.lower(strip(_typed(value, "$.best_reply", "STRING"))),
        "risk": F.coalesce(_typed(value, "$.risk", "STRING"), F.lit("unknown")),
        "blunder_suspected": _typed(value, "$.blunder_suspected", "BOOLEAN").try_cast("boolean"),
        "critic_reason": _typed(value, "$.reason", "STRING"),
    }).drop("_text", "_object", "_object_scan")


# Helpers travel with the functions that use them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
