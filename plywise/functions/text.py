"""Text, key and name helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and provider names of participant identities.
RERANKED_PREFIX = "reranked:"
DELIBERATIVE_PREFIX = "deliberative:"
PROVIDERS = ("openai", "anthropic", "gemini", "local")
ENGINE_NAME, RANDOM_NAME = "stockfish", "random"
COMPACT_LIMIT = 220


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column, limit: int = COMPACT_LIMIT) -> Column:
    """Collapse white space; cut long text to the limit with an ellipsis."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("..."))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(cut)


def listed(values: Column, limit: int | None = None) -> Column:
    """Sorted comma list; beyond the limit the rest is only counted."""
    ordered = F.array_sort(values)
    full = F.array_join(ordered, ", ")
    if limit is None or limit < 0:
        return full
    short = F.concat(
        F.array_join(F.slice(ordered, 1, limit), ", ") if limit else F.lit(""),
        F.lit(" ... ("),
        (F.size(values) - limit).cast("string"),
        F.lit(" more)"),
    )
    return F.when(F.size(values) > limit, short).otherwise(full)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; nothing for empty text."""
    length = F.char_length(text)
    return F.when(text.isNull() | (length == 0), 0).otherwise(((length + 3) / 4).cast("int"))


def usage(prompt: Column, response: Column, window: Column, prompt_tokens: Column,
          completion_tokens: Column, total_tokens: Column) -> Column:
    """Token usage that prefers reported numbers to estimates."""
    used_prompt = F.coalesce(prompt_tokens, estimate_tokens(prompt))
    used_completion = F.coalesce(completion_tokens, estimate_tokens(response))
    total = F.coalesce(total_tokens, used_prompt + used_completion)
    return F.struct(
        used_prompt.alias("prompt_tokens"),
        used_completion.alias("completion_tokens"),
        total.alias("total_tokens"),
        window.alias("estimated_context_window"),
        F.greatest(window - total, F.lit(0)).alias("estimated_context_remaining"),
    )


def lenient_int(value: Column) -> Column:
    """Integer text becomes an integer, anything else (also 'true' or '1.5') NULL."""
    cleaned = strip(value)
    return F.when(cleaned.rlike(r"^[+-]?[0-9]+$"), cleaned).try_cast("int")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def evaluation_key(fen: Column, uci: Column) -> Column:
    return F.sha2(F.concat(fen, F.lit("|"), uci), 256)


def example_key(prompt: Column, completion: Column) -> Column:
    return F.sha2(F.concat(prompt, F.lit("\x00"), completion), 256)


def base_identity(name: Column) -> Column:
    """Participant name without its strategy prefix (a bare prefix stays)."""
    pattern = f"^(?:{RERANKED_PREFIX}|{DELIBERATIVE_PREFIX})(.+)$"
    inner = F.regexp_extract(name, "(?s)" + pattern, 1)
    return F.when(inner != "", inner).otherwise(name)


def opponent_type(name: Column) -> Column:
    base = base_identity(name)
    return F.when(base.isin(RANDOM_NAME, ENGINE_NAME), base).otherwise("model")


def provider(name: Column) -> Column:
    head = F.substring_index(name, ":", 1)
    return F.when(F.contains(name, F.lit(":")) & head.isin(*PROVIDERS), head).otherwise("local")


def provider_model(name: Column) -> Column:
    """Model part of ``provider:model``; the whole name when the provider is unknown."""
    head = F.substring_index(name, ":", 1)
    known = F.contains(name, F.lit(":")) & head.isin(*PROVIDERS)
    return F.when(known, F.substr(name, F.char_length(head) + 2)).otherwise(name)


def assistant_text(messages: Column) -> Column:
    """Assistant contents of a chat, one per line."""
    own = F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].isNotNull())
    return F.array_join(F.transform(own, lambda m: m["content"]), "\n")


def _unit(number: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))


def _escaped(piece: Column) -> Column:
    """A run of ASCII as it is; another character as its UTF-16 code units, two for those beyond 0xFFFF."""
    code = F.ascii(piece).cast("long")
    high = code - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(high, 10)), _unit(F.lit(0xDC00) + high.bitwiseAND(F.lit(0x3FF))))
    return F.when(code < 0x80, piece).when(code < 0x10000, _unit(code)).otherwise(pair)


def ascii_escaped(json_text: Column) -> Column:
    """JSON text with non-ASCII characters as code units; only rows that have any are touched."""
    foreign = json_text.rlike(r"[^\x00-\x7F]")
    pieces = F.regexp_extract_all(json_text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.when(foreign, F.array_join(F.transform(pieces, _escaped), "")).otherwise(json_text)


def sorted_json(fields: dict[str, object]) -> Column:
    """JSON text of nested columns with sorted keys and ', ' / ': ' separators."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        value = fields[name]
        text = sorted_json(value) if isinstance(value, dict) else _json_value(value)
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), text]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _json_value(value: Column) -> Column:
    inner = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.regexp_replace(F.substr(inner, F.lit(2), F.char_length(inner) - 2), '","', '", "')
