"""Exact-match cache keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_PREFIX = "llm:cache:"  # fixed value


# to_json writes hex digits in upper case; only these control characters show a letter digit.
_LETTERED = "\\x0b\\x0e\\x0f\\x1a-\\x1f"


def _escaped(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(3), F.char_length(one) - 4)


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal: non-ASCII kept, control characters as lower-case hex."""
    pieces = F.regexp_extract_all(
        text, F.lit(f"[{_LETTERED}]|[^{_LETTERED}]+"), F.lit(0))
    piecewise = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(f"[{_LETTERED}]"), F.lower(_escaped(p))).otherwise(_escaped(p))),
        "")
    body = F.when(text.rlike(f"[{_LETTERED}]"), piecewise).otherwise(_escaped(text))
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_messages(messages="messages") -> Column:
    """Messages as JSON with sorted keys and ``", "``/``": "`` separators."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    each = F.transform(
        messages,
        lambda m: F.concat(
            F.lit('{"content": '), json_string(m["content"]),
            F.lit(', "role": '), json_string(m["role"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def l1_key(messages="messages", extra_key_cols: tuple = ()) -> Column:
    """Key of the exact tier. Model and user are not part of it unless asked for."""
    body = canonical_messages(messages)
    for c in extra_key_cols:
        body = F.concat(body, F.lit("\x1f"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat(F.lit(KEY_PREFIX), F.md5(body))
