"""Expressions over request text: extraction, normalization, keywords, classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from promptlake.rules import Rules

_DEFAULT = Rules()

# Fixed patterns: ASCII word boundaries are spelt out, because the JVM's own \b treats
# letters of other scripts as word characters.
_NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
YEAR = _NOT_AFTER_WORD + r"(?:19|20)[0-9]{2}" + _NOT_BEFORE_WORD
VERSION = _NOT_AFTER_WORD + r"v?[0-9]+\.[0-9]+(?:\.[0-9]+)?" + _NOT_BEFORE_WORD


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body`` over ``value``, evaluated once however often the body uses it."""
    return F.transform(F.array(_col(value)), body)[0]


def query_text(messages="messages") -> Column:
    """Content of the last message, whatever its role; empty without messages."""
    return F.coalesce(F.try_element_at(_col(messages), F.lit(-1))["content"], F.lit(""))


def l2_eligible(text="query_text", max_chars: int = 300) -> Column:
    """Long prompts carry context of their own and skip the vector tier."""
    return F.char_length(_col(text)) <= max_chars


def normalize(text="query_text", rules: Rules = _DEFAULT) -> Column:
    """Replace known terms in one pass, longest term first, at ASCII word boundaries."""
    text = _col(text)
    terms = sorted(rules.term_map, key=len, reverse=True)
    if not terms:
        return text
    alternatives = "|".join(re.escape(t) for t in terms)
    term = f"(?i){_NOT_AFTER_WORD}(?:{alternatives}){_NOT_BEFORE_WORD}"
    # Cut the text into terms, other words and the rest, swap the terms, and join again.
    pieces = F.regexp_extract_all(
        text,
        F.lit(f"(?i)(?:{alternatives}){_NOT_BEFORE_WORD}|[A-Za-z0-9_]+|[^A-Za-z0-9_]+"),
        F.lit(0),
    )
    lookup = F.create_map(*[F.lit(x) for t in terms for x in (t, rules.term_map[t])])
    swapped = F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, F.lower(p)), p)), "")
    return F.when(text.rlike(term), swapped).otherwise(text)


def years(text="query_text") -> Column:
    """Four-digit years 1900-2099."""
    return _extract(text, "(?:19|20)[0-9]{2}", YEAR)


def versions(text="query_text") -> Column:
    """Version numbers such as 3.12 or v1.2.3."""
    return _extract(text, r"[0-9]\.[0-9]", VERSION)


def _extract(text, hint: str, pattern: str) -> Column:
    """All matches; texts without the plain ``hint`` skip the slower bounded pattern."""
    text = _col(text)
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def numbers(text="query_text") -> Column:
    """Sorted set of years and versions."""
    return F.array_sort(F.array_union(years(text), versions(text)))


def matched_words(text, words) -> Column:
    """Those of ``words`` that occur in the lower-cased text as substrings, sorted."""
    words = sorted(set(words))
    if not words:
        return F.array().cast("array<string>")
    return let(F.lower(_col(text)), lambda t: F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in words])))


def tech_keywords(text="query_text", rules: Rules = _DEFAULT) -> Column:
    """Technology words found as substrings, sorted."""
    return matched_words(text, rules.tech_words)


def extract_keywords(text="query_text", rules: Rules = _DEFAULT) -> Column:
    """Sorted set of years, versions and technology words."""
    return F.array_sort(F.array_union(numbers(text), tech_keywords(text, rules)))


def classify_query(text="query_text", rules: Rules = _DEFAULT) -> Column:
    """First class one of whose words occurs in the text; the last class is the default."""
    return _by_class(text, rules, 0)


def predict_output_tokens(text="query_text", rules: Rules = _DEFAULT) -> Column:
    """Upper estimate of the answer's tokens, by class."""
    return _by_class(text, rules, 1)


def _by_class(text, rules: Rules, item: int) -> Column:
    *ranked, default = rules.query_classes

    def first_class(lower):
        chain = F
        for cls in ranked:
            found = F.lit(False)
            for word in cls[2]:
                found = found | F.contains(lower, F.lit(word))
            chain = chain.when(found, F.lit(cls[item]))
        return chain.otherwise(F.lit(default[item]))

    return let(F.lower(_col(text)), first_class) if ranked else F.lit(default[item])


def mock_answer(text="query_text", model="model") -> Column:
    """Deterministic placeholder answer (fixed format)."""
    return F.concat(
        F.lit("[MOCK] '"), F.substring(_col(text), 1, 50),
        F.lit("...'에 대한 응답입니다. (model="), _col(model), F.lit(")"))
