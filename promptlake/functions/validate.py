"""Checks that a neighbour's answer may be reused: language, then numbers, then technology."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptlake.functions.text import _col, let, numbers, tech_keywords
from promptlake.rules import Rules

_RULES = Rules()


def _result(passed, reason) -> Column:
    return F.struct(F.lit(passed).alias("passed"), F.lit(reason).alias("reason"))


def check_language(query_lang="lang", entry_lang="entry_lang") -> Column:
    """Differing codes fail; an unknown code on either side passes."""
    q, e = F.coalesce(_col(query_lang), F.lit("")), F.coalesce(_col(entry_lang), F.lit(""))
    return (
        F.when((q == "") | (e == ""), _result(True, "lang_unknown_skip"))
        .when(q == e, _result(True, "lang_match"))
        .otherwise(_result(False, "lang_mismatch")))


def _check_sets(query_set: Column, entry_set: Column, name: str, none: str) -> Column:
    return let(query_set, lambda q: (
        F.when(F.size(q) == 0, _result(True, none))
        .when(q == entry_set, _result(True, f"{name}_match"))
        .otherwise(_result(False, f"{name}_mismatch"))))


def entry_numbers(keywords="entry_keywords") -> Column:
    """Numbers found again in the stored keywords."""
    return numbers(F.array_join(_col(keywords), " "))


def entry_tech(keywords="entry_keywords", rules: Rules = _RULES) -> Column:
    """Technology words found again in the stored keywords."""
    return tech_keywords(F.array_join(_col(keywords), " "), rules)


def check_numeric(text="query_text", keywords="entry_keywords") -> Column:
    """Numbers of the query, if any, must equal those of the entry."""
    return _check_sets(
        numbers(text), entry_numbers(keywords), "numeric", "no_numeric_in_query")


def check_tech(text="query_text", keywords="entry_keywords", rules: Rules = _RULES) -> Column:
    """Technology words of the query, if any, must equal those of the entry."""
    return _check_sets(
        tech_keywords(text, rules), entry_tech(keywords, rules),
        "tech_keyword", "no_tech_keyword_in_query")


def validate_sets(q_lang, e_lang, q_numbers, e_numbers, q_tech, e_tech) -> Column:
    """All checks over precomputed sets; the first failure gives the reason."""
    lang = check_language(q_lang, e_lang)
    # each check runs only if the one before passed
    num = _check_sets(_col(q_numbers), _col(e_numbers), "numeric", "no_numeric_in_query")
    tech = _check_sets(_col(q_tech), _col(e_tech), "tech_keyword", "no_tech_keyword_in_query")
    done = _result(True, "all_checks_passed")
    last = let(tech, lambda t: F.when(~t["passed"], t).otherwise(done))
    middle = let(num, lambda n: F.when(~n["passed"], n).otherwise(last))
    return let(lang, lambda g: F.when(~g["passed"], g).otherwise(middle))


def validate(text="query_text", lang="lang", entry_lang="entry_lang",
             keywords="entry_keywords", rules: Rules = _RULES) -> Column:
    """All checks over raw columns."""
    return validate_sets(
        lang, entry_lang, numbers(text), entry_numbers(keywords),
        tech_keywords(text, rules), entry_tech(keywords, rules))
