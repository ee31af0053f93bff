"""Answer matching rules as native Column expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The competencies each matching rule serves, and the phrases that count as a refusal.
NUMERIC_TYPES = [
    "retrieval", "update", "aggregation", "cross_category", "ratio", "delta", "counterfactual",
    "relationship_hop", "relationship_chain", "temporal_extreme", "relationship_count", "multi_constraint",
]
NAME_VALUE_TYPES = ["synthesis", "conditional", "comparison", "multi_hop", "outlier"]
ENTITY_TYPES = ["text_match", "enum_filter", "relationship_lookup", "relationship_filter"]
REFUSAL_PHRASES = [
    "abstain", "don't know", "dont know", "do not know", "not available", "no information", "no data",
    "cannot determine", "can't determine", "insufficient data", "not mentioned", "no record", "not found",
    "no such", "unknown", "n/a", "i don't have", "i dont have", "could not find", "couldn't find",
    "no matching", "does not exist", "doesn't exist",
]
# White space that a strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Thresholds and patterns of the matching rules.
FLOAT_TOLERANCE = 0.02
TOKEN_SHARE = 0.67
LENGTH_SHARE = 0.5

NUMBER = r"(-?(?:\d+\.?\d*|\.\d+))\s*([KkMm])?"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TITLE = r"(?i)^(dr|mr|mrs|ms|prof|sr|jr)\.?\s+"
PAREN_TAIL = r"\s*\([^)]*\)\s*$"
NAME_VALUE = r"^(.+?)\s*\(([^)]+)\)\s*$"


def strip(text: Column | str) -> Column:
    """Without white space at both ends: newlines, tabs and the Unicode spaces as well as blanks."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def number_text(text: Column) -> Column:
    """First number with its suffix, after dropping thousands commas and dollar signs; empty if none."""
    return F.regexp_extract(strip(F.translate(text, ",$", "")), NUMBER, 0)


def number_value(found: Column) -> Column:
    return F.translate(found, "KkMm \t\n\r\f", "").try_cast("double")


def number_suffix(found: Column) -> Column:
    """K or M right behind the number, else an empty string."""
    last = F.upper(F.right(found, F.lit(1)))
    return F.when(last.isin("K", "M"), last).otherwise("")


def suffix_factor(found: Column) -> Column:
    s = number_suffix(found)
    return F.when(s == "K", 1000.0).when(s == "M", 1000000.0).otherwise(1.0)


def number_goal(truth: Column) -> Column:
    """A truth as a number: directly, or the first number of a formatted one."""
    bare = strip(truth)
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast("double")).otherwise(number_value(number_text(truth)))


def numbers_agree(plain: Column, scaled: Column, goal: Column, truth: Column) -> Column:
    """Whole truths need the same whole number; truths with a dot allow 2 % either way.

    The number counts with its K/M multiplied in or taken as a label.
    """
    whole = ~F.contains(truth, F.lit("."))

    def close(value: Column) -> Column:
        return (
            F.when(whole, F.rint(value) == F.rint(goal))
            .when(goal == 0, value == 0)
            .otherwise(F.abs(value - goal) / F.abs(goal) <= FLOAT_TOLERANCE)
        )

    return F.coalesce(close(scaled) | close(plain), F.lit(False))


def numeric_match(answer: Column, truth: Column) -> Column:
    found = number_text(answer)
    plain = number_value(found)
    return numbers_agree(plain, plain * suffix_factor(found), number_goal(truth), truth)


def bare_name(name: Column) -> Column:
    """Name without a title in front and a parenthesis behind."""
    return strip(F.regexp_replace(F.regexp_replace(name, PAREN_TAIL, ""), TITLE, ""))


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def names_agree(said: Column, goal: Column, said_tokens: Column, goal_tokens: Column) -> Column:
    """At least 67 % of the truth's tokens occur, and the answer is at least half as long."""
    hits = F.size(F.filter(goal_tokens, lambda t: F.array_contains(said_tokens, t)))
    return F.coalesce(
        F.when(F.size(goal_tokens) == 0, F.lower(said) == F.lower(goal))
        .when(F.length(said) < F.length(goal) * LENGTH_SHARE, F.lit(False))
        .otherwise(hits / F.size(goal_tokens) >= TOKEN_SHARE),
        F.lit(False),
    )


def entity_match(answer: Column, truth: Column) -> Column:
    goal, said = bare_name(truth), bare_name(answer)
    return names_agree(said, goal, name_tokens(said), name_tokens(goal))


def name_value_match(answer: Column, truth: Column) -> Column:
    """``Name (value)`` needs both parts; a truth without a value needs the name."""
    goal = strip(truth)
    name = F.regexp_extract(goal, NAME_VALUE, 1)
    value = F.regexp_extract(goal, NAME_VALUE, 2)
    return F.when(
        goal.rlike(NAME_VALUE), entity_match(answer, strip(name)) & numeric_match(answer, strip(value))
    ).otherwise(entity_match(answer, goal))


def abstention_match(answer: Column) -> Column:
    """A refusal phrase and no digit."""
    low = F.lower(answer)
    refused = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        refused = refused | F.contains(low, F.lit(phrase))
    return F.coalesce(refused & ~low.rlike(r"\p{Nd}"), F.lit(False))
