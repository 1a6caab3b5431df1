"""Checks of values as boolean columns, and the safe reading of written parameters. A null passes no check."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F


def _told(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def bounded(value: Column, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """Whether a number lies between two bounds; a missing bound does not bound."""
    inside = value.isNotNull() & ~F.isnan(value.cast("double"))
    if low is not None:
        inside &= value >= low if inclusive else value > low
    if high is not None:
        inside &= value <= high if inclusive else value < high
    return _told(inside)


def whole(value: Column, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """Whether a bounded number has no fraction."""
    return bounded(value, low, high, inclusive) & _told(value.cast("double") == F.floor(value.cast("double")))


def single_characters(text: Column) -> Column:
    """Whether a text can stand for a set of one-letter codes: not empty, no letter twice."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return _told((F.size(letters) > 0) & (F.size(F.array_distinct(letters)) == F.size(letters)))


def stands_for_none(text: Column) -> Column:
    """Whether a text stands for the absence of a value."""
    return text.isNull() | F.lower(F.trim(text)).isin("", "none", "null")


def camel_case(text: Column) -> Column:
    """Whether a text is a name of capitalised words without separators."""
    return _told(text.rlike(r"^(?:[A-Z][a-z0-9]*)+$"))


def coerced(text: str) -> object:
    """A written parameter as the value it stands for: numbers, booleans, None, lists and mappings, whose written numbers become
    numbers too; anything else stays text. Nothing is evaluated.
    """
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        value = {"true": True, "false": False, "none": None, "null": None}.get(text.strip().lower(), text)
    if isinstance(value, dict):
        return {k: coerced(v) if isinstance(v, str) else v for k, v in value.items()}
    return int(value) if isinstance(value, float) and value.is_integer() and text.strip().lstrip("+-").isdigit() else value
