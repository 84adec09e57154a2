"""Column functions over text fields, tokens and keyword arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a text field.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
DIGITS_PATTERN = r"^\p{Nd}*\z"


def fields(line: Column, sep: str = " ") -> Column:
    """Fields of a line; empty fields at the end of the line are not counted.

    A line of separators only has no field, an empty line one, which is empty.
    """
    body = F.rtrim(line, F.lit(sep))
    none = F.array().cast("array<string>")
    return F.when((body == "") & (line != ""), none).otherwise(F.split(body, re.escape(sep)))


def has_fields(arr: Column, n: int) -> Column:
    return F.size(arr) >= n


def is_all_digits(c: Column) -> Column:
    """True when every character is a digit, so also for the empty string."""
    return c.rlike(DIGITS_PATTERN)


def to_double(c: Column) -> Column:
    """Number or null; never fails, and takes no suffixes such as ``1.2d``."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def to_long(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), c.try_cast("bigint"))


def to_int(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), c.try_cast("int"))


def prefix_double(c: Column, n: int = 8) -> Column:
    """Number read from the first ``n`` characters of a text field."""
    return to_double(F.substring(c, 1, n))


def non_empty(c: Column) -> Column:
    return F.length(c) > 0


def distinct_words(words: Column) -> Column:
    return F.array_distinct(words)


def shared_words(w1: Column, w2: Column) -> Column:
    """Distinct words found in both arrays (case-sensitive), in word order."""
    return F.sort_array(F.array_intersect(w1, w2))


def any_shared_word(w1: Column, w2: Column) -> Column:
    return F.arrays_overlap(w1, w2)
