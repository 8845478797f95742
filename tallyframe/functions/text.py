"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns the text filters must match.
THREE_NON_VOWELS = "[^aeiouAEIOU]{3}"
ENDS_WITH_VOWEL = "[aeiouAEIOU]$"
ENDS_WITH_E = "[eE]$"


def matches_like(column: Column, pattern: str, ci: bool = False) -> Column:
    """LIKE with ``%`` and ``_``; ``ci`` ignores case."""
    return column.ilike(pattern) if ci else column.like(pattern)


def is_present(column: Column) -> Column:
    """Neither NULL nor blank."""
    return column.isNotNull() & (F.trim(column) != "")


def letter_group(column: Column, other: str = "other") -> Column:
    """Bucket by first letter: A-M, N-Z, anything else."""
    first = F.upper(F.left(column, F.lit(1)))
    return (
        F.when(first.between("A", "M"), "Group A-M").when(first.between("N", "Z"), "Group N-Z").otherwise(other)
    )


def centre_pad(column: Column, right_width: int, total_width: int, fill: str) -> Column:
    return F.lpad(F.rpad(column, right_width, fill), total_width, fill)


def domain_of(email: Column) -> Column:
    """Text after the first ``@``."""
    return F.substring(
        email, F.locate("@", email) + F.lit(1), F.length(email)
    )


def top_level_domain(email: Column) -> Column:
    return F.substring_index(domain_of(email), ".", -1)


def char_occurrences(column: Column, char: str) -> Column:
    """How often ``char`` occurs, ignoring case."""
    return F.length(column) - F.length(F.replace(F.lower(column), F.lit(char.lower()), F.lit("")))


def substring_occurrences(column: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    return F.regexp_count(column, F.lit(re.escape(needle)))


def find_first(column: Column, needle: str) -> Column:
    """0-based position of ``needle``, -1 if absent."""
    return F.instr(column, needle) - 1


def is_palindrome(column: Column) -> Column:
    return column == F.reverse(column)


def is_alnum(column: Column) -> Column:
    return column.rlike("^[A-Za-z0-9]+$")


def is_alpha(column: Column) -> Column:
    return column.rlike("^[A-Za-z]+$")


def is_space(column: Column) -> Column:
    return column.rlike(r"^\s+$")


def is_lower(column: Column) -> Column:
    return column.rlike("[A-Za-z]") & (column == F.lower(column))


def is_upper(column: Column) -> Column:
    return column.rlike("[A-Za-z]") & (column == F.upper(column))


def is_title(column: Column) -> Column:
    """Every run of letters starts upper case and goes on lower case, whatever separates the runs."""
    return column.rlike("[A-Za-z]") & ~column.rlike(r"(?<!\p{L})\p{Ll}") & ~column.rlike(r"\p{L}\p{Lu}")


def split_labels(column: Column, separator: str = ", ") -> Column:
    """Split a delimiter-encoded list; the separator is taken literally."""
    return F.split(column, re.escape(separator))
