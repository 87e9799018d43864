"""String predicates on columns, over all of Unicode (Java's classes are ASCII unless told otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASED = r"\p{Lu}\p{Lt}\p{Ll}"
#: Upper case only after uncased characters, lower case only after cased ones, and one cased at least.
TITLE = rf"^[^{_CASED}]*[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:[^{_CASED}]+[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*)*[^{_CASED}]*$"
UPPER = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"
LOWER = r"^[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$"
ALPHA = r"^\p{L}+$"
NUMERIC = r"^\p{N}+$"
DIGITS = r"^\p{Nd}+$"


def is_title(c: Column) -> Column:
    return c.rlike(TITLE)


def is_upper(c: Column) -> Column:
    return c.rlike(UPPER)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def last_characters(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def from_end(c: Column, n: int) -> Column:
    """The n-th character from the end; empty if there is none."""
    return F.when(F.length(c) >= n, c.substr(F.length(c) - (n - 1), F.lit(1))).otherwise("")


def fix_mixed_case(word: Column) -> Column:
    """Words in one case stay; a capitalised one becomes Title case; others follow their first letter."""
    first = F.substring(word, 1, 1)
    second = F.substring(word, 2, 1)
    return (
        F.when(word.rlike(UPPER) | word.rlike(LOWER), word)
        .when(first.rlike(r"\p{Lu}") & second.rlike(r"\p{Ll}"), F.concat(F.upper(first), F.lower(F.substring(word, 2, 1 << 30))))
        .when(first.rlike(r"\p{Lu}"), F.upper(word))
        .otherwise(F.lower(word))
    )


def connected(lines: Column) -> Column:
    """Lines as one text: a line that ends with a hyphen loses it and is followed at once, others by a space."""
    last = F.size(lines) - 1
    parts = F.transform(lines, lambda x, i: F.when(i == last, x).when(x.endswith("-"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" "))))
    return F.array_join(parts, "")
