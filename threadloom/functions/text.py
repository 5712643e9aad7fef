"""Text expressions: pure Column to Column, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, no-break spaces and zero-width characters, as a regex class body.
BLANKS = r"\s\x1C-\x1F\x85\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def blank(c: Column) -> Column:
    """True for null, empty, or only white space, no-break spaces and zero-width characters."""
    return c.isNull() | ~c.rlike(f"[^{BLANKS}]")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def words(c: Column) -> Column:
    """Maximal runs of letters and digits after lower-casing, in order."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def word_set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(words(c)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)
