"""Text functions with the semantics of the corpus tools, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the tools take it: Unicode's, and the four separators from U+001C.
BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def clean_script(c: Column) -> Column:
    """Line ends and tabs as one space each, then stripped."""
    return strip(F.translate(c, "\n\r\t", "   "))


def symbol(c: Column) -> Column:
    return F.lower(strip(c))


def after_first(c: Column, mark: str) -> Column:
    """What follows the first mark; the whole text if it has none."""
    return F.coalesce(F.try_element_at(F.split(c, f"\\Q{mark}\\E", 2), F.lit(2)), c)


def halves(c: Column) -> Column:
    """A word cut in two, the first half the shorter."""
    n = F.floor(F.length(c) / 2).cast("int")
    return F.array(F.substring(c, F.lit(1), n), F.substring(c, n + 1, F.length(c) - n))


def number(c: Column) -> Column:
    """A text as a double where it is written as a plain number; null for what Java alone takes, like a type suffix."""
    c = F.trim(c.cast("string"))
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def is_whole(c: Column) -> Column:
    return F.coalesce(c.rlike("^-?[0-9]+$"), F.lit(False))


def replace_first(c: Column, pattern: str, new: Column) -> Column:
    """The first match's second group replaced literally; pattern has three groups: before, body, after. Unmatched texts stay."""
    start = F.regexp_instr(c, F.lit(pattern))
    before, body = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    at = start + F.length(before)
    rest = F.substring(c, at + F.length(body), F.length(c))
    return F.when(start > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, rest)).otherwise(c)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def fenced(c: Column) -> Column:
    """The first fenced code block of an answer, without its language; the text itself if there is none."""
    code = F.regexp_extract(c, r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1)
    return strip(F.when(code != "", code).otherwise(c))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
