"""Sandbox pages: the elements that a script asks for, and a page that holds them and the script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns by which scripts name elements, and tags that the page has itself.
BY_ID = r"document\.getElementById\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
QUERY_ID = r"document\.querySelector(?:All)?\s*\(\s*['\"]#([^'\" ]+)['\"]\s*\)"
BY_CLASS = r"document\.getElementsByClassName\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
QUERY_CLASS = r"document\.querySelector(?:All)?\s*\(\s*['\"]\s*\.([^'\" ]+)['\"]\s*\)"
BY_TAG = r"document\.getElementsByTagName\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
OWN_TAGS = ["html", "head", "body", "script", "title", "h1"]


def _all(code: Column, pattern: str) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), 1)


def element_ids(code: Column) -> Column:
    return F.array_sort(F.array_union(_all(code, BY_ID), _all(code, QUERY_ID)))


def element_classes(code: Column) -> Column:
    names = F.concat(_all(code, BY_CLASS), _all(code, QUERY_CLASS))
    parts = F.flatten(F.transform(names, lambda x: F.split(x, r"\s+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def element_tags(code: Column) -> Column:
    found = F.array_distinct(_all(code, BY_TAG))
    taken = F.concat(element_ids(code), element_classes(code), F.array(*map(F.lit, OWN_TAGS)))
    return F.array_sort(F.array_except(found, taken))


def placeholders(code: Column) -> Column:
    """The elements as HTML, in the order of ids, classes and tags, each sorted, so that pages are the same each time."""

    def by_id(x: Column) -> Column:
        kind = F.when(F.lower(x).contains("canvas"), "canvas").when(F.lower(x).contains("svg"), "svg").otherwise("div")
        return F.concat(F.lit("<"), kind, F.lit(' id="'), x, F.lit('"></'), kind, F.lit(">"))

    ids = F.transform(element_ids(code), by_id)
    classes = F.transform(element_classes(code), lambda x: F.concat(F.lit('<div class="'), x, F.lit('"></div>')))
    tags = F.transform(element_tags(code), lambda x: F.concat(F.lit("<"), x, F.lit("></"), x, F.lit(">")))
    return F.array_join(F.concat(ids, classes, tags), "\n    ")


def sandbox(code: Column) -> Column:
    """A page that holds the placeholders and runs the script once they are there, inside a try."""
    return F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head><title>Sandbox</title></head>\n<body>\n    "), placeholders(code),
        F.lit("\n<script>\ndocument.addEventListener('DOMContentLoaded', () => { try {\n"), code,
        F.lit("\n} catch (e) { console.error(e); } });\n</script>\n</body>\n</html>\n"),
    )
