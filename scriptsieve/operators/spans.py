"""Spans of a script that rules match: selection, coverage and splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,rule:int,idx:int>"
#: Quotes or backslashes around the word; what follows decides whether it is a key.
QUOTED = r"((?:['\"]|\\)+canvas(?:['\"]|\\)+)"


def chosen(spans: Column) -> Column:
    """Spans (start, end, rule, idx) that don't overlap, from the left: by start, rule and place, each that starts at or after the end of the last one taken. Repeats count once."""
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["idx"].alias("idx"), s["end"].alias("end")))))
    begin = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,rule:int,idx:int,end:int>>").alias("taken"))

    def take(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["last"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["last"]).alias("last"), F.when(fits, F.concat(acc["taken"], F.array(s))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(ordered, begin, take, lambda acc: acc["taken"])


def coverage(taken: Column, script: Column) -> Column:
    """The share of a script's characters that chosen spans cover; 0 for an empty script."""
    total = F.aggregate(taken, F.lit(0), lambda acc, s: acc + (s["end"] - s["start"]))
    return F.when(F.length(script) > 0, total / F.length(script)).otherwise(F.lit(0.0))


def spliced(taken: Column, script: Column, codes: Column) -> Column:
    """The script with each chosen span replaced by its rule's code (codes: map from rule to text)."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        kept = F.substring(script, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.coalesce(F.try_element_at(codes, s["rule"]), F.lit(""))).alias("out"))

    return F.aggregate(taken, begin, put, lambda acc: F.concat(acc["out"], F.substring(script, acc["at"] + 1, F.length(script))))


def quoted_canvas(script: Column, rule: int = 13) -> Column:
    """Spans of the quoted word that no colon follows, in SQL functions: texts between matches are summed up to offsets."""
    pieces = F.split(script, QUOTED, -1)
    found = F.regexp_extract_all(script, F.lit(QUOTED), 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(found, i))
        key = F.ltrim(F.regexp_replace(F.get(pieces, i + 1), r"^\s+", "")).startswith(":")
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule).alias("rule"), i.alias("idx"))
        return F.struct(end.alias("at"), F.when(key, acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, begin, add, lambda acc: acc["out"])


def line_offsets(script: Column) -> Column:
    """The offset at which each line starts; lines end at \\n only."""
    lengths = F.transform(F.split(script, "\n", -1), lambda x: F.length(x) + 1)
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def offset(script: Column, line: Column, column: Column) -> Column:
    """The offset of a line (from 1) and column; -1 out of range."""
    starts = line_offsets(script)
    there = (line >= 1) & (line <= F.size(starts) - 1) & (column >= 0)
    at = F.get(starts, line - 1) + column
    return F.when(there & (at <= F.length(script)), at).otherwise(F.lit(-1))


def composed(spans: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """script, spans: all spans (script, rule, idx, start, end) of the rules that checks (script, rule, valid) found valid, in order of rule."""
    if checks is not None:
        spans = spans.join(checks.where("valid").select("script", "rule").distinct(), ["script", "rule"], "left_semi")
    return spans.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule", "idx"))).alias("spans"))


def working_rules(checks: DataFrame) -> DataFrame:
    return checks.where("valid").groupBy("script").agg(F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("working_rules"))
