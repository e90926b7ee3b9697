"""Pairs of original and rewritten scripts: part files, sizes, coverage and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_first, replace_first

PART = r"^(js|wasm)_(.+?)_([0-9]+)\.json$"
SCRIPT_TAG = r"(?s)(<script>)(.*?)(</script>)"


def part_names(files: DataFrame, name: str = "file") -> DataFrame:
    """kind, base, part of files that are named <kind>_<base>_<part>.json; others are dropped."""
    f = F.col(name)
    return files.where(f.rlike(PART)).select("*", F.regexp_extract(f, PART, 1).alias("kind"), F.regexp_extract(f, PART, 2).alias("base"), F.regexp_extract(f, PART, 3).cast("int").alias("part"))


def base_name(stem: Column) -> Column:
    return after_first(stem, "_")


def combined(parts: DataFrame, sep: str = "\n") -> DataFrame:
    """kind, base, parts, content: the contents of each base in the order of its part numbers."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), sep)
    return parts.groupBy("kind", "base").agg(F.count("*").alias("parts"), joined.alias("content"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last."""
    names = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(F.col(c), F.col(order)).alias(c) for c in names])


def sizes(items: DataFrame, *by: str) -> DataFrame:
    """bytes: the UTF-8 length of all contents."""
    return items.groupBy(*by).agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


def compared(left: DataFrame, right: DataFrame, key: str = "base") -> DataFrame:
    """Sizes of both sides of each key, their difference and percentage (infinite where the left is empty), and whether both have the key."""
    a = left.select(key, F.col("bytes").alias("js_bytes"))
    b = right.select(key, F.col("bytes").alias("wasm_bytes"))
    out = a.join(b, key, "full_outer")
    diff = F.col("wasm_bytes") - F.col("js_bytes")
    status = F.when(F.col("js_bytes").isNull(), "only_wasm").when(F.col("wasm_bytes").isNull(), "only_js").otherwise("both")
    pct = F.when(F.col("js_bytes") == 0, F.lit(float("inf"))).otherwise(F.try_divide(diff * F.lit(100.0), F.col("js_bytes")))
    return out.withColumns({"status": status, "diff": diff, "pct": pct})


def totals(comparison: DataFrame) -> DataFrame:
    """One row over the keys that both sides have."""
    t = comparison.where("status = 'both'").agg(F.count("*").alias("pairs"), F.sum("js_bytes").alias("js_bytes"), F.sum("wasm_bytes").alias("wasm_bytes"))
    diff = F.col("wasm_bytes") - F.col("js_bytes")
    return t.withColumn("diff", diff).withColumn("pct", F.when(F.col("js_bytes") == 0, F.lit(float("inf"))).otherwise(F.try_divide(diff * F.lit(100.0), F.col("js_bytes"))))


def report(comparison: DataFrame) -> DataFrame:
    """The comparison as fixed-width lines."""
    line = F.format_string("%-20s %10d %10d %10d %9.2f%%", "base", "js_bytes", "wasm_bytes", "diff", "pct")
    return comparison.where("status = 'both'").orderBy("base").select(line.alias("line"))


def matched(first: DataFrame, second: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the first that the second has too, and those that it lacks."""
    names = second.select(key).distinct()
    return first.join(names, key, "left_semi"), first.join(names, key, "left_anti")


def updated_pages(pages: DataFrame, scripts: DataFrame, key: str = "key") -> DataFrame:
    """Pages (key, html) with the body of their first script replaced by a twin's content, and what happened: updated, no_script, missing (copied as it is)."""
    twin = scripts.select(key, F.col("content").alias("__new"))
    out = pages.join(twin, key, "left")
    has = F.coalesce(F.col("html").rlike(SCRIPT_TAG), F.lit(False))
    status = F.when(F.col("__new").isNull(), "missing").when(~has, "no_script").otherwise("updated")
    html = F.when(status == "updated", replace_first(F.col("html"), SCRIPT_TAG, F.col("__new"))).otherwise(F.col("html"))
    return out.withColumn("status", status).withColumn("html", html).drop("__new")


def statuses(runs: DataFrame) -> DataFrame:
    """Six flags of a conversion from what is known of it: bytes, parsed, n_rules, seconds, valid. The first that fails decides."""
    step = (
        F.when(F.col("bytes") > 800_000, "large_file_skip").when(~F.col("parsed"), "ast_fail").when(F.col("n_rules") == 0, "abrupt_fail")
        .when(F.col("seconds") > 600, "time_fail").when(~F.col("valid"), "validation_fail").otherwise("success")
    )
    flags = ["abrupt_fail", "time_fail", "ast_fail", "large_file_skip", "validation_fail", "success"]
    return runs.withColumn("__step", step).select(*runs.columns, *[(F.col("__step") == f).cast("int").alias(f) for f in flags])


def log_summary(log: DataFrame) -> DataFrame:
    """Runs and successes of each rule that a conversion log names."""
    rules = log.select(F.explode(F.split("working_rules", r"\|")).alias("rule"), "success").where("rule <> ''")
    return rules.groupBy("rule").agg(F.count("*").alias("runs"), F.sum("success").cast("long").alias("successes"))
