"""URLs and links of stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An href in double quotes, in single ones, or bare.
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    quoted = F.regexp_extract_all(html, F.lit(LINK), 1)
    return F.transform(quoted, lambda h: F.when(h.startswith('"') | h.startswith("'"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h))


def authority(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its dot segments resolved; what would climb above the root stays at it."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.regexp_replace(done, "/[^/]*$", "")
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.lit("/"), part))

    walked = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    return F.when(last.isin(".", ".."), F.concat(walked, F.lit("/"))).otherwise(walked)


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against a page, dot segments included, in SQL functions."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_extract(F.substring(bare, F.length(root) + 1, F.length(bare)), r"^(.*/)", 1))
    way, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(root, without_dots(F.when(href.startswith("/"), way).otherwise(F.concat(folder, way))), rest))
    )


@F.pandas_udf(StringType())
def resolve(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A link resolved against a page in every form, dot segments included."""
    for bases, links in pairs:
        yield pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(bases, links)])


def output_key(url: Column) -> Column:
    """A file name from a URL's path: `index` for the root, else the path with its marks as underscores."""
    p = path(url)
    inner = F.regexp_replace(p, "^/+|/+$", "")
    return F.when(p.isin("", "/"), F.lit("index")).otherwise(F.translate(inner, "/.", "__"))
