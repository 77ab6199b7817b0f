"""Links out of web pages."""

from __future__ import annotations

import html as standard
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import DATA_LINK_SUFFIXES, NON_PROJECT_PARTS
from lakekit.operators.ordering import first_per_key

# Parts of a page that hold no links (the last may lack its end), tags of links, and their attributes. Nothing here
# backtracks over a page.
_SILENT = (
    r"(?is)<!--.*?(?:--\s*+>|\z)|<script(?=[\s/>])[^>]*+(?<!/)>.*?(?:</script\s*+>|\z)"
    r"|<style(?=[\s/>])[^>]*+(?<!/)>.*?(?:</style\s*+>|\z)"
)
_TAG = r"""(?i)<a(?=[\s/])((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>"""
_ATTRIBUTE = r"""([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?"""
# Character references in values; a name without its semicolon is none before an equals sign.
_REFERENCE = re.compile(r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*+:"


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, none, step)
    # A path that ends in a dot part is a folder.
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def absolute(base: Column, href: Column) -> Column:
    """The address that ``href`` means on the page ``base``; ``href`` itself when the page's address has no scheme."""
    base = F.coalesce(base, F.lit(""))
    scheme = F.regexp_extract(base, "(" + _SCHEME + ")", 1)
    site = F.regexp_extract(base, "(" + _SCHEME + r"(?://[^/?#]*+)?)", 1)
    page = F.regexp_extract(base, r"^([^?#]*+)", 1)
    path = F.substr(page, F.length(site) + 1)
    folder = F.regexp_replace(path, r"[^/]*+$", "")
    wanted, rest = F.regexp_extract(href, r"^([^?#]*+)", 1), F.regexp_extract(href, r"^[^?#]*+(.*)$", 1)
    inside = F.when(folder == "", F.concat(F.lit("/"), wanted)).otherwise(F.concat(folder, wanted))
    return (
        F.when((scheme == "") | href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", F.regexp_extract(base, r"^([^#]*+)", 1))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*+)", 1), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("/"), F.concat(site, _without_dots(wanted), rest))
        .otherwise(F.concat(site, _without_dots(inside), rest))
    )


def _decode(text: str) -> str:
    def letters(found: re.Match) -> str:
        reference = found.group()
        return standard.unescape(reference) if reference[1] == "#" else html5.get(reference[1:], reference)

    return _REFERENCE.sub(letters, text)


def _decode_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Addresses of pages with their references decoded; most hold none and are handed through."""
    for pages in batches:
        yield pages.map(lambda values: [_decode(v) if "&" in v else v for v in values], na_action="ignore")


def anchors(html: Column) -> Column:
    """``href`` values of a page's ``<a>`` tags in document order."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _SILENT, " "), F.lit(_TAG), 1)

    def place(tag: Column) -> Column:
        return F.array_position(F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), F.lower), "href")

    def value(tag: Column) -> Column:
        found = F.get(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2), place(tag).cast("int") - 1)
        return F.coalesce(F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2"), F.lit(""))

    # Two thousand named references belong in no plan, so Python decodes the values; pages never go there.
    decoded = F.pandas_udf(_decode_all, "array<string>")
    return decoded(F.transform(F.filter(tags, lambda t: place(t) > 0), value))


def page_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Every link of every page: key, position in the page, href and absolute URL."""
    found = pages.select(key, F.col(url).alias("_page"), F.posexplode(anchors(F.col(html))).alias("position", "href"))
    return found.select(key, "position", "href", absolute(F.col("_page"), F.col("href")).alias("url"))


def data_links(links: DataFrame) -> DataFrame:
    """Links that point to a data file, by the end of the href."""
    ends = F.lit(False)
    for ending in DATA_LINK_SUFFIXES:
        ends = ends | F.lower("href").endswith(ending)
    return links.filter(ends)


def project_links(
    links: DataFrame, key: str, prefix: str, seen: DataFrame | None = None, max_per_page: int = 20
) -> DataFrame:
    """Project addresses ``owner/name`` on search pages, at most ``max_per_page`` new ones per page."""
    parts = F.filter(F.split("href", "/"), lambda p: p != "")
    barred = F.array(*[F.lit(p) for p in NON_PROJECT_PARTS])
    found = (
        links.filter(F.col("href").contains("/") & ~F.col("href").isin("/", "/search"))
        .withColumn("_parts", parts)
        .filter((F.size("_parts") >= 2) & ~F.arrays_overlap("_parts", barred))
        .select(
            key,
            "position",
            F.concat_ws("/", F.col("_parts")[0], F.col("_parts")[1]).alias("repo_name"),
        )
        .withColumn("repo_url", F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("repo_name")))
    )
    if seen is not None:
        found = found.join(seen.select("repo_url").distinct(), "repo_url", "left_anti")
    return first_per_key(found, [key], [F.col("position")], max_per_page)
