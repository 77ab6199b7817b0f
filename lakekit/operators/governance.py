"""Personal data in column names, licenses and API documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import (
    API_DOC_NAMES,
    LICENSE_NAMES,
    LICENSE_REGEXES,
    PII_WORDS,
    README_API_REGEXES,
    README_NAMES,
)
from lakekit.functions.text import bind, fold_case, license_or_unknown, mentions


def pii_kinds(header: Column) -> Column:
    """Kinds of personal data a column name suggests, as an array.

    A kind fits when one of its words occurs anywhere in the name, in any case.
    """

    def kinds(folded: Column) -> Column:
        return F.array_compact(
            F.array(*[F.when(mentions(folded, words), F.lit(kind)) for kind, words in PII_WORDS.items()])
        )

    return bind(fold_case(header), kinds)


def pii_columns(headers: DataFrame, column: str = "column") -> DataFrame:
    """One row per finding: every kind a column name matches, beside the columns of ``headers``."""
    return headers.select("*", F.explode(pii_kinds(F.col(column))).alias("pii_kind"))


def pii_by_file(headers: DataFrame, keys: list[str], column: str = "column") -> DataFrame:
    """Per file: whether it is flagged, the number of findings, and the kinds found."""
    return (
        headers.select(*keys, pii_kinds(F.col(column)).alias("_found"))
        # No more sets of kinds than there are combinations, however many columns there are.
        .groupBy(*keys)
        .agg(F.sum(F.size("_found")).alias("findings"), F.collect_set("_found").alias("_sets"))
        .withColumn("_kinds", F.array_sort(F.array_distinct(F.flatten("_sets"))))
        .select(
            *keys,
            (F.col("findings") > 0).alias("pii_flagged"),
            "findings",
            F.array_join("_kinds", ",").alias("pii_fields"),
        )
    )


def csv_headers(files: DataFrame) -> DataFrame:
    """One row per column name of every CSV file: ``repo``, ``path``, ``position``, ``column``.

    The header is the first line; commas inside quotes do not split it. Names are found one after the other, so a
    header may have any number of them.
    """
    line = F.regexp_extract("content", r"\A\x{FEFF}?([^\r\n]*)", 1)
    names = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'), 1)
    unquoted = F.regexp_replace(F.regexp_replace("raw", r'^"(.*)"$', "$1"), '""', '"')
    return (
        files.filter(F.col("suffix") == ".csv")
        .select("repo", "path", F.posexplode(names).alias("position", "raw"))
        .select("repo", "path", "position", unquoted.alias("column"))
    )


def license_of(content: Column, head_chars: int | None = None) -> Column:
    """License named by a text; the first kind with a match wins.

    The whole text is searched, or its first ``head_chars`` characters, such as ``LICENSE_HEAD_CHARS``.
    """
    head = content if head_chars is None else F.left(content, F.lit(head_chars))

    def kind(folded: Column) -> Column:
        return F.coalesce(*[F.when(mentions(folded, r), F.lit(name)) for name, r in LICENSE_REGEXES.items()])

    return bind(fold_case(head), kind)


def root_name(path: Column, repo: Column) -> Column:
    """File name when the file lies at the top of its project, else null."""
    inner = F.substr(path, F.length(repo) + 2)
    return F.when(path.startswith(F.concat(repo, F.lit("/"))) & ~inner.contains("/"), inner)


def rank_in(name: Column, names: list[str]) -> Column:
    """Position of ``name`` in a list of preferred names, from 1; null when absent."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0).cast("bigint"))


def license_by_repo(files: DataFrame) -> DataFrame:
    """Per project: license and path of its license file.

    Files are tried in a fixed order; one without a match lets the next try.
    The path is that of the first file present.
    """
    ranked = files.withColumn("_rank", rank_in(root_name(F.col("path"), F.col("repo")), LICENSE_NAMES))
    found = ranked.filter(F.col("_rank").isNotNull()).withColumn("_license", license_of(F.col("content")))
    return found.groupBy("repo").agg(
        F.min_by("_license", F.when(F.col("_license").isNotNull(), F.col("_rank"))).alias("license"),
        F.min_by(root_name(F.col("path"), F.col("repo")), F.col("_rank")).alias("license_file_path"),
    )


def license_summary(repos: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Project, URL and license or Unknown, best quality first.

    With ``licenses(repo_url, license)`` the license comes from that table, one
    row per entry; else from the project record.
    """
    if licenses is not None:
        repos = repos.drop("license").join(licenses.select("repo_url", "license"), "repo_url", "left")
    return repos.select(
        "repo_name", "repo_url", license_or_unknown(F.col("license")).alias("license"), "quality_score"
    ).orderBy(F.col("quality_score").desc_nulls_last(), "repo_name")


def license_counts(repos: DataFrame) -> DataFrame:
    """Projects per license, beside the number licensed and in all."""
    counted = repos.groupBy(license_or_unknown(F.col("license")).alias("license")).agg(F.count("*").alias("repos"))
    # License names may be free text, so the sums are an aggregate of their own and not a window over all kinds.
    known = license_or_unknown(F.col("license")) != "Unknown"
    sums = repos.agg(F.count_if(known).alias("licensed"), F.count("*").alias("total"))
    return counted.withColumns({"licensed": sums.select("licensed").scalar(), "total": sums.select("total").scalar()})


def readme_rank(name: Column) -> Column:
    """Order in which a top-level file is taken as README: listed names first, then any ``readme*`` by name."""
    fallback = F.when(F.lower(name).startswith("readme"), F.lit(len(README_NAMES) + 1).cast("bigint"))
    return F.coalesce(rank_in(name, README_NAMES), fallback)


def mentions_api(content: Column) -> Column:
    return bind(fold_case(content), lambda folded: mentions(folded, README_API_REGEXES))


def api_docs(files: DataFrame) -> DataFrame:
    """Per project: an API description file anywhere, and a README that mentions an API."""
    name = F.element_at(F.split("path", "/"), -1)
    ranked = files.withColumn("_top", root_name(F.col("path"), F.col("repo"))).withColumn(
        "_place", readme_rank(F.col("_top"))
    )
    readme = F.col("_place").isNotNull()
    return (
        ranked.withColumns(
            {
                "_rank": F.when(readme, F.struct("_place", "_top")),
                "_mention": F.when(readme, mentions_api(F.col("content"))),
            }
        )
        .groupBy("repo")
        .agg(
            F.bool_or(name.isin(API_DOC_NAMES)).alias("api_docs_found"),
            F.coalesce(F.min_by("_mention", "_rank"), F.lit(False)).alias("readme_mentions_api"),
        )
    )
