"""Project scores, summaries, gates and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import API_DOC_NAMES, DATA_SUFFIXES, LICENSE_NAMES, SAMPLE_NAME_STARTS
from lakekit.operators.corpus import file_checks
from lakekit.operators.governance import license_of, mentions_api, rank_in, readme_rank, root_name
from lakekit.operators.keyfilter import FILTER_FROM, without_keys
from lakekit.operators.ordering import first_per_key


def is_data_file(path: Column) -> Column:
    ends = F.lit(False)
    for ending in DATA_SUFFIXES:
        ends = ends | path.endswith(ending)
    return ends


def repo_quality(files: DataFrame) -> DataFrame:
    """Score of every project from its files ``(repo, path, suffix, size, content)``.

    One pass over the content reduces every file to a few flags; the flags are
    combined per project before the shuffle, so content never moves.
    """
    path, repo, content = F.col("path"), F.col("repo"), F.col("content")
    inner = F.substr(path, F.length(repo) + 2)
    starts_as_sample = F.lit(False)
    for start in SAMPLE_NAME_STARTS:
        starts_as_sample = starts_as_sample | F.col("inner").startswith(start)

    # Named step by step, so that Spark computes each of these once per file.
    named = file_checks(files).withColumns({"inner": inner, "top": root_name(path, repo), "data": is_data_file(path)})
    ranked = named.withColumns({"readme": readme_rank(F.col("top")), "license_rank": rank_in(F.col("top"), LICENSE_NAMES)})
    flags = ranked.select(
        "repo",
        "size",
        "data",
        F.when(F.col("data"), F.col("suffix")).alias("data_suffix"),
        F.element_at(F.split(path, "/"), -1).isin(API_DOC_NAMES).alias("api_doc"),
        F.when(F.col("readme").isNotNull(), F.struct("readme", "top")).alias("readme_rank"),
        F.when(F.col("readme").isNotNull(), mentions_api(content)).alias("mention"),
        "csv_ok",
        "json_ok",
        "py_ok",
        "xml_ok",
        starts_as_sample.alias("sample"),
        F.when(F.col("license_rank").isNotNull(), license_of(content)).alias("license"),
        "license_rank",
        "top",
    )
    per_repo = flags.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.count_if("data").alias("data_files"),
        # Suffixes come from a fixed list, so this set is small for every project.
        F.array_sort(F.collect_set("data_suffix")).alias("data_types"),
        F.bool_or("api_doc").alias("api_docs_found"),
        F.min_by("mention", "readme_rank").alias("mention"),
        F.min_by("size", "readme_rank").alias("readme_size"),
        F.count_if("csv_ok").alias("csv_ok"),
        F.count_if("xml_ok").alias("xml_ok"),
        (F.count_if("json_ok") + F.count_if("py_ok")).alias("code_ok"),
        F.bool_or("sample").alias("sample"),
        F.min_by("license", F.when(F.col("license").isNotNull(), F.col("license_rank"))).alias("license"),
        F.min_by("top", "license_rank").alias("license_file_path"),
    )

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    score = (
        F.least(F.col("data_files") * 1.5, F.lit(15.0))
        + points(F.col("api_docs_found"), 10.0)
        + points(F.col("mention"), 5.0)
        + F.col("csv_ok") * 2.0
        + F.col("xml_ok") * 1.0
        + F.least(F.col("code_ok") * 0.5, F.lit(10.0))
        + points(F.col("sample"), 3.0)
        + points(F.col("readme_size") > 500, 3.0)
        + points(F.col("readme_size") > 2000, 2.0)
        + points(F.col("license").isNotNull(), 2.0)
    )
    return per_repo.select(
        "repo",
        "total_files",
        "data_files",
        "data_types",
        "api_docs_found",
        "license",
        F.when(F.col("license").isNotNull(), F.col("license_file_path")).alias("license_file_path"),
        F.bround(score, 1).alias("quality_score"),
    )


def structure_summary(files: DataFrame, quality: DataFrame, facts: DataFrame) -> DataFrame:
    """One line of text per project.

    ``quality`` is the result of ``repo_quality`` and ``facts`` holds
    ``(repo, language, stars)``. The first five data files are picked before
    any list is built, so a project of any size is safe.
    """
    inner = F.substr(F.col("path"), F.length("repo") + 2)
    named = files.filter(is_data_file(F.col("path"))).select("repo", inner.alias("file"))
    firsts = (
        first_per_key(named, ["repo"], [F.col("file")], 5)
        .groupBy("repo")
        .agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("first_files"))
    )
    joined = quality.join(firsts, "repo", "left").join(facts, "repo", "left")
    unknown = F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown"))
    parts = [
        F.concat(F.lit("Language: "), unknown),
        F.concat(F.lit("Stars: "), F.coalesce("stars", F.lit(0)).cast("string")),
        F.when(F.size("data_types") > 0, F.concat(F.lit("Data types: "), F.array_join("data_types", ", "))),
        F.when(
            F.col("data_files") > 0,
            F.concat(F.lit("Data files ("), F.col("data_files").cast("string"), F.lit("): "), F.col("first_files")),
        ),
        F.when(F.col("api_docs_found"), F.lit("API docs: yes")),
        F.when(F.col("license").isNotNull(), F.concat(F.lit("License: "), F.col("license"))),
        F.concat(F.lit("Quality score: "), F.col("quality_score").cast("string"), F.lit("/50")),
        F.concat(F.lit("Total files: "), F.col("total_files").cast("string")),
    ]
    return joined.select("repo", F.concat_ws(" | ", *parts).alias("structure_summary"))


def quality_gate(repos: DataFrame, minimum: float = 5.0) -> DataFrame:
    return repos.filter(F.col("quality_score") >= minimum)


def candidate_select(
    results: DataFrame, blacklist: DataFrame, seeds: DataFrame, min_stars: int, order: str = "seq", filter_from: int = FILTER_FROM
) -> DataFrame:
    """Search results worth fetching, then the seed projects.

    Results below ``min_stars`` or on the blacklist are dropped and the first
    of each URL kept. Seeds on the blacklist are dropped; a seed that is also
    a result stays twice. A blacklist of ``filter_from`` URLs or more is asked by a Bloom filter first.
    """
    wanted = without_keys(results.filter(F.col("stars") >= min_stars), blacklist, "repo_url", filter_from)
    kept = first_per_key(wanted, ["repo_url"], [F.col(order)]).withColumn("origin", F.lit("search"))
    known = without_keys(seeds, blacklist, "repo_url", filter_from).withColumn("origin", F.lit("seed"))
    return kept.unionByName(known, allowMissingColumns=True)


def score_band(score: Column) -> Column:
    return F.when(score >= 30, "high").when(score >= 15, "mid").otherwise("low")


def score_bands(repos: DataFrame) -> DataFrame:
    return repos.groupBy(score_band(F.col("quality_score")).alias("band")).agg(F.count("*").alias("repos"))
