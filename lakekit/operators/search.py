"""Token index, ranked search and lake statistics over project records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import API_INTENT, TYPE_INTENTS
from lakekit.functions.text import strip, words
from lakekit.operators.ordering import first_per_key

NAME_SPLIT = r"(?U)[\s\-_/.,]+"


def name_parts() -> Column:
    """Pieces of the name, and the tags and data types as they are, in lower case."""
    labels = F.transform(F.concat("tags", "data_types"), lambda v: strip(F.lower(v)))
    return F.concat(F.split(F.lower("repo_name"), NAME_SPLIT), labels)


def long_words(text: Column) -> Column:
    return F.filter(words(F.coalesce(text, F.lit(""))), lambda w: F.length(w) > 2)


def repo_tokens() -> Column:
    """Distinct index tokens of a project record."""
    pieces = F.concat(
        name_parts(),
        long_words(F.col("description")),
        long_words(F.col("structure_summary")),
    )
    return F.array_remove(F.array_distinct(pieces), "")


def postings(repos: DataFrame, key: str = "seq") -> DataFrame:
    """The inverted index as rows ``(token, key)``."""
    return repos.select(F.explode(repo_tokens()).alias("token"), F.col(key))


def index_blocks(index: DataFrame, key: str = "seq", block: int = 4096) -> DataFrame:
    """The inverted index as sorted lists; a token found in many projects has many blocks.

    A block covers ``block`` consecutive keys, which bounds every list and
    spreads a frequent token over many groups.
    """
    return (
        index.withColumn("block", F.floor(F.col(key) / block))
        .groupBy("token", "block")
        .agg(F.count("*").alias("repos"), F.array_sort(F.collect_list(key)).alias("keys"))
    )


def write_index(index: DataFrame, path: str, key: str = "seq") -> None:
    """Store the index sorted by token, so that a lookup reads few row groups."""
    index.repartitionByRange("token", key).sortWithinPartitions("token", key).write.mode("overwrite").parquet(path)


def lookup(index: DataFrame, tokens: list[str]) -> DataFrame:
    """Index rows of some tokens; on a stored index the filter reaches the file statistics."""
    return index.filter(F.col("token").isin(tokens))


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case words of a query longer than one character."""
    return sorted({t for t in re.split(r"\W+", query.lower()) if len(t) > 1})


def intended_types(query: str) -> list[str]:
    """Data types a query asks for, by substring: ``db`` also fires inside ``feedback``."""
    text = query.lower()
    return [kind for kind, signs in TYPE_INTENTS.items() if any(sign in text for sign in signs)]


def wants_api(query: str) -> bool:
    return any(sign in query.lower() for sign in API_INTENT)


def _prepared(repos: DataFrame) -> DataFrame:
    """Lower-case columns that every query looks at, computed once per row."""
    return repos.withColumns(
        {
            "_name": F.lower("repo_name"),
            "_description": F.lower(F.coalesce("description", F.lit(""))),
            "_summary": F.lower(F.coalesce("structure_summary", F.lit(""))),
            "_parts": name_parts(),
        }
    )


def _score(query: str) -> Column:
    """Score of a prepared row: token, name and description hits, intents and quality."""
    score = F.lit(0.0)
    for token in query_tokens(query):
        in_index = F.array_contains("_parts", token)
        if len(token) > 2:
            # Plain search first: the word test only runs where the letters occur.
            word = rf"(?U)(?<![\w\p{{No}}\p{{Cn}}]){token}(?![\w\p{{No}}\p{{Cn}}])"
            for column in ("_description", "_summary"):
                in_index = in_index | (F.col(column).contains(token) & F.col(column).rlike(word))
        score = score + F.when(in_index, 1.0).otherwise(0.0)
        score = score + F.when(F.col("_name").contains(token), 1.5).otherwise(0.0)
        score = score + F.when(F.col("_description").contains(token), 0.5).otherwise(0.0)
    types = intended_types(query)
    if types:
        wanted = F.array(*[F.lit(t) for t in types])
        score = score + F.when(F.arrays_overlap("data_types", wanted), 2.0).otherwise(0.0)
    if wants_api(query):
        score = score + F.when(F.col("api_docs_found"), 2.0).otherwise(0.0)
    return score + F.coalesce("quality_score", F.lit(0.0)) * 0.02


def search(repos: DataFrame, query: str, top_k: int = 10, key: str = "seq") -> DataFrame:
    """The best ``top_k`` projects for a query, ties in index order.

    One scan: every task keeps its own ``top_k`` and only those are merged.
    """
    scored = _prepared(repos).select(key, "repo_name", _score(query).alias("score"))
    return scored.filter(F.col("score") > 0).orderBy(F.col("score").desc(), F.col(key)).limit(top_k)


def _substring_points(repos: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """(key, token, points) for tokens inside names and descriptions, from one scan whatever the number of tokens."""
    import ahocorasick

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for token in tokens:
            automaton.add_word(token, token)
        automaton.make_automaton()
        for batch in batches:
            at, token, points = [], [], []
            for column, weight in ((1, 1.5), (2, 0.5)):
                for i, text in enumerate(batch.column(column).to_pylist()):
                    inside = {t for _, t in automaton.iter(text or "")}
                    at += [i] * len(inside)
                    token += inside
                    points += [weight] * len(inside)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(token, pa.string()), pa.array(points, pa.float64())],
                [key, "token", "points"],
            )

    texts = repos.select(key, F.lower("repo_name"), F.lower(F.coalesce("description", F.lit(""))))
    return texts.mapInArrow(found, f"`{key}` {repos.schema[key].dataType.simpleString()}, token string, points double")


def search_batch(
    repos: DataFrame, queries: dict[int, str], top_k: int = 10, key: str = "seq", index: DataFrame | None = None
) -> DataFrame:
    """Ranked search for any number of queries, from the index and one scan of the texts.

    The postings of ``index``, or those of ``repos``, meet the queries' tokens in a join; letters inside names and
    descriptions are found in one pass. A project without any hit ranks by its intents and quality alone, of which
    there are few kinds, so the best of each kind are the only ones to consider.
    """
    spark, number = repos.sparkSession, repos.schema[key].dataType.simpleString()
    asked = spark.createDataFrame(
        [(i, t) for i, q in queries.items() for t in query_tokens(q)], "query_id bigint, token string"
    )
    kinds = {q: (tuple(intended_types(q)), wants_api(q)) for q in queries.values()}
    numbers = {k: n for n, k in enumerate(sorted(set(kinds.values())))}
    plans = spark.createDataFrame([(i, numbers[kinds[q]]) for i, q in queries.items()], "query_id bigint, kind int")

    def base(types: tuple[str, ...], api: bool) -> Column:
        score = F.coalesce("quality_score", F.lit(0.0)) * 0.02
        if types:
            wanted = F.arrays_overlap("data_types", F.array(*map(F.lit, types)))
            score = score + F.when(wanted, 2.0).otherwise(0.0)
        return score + F.when(F.col("api_docs_found"), 2.0).otherwise(0.0) if api else score

    bases = F.array(*(F.struct(F.lit(n).alias("kind"), base(*k).alias("base")) for k, n in numbers.items()))
    rows = repos.select(key, "repo_name", F.inline(bases))
    listed = (postings(repos, key) if index is None else index).select("token", key, F.lit(1.0).alias("points"))
    tokens = sorted({t for q in queries.values() for t in query_tokens(q)})
    inside = _substring_points(repos, tokens, key) if tokens else spark.createDataFrame([], f"`{key}` {number}, token string, points double")
    hits = (
        listed.unionByName(inside).join(asked, "token").groupBy("query_id", key).agg(F.sum("points").alias("points"))
        .join(plans, "query_id").join(rows, ["kind", key])
        .select("query_id", key, "repo_name", (F.col("points") + F.col("base")).alias("score"))
    )
    plain = first_per_key(rows, ["kind"], [F.col("base").desc(), F.col(key)], top_k)
    plain = plain.join(plans, "kind").select("query_id", key, "repo_name", F.col("base").alias("score"))
    every = hits.unionByName(plain).groupBy("query_id", key, "repo_name").agg(F.max("score").alias("score"))
    return first_per_key(every.where("score > 0"), ["query_id"], [F.col("score").desc(), F.col(key)], top_k)


def record_text(repos: DataFrame) -> Column:
    """A whole record as lower-case JSON text, nulls included."""
    return F.lower(F.to_json(F.struct(*repos.columns), {"ignoreNullFields": "false"}))


def search_substring(repos: DataFrame, query: str) -> DataFrame:
    """Records whose JSON text, field names included, contains the query; best quality first.

    A blank query finds nothing. The text has no blanks after separators.
    """
    wanted = query.lower().strip()
    if not wanted:
        return repos.limit(0)
    return repos.filter(record_text(repos).contains(wanted)).orderBy(
        F.col("quality_score").desc_nulls_last(), "repo_name"
    )


def sidebar_text() -> Column:
    """What the side-bar search looks into."""
    return F.concat_ws(
        " ",
        "repo_name",
        F.coalesce("description", F.lit("")),
        F.array_join("tags", " "),
        F.array_join("data_types", " "),
    )


def search_sidebar(repos: DataFrame, query: str) -> DataFrame:
    """Records with the query in name, description, tags or data types; a blank query keeps all."""
    wanted = query.lower().strip()
    if not wanted:
        return repos
    return repos.filter(F.lower(sidebar_text()).contains(wanted))


def lake_stats(repos: DataFrame) -> DataFrame:
    """One row about the whole lake."""
    licensed = F.coalesce(F.col("license"), F.lit("")) != ""
    return repos.agg(
        F.count("*").alias("total_repos"),
        F.coalesce(F.sum(F.size("data_files")), F.lit(0)).alias("total_data_files"),
        # Distinct suffixes only, merged in every task before the shuffle.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("data_types")))).alias("data_types"),
        F.count_if("api_docs_found").alias("api_docs_count"),
        F.coalesce(F.bround(F.avg("quality_score"), 1), F.lit(0.0)).alias("avg_quality_score"),
        F.count_if(licensed).alias("licensed_count"),
    )


def recent(repos: DataFrame, n: int = 10, key: str = "seq") -> DataFrame:
    return repos.orderBy(F.col("ingested_at").desc_nulls_last(), F.col(key)).limit(n)


def best(repos: DataFrame, n: int | None = 10, key: str = "seq") -> DataFrame:
    """The ``n`` best records by score, or all of them in that order."""
    ordered = repos.orderBy(F.col("quality_score").desc_nulls_last(), F.col(key))
    return ordered if n is None else ordered.limit(n)
