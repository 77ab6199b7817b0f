"""Operator 9, URL filters with hashed host-suffix and path-prefix expressions.

A URL stands for the expressions of all suffixes of its host, at label borders, with all prefixes of its path whose
length some rule has. Expressions meet rules by an equi-join on the first 32 bits of their SHA-256; the whole digest
confirms a match and the longest rule wins. Only built-in functions are used.

Distinct pairs of host and path prefix are judged once for each of ``SALTS`` shares of the rows, so a pair that holds a
third of all pages is expanded a few times and its rows meet their verdict in several tasks. Rules are broadcast while there are at most ``broadcast_rules`` of them, else joined by a shuffle.

Cases: a null URL or one without "://" has an empty host and path, which fit no rule; equal rules count once, and of
equal rules with different verdicts "block" wins; repeated pages are judged alike; empty tables give no rows, or the
default verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.llm.columns import named

BROADCAST_RULES = 100_000
SALTS = 64
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """``pages`` as struct ``row`` with host, path, the winning rule (or null) and the verdict."""
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("rule"), F.translate("host", _UPPER, _LOWER).alias("h"), "path")
        .agg(F.max("verdict").alias("rule_verdict"))  # "block" over "allow"
        .withColumn("digest", F.sha2(F.concat_ws("\n", "h", "path"), 256))
        .select("rule", "rule_verdict", "digest", F.substring("digest", 1, 8).alias("prefix"))
    )
    # The lengths that rules' paths have: few, however many rules there are.
    lengths = sorted(r["n"] for r in rules.where("path IS NOT NULL").select(F.length("path").alias("n")).distinct().collect())
    longest = max(lengths, default=0)
    host, path = host_and_path(named(url))
    rows = pages.select(F.struct(*(named(c) for c in pages.columns)).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("path_head", F.substring("path", 1, longest))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    keys = rows.select("host", "path_head", "salt").distinct()

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    heads = [F.when(F.length("path_head") >= n, F.substring("path_head", 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*heads)) if heads else F.array().cast("array<string>")
    asked = (
        keys.withColumn("suffix", F.explode(suffixes))
        .withColumn("lead", F.explode(prefixes))
        .withColumn("asked", F.sha2(F.concat_ws("\n", "suffix", "lead"), 256))
        .withColumn("prefix", F.substring("asked", 1, 8))
    )
    if known.count() <= broadcast_rules:
        known = F.broadcast(known)
    matched = asked.join(known, "prefix").where("asked = digest")
    best = matched.groupBy("host", "path_head", "salt").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("suffix"))).alias("best")
    )
    return rows.join(best, ["host", "path_head", "salt"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), q AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), best AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM q JOIN rules ON (q.host = rules.host OR ends_with(q.host, '.' || rules.host)) AND starts_with(q.path, rules.path)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN best USING (r)
"""
