"""SQL that DuckDB runs on the same tables to check the named queries.

Nothing here is shared with the queries: the derived inputs and every rule are
written out a second time in plain SQL.
"""

from __future__ import annotations

from lakekit.plans import conformance

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

VIEWS = {
    "corpus_files": """corpus_files AS (
        SELECT repo, repo || '/' || name AS path, name,
               lower(regexp_extract(name, '[^/.][^/]*(\\.[^./]+)$', 1)) AS suffix,
               CAST(strlen(content) AS BIGINT) AS size, content
        FROM (
            SELECT 'repo_' || (doc_id // 10) AS repo,
                   CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' WHEN doc_id % 10 = 1 THEN 'README.md'
                        WHEN doc_id % 10 <= 4 THEN 'data_' || (doc_id % 10) || '.csv'
                        WHEN doc_id % 10 = 5 THEN 'meta_5.json' ELSE 'note_' || (doc_id % 10) || '.txt' END AS name,
                   text AS content
            FROM documents
            UNION ALL
            SELECT 'repo_' || (event_id // 2), 'event_' || event_id || '.json', props FROM events))""",
    "license_texts": r"""license_texts AS (
        SELECT doc_id, CASE
            WHEN regexp_matches(head, 'MIT\s+License|Permission is hereby granted, free of charge', 'i') THEN 'MIT'
            WHEN regexp_matches(head, 'Apache\s+License.*2\.0|Licensed under the Apache License', 'i') THEN 'Apache 2.0'
            WHEN regexp_matches(head, 'GNU GENERAL PUBLIC LICENSE|GPLv[23]', 'i') THEN 'GPL'
            WHEN regexp_matches(head, 'CC0\s+1\.0|Creative Commons Zero|dedicate.*public domain', 'i') THEN 'CC0'
            WHEN regexp_matches(head, 'BSD\s+License|Redistribution and use in source and binary forms', 'i') THEN 'BSD'
            END AS license
        FROM (SELECT doc_id, text AS head FROM documents))""",
    "repo_meta": """repo_meta AS (
        SELECT d.doc_id AS seq, source || '/' || d.doc_id AS repo_name,
               'https://example.org/' || source || '/' || d.doc_id AS repo_url, source AS mirror_name,
               text AS description, n_chars AS stars, lang AS language, [lang, source] AS tags,
               CASE d.doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_files,
               CASE d.doc_id % 3 WHEN 0 THEN ['.csv'] WHEN 1 THEN ['.json'] ELSE CAST([] AS VARCHAR[]) END AS data_types,
               d.doc_id % 7 = 0 AS api_docs_found,
               CAST(n_chars % 41 + d.doc_id % 10 AS DOUBLE) AS quality_score,
               'Language: ' || lang AS structure_summary, t.license,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS ingested_at
        FROM documents d JOIN license_texts t ON t.doc_id = d.doc_id)""",
    "snapshots": """snapshots AS (
        SELECT o_custkey AS key, o_totalprice AS score, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus AS license
        FROM orders)""",
    "headers": r"""headers AS (
        SELECT 'doc_' || doc_id AS dataset, "column" FROM (
            SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'))) AS "column"
            FROM documents) WHERE "column" <> ''
        UNION ALL
        SELECT 'customer_' || (c_custkey // 100), lower(c_mktsegment) || '_' ||
               ['email_address', 'Phone', 'zip_code', 'last_name', 'tax_id', 'ip_addr', 'balance', 'unzipped'][c_custkey % 8 + 1]
        FROM customer)""",
    "findings": r"""findings AS (
        SELECT dataset, "column", unnest(list_filter([
            CASE WHEN regexp_matches("column", '(email|e\-mail|email_address|contact_email)', 'i') THEN 'email' END,
            CASE WHEN regexp_matches("column", '(phone|telephone|cell|mobile|contact_number|phone_number)', 'i') THEN 'phone' END,
            CASE WHEN regexp_matches("column", '(address|street|city|state|zip|postal|location|residence)', 'i') THEN 'address' END,
            CASE WHEN regexp_matches("column", '(first_name|last_name|full_name|given_name|surname|middle_name)', 'i') THEN 'name' END,
            CASE WHEN regexp_matches("column", '(ssn|social_security|national_id|tax_id)', 'i') THEN 'ssn' END,
            CASE WHEN regexp_matches("column", '(ip_address|ip_addr|client_ip|remote_addr)', 'i') THEN 'ip' END
            ], lambda k: k IS NOT NULL)) AS pii_kind
        FROM headers)""",
    "ragged": """ragged AS (
        SELECT CASE WHEN k <> 2 THEN CAST(event_id AS VARCHAR) END AS id,
               CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 'a,b' ELSE event_type END AS kind,
               CASE WHEN k IN (0, 2, 3) THEN NULL ELSE CAST(value AS VARCHAR) END AS value,
               CASE WHEN k IN (0, 2) THEN NULL WHEN k = 1 THEN 'x' WHEN k = 3 THEN ' ' ELSE '2024-01-01' END AS day,
               CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE 4 END AS BIGINT) AS cells
        FROM (SELECT *, event_id % 9 AS k FROM events))""",
    "guessable": """guessable AS (
        SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS whole, CAST(o_totalprice AS VARCHAR) AS fraction,
               strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey || '-' || o_orderkey AS dashed,
               CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS gaps,
               '' AS nothing, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS key_text
        FROM orders)""",
    "customer_text": """customer_text AS (
        SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
               c_mktsegment, c_acctbal AS balance, c_nationkey AS nation
        FROM customer)""",
    "links": """links AS (
        SELECT page_id, CAST(i - 1 AS BIGINT) AS position, hrefs[i] AS href,
               regexp_extract(url, '^(https?://[^/?#]+)', 1) || hrefs[i] AS url
        FROM (SELECT page_id, url, hrefs, unnest(generate_series(1, len(hrefs))) AS i
              FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)))""",
    "scores": """scores AS (
        SELECT user_id AS entity, list_reduce(
                   list_prepend(10.0::DOUBLE, list(CASE WHEN event_type <> 'error' THEN 0.5 ELSE -2.0 END::DOUBLE ORDER BY ts, event_id)),
                   lambda s, d: greatest(0.0::DOUBLE, least(20.0::DOUBLE, s + d))) AS score,
               count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures,
               arg_max(event_type, ts) <> 'error' AS last_ok,
               arg_max(value, ts) FILTER (event_type <> 'error' AND value > 0) AS latency_ms
        FROM events GROUP BY user_id),
        health AS (
        SELECT entity, score, successes, failures, last_ok OR score >= 1 AS alive, latency_ms FROM scores)""",
    "quality": r"""checked AS (
        SELECT *, regexp_matches(name, '\.(json|csv|xml|db|sqlite|parquet|feather|arrow|avro)$') AS data,
               CASE WHEN suffix = '.csv' THEN regexp_matches(content, '^\x{FEFF}?[^\r\n]') END AS csv_ok,
               CASE WHEN suffix = '.json' THEN json_valid(content) END AS json_ok,
               CASE WHEN name = 'LICENSE' THEN CASE
                    WHEN regexp_matches(content, 'MIT\s+License|Permission is hereby granted, free of charge', 'i') THEN 'MIT'
                    WHEN regexp_matches(content, 'Apache\s+License.*2\.0|Licensed under the Apache License', 'i') THEN 'Apache 2.0'
                    WHEN regexp_matches(content, 'GNU GENERAL PUBLIC LICENSE|GPLv[23]', 'i') THEN 'GPL'
                    WHEN regexp_matches(content, 'CC0\s+1\.0|Creative Commons Zero|dedicate.*public domain', 'i') THEN 'CC0'
                    WHEN regexp_matches(content, 'BSD\s+License|Redistribution and use in source and binary forms', 'i') THEN 'BSD'
                    END END AS license
        FROM corpus_files),
        quality AS (
        SELECT repo, count(*) AS total_files, CAST(sum(data::INT) AS BIGINT) AS data_files,
               coalesce(string_agg(DISTINCT CASE WHEN data THEN suffix END, ',' ORDER BY CASE WHEN data THEN suffix END), '') AS data_types,
               false AS api_docs_found, max(license) AS license,
               max(CASE WHEN license IS NOT NULL THEN 'LICENSE' END) AS license_file_path,
               round_even(least(sum(data::INT) * 1.5::DOUBLE, 15) + sum(coalesce(csv_ok, false)::INT) * 2
                 + least(sum(coalesce(json_ok, false)::INT) * 0.5::DOUBLE, 10)
                 + CASE WHEN bool_or(regexp_matches(name, '^(sample|example|test|demo|data)')) THEN 3 ELSE 0 END
                 + coalesce(max(CASE WHEN name = 'README.md' AND regexp_matches(content, '(https?://[^\s]*api[^\s]*|/api/v?\d|endpoint|REST\s*API|GraphQL)', 'i') THEN 5 END), 0)
                 + coalesce(max(CASE WHEN name = 'README.md' THEN CASE WHEN size > 2000 THEN 5 WHEN size > 500 THEN 3 ELSE 0 END END), 0)
                 + CASE WHEN max(license) IS NOT NULL THEN 2 ELSE 0 END, 1) AS quality_score
        FROM checked GROUP BY repo)""",
}
NEEDS = {
    "repo_meta": ["license_texts"],
    "findings": ["headers"],
    "quality": ["corpus_files"],
}


def _views(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for view in [*_views(NEEDS.get(name, [])), name]:
            if view not in ordered:
                ordered.append(view)
    return ordered


def using(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in _views(list(names))) + "\n" + body


def _stats(source: str, columns: list[str], prefix: str = "WITH ") -> str:
    """Statistics of text columns, one branch per column."""
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", count(*) AS total,
                count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS blank,
                count(v) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi
            FROM (SELECT {c}, CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '{NUMBER}')
                         THEN try_cast(CAST({c} AS VARCHAR) AS DOUBLE) END AS v FROM {source})"""
        )
    return (
        f"{prefix}measured AS ("
        + " UNION ALL ".join(parts)
        + """), judged AS (SELECT *, n > 0 AND n > (total - blank) * 0.5 AS is_numeric FROM measured)
        SELECT position, "column", total AS total_rows, round_even(blank / greatest(total, 1), 3) AS null_ratio,
               is_numeric AS "numeric", CASE WHEN is_numeric THEN n END AS "count",
               CASE WHEN is_numeric THEN round_even(s / n, 3) END AS "mean",
               CASE WHEN is_numeric THEN round_even(lo, 3) END AS "min",
               CASE WHEN is_numeric THEN round_even(hi, 3) END AS "max"
        FROM judged"""
    )


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _guess(source: str, order: str, columns: list[str], start: int = 0, limit: str = "LIMIT 10") -> str:
    """Type guess by the first ten rows, or others, one branch per column."""
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"""SELECT CAST({i + start} AS BIGINT) AS position, '{c[0]}' AS "column",
                CASE WHEN NOT coalesce(bool_and(digits), false) THEN 'string'
                     WHEN bool_or(contains(v, '.')) THEN 'float'
                     WHEN bool_or(contains(v, '-')) THEN CASE WHEN length(arg_min(v, o)) = 10 THEN 'date' ELSE 'string' END
                     ELSE 'int' END AS type_guess, bool_or(v IS NULL) AS nullable
            FROM (SELECT o, v, regexp_matches(replace(replace(v, '.', ''), '-', ''), '^[0-9]+$') AS digits FROM (
                SELECT {order} AS o, nullif(CASE WHEN trim({c[1]}) = '' THEN '' ELSE {c[1]} END, '') AS v
                FROM {source} ORDER BY {order} {limit}))"""
        )
    return " UNION ALL ".join(parts)


_GUESSABLE = [("o_orderkey", "key_text")] + [
    (c, c) for c in ("whole", "fraction", "day", "dashed", "gaps", "nothing", "o_orderstatus")
]
_CUSTOMER_TEXT = [("c_custkey", "CAST(c_custkey AS VARCHAR)")] + [
    (c, c) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
]

_TYPES = {
    "region": "r_regionkey (integer), r_name (string)",
    "nation": "n_nationkey (integer), n_name (string), n_regionkey (integer)",
    "customer": "c_custkey (integer), c_name (string), c_nationkey (integer), c_acctbal (number), c_mktsegment (string)",
    "supplier": "s_suppkey (integer), s_name (string), s_nationkey (integer), s_acctbal (number)",
    "part": "p_partkey (integer), p_name (string), p_brand (string), p_type (string), p_size (integer), p_retailprice (number)",
    "orders": "o_orderkey (integer), o_custkey (integer), o_orderstatus (string), o_totalprice (number), o_orderdate (time), o_orderpriority (string)",
    "lineitem": "l_orderkey (integer), l_partkey (integer), l_suppkey (integer), l_linenumber (integer), l_quantity (number), l_extendedprice (number), l_discount (number), l_tax (number), l_returnflag (string), l_linestatus (string), l_shipdate (time)",
    "events": "event_id (integer), ts (time), user_id (integer), event_type (string), value (number), props (string)",
    "documents": "doc_id (integer), text (string), lang (string), source (string), n_chars (integer)",
}


def _tokens_of(query_tokens: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in query_tokens) + "]"


def _search(tokens: list[str], types: list[str], wants_api: bool) -> str:
    """Scores of one query over repo_meta with its token sets."""
    api = "+ CASE WHEN api_docs_found THEN 2.0 ELSE 0 END" if wants_api else ""
    typed = f"+ CASE WHEN list_has_any(data_types, {_tokens_of(types)}) THEN 2.0 ELSE 0 END" if types else ""
    return f"""SELECT seq, repo_name, CAST(
            list_sum(list_transform({_tokens_of(tokens)}, lambda t:
                CASE WHEN list_contains(tokens, t) THEN 1.0 ELSE 0 END
                + CASE WHEN contains(lower(repo_name), t) THEN 1.5 ELSE 0 END
                + CASE WHEN contains(lower(description), t) THEN 0.5 ELSE 0 END))
            {typed} {api} AS DOUBLE) + quality_score * 0.02::DOUBLE AS score
        FROM tokenized"""


_TOKENIZED = r"""tokenized AS (
    SELECT *, list_distinct(list_filter(list_concat(
        regexp_split_to_array(lower(repo_name), '[\s\-_/.,]+'),
        list_transform(tags, lambda t: lower(t)), list_transform(data_types, lambda t: lower(t)),
        list_filter(regexp_split_to_array(lower(description), '[^\p{L}\p{M}\p{N}_]+'), lambda w: length(w) > 2),
        list_filter(regexp_split_to_array(lower(structure_summary), '[^\p{L}\p{M}\p{N}_]+'), lambda w: length(w) > 2)
        ), lambda t: trim(t) <> '')) AS tokens
    FROM repo_meta)"""


def _tokenized(body: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in _views(["repo_meta"])) + ",\n" + _TOKENIZED + "\n" + body


_BATCH = [
    (1, ["the", "station", "of", "json", "feedback"], [".json", ".db"], False),
    (2, ["src2", "de", "und", "schen"], [], False),
    (3, ["rest", "endpoint", "le", "reaux"], [], True),
    (4, ["tabular", "state"], [".csv"], False),
    (5, ["xyzzy"], [], False),
]

_KEPT = """SELECT key, score, seq FROM snapshots
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, seq) = 1"""

_CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
_SUPPLIER = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"
_PART = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"

_DOCUMENT = "SELECT doc_id, sha256(text) AS text_hash, lang, source, n_chars FROM documents"


def _column_types(tables: dict[str, list[str]]) -> str:
    """The narrowest type that holds the text of all values of every column."""
    parts = []
    for name, columns in tables.items():
        for position, column in enumerate(columns):
            text = f"CAST({column} AS VARCHAR)"
            parts.append(f"""SELECT '{name}' AS "table", count(*) AS rows, CAST({position} AS BIGINT) AS position, '{column}' AS "column",
                CASE WHEN bool_and(typeof({column}) LIKE 'TIMESTAMP%') THEN 'timestamp'
                     WHEN bool_and(try_cast({text} AS INTEGER) IS NOT NULL AND NOT contains({text}, '.')) THEN 'int'
                     WHEN bool_and(try_cast({text} AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type FROM {name}""")
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    # sources
    "csv_quoted_table": "SELECT *, (SELECT count(*) FROM documents) AS rows FROM (" + _DOCUMENT + ")",
    "csv_quoted_to_parquet": _DOCUMENT,
    "csv_damaged": """SELECT CAST(CASE WHEN event_id % 9 = 0 THEN 2 ELSE 5 END AS BIGINT) AS pieces, count(*) AS records,
        CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 9 < 2 GROUP BY 1""",
    "csv_tree_types": _column_types({
        "nation": ["n_nationkey", "n_name", "n_regionkey"],
        "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    }),
    "json_batch_convert": """SELECT 'o_orderkey' AS key, o_orderkey AS id, o_totalprice AS amount FROM orders
        UNION ALL SELECT 's_suppkey', s_suppkey, s_acctbal FROM supplier""",
    "csv_table": _CUSTOMER,
    "csv_directory": """SELECT 'region' AS "table", count(*) AS rows, CAST(2 AS BIGINT) AS columns FROM region
        UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier
        UNION ALL SELECT 'customer', count(*), 5 FROM customer""",
    "csv_raw": using("ragged", body="SELECT * FROM ragged"),
    "csv_raw_multiline": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text_hash, lang, source,
        CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "parquet_table": "SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part) AS rows FROM part",
    "json_table": _SUPPLIER,
    "metadata_dir": using(
        "repo_meta",
        body="""SELECT repo_name, repo_url, stars, quality_score, array_to_string(tags, ',') AS tags, license, '' AS language
        FROM repo_meta WHERE seq % 10 <> 3""",
    ),
    "file_inventory": using(
        "corpus_files",
        body="""SELECT path, name, size, suffix,
        suffix IN ('.csv', '.json', '.md', '.txt', '.py', '.xml', '.yml', '.yaml') AS preview FROM corpus_files""",
    ),
    "data_file_list": using(
        "corpus_files", body=r"SELECT DISTINCT path, size FROM corpus_files WHERE regexp_matches(name, '\.(csv|json)$')"
    ),
    "object_listing": "SELECT DISTINCT o_orderstatus AS status, true AS has_bytes FROM orders",
    "api_payload_rows": """SELECT o_custkey, o_orderkey AS order_id, o_orderstatus AS status FROM orders
        """,
    "api_repo_items": """SELECT doc_id, source || '/' || doc_id AS repo_name,
        'https://example.org/' || source || '/' || doc_id AS repo_url, 'github_api' AS mirror_name,
        CASE WHEN doc_id % 4 <> 0 THEN text ELSE '' END AS description, n_chars AS stars, lang AS language,
        lang || ',' || source AS tags FROM documents WHERE doc_id % 6 <> 0""",
    # sinks
    "csv_to_parquet": _CUSTOMER,
    "json_to_parquet": _SUPPLIER,
    "conversion_sizes": "SELECT count(*) > 0 AS smaller, count(*) > 0 AS in_range FROM lineitem",
    "batch_convert_plan": using(
        "corpus_files",
        body=r""", stems AS (SELECT *, regexp_replace(path, '\.[^./]+$', '') AS stem FROM corpus_files)
        SELECT path, CASE WHEN suffix NOT IN ('.csv', '.json') THEN 'skip'
            WHEN stem NOT LIKE '%5' AND newest > 0 THEN 'skip' ELSE 'convert' END AS action
        FROM (SELECT *, max(size % 3 - 1) OVER (PARTITION BY stem) AS newest FROM stems)""",
    ),
    "batch_convert": """SELECT 'region' AS "table", count(*) AS rows, true AS second_run_skips FROM region
        UNION ALL SELECT 'nation', count(*), true FROM nation UNION ALL SELECT 'supplier', count(*), true FROM supplier""",
    "export_parquet": _PART,
    "export_csv": _PART,
    "export_json": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE lower(p_name) LIKE '%red%'",
    "write_append": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "write_replace": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'",
    "write_merge": """SELECT c_custkey AS key, c_acctbal AS score FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""",
    "license_report": using(
        "repo_meta",
        body="""SELECT row_number() OVER (ORDER BY slug) AS number, slug, repo_name, coalesce(license, 'Unknown') AS license, repo_url
        FROM (SELECT *, mirror_name || '_' || seq AS slug FROM repo_meta)""",
    ),
    # catalog
    "list_tables": " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS rows, CAST({i} AS BIGINT) AS position, '{c.split(" (")[0]}' AS "column" """
        for t, columns in _TYPES.items()
        for i, c in enumerate(columns.split(", "))
    ),
    "schema_context": " UNION ALL ".join(
        f"SELECT 'Table ''{t}'' (' || count(*) || ' rows): {columns}' AS line FROM {t}" for t, columns in _TYPES.items()
    ),
    # browse
    "rows_filter": using(
        "customer_text",
        body="""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer_text
        WHERE contains(lower(c_mktsegment), 'build')""",
    ),
    "rows_sort": """(SELECT 'number' AS kind, c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 100)
        UNION ALL (SELECT 'number_desc', c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 100)
        UNION ALL (SELECT 'text', c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 100)
        UNION ALL (SELECT 'text_desc', c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 100)
        UNION ALL (SELECT 'input', c_custkey FROM customer ORDER BY c_custkey LIMIT 100)""",
    "rows_sort_all": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer",
    # A negative balance keeps its dash out of the digit test, so the column still sorts as numbers.
    "rows_page": """SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer
        ORDER BY customer.c_acctbal DESC, c_custkey LIMIT 50 OFFSET 75""",
    "rows_totals": "SELECT count(*) AS total, count(*) FILTER (contains(lower(c_name), '00001')) AS filtered_total FROM customer",
    "preview": """SELECT o_orderkey, o_custkey, o_orderstatus, least((SELECT count(*) FROM orders), 500) AS total_rows,
        (SELECT count(*) FROM orders) >= 500 AS truncated FROM orders ORDER BY o_orderkey LIMIT 500""",
    "content_preview": using(
        "corpus_files",
        body="""SELECT path, CASE WHEN suffix = '.csv' THEN 'csv' WHEN suffix = '.json' THEN 'json'
            WHEN suffix IN ('.md', '.txt') THEN 'text' ELSE 'binary' END AS kind,
        CASE WHEN suffix IN ('.json', '.md', '.txt') THEN left(content, 50000) END AS content,
        CASE WHEN suffix = '' THEN CASE WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE)
            WHEN size < 1048576 THEN printf('%.1f KB', round_even(size / 1024, 1))
            ELSE printf('%.1f MB', round_even(size / 1048576, 1)) END END AS size_human
        FROM corpus_files""",
    ),
    "chart_series": """SELECT o_orderkey, o_orderstatus AS label, o_totalprice AS value
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200) WHERE o_orderkey % 5 <> 0""",
    # profile
    "column_stats": _stats("lineitem", _LINEITEM),
    "column_stats_text": _stats("lineitem", _LINEITEM),
    "column_stats_long": _stats("orders", _ORDERS),
    "column_stats_ragged": using("ragged", body=_stats("ragged", ["id", "kind", "value", "day"], ", ")),
    "csv_profile": using(
        "ragged",
        body=" UNION ALL ".join(
            f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", count(*) AS total_rows,
            count(*) FILTER (cells <> 4) AS inconsistent_rows,
            round_even(count(*) FILTER (cells > {i} AND ({c} IS NULL OR trim({c}) = '')) / count(*), 3) AS null_ratio FROM ragged"""
            for i, c in enumerate(["id", "kind", "value", "day"])
        ),
    ),
    "date_columns": """WITH head AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20)
        SELECT CAST(1 AS BIGINT) AS position, 'day' AS "column" FROM head HAVING count(*) >= 3
        UNION ALL SELECT CAST(2 AS BIGINT), 'gaps' FROM head HAVING count(*) FILTER (o_orderkey % 4 <> 0) / count(*) >= 0.7
        UNION ALL SELECT CAST(3 AS BIGINT), 'holes' FROM head HAVING count(*) FILTER (o_orderkey % 2 <> 0) / count(*) >= 0.7""",
    "infer_types": using("guessable", body=_guess("guessable", "o_orderkey", _GUESSABLE)),
    "infer_types_batch": using(
        "guessable",
        "customer_text",
        body="SELECT 'orders' AS \"table\", *, CAST(NULL AS VARCHAR) AS error FROM ("
        + _guess("guessable", "o_orderkey", _GUESSABLE)
        + ") UNION ALL SELECT 'customer', *, CAST(NULL AS VARCHAR) FROM ("
        + _guess("customer_text", "c_custkey", _CUSTOMER_TEXT)
        + ")",
    ),
    "schema_json": using(
        "guessable",
        body="""SELECT '{"dataset":"orders-1","schema":{"fields":[' || string_agg(
            '{"fieldPath":"' || "column" || '","description":"' || "column" || '","nativeDataType":"' || type_guess
            || '","nullable":' || nullable || ',"tags":["unknown"]}', ',' ORDER BY position) || ']}}' AS document
        FROM (""" + _guess("guessable", "o_orderkey", _GUESSABLE) + ")",
    ),
    "chart_suggestion": """SELECT 'bar' AS chart_type, CAST(1 AS BIGINT) AS numeric_columns, 'o_orderstatus' AS x_axis,
            'avg_price' AS y_axes, 'Average price by status' AS title FROM orders HAVING count(*) > 0
        UNION ALL SELECT 'line', 2, 'o_orderdate', 'avg_price,n', 'Price trend by day'
        UNION ALL SELECT 'bar', 2, 'o_orderdate', 'avg_price,n', 'Price by day'
        UNION ALL SELECT 'table', 0, NULL, NULL, 'All orders'""",
    # corpus and governance
    "json_valid": """SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS valid, 'event' AS origin
        FROM events UNION ALL SELECT doc_id, json_valid(text), 'document' FROM documents""",
    "xml_report_titles": """SELECT page_id, page_id % 4 <> 0 AS valid, CASE WHEN page_id % 4 <> 0 THEN 'page' END AS root_tag,
        CAST(CASE WHEN page_id % 4 <> 0 THEN 3 ELSE 0 END AS BIGINT) AS unique_elements FROM pages""",
    "pii_columns": using("findings", body="SELECT * FROM findings"),
    "pii_by_file": using(
        "findings",
        body="""SELECT dataset, count(pii_kind) > 0 AS pii_flagged, count(pii_kind) AS findings,
        coalesce(string_agg(DISTINCT pii_kind, ',' ORDER BY pii_kind), '') AS pii_fields
        FROM (SELECT DISTINCT dataset FROM headers) LEFT JOIN findings USING (dataset) GROUP BY dataset""",
    ),
    "pii_by_csv_file": using(
        "corpus_files",
        body=r""", names AS (
            SELECT repo, path, unnest(string_split(regexp_extract(content, '^\x{FEFF}?([^\r\n]*)', 1), ',')) AS n
            FROM corpus_files WHERE suffix = '.csv'),
        kinds AS (SELECT repo, path, [
            CASE WHEN regexp_matches(n, 'email|e-mail', 'i') THEN 'email' END,
            CASE WHEN regexp_matches(n, 'phone|cell|mobile|contact_number', 'i') THEN 'phone' END,
            CASE WHEN regexp_matches(n, 'address|street|city|state|zip|postal|location|residence', 'i') THEN 'address' END,
            CASE WHEN regexp_matches(n, '(first|last|full|given|middle)_name|surname', 'i') THEN 'name' END,
            CASE WHEN regexp_matches(n, 'ssn|social_security|national_id|tax_id', 'i') THEN 'ssn' END,
            CASE WHEN regexp_matches(n, 'ip_addr|client_ip|remote_addr', 'i') THEN 'ip' END] AS k FROM names)
        SELECT repo, path, count(kind) > 0 AS pii_flagged, count(kind) AS findings,
               coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS pii_fields
        FROM (SELECT repo, path, unnest(k) AS kind FROM kinds) GROUP BY repo, path""",
    ),
    "license_detect": using("license_texts", body="SELECT doc_id, license FROM license_texts"),
    "license_detect_whole_text": "WITH "
    + VIEWS["license_texts"]
    + " SELECT doc_id, license FROM license_texts",
    "license_by_repo": using(
        "license_texts",
        body="SELECT 'repo_' || (doc_id // 10) AS repo, license, 'LICENSE' AS license_file_path FROM license_texts WHERE doc_id % 10 = 0",
    ),
    "license_summary": using(
        "repo_meta", body="SELECT repo_name, repo_url, coalesce(license, 'Unknown') AS license, quality_score FROM repo_meta"
    ),
    "license_summary_joined": using(
        "repo_meta", body="SELECT repo_name, repo_url, coalesce(license, 'Unknown') AS license, quality_score FROM repo_meta"
    ),
    "license_counts": using(
        "repo_meta",
        body="""SELECT coalesce(license, 'Unknown') AS license, count(*) AS repos,
        (SELECT count(license) FROM repo_meta) AS licensed, (SELECT count(*) FROM repo_meta) AS total
        FROM repo_meta GROUP BY 1""",
    ),
    "api_docs": using(
        "corpus_files",
        body=r"""SELECT repo, coalesce(bool_or(name = 'meta_5.json' AND size % 3 = 0), false) AS api_docs_found,
        coalesce(bool_or(name = 'README.md' AND (size % 2 = 0 OR
            regexp_matches(content, '(https?://[^\s]*api[^\s]*|/api/v?\d|endpoint|REST\s*API|GraphQL)', 'i'))), false) AS readme_mentions_api
        FROM corpus_files GROUP BY repo""",
    ),
    # quality
    "repo_quality": using("quality", body="SELECT * FROM quality"),
    "structure_summary": using(
        "quality",
        body="""SELECT q.repo, 'Language: ' || coalesce(language, 'unknown') || ' | Stars: ' || coalesce(stars, 0)
            || CASE WHEN data_types <> '' THEN ' | Data types: ' || replace(data_types, ',', ', ') ELSE '' END
            || CASE WHEN data_files > 0 THEN ' | Data files (' || data_files || '): ' || first_files ELSE '' END
            || CASE WHEN q.license IS NOT NULL THEN ' | License: ' || q.license ELSE '' END
            || ' | Quality score: ' || quality_score || '/50 | Total files: ' || total_files AS structure_summary
        FROM quality q
        LEFT JOIN (SELECT repo, array_to_string(list(name ORDER BY name)[1:5], ', ') AS first_files
                   FROM checked WHERE data GROUP BY repo) f ON q.repo = f.repo
        LEFT JOIN (SELECT 'repo_' || (doc_id // 10) AS repo, min(lang) AS language, max(n_chars) AS stars
                   FROM documents GROUP BY 1) d ON q.repo = d.repo""",
    ),
    "quality_gate": using("quality", body="SELECT repo, quality_score FROM quality WHERE quality_score >= 5"),
    "candidate_select": """WITH blocked AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY')
        SELECT 'https://example.org/' || o_custkey AS repo_url, arg_min(CAST(trunc(o_totalprice) AS BIGINT), o_orderkey) AS stars,
               min(o_orderkey) AS seq, 'search' AS origin
        FROM orders WHERE trunc(o_totalprice) >= 200000 AND o_custkey NOT IN (SELECT k FROM blocked) GROUP BY o_custkey
        UNION ALL
        SELECT 'https://example.org/' || s_suppkey, CAST(trunc(s_acctbal) AS BIGINT), s_suppkey, 'seed'
        FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM blocked)""",
    "score_bands": using(
        "quality",
        body="""SELECT CASE WHEN quality_score >= 30 THEN 'high' WHEN quality_score >= 15 THEN 'mid' ELSE 'low' END AS band,
        count(*) AS repos FROM quality GROUP BY 1""",
    ),
    "lake_projects": using(
        "quality",
        body="""SELECT q.repo, CASE WHEN total_files > 8 AND NOT (quality_score >= 5 AND quality_score > (total_files % 3) * 10)
                           THEN (total_files % 3) * 10.0::DOUBLE ELSE quality_score END AS quality_score, license, total_files
        FROM quality q WHERE total_files > 8 OR quality_score >= 5""",
    ),
    "lake_file_records": using(
        "quality",
        body="""SELECT sha256(content) AS sha256, name, arg_min(repo, path) AS repo, min(path) AS path, min(size) AS size, min(suffix) AS suffix,
        arg_min(suffix = '.csv' AND regexp_matches(line, 'email|e-mail|phone|cell|mobile|address|street|city|state|zip|postal|location', 'i'), path) AS pii_flagged,
        coalesce(arg_min(CASE WHEN suffix = '.csv' THEN array_to_string(list_sort(list_filter([
            CASE WHEN regexp_matches(line, 'email|e-mail', 'i') THEN 'email' END,
            CASE WHEN regexp_matches(line, 'phone|cell|mobile|contact_number', 'i') THEN 'phone' END,
            CASE WHEN regexp_matches(line, 'address|street|city|state|zip|postal|location|residence', 'i') THEN 'address' END
            ], lambda k: k IS NOT NULL)), ',') ELSE '' END, path), '') AS pii_fields,
        'raw/' || left(sha256(content), 2) || '/' || sha256(content) || '_' || name AS storage_path
        FROM (SELECT *, regexp_extract(content, '^([^\r\n]*)', 1) AS line FROM checked
              WHERE data AND repo IN (SELECT repo FROM quality WHERE quality_score >= 5)) GROUP BY sha256(content), name""",
    ),
    # merge
    "cas_dedup": using(
        "corpus_files",
        body="""SELECT h AS sha256, name, min(path) AS first_path, min(size) AS size, count(*) AS copies,
        'raw/' || left(h, 2) || '/' || h || '_' || name AS storage_path
        FROM (SELECT *, sha256(content) AS h FROM corpus_files) GROUP BY h, name""",
    ),
    "cas_dedup_hash": using(
        "corpus_files",
        body="""SELECT h AS sha256, min(path) AS first_path, arg_min(name, path) AS name, min(size) AS size, count(*) AS copies,
        'raw/' || left(h, 2) || '/' || h || '_' || arg_min(name, path) AS storage_path
        FROM (SELECT *, sha256(content) AS h FROM corpus_files) GROUP BY h""",
    ),
    "flat_layout": using(
        "corpus_files",
        body="""SELECT target_path, max(path) AS source_path, count(*) AS files FROM (
            SELECT path, 'data/structured/' || CASE suffix WHEN '.csv' THEN 'csv' WHEN '.json' THEN 'json' ELSE 'unstructured/raw' END
                   || '/' || repo || '_' || name AS target_path FROM corpus_files) GROUP BY target_path""",
    ),
    "store_if_better": using("snapshots", body=_KEPT),
    "version_history": using(
        "snapshots",
        body="SELECT key, score, seq FROM snapshots QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) <= 10",
    ),
    "upsert": """WITH known AS (SELECT c_custkey AS k, 'customer ' || c_custkey AS n, c_acctbal AS s FROM customer WHERE c_acctbal > 4500),
        batch AS (SELECT o_custkey AS k, 'order ' || min(o_orderkey) AS n, arg_max(o_totalprice, o_orderkey) AS s,
                         arg_max(o_orderstatus, o_orderkey) AS l, arg_max(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS u
                  FROM orders GROUP BY o_custkey)
        SELECT coalesce(known.k, batch.k) AS repo_url, coalesce(known.n, batch.n) AS repo_name, coalesce(batch.s, known.s) AS quality_score,
               coalesce(l, 'U') AS license, coalesce(u, '2000-01-01') AS updated_at
        FROM known FULL JOIN batch ON known.k = batch.k""",
    "insert_ignore": using(
        "corpus_files",
        body=""", hashed AS (SELECT sha256(content) AS h, name, path, suffix FROM corpus_files)
        SELECT h AS sha256, name, min(path) AS path FROM hashed
        WHERE (h, name) NOT IN (SELECT (h, name) FROM hashed WHERE suffix = '.csv') GROUP BY h, name""",
    ),
    "hash_exists": """SELECT doc_id, sha256(text) AS sha256,
        sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0') AS stored FROM documents""",
    "metadata_import": using(
        "repo_meta",
        body="""SELECT 'a' || seq AS slug, repo_name, repo_url, CASE WHEN seq % 4 <> 0 THEN stars ELSE 0 END AS stars,
        CASE WHEN seq % 4 <> 0 THEN language ELSE '' END AS language,
        CASE WHEN seq % 4 <> 0 THEN quality_score ELSE 0 END AS quality_score, license,
        '["' || language || '","' || mirror_name || '"]' AS tags,
        CASE WHEN seq % 4 <> 0 THEN strftime(ingested_at, '%Y-%m-%d %H:%M:%S') END AS ingested_at
        FROM repo_meta WHERE language <> 'de'""",
    ),
    # search
    "inverted_index": _tokenized(
        """SELECT token, CAST(seq // 4096 AS BIGINT) AS block, count(*) AS repos, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS keys
        FROM (SELECT seq, trim(unnest(tokens)) AS token FROM tokenized) GROUP BY token, seq // 4096"""
    ),
    "index_lookup": _tokenized(
        """SELECT token, seq FROM (SELECT seq, unnest(tokens) AS token FROM tokenized)
        WHERE token IN ('the', 'src1', 'csv', '.csv', 'leaux')"""
    ),
    "search_topk": _tokenized(
        "SELECT seq, repo_name, round(score, 6) AS score FROM ("
        + _search(["the", "reaux", "csv", "api", "src1"], [".csv"], True)
        + ") WHERE score > 0 ORDER BY score DESC, seq LIMIT 10"
    ),
    "search_batch": _tokenized(
        "SELECT seq, repo_name, query_id, round(score, 6) AS score FROM ("
        + " UNION ALL ".join(
            f"SELECT *, CAST({q} AS BIGINT) AS query_id FROM ({_search(tokens, types, wants)})" for q, tokens, types, wants in _BATCH
        )
        + ") WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) <= 10"
    ),
    "search_substring": using(
        "repo_meta",
        body="""SELECT seq, repo_name, quality_score FROM repo_meta WHERE contains(lower(description), 'thanedble')""",
    ),
    "search_sidebar": using(
        "repo_meta",
        body="""SELECT seq, repo_name FROM repo_meta WHERE contains(lower(repo_name || ' ' || description || ' '
        || array_to_string(tags, ' ') || ' ' || array_to_string(data_types, ' ')), 'de src1')""",
    ),
    "lake_stats": using(
        "repo_meta",
        body="""SELECT count(*) AS total_repos, CAST(sum(n_files) AS BIGINT) AS total_data_files,
        (SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(data_types) AS t FROM repo_meta)) AS data_types,
        count(*) FILTER (api_docs_found) AS api_docs_count, round_even(avg(quality_score), 1) AS avg_quality_score,
        count(license) AS licensed_count FROM repo_meta""",
    ),
    "recent": using(
        "repo_meta",
        body="""SELECT seq, repo_name, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at FROM repo_meta
        ORDER BY repo_meta.ingested_at DESC, seq LIMIT 10""",
    ),
    "best": using(
        "repo_meta", body="SELECT seq, repo_name, quality_score FROM repo_meta ORDER BY quality_score DESC, seq LIMIT 25"
    ),
    "list_all_repos": using("repo_meta", body="SELECT seq, repo_name, quality_score FROM repo_meta"),
    # web pages
    "page_links": using("links", body="SELECT page_id, position, href, url FROM links"),
    "data_links": using(
        "links",
        body="""SELECT page_id, position, '/data' || href || '.CSV' AS href,
        left(url, length(url) - length(href)) || '/data' || href || '.CSV' AS url FROM links""",
    ),
    "project_links": using(
        "links",
        body=""", named AS (SELECT page_id, position,
            'data/' || split_part(ltrim(href, '/') || '.CSV', '/', 1) AS repo_name FROM links)
        SELECT page_id, position, repo_name, 'https://mirror.example.org/' || repo_name AS repo_url FROM named
        WHERE repo_name NOT IN (SELECT 'data/' || regexp_extract(html, 'href="/([^"]*)"', 1) || '.CSV' FROM pages)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 3""",
    ),
    # health
    "health_score": using("scores", body="SELECT * FROM health"),
    "health_stats": using(
        "scores",
        body="""SELECT count(*) AS total, count(*) FILTER (alive) AS alive, count(*) FILTER (NOT alive) AS dead,
        coalesce(round_even(avg(score) FILTER (alive), 1), 0) AS avg_score,
        (SELECT entity FROM health WHERE alive ORDER BY score DESC, entity LIMIT 1) AS top_entity FROM health""",
    ),
    "weighted_sample": using(
        "scores",
        body="""SELECT entity, score FROM health WHERE alive
        ORDER BY score <= 0, -ln((CAST(('0x' || left(md5(CAST(entity AS VARCHAR) || '7'), 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / CASE WHEN score > 0 THEN score ELSE 1 END, entity
        LIMIT 5""",
    ),
    # incremental forms
    "stream_convert": _PART,
    "stream_keep_better": using("snapshots", body=_KEPT),
    "stream_upsert": """SELECT o_custkey AS repo_url, min(o_orderkey) AS first_seq, arg_max(o_totalprice, o_orderkey) AS quality_score,
        arg_max(o_orderstatus, o_orderkey) AS license, arg_max(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS updated_at
        FROM orders GROUP BY o_custkey""",
    "stream_insert_ignore": using(
        "snapshots", body="SELECT key, license, arg_min(score, seq) AS score, min(seq) AS seq FROM snapshots GROUP BY key, license"
    ),
    "stream_health": using("scores", body="SELECT * FROM health"),
    # statements
    "sql_guard": r"""SELECT o_orderkey, sql, regexp_matches(sql, '\b(DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE|CREATE)\b', 'i') AS refused
        FROM (SELECT o_orderkey, CASE o_orderkey % 8
            WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey
            WHEN 1 THEN 'delete from orders where o_orderkey = ' || o_orderkey
            WHEN 2 THEN 'SELECT ''update'' AS updated, ' || o_orderkey
            WHEN 3 THEN 'COPY t_' || o_orderkey || ' TO ''x'''
            WHEN 4 THEN 'WITH x AS (SELECT ' || o_orderkey || ') INSERT INTO t SELECT * FROM x'
            WHEN 5 THEN 'SELECT created, ' || o_orderkey || ' FROM updates'
            WHEN 6 THEN 'Drop TABLE t_' || o_orderkey
            ELSE '/* alter */ SELECT ' || o_orderkey END AS sql FROM orders)""",
    "extract_sql": "SELECT conv_id, turn, 'SELECT ' || conv_id AS sql FROM conversations",
    "extract_json": """SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'Here: ' || props WHEN event_id % 5 = 3 THEN NULL ELSE props END AS json,
        event_id % 5 NOT IN (2, 3) AS valid FROM events""",
    # column functions
    "scalar_functions": r"""SELECT doc_id, source || '_ünï_x_' || doc_id || '.v1' AS slug,
        '_' || source || '_Ünï_x_' || doc_id || '_v1_' AS table_name,
        CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', round_even(n_chars / 1024, 1)) END AS size,
        CASE WHEN n_chars * 123457 < 1048576 THEN printf('%.1f KB', round_even(n_chars * 123457 / 1024, 1))
             WHEN n_chars * 123457 < 1073741824 THEN printf('%.1f MB', round_even(n_chars * 123457 / 1048576, 1))
             ELSE printf('%.1f GB', round_even(n_chars * 123457 / 1073741824, 1)) END AS big_size,
        sha256(text) AS sha256 FROM documents""",
}

for _name, (_spark_sql, _check) in conformance.STATEMENTS.items():
    ORACLES[_name] = _check or _spark_sql

# What is guessed from the first rows, guessed from all.
for _name in ("date_columns", "infer_types", "infer_types_batch", "schema_json"):
    ORACLES[f"{_name}_whole"] = ORACLES[_name].replace(" LIMIT 20", "").replace(" LIMIT 10", "")
ORACLES["candidate_select_filtered"] = ORACLES["candidate_select"]
# The stored indexes answer the same questions as the scans.
for _name in ("search_topk", "search_batch", "search_substring", "search_sidebar"):
    ORACLES[f"index_{_name}"] = ORACLES[_name]
_RUNS = r"""list_filter(list_distinct(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+')), lambda w: w <> '')"""
ORACLES["term_index"] = using(
    "repo_meta",
    body=" UNION ALL ".join(
        f"""SELECT '{place}' AS place, count(DISTINCT w) AS terms, count(*) AS entries
        FROM (SELECT unnest({_RUNS.format(column)}) AS w FROM repo_meta)"""
        for place, column in (("name", "repo_name"), ("description", "description"))
    ),
)
