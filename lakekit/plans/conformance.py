"""SQL statements that users of the SQL entry run, one per family.

Each entry is ``name: (Spark SQL, SQL of the check)``; None means the same text.
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

STATEMENTS: dict[str, tuple[str, str | None]] = {
    "sql_group_avg": (
        "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY c_mktsegment",
        None,
    ),
    "sql_top_avg": (
        """SELECT n_name, round(avg(c_acctbal), 4) AS avg_balance
           FROM customer JOIN nation ON c_nationkey = n_nationkey
           GROUP BY n_name ORDER BY avg_balance DESC, n_name LIMIT 5""",
        None,
    ),
    "sql_filter": ('SELECT "p_partkey", "p_name", "p_retailprice" FROM part WHERE "p_size" > 30', None),
    "sql_top_sum": (
        """SELECT p_type, round(sum(l_extendedprice), 2) AS sales
           FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL '1' YEAR
           GROUP BY p_type ORDER BY sales DESC, p_type LIMIT 3""",
        None,
    ),
    "sql_inner_join": (
        """SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
        None,
    ),
    "sql_left_join": (
        """SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(top, 0) AS top_price
           FROM customer LEFT JOIN (
             SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) t
           ON c_custkey = o_custkey""",
        None,
    ),
    "sql_full_join": (
        """SELECT c.k AS customer_nation, s.k AS supplier_nation, c.n AS customers, s.n AS suppliers
           FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) % 2 = 0) c
           FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) % 2 = 1) s
           ON c.k = s.k""",
        None,
    ),
    "sql_using_join": (
        """SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)""",
        None,
    ),
    "sql_semi_join": (
        "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
        "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    ),
    "sql_anti_join": (
        "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
        "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    ),
    "sql_exists": (
        """SELECT s_suppkey FROM supplier s
           WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)""",
        None,
    ),
    "sql_in_subquery": (
        """SELECT p_partkey, p_brand FROM part
           WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
             AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_size)""",
        None,
    ),
    "sql_lateral": (
        """SELECT n_name, t.customers FROM nation,
           LATERAL (SELECT count(*) AS customers FROM customer WHERE c_nationkey = n_nationkey) t""",
        None,
    ),
    "sql_scalar_subquery": (
        """SELECT c_custkey, c_acctbal FROM customer c
           WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)""",
        None,
    ),
    "sql_group_ordinal": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
        None,
    ),
    "sql_group_all": (
        "SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY ALL",
        None,
    ),
    "sql_agg_filter": (
        """SELECT event_type, count(*) FILTER (WHERE value > 10) AS high, round(avg(value) FILTER (WHERE value <= 10), 6) AS low_mean
           FROM events GROUP BY event_type""",
        None,
    ),
    "sql_count_distinct": (
        "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
        None,
    ),
    "sql_median": (
        "SELECT l_returnflag, median(l_quantity) AS middle FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "sql_percentile": (
        "SELECT l_linestatus, round(percentile(l_discount, 0.9), 4) AS p90 FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, round(quantile_cont(l_discount, 0.9), 4) AS p90 FROM lineitem GROUP BY l_linestatus",
    ),
    "sql_having": (
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
        None,
    ),
    "sql_grouping_sets": (
        """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
           GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
        None,
    ),
    "sql_cube": ("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)", None),
    "sql_rollup": (
        "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
        None,
    ),
    "sql_window_rank": (
        """SELECT l_orderkey, l_partkey, l_quantity,
                  CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS bigint) AS place,
                  CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS bigint) AS dense_place
           FROM lineitem""",
        None,
    ),
    "sql_window_running": (
        """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id
                  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS last_five,
                  lag(event_type) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS before
           FROM events""",
        None,
    ),
    "sql_top_per_group": (
        """SELECT o_custkey, o_orderkey FROM (
             SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
             FROM orders) t WHERE rn <= 2""",
        """SELECT o_custkey, o_orderkey FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
    ),
    "sql_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "sql_union_all": (
        """SELECT 'customer' AS origin, c_acctbal AS balance FROM customer
           UNION ALL SELECT 'supplier' AS origin, s_acctbal AS balance FROM supplier""",
        None,
    ),
    "sql_intersect_all": ("SELECT l_partkey AS k FROM lineitem INTERSECT ALL SELECT p_partkey AS k FROM part", None),
    "sql_except": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000",
        None,
    ),
    "sql_with": (
        """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
                big AS (SELECT o_custkey, total FROM spent WHERE total > (SELECT avg(total) FROM spent))
           SELECT c_mktsegment, count(*) AS customers, round(min(total), 2) AS lowest
           FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
        None,
    ),
    "sql_recursive": (
        """WITH RECURSIVE chain(k, depth) AS (
             SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_regionkey = 0
             UNION ALL SELECT n_nationkey AS k, depth + 1 AS depth FROM nation JOIN chain ON n_nationkey = k + 7)
           SELECT k, depth, count(c_custkey) AS customers FROM chain LEFT JOIN customer ON c_nationkey = k GROUP BY k, depth""",
        None,
    ),
    "sql_pivot": (
        """SELECT c_nationkey, coalesce(building, 0) AS building, coalesce(machinery, 0) AS machinery,
                  coalesce(furniture, 0) AS furniture
           FROM (SELECT c_mktsegment, c_nationkey, c_acctbal FROM customer)
           PIVOT (count(c_acctbal) FOR c_mktsegment IN ('BUILDING' AS building, 'MACHINERY' AS machinery, 'FURNITURE' AS furniture))""",
        """SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
                  count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery,
                  count(*) FILTER (c_mktsegment = 'FURNITURE') AS furniture
           FROM customer GROUP BY c_nationkey""",
    ),
    "sql_unpivot": (
        """SELECT p_partkey, name, value FROM (SELECT p_partkey, p_brand, p_type FROM part)
           UNPIVOT (value FOR name IN (p_brand, p_type))""",
        """SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part
           UNION ALL SELECT p_partkey, 'p_type' AS name, p_type AS value FROM part""",
    ),
    "sql_limit_offset": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
        None,
    ),
    "sql_from_first": ("FROM part SELECT p_brand, count(*) AS n GROUP BY p_brand", None),
    "sql_case": (
        """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size,
                  count(*) AS n FROM lineitem GROUP BY 1""",
        None,
    ),
    "sql_date_functions": (
        """SELECT CAST(extract(year FROM o_orderdate) AS bigint) AS year, CAST(extract(month FROM o_orderdate) AS bigint) AS month,
                  count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM orders WHERE date_trunc('quarter', o_orderdate) >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY 1, 2""",
        None,
    ),
    "sql_date_format": (
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS minute FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events",
    ),
    "sql_string_match": (
        """SELECT p_partkey, upper(p_name) AS name, CAST(length(p_type) AS bigint) AS type_chars FROM part
           WHERE p_name ILIKE '%RED%' OR contains(p_type, 'PROMO')""",
        None,
    ),
    "sql_regex": (
        "SELECT doc_id FROM documents WHERE regexp_like(text, '[0-9]{3}-[0-9]{4}')",
        "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')",
    ),
    "sql_json_field": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS bigint) AS k FROM events",
        "SELECT event_id, CAST(props ->> '$.k' AS bigint) AS k FROM events",
    ),
    "sql_list_agg": (
        """SELECT user_id, listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type) AS types
           FROM events GROUP BY user_id""",
        "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id",
    ),
    "sql_explode": (
        "SELECT vec_id, CAST(pos AS bigint) AS pos, CAST(value AS double) AS value FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, value",
        """SELECT vec_id, pos - 1 AS pos, CAST(embedding[pos] AS double) AS value
           FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)""",
    ),
    "sql_struct": (
        "SELECT s.label AS label, count(*) AS n FROM (SELECT named_struct('label', label, 'id', vec_id) AS s FROM embeddings) t GROUP BY 1",
        "SELECT s.label AS label, count(*) AS n FROM (SELECT {'label': label, 'id': vec_id} AS s FROM embeddings) t GROUP BY 1",
    ),
    "sql_except_columns": (
        "SELECT * EXCEPT (s_acctbal) FROM supplier",
        "SELECT * EXCLUDE (s_acctbal) FROM supplier",
    ),
    "sql_safe_division": (
        "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_discount) AS ratio FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem",
    ),
    "sql_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "sql_values": (
        """SELECT o_orderstatus, CAST(w.weight AS double) AS weight, count(*) AS n FROM orders
           JOIN (VALUES ('F', 1.5), ('O', 2.5), ('P', 4.0)) AS w(status, weight) ON o_orderstatus = w.status
           GROUP BY o_orderstatus, w.weight""",
        None,
    ),
}
