"""SELECT queries over the test tables: key, (Spark SQL, SQL for the check or None where it is the same)."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str | None]] = {
    # S1
    "scan_full": (
        'SELECT * FROM region',
        None,
    ),
    # P2
    "project_columns": (
        'SELECT c_custkey, c_name FROM customer',
        None,
    ),
    # P3
    "project_alias": (
        'SELECT c_custkey AS id, c_name AS nm FROM customer',
        None,
    ),
    # P5
    "arith_add_sub_mul": (
        'SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 1 AS s, l_linenumber * 3 AS m FROM lineitem',
        None,
    ),
    # P5/P6
    "arith_int_div_mod": (
        'SELECT l_orderkey, l_linenumber, l_orderkey DIV 7 AS d, l_orderkey % 7 AS r FROM lineitem',
        'SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS d, l_orderkey % 7 AS r FROM lineitem',
    ),
    # P7
    "unary_minus": (
        'SELECT c_custkey, -c_custkey AS neg FROM customer',
        None,
    ),
    # F1
    "filter_eq": (
        "SELECT * FROM orders WHERE o_orderstatus = 'F'",
        None,
    ),
    # F1
    "filter_ne": (
        "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
        None,
    ),
    # F1
    "filter_lt": (
        'SELECT o_orderkey FROM orders WHERE o_totalprice < 50000',
        None,
    ),
    # F1
    "filter_le": (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10',
        None,
    ),
    # F1
    "filter_gt": (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40',
        None,
    ),
    # F1
    "filter_ge": (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 40',
        None,
    ),
    # F2
    "filter_and": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'",
        None,
    ),
    # F2
    "filter_or": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 OR l_returnflag = 'R'",
        None,
    ),
    # F2
    "filter_and_or_precedence": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR l_returnflag = 'R' AND l_quantity > 40",
        None,
    ),
    # F3
    "filter_not": (
        "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')",
        None,
    ),
    # F4
    "filter_is_null": (
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL",
        None,
    ),
    # F4
    "filter_is_not_null": (
        "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NOT NULL",
        None,
    ),
    # F5
    "filter_in": (
        'SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)',
        None,
    ),
    # F5
    "filter_not_in": (
        'SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)',
        None,
    ),
    # F6
    "filter_between": (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20',
        None,
    ),
    # F6
    "filter_not_between": (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20',
        None,
    ),
    # F7
    "filter_like": (
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'",
        None,
    ),
    # F7
    "filter_not_like": (
        "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring%'",
        None,
    ),
    # F8
    "filter_ilike": (
        "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'",
        None,
    ),
    # F8
    "filter_not_ilike": (
        "SELECT n_name FROM nation WHERE n_name NOT ILIKE 'nation_1%'",
        None,
    ),
    # F9
    "filter_regex": (
        "SELECT p_partkey FROM part WHERE p_brand RLIKE '[0-4]$'",
        "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[0-4]$')",
    ),
    # F9
    "filter_not_regex": (
        "SELECT p_partkey FROM part WHERE NOT p_brand RLIKE '[0-4]$'",
        "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '[0-4]$')",
    ),
    # P8
    "case_when": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
        None,
    ),
    # D1
    "distinct_single": (
        'SELECT DISTINCT l_returnflag FROM lineitem',
        None,
    ),
    # D1
    "distinct_multi": (
        'SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem',
        None,
    ),
    # O1/O3
    "order_by_asc_limit": (
        'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC, o_orderkey ASC LIMIT 10',
        None,
    ),
    # O1/O3
    "order_by_desc_limit": (
        'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10',
        None,
    ),
    # O3/O4
    "limit_offset": (
        'SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 20',
        None,
    ),
    # O4
    "offset_only": (
        'SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20',
        None,
    ),
    # O1
    "order_by_nulls_first": (
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY st ASC NULLS FIRST, o_orderkey LIMIT 10",
        None,
    ),
    # A1
    "agg_count_star": (
        'SELECT COUNT(*) AS c FROM lineitem',
        None,
    ),
    # A1
    "agg_count_col_nulls": (
        "SELECT COUNT(NULLIF(o_orderstatus, 'F')) AS c FROM orders",
        None,
    ),
    # A2
    "agg_sum_int": (
        'SELECT SUM(l_linenumber) AS s FROM lineitem',
        'SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem',
    ),
    # A2
    "agg_sum_double": (
        'SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem',
        None,
    ),
    # A3
    "agg_avg": (
        'SELECT AVG(l_linenumber) AS a FROM lineitem',
        None,
    ),
    # A4/A5
    "agg_min_max_num": (
        'SELECT MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx FROM lineitem',
        None,
    ),
    # A4/A5
    "agg_min_max_str": (
        'SELECT MIN(n_name) AS mn, MAX(n_name) AS mx FROM nation',
        None,
    ),
    # A7
    "agg_empty_input": (
        'SELECT COUNT(*) AS c, SUM(n_nationkey) AS s, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0',
        'SELECT COUNT(*) AS c, CAST(SUM(n_nationkey) AS BIGINT) AS s, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0',
    ),
    # A6
    "group_by_single": (
        'SELECT l_returnflag, COUNT(*) AS c, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag',
        'SELECT l_returnflag, COUNT(*) AS c, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag',
    ),
    # A6
    "group_by_multi": (
        'SELECT l_returnflag, l_linestatus, COUNT(*) AS c, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus',
        None,
    ),
    # A6
    "group_by_expr": (
        'SELECT n_regionkey % 2 AS k, COUNT(*) AS c FROM nation GROUP BY n_regionkey % 2',
        None,
    ),
    # A6
    "group_by_null_key": (
        "SELECT NULLIF(o_orderstatus, 'F') AS st, COUNT(*) AS c FROM orders GROUP BY NULLIF(o_orderstatus, 'F')",
        None,
    ),
    # A6
    "agg_select_order": (
        'SELECT COUNT(*) AS c, o_orderstatus FROM orders GROUP BY o_orderstatus',
        None,
    ),
    # A8
    "agg_expr_arg": (
        'SELECT SUM(l_linenumber * 2) AS s FROM lineitem',
        'SELECT CAST(SUM(l_linenumber * 2) AS BIGINT) AS s FROM lineitem',
    ),
    # A9
    "agg_count_distinct": (
        'SELECT COUNT(DISTINCT l_suppkey) AS c FROM lineitem',
        None,
    ),
    # A10
    "having": (
        'SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15',
        None,
    ),
    # A11
    "agg_where_order_limit": (
        "SELECT o_custkey, COUNT(*) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10",
        None,
    ),
    # C4
    "selectivity_eq": (
        'SELECT 1.0D / COUNT(DISTINCT o_orderstatus) AS sel FROM orders',
        'SELECT CAST(1.0 AS DOUBLE) / COUNT(DISTINCT o_orderstatus) AS sel FROM orders',
    ),
    # J1
    "wc_inner_join": (
        'SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey',
        None,
    ),
    # J2
    "wc_broadcast_join": (
        'SELECT /*+ BROADCAST(r) */ n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey',
        'SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey',
    ),
    # W2
    "wc_cte": (
        'WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, COUNT(*) AS c FROM big GROUP BY o_orderstatus',
        None,
    ),
    # W1
    "wc_row_number": (
        'SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders',
        'SELECT o_orderkey, o_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders',
    ),
    # J3
    "join_left_outer": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
        None,
    ),
    # J3
    "join_full_outer": (
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey",
        None,
    ),
    # J3
    "join_anti": (
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
        None,
    ),
    # J3
    "join_theta": (
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        None,
    ),
    # J3
    "join_range": (
        "SELECT s.band, COUNT(*) AS c FROM (VALUES (1, 0, 50000), (2, 50000, 150000), (3, 150000, 1000000)) AS s(band, low, high) JOIN orders o ON o.o_totalprice >= s.low AND o.o_totalprice < s.high GROUP BY s.band",
        None,
    ),
    # J3
    "join_lateral": (
        "SELECT r.r_name, l.first_name FROM region r JOIN LATERAL (SELECT MIN(n.n_name) AS first_name FROM nation n WHERE n.n_regionkey = r.r_regionkey) l ON TRUE",
        None,
    ),
    # P12
    "select_without_from": (
        "SELECT 1 AS welcome, 'x' AS s",
        None,
    ),
    # F10
    "filter_bare_boolean": (
        "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders) o WHERE done",
        None,
    ),
    # A14
    "group_by_rollup": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        None,
    ),
    # A14
    "group_by_cube": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        None,
    ),
    # A14
    "grouping_sets": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS c FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        None,
    ),
    # W3
    "subquery_scalar": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(o_totalprice) * 0.9 FROM orders)",
        None,
    ),
    # W3
    "subquery_in": (
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'C')",
        None,
    ),
    # W4
    "window_ranks": (
        "SELECT n_nationkey, RANK() OVER (ORDER BY n_regionkey) AS r, DENSE_RANK() OVER (ORDER BY n_regionkey) AS d, NTILE(4) OVER (ORDER BY n_nationkey) AS q FROM nation",
        "SELECT n_nationkey, CAST(RANK() OVER (ORDER BY n_regionkey) AS INTEGER) AS r, CAST(DENSE_RANK() OVER (ORDER BY n_regionkey) AS INTEGER) AS d, CAST(NTILE(4) OVER (ORDER BY n_nationkey) AS INTEGER) AS q FROM nation",
    ),
    # W4
    "window_lag_lead": (
        "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
        None,
    ),
    # W4
    "window_frame": (
        "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM orders",
        "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders",
    ),
    # 2.9
    "set_union_all": (
        "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
        None,
    ),
    # 2.9
    "set_union": (
        "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region",
        None,
    ),
    # 2.9
    "set_intersect": (
        "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
        None,
    ),
    # 2.9
    "set_except": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
        None,
    ),
    # 2.9
    "set_except_all": (
        "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
        None,
    ),
    # M15
    "select_top": (
        "SELECT TOP 7 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7",
    ),
    # M15
    "select_top_nested": (
        "SELECT COUNT(*) AS c, MAX(k) AS m FROM (SELECT DISTINCT TOP 3 n_regionkey AS k FROM nation ORDER BY k) t",
        "SELECT COUNT(*) AS c, MAX(k) AS m FROM (SELECT DISTINCT n_regionkey AS k FROM nation ORDER BY k LIMIT 3) t",
    ),
    # M15
    "select_distribute_by": (
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' DISTRIBUTE BY (o_custkey)",
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
    ),
    # J3
    "wc_semi_join": (
        'SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)',
        None,
    ),
}
