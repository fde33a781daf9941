"""Relational queries in SQL, one for each operator; where both engines read the same text it is written once.

A pair holds the Spark text and the text of the SQL oracle. Types are cast so that both give the same schema,
sums of doubles are rounded, and every ranking has a unique tie-breaker.
"""

from __future__ import annotations

SQL: dict[str, str | tuple[str, str]] = {
    # scans, projection, predicates
    "scan_values": "SELECT CAST(a AS INT) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS t(a, b)",
    "scan_alias_subquery": "SELECT s.k, s.name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) AS s WHERE s.k > 3",
    "scan_row_count": "SELECT count(*) AS n FROM lineitem",
    "scan_index_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900",
    "scan_bitmap_and_or": "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size < 5 OR p_size > 45) AND (p_brand LIKE '%1' OR p_retailprice < 950)",
    "filter_between_in_like": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 9 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'",
    "filter_three_valued": "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 AND CAST(NULL AS BOOLEAN)) OR o_orderstatus IS NULL",
    "filter_null_safe_equal": ("SELECT e.event_id FROM events e WHERE e.props <=> NULL OR e.event_type <=> 'click'", "SELECT e.event_id FROM events e WHERE e.props IS NOT DISTINCT FROM NULL OR e.event_type IS NOT DISTINCT FROM 'click'"),
    "filter_xor": ("SELECT p_partkey FROM part WHERE (p_size > 25) != (p_retailprice > 1200)", "SELECT p_partkey FROM part WHERE xor(CAST(p_size > 25 AS INT), CAST(p_retailprice > 1200 AS INT)) = 1"),
    "filter_ilike": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%'",
    "filter_regex_match": ("SELECT p_partkey, p_type FROM part WHERE p_type RLIKE '(?i)^s.*(ard|all)$' AND NOT p_type RLIKE 'STAN'", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^s.*(ard|all)$') AND NOT regexp_matches(p_type, 'STAN')"),
    "filter_similar_to": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment RLIKE '^(?:(BUILD|MACHIN).*)$'", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment SIMILAR TO '(BUILD|MACHIN).*'"),
    "filter_starts_with": ("SELECT s_suppkey FROM supplier WHERE startswith(s_name, 'Supplier#00000000')", "SELECT s_suppkey FROM supplier WHERE s_name ^@ 'Supplier#00000000'"),
    "project_case": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "project_arithmetic": ("SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS q, l_orderkey % 7 AS r, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_linenumber AS neg FROM lineitem"),
    "project_bitwise": ("SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, ~p_size AS n FROM part", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r, ~p_size AS n FROM part"),
    "project_math": ("SELECT p_partkey, round(power(p_size, 2), 4) AS pw, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, abs(p_size - 25) AS ab, CAST(factorial(p_size % 10) AS BIGINT) AS fa, CAST(floor(p_retailprice / 7) AS BIGINT) AS fl, CAST(ceil(p_retailprice / 7) AS BIGINT) AS ce, round(ln(p_retailprice), 6) AS ln, CAST(sign(p_size - 25) AS INT) AS sg FROM part", "SELECT p_partkey, round(power(p_size, 2), 4) AS pw, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, abs(p_size - 25) AS ab, CAST(factorial(p_size % 10) AS BIGINT) AS fa, CAST(floor(p_retailprice / 7) AS BIGINT) AS fl, CAST(ceil(p_retailprice / 7) AS BIGINT) AS ce, round(ln(p_retailprice), 6) AS ln, CAST(sign(p_size - 25) AS INT) AS sg FROM part"),
    "project_cast_try_cast": "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR(30)) IS NOT NULL AS has, TRY_CAST(o_orderpriority AS INT) AS bad, TRY_CAST(substring(o_orderpriority, 1, 1) AS INT) AS good FROM orders",
    "project_strings": ("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'o') AS r, trim(concat('  ', c_mktsegment, ' ')) AS t, lpad(CAST(c_custkey AS STRING), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_mktsegment) AS rv, CAST(position('0' IN c_name) AS BIGINT) AS ps, c_mktsegment || '-' || c_name AS cc, left(c_name, 4) AS lf, right(c_name, 4) AS rt, repeat('ab', 2) AS rep, split_part(c_name, '#', 2) AS sp, translate(c_mktsegment, 'AE', '43') AS tr, md5(c_name) AS md FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'o') AS r, trim(concat('  ', c_mktsegment, ' ')) AS t, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_mktsegment) AS rv, CAST(position('0' IN c_name) AS BIGINT) AS ps, c_mktsegment || '-' || c_name AS cc, left(c_name, 4) AS lf, right(c_name, 4) AS rt, repeat('ab', 2) AS rep, split_part(c_name, '#', 2) AS sp, translate(c_mktsegment, 'AE', '43') AS tr, md5(c_name) AS md FROM customer"),
    "project_null_functions": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'closed') AS st, greatest(o_totalprice, 100000.0) AS g, least(o_orderkey, 50) AS l, nullif(o_orderkey % 3, 0) AS nf FROM orders",
    "project_dates": ("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(o_orderdate AS DATE) AS dt, CAST(datediff(DATE'1999-01-01', CAST(o_orderdate AS DATE)) AS INT) AS age, last_day(CAST(o_orderdate AS DATE)) AS ld FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(o_orderdate AS DATE) AS dt, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS age, last_day(CAST(o_orderdate AS DATE)) AS ld FROM orders"),
    "project_intervals": ("SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 10 DAY AS b, o_orderdate + INTERVAL 36 HOUR AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 10 DAY AS b, o_orderdate + INTERVAL 36 HOUR AS c FROM orders"),
    "project_extract_epoch": ("SELECT event_id, CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) AS BIGINT) AS epoch FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events"),
    "project_json": ("SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.page') AS page FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events"),
    "project_row_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT 'A', 'F' FROM region)",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "join_natural": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "join_using": "SELECT k, a, b FROM (SELECT o_orderkey AS k, o_orderstatus AS a FROM orders) x JOIN (SELECT l_orderkey AS k, l_linenumber AS b FROM lineitem) y USING (k)",
    "join_theta": "SELECT n.n_nationkey AS n, r.r_regionkey AS r FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "join_null_keys": "SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k = b.k",
    "join_star": "SELECT n_name, p_brand, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_brand",
    "join_lateral_top1": "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
    # aggregation
    "agg_basic": "SELECT l_returnflag, count(*) AS n, count(l_tax) AS c, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS mi, max(l_discount) AS ma FROM lineitem GROUP BY l_returnflag",
    "agg_statistics": "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sds, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS co, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl FROM lineitem GROUP BY l_linestatus",
    "agg_string": ("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_array": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS ids FROM nation GROUP BY n_regionkey"),
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, round(sum(DISTINCT l_discount), 4) AS d FROM lineitem GROUP BY l_returnflag",
    "agg_bool": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS al, bool_or(o_orderstatus = 'P') AS an FROM orders GROUP BY o_custkey",
    "agg_percentile": ("SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS med, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY o_orderpriority"),
    "agg_mode": ("SELECT count(*) AS n FROM (SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS m FROM customer GROUP BY c_nationkey) x JOIN customer c ON c.c_nationkey = x.c_nationkey GROUP BY x.c_nationkey HAVING count(*) > 0", "SELECT count(*) AS n FROM (SELECT c_nationkey, mode(c_mktsegment) AS m FROM customer GROUP BY c_nationkey) x JOIN customer c ON c.c_nationkey = x.c_nationkey GROUP BY x.c_nationkey HAVING count(*) > 0"),
    "agg_filter": "SELECT l_shipdate > TIMESTAMP_NTZ '1995-01-01' AS late, count(*) FILTER (WHERE l_returnflag = 'R') AS r, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o FROM lineitem GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000",
    "agg_group_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "agg_rollup": ("SELECT n_regionkey, c_mktsegment, count(*) AS n, CAST(grouping_id(n_regionkey, c_mktsegment) AS BIGINT) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)", "SELECT n_regionkey, c_mktsegment, count(*) AS n, CAST(grouping_id(n_regionkey, c_mktsegment) AS BIGINT) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)"),
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg_over_agg": "SELECT o_orderpriority, CAST(extract(year FROM o_orderdate) AS INT) AS y, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY extract(year FROM o_orderdate)) AS BIGINT) AS run FROM orders GROUP BY o_orderpriority, extract(year FROM o_orderdate)",
    "agg_pivot_case": "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY o_orderpriority",
    "agg_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, count(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f, count(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag"),
    "agg_unpivot": ("SELECT k, which, value FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR which IN (discount, tax))", "SELECT k, which, value FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR which IN (discount, tax))"),
    "agg_approx_distinct": ("WITH a AS (SELECT l_returnflag AS f, approx_count_distinct(l_partkey, 0.02) AS about FROM lineitem GROUP BY l_returnflag), d AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, n, abs(about - n) <= 0.08 * n AS close FROM d JOIN a ON l_returnflag <=> f", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS close FROM lineitem GROUP BY l_returnflag"),
    "agg_hll_sketch": ("SELECT l_linestatus, max(n) AS n, abs(hll_sketch_estimate(hll_union_agg(s)) - max(n)) <= 0.05 * max(n) AS close FROM (SELECT l_linestatus, l_returnflag, hll_sketch_agg(l_partkey) AS s FROM lineitem GROUP BY ALL) JOIN (SELECT l_linestatus, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) USING (l_linestatus) GROUP BY l_linestatus", "SELECT l_linestatus, count(DISTINCT l_partkey) AS n, true AS close FROM lineitem GROUP BY l_linestatus"),
    "agg_approx_percentile": ("SELECT o_orderpriority, count(*) AS n, abs(avg(CASE WHEN o_totalprice <= m THEN 1.0E0 ELSE 0.0E0 END) - 0.5) <= 0.01 AND abs(avg(CASE WHEN o_totalprice <= h THEN 1.0E0 ELSE 0.0E0 END) - 0.9) <= 0.01 AS close FROM orders JOIN (SELECT o_orderpriority, approx_percentile(o_totalprice, 0.5, 10000) AS m, approx_percentile(o_totalprice, 0.9, 10000) AS h FROM orders GROUP BY o_orderpriority) USING (o_orderpriority) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n, true AS close FROM orders GROUP BY o_orderpriority"),
    "agg_last_point": ("SELECT user_id, max_by(event_id, struct(ts, event_id)) AS last_event FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id"),
    # windows
    "win_ranking": "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS p, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER w AS n, o_totalprice - lag(o_totalprice, 1, o_totalprice) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run FROM orders",
    "win_rows_frame": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma FROM orders",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part",
    "win_peers_default": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM part",
    "win_ignore_nulls": ("SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_f FROM orders", "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_f FROM orders"),
    "win_ratio_to_report": "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS ratio FROM supplier",
    "win_qualify_top_n": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    # sort and limit
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "sort_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30",
    "sort_nulls": "SELECT k FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 40",
    # sets
    "set_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region",
    "set_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_nested": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT k FROM b)",
    # subqueries, common table expressions, recursion
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sub_scalar_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sub_scalar_count": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sub_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders)",
    "sub_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "sub_not_exists": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 10)",
    "sub_tuple_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM lineitem GROUP BY l_orderkey)",
    "sub_derived_nested": "SELECT y, n FROM (SELECT y, count(*) AS n FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y FROM orders) a GROUP BY y) b WHERE n > 10",
    "cte_chain": ("WITH o AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, t FROM o ORDER BY t DESC, o_custkey LIMIT 10) SELECT o_custkey, round(t, 2) AS t FROM r", "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, t, rank() OVER (ORDER BY t DESC, o_custkey) AS k FROM o) SELECT o_custkey, round(t, 2) AS t FROM r WHERE k <= 10"),
    "cte_recursive_sequence": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t",
    "cte_recursive_hierarchy": ("WITH RECURSIVE h(id, lvl, path) AS (SELECT CAST(1 AS BIGINT), 1, CAST('1' AS STRING) UNION ALL SELECT c.c_custkey, h.lvl + 1, concat(h.path, '/', CAST(c.c_custkey AS STRING)) FROM customer c JOIN h ON c.c_custkey div 2 = h.id AND c.c_custkey > 1) SELECT id, lvl, path FROM h", "WITH RECURSIVE h(id, lvl, path) AS (SELECT CAST(1 AS BIGINT), 1, CAST('1' AS VARCHAR) UNION ALL SELECT c.c_custkey, h.lvl + 1, concat(h.path, '/', CAST(c.c_custkey AS VARCHAR)) FROM customer c JOIN h ON c.c_custkey // 2 = h.id AND c.c_custkey > 1) SELECT id, lvl, path FROM h"),
    # table functions
    "unnest_array": ("SELECT n_nationkey, e FROM nation LATERAL VIEW explode(split(n_name, 'A')) t AS e", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS e FROM nation"),
    "unnest_ordinality": ("SELECT n_nationkey, CAST(p + 1 AS BIGINT) AS ord, e FROM nation LATERAL VIEW posexplode(split(n_name, 'A')) t AS p, e", "SELECT n_nationkey, ord, e FROM nation, LATERAL (SELECT unnest(string_split(n_name, 'A')) AS e, generate_subscripts(string_split(n_name, 'A'), 1) AS ord)"),
    "unnest_multiple": ("SELECT k, a, b FROM (SELECT r_regionkey AS k, array(1, 2, 3) AS x, array('p', 'q') AS y FROM region) LATERAL VIEW inline(arrays_zip(x, y)) t AS a, b", "SELECT r_regionkey AS k, unnest([1, 2, 3]) AS a, unnest(['p', 'q']) AS b FROM region"),
    "unnest_outer": ("SELECT r_regionkey AS k, e FROM region LATERAL VIEW OUTER explode(CASE WHEN r_regionkey > 2 THEN array(r_regionkey, 9) END) t AS e", "SELECT r_regionkey AS k, e FROM region LEFT JOIN LATERAL (SELECT unnest(CASE WHEN r_regionkey > 2 THEN [r_regionkey, 9] END) AS e) t ON true"),
    "generate_series_step": ("SELECT CAST(n AS BIGINT) AS n FROM (SELECT explode(sequence(2, 40, 3)) AS n)", "SELECT generate_series AS n FROM generate_series(2, 40, 3)"),
    "json_table": ("SELECT a, b FROM (SELECT inline(from_json('[{\"a\":1,\"b\":\"foo\"},{\"a\":2,\"b\":\"bar\"}]', 'array<struct<a:int,b:string>>')))", "SELECT unnest(from_json('[{\"a\":1,\"b\":\"foo\"},{\"a\":2,\"b\":\"bar\"}]', '[{\"a\":\"INTEGER\",\"b\":\"VARCHAR\"}]'), recursive := true)"),
    "regexp_split_to_table": ("SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, '[ _-]+')) t AS w", "SELECT p_partkey, unnest(regexp_split_to_array(p_type, '[ _-]+')) AS w FROM part"),
    "array_functions": ("SELECT r_regionkey AS k, CAST(size(a) AS BIGINT) AS n, element_at(a, 2) AS second, array_join(slice(a, 2, 2), ',') AS sl, array_contains(a, 3) AS has, CAST(array_position(a, 3) AS INT) AS pos, array_join(array_distinct(concat(a, array(1, 1))), ',') AS ds, arrays_overlap(a, array(7, r_regionkey)) AS ov, array_max(a) AS mx FROM (SELECT r_regionkey, array(r_regionkey, 3, 1) AS a FROM region)", "SELECT r_regionkey AS k, len(a) AS n, a[2] AS second, array_to_string(a[2:3], ',') AS sl, list_contains(a, 3) AS has, CAST(coalesce(list_position(a, 3), 0) AS INT) AS pos, array_to_string(array_distinct_ordered, ',') AS ds, list_has_any(a, [7, r_regionkey]) AS ov, list_max(a) AS mx FROM (SELECT r_regionkey, [r_regionkey, 3, 1] AS a, list_filter(a || [1, 1], lambda x, i: list_position(a || [1, 1], x) = i) AS array_distinct_ordered FROM region)"),
    # decision-support queries over the star schema, on the columns that there are
    "tpch_q3": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1998-03-15' AND l_shipdate > TIMESTAMP_NTZ '1998-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1997-07-01' AND o_orderdate < TIMESTAMP_NTZ '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'X' AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24",
    "tpch_q7": "SELECT sn.n_name AS supp, cn.n_name AS cust, CAST(extract(year FROM l_shipdate) AS INT) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE (sn.n_name = 'NATION_1' AND cn.n_name = 'NATION_2') OR (sn.n_name = 'NATION_2' AND cn.n_name = 'NATION_1') GROUP BY sn.n_name, cn.n_name, extract(year FROM l_shipdate)",
    "tpch_q8": "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE n1.n_regionkey = 1 AND p_type = 'ECONOMY' GROUP BY extract(year FROM o_orderdate)",
    "tpch_q9": "SELECT n_name, CAST(extract(year FROM o_orderdate) AS INT) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%ring%' GROUP BY n_name, extract(year FROM o_orderdate)",
    "tpch_q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q12": "SELECT l_linestatus, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high, count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01' GROUP BY l_linestatus",
    "tpch_q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) x GROUP BY c_count",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP_NTZ '1996-09-01'",
    "tpch_q15": "WITH revenue AS (SELECT l_suppkey AS k, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = k WHERE total = (SELECT max(total) FROM revenue)",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#4' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice",
    "tpch_q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#17' AND l_quantity BETWEEN 10 AND 40 AND p_size BETWEEN 1 AND 30)",
    "tpch_q21": "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name",
    "tpch_q22": "SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment",
    # the same with a partsupp derived from the lines: a part of a supplier with all that was sold and its least price
    "tpch_q2": "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey), r AS (SELECT ps_partkey, ps_supplycost, s_suppkey, s_name, s_acctbal, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT s_acctbal, s_name, n_name, p_partkey FROM part JOIN r ON p_partkey = ps_partkey WHERE p_size <= 15 AND p_type IN ('PROMO', 'SMALL') AND ps_supplycost = (SELECT min(i.ps_supplycost) FROM r i WHERE i.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100",
    "tpch_q11": "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey), v AS (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS v FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY ps_partkey) SELECT ps_partkey, round(v, 2) AS value FROM v WHERE v > (SELECT sum(v) * 0.001 FROM v)",
    "tpch_q16": "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'PROMO%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 AND s_suppkey IS NOT NULL) GROUP BY p_brand, p_type, p_size",
    "tpch_q20": "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <= 2 AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'))",
    # analytical idioms
    "idiom_running_total": "SELECT d, round(sum(t) OVER (ORDER BY d), 2) AS run FROM (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS t FROM orders GROUP BY CAST(o_orderdate AS DATE)) x",
    "idiom_year_over_year": "WITH y AS (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, sum(o_totalprice) AS t FROM orders GROUP BY extract(year FROM o_orderdate)) SELECT a.y, round(100 * (a.t - b.t) / b.t, 4) AS growth FROM y a JOIN y b ON a.y = b.y + 1",
    "idiom_cohort": ("WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events GROUP BY user_id) SELECT first, CAST(datediff(CAST(ts AS DATE), first) AS INT) AS age, count(DISTINCT e.user_id) AS n FROM events e JOIN f ON e.user_id = f.user_id GROUP BY first, datediff(CAST(ts AS DATE), first)", "WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events GROUP BY user_id) SELECT first, CAST(CAST(ts AS DATE) - first AS INT) AS age, count(DISTINCT e.user_id) AS n FROM events e JOIN f ON e.user_id = f.user_id GROUP BY first, CAST(ts AS DATE) - first"),
    "idiom_moving_average": "SELECT m, round(avg(t) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma FROM (SELECT extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS mm, CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS INT) AS m, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) x",
    "idiom_funnel": "WITH u AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS v, min(CASE WHEN event_type = 'click' THEN ts END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p FROM events GROUP BY user_id) SELECT count(v) AS viewed, count(CASE WHEN c > v THEN 1 END) AS clicked, count(CASE WHEN p > c AND c > v THEN 1 END) AS bought FROM u",
    "idiom_sessionize": "SELECT user_id, s AS session, min(event_id) AS first_event, count(*) AS n FROM (SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, s",
    "idiom_cumulative_percent": "SELECT p_brand, round(100 * sum(t) OVER (ORDER BY t DESC, p_brand) / sum(t) OVER (), 4) AS cum FROM (SELECT p_brand, sum(p_retailprice) AS t FROM part GROUP BY p_brand) x",
    "idiom_churn": "WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n, count(CASE WHEN last < TIMESTAMP_NTZ '1998-06-01' OR last IS NULL THEN 1 END) AS churned FROM customer LEFT JOIN l ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "idiom_duplicates": "SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "idiom_delete_duplicates": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) x WHERE rn = 1",
    "idiom_first_last": "SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
}
