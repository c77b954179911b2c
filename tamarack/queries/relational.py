"""Access-SQL queries over the relational test tables, each with its ANSI counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.engine import Engine
from tamarack.paging import PageError, PageRequest, Pager, query_page
from tamarack.plans.legacy import legacy_query
from tamarack.plans.lexer import AccessSqlError
from tamarack.sources.jet.saved import QueryRow, query_sql

#: Saved queries that the view queries use.
VIEWS = {
    "big_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM [orders] WHERE o_totalprice > 300000",
    "asian_nations": 'SELECT n.n_nationkey, n.n_name FROM [nation] AS n INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = "ASIA"',
    "asian_customers": "SELECT c.c_custkey, c.c_name, a.n_name FROM [customer] AS c INNER JOIN [asian_nations] AS a ON c.c_nationkey = a.n_nationkey",
    "lines_from": "PARAMETERS [minq] Long; SELECT l_orderkey, l_linenumber, l_quantity FROM [lineitem] WHERE l_quantity >= [minq]",
}

#: name -> (Access SQL, parameters, SQL for DuckDB)
STATEMENTS: dict[str, tuple[str, dict, str]] = {
    "scan_project": ("SELECT [c_custkey], [c_name] FROM [customer]", {}, "SELECT c_custkey, c_name FROM customer"),
    "select_star": ("SELECT * FROM [region]", {}, "SELECT * FROM region"),
    "qualified_star": ("SELECT n.* FROM [nation] AS n INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey", {}, "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "filter_cmp": ('SELECT l_orderkey, l_linenumber, l_quantity FROM [lineitem] WHERE l_quantity >= 45 AND NOT l_returnflag = "A"', {}, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND NOT lower(l_returnflag) = 'a'"),
    "filter_or": ('SELECT o_orderkey FROM [orders] WHERE o_totalprice < 1000 OR o_orderstatus <> "F" AND o_totalprice > 400000', {}, "SELECT o_orderkey FROM orders WHERE o_totalprice < 1000 OR lower(o_orderstatus) <> 'f' AND o_totalprice > 400000"),
    "filter_between": ("SELECT l_orderkey, l_linenumber FROM [lineitem] WHERE l_discount BETWEEN 0.02 AND 0.04", {}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02::DOUBLE AND 0.04::DOUBLE"),
    "filter_not_between": ("SELECT l_orderkey, l_linenumber FROM [lineitem] WHERE l_quantity NOT BETWEEN 3 AND 48", {}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48"),
    "filter_in_list": ('SELECT o_orderkey, o_orderpriority FROM [orders] WHERE o_orderpriority IN ("1-URGENT","2-HIGH")', {}, "SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent','2-high')"),
    "filter_not_in_list": ("SELECT n_nationkey, n_name FROM [nation] WHERE n_regionkey NOT IN (1, 3)", {}, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)"),
    "filter_is_null": ("SELECT c.c_custkey FROM [customer] AS c LEFT JOIN [orders] AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", {}, "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL"),
    "filter_is_not_null": ("SELECT abi_hbl_id, hold_date FROM [t_abi_hbl] WHERE hold_date IS NOT NULL", {}, "SELECT abi_hbl_id, hold_date FROM t_abi_hbl WHERE hold_date IS NOT NULL"),
    "filter_truth": ("SELECT n_nationkey FROM [nation] WHERE n_regionkey", {}, "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "like_star": ('SELECT p_partkey, p_name FROM [part] WHERE p_name LIKE "s*"', {}, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?is)^s.*$')"),
    "like_question": ('SELECT p_partkey, p_brand FROM [part] WHERE p_brand LIKE "Brand#1?"', {}, "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?is)^brand#1.$')"),
    "like_class": ('SELECT p_partkey, p_name FROM [part] WHERE p_name LIKE "[a-m]*"', {}, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?is)^[a-m].*$')"),
    "like_negclass": ('SELECT p_partkey, p_name FROM [part] WHERE p_name LIKE "[!a-m]*"', {}, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?is)^[^a-m].*$')"),
    "not_like": ('SELECT s_suppkey FROM [supplier] WHERE s_name NOT LIKE "*1"', {}, "SELECT s_suppkey FROM supplier WHERE NOT regexp_matches(s_name, '(?is)^.*1$')"),
    "like_infix": ('SELECT abi_hbl_id, house_no FROM [t_abi_hbl] WHERE house_no LIKE "*a1*"', {}, "SELECT abi_hbl_id, house_no FROM t_abi_hbl WHERE lower(house_no) LIKE '%a1%'"),
    "like_column": ("SELECT n.n_name FROM [nation] AS n, [region] AS r WHERE n.n_regionkey = r.r_regionkey AND n.n_name LIKE Left(r.r_name, 1) & \"*\"", {}, "SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND starts_with(lower(n.n_name), lower(left(r.r_name, 1)))"),
    "case_insensitive_eq": ('SELECT c_custkey FROM [customer] WHERE c_mktsegment = "building"', {}, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "date_literal": ("SELECT o_orderkey, o_orderdate FROM [orders] WHERE o_orderdate >= #1/1/1998#", {}, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"),
    "arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM [lineitem]", {}, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "arith_int": ("SELECT n_nationkey, n_nationkey*2+n_regionkey-1 AS v, -n_regionkey AS neg FROM [nation]", {}, "SELECT n_nationkey, CAST(n_nationkey*2+n_regionkey-1 AS BIGINT) AS v, CAST(-n_regionkey AS BIGINT) AS neg FROM nation"),
    "div_float": ("SELECT p_partkey, p_size / 4 AS quarter FROM [part]", {}, "SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS quarter FROM part"),
    "concat": ('SELECT c_custkey, c_name & "-" & c_mktsegment AS tag FROM [customer]', {}, "SELECT c_custkey, c_name || '-' || c_mktsegment AS tag FROM customer"),
    "three_valued": ('SELECT c.c_custkey, IIf(o.o_totalprice > 0 AND FALSE, "t", IIf(NOT (o.o_totalprice > 0), "n", "u")) AS mark FROM [customer] AS c LEFT JOIN [orders] AS o ON c.c_custkey = o.o_custkey ', {}, "SELECT c.c_custkey, CASE WHEN o.o_totalprice > 0 AND FALSE THEN 't' WHEN NOT (o.o_totalprice > 0) THEN 'n' ELSE 'u' END AS mark FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey "),
    "null_in": ("SELECT abi_hbl_id, IIf(manifest_quantity IN (1, NULL), 1, IIf(NOT manifest_quantity IN (1, NULL), 2, 3)) AS v FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, CAST(CASE WHEN manifest_quantity IN (1, NULL) THEN 1 WHEN NOT manifest_quantity IN (1, NULL) THEN 2 ELSE 3 END AS BIGINT) AS v FROM t_abi_hbl"),
    "fn_iif": ('SELECT l_orderkey, l_linenumber, IIf(l_quantity > 25, "big", "small") AS size_class FROM [lineitem]', {}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class FROM lineitem"),
    "fn_nz": ("SELECT abi_hbl_id, Nz(manifest_quantity, 0) AS q, Nz(house_no) AS h FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, CAST(coalesce(manifest_quantity, 0) AS BIGINT) AS q, coalesce(house_no, '') AS h FROM t_abi_hbl"),
    "fn_len": ("SELECT abi_hbl_id, Len(house_no) AS n FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, CAST(length(house_no) AS INTEGER) AS n FROM t_abi_hbl"),
    "fn_case": ("SELECT abi_hbl_id, LCase(house_no) AS lo, UCase(house_no) AS up FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, lower(house_no) AS lo, upper(house_no) AS up FROM t_abi_hbl"),
    "fn_trim": ("SELECT abi_hbl_id, Trim(house_no) AS t FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, trim(house_no) AS t FROM t_abi_hbl"),
    "fn_ltrim_rtrim": ("SELECT abi_hbl_id, LTrim(house_no) AS l, RTrim(house_no) AS r FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, ltrim(house_no) AS l, rtrim(house_no) AS r FROM t_abi_hbl"),
    "fn_left_right": ("SELECT abi_hbl_id, Left(house_no, 3) AS l, Right(house_no, 2) AS r FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, coalesce(left(house_no, 3), '') AS l, coalesce(right(house_no, 2), '') AS r FROM t_abi_hbl"),
    "fn_mid": ("SELECT abi_hbl_id, Mid(house_no, 2, 3) AS m, Mid(house_no, 4) AS rest FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, coalesce(substr(house_no, 2, 3), '') AS m, coalesce(substr(house_no, 4), '') AS rest FROM t_abi_hbl"),
    "fn_cstr": ("SELECT abi_hbl_id, CStr(manifest_quantity) AS q, CStr(accepted_date) AS d FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, CAST(manifest_quantity AS VARCHAR) AS q, strftime(accepted_date, '%Y-%m-%d %H:%M:%S') AS d FROM t_abi_hbl"),
    "fn_clng": ("SELECT l_orderkey, l_linenumber, CLng(l_quantity / 2) AS half, CInt(-l_quantity / 2) AS neg FROM [lineitem]", {}, "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / 2) AS BIGINT) AS half, CAST(round(-l_quantity / 2) AS BIGINT) AS neg FROM lineitem"),
    "fn_cdbl": ("SELECT n_nationkey, CDbl(n_nationkey) AS d, CSng(n_regionkey) AS s FROM [nation]", {}, "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS d, CAST(n_regionkey AS DOUBLE) AS s FROM nation"),
    "fn_datevalue": ("SELECT abi_hbl_id, DateValue(accepted_date) AS d FROM [t_abi_hbl]", {}, "SELECT abi_hbl_id, CAST(CAST(accepted_date AS DATE) AS TIMESTAMP) AS d FROM t_abi_hbl"),
    "fn_datevalue_text": ('SELECT n_nationkey, DateValue("3/5/1998 10:30") AS d FROM [nation]', {}, "SELECT n_nationkey, TIMESTAMP '1998-03-05' AS d FROM nation"),
    "fn_datepart_all": ('SELECT abi_hbl_id, DatePart("yyyy", accepted_date) AS y, DatePart("q", accepted_date) AS q, DatePart("m", accepted_date) AS m, DatePart("y", accepted_date) AS dy, DatePart("d", accepted_date) AS d, DatePart("w", accepted_date) AS w, DatePart("ww", accepted_date) AS ww, DatePart("h", accepted_date) AS h, DatePart("n", accepted_date) AS n, DatePart("s", accepted_date) AS s FROM [t_abi_hbl]', {}, "SELECT abi_hbl_id, year(accepted_date) AS y, quarter(accepted_date) AS q, month(accepted_date) AS m, dayofyear(accepted_date) AS dy, day(accepted_date) AS d, dayofweek(accepted_date) + 1 AS w, weekofyear(accepted_date) AS ww, hour(accepted_date) AS h, minute(accepted_date) AS n, second(accepted_date) AS s FROM t_abi_hbl"),
    "fn_format_date": ('SELECT abi_hbl_id, Format(accepted_date, "yyyy-mm-dd hh:nn:ss") AS f, Format(accepted_date, "dd mmm yy") AS g FROM [t_abi_hbl]', {}, "SELECT abi_hbl_id, strftime(accepted_date, '%Y-%m-%d %H:%M:%S') AS f, strftime(accepted_date, '%d %b %y') AS g FROM t_abi_hbl"),
    "fn_format_fixed": ('SELECT n_nationkey, Format(n_nationkey / 4, "Fixed") AS f, Format(n_regionkey, "General Number") AS g FROM [nation]', {}, "SELECT n_nationkey, printf('%.2f', n_nationkey / 4.0::DOUBLE) AS f, CAST(n_regionkey AS VARCHAR) AS g FROM nation"),
    "fn_abs": ("SELECT c_custkey, Abs(c_acctbal) AS a FROM [customer]", {}, "SELECT c_custkey, abs(c_acctbal) AS a FROM customer"),
    "fn_round": ("SELECT l_orderkey, l_linenumber, Round(l_extendedprice * l_discount, 1) AS r FROM [lineitem]", {}, "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount * 10, 0) / 10 AS r FROM lineitem"),
    "params": ("PARAMETERS [minq] Long; SELECT l_orderkey, l_linenumber FROM [lineitem] WHERE l_quantity >= [minq] AND l_returnflag = [flag]", {"minq": 48, "[Flag]": "r"}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 48 AND lower(l_returnflag) = 'r'"),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM [orders] AS o INNER JOIN [customer] AS c ON o.o_custkey = c.c_custkey", {}, "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM [customer] AS c LEFT JOIN [orders] AS o ON c.c_custkey = o.o_custkey", {}, "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM [orders] AS o RIGHT JOIN [customer] AS c ON o.o_custkey = c.c_custkey", {}, "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_cross": ("SELECT n.n_name, r.r_name FROM [nation] AS n CROSS JOIN [region] AS r", {}, "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r"),
    "join_comma_where": ("SELECT n.n_name, r.r_name FROM [nation] AS n, [region] AS r WHERE n.n_regionkey = r.r_regionkey", {}, "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey"),
    "join_nested_parens": ("SELECT c.c_name, n.n_name, r.r_name FROM ([customer] AS c INNER JOIN [nation] AS n ON c.c_nationkey = n.n_nationkey) INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey", {}, "SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "join_nested_right": ("SELECT c.c_custkey, n.n_name, r.r_name FROM [customer] AS c LEFT JOIN ([nation] AS n INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey", {}, "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey"),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS other FROM [nation] AS a INNER JOIN [nation] AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", {}, "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM [nation] AS a INNER JOIN [nation] AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey", {}, "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey"),
    "join_composite": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM [lineitem] AS a INNER JOIN [lineitem] AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40", {}, "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40"),
    "join_text_key": ("SELECT a.n_nationkey, b.n_regionkey FROM [nation] AS a INNER JOIN [nation] AS b ON a.n_name = b.n_name", {}, "SELECT a.n_nationkey, b.n_regionkey FROM nation a JOIN nation b ON a.n_name = b.n_name"),
    "sub_in": ("SELECT c_custkey FROM [customer] WHERE c_custkey IN (SELECT o_custkey FROM [orders] WHERE o_totalprice > 400000)", {}, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "sub_not_in": ("SELECT c_custkey FROM [customer] WHERE c_custkey NOT IN (SELECT o_custkey FROM [orders])", {}, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "sub_exists": ("SELECT c.c_custkey FROM [customer] AS c WHERE EXISTS (SELECT * FROM [orders] AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", {}, "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "sub_not_exists": ("SELECT c.c_custkey FROM [customer] AS c WHERE NOT EXISTS (SELECT * FROM [orders] AS o WHERE o.o_custkey = c.c_custkey)", {}, "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "sub_scalar": ("SELECT p_partkey FROM [part] WHERE p_retailprice = (SELECT Max(p_retailprice) FROM [part])", {}, "SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)"),
    "sub_scalar_correlated": ("SELECT c.c_custkey, (SELECT Count(*) FROM [orders] AS o WHERE o.o_custkey = c.c_custkey) AS n FROM [customer] AS c", {}, "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c"),
    "agg_group": ("SELECT l_returnflag, Count(*) AS n, Min(l_quantity) AS lo, Max(l_quantity) AS hi FROM [lineitem] GROUP BY l_returnflag", {}, "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag"),
    "agg_global": ("SELECT Count(*) AS n, Sum(p_size) AS s, Avg(p_size) AS a FROM [part]", {}, "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a FROM part"),
    "agg_empty": ("SELECT Count(*) AS n, Sum(p_size) AS s FROM [part] WHERE p_size > 100000", {}, "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part WHERE p_size > 100000"),
    "agg_having": ("SELECT o_custkey, Count(*) AS n FROM [orders] GROUP BY o_custkey HAVING Count(*) > 15", {}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_count_col": ("SELECT Count(*) AS all_rows, Count(manifest_quantity) AS known, Count(hold_date) AS held FROM [t_abi_hbl]", {}, "SELECT count(*) AS all_rows, count(manifest_quantity) AS known, count(hold_date) AS held FROM t_abi_hbl"),
    "agg_min_max_text": ("SELECT n_regionkey, Min(n_name) AS lo, Max(n_name) AS hi FROM [nation] GROUP BY n_regionkey", {}, "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey"),
    "agg_expr_over_agg": ('SELECT o_orderstatus, Round(Sum(o_totalprice) / Count(*), 2) AS mean, IIf(Count(*) > 1000, "many", "few") AS how FROM [orders] GROUP BY o_orderstatus', {}, "SELECT o_orderstatus, round_even(sum(o_totalprice) / count(*) * 100, 0) / 100 AS mean, CASE WHEN count(*) > 1000 THEN 'many' ELSE 'few' END AS how FROM orders GROUP BY o_orderstatus"),
    "agg_group_by_expr": ('SELECT DatePart("yyyy", o_orderdate) AS y, Count(*) AS n FROM [orders] GROUP BY DatePart("yyyy", o_orderdate)', {}, "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_firstrow": ("SELECT n_nationkey, n_name, Count(*) AS n FROM [nation] AS a INNER JOIN [customer] AS c ON a.n_nationkey = c.c_nationkey GROUP BY n_nationkey", {}, "SELECT n_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM nation a JOIN customer c ON a.n_nationkey = c.c_nationkey GROUP BY n_nationkey"),
    "agg_null_group": ("SELECT abi_master_id, Count(*) AS n FROM [t_abi_hbl] GROUP BY abi_master_id", {}, "SELECT abi_master_id, count(*) AS n FROM t_abi_hbl GROUP BY abi_master_id"),
    "agg_top_one": ("SELECT TOP 1 Count(*) AS n FROM [orders]", {}, "SELECT count(*) AS n FROM orders"),
    "distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM [customer]", {}, "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "distinctrow": ("SELECT DISTINCTROW l_returnflag, l_linestatus FROM [lineitem]", {}, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "top_n": ("SELECT TOP 10 o_orderkey, o_totalprice FROM [orders] ORDER BY o_totalprice DESC, o_orderkey", {}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "top_percent": ("SELECT TOP 1 PERCENT o_orderkey FROM [orders] ORDER BY o_orderkey", {}, "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil(count(*) OVER () / 100.0)"),
    "limit_offset": ("SELECT c_custkey FROM [customer] ORDER BY c_custkey LIMIT 20 OFFSET 30", {}, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30"),
    "order_alias": ("SELECT TOP 25 p_partkey, p_retailprice * 2 AS twice FROM [part] ORDER BY twice DESC, p_partkey", {}, "SELECT p_partkey, p_retailprice * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 25"),
    "order_ordinal": ("SELECT TOP 25 p_size, p_partkey FROM [part] ORDER BY 1 DESC, 2", {}, "SELECT p_size, p_partkey FROM part ORDER BY 1 DESC, 2 LIMIT 25"),
    "order_hidden_col": ("SELECT TOP 25 c_name FROM [customer] ORDER BY c_acctbal DESC, c_custkey", {}, "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25"),
    "order_nulls": ("SELECT TOP 40 abi_hbl_id, hold_date FROM [t_abi_hbl] GROUP BY abi_hbl_id, hold_date ORDER BY hold_date DESC, abi_hbl_id", {}, "SELECT abi_hbl_id, hold_date FROM t_abi_hbl GROUP BY ALL ORDER BY hold_date DESC NULLS LAST, abi_hbl_id LIMIT 40"),
    "order_agg": ("SELECT TOP 10 o_custkey, Count(*) AS n FROM [orders] GROUP BY o_custkey ORDER BY Count(*) DESC, o_custkey", {}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10"),
    "order_distinct": ("SELECT DISTINCT TOP 3 c_mktsegment FROM [customer] ORDER BY c_mktsegment DESC", {}, "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment DESC LIMIT 3"),
    "union": ("SELECT n_regionkey AS k FROM [nation] UNION SELECT r_regionkey FROM [region]", {}, "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "union_all": ("SELECT c_nationkey AS k FROM [customer] UNION ALL SELECT s_nationkey FROM [supplier]", {}, "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_ordered": ("SELECT n_name AS nm FROM [nation] UNION SELECT r_name FROM [region] ORDER BY nm DESC LIMIT 7", {}, "SELECT n_name AS nm FROM nation UNION SELECT r_name FROM region ORDER BY nm DESC LIMIT 7"),
    "union_three": ("SELECT n_nationkey AS k FROM [nation] UNION ALL SELECT r_regionkey FROM [region] UNION SELECT 3 FROM [region]", {}, "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL (SELECT r_regionkey FROM region UNION SELECT 3)"),
    "union_mixed_kinds": ("SELECT n_nationkey AS v FROM [nation] UNION ALL SELECT r_name FROM [region]", {}, "SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT r_name FROM region"),
    "view_basic": ("SELECT Count(*) AS n FROM [big_orders]", {}, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000"),
    "view_nested": ("SELECT a.n_name, Count(*) AS n FROM [asian_customers] AS a GROUP BY a.n_name", {}, "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name"),
    "view_params": ("SELECT l_orderkey, l_linenumber FROM [lines_from]", {"minq": 49}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49"),
    "view_in_join": ("SELECT c.c_name, b.o_totalprice FROM [customer] AS c INNER JOIN [big_orders] AS b ON c.c_custkey = b.o_custkey", {}, "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000"),
    "hbl_self_join": ('SELECT a.abi_hbl_id, UCase(a.house_no) AS house, Count(b.abi_hbl_id) AS n FROM [t_abi_hbl] AS a INNER JOIN [t_abi_hbl] AS b ON a.abi_master_id = b.abi_master_id WHERE a.manifest_quantity BETWEEN 1 AND 20 AND a.hold_date IS NOT NULL GROUP BY a.abi_hbl_id, UCase(a.house_no)', {}, "SELECT a.abi_hbl_id, upper(a.house_no) AS house, count(b.abi_hbl_id) AS n FROM t_abi_hbl a JOIN t_abi_hbl b ON a.abi_master_id = b.abi_master_id WHERE a.manifest_quantity BETWEEN 1 AND 20 AND a.hold_date IS NOT NULL GROUP BY 1, 2"),
    "events_daily": ('SELECT Format(ts, "yyyy-mm-dd") AS day_text, event_type, Count(*) AS n, Count(value) AS valued FROM [events] GROUP BY Format(ts, "yyyy-mm-dd"), event_type', {}, "SELECT strftime(ts, '%Y-%m-%d') AS day_text, event_type, count(*) AS n, count(value) AS valued FROM events GROUP BY 1, 2"),
    "tpch_q1_like": ("SELECT l_returnflag, l_linestatus, Round(Sum(l_quantity), 2) AS sum_qty, Round(Sum(l_extendedprice), 2) AS sum_base, Round(Sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, Round(Avg(l_discount), 4) AS avg_disc, Count(*) AS n FROM [lineitem] WHERE l_shipdate <= #9/2/1998# GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", {}, "SELECT l_returnflag, l_linestatus, round_even(sum(l_quantity) * 100, 0) / 100 AS sum_qty, round_even(sum(l_extendedprice) * 100, 0) / 100 AS sum_base, round_even(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS sum_disc, round_even(avg(l_discount) * 10000, 0) / 10000 AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q3_like": ('SELECT TOP 10 o.o_orderkey, Round(Sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM ([customer] AS c INNER JOIN [orders] AS o ON c.c_custkey = o.o_custkey) INNER JOIN [lineitem] AS l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = "BUILDING" AND o.o_orderdate < #3/15/1995# AND l.l_shipdate > #3/15/1995# GROUP BY o.o_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderkey', {}, "SELECT o_orderkey, round_even(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(c_mktsegment) = 'building' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 3 ORDER BY revenue DESC, o_orderkey LIMIT 10"),
    "tpch_q5_like": ('SELECT n.n_name, Round(Sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM (((([customer] AS c INNER JOIN [orders] AS o ON c.c_custkey = o.o_custkey) INNER JOIN [lineitem] AS l ON l.l_orderkey = o.o_orderkey) INNER JOIN [supplier] AS s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey) INNER JOIN [nation] AS n ON s.s_nationkey = n.n_nationkey) INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = "ASIA" GROUP BY n.n_name', {}, "SELECT n_name, round_even(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia' GROUP BY n_name"),
    "tpch_q6_like": ("SELECT Round(Sum(l_extendedprice * l_discount), 2) AS revenue FROM [lineitem] WHERE l_shipdate >= #1/1/1996# AND l_shipdate < #1/1/1997# AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", {}, "SELECT round_even(sum(l_extendedprice * l_discount) * 100, 0) / 100 AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24"),
    "tpch_q10_like": ('SELECT TOP 20 c.c_custkey, c.c_name, Round(Sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM ([customer] AS c INNER JOIN [orders] AS o ON c.c_custkey = o.o_custkey) INNER JOIN [lineitem] AS l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = "R" GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c.c_custkey', {}, "SELECT c_custkey, c_name, round_even(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(l_returnflag) = 'r' GROUP BY 1, 2 ORDER BY revenue DESC, c_custkey LIMIT 20"),
    "tpch_q12_like": ('SELECT l.l_linestatus, Sum(IIf(o.o_orderpriority IN ("1-URGENT", "2-HIGH"), 1, 0)) AS high_n, Sum(IIf(o.o_orderpriority IN ("1-URGENT", "2-HIGH"), 0, 1)) AS low_n FROM [orders] AS o INNER JOIN [lineitem] AS l ON o.o_orderkey = l.l_orderkey GROUP BY l.l_linestatus', {}, "SELECT l_linestatus, CAST(sum(CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high') THEN 1 ELSE 0 END) AS BIGINT) AS high_n, CAST(sum(CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high') THEN 0 ELSE 1 END) AS BIGINT) AS low_n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "tpch_q14_like": ('SELECT Round(100 * Sum(IIf(p.p_type LIKE "PROMO*", l.l_extendedprice * (1 - l.l_discount), 0)) / Sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS promo FROM [lineitem] AS l INNER JOIN [part] AS p ON l.l_partkey = p.p_partkey', {}, "SELECT round_even(100 * sum(CASE WHEN lower(p_type) LIKE 'promo%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)) * 10000, 0) / 10000 AS promo FROM lineitem JOIN part ON l_partkey = p_partkey"),
}


def engine(spark: SparkSession, folder: str) -> Engine:
    """An engine over the tables of ``folder`` with the saved queries above."""
    return Engine(spark, folder, views=VIEWS)


def _statement(sql: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d).query(sql, params)


ORDERED = "SELECT o_orderkey, o_totalprice FROM [orders] ORDER BY o_totalprice DESC, o_orderkey"


def page_first(spark: SparkSession, d: str) -> DataFrame:
    return query_page(engine(spark, d), ORDERED, request=PageRequest(size=50)).frame


def page_next(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    first = query_page(e, ORDERED, request=PageRequest(size=50))
    return query_page(e, ORDERED, request=PageRequest(size=50, after=first.next_cursor)).frame


def page_previous(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    first = query_page(e, ORDERED, request=PageRequest(size=50))
    second = query_page(e, ORDERED, request=PageRequest(size=50, after=first.next_cursor))
    return query_page(e, ORDERED, request=PageRequest(size=20, before=second.prev_cursor)).frame


def pager_page(spark: SparkSession, d: str) -> DataFrame:
    return Pager(engine(spark, d), ORDERED, size=100).page(3)


def read_table_text(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).read_table("nation")


def list_tables(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).describe("LIST TABLES")


def describe_table(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).describe("DESCRIBE TABLE [nation]").select("column_name")


def row_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(engine(spark, d).row_count("lineitem"),)], "n long")


#: name -> rows that describe a saved query, parameters, SQL for DuckDB
SAVED: dict[str, tuple[list[QueryRow], dict, str]] = {
    "saved_parameters": ([QueryRow(2, 4, "lowest"), QueryRow(3, 1), QueryRow(5, 0, "nation"), QueryRow(8, 0, None, None, "n_regionkey >= [lowest]")], {"lowest": 3}, "SELECT * FROM nation WHERE n_regionkey >= 3"),
    "saved_distinct": ([QueryRow(3, 2), QueryRow(5, 0, "customer"), QueryRow(6, 0, "segment", None, "c_mktsegment")], {}, "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "saved_top": ([QueryRow(3, 16, "5"), QueryRow(5, 0, "nation"), QueryRow(6, 0, None, None, "n_name"), QueryRow(11, 0, "D", None, "n_name")], {}, "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 5"),
    "saved_joins": ([QueryRow(3, 0), QueryRow(5, 0, "nation", "n"), QueryRow(5, 0, "region", "r"), QueryRow(5, 0, "supplier", "s"), QueryRow(6, 0, "place", None, "n.n_name"), QueryRow(6, 0, None, None, "r.r_name"), QueryRow(6, 0, None, None, "s.s_suppkey"), QueryRow(7, 1, "n", "r", "n.n_regionkey = r.r_regionkey"), QueryRow(7, 2, "n", "s", "n.n_nationkey = s.s_nationkey")], {}, "SELECT n.n_name AS place, r.r_name, s.s_suppkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey"),
    "saved_groups": ([QueryRow(3, 0), QueryRow(5, 0, "orders"), QueryRow(6, 0, None, None, "o_orderpriority"), QueryRow(6, 0, "n", None, "Count(*)"), QueryRow(8, 0, None, None, "o_totalprice > 1000"), QueryRow(9, 0, None, None, "o_orderpriority"), QueryRow(10, 0, None, None, "Count(*) > 10"), QueryRow(11, 0, None, None, "o_orderpriority")], {}, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10"),
}

#: name -> statement of the small dialect, SQL for DuckDB
LEGACY: dict[str, tuple[str, str]] = {
    "legacy_columns": ("SELECT n_nationkey, N_NAME FROM nation", "SELECT n_nationkey, n_name FROM nation"),
    "legacy_star": ("SELECT * FROM region LIMIT 5", "SELECT * FROM region"),
    "legacy_count": ("SELECT COUNT(*) FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'A'", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'A'"),
    "legacy_where": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR NOT o_totalprice > 1000) AND o_orderdate < strptime('1997-01-01', '%Y-%m-%d')", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR NOT o_totalprice > 1000) AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "legacy_null": ("SELECT abi_hbl_id FROM t_abi_hbl WHERE hold_date IS NOT NULL OR house_no IS NULL", "SELECT abi_hbl_id FROM t_abi_hbl WHERE hold_date IS NOT NULL OR house_no IS NULL"),
    "legacy_like": ("SELECT p_partkey FROM part WHERE p_name LIKE 's%' OR p_brand LIKE 'Brand#_1'", "SELECT p_partkey FROM part WHERE p_name LIKE 's%' OR p_brand LIKE 'Brand#_1'"),
    "legacy_ilike": ("SELECT p_partkey FROM part WHERE p_name ILIKE 'S%'", "SELECT p_partkey FROM part WHERE p_name ILIKE 'S%'"),
    "legacy_top": ("SELECT TOP 100 PERCENT n_nationkey FROM nation WHERE n_regionkey >= 2", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 2"),
}


def fn_date_now(spark: SparkSession, d: str) -> DataFrame:
    # the clock itself has no counterpart; what must hold of it has
    return engine(spark, d).query('SELECT n_nationkey, IIf(Date() <= Now(), 1, 0) AS begun, IIf(DateValue(Now()) = Date(), 1, 0) AS today, IIf(Format(Date(), "hh:nn:ss") = "00:00:00", 1, 0) AS midnight FROM [nation]')


#: Statements that can't be run.
REJECTED = [
    "SELECT n_name FROM nation WHERE Count(*) > 1",
    "SELECT n_name FROM nation GROUP BY Count(*)",
    "SELECT Nothing(n_name) FROM nation",
    "SELECT n_name FROM nowhere",
    "SELECT no_column FROM nation",
    "SELECT n_name FROM nation WHERE n_name = 'open",
    "SELECT n_name FROM",
    "SELECT n_name FROM nation ORDER BY 7",
    "SELECT n_name FROM nation WHERE n_nationkey = #13/45/2020#",
    "DELETE FROM nation",
]


def rejected_statements(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)

    def refused(sql: str) -> int:
        try:
            e.compile(sql)
        except AccessSqlError:
            return 1
        return 0

    return spark.createDataFrame([(k, refused(sql)) for k, sql in enumerate(REJECTED)], "place int, refused int")


def refused_cursors(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    cursor = query_page(e, ORDERED, request=PageRequest(size=5)).next_cursor
    cases = [(ORDERED, {}, PageRequest(5, after=cursor, before=cursor)), (ORDERED, {}, PageRequest(1001)), (ORDERED, {}, PageRequest(5, after="!")), (f"{ORDERED} DESC", {}, PageRequest(5, after=cursor)), (ORDERED, {"p": 1}, PageRequest(5, after=cursor)), ("SELECT DISTINCT o_orderstatus FROM [orders]", {}, PageRequest(5))]

    def refused(sql: str, params: dict, request: PageRequest) -> int:
        try:
            query_page(e, sql, params, request)
        except PageError:
            return 1
        return 0

    return spark.createDataFrame([(k, refused(*case)) for k, case in enumerate(cases)], "place int, refused int")


def list_views(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in engine(spark, d).views()], "view_name string")


def typed_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(engine(spark, d).rows("SELECT r_regionkey, r_name FROM [region]", tag="typed")), "r_regionkey int, r_name string")


def _saved(rows: list[QueryRow], params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d).query(query_sql(rows), params)


def _legacy(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: legacy_query(engine(spark, d), sql)


_PLAIN = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
OTHERS: dict[str, tuple[Callable, str]] = {
    "page_first": (page_first, f"{_PLAIN} LIMIT 50"),
    "page_next": (page_next, f"{_PLAIN} LIMIT 50 OFFSET 50"),
    "page_previous": (page_previous, f"{_PLAIN} LIMIT 20 OFFSET 30"),
    "pager_page": (pager_page, f"{_PLAIN} LIMIT 100 OFFSET 200"),
    "read_table_text": (read_table_text, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"),
    "list_tables": (list_tables, "SELECT table_name FROM information_schema.tables"),
    "describe_table": (describe_table, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name"),
    "row_count": (row_count, "SELECT count(*) AS n FROM lineitem"),
    "fn_date_now": (fn_date_now, "SELECT n_nationkey, 1 AS begun, 1 AS today, 1 AS midnight FROM nation"),
    "rejected_statements": (rejected_statements, "SELECT CAST(unnest(range(10)) AS INTEGER) AS place, 1 AS refused"),
    "refused_cursors": (refused_cursors, "SELECT CAST(unnest(range(6)) AS INTEGER) AS place, 1 AS refused"),
    "list_views": (list_views, "SELECT unnest(['asian_customers', 'asian_nations', 'big_orders', 'lines_from']) AS view_name"),
    "typed_rows": (typed_rows, "SELECT r_regionkey, r_name FROM region"),
    **{n: (_saved(rows, p), o) for n, (rows, p, o) in SAVED.items()},
    **{n: (_legacy(sql), o) for n, (sql, o) in LEGACY.items()},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{n: _statement(sql, p) for n, (sql, p, _) in STATEMENTS.items()}, **{n: f for n, (f, _) in OTHERS.items()}}
ORACLES: dict[str, str] = {**{n: o for n, (_, _, o) in STATEMENTS.items()}, **{n: o for n, (_, o) in OTHERS.items()}}
