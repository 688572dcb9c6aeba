"""Queries of the relational core: aggregates, pivots, joins, set operations, windows, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.engine import guard
from tallyspark.engine.shared import table
from tallyspark.operators import relational as R
from tallyspark.plans.base import SALES, sales


def _rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def _by_year(spark, d):
    return sales(spark, d).withColumn("year", F.year("order_date").cast("string"))


def olap_group(spark: SparkSession, d: str) -> DataFrame:
    df = R.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], ["SUM", "AVG", "COUNT", "MIN", "MAX"], "l_shipdate <= date'1998-09-02'")
    return _rounded(df, "l_quantity_avg", "l_extendedprice_avg", "l_quantity_sum", "l_extendedprice_sum")


def _leveled(df: DataFrame) -> DataFrame:
    return _rounded(df, "sales_sum").select("region", "year", "sales_sum", "sales_count", "level")


def olap_rollup(spark, d):
    return _leveled(R.aggregate(_by_year(spark, d), ["region", "year"], ["sales"], ["SUM", "COUNT"], mode="rollup"))


def olap_cube(spark, d):
    return _leveled(R.aggregate(_by_year(spark, d), ["region", "year"], ["sales"], ["SUM", "COUNT"], mode="cube"))


def olap_grouping_sets(spark, d):
    return _leveled(R.aggregate(_by_year(spark, d), ["region", "year"], ["sales"], ["SUM", "COUNT"], mode="sets", sets=[["region"], ["year"], []]))


_OLAP = "SELECT region, year, round(sum(sales), 4) AS sales_sum, count(sales) AS sales_count, CAST(grouping(region, year) AS BIGINT) AS level FROM (SELECT *, CAST(year(order_date) AS VARCHAR) AS year FROM sales) GROUP BY "


def pivot_sum(spark, d):
    return _rounded(R.pivot(sales(spark, d), ["region"], "channel", "sales", "SUM"), *[f"{c}_sum" for c in _SEGMENTS])


def pivot_average(spark, d):
    return _rounded(R.pivot(sales(spark, d), ["region"], "channel", "sales", "AVG", list(_SEGMENTS)), *[f"{c}_avg" for c in _SEGMENTS])


def pivot_zero_filled(spark, d):
    df = R.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "AVG", ["F", "O"], zero_filled=True)
    return _rounded(df, "F_avg", "O_avg")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def filter_project(spark, d):
    df = table(spark, d, "lineitem").filter(guard.predicate(spark, "l_discount between 0.05 and 0.07 and l_quantity < 24"))
    return df.select("l_orderkey", (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("saved"))


def filter_exact_match(spark, d):
    return R.matching(table(spark, d, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_custkey")


def sql_sandbox(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ts_orders")
    return R.run_sql(spark, "WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM ts_orders GROUP BY 1) SELECT p, n FROM a WHERE n > 0", 100)


def filter_aggregates(spark, d):
    late, early = F.year("order_date") == 1998, F.year("order_date") == 1997
    df = sales(spark, d).groupBy("region").agg(F.sum(F.when(early, F.col("sales"))).alias("base"), F.sum(F.when(late, F.col("sales"))).alias("current"), F.count_if(late).alias("n"))
    return _rounded(df, "base", "current")


def formula_column(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("case when p_size > 25 then 'large' else 'small' end").alias("size_class"), F.round(F.expr("p_retailprice * 1.1"), 3).alias("with_tax"))
    return df


def join_inner(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


def join_full_null_safe(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.year("l_shipdate").alias("y"))
    a = li.filter("y = 1997").groupBy("flag").agg(F.count(F.lit(1)).alias("n97"))
    b = li.filter("y = 1998 and (flag <> 'A' or flag is null)").groupBy("flag").agg(F.count(F.lit(1)).alias("n98"))
    b = b.withColumnRenamed("flag", "flag2")
    return a.join(b, F.col("flag").eqNullSafe(F.col("flag2")), "full").select(F.coalesce("flag", "flag2").alias("flag"), F.coalesce("n97", F.lit(0)).alias("n97"), F.coalesce("n98", F.lit(0)).alias("n98"))


def join_semi(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity >= 50").select("l_orderkey")
    o = table(spark, d, "orders")
    return o.join(big, o.o_orderkey == big.l_orderkey, "left_semi").select("o_orderkey")


def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'2001-06-01 00:00:00'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def join_scenario_grid(spark, d):
    """A fixed grid of 3 x 2 cases per region; the grid is a literal array, so nothing is joined."""
    per = sales(spark, d).groupBy("region").agg(F.sum("sales").alias("s"))
    grid = F.array(*[F.struct(F.lit(a).alias("cap"), F.lit(b).alias("drop_share")) for a in (0.0, 0.05, 0.1) for b in (0.0, 0.1)])
    return _rounded(per.select("region", F.inline(grid), "s").withColumn("kept", F.col("s") * (1 - F.col("cap")) * (1 - F.col("drop_share"))).drop("s"), "kept")


def join_year_over_year(spark, d):
    m = sales(spark, d).groupBy(F.trunc("order_date", "month").alias("month")).agg(F.sum("sales").alias("s"))
    b = m.select(F.add_months("month", 12).alias("month"), F.col("s").alias("year_before"))
    return _rounded(m.join(b, "month", "left"), "s", "year_before")


def join_multipliers(spark, d):
    """The factors by which a line's amount differs from quantity times price, from a literal list."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") * 10).alias("q"), F.floor(F.col("l_quantity")).alias("e"))
    hits = F.filter(F.array(*[F.lit(x) for x in (0.1, 1.0, 10.0, 100.0)]), lambda m: F.abs(F.col("q") - F.col("e") * m) <= 0.01)
    return li.select(F.size(hits).cast("long").alias("hits"), F.element_at(hits, 1).alias("factor")).groupBy("hits", "factor").agg(F.count(F.lit(1)).alias("n"))


def set_union_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"))
    return a.unionByName(b).groupBy("k", "kind").agg(F.count(F.lit(1)).alias("n"))


def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct())


def set_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def window_rank(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double"), 2).alias("total"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = per.join(c, per.o_custkey == c.c_custkey).select("c_nationkey", "c_custkey", "total")
    return R.top_per_group(rows, ["c_nationkey"], [F.col("total").desc(), F.col("c_custkey")], 3)


def window_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    best = R.latest_per_key(o, ["o_custkey"], "o_orderdate")
    return best.select("o_custkey", F.to_date("o_orderdate").alias("last_day"), "o_orderkey")


def window_lag_lead(spark, d):
    m = sales(spark, d).groupBy("region", F.trunc("order_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("region").orderBy("month")
    return m.select("region", "month", "n", F.lag("n").over(w).cast("double").alias("before"), F.lead("n").over(w).cast("double").alias("after"))


def window_running_sum(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return R.running_total(m, ["o_orderstatus"], "day", "n", "so_far")


def window_duplicates(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    return li.filter("copies > 1")


def top_k(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


def topk_remainder(spark, d):
    per = sales(spark, d).groupBy("nation").agg(F.sum("sales").alias("s"))
    return _rounded(R.top_with_remainder(per, "nation", "s", 5), "s")


def other_aggregates(spark, d):
    df = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.median("o_totalprice").alias("median"), F.percentile("o_totalprice", F.lit(0.9)).alias("p90"), F.stddev_pop("o_totalprice").alias("sd"),
        F.bool_and(F.col("o_totalprice") > 1000).alias("all_over"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_over"), F.expr("listagg(distinct o_orderstatus, ',') within group (order by o_orderstatus)").alias("states"),
    )
    return _rounded(df, "median", "p90", "sd")


def ratio_of_sums(spark, d):
    df = sales(spark, d).groupBy("channel").agg((F.sum("profit") / F.nullif(F.sum("sales"), F.lit(0.0))).alias("margin"), F.count_distinct("customer_id").alias("customers"))
    return _rounded(df, "margin", places=8)


def _q(sql: str) -> str:
    return f"WITH {SALES}\n{sql}"


QUERIES = {f.__name__: f for f in (
    olap_group, olap_rollup, olap_cube, olap_grouping_sets, pivot_sum, pivot_average, pivot_zero_filled, filter_project, filter_exact_match, sql_sandbox, filter_aggregates, formula_column, join_inner, join_left,
    join_full_null_safe, join_semi, join_anti, join_scenario_grid, join_year_over_year, join_multipliers, set_union_all, set_intersect, set_except, set_distinct, window_rank, window_latest, window_lag_lead,
    window_running_sum, window_duplicates, top_k, topk_remainder, other_aggregates, ratio_of_sums,
)}

SQL = {
    "olap_group": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_avg, count(l_quantity) AS l_quantity_count, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
        round(sum(l_extendedprice), 4) AS l_extendedprice_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_avg, count(l_extendedprice) AS l_extendedprice_count, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""",
    "olap_rollup": _q(_OLAP + "ROLLUP (region, year)"),
    "olap_cube": _q(_OLAP + "CUBE (region, year)"),
    "olap_grouping_sets": _q(_OLAP + "GROUPING SETS ((region), (year), ())"),
    "pivot_sum": _q("SELECT region, " + ", ".join(f"round(coalesce(sum(sales) FILTER (channel = '{c}'), 0), 4) AS {c}_sum" for c in _SEGMENTS) + " FROM sales GROUP BY region"),
    "pivot_average": _q("SELECT region, " + ", ".join(f"round(avg(sales) FILTER (channel = '{c}'), 4) AS {c}_avg" for c in _SEGMENTS) + " FROM sales GROUP BY region"),
    "pivot_zero_filled": "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 4) AS F_avg, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 4) AS O_avg FROM lineitem GROUP BY ALL",
    "filter_project": "SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS saved FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "filter_exact_match": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "sql_sandbox": "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1",
    "filter_aggregates": _q("SELECT region, round(sum(sales) FILTER (year(order_date) = 1997), 4) AS base, round(sum(sales) FILTER (year(order_date) = 1998), 4) AS current, count(*) FILTER (year(order_date) = 1998) AS n FROM sales GROUP BY region"),
    "formula_column": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, round(p_retailprice * 1.1::DOUBLE, 3) AS with_tax FROM part",
    "join_inner": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "join_left": "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_full_null_safe": """WITH l AS (SELECT nullif(l_returnflag, 'N') AS flag, year(l_shipdate) AS y FROM lineitem), a AS (SELECT flag, count(*) AS n97 FROM l WHERE y = 1997 GROUP BY 1), b AS (SELECT flag, count(*) AS n98 FROM l WHERE y = 1998 AND (flag <> 'A' OR flag IS NULL) GROUP BY 1)
        SELECT coalesce(a.flag, b.flag) AS flag, coalesce(n97, 0) AS n97, coalesce(n98, 0) AS n98 FROM a FULL JOIN b ON a.flag IS NOT DISTINCT FROM b.flag""",
    "join_semi": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01')",
    "join_scenario_grid": _q("SELECT region, cap, drop_share, round(s * (1 - cap) * (1 - drop_share), 4) AS kept FROM (SELECT region, sum(sales) AS s FROM sales GROUP BY 1), (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) a(cap), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) b(drop_share)"),
    "join_year_over_year": _q(", m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(sales) AS s FROM sales GROUP BY 1) SELECT m.month, round(m.s, 4) AS s, round(b.s, 4) AS year_before FROM m LEFT JOIN m b ON m.month = b.month + INTERVAL 1 YEAR").replace(")\n,", "),\n"),
    "join_multipliers": """WITH h AS (SELECT list_filter([0.1::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE, 100.0::DOUBLE], lambda m: abs(floor(l_quantity * 10) - floor(l_quantity) * m) <= 0.01) AS hits FROM lineitem)
        SELECT CAST(len(hits) AS BIGINT) AS hits, hits[1] AS factor, count(*) AS n FROM h GROUP BY ALL""",
    "set_union_all": "SELECT k, kind, count(*) AS n FROM (SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49",
    "set_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "window_rank": """WITH t AS (SELECT o_custkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE), 2) AS total FROM orders GROUP BY 1)
        SELECT c_nationkey, c_custkey, total, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS INT) AS place FROM t JOIN customer ON o_custkey = c_custkey QUALIFY place <= 3""",
    "window_latest": "SELECT o_custkey, CAST(o_orderdate AS DATE) AS last_day, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "window_lag_lead": _q(", m AS (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS n FROM sales GROUP BY ALL) SELECT region, month, n, CAST(lag(n) OVER w AS DOUBLE) AS before, CAST(lead(n) OVER w AS DOUBLE) AS after FROM m WINDOW w AS (PARTITION BY region ORDER BY month)").replace(")\n,", "),\n"),
    "window_running_sum": "WITH m AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, day, n, CAST(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY day) AS BIGINT) AS so_far FROM m",
    "window_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "top_k": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20",
    "topk_remainder": _q(", t AS (SELECT nation, sum(sales) AS s, row_number() OVER (ORDER BY abs(sum(sales)) DESC, nation) <= 5 AS is_top FROM sales GROUP BY 1) SELECT CASE WHEN is_top THEN nation ELSE '(other)' END AS nation, is_top, round(sum(s), 4) AS s, count(*) AS members FROM t GROUP BY ALL").replace(")\n,", "),\n"),
    "other_aggregates": """SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(stddev_pop(o_totalprice), 4) AS sd, bool_and(o_totalprice > 1000) AS all_over, bool_or(o_totalprice > 400000) AS any_over,
        string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1""",
    "ratio_of_sums": _q("SELECT channel, round(sum(profit) / nullif(sum(sales), 0), 8) AS margin, count(DISTINCT customer_id) AS customers FROM sales GROUP BY 1"),
}
