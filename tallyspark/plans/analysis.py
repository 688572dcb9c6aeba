"""Queries of profiles, attribution, contracts, order tools, events, cleaning and quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyspark.engine.shared import table
from tallyspark.operators import attribution as A
from tallyspark.operators import bridge as B
from tallyspark.operators import contracts as C
from tallyspark.operators import events as W
from tallyspark.operators import orders as O
from tallyspark.operators import profile as P
from tallyspark.operators import quality as Q
from tallyspark.operators import transform as X
from tallyspark.plans.base import SALES, sales

Y97, Y98 = ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01")
def _years():
    return F.year("order_date") == 1997, F.year("order_date") == 1998



def _round(df, places=4, skip=()):
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def eda_profile(spark, d):
    return _round(P.profile(table(spark, d, "orders"))).select("column_name", "n_rows", "n_null", "n_distinct", "mean", "sd", "min", "max", "p25", "p50", "p75", "p95", "p99", "skewness", "kurtosis")


def eda_top_values(spark, d):
    return P.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5).withColumn("n", F.col("n").cast("long")).withColumn("place", F.col("place").cast("int"))


def eda_quality_score(spark, d):
    return P.quality_score(P.profile(table(spark, d, "trace_rows").drop("ingested_at")))


def driver_sum(spark, d):
    return _round(A.driver_table(sales(spark, d), "sales", ["region"], *_years()))


def driver_count(spark, d):
    return _round(A.driver_table(sales(spark, d), "sales", ["channel"], *_years(), "COUNT").drop("contribution"))


def driver_path(spark, d):
    return _round(A.driver_path(sales(spark, d), "sales", ["region", "nation", "channel"], *_years()))


def driver_shapley(spark, d):
    return _round(A.shapley_members(sales(spark, d), "sales", ["region", "channel"], *_years()))


def rate_volume(spark, d):
    return _round(A.rate_volume(sales(spark, d), "channel", "unit_price", "quantity", *_years()), 3)


def variance_cells(spark, d):
    return _round(A.moment_cells(sales(spark, d), "discount", ["region", "channel"]))


def variance_shares(spark, d):
    out = A.variance_shares(sales(spark, d), "sales", ["region", "channel"])
    rows = [(f, float(v["ssb"] / out["sst"]), float(out["sequential"][f] / out["sst"]), float(out["shapley"][f] / out["sst"])) for f, v in out["factors"].items()]
    return _round(spark.createDataFrame(rows, "factor string, alone double, sequential double, shapley double"), 8)


def _windows(**more):
    return C.Windows("order_date", date(1997, 1, 1), date(1998, 1, 1), date(1998, 1, 1), date(1999, 1, 1), "month", complete_until=date(1999, 1, 1), **more)


def _frame(spark, d, metric):
    return C.tagged(sales(spark, d), metric, _windows())


def compare_sum(spark, d):
    return _round(C.compare(_frame(spark, d, C.Metric("sum", "sales"))))


def compare_ratio(spark, d):
    return _round(C.compare(_frame(spark, d, C.Metric("ratio", numerator="profit", denominator="sales"))), 8)


def compare_distinct(spark, d):
    return _round(C.compare(_frame(spark, d, C.Metric("distinct_count", "customer_id"))))


def compare_closing_balance(spark, d):
    one = sales(spark, d).groupBy("customer_id", "order_date").agg(F.sum("quantity").alias("balance"))
    return _round(C.compare(C.tagged(one, C.Metric("closing_balance", "balance", entities=("customer_id",)), _windows())))


def calendar_series(spark, d):
    return _round(C.series(_frame(spark, d, C.Metric("sum", "sales"))))


def decompose_dimension(spark, d):
    return _round(C.decompose_dimension(_frame(spark, d, C.Metric("sum", "sales")), "nation", 5))


def decompose_ratio(spark, d):
    return _round(C.decompose_ratio(_frame(spark, d, C.Metric("ratio", numerator="profit", denominator="sales"))), 8)


def _sensitivity(method):
    def query(spark, d):
        f = _frame(spark, d, C.Metric("sum", "sales"))
        return _round(C.sensitivity(f, "sales", method, {"zscore": 2.0, "iqr": 0.3, "mad": 2.0}[method], cohort="region").select("scenario", "base", "current", "base_rows", "current_rows"))

    query.__name__ = f"sensitivity_{method}"
    return query


def profit_bridge(spark, d):
    return _round(B.profit_bridge(sales(spark, d), Y97, Y98).withColumn("error", F.abs("error") < 0.01), 2)


def report_series(spark, d):
    return _round(O.calendar_series(sales(spark, d), "order_date", "profit", "month", date(1996, 7, 1), date(1998, 7, 1)))


def order_classes(spark, d):
    df = sales(spark, d).withColumn("sales", F.when(F.col("order_id") % 97 == 0, F.col("sales") * 10).otherwise(F.col("sales")))
    return O.order_classes(df, Y97, Y98, discount_threshold=0.095).groupBy("period", "order_class").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("sales"), 2).alias("sales"))


def order_reconciliation(spark, d):
    df = sales(spark, d).withColumn("sales", F.when(F.col("order_id") % 97 == 0, F.col("sales") * 10).otherwise(F.col("sales")))
    out = O.reconcile_orders(df, Y97, Y98, tolerance=0.02)
    return out.groupBy("period").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("observed_multiplier"), 6).alias("multiplier"), F.sum(F.size("matching")).alias("explained"))


def bridge_without_orders(spark, d):
    return _round(O.bridge_without(sales(spark, d), [1, 2, 3, 4, 5, 6, 7], Y97, Y98), 2).filter("effect = 'delta'")


def discount_drivers(spark, d):
    return _round(O.discount_drivers(sales(spark, d), Y97, Y98, "channel"), 2)


def discount_audit(spark, d):
    out = O.audit_orders(sales(spark, d), Y97, Y98, "nation", "channel")
    return out.groupBy("priority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("burden"), 3).alias("burden"), F.round(F.sum("profit"), 3).alias("profit"))


def discount_scenarios(spark, d):
    out = O.discount_scenarios(sales(spark, d), Y98, [0.02, 0.05], [0.0, 0.1], [0.0, 1.0])
    return _round(out.filter("level = 8").select("cap", "drop_share", "cost_share", "profit", "uplift", "tolerance"), 4)


def funnel(spark, d):
    return W.funnel(table(spark, d, "events"), ["view", "click", "purchase"], event="event_type", at="ts", start="2024-01-05", end="2024-01-05").select("step", "event", "users", "rate_from_first", "rate_from_previous")


def funnel_ordered(spark, d):
    return W.funnel(table(spark, d, "events"), ["view", "click", "purchase"], event="event_type", at="ts", start="2024-01-05", end="2024-01-05", ordered=True)


def user_flow(spark, d):
    return W.flow(table(spark, d, "events").withColumn("session", F.concat_ws("-", "user_id", F.to_date("ts"))).withColumn("at", F.struct("ts", "event_id")), "session", "event_type", "at", 12)


def retention(spark, d):
    return W.retention(table(spark, d, "events"), "user_id", "ts", 7)


def page_metrics(spark, d):
    e = table(spark, d, "events").withColumn("session", F.to_date("ts"))
    return _round(W.page_metrics(e, page="event_type", user="user_id", session="session", event="event_type", properties="props", view="view", leave="click", dwell="$.k"))


def session_summary(spark, d):
    t = table(spark, d, "trace_rows").withColumn("status_code", F.upper("status_code"))
    out = W.sessions(t, at="event_id")
    return out.select("session_id", F.coalesce("user_id", F.lit("-")).alias("user_id"), "started", "ended", "events", "errors", F.coalesce("entry_page", F.lit("-")).alias("entry_page"), F.coalesce("exit_page", F.lit("-")).alias("exit_page"))


def clean_table(spark, d):
    df = table(spark, d, "sales_lines").select("line_id", "discount", "unit_price", "region")
    return _round(X.clean(df, {"discount": "MEAN", "unit_price": 0.0, "region": "MODE"}, {"unit_price": (1.0, 1000.0)}).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("discount").alias("discount"), F.sum("unit_price").alias("prices")), 6)


def dedup_rows(spark, d):
    return X.clean(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dedup=["l_orderkey", "l_linenumber"])


def wide_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    n = n.withColumnRenamed("n_name", "c_name")
    return X.wide_join(c, [("nat", n, "fact.c_nationkey = nat.n_nationkey"), ("reg", r, "nat.n_regionkey = reg.r_regionkey")]).select("c_custkey", "c_name", "nat_c_name", "r_name")


def incremental_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    new = c.filter("c_custkey % 10 = 0").withColumn("balance", F.lit(0.0)).unionByName(c.filter("c_custkey = 1").withColumn("c_custkey", F.lit(-1).cast("long")))
    return X.merge(c, new, "c_custkey")


def quality_suite(spark, d):
    suite = [Q.Assertion("not_null", "region"), Q.Assertion("unique", "line_id"), Q.Assertion("between", "quantity", 1, 500), Q.Assertion("row_count", low=1), Q.Assertion("unique", "order_id", nulls_repeat=False)]
    return Q.run_suite(table(spark, d, "sales_lines"), suite)


QUERIES = {f.__name__: f for f in (
    eda_profile, eda_top_values, eda_quality_score, driver_sum, driver_count, driver_path, driver_shapley, rate_volume, variance_cells, variance_shares, compare_sum, compare_ratio, compare_distinct, compare_closing_balance,
    calendar_series, decompose_dimension, decompose_ratio, _sensitivity("zscore"), _sensitivity("iqr"), _sensitivity("mad"), profit_bridge, report_series, order_classes, order_reconciliation, bridge_without_orders, discount_drivers,
    discount_audit, discount_scenarios, funnel, funnel_ordered, user_flow, retention, page_metrics, session_summary, clean_table, dedup_rows, wide_join, incremental_merge, quality_suite,
)}


def _q(sql: str) -> str:
    return f"WITH {SALES}{', ' if sql.startswith('@') else ' '}{sql.lstrip('@')}"


_P = "CASE year(order_date) WHEN 1997 THEN 'base' WHEN 1998 THEN 'current' END"


def _both(x, f="sum"):
    return f"{f}({x}) FILTER (year(order_date) = 1997)", f"{f}({x}) FILTER (year(order_date) = 1998)"


def _compare(a, b, rows="count(*)"):
    n0, n1 = f"{rows} FILTER (year(order_date) = 1997)", f"{rows} FILTER (year(order_date) = 1998)"
    return f"SELECT a AS base, b AS current, b - a AS delta, (b - a) * 100 / abs(nullif(a, 0)) AS change_pct, base_rows, current_rows FROM (SELECT {a} AS a, {b} AS b, {n0} AS base_rows, {n1} AS current_rows FROM sales)"


def _rounded(sql, names, places=4, also=""):
    return f"SELECT {', '.join(f'round({n}, {places}) AS {n}' for n in names)}{also} FROM ({sql})"


_CMP = ["base", "current", "delta", "change_pct"]
_NUMERIC = "count(*) AS n_rows, count(*) - count({0}) AS n_null, count(DISTINCT {0}) AS n_distinct"
_FIG = "avg({0}) AS mean, stddev_samp({0}) AS sd, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, quantile_cont({0}, 0.95) AS p95, quantile_cont({0}, 0.99) AS p99, skewness({0}) AS skewness, kurtosis({0}) AS kurtosis"
_FIGS = ["mean", "sd", "min", "max", "p25", "p50", "p75", "p95", "p99", "skewness", "kurtosis"]


def _flag(method):
    if method == "zscore":
        ref, score = "SELECT region, avg(sales) AS m, stddev_pop(sales) AS s FROM t WHERE p = 'base' GROUP BY 1", "abs(sales - m) / nullif(s, 0) >= 2.0"
    elif method == "iqr":
        ref, score = "SELECT region, quantile_cont(sales, 0.25) AS m, quantile_cont(sales, 0.75) AS h, quantile_cont(sales, 0.75) - quantile_cont(sales, 0.25) AS s FROM t WHERE p = 'base' GROUP BY 1", "greatest(m - sales, sales - h, 0) / nullif(s, 0) > 0.3"
    else:
        ref, score = "SELECT region, any_value(m) AS m, median(abs(sales - m)) AS s FROM (SELECT t.region, sales, m FROM t JOIN (SELECT region, median(sales) AS m FROM t WHERE p = 'base' GROUP BY 1) USING (region) WHERE p = 'base') GROUP BY 1", "0.67449 * abs(sales - m) / nullif(s, 0) >= 2.0"
    return _q(f"@t AS (SELECT *, {_P} AS p FROM sales WHERE year(order_date) IN (1997, 1998)), ref AS ({ref}), f AS (SELECT t.*, coalesce({score}, false) AS bad FROM t JOIN ref USING (region)) "
              + " UNION ALL ".join(f"SELECT '{n}' AS scenario, round(sum(sales) FILTER (p = 'base'), 4) AS base, round(sum(sales) FILTER (p = 'current'), 4) AS current, count(*) FILTER (p = 'base') AS base_rows, count(*) FILTER (p = 'current') AS current_rows FROM f {c}" for n, c in (("all", ""), ("reviewed", "WHERE NOT bad"))))


def _bridge_cells(source, keys=""):
    k = f"{keys}, " if keys else ""
    parts = ", ".join(f"coalesce(sum({e}) FILTER (p = '{p}'), 0) AS {n}{i}" for i, p in enumerate(("base", "current")) for n, e in (("q", "quantity"), ("g", "quantity * unit_price"), ("dg", "quantity * unit_price * discount"), ("c", "cogs"), ("r", "sales - quantity * unit_price * (1 - discount)"), ("l", "profit - sales + cogs"), ("f", "profit")))
    own = ", ".join(f"coalesce({a}{i} / nullif({b}{i}, 0), {a}{1 - i} / nullif({b}{1 - i}, 0), 0) AS {n}{i}" for i in (0, 1) for n, a, b in (("p", "g", "q"), ("d", "dg", "g"), ("u", "c", "q")))
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""cells AS (SELECT {k}product_id, {parts} FROM {source} GROUP BY ALL), unit AS (SELECT *, {own}, sum(q0) {over} AS tq0, sum(q1) {over} AS tq1 FROM cells),
      mid AS (SELECT *, coalesce(q0 / nullif(tq0, 0), 0) AS s0, coalesce(q1 / nullif(tq1, 0), 0) AS s1, p0 * (1 - d0) - u0 AS m0, p1 * (1 - d1) - u1 AS m1 FROM unit),
      eff AS (SELECT {k}product_id, (tq1 - tq0) * (s0 * m0 + s1 * m1) / 2 AS volume, (tq0 + tq1) / 2 * (s1 - s0) * (m0 + m1) / 2 AS mix, (tq0 + tq1) / 2 * (s0 + s1) / 2 * (p1 - p0) * (1 - (d0 + d1) / 2) AS price,
        -(tq0 + tq1) / 2 * (s0 + s1) / 2 * (p0 + p1) / 2 * (d1 - d0) AS discount, -(tq0 + tq1) / 2 * (s0 + s1) / 2 * (u1 - u0) AS cost, r1 - r0 AS residual, l1 - l0 AS ledger, f0, f1, (tq0 + tq1) / 2 * (s0 + s1) / 2 * (p0 + p1) / 2 AS k FROM mid)"""


_EVENTS = "FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'"
_SUITE = [("not_null", "region", "count(*) FILTER (region IS NULL)"), ("unique", "line_id", "count(*) - count(DISTINCT line_id)"), ("between", "quantity", "count(*) FILTER (quantity < 1 OR quantity > 500)"), ("row_count", "*", "CAST(count(*) < 1 AS BIGINT)"), ("unique", "order_id", "count(order_id) - count(DISTINCT order_id)")]

SQL = {
    "eda_profile": " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, n_rows, n_null, n_distinct, {', '.join(f'round({f}, 4) AS {f}' for f in _FIGS)} FROM (SELECT {_NUMERIC.format(c)}, {_FIG.format(c)} FROM orders)" for c in ("o_orderkey", "o_custkey", "o_totalprice")]
        + [f"SELECT '{c}', {_NUMERIC.format(c)}, {', '.join('NULL' for _ in _FIGS)} FROM orders" for c in ("o_orderstatus", "o_orderdate", "o_orderpriority")]),
    "eda_top_values": " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INT) AS place FROM orders WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place <= 5" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "eda_quality_score": "SELECT greatest(20, 100 - CAST(sum(CASE WHEN s > 0.3 THEN 10 WHEN s > 0.05 THEN 3 ELSE 0 END) AS BIGINT)) AS score FROM ("
        + " UNION ALL ".join(f"SELECT 1 - count({c}) / count(*) AS s FROM trace_rows" for c in "event_id contract_id session_id user_id event_type event_name service_name page_path duration_ms status_code created_at event_date timestamp_ms".split()) + ")",
    "driver_sum": _q("SELECT region, round(b, 4) AS base, round(c, 4) AS current, round(c - b, 4) AS diff, round((c - b) / sum(c - b) OVER (), 4) AS contribution, round((c - b) * 100 / abs(b), 4) AS growth FROM (SELECT region, {0} AS b, {1} AS c FROM sales GROUP BY 1)".format(*_both("sales"))),
    "driver_count": _q("SELECT channel, CAST(b AS DOUBLE) AS base, CAST(c AS DOUBLE) AS current, CAST(c - b AS DOUBLE) AS diff, round((c - b) * 100 / b, 4) AS growth FROM (SELECT channel, {0} AS b, {1} AS c FROM sales GROUP BY 1)".format(*_both("sales", "count"))),
    "driver_path": _q("SELECT CAST(depth AS INT) AS depth, member, round(coalesce(b, 0), 4) AS base, round(coalesce(c, 0), 4) AS current, round(coalesce(c, 0) - coalesce(b, 0), 4) AS diff FROM ("
        + " UNION ALL ".join(f"SELECT {k + 1} AS depth, concat_ws(' / ', {', '.join(p)}) AS member, {_both('sales')[0]} AS b, {_both('sales')[1]} AS c FROM sales WHERE year(order_date) IN (1997, 1998) GROUP BY ALL" for k, p in enumerate((["region"], ["region", "nation"], ["region", "nation", "channel"]))) + ")"),
    "driver_shapley": _q(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS member, round({_both('sales')[1]} - {_both('sales')[0]}, 4) AS diff FROM sales GROUP BY {c}" for c in ("region", "channel"))),
    "rate_volume": _q("SELECT channel, round(p0 * (q1 - q0), 3) AS volume_effect, round(q0 * (p1 - p0), 3) AS rate_effect, round((p1 - p0) * (q1 - q0), 3) AS interaction, round((p0 + p1) / 2 * (q1 - q0), 3) AS shapley_volume, round((q0 + q1) / 2 * (p1 - p0), 3) AS shapley_rate FROM (SELECT channel, a0 / q0 AS p0, a1 / q1 AS p1, q0, q1 FROM (SELECT channel, {0} AS a0, {1} AS a1, {2} AS q0, {3} AS q1 FROM sales GROUP BY 1))".format(*_both("unit_price * quantity"), *_both("quantity"))),
    "variance_cells": _q("SELECT region, channel, count(*) AS n, round(sum(discount), 4) AS s, round(sum(discount * discount), 4) AS ss FROM sales GROUP BY ALL"),
    "variance_shares": _q("@t AS (SELECT sum(sales * sales) - sum(sales) * sum(sales) / count(*) AS sst, sum(sales) * sum(sales) / count(*) AS c FROM sales), x AS (SELECT (SELECT sum(s * s / n) FROM (SELECT sum(sales) AS s, count(*) AS n FROM sales GROUP BY region)) - c AS r, (SELECT sum(s * s / n) FROM (SELECT sum(sales) AS s, count(*) AS n FROM sales GROUP BY channel)) - c AS h, (SELECT sum(s * s / n) FROM (SELECT sum(sales) AS s, count(*) AS n FROM sales GROUP BY region, channel)) - c AS rh, sst FROM t) SELECT 'region' AS factor, round(r / sst, 8) AS alone, round(r / sst, 8) AS sequential, round((r + rh - h) / 2 / sst, 8) AS shapley FROM x UNION ALL SELECT 'channel', round(h / sst, 8), round((rh - r) / sst, 8), round((h + rh - r) / 2 / sst, 8) FROM x"),
    "compare_sum": _q(_rounded(_compare(*_both("sales")), _CMP, 4, ", base_rows, current_rows")),
    "compare_ratio": _q(_rounded(_compare(*[f"{a} / {b}" for a, b in zip(_both("profit"), _both("sales"), strict=True)]), _CMP, 8, ", base_rows, current_rows")),
    "compare_distinct": _q(_rounded(_compare(*[f"CAST({x} AS DOUBLE)" for x in _both("DISTINCT customer_id", "count")]), _CMP, 4, ", base_rows, current_rows")),
    "compare_closing_balance": _q("@b AS (SELECT customer_id, order_date, sum(quantity) AS balance, year(order_date) AS y FROM sales WHERE year(order_date) IN (1997, 1998) GROUP BY ALL), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY customer_id, y ORDER BY order_date DESC) = 1) SELECT base, current, current - base AS delta, round((current - base) * 100 / base, 4) AS change_pct, base_rows, current_rows FROM (SELECT sum(balance) FILTER (y = 1997) AS base, sum(balance) FILTER (y = 1998) AS current, count(*) FILTER (y = 1997) AS base_rows, count(*) FILTER (y = 1998) AS current_rows FROM l)"),
    "calendar_series": _q(f"SELECT {_P} AS period, CAST(date_trunc('month', order_date) AS DATE) AS bucket, round(sum(sales), 4) AS value FROM sales WHERE year(order_date) IN (1997, 1998) GROUP BY ALL"),
    "decompose_dimension": _q("@m AS (SELECT nation, {1} - {0} AS x FROM sales GROUP BY 1), r AS (SELECT nation, x, row_number() OVER (ORDER BY abs(x) DESC, nation) <= 5 AS is_top FROM m) SELECT CASE WHEN is_top THEN nation ELSE '(other)' END AS member, is_top, round(sum(x), 4) AS diff, count(*) AS members FROM r GROUP BY ALL".format(*_both("sales"))),
    "decompose_ratio": _q("SELECT round((a1 - a0) * (1 / b0 + 1 / b1) / 2, 8) AS numerator_effect, round((a0 + a1) / 2 * (1 / b1 - 1 / b0), 8) AS denominator_effect, round(a1 / b1 - a0 / b0, 8) AS delta FROM (SELECT {0} AS a0, {1} AS a1, {2} AS b0, {3} AS b1 FROM sales)".format(*_both("profit"), *_both("sales"))),
    "sensitivity_zscore": _flag("zscore"), "sensitivity_iqr": _flag("iqr"), "sensitivity_mad": _flag("mad"),
    "profit_bridge": _q(f"@t AS (SELECT *, {_P} AS p FROM sales WHERE year(order_date) IN (1997, 1998)), bad AS (SELECT DISTINCT order_id FROM t WHERE abs(sales - quantity * unit_price * (1 - discount)) > 0.01), sc AS (SELECT 'observed' AS scenario, * FROM t UNION ALL SELECT 'review', * FROM t WHERE order_id NOT IN (SELECT order_id FROM bad)), {_bridge_cells('sc', 'scenario')} SELECT scenario, round(sum(f0), 2) AS base, round(sum(f1), 2) AS current, round(sum(f1 - f0), 2) AS delta, round(sum(volume), 2) AS volume, round(sum(mix), 2) AS mix, round(sum(price), 2) AS price, round(sum(discount), 2) AS discount, round(sum(cost), 2) AS cost, round(sum(residual), 2) AS residual, round(sum(ledger), 2) AS ledger, abs(sum(f1 - f0) - sum(volume + mix + price + discount + cost + residual + ledger)) < 0.01 AS error FROM eff GROUP BY 1"),
    "report_series": _q("@m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS bucket, sum(profit) AS v FROM sales GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '1996-07-01', DATE '1998-06-01', INTERVAL 1 MONTH)) AS DATE) AS bucket) SELECT s.bucket, round(m.v, 4) AS value, round(a.v, 4) AS previous, round(b.v, 4) AS year_before FROM s LEFT JOIN m USING (bucket) LEFT JOIN m a ON a.bucket = s.bucket - INTERVAL 1 MONTH LEFT JOIN m b ON b.bucket = s.bucket - INTERVAL 1 YEAR"),
    "order_classes": _q(f"@t AS (SELECT * REPLACE (CASE WHEN order_id % 97 = 0 THEN sales * 10 ELSE sales END AS sales), {_P} AS p FROM sales WHERE year(order_date) IN (1997, 1998)), lim AS (SELECT quantile_cont(s, 0.75) + 1.5 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) AS x FROM (SELECT sum(sales) AS s FROM t WHERE p = 'base' GROUP BY order_id)), o AS (SELECT order_id, p, bool_or(abs(sales - quantity * unit_price * (1 - discount)) > 0.01) AS mis, bool_or(discount > 0.095) AS outl, sum(sales) AS s FROM t GROUP BY ALL) SELECT p AS period, CASE WHEN mis THEN 'amount_mismatch' WHEN outl THEN 'discount_outlier' WHEN s > (SELECT x FROM lim) THEN 'large_order_checks_passed' ELSE 'other_checks_passed' END AS order_class, count(*) AS orders, round(sum(s), 2) AS sales FROM o GROUP BY ALL"),
    "order_reconciliation": _q(f"@t AS (SELECT * REPLACE (CASE WHEN order_id % 97 = 0 THEN sales * 10 ELSE sales END AS sales), {_P} AS p FROM sales WHERE year(order_date) IN (1997, 1998)), l AS (SELECT DISTINCT order_id, order_date, product_id, quantity, unit_price, discount, sales, cogs, profit, p, quantity * unit_price * (1 - discount) AS e FROM t) SELECT p AS period, count(*) AS lines, round(avg(sales / e), 6) AS multiplier, CAST(sum(len(list_filter([0.01, 0.1, 10, 100, 1000], lambda m: abs(sales - e * m) <= 0.02))) AS BIGINT) AS explained FROM l WHERE abs(sales - e) > 0.02 GROUP BY 1"),
    "bridge_without_orders": _q("SELECT 'delta' AS effect, round(a, 2) AS observed, round(b, 2) AS without, round(a - b, 2) AS difference FROM (SELECT {1} - {0} AS a, sum(profit) FILTER (year(order_date) = 1998 AND order_id NOT BETWEEN 1 AND 7) - sum(profit) FILTER (year(order_date) = 1997 AND order_id NOT BETWEEN 1 AND 7) AS b FROM sales)".format(*_both("profit"))),
    "discount_drivers": _q(f"@t AS (SELECT *, {_P} AS p FROM sales WHERE year(order_date) IN (1997, 1998)), {_bridge_cells('t')}, mc AS (SELECT product_id, channel, coalesce(sum(quantity * unit_price) FILTER (p = 'base'), 0) AS g0, coalesce(sum(quantity * unit_price) FILTER (p = 'current'), 0) AS g1, coalesce(sum(quantity * unit_price * discount) FILTER (p = 'base'), 0) AS e0, coalesce(sum(quantity * unit_price * discount) FILTER (p = 'current'), 0) AS e1 FROM t GROUP BY ALL), mw AS (SELECT *, sum(g0) OVER w AS tg0, sum(g1) OVER w AS tg1 FROM mc WINDOW w AS (PARTITION BY product_id)), mr AS (SELECT product_id, channel, coalesce(CASE WHEN tg0 <> 0 THEN g0 / tg0 ELSE g1 / nullif(tg1, 0) END, 0) AS w0, coalesce(CASE WHEN tg1 <> 0 THEN g1 / tg1 ELSE g0 / nullif(tg0, 0) END, 0) AS w1, coalesce(e0 / nullif(g0, 0), e1 / nullif(g1, 0), 0) AS r0, coalesce(e1 / nullif(g1, 0), e0 / nullif(g0, 0), 0) AS r1 FROM mw) SELECT channel AS member, round(sum(-k * (w0 + w1) / 2 * (r1 - r0)), 2) AS rate_effect, round(sum(-k * (r0 + r1) / 2 * (w1 - w0)), 2) AS structure_effect, round(sum(-k * (w0 + w1) / 2 * (r1 - r0)) + sum(-k * (r0 + r1) / 2 * (w1 - w0)), 2) AS discount_effect FROM mr JOIN eff USING (product_id) GROUP BY 1"),
    "discount_audit": _q("""@t AS (SELECT *, quantity * unit_price AS g FROM sales), b AS (SELECT * FROM t WHERE year(order_date) = 1997), c AS (SELECT * FROM t WHERE year(order_date) = 1998),
      r1 AS (SELECT product_id, nation, channel, sum(g * discount) / sum(g) AS x1 FROM b GROUP BY ALL HAVING count(DISTINCT order_id) >= 3), r2 AS (SELECT product_id, channel, sum(g * discount) / sum(g) AS x2 FROM b GROUP BY ALL HAVING count(DISTINCT order_id) >= 3), r3 AS (SELECT product_id, sum(g * discount) / sum(g) AS x3 FROM b GROUP BY ALL HAVING count(DISTINCT order_id) >= 3),
      l AS (SELECT c.*, coalesce(x1, x2, x3) AS ref FROM c LEFT JOIN r1 USING (product_id, nation, channel) LEFT JOIN r2 USING (product_id, channel) LEFT JOIN r3 USING (product_id)),
      o AS (SELECT order_id, bool_or(abs(sales - quantity * unit_price * (1 - discount)) > 0.01 OR abs(profit - sales + cogs) > 0.01) AS mis, coalesce(sum(g * (discount - ref)), 0) AS burden, sum(profit) AS profit, bool_or(ref IS NULL) AS unk FROM l GROUP BY 1)
      SELECT CASE WHEN mis THEN 'P0_ACCOUNTING' WHEN profit < 0 AND burden > 0 THEN 'P1_LOSS' WHEN profit < 0 THEN 'P2_SELECTED_LOSS' WHEN burden >= 500 THEN 'P2_MATERIAL' WHEN unk THEN 'P3_REFERENCE' ELSE 'P3_ROUTINE' END AS priority, count(*) AS orders, round(sum(burden), 3) AS burden, round(sum(profit), 3) AS profit FROM o GROUP BY 1"""),
    "discount_scenarios": _q("@t AS (SELECT quantity * unit_price AS g, discount, cogs, profit FROM sales WHERE year(order_date) = 1998), n AS (SELECT cap, sum(g * (1 - least(discount, cap))) AS net, sum(cogs) AS c, sum(profit) AS now FROM t, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) x(cap) GROUP BY 1) SELECT cap, drop_share, cost_share, round(net * (1 - drop_share) - c * (1 - cost_share * drop_share), 4) AS profit, round(net * (1 - drop_share) - c * (1 - cost_share * drop_share) - now, 4) AS uplift, round((net - c - now) / (net - cost_share * c), 4) AS tolerance FROM n, (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) y(drop_share), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) z(cost_share)"),
    "funnel": f"WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c {_EVENTS} GROUP BY 1), n AS (SELECT count(*) FILTER (a) AS x, count(*) FILTER (a AND b) AS y, count(*) FILTER (a AND b AND c) AS z FROM u) SELECT 1 AS step, 'view' AS event, x AS users, 1.0::DOUBLE AS rate_from_first, 1.0::DOUBLE AS rate_from_previous FROM n UNION ALL SELECT 2, 'click', y, round(y / x, 4), round(y / x, 4) FROM n UNION ALL SELECT 3, 'purchase', z, round(z / x, 4), round(z / y, 4) FROM n",
    "funnel_ordered": f"WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'click') AS b, min(ts) FILTER (event_type = 'purchase') AS c {_EVENTS} GROUP BY 1), n AS (SELECT count(a) AS x, count(*) FILTER (b >= a) AS y, count(*) FILTER (b >= a AND c >= b) AS z FROM u) SELECT 1 AS step, 'view' AS event, x AS users, 1.0::DOUBLE AS rate_from_first, 1.0::DOUBLE AS rate_from_previous FROM n UNION ALL SELECT 2, 'click', y, round(y / x, 4), round(y / x, 4) FROM n UNION ALL SELECT 3, 'purchase', z, round(z / x, 4), round(z / y, 4) FROM n",
    "user_flow": "WITH s AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS target FROM events) SELECT source, target, count(*) AS n FROM s WHERE source <> target GROUP BY ALL ORDER BY n DESC, source, target LIMIT 12",
    "retention": "WITH a AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d FROM events), f AS (SELECT u, min(d) AS cohort FROM a GROUP BY 1) SELECT cohort, CAST(d - cohort AS INT) AS day, count(*) AS users, any_value(z) AS cohort_size, round(count(*) / any_value(z), 4) AS rate FROM a JOIN f USING (u) JOIN (SELECT cohort, count(*) AS z FROM f GROUP BY 1) USING (cohort) WHERE d - cohort <= 7 GROUP BY ALL",
    "page_metrics": "SELECT event_type AS page, count(*) FILTER (event_type = 'view') AS views, count(DISTINCT user_id) FILTER (event_type = 'view') AS users, count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'view') AS sessions, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) FILTER (event_type = 'click'), 4) AS mean_dwell FROM events GROUP BY 1",
    "session_summary": "SELECT session_id, coalesce(user_id, '-') AS user_id, min(event_id) AS started, max(event_id) AS ended, count(*) AS events, count(*) FILTER (event_type = 'error' OR upper(status_code) = 'ERROR') AS errors, coalesce(arg_min(page_path, {'a': event_id, 'b': page_path}), '-') AS entry_page, coalesce(arg_max(page_path, {'a': event_id, 'b': page_path}), '-') AS exit_page FROM trace_rows GROUP BY session_id, user_id",
    "clean_table": "WITH m AS (SELECT avg(discount) AS d, (SELECT region FROM sales_lines WHERE region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 1) AS r FROM sales_lines) SELECT coalesce(region, r) AS region, count(*) AS n, round(avg(coalesce(discount, d)), 6) AS discount, round(sum(least(greatest(coalesce(unit_price, 0), 1), 1000)), 6) AS prices FROM sales_lines, m GROUP BY 1",
    "dedup_rows": "SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL",
    "wide_join": "SELECT c_custkey, c_name, n_name AS nat_c_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "incremental_merge": "SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 0.0::DOUBLE FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -1, round(c_acctbal, 2) FROM customer WHERE c_custkey = 1",
    "quality_suite": " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS place, '{r}' AS rule, '{c}' AS column_name, {e} AS failures, {e} = 0 AS passed FROM sales_lines" for k, (r, c, e) in enumerate(_SUITE)),
}
