"""Queries of statistics, insights, mining, the semantic layer, the ontology, sources and streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tallyspark.engine import guard
from tallyspark.engine.shared import shared_folder, table
from tallyspark.operators import insight as I
from tallyspark.operators import mining as M
from tallyspark.operators import ontology as N
from tallyspark.operators import semantic as S
from tallyspark.operators import stats as T
from tallyspark.operators.transform import Model, ModelGraph
from tallyspark.plans.base import SALES, sales
from tallyspark.sinks import writers
from tallyspark.sources import readers
from tallyspark.streaming import events as stream


def _round(df, places=6):
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _one(spark, values: dict):
    kinds = {float: "double", int: "long", bool: "boolean", str: "string"}
    return _round(spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())))


def pearson_pairs(spark, d):
    return _round(T.correlation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "n", "r", "high"))


def spearman_pairs(spark, d):
    return _round(T.correlation(table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")), ["c_acctbal", "o_totalprice"], "spearman").select("a", "b", "n", "r"))


def simpson_groups(spark, d):
    df = sales(spark, d).withColumn("part", F.col("product_id") % 50)
    return _round(T.simpson(df, "part", ["quantity", "unit_price", "discount"])).select("a", "b", "group", "r_all", "r_group")


def t_test(spark, d):
    r = T.t_test(table(spark, d, "lineitem").filter("l_returnflag <> 'R'"), "l_extendedprice", "l_returnflag")
    return _one(spark, {"t": float(r["t"]), "df": float(r["df"]), "d": float(r["cohen_d"])})


def paired_t_test(spark, d):
    r = T.paired_t_test(sales(spark, d), "sales", "cogs")
    return _one(spark, {"n": r["n"], "t": float(r["t"]), "d": float(r["cohen_d"])})


def anova_one_way(spark, d):
    r = T.anova(sales(spark, d), "sales", "channel")
    return _one(spark, {"n": r["n"], "f": float(r["f"]), "eta2": float(r["eta2"])})


def anova_two_way(spark, d):
    rows = T.two_way_anova(sales(spark, d), "sales", "region", "channel")
    return spark.createDataFrame([(r["factor"], r["df"], float(r["ss"])) for r in rows], "factor string, df long, ss double").withColumn("ss", F.round("ss", 0))


def chi_square(spark, d):
    r = T.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return _one(spark, {"n": r["n"], "chi2": float(r["chi2"]), "df": r["df"], "v": float(r["cramer_v"])})


def mann_whitney(spark, d):
    r = T.mann_whitney(table(spark, d, "lineitem").filter("l_returnflag <> 'R'"), "l_quantity", "l_returnflag")
    return _one(spark, {"u": float(r["u"]), "effect": float(r["rank_biserial"])})


def ols(spark, d):
    r = T.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return _one(spark, {"n": r["n"], "intercept": r["terms"][0]["coefficient"], "slope": r["terms"][1]["coefficient"], "r2": float(r["r2"])}).withColumns({"intercept": F.round("intercept", 3), "slope": F.round("slope", 3)})


def ols_two(spark, d):
    r = T.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return spark.createDataFrame([(t["term"], float(t["coefficient"]), float(t["p"])) for t in r["terms"]], "term string, coefficient double, p double")


def logistic(spark, d):
    r = T.logistic(table(spark, d, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50_000).cast("double")).withColumn("q", F.col("l_quantity") / 10), "y", ["q"])
    return spark.createDataFrame([(t["term"], float(t["coefficient"]), float(t["odds_ratio"])) for t in r["terms"]], "term string, coefficient double, odds_ratio double")


def outliers_z(spark, d):
    _, rows = I.outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", threshold=1.7, k=20)
    return rows.select("o_orderkey", F.round("score", 6).alias("score"))


def outliers_iqr(spark, d):
    n, _ = I.outliers(sales(spark, d).select("sales"), "sales", "iqr")
    return spark.createDataFrame([(n,)], "n long")


def isolation_forest(spark, d):
    df = I.isolation_forest(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return df.filter("is_outlier")


def trend_slopes(spark, d):
    df = sales(spark, d).withColumn("month", F.trunc("order_date", "month"))
    return I.trend(df, "month", "quantity", "region").select("group", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "direction")


def dominance(spark, d):
    return _round(I.dominance(sales(spark, d), "nation", "quantity"))


def discover_insights(spark, d):
    found = I.discover(table(spark, d, "sales_lines"))["insights"]
    return spark.createDataFrame([(k, f["kind"], f["text"]) for k, f in enumerate(found)], "place int, kind string, text string")


def rfm(spark, d):
    df = M.rfm(sales(spark, d), "customer_id", "order_date", "order_id", "quantity", "2001-08-02")
    return df.groupBy("r", "f", "m").agg(F.count(F.lit(1)).alias("customers"))


def kmeans(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return M.kmeans(df, ["c_acctbal", "nation"], 3)[0]


def forecast(spark, d):
    df = sales(spark, d).filter("order_date < date'2001-07-01'").withColumn("month", F.date_format("order_date", "yyyy-MM"))
    r = M.forecast(df, "month", "quantity", 6, "holt")
    return spark.createDataFrame(list(zip(range(1, 7), r["forecast"], r["low"], r["high"], strict=True)), "step int, forecast double, low double, high double")


def _store(spark, d):
    store = S.Store(spark, {"orders": table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "customer": table(spark, d, "customer"), "nation": table(spark, d, "nation"), "lineitem": table(spark, d, "lineitem")})
    store.add_model(S.Model("nations", "nation", [S.Entity("nation", "n_nationkey", True)], ["n_name"]))
    store.add_model(S.Model("customers", "customer", [S.Entity("customer", "c_custkey", True), S.Entity("nation", "c_nationkey")], ["c_mktsegment"]))
    store.add_model(S.Model("orders", "orders", [S.Entity("order", "o_orderkey", True), S.Entity("customer", "o_custkey")], ["o_orderstatus"], "day"))
    store.add_model(S.Model("lines", "lineitem", [S.Entity("order", "l_orderkey")], ["l_returnflag"]))
    store.add_metric(S.Metric("orders_n", "orders", "count(*)"))
    store.add_metric(S.Metric("balance", "customers", "sum(cast(c_acctbal as decimal(14,2)))"))
    store.add_metric(S.Metric("quantity", "lines", "sum(l_quantity)"))
    store.add_metric(S.Metric("per_order", kind="ratio", inputs=("quantity", "orders_n")))
    store.add_metric(S.Metric("orders_so_far", kind="cumulative", inputs=("orders_n",)))
    return store


def metric_two_tables(spark, d):
    return _round(_store(spark, d).query(["orders_n", "balance"], ["n_name"]), 2)


def metric_ratio(spark, d):
    return _round(_store(spark, d).query(["per_order"], ["o_orderstatus"]))


def metric_cumulative(spark, d):
    return _store(spark, d).query(["orders_so_far"], ["day"])


def ontology_two_hops(spark, d):
    o = N.Ontology(spark, {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders"), "lineitem": table(spark, d, "lineitem"), "part": table(spark, d, "part")})
    o.add_object(N.ObjectType("Customer", "customer", "c_custkey", {"balance": "c_acctbal"}))
    o.add_object(N.ObjectType("Order", "orders", "o_orderkey"))
    o.add_object(N.ObjectType("Part", "part", "p_partkey"))
    o.add_link(N.LinkType("placed", "Customer", "Order", "c_custkey", "o_custkey"))
    o.add_link(N.LinkType("holds", "Order", "Part", "o_orderkey", "p_partkey", "many_to_many", "lineitem", "l_orderkey", "l_partkey"))
    hops = o.traverse("Customer", ["placed", "holds"], "c_acctbal > 9900")
    return hops[0].select(F.lit(1).alias("hop"), "key").unionByName(hops[1].select(F.lit(2).alias("hop"), "key"))


def ontology_objects(spark, d):
    o = N.Ontology(spark, {"part": table(spark, d, "part")})
    o.add_object(N.ObjectType("Part", "part", "p_partkey", {"name": "p_name", "large": "p_size > 40"}))
    return o.query("Part", ["name", "large"], "p_brand = 'Brand#13'")


def model_graph(spark, d):
    """Two dependent models, of which the second is written as a versioned table and merged a second time."""
    table(spark, d, "orders").createOrReplaceTempView("mg_orders")
    graph = ModelGraph(spark, os.path.join(shared_folder(spark).removeprefix("file://"), f"models-{uuid.uuid4().hex}"))
    graph.add(Model("mg_daily", "SELECT to_date(o_orderdate) AS day, count(*) AS n FROM mg_orders GROUP BY 1"))
    graph.add(Model("mg_monthly", "SELECT trunc(day, 'month') AS month, sum(n) AS n FROM mg_daily GROUP BY 1", "incremental", "month"))
    graph.run()
    graph.run(["mg_monthly"])
    return spark.table("mg_monthly")


def sql_lineage(spark, d):
    sources = guard.referenced_tables(spark, "WITH a AS (SELECT * FROM orders) SELECT * FROM a JOIN customer c ON a.k = c.k WHERE EXISTS (SELECT 1 FROM nation)")
    return spark.createDataFrame([(s,) for s in sorted(sources)], "source string")


def file_round_trip(spark, d):
    folder = os.path.join(shared_folder(spark), f"trip-{uuid.uuid4().hex}")
    writers.write(table(spark, d, "nation"), f"{folder}/nation.csv")
    writers.write(readers.read(spark, f"{folder}/nation.csv", columns=["n_name", "n_regionkey"], where="n_regionkey < 3", schema="n_nationkey int, n_name string, n_regionkey int"), f"{folder}/nation.parquet")
    return readers.read(spark, f"{folder}/nation.parquet")


def trace_import(spark, d):
    t = readers.trace_records(table(spark, d, "trace_rows").drop("ingested_at"), "2026-01-01T00:00:00")
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("properties").alias("with_properties"))


def _streamed(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = os.path.dirname(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, df, name):
    folder = os.path.join(shared_folder(spark), f"stream-{name}-{uuid.uuid4().hex}")
    query = stream.to_parquet(df, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def stream_deduplicated(spark, d):
    out = _drained(spark, stream.fresh_events(_streamed(spark, d), late="40 days"), "fresh")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_windows(spark, d):
    """Hourly windows that the watermark has closed, which are all but those of the last stretch."""
    out = _drained(spark, stream.windowed(_streamed(spark, d), ["event_type"], "value", length="1 hour", late="0 seconds"), "windows")
    return out.filter("window_end <= timestamp'2024-01-29 00:00:00'").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    pearson_pairs, spearman_pairs, simpson_groups, t_test, paired_t_test, anova_one_way, anova_two_way, chi_square, mann_whitney, ols, ols_two, logistic, outliers_z, outliers_iqr, isolation_forest, trend_slopes, dominance,
    discover_insights, rfm, kmeans, forecast, metric_two_tables, metric_ratio, metric_cumulative, ontology_two_hops, ontology_objects, model_graph, sql_lineage, file_round_trip, trace_import, stream_deduplicated, stream_windows,
)}


def _q(sql: str) -> str:
    return f"WITH {SALES}{', ' if sql.startswith('@') else ' '}{sql.lstrip('@')}"


_AB = "FILTER (l_returnflag = 'A')", "FILTER (l_returnflag = 'N')"
SQL = {
    "pearson_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) >= 0.7 AS high FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))),
    "spearman_pairs": "SELECT 'c_acctbal' AS a, 'o_totalprice' AS b, count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT rank() OVER (ORDER BY c_acctbal) AS x, rank() OVER (ORDER BY o_totalprice) AS y FROM customer JOIN orders ON c_custkey = o_custkey)",
    "simpson_groups": _q("@g AS (SELECT CAST(product_id % 50 AS VARCHAR) AS g, * FROM sales), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, g, (SELECT corr({a}, {b}) FROM sales) AS r_all, corr({a}, {b}) AS r_group FROM g GROUP BY g HAVING count(*) >= 3" for a, b in (("quantity", "unit_price"), ("quantity", "discount"), ("unit_price", "discount"))) + ') SELECT a, b, g AS "group", round(r_all, 6) AS r_all, round(r_group, 6) AS r_group FROM p WHERE r_all * r_group < 0 AND abs(r_all) >= 0.1 AND abs(r_group) >= 0.1'),
    "t_test": """WITH l AS (SELECT l_returnflag AS g, l_extendedprice AS y FROM lineitem WHERE l_returnflag <> 'R'), s AS (SELECT count(*) FILTER (g = 'A') AS na, count(*) FILTER (g = 'N') AS nb, avg(y) FILTER (g = 'A') AS ma, avg(y) FILTER (g = 'N') AS mb, var_samp(y) FILTER (g = 'A') AS va, var_samp(y) FILTER (g = 'N') AS vb FROM l)
        SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, CAST(na + nb - 2 AS DOUBLE) AS df, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s""",
    "paired_t_test": _q("SELECT count(*) AS n, round(avg(sales - cogs) / (stddev_samp(sales - cogs) / sqrt(count(*))), 6) AS t, round(-avg(sales - cogs) / stddev_samp(sales - cogs), 6) AS d FROM sales"),
    "anova_one_way": _q("@g AS (SELECT channel, count(*) AS n, avg(sales) AS m, var_samp(sales) AS v FROM sales GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS w FROM g), b AS (SELECT sum(g.n * (m - grand) * (m - grand)) AS ssb FROM g, t) SELECT CAST(n AS BIGINT) AS n, round(ssb / (k - 1) / (w / (n - k)), 6) AS f, round(ssb / (ssb + w), 6) AS eta2 FROM t, b"),
    "chi_square": "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x, sum(n) OVER () AS t FROM c) SELECT CAST(any_value(t) AS BIGINT) AS n, round(sum((n - x) * (n - x) / x), 6) AS chi2, CAST(8 AS BIGINT) AS df, round(sqrt(sum((n - x) * (n - x) / x) / any_value(t) / 2), 6) AS v FROM e",
    "mann_whitney": "WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem WHERE l_returnflag <> 'R'), s AS (SELECT count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'N') AS b, sum(r) FILTER (g = 'A') AS ra FROM r) SELECT ra - a * (a + 1) / 2 AS u, round(2 * (ra - a * (a + 1) / 2) / (a * b) - 1, 6) AS effect FROM s",
    "ols": "SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem",
    "outliers_z": "WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round(abs(o_totalprice - a) / s, 6) AS score FROM orders, m WHERE abs(o_totalprice - a) / s >= 1.7 ORDER BY abs(o_totalprice - a) / s DESC, o_orderkey LIMIT 20",
    "outliers_iqr": _q("@q AS (SELECT quantile_cont(sales, 0.25) AS a, quantile_cont(sales, 0.75) AS b FROM sales) SELECT count(*) AS n FROM sales, q WHERE sales < a - 1.5 * (b - a) OR sales > b + 1.5 * (b - a)"),
    "trend_slopes": _q("@m AS (SELECT region, date_trunc('month', order_date) AS t, sum(quantity) AS y FROM sales GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) - 1 AS x FROM m) SELECT region AS \"group\", count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, CASE WHEN regr_slope(y, x) > 0 THEN 'up' WHEN regr_slope(y, x) < 0 THEN 'down' ELSE 'flat' END AS direction FROM x GROUP BY 1"),
    "dominance": _q("@c AS (SELECT nation, sum(quantity) AS v FROM sales GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v, nation) AS i, row_number() OVER (ORDER BY v DESC, nation) AS j, sum(v) OVER (ORDER BY v DESC, nation ROWS UNBOUNDED PRECEDING) AS run, sum(v) OVER () AS t FROM c) SELECT count(*) AS categories, sum(v) AS total, round(2 * sum(v * i) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(v) FILTER (j <= 3) / sum(v), 6) AS top_share, count(*) FILTER (run < t * 0.8) + 1 AS pareto_80 FROM r"),
    "rfm": _q("@p AS (SELECT customer_id, DATE '2001-08-02' - max(order_date) AS r, count(DISTINCT order_id) AS f, sum(quantity) AS m FROM sales GROUP BY 1), q AS (SELECT quantile_cont(r, [0.25, 0.5, 0.75]) AS qr, quantile_cont(f, [0.25, 0.5, 0.75]) AS qf, quantile_cont(m, [0.25, 0.5, 0.75]) AS qm FROM p) SELECT CAST(5 - len(list_filter(qr, lambda x: x <= p.r)) AS INT) AS r, CAST(1 + len(list_filter(qf, lambda x: x <= p.f)) AS INT) AS f, CAST(1 + len(list_filter(qm, lambda x: x <= p.m)) AS INT) AS m, count(*) AS customers FROM p, q GROUP BY ALL"),
    "metric_two_tables": "WITH o AS (SELECT n_name, count(*) AS x FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_name, sum(CAST(c_acctbal AS DECIMAL(14,2))) AS y FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT coalesce(o.n_name, b.n_name) AS n_name, CAST(x AS DOUBLE) AS orders_n, round(CAST(y AS DOUBLE), 2) AS balance FROM o FULL JOIN b ON o.n_name IS NOT DISTINCT FROM b.n_name",
    "metric_ratio": "SELECT o_orderstatus, round(q / n, 6) AS per_order FROM (SELECT o_orderstatus, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) USING (o_orderstatus)",
    "metric_cumulative": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) SELECT s.day, CAST(sum(n) OVER (ORDER BY s.day) AS DOUBLE) AS orders_so_far FROM s LEFT JOIN d USING (day)",
    "ontology_two_hops": "WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)) SELECT 1 AS hop, o_orderkey AS key FROM o UNION ALL SELECT DISTINCT 2, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)",
    "ontology_objects": "SELECT p_partkey, p_name AS name, p_size > 40 AS large FROM part WHERE p_brand = 'Brand#13'",
    "model_graph": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1",
    "sql_lineage": "SELECT unnest(['customer', 'nation', 'orders']) AS source",
    "file_round_trip": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3",
    "trace_import": "SELECT event_type, count(*) AS n, count(*) AS with_properties FROM trace_rows GROUP BY 1",
    "stream_deduplicated": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY ALL",
}
