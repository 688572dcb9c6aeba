"""The sales view that many queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine.shared import table


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their order, product, customer and place; money is exact decimal until it is summed."""
    line, orders, customer = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey).join(region, F.col("n_regionkey") == region.r_regionkey)
        .select(
            F.col("l_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("channel"),
            F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("unit_price"),
            F.col("l_discount").alias("discount"), (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("sales"), (price * F.lit("0.6").cast("decimal(2,1)")).cast("double").alias("cogs"),
            (price * (1 - F.col("l_discount").cast("decimal(4,2)")) - price * F.lit("0.6").cast("decimal(2,1)")).cast("double").alias("profit"),
        )
    )


SALES = """sales AS (
  SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, r_name AS region, n_name AS nation, c_mktsegment AS channel, o_custkey AS customer_id,
         l_partkey AS product_id, l_quantity AS quantity, l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_discount AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS sales,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.6 AS DOUBLE) AS cogs,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) - CAST(l_extendedprice AS DECIMAL(12,2)) * 0.6 AS DOUBLE) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
