"""Exact quantiles that no single task has to hold: by value counts in sorted ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable


def exact_quantiles(df: DataFrame, keys: dict[str, Column], value: Column, shares: list[float]) -> DataFrame:
    """(*keys, q): per key the interpolated quantiles of the non-null values, as an array; nulls are keys.

    Values are counted before the shuffle and spread over ranges of key and value, so that a key that holds a third of all
    rows is split; the running count within a range is offset by the sizes of the ranges before it.
    """
    names = list(keys)
    counts = df.select(*[c.alias(n) for n, c in keys.items()], value.alias("_v")).filter("_v is not null").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(*[F.col(n).asc_nulls_first() for n in names], F.col("_v")).withColumn("_part", F.spark_partition_id())
    ranged = durable(ranged)  # ranges are drawn from a sample, so they must not be drawn twice
    per_key = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    sizes = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(
        *[F.col(n).alias(f"_k_{n}") for n in names], F.col("_part").alias("_p"), F.sum("_size").over(per_key).alias("_total"),
        F.coalesce(F.sum("_size").over(per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    on = F.col("_part") == F.col("_p")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_k_{n}"))
    run = F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_run", F.coalesce(run, F.lit(0))).join(sizes, on).withColumn("_before", F.col("_offset") + F.col("_run"))
    ends = []
    for k, q in enumerate(shares):
        at = (F.col("_total") - 1) * F.lit(float(q))
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v"))).cast("double").alias(f"_{end}{k}"))
    found = placed.groupBy(*names).agg(F.max("_total").alias("_total"), *ends)
    if not names:
        found = found.filter("_total is not null")
    cells = []
    for k, q in enumerate(shares):
        at = (F.col("_total") - 1) * F.lit(float(q))
        cells.append(F.col(f"_lo{k}") + (at - F.floor(at)) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")))
    return found.select(*names, F.array(*cells).alias("q"))
