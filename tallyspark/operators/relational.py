"""Grouped aggregates, pivots, filters, top-k with remainder, and governed free SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.engine import guard

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max,
    "MEDIAN": F.median, "STDDEV": F.stddev_samp, "DISTINCT": F.count_distinct,
}


def aggregate(
    df: DataFrame, dims: list[str], metrics: list[str], funcs: list[str], filters: str | None = None, *, mode: str = "group", sets: list[list[str]] | None = None,
    order: list[tuple[str, bool]] | None = None, limit: int | None = None,
) -> DataFrame:
    """Aggregates named <metric>_<func> by dimensions; mode is group, rollup, cube or sets.

    For rollup, cube and sets, ``level`` is Spark's grouping id, which tells subtotals from nulls in the data. With a
    limit, rows are ordered by ``order`` (column, descending), by default the first metric descending and then the
    dimensions; nulls come last.
    """
    guard.columns(df, [*dims, *metrics])
    rows = df.filter(guard.predicate(df.sparkSession, filters)) if filters else df
    unknown = [f for f in funcs if f.upper() not in AGGREGATES]
    if unknown or not metrics or not funcs:
        raise ValueError(f"functions are {sorted(AGGREGATES)}; unknown: {unknown}")
    out = [AGGREGATES[f.upper()](F.col(guard.quoted(m))).alias(f"{m}_{f.lower()}") for m in metrics for f in funcs]
    keys = [F.col(guard.quoted(c)) for c in dims]
    if mode == "group":
        done = rows.groupBy(*keys).agg(*out)
    elif mode in ("rollup", "cube"):
        done = getattr(rows, mode)(*keys).agg(*out, F.grouping_id().cast("long").alias("level"))
    elif mode == "sets":
        done = rows.groupingSets([[F.col(guard.quoted(c)) for c in s] for s in sets or []], *keys).agg(*out, F.grouping_id().cast("long").alias("level"))
    else:
        raise ValueError(f"no mode {mode!r}")
    if limit is not None:
        keys_ = order or [(f"{metrics[0]}_{funcs[0].lower()}", True), *((d, False) for d in dims)]
        done = done.orderBy(*[F.col(guard.quoted(c)).desc_nulls_last() if down else F.col(guard.quoted(c)).asc_nulls_last() for c, down in keys_]).limit(limit)
    return done


def pivot(df: DataFrame, rows: list[str], column: str, value: str, func: str, values: list[str] | None = None, *, zero_filled: bool = False, max_columns: int = 500) -> DataFrame:
    """One column <value>_<func> per value of ``column``.

    zero_filled counts rows of other values as 0 in every function, as a CASE with ELSE 0 does; otherwise they are left
    out and only SUM and COUNT of an empty cell are 0. The values are read first unless given; more than max_columns is
    an error, never a cut.
    """
    guard.columns(df, [*rows, column, value])
    if values is None:
        found = df.select(F.col(guard.quoted(column)).cast("string").alias("v")).filter("v is not null").distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"{column} has more than {max_columns} values")
        values = sorted(r.v for r in found)
    f, x, at = AGGREGATES[func.upper()], F.col(guard.quoted(value)), F.col(guard.quoted(column)).cast("string")
    cells = []
    for v in values:
        cell = f(F.when(at == v, x).otherwise(0)) if zero_filled else f(F.when(at == v, x))
        cells.append((F.coalesce(cell, F.lit(0)) if func.upper() == "SUM" else cell).alias(f"{v}_{func.lower()}"))
    return df.groupBy(*[F.col(guard.quoted(r)) for r in rows]).agg(*cells)


def matching(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns, as text, equal the given values."""
    guard.columns(df, list(wanted))
    for c, v in wanted.items():
        df = df.filter(F.col(guard.quoted(c)).cast("string") == F.lit(v))
    return df


def top_with_remainder(df: DataFrame, key: str, value: str, k: int, other: str = "(other)") -> DataFrame:
    """(key, value, members): the k members of greatest absolute value, and the rest as one row.

    ``df`` is one row per member. The k-th place is found by a limited sort on the executors, so no window runs over all
    members.
    """
    x, name = F.abs(F.col(value)), F.col(key)
    best = df.orderBy(x.desc_nulls_last(), name.asc_nulls_first()).limit(k).withColumn("_top", F.lit(True)).select(F.col(key).alias("_k"), "_top")
    marked = df.join(best, df[key].eqNullSafe(best["_k"]), "left")
    shown = F.when(F.col("_top"), name).otherwise(F.lit(other))
    return marked.groupBy(shown.alias(key), F.coalesce("_top", F.lit(False)).alias("is_top")).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("members"))


def run_sql(spark: SparkSession, text: str, limit: int = 100) -> DataFrame:
    """A single reading statement over registered tables; at most ``limit`` rows of its result."""
    return spark.sql(guard.read_only(spark, text)).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the greatest ``order``, of equals the greatest row. Combined before the shuffle, so hot keys don't pile up."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place", shards: int = 64) -> DataFrame:
    """The first k rows of each group in the given order, with their place.

    Each group is first cut to k within shards of its rows, so a hot group is never sorted in one task.
    """
    rest = [F.col(guard.quoted(c)) for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    shard = F.pmod(F.xxhash64(*rest), F.lit(shards)) if rest else F.lit(0)
    first = df.withColumn("_shard", shard).withColumn(place, F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(*order))).filter(F.col(place) <= k)
    return first.drop("_shard").withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= k)


def running_total(df: DataFrame, partition: list[str], order: str, value: str, name: str) -> DataFrame:
    """The value summed up to each row, by partition."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
