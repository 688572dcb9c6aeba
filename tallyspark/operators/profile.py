"""Table profiles: counts, moments, quantiles and frequent values of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.engine import types as semantics
from tallyspark.engine.guard import quoted
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators.relational import top_per_group

QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


#: Size of the quantile sketches (rank error below 0.1 %) and relative error of approximate distinct counts.
SKETCH_SIZE, DISTINCT_ERROR = 4000, 0.03


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: column_name, semantic_type, n_rows, n_null, null_share, n_distinct, mean, sd, min, max, p25 to p99, skewness, kurtosis.

    Counts and moments are one generated aggregate; quantiles and distinct counts, which would keep it from being
    generated, are aggregates of their own. Exact quantiles come from value counts in sorted ranges, so no task holds a
    column; with exact False they and the distinct counts are sketches, and nothing but sketches is shuffled. The choice is
    the caller's and doesn't depend on the table's size. Moments that aren't defined are null; figures of numbers are null
    for other types.
    """
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    numbers = [f for f in flat if isinstance(f.dataType, T.NumericType)]
    shares = F.array(*map(F.lit, QUANTILES))
    parts, places, distinct = [F.count(F.lit(1)).alias("n_rows")], [], []
    for k, f in enumerate(flat):
        c = F.col(quoted(f.name))
        parts.append(F.count(c).alias(f"filled{k}"))
        distinct.append((F.count_distinct(c) if exact else F.approx_count_distinct(c, DISTINCT_ERROR)).alias(f"distinct{k}"))
        if isinstance(f.dataType, T.NumericType):
            x = c.cast("double")
            parts += [F.avg(x).alias(f"mean{k}"), F.stddev_samp(x).alias(f"sd{k}"), F.min(x).alias(f"min{k}"), F.max(x).alias(f"max{k}"), semantics.sample_skewness(x).alias(f"skew{k}"), semantics.sample_kurtosis(x).alias(f"kurt{k}")]
            places += [] if exact else [F.kll_sketch_agg_double(x, SKETCH_SIZE).alias(f"q{k}")]
    row = df.agg(*parts)
    for more in (places, distinct):
        if more:
            row = row.withColumn("_s", df.agg(F.struct(*more)).scalar()).select("*", "_s.*").drop("_s")
    if not exact and places:  # a sketch per column is merged as bytes, and asked once at the end
        row = row.withColumns({f"q{k}": F.when(F.col(f"filled{k}") > 0, F.kll_sketch_get_quantile_double(f"q{k}", shares)) for k, f in enumerate(flat) if isinstance(f.dataType, T.NumericType)})
    none = F.lit(None).cast("double")
    lines = []
    for k, f in enumerate(flat):
        number = isinstance(f.dataType, T.NumericType)
        at = lambda name, k=k, number=number: F.col(f"{name}{k}").cast("double") if number else none
        lines.append(F.struct(
            F.lit(f.name).alias("column_name"), semantics.role_column(f, F.col("n_rows"), F.col(f"distinct{k}")).alias("semantic_type"), F.col("n_rows"), (F.col("n_rows") - F.col(f"filled{k}")).alias("n_null"),
            F.coalesce(F.try_divide(F.col("n_rows") - F.col(f"filled{k}"), F.col("n_rows")), F.lit(0.0)).alias("null_share"), F.col(f"distinct{k}").alias("n_distinct"),
            at("mean").alias("mean"), at("sd").alias("sd"), at("min").alias("min"), at("max").alias("max"),
            *[(F.get(F.col(f"q{k}"), F.lit(i)).cast("double") if number and not exact else none).alias(f"p{round(100 * q)}") for i, q in enumerate(QUANTILES)],
            at("skew").alias("skewness"), at("kurt").alias("kurtosis"),
        ))
    out = row.select(F.inline(F.array(*lines)))
    if not exact or not numbers:
        return out
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(quoted(f.name)).cast("double").alias("_x")) for f in numbers])))
    found = exact_quantiles(long, {"column_name": F.col("column_name")}, F.col("_x"), list(QUANTILES))
    named = [f"p{round(100 * q)}" for q in QUANTILES]
    with_q = out.join(found, "column_name", "left")
    return with_q.select(*[F.get("q", F.lit(named.index(c))).alias(c) if c in named else F.col(c) for c in out.columns])


def quality_score(profiled: DataFrame) -> DataFrame:
    """(score): 100 less 10 for each column with over 30 % nulls and 3 for each with 5 to 30 %, at least 20."""
    off = F.sum(F.when(F.col("null_share") > 0.3, 10).when(F.col("null_share") > 0.05, 3).otherwise(0))
    return profiled.agg(F.greatest(F.lit(20), 100 - F.coalesce(off, F.lit(0))).cast("long").alias("score"))


def top_values(df: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(column_name, value, n, place): the k most frequent non-null values of each column; of equals the least text.

    Counts are combined before the shuffle and cut per column in shards, so neither a frequent value nor a column of many
    values is a hot task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("value")) for c in names])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["column_name"], [F.col("n").desc(), F.col("value")], k)
