"""Semantic types of columns, and moments that need a sample correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER, TEMPORAL, CATEGORICAL, MEASURE, TEXT = "IDENTIFIER", "DIMENSION_TEMPORAL", "DIMENSION_CATEGORICAL", "MEASURE", "TEXT"
# Names that tell a role by themselves, and the limits between roles.
ID_NAMES = frozenset({"id", "uuid", "code", "guid", "pk"})
TIME_NAMES = frozenset({"date", "created_at", "updated_at", "time", "dt"})
FEW_NUMBERS, FEW_NUMBERS_FROM_ROWS = 10, 50
UNIQUE_SHARE, UNIQUE_FROM_ROWS, FEW_TEXTS, REPEATED_SHARE = 0.8, 100, 1000, 0.2
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def told_role(field: T.StructField) -> str | None:
    """The role that a column's name or type tells; None where its values decide."""
    name, kind = field.name.lower(), field.dataType
    by_name = IDENTIFIER if name in ID_NAMES or name.endswith("_id") else TEMPORAL if name in TIME_NAMES else None
    by_type = TEMPORAL if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else TEXT if isinstance(kind, _NESTED) else None
    if by_name or by_type:
        return by_name or by_type
    return None if isinstance(kind, T.NumericType | T.StringType) else CATEGORICAL


def role_column(field: T.StructField, rows: Column, distinct: Column) -> Column:
    """The role of a column from the counts of the whole table, which no order of rows changes."""
    told = told_role(field)
    if told:
        return F.lit(told)
    if isinstance(field.dataType, T.NumericType):
        coded = (distinct <= FEW_NUMBERS) & (rows > FEW_NUMBERS_FROM_ROWS)
        return F.when(coded, F.lit(CATEGORICAL)).otherwise(F.lit(MEASURE))
    share = F.try_divide(distinct, rows)
    names_rows, repeats = (share > UNIQUE_SHARE) & (rows > UNIQUE_FROM_ROWS), (distinct <= FEW_TEXTS) | (share < REPEATED_SHARE)
    return F.when(names_rows, F.lit(IDENTIFIER)).when(repeats, F.lit(CATEGORICAL)).otherwise(F.lit(TEXT))


#: Relative error of the distinct counts that roles are read from.
ROLE_ERROR = 0.02


def semantic_types(df: DataFrame) -> dict[str, str]:
    """The role of every column, from one aggregate over the whole table; only columns whose values decide are read."""
    open_ = [(k, f) for k, f in enumerate(df.schema.fields) if told_role(f) is None]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col(f"`{f.name}`"), ROLE_ERROR).alias(f"d{k}") for k, f in open_]) if open_ else df.sparkSession.range(1).select(F.lit(0).alias("n"))
    found = counts.select(F.array(*[role_column(f, F.col("n"), F.col(f"d{k}") if told_role(f) is None else F.lit(0)) for k, f in enumerate(df.schema.fields)])).first()[0] if df.columns else []
    return dict(zip(df.columns, found, strict=True))


def sample_skewness(c: Column | str) -> Column:
    """The bias-corrected skewness; null below 3 values and for constants."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.min(c) < F.max(c)), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column | str) -> Column:
    """The bias-corrected excess kurtosis; null below 4 values and for constants."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.min(c) < F.max(c)), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def finite(c: Column) -> Column:
    """Whether a number is neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def month_gap(later: Column, earlier: Column) -> Column:
    """Month boundaries between two dates."""
    return 12 * (F.year(later) - F.year(earlier)) + F.month(later) - F.month(earlier)


def period_start(grain: str, date: Column) -> Column:
    """The first day of the period that holds a date."""
    if grain not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"no grain {grain!r}")
    return date.cast("date") if grain == "day" else F.trunc(date, grain)
