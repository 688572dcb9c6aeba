"""Comparisons of a metric between calendar windows under explicit contracts.

A contract names the metric and the windows; everything that could make the comparison misleading is checked in one
aggregate before a number is returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.engine.types import finite, period_start
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators.relational import matching, top_with_remainder

KINDS = ("sum", "ratio", "distinct_count", "closing_balance")


class ContractError(ValueError):
    """The data or the request doesn't meet the contract."""


@dataclass(frozen=True)
class Metric:
    """What is measured. Entities are the keys of balances; numerator and denominator those of ratios."""

    kind: str
    column: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    entities: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ContractError(f"kinds are {KINDS}")
        if self.kind == "ratio" and not (self.numerator and self.denominator and not self.column):
            raise ContractError("a ratio has a numerator and a denominator only")
        if self.kind != "ratio" and not self.column:
            raise ContractError(f"{self.kind} needs a column")
        if self.kind == "closing_balance" and not 1 <= len(self.entities) <= 5:
            raise ContractError("a balance has 1 to 5 entity keys")

    @property
    def inputs(self) -> list[str]:
        return [c for c in (self.column, self.numerator, self.denominator) if c]


@dataclass(frozen=True)
class Windows:
    """Two windows [start, end) over a time column; zone is for aware timestamps, complete_until for watermarks."""

    column: str
    base_start: date
    base_end: date
    current_start: date
    current_end: date
    grain: str = "month"
    mode: str = "date"
    zone: str = "UTC"
    complete_until: date | None = None
    strict: bool = True
    aligned: bool = True
    equal_buckets: bool = True

    def __post_init__(self) -> None:
        if not (self.base_start < self.base_end <= self.current_start < self.current_end):
            raise ContractError("base_start < base_end <= current_start < current_end")
        if self.mode not in ("date", "aware_timestamp"):
            raise ContractError("mode is date or aware_timestamp")
        if self.strict and (self.complete_until is None or self.complete_until < self.current_end):
            raise ContractError("the current window isn't known to be complete")
        if self.equal_buckets and self.buckets(self.base_start, self.base_end) != self.buckets(self.current_start, self.current_end):
            raise ContractError("the windows hold unequal numbers of buckets")
        if self.aligned and any(d != self.floor(d) for d in (self.base_start, self.base_end, self.current_start, self.current_end)):
            raise ContractError(f"the windows don't begin and end with a {self.grain}")

    def floor(self, d: date) -> date:
        if self.grain == "week":
            return date.fromordinal(d.toordinal() - d.weekday())
        return {"day": d, "month": d.replace(day=1), "quarter": date(d.year, (d.month - 1) // 3 * 3 + 1, 1), "year": date(d.year, 1, 1)}[self.grain]

    def buckets(self, start: date, end: date) -> int:
        a, b = self.floor(start), self.floor(date.fromordinal(end.toordinal() - 1))
        if self.grain in ("day", "week"):
            return (b - a).days // (1 if self.grain == "day" else 7) + 1
        return ((b.year - a.year) * 12 + b.month - a.month) // {"month": 1, "quarter": 3, "year": 12}[self.grain] + 1


@dataclass(frozen=True)
class Frame:
    """Rows tagged with _date, _at, _period (base, current) and _valid."""

    rows: DataFrame
    metric: Metric
    windows: Windows


def tagged(df: DataFrame, metric: Metric, windows: Windows, filters: dict[str, str] | None = None, invalid: str = "reject") -> Frame:
    """The rows of both windows. Unreadable metric values or dates are an error, or left out with invalid='exclude'."""
    columns(df, [*metric.inputs, *metric.entities, windows.column])
    if len(filters or {}) > 8:
        raise ContractError("at most 8 filters")
    rows = matching(df, filters or {})
    c = F.col(quoted(windows.column))
    if windows.mode == "date":
        at = c.try_cast("timestamp_ntz")
    else:
        zoned = c.cast("string").rlike(r"(?i)(z|[+-]\d{2}:?\d{2})\s*$")
        at = F.when(zoned, F.from_utc_timestamp(F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()), windows.zone).cast("timestamp_ntz"))
    rows = rows.withColumn("_at", at).withColumn("_date", F.to_date("_at"))
    inside = lambda a, b: (F.col("_date") >= F.lit(a)) & (F.col("_date") < F.lit(b))
    rows = rows.withColumn("_period", F.when(inside(windows.base_start, windows.base_end), "base").when(inside(windows.current_start, windows.current_end), "current"))
    value = lambda n: F.col(quoted(n)).isNotNull() if metric.kind == "distinct_count" else finite(F.col(quoted(n)).try_cast("double"))
    valid = F.lit(True)
    for n in metric.inputs:
        valid = valid & value(n)
    for n in metric.entities:
        valid = valid & F.col(quoted(n)).isNotNull()
    rows = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    counts = rows.agg(F.count_if(F.col("_date").isNull()).alias("undated"), F.count_if(F.col("_period").isNotNull() & ~F.col("_valid")).alias("invalid"), F.count_if(F.col("_valid") & (F.col("_period") == "base")).alias("base"), F.count_if(F.col("_valid") & (F.col("_period") == "current")).alias("current")).first()
    if invalid == "reject" and (counts.undated or counts.invalid):
        raise ContractError(f"{counts.undated} rows without a date and {counts.invalid} with an unreadable value")
    if not counts.base or not counts.current:
        raise ContractError("a window has no rows")
    kept = rows.filter("_period is not null and _valid")
    if metric.kind == "closing_balance":
        keys = [F.col(quoted(e)) for e in metric.entities]
        if kept.groupBy("_period", *keys, "_at").count().filter("count > 1").limit(1).count():
            raise ContractError("two balances of one entity at one time")
    return Frame(kept, metric, windows)


def _measured(frame: Frame, keys: list[Column | str]) -> DataFrame:
    """The metric per key; balances are each entity's last row per key."""
    m, rows = frame.metric, frame.rows
    x = lambda n: F.col(quoted(n)).try_cast("double")
    if m.kind == "closing_balance":
        last = rows.groupBy(*keys, *[F.col(quoted(e)) for e in m.entities]).agg(F.max_by(x(m.column), "_at").alias("_last"))
        return last.groupBy(*[k if isinstance(k, str) else k for k in keys]).agg(F.sum("_last").alias("value"), F.count(F.lit(1)).alias("rows_used"))
    value = {"sum": lambda: F.sum(x(m.column)), "distinct_count": lambda: F.count_distinct(F.col(quoted(m.column))).cast("double"), "ratio": lambda: F.try_divide(F.sum(x(m.numerator)), F.sum(x(m.denominator)))}[m.kind]()
    return rows.groupBy(*keys).agg(value.alias("value"), F.count(F.lit(1)).alias("rows_used"))


def compare(frame: Frame) -> DataFrame:
    """(base, current, delta, change_pct, base_rows, current_rows): null where a value or the base doesn't allow it."""
    return _ends(_measured(frame, ["_period"]), [])


def _ends(v: DataFrame, keys: list[str]) -> DataFrame:
    """Both periods' values side by side, per key."""
    pick = lambda p, c: F.max(F.when(F.col("_period") == p, F.col(c)))
    out = v.groupBy(*keys).agg(pick("base", "value").alias("base"), pick("current", "value").alias("current"), pick("base", "rows_used").alias("base_rows"), pick("current", "rows_used").alias("current_rows"))
    return out.withColumn("delta", F.col("current") - F.col("base")).withColumn("change_pct", F.try_divide(F.col("delta") * 100, F.abs("base")))


def series(frame: Frame) -> DataFrame:
    """(period, bucket, value): every bucket of both windows; one without rows is null."""
    w, spark = frame.windows, frame.rows.sparkSession
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[w.grain]
    spine = None
    for p, a, b in (("base", w.base_start, w.base_end), ("current", w.current_start, w.current_end)):
        part = spark.range(1).select(F.lit(p).alias("_period"), F.explode(F.sequence(F.lit(w.floor(a)), F.lit(w.floor(date.fromordinal(b.toordinal() - 1))), F.expr(step))).alias("bucket"))
        spine = part if spine is None else spine.unionByName(part)
    tagged_ = Frame(frame.rows.withColumn("bucket", period_start(w.grain, F.col("_date"))), frame.metric, w)
    return spine.join(_measured(tagged_, ["_period", "bucket"]), ["_period", "bucket"], "left").select(F.col("_period").alias("period"), "bucket", "value")


def decompose_dimension(frame: Frame, dimension: str, k: int = 50) -> DataFrame:
    """(member, is_top, diff, members): member changes of a sum; those beyond k are one row, so the rows add up."""
    if frame.metric.kind != "sum":
        raise ContractError("only sums are decomposed by dimension")
    x = F.col(quoted(frame.metric.column)).try_cast("double")
    sign = F.when(F.col("_period") == "base", -x).otherwise(x)
    return top_with_remainder(frame.rows.groupBy(F.col(quoted(dimension)).cast("string").alias("member")).agg(F.sum(sign).alias("diff")), "member", "diff", k)


def decompose_ratio(frame: Frame) -> DataFrame:
    """(numerator_effect, denominator_effect, delta): midpoint effects of a ratio's parts."""
    m = frame.metric
    if m.kind != "ratio":
        raise ContractError("only ratios have a numerator and a denominator")
    s = lambda n, p: F.sum(F.when(F.col("_period") == p, F.col(quoted(n)).try_cast("double")))
    v = frame.rows.agg(s(m.numerator, "base").alias("a0"), s(m.numerator, "current").alias("a1"), s(m.denominator, "base").alias("b0"), s(m.denominator, "current").alias("b1"))
    if v.filter("b0 = 0 or b1 = 0").count():
        raise ContractError("a denominator is zero")
    return v.select(((F.col("a1") - F.col("a0")) * (1 / F.col("b0") + 1 / F.col("b1")) / 2).alias("numerator_effect"), ((F.col("a0") + F.col("a1")) / 2 * (1 / F.col("b1") - 1 / F.col("b0"))).alias("denominator_effect"), (F.col("a1") / F.col("b1") - F.col("a0") / F.col("b0")).alias("delta"))


def flagged(frame: Frame, column: str, method: str = "mad", threshold: float | None = None, reference: str = "base", cohort: str | None = None) -> DataFrame:
    """The frame's rows with _score and _flag: how far a value lies from its reference; without spread it isn't scored."""
    limit = threshold or {"zscore": 3.0, "iqr": 1.5, "mad": 3.5}[method]
    x = F.col(quoted(column)).try_cast("double")
    rows = frame.rows.withColumns({"_x": x, "_cohort": F.col(quoted(cohort)).cast("string") if cohort else F.lit("all")})
    ref = rows.filter("_period = 'base'") if reference == "base" else rows
    if method == "zscore":
        stats = ref.groupBy("_cohort").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
        score = lambda: F.abs(F.col("_x") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    elif method == "iqr":
        q = exact_quantiles(ref, {"_cohort": F.col("_cohort")}, F.col("_x"), [0.25, 0.75])
        stats = q.select("_cohort", F.col("q")[0].alias("_m"), F.col("q")[1].alias("_h"), (F.col("q")[1] - F.col("q")[0]).alias("_s"))
        score = lambda: F.greatest(F.col("_m") - F.col("_x"), F.col("_x") - F.col("_h"), F.lit(0.0)) / F.nullif(F.col("_s"), F.lit(0.0))
    elif method == "mad":
        mid = exact_quantiles(ref, {"_cohort": F.col("_cohort")}, F.col("_x"), [0.5]).select(F.col("_cohort").alias("_c"), F.col("q")[0].alias("_m"))
        far = exact_quantiles(ref.join(mid, F.col("_cohort").eqNullSafe(F.col("_c"))), {"_cohort": F.col("_cohort")}, F.abs(F.col("_x") - F.col("_m")), [0.5])
        stats = far.join(mid, F.col("_cohort").eqNullSafe(F.col("_c"))).select("_cohort", "_m", F.col("q")[0].alias("_s"))
        score = lambda: 0.67449 * F.abs(F.col("_x") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    else:
        raise ContractError("methods are zscore, iqr and mad")
    stats = stats.withColumnRenamed("_cohort", "_c")
    scored = rows.join(stats, F.col("_cohort").eqNullSafe(F.col("_c")), "left").withColumn("_score", score())
    hit = F.col("_score") > limit if method == "iqr" else F.col("_score") >= limit
    return scored.withColumn("_flag", F.coalesce(hit, F.lit(False))).drop("_c", "_m", "_s", "_h", "_cohort", "_x")


def sensitivity(frame: Frame, column: str, method: str = "mad", threshold: float | None = None, reference: str = "base", cohort: str | None = None, entity: str | None = None) -> DataFrame:
    """compare() with all rows and without flagged rows, or without all rows of flagged entities: (scenario, ...).

    Both scenarios are measured in one pass; a scenario or window without rows has nulls.
    """
    rows = flagged(frame, column, method, threshold, reference, cohort)
    out = F.col("_flag")
    if entity:
        bad = rows.filter("_flag").select(F.col(quoted(entity)).alias("_e")).distinct().withColumn("_bad", F.lit(True))
        rows, out = rows.join(bad, F.col(quoted(entity)).eqNullSafe(F.col("_e")), "left"), F.coalesce("_bad", F.lit(False))
    names = F.array(F.lit("all"), F.lit("reviewed"))
    both = rows.withColumn("scenario", F.explode(F.when(out, F.slice(names, 1, 1)).otherwise(names)))
    found = _ends(_measured(Frame(both, frame.metric, frame.windows), ["scenario", "_period"]), ["scenario"])
    return rows.sparkSession.createDataFrame([("all",), ("reviewed",)], "scenario string").join(found, "scenario", "left")
