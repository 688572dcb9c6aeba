"""Assertions over tables in one scan, schema comparison, and a health score of analysis contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.operators.schema_drift import canonical_type


@dataclass(frozen=True)
class Assertion:
    """not_null, unique, between (low, high) or row_count (low, high); for unique, nulls may count as repeats."""

    rule: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    nulls_repeat: bool = True


def run_suite(df: DataFrame, suite: list[Assertion]) -> DataFrame:
    """(place, rule, column_name, failures, passed) for each assertion, from one aggregate; an unknown rule fails."""
    columns(df, [a.column for a in suite if a.column])
    parts, rows = [F.count(F.lit(1)).alias("n")], []
    for k, a in enumerate(suite):
        c = F.col(quoted(a.column)) if a.column else F.lit(1)
        if a.rule == "not_null":
            parts.append(F.count_if(c.isNull()).alias(f"x{k}"))
        elif a.rule == "unique":
            parts.append(((F.count(F.lit(1)) if a.nulls_repeat else F.count(c)) - F.count_distinct(c)).alias(f"x{k}"))
        elif a.rule == "between":
            low = c < a.low if a.low is not None else F.lit(False)
            high = c > a.high if a.high is not None else F.lit(False)
            parts.append(F.count_if(low | high).alias(f"x{k}"))
        elif a.rule == "row_count":
            n = F.count(F.lit(1))
            parts.append(F.when((n >= (a.low or 0)) & ((n <= a.high) if a.high is not None else F.lit(True)), 0).otherwise(1).cast("long").alias(f"x{k}"))
        else:
            parts.append(F.lit(1).cast("long").alias(f"x{k}"))
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(a.rule).alias("rule"), F.lit(a.column or "*").alias("column_name"), F.col(f"x{k}").alias("failures"), (F.col(f"x{k}") == 0).alias("passed")))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def schema_drift(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(kind, column, expected type, found type) for columns that are added, removed or of another type."""
    found = {n: canonical_type(t) for n, t in df.dtypes}
    wanted = {n: canonical_type(t) for n, t in expected.items()}
    out = [("removed", n, t, "") for n, t in wanted.items() if n not in found]
    out += [("added", n, "", t) for n, t in found.items() if n not in wanted]
    out += [("retyped", n, t, found[n]) for n, t in wanted.items() if n in found and found[n] != t]
    return sorted(out)


def context_health(steps: list[dict], tables: dict[str, str], metrics: list[str], guides: list[str]) -> dict:
    """A score from 0 to 100 of how well an analysis is grounded, and why.

    steps have operator, tables, governed, warnings and null_share; tables map names to endorsement.
    """
    reasons, score = [], 100.0

    def less(points: float, why: str) -> None:
        nonlocal score
        if points > 0:
            score -= points
            reasons.append(why)

    used = sorted({t for s in steps for t in s.get("tables", [])})
    open_ = [t for t in used if tables.get(t) != "endorsed"]
    less(20 * len(open_) / len(used) if used else 0, f"not endorsed: {open_}")
    less(0 if metrics else 15, "no metric is defined")
    less(0 if guides else 10, "no guide is registered")
    share = lambda f: sum(map(bool, map(f, steps))) / len(steps) if steps else 0
    less(25 * share(lambda s: s.get("operator") == "sql" and not s.get("governed")), "ungoverned SQL")
    less(15 * share(lambda s: s.get("warnings")), "steps with warnings")
    less(15 * share(lambda s: (s.get("null_share") or 0) > 0.2), "steps that dropped many nulls")
    return {"score": max(0.0, round(score, 2)), "reasons": reasons}
