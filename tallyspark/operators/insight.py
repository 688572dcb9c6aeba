"""Outliers, trends and concentration, and the search for findings over a whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine import types as semantics
from tallyspark.engine.guard import columns, quoted
from tallyspark.functions import tails
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators import stats


def outliers(df: DataFrame, column: str, method: str = "z_score", threshold: float = 3.0, k: int = 50) -> tuple[int, DataFrame]:
    """(how many rows lie outside, the k farthest with score); iqr uses 1.5 quartile ranges whatever the threshold."""
    columns(df, [column])
    x = F.col(quoted(column)).try_cast("double")
    if method == "z_score":
        m = df.select(x.alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
        score = F.abs(x - F.lit(m[0])) / F.lit(m[1] or 1.0) if m[0] is not None else F.lit(None).cast("double")
        hit = score >= threshold
    elif method == "iqr":
        q = next((r.q for r in exact_quantiles(df, {}, x, [0.25, 0.75]).collect()), [None, None])
        if q[0] is None:
            score = F.lit(None).cast("double")
        else:
            reach = 1.5 * (q[1] - q[0])
            score = F.greatest(F.lit(q[0] - reach) - x, x - F.lit(q[1] + reach))
        hit = score > 0
    else:
        raise ValueError("methods are z_score and iqr; isolation forests are isolation_forest()")
    rows = df.withColumn("score", score).filter(hit)
    return rows.count(), rows.orderBy(F.col("score").desc(), *[F.col(quoted(c)).asc_nulls_last() for c, t in df.dtypes if not t.startswith("map")]).limit(k)


def isolation_forest(df: DataFrame, names: list[str], contamination: float = 0.01, trees: int = 100, sample: int = 256, seed: int = 42, fit_rows: int = 20_000) -> DataFrame:
    """The frame with score and is_outlier: short paths in random trees are outliers.

    Trees are grown on a bounded sample (fit_rows, the rows of least hash); every row is scored on the executors, and the
    threshold is a quantile of all scores. Rows with a null have neither.
    """
    columns(df, names)
    complete = df.select(*[F.col(quoted(c)).try_cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    h, n, drawn = F.xxhash64(*complete.columns), complete.count(), complete
    if n > 2 * fit_rows:  # only rows of small hash are sorted, so that no task merges fit_rows rows of every partition
        near = complete.filter(h < F.lit(int(-(1 << 63) + (1 << 64) * (2 * fit_rows / n))))
        drawn = near if near.count() >= fit_rows else complete
    data = drawn.orderBy(h).limit(fit_rows).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int) -> tuple:
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth == 0 or len(rows) <= 1 or not len(wide):
            return (len(rows),)
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] < cut
        return f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    size = min(sample, len(data))
    forest = [grow(data[rng.choice(len(data), size, replace=False)], math.ceil(math.log2(max(2, size)))) for _ in range(trees)] if size else []
    usual = lambda n: 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
    norm = usual(size) or 1.0

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        rows = x.to_numpy(float)
        depth = np.zeros(len(rows))

        def walk(node: tuple, at: np.ndarray, d: int) -> None:
            if len(node) == 1:
                depth[at] += d + usual(node[0])
                return
            left = rows[at, node[0]] < node[1]
            if left.any():
                walk(node[2], at[left], d + 1)
            if (~left).any():
                walk(node[3], at[~left], d + 1)

        whole = np.flatnonzero(~np.isnan(rows).any(axis=1))
        for tree in forest:
            walk(tree, whole, 0)
        out = np.full(len(rows), np.nan)
        out[whole] = 2.0 ** (-depth[whole] / max(1, len(forest)) / norm)
        return pd.Series(out)

    with_score = df.withColumn("score", F.nanvl(scored(F.struct(*[F.col(quoted(c)).try_cast("double").alias(c) for c in names])), F.lit(None)))
    limit = with_score.agg(F.percentile_approx("score", 1 - contamination, 10_000)).first()[0]
    return with_score.withColumn("is_outlier", F.col("score") > F.lit(limit))


def trend(df: DataFrame, time: str, value: str, group: str | None = None) -> DataFrame:
    """(group, n, slope, r2, p, direction, significant, change_point): the sum per time against its place in order.

    change_point is the first time of the second half where the halves' slopes differ in sign and by over 0.1. Times are
    aggregated before they are ordered; each group is fitted apart.
    """
    g = F.col(quoted(group)).cast("string") if group else F.lit("all")
    sums = df.filter(F.col(quoted(time)).isNotNull()).groupBy(g.alias("group"), F.col(quoted(time)).alias("t")).agg(F.sum(F.col(quoted(value)).try_cast("double")).alias("y")).filter("y is not null")
    w = Window.partitionBy("group").orderBy("t")
    rows = sums.withColumns({"x": (F.row_number().over(w) - 1).cast("double"), "n": F.count(F.lit(1)).over(Window.partitionBy("group"))}).withColumn("late", F.col("x") >= F.floor(F.col("n") / 2))
    slope = lambda cond: F.regr_slope(F.when(cond, F.col("y")), F.when(cond, F.col("x")))
    out = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), slope(~F.col("late")).alias("early"), slope(F.col("late")).alias("later"), F.min(F.when(F.col("late"), F.col("t"))).cast("string").alias("mid"))

    @F.pandas_udf("double")
    def p_value(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1.0 if pd.isna(r) or m < 3 else 0.0 if r >= 1 else tails.f_tail(r * (m - 2) / (1 - r), 1, m - 2) for r, m in zip(r2, n, strict=True)])

    out = out.withColumn("p", p_value("r2", "n"))
    turned = (F.signum("early") * F.signum("later") < 0) & (F.abs(F.col("later") - F.col("early")) > 0.1)
    return out.select("group", "n", "slope", "r2", "p", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat").alias("direction"), ((F.col("p") < 0.05) & (F.col("r2") >= 0.01)).alias("significant"), F.when(turned, F.col("mid")).alias("change_point"))


def dominance(df: DataFrame, category: str, value: str, k: int = 3) -> DataFrame:
    """(categories, total, gini, top_share, pareto_80): concentration of the positive sums of categories."""
    sums = df.groupBy(F.col(quoted(category)).cast("string").alias("c")).agg(F.sum(F.col(quoted(value)).try_cast("double")).alias("v")).filter("v > 0")
    ranked = stats.ranks(sums.select(F.col("v").alias("value")))  # value counts, so equal sums share a place
    n = F.sum("n")
    # of the ordered sums, a tied value of n members takes places before + 1 to before + n
    weighted = F.sum(F.col("value") * F.col("n") * (F.col("before") + (F.col("n") + 1) / 2))
    base = ranked.agg(F.coalesce(n, F.lit(0)).alias("categories"), F.sum(F.col("value") * F.col("n")).alias("total"), weighted.alias("weighted"))
    above = ranked.withColumns({c: base.select(c).scalar() for c in ("categories", "total")}).withColumn("from_top", F.col("categories") - F.col("before") - F.col("n"))
    top = above.agg(F.sum(F.col("value") * F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("from_top")))).alias("top"))
    # of n tied values, those before the running sum from the top reaches four fifths
    goal = F.col("total") * 0.8 - (F.col("total") - F.col("sum_before") - F.col("value") * F.col("n"))
    short = F.least(F.greatest(F.ceil(goal / F.col("value")) - 1, F.lit(0)), F.col("n"))
    pareto = above.agg((F.coalesce(F.sum(short), F.lit(0)) + 1).alias("pareto_80"))
    gini = (2 * F.col("weighted") / F.nullif(F.col("categories") * F.col("total"), F.lit(0.0))) - (F.col("categories") + 1) / F.nullif(F.col("categories"), F.lit(0))
    return base.withColumns({"top": top.scalar(), "pareto_80": pareto.scalar()}).select("categories", "total", F.coalesce(gini, F.lit(0.0)).alias("gini"), F.coalesce(F.try_divide("top", "total"), F.lit(0.0)).alias("top_share"), F.when(F.col("categories") > 0, F.col("pareto_80")).otherwise(0).alias("pareto_80"))


SEVERITY = {"anomaly": 3, "correlation": 2, "trend": 2, "dominance": 1}


def discover(df: DataFrame, ranker: Callable[[list[dict]], list[dict]] | None = None) -> dict:
    """Findings over at most 5 measures, 3 categories and 1 time column, ordered by severity or by ``ranker``, and a graph of shared columns."""
    roles = semantics.semantic_types(df)
    pick = lambda role, n: [c for c, r in roles.items() if r == role][:n]
    measures, categories, times = pick(semantics.MEASURE, 5), pick(semantics.CATEGORICAL, 3), pick(semantics.TEMPORAL, 1)
    found: list[dict] = []
    for m in measures:
        n, _ = outliers(df, m)
        if n:
            found.append({"kind": "anomaly", "columns": [m], "strength": n, "text": f"{n} rows of {m} lie at least 3 deviations from the mean"})
    if len(measures) > 1:
        for r in stats.correlation(df, measures).filter("high and significant").collect():
            found.append({"kind": "correlation", "columns": [r.a, r.b], "strength": abs(r.r), "text": f"{r.a} and {r.b} correlate at {r.r:.2f}"})
    for c in categories:
        for m in measures[:1]:
            r = dominance(df, c, m).first()
            if r.gini >= 0.4 or (r.top_share >= 0.6 and r.categories > 5):
                found.append({"kind": "dominance", "columns": [c, m], "strength": r.gini, "text": f"the three largest {c} hold {r.top_share:.0%} of {m}"})
    for t in times:
        for m in measures:
            r = trend(df, t, m).first()
            if r and r.significant:
                found.append({"kind": "trend", "columns": [t, m], "strength": r.r2, "text": f"{m} goes {r.direction} over {t}"})
    found = ranker(found) if ranker else sorted(found, key=lambda x: (-SEVERITY[x["kind"]], -x["strength"], x["text"]))
    edges = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if set(found[i]["columns"]) & set(found[j]["columns"])]
    return {"insights": found, "graph": {"nodes": list(range(len(found))), "edges": edges}}
