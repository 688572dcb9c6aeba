"""Clusters, customer segments and forecasts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.engine.shared import durable
from tallyspark.functions.quantiles import exact_quantiles

#: Buckets of one series that a forecast reads on the driver.
MAX_BUCKETS = 100_000


def kmeans(df: DataFrame, names: list[str], k: int | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    """(the complete rows with ``cluster``, {k, silhouette, profiles}): standardised, k from 2 to 6 by silhouette unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    columns(df, names)
    rows = df.dropna(subset=names)
    if rows.limit(10).count() < 10:
        raise ValueError("clustering needs 10 complete rows")
    flat = VectorAssembler(inputCols=names, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(flat).transform(flat).persist()
    try:
        best = None
        for n in [k] if k else range(2, 7):
            out = KMeans(featuresCol="_x", predictionCol="cluster", k=n, seed=seed).fit(scaled).transform(scaled)
            score = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(out) if out.select("cluster").distinct().limit(2).count() > 1 else -1.0
            if best is None or score > best[0]:
                best = score, n, out
        score, n, out = best
        profiles = [r.asDict() for r in out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(c) for c in names]).orderBy("cluster").collect()]
    finally:
        scaled.unpersist()
    return out.drop("_raw", "_x"), {"k": n, "silhouette": score, "profiles": profiles}


def rfm(df: DataFrame, customer: str, day: str, order: str, amount: str, as_of: str) -> DataFrame:
    """(customer, recency, frequency, monetary, r, f, m, segment): scores by quartiles over customers.

    r is 5 less the quartiles at most as large as the recency (2 to 5); f and m count quartiles below, plus one (1 to 4).
    """
    per = df.filter(F.col(quoted(customer)).isNotNull()).groupBy(F.col(quoted(customer)).alias("customer")).agg(
        F.datediff(F.lit(as_of).cast("date"), F.max(F.col(quoted(day)).try_cast("date"))).alias("recency"), F.count_distinct(F.col(quoted(order))).alias("frequency"), F.sum(F.col(quoted(amount)).try_cast("double")).alias("monetary")
    )
    per = durable(per)
    q = {f"q_{c}": exact_quantiles(per, {}, F.col(c).cast("double"), [0.25, 0.5, 0.75]).scalar() for c in ("recency", "frequency", "monetary")}
    below = lambda c, op: sum((F.when(op(F.col(f"q_{c}")[i], F.col(c)), 1).otherwise(0) for i in range(3)), F.lit(0))
    both = per.withColumns(q)
    scored = both.select("customer", "recency", "frequency", "monetary", (5 - below("recency", lambda a, x: a <= x)).alias("r"), (1 + below("frequency", lambda a, x: a <= x)).alias("f"), (1 + below("monetary", lambda a, x: a <= x)).alias("m"))
    segment = (
        F.when((F.col("r") >= 4) & (F.col("f") >= 3) & (F.col("m") >= 3), "champions").when((F.col("r") >= 3) & (F.col("f") >= 3), "loyal").when((F.col("r") <= 3) & (F.col("m") >= 3), "at_risk").when(F.col("r") >= 4, "recent").otherwise("others")
    )
    return scored.withColumn("segment", segment)


def calendar(df: DataFrame, time: str, value: str) -> dict:
    """The sums per day or month with gaps as 0: {grain, season, labels, values, missing}.

    Times are summed first; only buckets (at most MAX_BUCKETS, checked) reach the driver. The grain is told from the
    median step: 0.8 to 1.5 days, 27 to 32 days, otherwise irregular; over a fifth of unreadable times is no calendar.
    """
    at = F.coalesce(F.col(quoted(time)).try_cast("date"), F.concat(F.col(quoted(time)).cast("string"), F.lit("-01")).try_cast("date"))
    sums = df.groupBy(F.col(quoted(time)).cast("string").alias("label"), at.alias("d")).agg(F.sum(F.col(quoted(value)).try_cast("double")).alias("v")).limit(MAX_BUCKETS + 1).collect()
    if len(sums) > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    dated = sorted((r.d, r.v or 0.0) for r in sums if r.d is not None)
    if len(dated) < 0.8 * len(sums) or len(dated) < 2:
        rest = sorted((r.label or "", r.v or 0.0) for r in sums)
        return {"grain": "not_a_date", "season": None, "labels": [x for x, _ in rest], "values": [v for _, v in rest], "missing": 0}
    step = float(np.median([(b[0] - a[0]).days for a, b in zip(dated, dated[1:], strict=False)]))
    by: dict = {}
    if 27 <= step <= 32:
        for d, v in dated:
            by[d.replace(day=1)] = by.get(d.replace(day=1), 0.0) + v
        first, last = min(by), max(by)
        n = (last.year - first.year) * 12 + last.month - first.month + 1
        labels = [first.replace(year=first.year + (first.month - 1 + i) // 12, month=(first.month - 1 + i) % 12 + 1) for i in range(n)]
        grain, season = "month", 12
    elif 0.8 <= step <= 1.5:
        for d, v in dated:
            by[d] = by.get(d, 0.0) + v
        labels = [type(dated[0][0]).fromordinal(k) for k in range(min(by).toordinal(), max(by).toordinal() + 1)]
        grain, season = "day", 7
    else:
        return {"grain": "irregular", "season": None, "labels": [str(d) for d, _ in dated], "values": [v for _, v in dated], "missing": 0}
    return {"grain": grain, "season": season, "labels": [str(d) for d in labels], "values": [by.get(d, 0.0) for d in labels], "missing": sum(d not in by for d in labels)}


def holt(y: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """(forecast, residual deviation) of exponential smoothing with an additive trend, its two rates by grid search."""
    best = None
    for a in np.linspace(0.05, 0.95, 19):
        for b in np.linspace(0.0, 0.95, 20):
            level, slope, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                e = v - level - slope
                sse += e * e
                level, slope = level + slope + a * e, slope + a * b * e
            if best is None or sse < best[0]:
                best = sse, level, slope
    sse, level, slope = best
    return level + slope * np.arange(1, steps + 1), math.sqrt(sse / max(1, len(y) - 1))


def arima(y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(forecast, deviation per step) of ARIMA(1,1,1) by conditional sum of squares."""
    d = np.diff(y)

    def errors(phi: float, theta: float) -> np.ndarray:
        e = np.zeros(len(d))
        for t in range(1, len(d)):
            e[t] = d[t] - phi * d[t - 1] - theta * e[t - 1]
        return e

    grid = [(p, q) for p in np.linspace(-0.95, 0.95, 20) for q in np.linspace(-0.95, 0.95, 20)]
    phi, theta = min(grid, key=lambda x: float((errors(*x) ** 2).sum()))
    for width in (0.05, 0.01, 0.002):
        near = [(np.clip(phi + i * width, -0.99, 0.99), np.clip(theta + j * width, -0.99, 0.99)) for i in range(-3, 4) for j in range(-3, 4)]
        phi, theta = min(near, key=lambda x: float((errors(*x) ** 2).sum()))
    e = errors(phi, theta)
    sigma = math.sqrt(float((e[1:] ** 2).mean()))
    out, last, diff = [], y[-1], phi * d[-1] + theta * e[-1]
    for _ in range(steps):
        last += diff
        out.append(last)
        diff *= phi
    psi, weights = 1.0, [1.0]
    for k in range(1, steps):
        psi += (phi + theta) * phi ** (k - 1)
        weights.append(psi)
    return np.array(out), sigma * np.sqrt(np.cumsum(np.square(weights)))


def forecast(df: DataFrame, time: str, value: str, steps: int = 6, method: str = "arima") -> dict:
    """The calendar's next buckets with 95 % limits, and how the method does on the last fifth against naive ones."""
    series = calendar(df, time, value)
    y = np.array(series["values"], float)
    if len(y) < 10:
        raise ValueError("a forecast needs 10 buckets")
    if method not in ("arima", "holt"):
        raise ValueError("methods are arima and holt")

    def run(history: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if method == "arima":
            return arima(history, n)
        mean, sd = holt(history, n)
        return mean, sd * np.sqrt(np.arange(1, n + 1))

    mean, sd = run(y, steps)
    cut = max(1, len(y) // 5)
    train, test = y[:-cut], y[-cut:]
    mape = lambda guess: float(np.mean(np.abs((test - guess) / test)[test != 0]) * 100) if (test != 0).any() else None
    holdout = {"method": mape(run(train, cut)[0]) if len(train) >= 4 else None, "naive": mape(np.full(cut, train[-1]))}
    if series["season"] and len(train) >= series["season"]:
        holdout["seasonal_naive"] = mape(np.array([train[len(train) - series["season"] + i % series["season"]] for i in range(cut)]))
    return {**{k: series[k] for k in ("grain", "season", "missing")}, "method": method, "forecast": mean.tolist(), "low": (mean - 1.959964 * sd).tolist(), "high": (mean + 1.959964 * sd).tolist(), "holdout_mape": holdout}
