"""Statistical tests and regressions from sums that executors make; only sufficient statistics reach the driver."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.engine.shared import durable
from tallyspark.functions import tails
from tallyspark.functions.quantiles import exact_quantiles

#: Groups of a test, cells of a cross table, and regressors at most: their statistics are finished on the driver.
MAX_GROUPS, MAX_CELLS, MAX_REGRESSORS = 10_000, 200_000, 40


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Complete rows of the named columns as doubles x0, x1, ..."""
    columns(df, names)
    rows = df.select(*[F.col(quoted(c)).try_cast("double").alias(f"x{k}") for k, c in enumerate(names)]).dropna()
    for k in range(len(names)):
        rows = rows.filter(~F.isnan(f"x{k}"))
    return rows


def pair_sums(rows: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """n, the sums s<i> and the products p<i>_<j> of x0 to x<k-1>, in one scan."""
    parts = [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)]]
    parts += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy(*keys).agg(*parts)


def _centred(rows: DataFrame, k: int) -> DataFrame:
    """Columns less their means, which keeps products of large numbers exact enough."""
    means = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).first()
    return rows.select(*[(F.col(f"x{i}") - F.lit(means[f"m{i}"] or 0.0)).alias(f"x{i}") for i in range(k)])


def _r(row, i: int, j: int) -> tuple[float, float]:
    n = row["n"]
    if n < 3:
        return 0.0, 1.0
    sxy = row[f"p{i}_{j}"] - row[f"s{i}"] * row[f"s{j}"] / n
    sxx, syy = row[f"p{i}_{i}"] - row[f"s{i}"] ** 2 / n, row[f"p{j}_{j}"] - row[f"s{j}"] ** 2 / n
    if sxx <= 1e-300 or syy <= 1e-300:
        return 0.0, 1.0
    r = max(-1.0, min(1.0, sxy / math.sqrt(sxx * syy)))
    if abs(r) >= 0.999999:
        return r, 0.0
    return r, tails.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation(df: DataFrame, names: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, n, r, p, q, high, significant) of every pair over complete rows; q is the Benjamini-Hochberg value.

    spearman ranks with ties sharing the least rank; ranks come from value counts, so no window runs over all rows.
    """
    rows = _numbers(df, names)
    if method == "spearman":
        rows = rank_columns(rows, len(names))
    elif method != "pearson":
        raise ValueError("methods are pearson and spearman")
    sums = pair_sums(_centred(rows, len(names)), len(names)).first()
    pairs = list(combinations(range(len(names)), 2))
    found = [_r(sums, i, j) for i, j in pairs]
    q = tails.benjamini_hochberg([p for _, p in found])
    out = [(names[i], names[j], sums["n"], r, p, v, abs(r) >= 0.7, v < 0.05 and abs(r) >= 0.1) for (i, j), (r, p), v in zip(pairs, found, q, strict=True)]
    return df.sparkSession.createDataFrame(out, "a string, b string, n long, r double, p double, q double, high boolean, significant boolean")


def ranks(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, n, before, sum_before): distinct values, their counts, and how many rows, and what sum, lie before them.

    The running figures are taken inside range partitions and offset by those of the ranges before.
    """
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    parts = durable(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    numeric = dict(values.dtypes)[value] in ("double", "float", "int", "bigint")
    mass = F.col(value).cast("double") * F.col("n") if numeric else F.lit(0.0)
    sizes = sorted((r.part, r.n, r.s) for r in parts.groupBy("part").agg(F.sum("n").alias("n"), F.sum(mass).alias("s")).collect())
    rows, total, offsets, sums = 0, 0.0, [], []
    for part, n, s in sizes:
        offsets += [F.lit(part), F.lit(rows)]
        sums += [F.lit(part), F.lit(total)]
        rows, total = rows + n, total + s
    w = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda pairs, zero: F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(zero)
    return parts.select(value, "n", (at(offsets, 0) + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("before"), (at(sums, 0.0) + F.coalesce(F.sum(mass).over(w), F.lit(0.0))).alias("sum_before"))


def rank_columns(rows: DataFrame, k: int, averaged: bool = False) -> DataFrame:
    """x<i> replaced by its rank: the least of ties, or their mean."""
    for i in range(k):
        r = ranks(rows.select(F.col(f"x{i}").alias("value")))
        place = F.col("before") + ((F.col("n") + 1) / 2 if averaged else 1)
        rows = rows.join(r.select(F.col("value").alias(f"x{i}"), place.cast("double").alias(f"r{i}")), f"x{i}")
    return rows.select(*[F.col(f"r{i}").alias(f"x{i}") for i in range(k)])


def simpson(df: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(a, b, group, r_all, r_group): groups of at least 3 rows where a pair's correlation has the other sign, both at least 0.1."""
    columns(df, [group, *names])
    base = df.select(F.col(quoted(group)).cast("string").alias("g"), *[F.col(quoted(c)).try_cast("double").alias(f"x{k}") for k, c in enumerate(names)]).dropna(subset=[f"x{k}" for k in range(len(names))])
    whole = pair_sums(base, len(names)).first()
    per = pair_sums(base, len(names), ["g"]).limit(MAX_GROUPS + 1).collect()
    if len(per) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    out = []
    for i, j in combinations(range(len(names)), 2):
        r0, _ = _r(whole, i, j) if whole["n"] else (0.0, 1.0)
        for row in per:
            r1, _ = _r(row, i, j) if row["n"] >= 3 else (0.0, 1.0)
            if r0 * r1 < 0 and min(abs(r0), abs(r1)) >= 0.1:
                out.append((names[i], names[j], row["g"], r0, r1))
    return df.sparkSession.createDataFrame(out, "a string, b string, `group` string, r_all double, r_group double")


def _groups(df: DataFrame, value: str, group: str) -> tuple[DataFrame, list]:
    columns(df, [value, group])
    rows = df.select(F.col(quoted(group)).cast("string").alias("g"), F.col(quoted(value)).try_cast("double").alias("y")).dropna().filter(~F.isnan("y"))
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var")).limit(MAX_GROUPS + 1).collect()
    if len(stats) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return rows, sorted(stats, key=lambda r: r.g)


def _levene(rows: DataFrame) -> float:
    """The p-value of equal variances, from deviations from group medians."""
    mid = exact_quantiles(rows, {"g": F.col("g")}, F.col("y"), [0.5]).select("g", F.col("q")[0].alias("m"))
    z = rows.join(mid, "g").select("g", F.abs(F.col("y") - F.col("m")).alias("z"))
    cells = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("v")).collect()
    n, k = sum(c.n for c in cells), len(cells)
    grand = sum(c.n * c.m for c in cells) / n
    between, within = sum(c.n * (c.m - grand) ** 2 for c in cells), sum((c.n - 1) * c.v for c in cells)
    if within <= 0 or n <= k:
        return 1.0 if between <= 0 else 0.0
    return tails.f_tail(between / (k - 1) / (within / (n - k)), k - 1, n - k)


def t_test(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    """Two groups in the order of their names: pooled, or Welch's where Levene rejects equal variances."""
    rows, g = _groups(df, value, group)
    if len(g) != 2 or min(s.n for s in g) < 2:
        raise ValueError("a t test has two groups of at least two values")
    a, b = g
    equal = _levene(rows) > 0.05
    pooled = math.sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))
    if equal:
        se, df_ = pooled * math.sqrt(1 / a.n + 1 / b.n), a.n + b.n - 2
    else:
        va, vb = a.var / a.n, b.var / b.n
        se, df_ = math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    gap = a.mean - b.mean
    t = gap / se if se else (0.0 if gap == 0 else math.copysign(math.inf, gap))
    p = tails.t_two_sided(t, df_) if gap or se else 1.0
    d = gap / pooled if pooled else 0.0
    return {"groups": [a.g, b.g], "n": [a.n, b.n], "means": [a.mean, b.mean], "method": "pooled" if equal else "welch", "t": t, "df": df_, "p": p, "cohen_d": d, "significant": p < alpha and (abs(d) >= 0.2 or not pooled)}


def paired_t_test(df: DataFrame, before: str, after: str, alpha: float = 0.05) -> dict:
    """Two columns of the same rows; t is of before less after, d of after less before."""
    row = _numbers(df, [before, after]).select((F.col("x0") - F.col("x1")).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    if row.n < 2:
        raise ValueError("a paired test needs two rows")
    t = row.m / (row.s / math.sqrt(row.n)) if row.s else (0.0 if not row.m else math.copysign(math.inf, row.m))
    p = tails.t_two_sided(t, row.n - 1) if row.m or row.s else 1.0
    return {"n": row.n, "t": t, "df": row.n - 1, "p": p, "cohen_d": -row.m / row.s if row.s else None, "significant": p < alpha}


def anova(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    """One-way analysis of variance with eta squared, and Tukey's pairs where it is significant with over two groups."""
    _, g = _groups(df, value, group)
    if len(g) < 2:
        raise ValueError("at least two groups")
    n, k = sum(s.n for s in g), len(g)
    grand = sum(s.n * s.mean for s in g) / n
    between = sum(s.n * (s.mean - grand) ** 2 for s in g)
    within = sum((s.n - 1) * (s.var or 0.0) for s in g)
    f = between / (k - 1) / (within / (n - k)) if n > k and within > 0 else math.inf if between > 0 else 0.0
    p = tails.f_tail(f, k - 1, n - k) if math.isfinite(f) else 0.0
    eta2 = between / (between + within) if between + within else 0.0
    pairs = []
    if p < alpha and k > 2 and within > 0:
        mse = within / (n - k)
        for a, b in combinations(g, 2):
            q = abs(a.mean - b.mean) / math.sqrt(mse / 2 * (1 / a.n + 1 / b.n))
            pairs.append({"a": a.g, "b": b.g, "difference": b.mean - a.mean, "p": tails.studentized_range_tail(q, k, n - k)})
    return {"n": n, "groups": k, "f": f, "p": p, "eta2": eta2, "ssb": between, "ssw": within, "significant": p < alpha and eta2 >= 0.01, "pairs": pairs}


def two_way_anova(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    """Type II sums of squares of two factors and their interaction, from cell moments by weighted least squares."""
    columns(df, [value, a, b])
    y = F.col(quoted(value)).try_cast("double")
    cells = df.select(F.col(quoted(a)).cast("string").alias("a"), F.col(quoted(b)).cast("string").alias("b"), y.alias("y")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")).limit(MAX_GROUPS + 1).collect()
    if len(cells) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} cells")
    weight, mean = np.array([c.n for c in cells], float), np.array([c.s / c.n for c in cells])
    within = sum(c.ss - c.s * c.s / c.n for c in cells)
    codes = lambda k: np.array([[float(c[k] == v) for v in sorted({c[k] for c in cells})[1:]] for c in cells]).reshape(len(cells), -1)
    one, xa, xb = np.ones((len(cells), 1)), codes("a"), codes("b")
    xab = np.einsum("ij,ik->ijk", xa, xb).reshape(len(cells), -1)

    def rss(*blocks: np.ndarray) -> tuple[float, int]:
        x = np.hstack(blocks)
        root = np.sqrt(weight)
        fit, _, rank, _ = np.linalg.lstsq(x * root[:, None], mean * root, rcond=None)
        return float((weight * (mean - x @ fit) ** 2).sum()), int(rank)

    full, rank = rss(one, xa, xb, xab)
    both, rank_ab = rss(one, xa, xb)
    n = int(weight.sum())
    error, df_error = within + full, n - rank
    out = []
    for name, (rest, r), (more, m) in ((f"C({a})", rss(one, xb), (both, rank_ab)), (f"C({b})", rss(one, xa), (both, rank_ab)), (f"C({a}):C({b})", (both, rank_ab), (full, rank))):
        ss, d = max(0.0, rest - more), m - r
        f = ss / d / (error / df_error) if d and df_error and error > 0 else None
        out.append({"factor": name, "ss": ss, "df": d, "f": f, "p": tails.f_tail(f, d, df_error) if f is not None else None, "partial_eta2": ss / (ss + error) if ss + error else 0.0})
    return [*out, {"factor": "residual", "ss": error, "df": df_error, "f": None, "p": None, "partial_eta2": None}]


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    """Independence of two categories, with Yates' correction for two by two, and Cramer's V."""
    columns(df, [a, b])
    cells = df.select(F.col(quoted(a)).cast("string").alias("a"), F.col(quoted(b)).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    rows, cols = sorted({c.a for c in cells}), sorted({c.b for c in cells})
    if len(rows) < 2 or len(cols) < 2:
        raise ValueError("both categories need two values")
    t = np.zeros((len(rows), len(cols)))
    for c in cells:
        t[rows.index(c.a), cols.index(c.b)] = c.n
    n = t.sum()
    expected = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / n
    off = np.abs(t - expected)
    if t.shape == (2, 2):
        off = off - np.minimum(0.5, off)
    x = float((off**2 / expected).sum())
    d = (len(rows) - 1) * (len(cols) - 1)
    v = math.sqrt(x / n / (min(t.shape) - 1))
    p = tails.chi2_tail(x, d)
    return {"n": int(n), "chi2": x, "df": d, "p": p, "cramer_v": v, "significant": p < alpha and v >= 0.1}


def mann_whitney(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    """Two groups by average ranks; two-sided normal approximation with tie and continuity corrections."""
    columns(df, [value, group])
    rows = df.select(F.col(quoted(group)).cast("string").alias("g"), F.col(quoted(value)).try_cast("double").alias("value")).dropna()
    r = ranks(rows.select("value"))
    sums = rows.join(r, "value").groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("before") + (F.col("n") + 1) / 2).alias("rank_sum")).limit(3).collect()
    if len(sums) != 2:
        raise ValueError("exactly two groups")
    a, b = sorted(sums, key=lambda s: s.g)
    n = a["size"] + b["size"]
    u = a.rank_sum - a["size"] * (a["size"] + 1) / 2
    tie = r.agg(F.coalesce(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")), F.lit(0.0))).first()[0]
    mean, var = a["size"] * b["size"] / 2, a["size"] * b["size"] / 12 * (n + 1 - tie / (n * (n - 1)))
    z = (abs(u - mean) - 0.5) / math.sqrt(var) if var > 0 else 0.0
    p = min(1.0, tails.normal_two_sided(max(z, 0.0)))
    effect = 2 * u / (a["size"] * b["size"]) - 1
    return {"groups": [a.g, b.g], "n": [a["size"], b["size"]], "u": u, "p": p, "rank_biserial": effect, "significant": p < alpha and abs(effect) >= 0.1}


def ols(df: DataFrame, target: str, features: list[str], order: str | None = None, level: float = 0.05) -> dict:
    """Least squares with intercept from one scan of products; a second scan takes the residuals' moments.

    Terms have coefficient, standard error, t, p, interval, standardised coefficient, and variance inflation with and
    without an intercept in the auxiliary fit. Durbin-Watson needs an order column.
    """
    if not 1 <= len(features) <= MAX_REGRESSORS:
        raise ValueError(f"1 to {MAX_REGRESSORS} regressors")
    k = len(features)
    rows = _numbers(df, [*features, target])
    total = df.count()
    mean = [m or 0.0 for m in rows.agg(*[F.avg(f"x{i}") for i in range(k + 1)]).first()]
    s = pair_sums(rows.select(*[(F.col(f"x{i}") - mean[i]).alias(f"x{i}") for i in range(k + 1)]), k + 1).first()
    n = s["n"]
    if n <= k + 1:
        raise ValueError(f"{n} complete rows for {k} regressors")
    p = np.array([[s[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    sums = np.array([s[f"s{i}"] for i in range(k + 1)])
    c = p - np.outer(sums, sums) / n
    inverse = np.linalg.pinv(c[:k, :k])
    slope = inverse @ c[:k, k]
    sst, sse = c[k, k], max(0.0, c[k, k] - slope @ c[:k, k])
    d = n - k - 1
    mse = sse / d
    centre = np.array(mean[:k])
    intercept = mean[k] - slope @ centre
    se = [math.sqrt(mse * (1 / n + centre @ inverse @ centre)), *np.sqrt(mse * np.diag(inverse))]
    raw = p[:k, :k] + np.outer(centre, sums[:k]) + np.outer(sums[:k], centre) + n * np.outer(centre, centre)
    raw_inverse = np.linalg.pinv(raw)
    critical = tails.t_quantile(level, d)
    terms = []
    for i, (name, b) in enumerate(zip(["intercept", *features], [intercept, *slope], strict=True)):
        t = b / se[i] if se[i] else math.inf
        terms.append({"term": name, "coefficient": float(b), "se": float(se[i]), "t": float(t), "p": tails.t_two_sided(t, d), "low": float(b - critical * se[i]), "high": float(b + critical * se[i]),
                      "beta": None if i == 0 or not sst else float(b * math.sqrt(c[i - 1, i - 1] / sst)), "vif": None if i == 0 else float(inverse[i - 1, i - 1] * c[i - 1, i - 1]), "vif_uncentred": None if i == 0 else float(raw_inverse[i - 1, i - 1] * raw[i - 1, i - 1])})
    r2 = 1 - sse / sst if sst else 0.0
    f = (sst - sse) / k / mse if mse else math.inf
    fitted = F.lit(float(intercept))
    for i, b in enumerate(slope):
        fitted = fitted + F.col(f"x{i}") * float(b)
    names = [*features, target]
    read = df.select(*[F.col(quoted(x)).try_cast("double").alias(f"x{i}") for i, x in enumerate(names)], *([F.col(quoted(order)).alias("o")] if order else [])).dropna(subset=[f"x{i}" for i in range(k + 1)])
    e = read.withColumn("e", F.col(f"x{k}") - fitted)
    m = e.agg(F.skewness("e").alias("s"), F.kurtosis("e").alias("k")).first() if sse > 0 else None
    jb = n / 6 * (m.s**2 + m.k**2 / 4) if m else 0.0
    dw = None
    if order and sse > 0:  # steps within sorted ranges, and between the ends of neighbouring ones
        ranged = durable(e.select("o", "e").repartitionByRange("o", "e").withColumn("part", F.spark_partition_id()))
        w = Window.partitionBy("part").orderBy("o", "e")
        steps = ranged.withColumn("g", F.col("e") - F.lag("e").over(w)).groupBy("part").agg(F.sum(F.col("g") * F.col("g")).alias("g2"), F.min(F.struct("o", "e"))["e"].alias("first"), F.max(F.struct("o", "e"))["e"].alias("last")).orderBy("part").collect()
        dw = (sum(r.g2 or 0.0 for r in steps) + sum((b.first - a.last) ** 2 for a, b in zip(steps, steps[1:], strict=False))) / sse
    return {"n": n, "dropped": total - n, "terms": terms, "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / d, "f": f, "f_p": tails.f_tail(f, k, d) if math.isfinite(f) else 0.0, "jarque_bera": jb, "jarque_bera_p": tails.chi2_tail(jb, 2), "durbin_watson": dw}


def logistic(df: DataFrame, target: str, features: list[str], steps: int = 25) -> dict:
    """Logistic regression by Newton steps; each step is one aggregate of gradients and curvature."""
    if not 1 <= len(features) <= MAX_REGRESSORS:
        raise ValueError(f"1 to {MAX_REGRESSORS} regressors")
    k = len(features)
    rows = _numbers(df, [*features, target])
    if rows.filter(~F.col(f"x{k}").isin(0.0, 1.0)).limit(1).count():
        raise ValueError("the target is 0 or 1")
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)]]
    y, weights = F.col(f"x{k}"), np.zeros(k + 1)
    for _ in range(steps):
        z = sum((x[i] * float(weights[i]) for i in range(1, k + 1)), F.lit(float(weights[0])))
        p = 1 / (1 + F.exp(-z))
        gap, curve = y - p, p * (1 - p)
        parts = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("ones"), F.sum(y * z - F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))).alias("ll")]
        parts += [F.sum(gap * x[i]).alias(f"g{i}") for i in range(k + 1)] + [F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        row = rows.agg(*parts).first()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        step = np.linalg.pinv(h) @ np.array([row[f"g{i}"] for i in range(k + 1)])
        if np.abs(step).max() < 1e-9:
            break
        weights = weights + step
    n, ones = row["n"], row["ones"]
    null = sum(c * math.log(c / n) for c in (ones, n - ones) if c > 0)
    se = np.sqrt(np.diag(np.linalg.pinv(h)))
    terms = [{"term": t, "coefficient": float(b), "se": float(s), "odds_ratio": math.exp(min(700.0, b)), "p": tails.normal_two_sided(b / s) if s else None} for t, b, s in zip(["intercept", *features], weights, se, strict=True)]
    return {"n": n, "terms": terms, "log_likelihood": row["ll"], "mcfadden_r2": 1 - row["ll"] / null if null else None, "p": tails.chi2_tail(2 * (row["ll"] - null), k)}
