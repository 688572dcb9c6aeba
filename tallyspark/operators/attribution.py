"""What a change or a spread is made of: driver attribution, Shapley averages, rate and volume, variance."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.operators.relational import AGGREGATES

#: Cells of all factors that variance decomposition finishes on the driver; more is an error.
MAX_CELLS = 200_000
MAX_PERMUTED = 4


def driver_table(df: DataFrame, metric: str, dims: list[str], base: Column, current: Column, func: str = "SUM") -> DataFrame:
    """(*dims, base, current, diff, contribution, growth): the change of each member, in one scan.

    Members with no row in either period are left out; rows in both predicates count in both; nulls are members; a
    missing side is 0. contribution is null for a total change of 0 and for other functions than SUM.
    """
    columns(df, [metric, *dims])
    f, x = AGGREGATES[func.upper()], F.col(quoted(metric))
    cells = df.filter(base | current).groupBy(*[F.col(quoted(c)) for c in dims]).agg(F.coalesce(f(F.when(base, x)), F.lit(0)).cast("double").alias("base"), F.coalesce(f(F.when(current, x)), F.lit(0)).cast("double").alias("current"))
    cells = cells.withColumn("diff", F.col("current") - F.col("base"))
    grown = F.try_divide(F.col("diff") * 100, F.abs("base"))
    if func.upper() != "SUM":
        return cells.withColumns({"contribution": F.lit(None).cast("double"), "growth": grown})
    total = df.agg((F.coalesce(F.sum(F.when(current, x)), F.lit(0)) - F.coalesce(F.sum(F.when(base, x)), F.lit(0))).cast("double").alias("total"))
    return cells.withColumns({"contribution": F.try_divide(F.col("diff"), total.scalar()), "growth": grown})


def driver_path(df: DataFrame, metric: str, path: list[str], base: Column, current: Column, top: int | None = None) -> DataFrame:
    """(depth, member, base, current, diff): changes at every depth of a path, from one grouping-sets scan.

    member joins the names of the path so far with ' / '; a null name is (null). With ``top``, the largest of each depth.
    """
    columns(df, [metric, *path])
    x = F.col(quoted(metric))
    names = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("(null)")).alias(f"p{k}") for k, c in enumerate(path)]
    flat = df.filter(base | current).select(*names, F.when(base, x).alias("b"), F.when(current, x).alias("c"))
    sums = flat.groupBy(*[f"p{k}" for k in range(len(path))]).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    levels = F.array(*[F.struct(F.lit(k + 1).alias("depth"), F.concat_ws(" / ", *[f"p{i}" for i in range(k + 1)]).alias("member")) for k in range(len(path))])
    out = sums.select(F.inline(levels), "b", "c").groupBy("depth", "member").agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("base"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("current")).withColumn("diff", F.col("current") - F.col("base"))
    if top is None:
        return out
    parts = [out.filter(F.col("depth") == k + 1).orderBy(F.abs("diff").desc(), "member").limit(top) for k in range(len(path))]
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return done


def shapley_members(df: DataFrame, metric: str, dims: list[str], base: Column, current: Column) -> DataFrame:
    """(dimension, member, diff): each dimension's member changes, which for sums no order of dimensions alters."""
    if not 1 <= len(dims) <= MAX_PERMUTED:
        raise ValueError(f"1 to {MAX_PERMUTED} dimensions")
    x = F.col(quoted(metric))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(quoted(c)).cast("string").alias("member")) for c in dims])
    return df.filter(base | current).select(F.inline(pairs), F.when(base, x).alias("b"), F.when(current, x).alias("c")).groupBy("dimension", "member").agg((F.coalesce(F.sum("c"), F.lit(0.0)) - F.coalesce(F.sum("b"), F.lit(0.0))).alias("diff"))


def rate_volume(df: DataFrame, dim: str, rate: str, volume: str, base: Column, current: Column) -> DataFrame:
    """(dim, volume_effect, rate_effect, interaction, shapley_volume, shapley_rate): rate is the volume-weighted mean."""
    columns(df, [dim, rate, volume])
    r, v = F.col(quoted(rate)), F.col(quoted(volume))
    s = df.groupBy(F.col(quoted(dim))).agg(*[F.coalesce(F.sum(F.when(w, e)), F.lit(0.0)).alias(n) for n, w, e in (("a0", base, r * v), ("q0", base, v), ("a1", current, r * v), ("q1", current, v))])
    p0, p1 = F.coalesce(F.try_divide("a0", "q0"), F.lit(0.0)), F.coalesce(F.try_divide("a1", "q1"), F.lit(0.0))
    dp, dq = p1 - p0, F.col("q1") - F.col("q0")
    return s.select(
        F.col(quoted(dim)), (p0 * dq).alias("volume_effect"), (F.col("q0") * dp).alias("rate_effect"), (dp * dq).alias("interaction"),
        ((p0 + p1) / 2 * dq).alias("shapley_volume"), ((F.col("q0") + F.col("q1")) / 2 * dp).alias("shapley_rate"),
    )


def moment_cells(df: DataFrame, metric: str, dims: list[str]) -> DataFrame:
    """(*dims, n, s, ss): count, sum and sum of squares per cell; rows with a null are dropped."""
    columns(df, [metric, *dims])
    if metric in dims or len(set(dims)) != len(dims):
        raise ValueError("factors are distinct and aren't the metric")
    y = F.col(quoted(metric)).cast("double")
    rows = df.select(*[F.col(quoted(c)) for c in dims], y.alias("_y")).dropna()
    return rows.groupBy(*[F.col(quoted(c)) for c in dims]).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("ss"))


def variance_shares(df: DataFrame, metric: str, dims: list[str]) -> dict:
    """How much of the metric's variance each factor explains: alone, in the given order, and averaged over orders.

    Moments per cell are summed on the executors; at most MAX_CELLS cells (checked) reach the driver. Factors with one
    level are skipped. interaction is given for two balanced factors, else None.
    """
    cells = moment_cells(df, metric, dims).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    n, s, ss = (sum(c[k] for c in cells) for k in ("n", "s", "ss"))
    if not n:
        return {"n": 0, "sst": None, "factors": {}, "sequential": {}, "shapley": {}, "skipped": dims, "interaction": None}
    total = ss - s * s / n

    def between(keys: tuple[str, ...]) -> float:
        groups: dict[tuple, list[float]] = {}
        for c in cells:
            g = groups.setdefault(tuple(c[k] for k in keys), [0, 0.0])
            g[0] += c["n"]
            g[1] += c["s"]
        return sum(g[1] ** 2 / g[0] for g in groups.values()) - s * s / n

    levels = {d: len({c[d] for c in cells}) for d in dims}
    kept = [d for d in dims if levels[d] > 1]
    factors = {}
    for d in kept:
        ssb, k = between((d,)), levels[d]
        ssw = total - ssb
        f = (ssb / (k - 1)) / (ssw / (n - k)) if n > k and ssw > 0 else None
        factors[d] = {"ssb": ssb, "ssw": ssw, "eta2": ssb / total if total else None, "f": f, "levels": k}
    sequential, before = {}, 0.0
    for k in range(len(kept)):
        now = between(tuple(kept[: k + 1]))
        sequential[kept[k]], before = now - before, now
    shapley: dict[str, float] = {}
    if 1 <= len(kept) <= MAX_PERMUTED:
        known = {frozenset(): 0.0}
        for order in permutations(kept):
            for k, d in enumerate(order):
                for part in (order[:k], order[: k + 1]):
                    if frozenset(part) not in known:
                        known[frozenset(part)] = between(tuple(sorted(part)))
                shapley[d] = shapley.get(d, 0.0) + (known[frozenset(order[: k + 1])] - known[frozenset(order[:k])]) / factorial(len(kept))
    interaction = None
    if len(kept) == 2:
        sizes: dict[tuple, int] = {}
        for c in cells:
            at = (c[kept[0]], c[kept[1]])
            sizes[at] = sizes.get(at, 0) + c["n"]
        if len(set(sizes.values())) == 1 and len(sizes) == levels[kept[0]] * levels[kept[1]]:
            interaction = between(tuple(kept)) - factors[kept[0]]["ssb"] - factors[kept[1]]["ssb"]
    return {"n": n, "sst": total, "population_variance": total / n, "factors": factors, "sequential": sequential, "shapley": shapley, "skipped": [d for d in dims if d not in kept], "interaction": interaction}


def driver_report(df: DataFrame, metric: str, path: list[str], base: Column, current: Column, func: str = "SUM", top: int = 5, rate: str | None = None, volume: str | None = None) -> dict:
    """Totals of both periods, the largest changes at each depth, and for sums the members of each dimension and rate and volume.

    closes tells whether the members of the first dimension add up to the change; other functions than SUM are level
    comparisons and never close.
    """
    f, x = AGGREGATES[func.upper()], F.col(quoted(metric))
    totals = df.agg(f(F.when(base, x)).cast("double").alias("base"), f(F.when(current, x)).cast("double").alias("current")).first()
    b, c = totals["base"] or 0.0, totals["current"] or 0.0
    members = driver_table(df, metric, path[:1], base, current, func)
    out = {"base": b, "current": c, "delta": c - b, "growth_pct": (c - b) / abs(b) * 100 if b else None, "method": "contribution" if func.upper() == "SUM" else "level_comparison", "closes": False, "shapley": None, "rate_volume": None}
    depths = range(1, len(path) + 1)
    branches = [driver_table(df, metric, path[:k], base, current, func).orderBy(F.abs("diff").desc(), *[F.col(quoted(p)).asc_nulls_first() for p in path[:k]]).limit(2 * top).collect() for k in depths]
    out["branches"] = [{"depth": k, "path": [r[p] for p in path[:k]], "base": r["base"], "current": r["current"], "diff": r["diff"]} for k, rows in zip(depths, branches, strict=True) for r in rows]
    if func.upper() == "SUM":
        total = members.agg(F.sum(F.round("diff", 2))).first()[0] or 0.0
        out["closes"] = abs(total - (c - b)) < 0.05
        out["shapley"] = {d: [r.asDict() for r in shapley_members(df, metric, [d], base, current).orderBy(F.abs("diff").desc(), "member").limit(top).collect()] for d in path[:MAX_PERMUTED]}
    if rate and volume:
        out["rate_volume"] = [r.asDict() for r in rate_volume(df, path[0], rate, volume, base, current).orderBy(F.col(quoted(path[0])).asc_nulls_first()).limit(2 * top).collect()]
    return out
