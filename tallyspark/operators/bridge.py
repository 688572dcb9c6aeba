"""Profit bridge: a change of profit as volume, mix, price, discount, cost, residual and ledger effects that add up.

Per product and period, quantity, quantity-weighted price, gross-weighted discount rate and unit cost are summed in one
aggregate; effects are products of mid-point averages and differences, so they close exactly. A product that only one
period knows takes the other's price, discount and cost, so its whole change is volume and mix.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import columns, quoted
from tallyspark.engine.types import finite
from tallyspark.operators.contracts import ContractError

#: Amounts that count as equal.
TOLERANCE = 0.01
EFFECTS = ("volume", "mix", "price", "discount", "cost", "residual", "ledger")


@dataclass(frozen=True)
class Roles:
    """Which columns play which part."""

    order: str = "order_id"
    date: str = "order_date"
    product: str = "product_id"
    quantity: str = "quantity"
    price: str = "unit_price"
    discount: str = "discount"
    sales: str = "sales"
    cogs: str = "cogs"
    profit: str = "profit"

    def frame(self, df: DataFrame, *extra: str) -> DataFrame:
        """The columns under their roles' names, and further ones under their own."""
        columns(df, [getattr(self, f.name) for f in fields(self)] + list(extra))
        numbers = {"quantity", "price", "discount", "sales", "cogs", "profit"}
        roles = [F.col(quoted(getattr(self, f.name))).try_cast("double").alias(f.name) if f.name in numbers else F.col(quoted(getattr(self, f.name))).alias(f.name) for f in fields(self)]
        return df.select(*roles, *[F.col(quoted(c)).alias(f"x_{c}") for c in extra])


def periods(rows: DataFrame, base: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """Rows of both windows [start, end) with ``period``."""
    day = F.col("date").try_cast("date")
    within = lambda w: (day >= F.lit(w[0]).cast("date")) & (day < F.lit(w[1]).cast("date"))
    return rows.withColumn("period", F.when(within(base), "base").when(within(current), "current")).filter("period is not null")


def residual() -> Column:
    """What a line's sales differ from quantity, price and discount."""
    return F.col("sales") - F.col("quantity") * F.col("price") * (1 - F.col("discount"))


def check_rows(rows: DataFrame) -> None:
    """Refuses lines with unreadable numbers, without product, or whose profit isn't sales less cost."""
    ok = F.col("product").isNotNull()
    for n in ("quantity", "price", "discount", "sales", "cogs", "profit"):
        ok = ok & finite(F.col(n))
    off = F.abs(F.col("profit") - F.col("sales") + F.col("cogs")) > TOLERANCE
    bad = rows.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"), F.count_if(off).alias("ledger")).first()
    if bad.invalid or bad.ledger:
        raise ContractError(f"{bad.invalid} invalid lines and {bad.ledger} whose profit isn't sales less cost")


def product_effects(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(*keys, product, *EFFECTS, delta): the effects of each product, from rows with ``period``."""
    gross = F.col("quantity") * F.col("price")
    sums = {"q": F.col("quantity"), "g": gross, "dg": gross * F.col("discount"), "c": F.col("cogs"), "r": residual(), "l": F.col("profit") - F.col("sales") + F.col("cogs"), "f": F.col("profit")}
    cells = rows.groupBy(*keys, "product").agg(*[F.coalesce(F.sum(F.when(F.col("period") == p, e)), F.lit(0.0)).alias(f"{n}{k}") for k, p in enumerate(("base", "current")) for n, e in sums.items()])
    totals = cells.groupBy(*keys).agg(F.sum("q0").alias("total_q0"), F.sum("q1").alias("total_q1"))
    both = cells.join(totals, list(keys)) if keys else cells.withColumns({c: totals.select(c).scalar() for c in ("total_q0", "total_q1")})
    own = lambda n, d, k: F.try_divide(f"{n}{k}", f"{d}{k}")
    for n, a, b in (("p", "g", "q"), ("d", "dg", "g"), ("u", "c", "q")):
        both = both.withColumns({f"{n}0": F.coalesce(own(a, b, 0), own(a, b, 1), F.lit(0.0)), f"{n}1": F.coalesce(own(a, b, 1), own(a, b, 0), F.lit(0.0))})
    for k in (0, 1):
        both = both.withColumns({f"s{k}": F.coalesce(F.try_divide(f"q{k}", f"total_q{k}"), F.lit(0.0)), f"m{k}": F.col(f"p{k}") * (1 - F.col(f"d{k}")) - F.col(f"u{k}")})
    avg = lambda n: (F.col(f"{n}0") + F.col(f"{n}1")) / 2
    gap = lambda n: F.col(f"{n}1") - F.col(f"{n}0")
    weight = avg("total_q") * avg("s")
    return both.select(
        *keys, "product", (gap("total_q") * (F.col("s0") * F.col("m0") + F.col("s1") * F.col("m1")) / 2).alias("volume"), (avg("total_q") * gap("s") * avg("m")).alias("mix"),
        (weight * gap("p") * (1 - avg("d"))).alias("price"), (-weight * avg("p") * gap("d")).alias("discount"), (-weight * gap("u")).alias("cost"), gap("r").alias("residual"), gap("l").alias("ledger"), gap("f").alias("delta"),
        weight.alias("weight"), avg("p").alias("price_mid"),
    )


def profit_bridge(df: DataFrame, base: tuple[str, str], current: tuple[str, str], roles: Roles | None = None, *, check: bool = True) -> DataFrame:
    """(scenario, base, current, delta, *EFFECTS, error): for all orders, and for 'review' without whole orders that hold a line with a residual."""
    rows = periods((roles or Roles()).frame(df), base, current)
    if check:
        check_rows(rows)
    bad = rows.filter(F.abs(residual()) > TOLERANCE).select("order").distinct()
    scenarios = rows.withColumn("scenario", F.lit("observed")).unionByName(rows.join(bad, "order", "left_anti").select(*rows.columns).withColumn("scenario", F.lit("review")))
    effects = product_effects(scenarios, ["scenario"]).groupBy("scenario").agg(*[F.sum(e).alias(e) for e in EFFECTS])
    ends = scenarios.groupBy("scenario").agg(*[F.coalesce(F.sum(F.when(F.col("period") == p, F.col("profit"))), F.lit(0.0)).alias(p) for p in ("base", "current")])
    out = ends.join(effects, "scenario").withColumn("delta", F.col("current") - F.col("base"))
    return out.select("scenario", "base", "current", "delta", *EFFECTS, (F.col("delta") - sum((F.col(e) for e in EFFECTS[1:]), F.col(EFFECTS[0]))).alias("error"))
