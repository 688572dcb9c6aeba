"""Order-level tools: reports, classes of orders, reconciliation, discount drivers, audits and scenarios.

All share the role names of ``bridge.Roles`` and windows [start, end). Reference figures come from base rows, are small
per product, and are joined with null-safe keys; ``order_ids`` only narrow what is shown, never what is computed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.guard import quoted
from tallyspark.engine.types import period_start
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators import bridge as B
from tallyspark.operators.contracts import ContractError

#: Words by which columns are recognised (fixed values).
ALIASES = {
    "date": ("order_date", "date", "dt", "created_at", "日期"), "profit": ("profit", "利润"), "sales": ("sales", "revenue", "amount", "销售额"), "cogs": ("cogs", "cost", "成本"),
    "quantity": ("quantity", "qty", "数量"), "price": ("unit_price", "price", "单价"), "discount": ("discount", "折扣率", "折扣"), "product": ("product_id", "sku", "product", "商品"),
    "order": ("order_id", "id", "订单号"), "region": ("region", "区域"), "category": ("category", "品类"),
}


def discover_roles(df: DataFrame) -> dict[str, str]:
    """Which column plays which part, by exact alias without case; the first alias in ALIASES' order wins."""
    low = {c.lower(): c for c in df.columns}
    return {role: next(low[a] for a in names if a in low) for role, names in ALIASES.items() if any(a in low for a in names)}


def calendar_series(df: DataFrame, date_column: str, value: str, grain: str, start: date, end: date) -> DataFrame:
    """(bucket, value, previous, year_before): every bucket from start to before end; one without rows is null.

    year_before is null for weeks. Buckets are aggregated first; the calendar is the only thing ordered.
    """
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[grain]
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(period_start(grain, F.lit(start)), F.lit(date.fromordinal(end.toordinal() - 1)), F.expr(step))).alias("bucket"))
    sums = df.select(period_start(grain, F.col(quoted(date_column)).try_cast("date")).alias("bucket"), F.col(quoted(value)).try_cast("double").alias("v")).groupBy("bucket").agg(F.sum("v").alias("value"))
    full = spine.join(sums, "bucket", "left")
    before = sums.select(F.expr(f"bucket + {step}").cast("date").alias("bucket"), F.col("value").alias("previous"))
    year = sums.select(F.add_months("bucket", 12).alias("bucket"), F.col("value").alias("year_before"))
    out = full.join(before, "bucket", "left")
    return out.withColumn("year_before", F.lit(None).cast("double")) if grain == "week" else out.join(year, "bucket", "left")


def anomalies(series: DataFrame, threshold: float = 3.0, k: int = 20) -> DataFrame:
    """(bucket, value, z): buckets at least ``threshold`` population deviations from the mean."""
    stats = series.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return series.withColumns({c: stats.select(c).scalar() for c in ("m", "s")}).select("bucket", "value", z.alias("z")).filter(F.abs("z") >= threshold).orderBy(F.abs("z").desc(), "bucket").limit(k)


def order_classes(df: DataFrame, base: tuple[str, str], current: tuple[str, str], roles: B.Roles | None = None, *, amount_tolerance: float = 0.01, discount_threshold: float | None = None, min_reference_rows: int = 5) -> DataFrame:
    """(order, period, order_class, sales, profit, contribution): one exclusive class per order and period.

    amount_mismatch before discount_outlier, insufficient_evidence, large_order_checks_passed, other_checks_passed.
    Discounts are outliers above Q3 + 1.5 IQR of the product's base lines (or a fixed threshold), orders are large above
    the same fence of base orders' sales. contribution is the order's profit, negative in the base, so all add up to
    the change.
    """
    rows = B.periods((roles or B.Roles()).frame(df), base, current)
    old, quarters = rows.filter("period = 'base'"), [0.25, 0.75]
    fence = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    known = old.groupBy(F.col("product").alias("p1")).agg(F.count("discount").alias("known"))
    reference = exact_quantiles(old, {"p2": F.col("product")}, F.col("discount"), quarters).select("p2", fence.alias("limit")).join(known, F.col("p1").eqNullSafe(F.col("p2")))
    sizes = exact_quantiles(old.groupBy("order").agg(F.sum("sales").alias("s")), {}, F.col("s"), quarters).select(fence.alias("size_limit"))
    lines = rows.join(reference, F.col("product").eqNullSafe(F.col("p2")), "left")
    limit = F.lit(discount_threshold) if discount_threshold is not None else F.when(F.col("known") >= min_reference_rows, F.col("limit"))
    marks = lines.groupBy("order", "period").agg(
        F.coalesce(F.max(F.abs(B.residual()) > amount_tolerance), F.lit(True)).alias("mismatch"), F.coalesce(F.max(F.col("discount") > limit), F.lit(False)).alias("outlier"),
        F.max(limit.isNull()).alias("unknown"), F.sum("sales").alias("sales"), F.sum("profit").alias("profit"),
    ).withColumn("size_limit", sizes.scalar())
    kind = F.when(F.col("mismatch"), "amount_mismatch").when(F.col("outlier"), "discount_outlier").when(F.col("unknown"), "insufficient_evidence").when(F.col("sales") > F.col("size_limit"), "large_order_checks_passed").otherwise("other_checks_passed")
    return marks.select("order", "period", kind.alias("order_class"), "sales", "profit", F.when(F.col("period") == "base", -F.col("profit")).otherwise(F.col("profit")).alias("contribution"))


def reconcile_orders(df: DataFrame, base: tuple[str, str], current: tuple[str, str], roles: B.Roles | None = None, *, multipliers: tuple[float, ...] = (0.01, 0.1, 10.0, 100.0, 1000.0), adjustments: tuple[str, ...] = (), tolerance: float = 0.01) -> DataFrame:
    """(order, period, expected, sales, observed_multiplier, matching, copies): lines whose amount isn't quantity times price.

    expected includes the adjustment columns; matching lists the multipliers that explain the amount; copies counts lines
    with the same business values.
    """
    r = roles or B.Roles()
    if len(set(adjustments)) > 8 or len(multipliers) > 20 or any(m <= 0 or m == 1 for m in multipliers):
        raise ContractError("at most 8 adjustments and 20 positive multipliers other than 1")
    rows = B.periods(r.frame(df, *adjustments), base, current)
    extra = sum((F.coalesce(F.col(f"x_{a}").try_cast("double"), F.lit(0.0)) for a in adjustments), F.lit(0.0))
    lines = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("expected", F.col("quantity") * F.col("price") * (1 - F.col("discount")) + extra)
    hits = F.filter(F.array(*map(F.lit, multipliers)), lambda m: F.abs(F.col("sales") - F.col("expected") * m) <= tolerance)
    return lines.filter(F.abs(F.col("sales") - F.col("expected")) > tolerance).select("order", "period", "expected", "sales", F.try_divide("sales", "expected").alias("observed_multiplier"), hits.alias("matching"), "copies")


def bridge_without(df: DataFrame, orders: list, base: tuple[str, str], current: tuple[str, str], roles: B.Roles | None = None) -> DataFrame:
    """(effect, observed, without, difference): the bridge with all orders and without the selected ones (at most 100)."""
    if not 0 < len(orders) <= 100:
        raise ContractError("1 to 100 orders")
    rows = B.periods((roles or B.Roles()).frame(df), base, current)
    kept = rows.filter(~F.col("order").isin(orders) | F.col("order").isNull())
    both = rows.withColumn("scenario", F.lit("observed")).unionByName(kept.withColumn("scenario", F.lit("without")))
    names = (*B.EFFECTS, "delta")
    sums = B.product_effects(both, ["scenario"]).groupBy("scenario").agg(*[F.sum(e).alias(e) for e in names])
    long = sums.select("scenario", F.inline(F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("v")) for e in names])))
    out = long.groupBy("effect").agg(*[F.max(F.when(F.col("scenario") == s, F.col("v"))).alias(s) for s in ("observed", "without")])
    return out.withColumn("difference", F.col("observed") - F.coalesce("without", F.lit(0.0)))


def discount_drivers(df: DataFrame, base: tuple[str, str], current: tuple[str, str], dimension: str, roles: B.Roles | None = None, excluded: tuple = ()) -> DataFrame:
    """(member, rate_effect, structure_effect, discount_effect): the bridge's discount effect by member of a dimension.

    Within a product, a member's weight is its share of gross sales: the change of rates at mean weights is the rate
    effect, the change of weights at mean rates the structure effect; over all members they add up to the bridge's.
    """
    rows = B.periods((roles or B.Roles()).frame(df, dimension), base, current)
    if excluded:
        rows = rows.filter(~F.col("order").isin(list(excluded)) | F.col("order").isNull())
    gross = F.col("quantity") * F.col("price")
    member = F.col(f"x_{dimension}").cast("string").alias("member")
    cells = rows.groupBy("product", member).agg(*[F.coalesce(F.sum(F.when(F.col("period") == p, e)), F.lit(0.0)).alias(f"{n}{k}") for k, p in enumerate(("base", "current")) for n, e in (("g", gross), ("dg", gross * F.col("discount")))])
    totals = cells.groupBy(F.col("product").alias("p2")).agg(*[F.sum(f"{n}{k}").alias(f"total_{n}{k}") for n in ("g", "dg") for k in (0, 1)])
    scale = B.product_effects(rows).select(F.col("product").alias("p3"), (F.col("weight") * F.col("price_mid")).alias("K"))
    both = cells.join(totals, F.col("product").eqNullSafe(F.col("p2"))).join(scale, F.col("product").eqNullSafe(F.col("p3")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # a product that one period doesn't know keeps the other's weights and rates, as in the bridge
    for k, o in ((0, 1), (1, 0)):
        here = F.col(f"total_g{k}") != 0
        both = both.withColumns({f"w{k}": zero(F.when(here, F.try_divide(f"g{k}", f"total_g{k}")).otherwise(F.try_divide(f"g{o}", f"total_g{o}"))), f"r{k}": zero(F.coalesce(F.try_divide(f"dg{k}", f"g{k}"), F.try_divide(f"dg{o}", f"g{o}")))})
    rate = -F.col("K") * (F.col("w0") + F.col("w1")) / 2 * (F.col("r1") - F.col("r0"))
    structure = -F.col("K") * (F.col("r0") + F.col("r1")) / 2 * (F.col("w1") - F.col("w0"))
    return both.groupBy("member").agg(F.sum(rate).alias("rate_effect"), F.sum(structure).alias("structure_effect")).withColumn("discount_effect", F.col("rate_effect") + F.col("structure_effect"))


def audit_orders(df: DataFrame, base: tuple[str, str], current: tuple[str, str], customer: str, channel: str, roles: B.Roles | None = None, *, min_reference_orders: int = 3, materiality: float = 500.0) -> DataFrame:
    """(order, priority, burden, profit, discount_rate, levels): current orders against usual base discounts.

    The reference rate of a line is that of its product, customer and channel, else product and channel, else product, of
    which at least min_reference_orders base orders exist. burden is gross times the rate above it. Priorities: P0
    accounting mismatch, P1 loss with a burden, P2 loss without or material burden, P3 reference missing or routine.
    """
    rows = B.periods((roles or B.Roles()).frame(df, customer, channel), base, current).withColumn("gross", F.col("quantity") * F.col("price"))
    old = rows.filter("period = 'base'")
    lines = rows.filter("period = 'current'")
    usual = []
    for level, keys in (("product_customer_channel", ["product", f"x_{customer}", f"x_{channel}"]), ("product_channel", ["product", f"x_{channel}"]), ("product", ["product"])):
        ref = old.groupBy(*[F.col(k).alias(f"{level}_{i}") for i, k in enumerate(keys)]).agg(F.try_divide(F.sum(F.col("gross") * F.col("discount")), F.sum("gross")).alias(f"r_{level}"), F.count_distinct("order").alias(f"n_{level}")).filter(F.col(f"n_{level}") >= min_reference_orders)
        on = [F.col(k).eqNullSafe(F.col(f"{level}_{i}")) for i, k in enumerate(keys)]
        lines = lines.join(ref, on, "left")
        usual.append((level, F.col(f"r_{level}")))
    rate = F.coalesce(*[r for _, r in usual])
    level = F.coalesce(*[F.when(r.isNotNull(), F.lit(n)) for n, r in usual], F.lit("none"))
    lines = lines.withColumns({"ref": rate, "level": level})
    out = lines.groupBy("order").agg(
        F.coalesce(F.max((F.abs(B.residual()) > B.TOLERANCE) | (F.abs(F.col("profit") - F.col("sales") + F.col("cogs")) > B.TOLERANCE)), F.lit(True)).alias("mismatch"),
        F.coalesce(F.sum(F.col("gross") * (F.col("discount") - F.col("ref"))), F.lit(0.0)).alias("burden"), F.sum("profit").alias("profit"), F.try_divide(F.sum(F.col("gross") * F.col("discount")), F.sum("gross")).alias("discount_rate"),
        F.max(F.col("ref").isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_set("level")), ", ").alias("levels"),
    )
    kind = (
        F.when(F.col("mismatch"), "P0_ACCOUNTING").when((F.col("profit") < 0) & (F.col("burden") > 0), "P1_LOSS").when(F.col("profit") < 0, "P2_SELECTED_LOSS")
        .when(F.col("burden") >= materiality, "P2_MATERIAL").when(F.col("unknown"), "P3_REFERENCE").otherwise("P3_ROUTINE")
    )
    return out.select("order", kind.alias("priority"), "burden", "profit", "discount_rate", "levels")


def discount_scenarios(df: DataFrame, window: tuple[str, str], caps: list[float], drops: list[float], cost_shares: list[float], roles: B.Roles | None = None) -> DataFrame:
    """(product, cap, drop_share, cost_share, profit, uplift, tolerance, level): grid of discount caps and volume drops.

    profit is G(1 - min(d, cap))(1 - v) - C(1 - a v); tolerance is the volume drop at which a cap gains nothing. level
    is the grouping id: 0 per product, 8 over all products. Grids are literal arrays of checked size.
    """
    if not (1 <= len(caps) <= 12 and 1 <= len(drops) <= 12 and 1 <= len(cost_shares) <= 5) or any(not 0 <= x <= 1 for x in (*caps, *drops, *cost_shares)):
        raise ContractError("1 to 12 caps and drops and 1 to 5 cost shares within [0, 1]")
    rows = B.periods((roles or B.Roles()).frame(df), window, window).withColumn("gross", F.col("quantity") * F.col("price"))
    by_cap = F.array(*[F.struct(F.lit(float(c)).alias("cap"), (F.col("gross") * (1 - F.least(F.col("discount"), F.lit(float(c))))).alias("net")) for c in caps])
    # products times caps rows: the grid of drops and shares is applied to sums, not to lines
    sums = rows.select("product", "cogs", "profit", F.inline(by_cap)).groupBy("product", "cap").agg(F.sum("net").alias("net"), F.sum("cogs").alias("c"), F.sum("profit").alias("now"))
    grid = F.array(*[F.struct(F.lit(float(v)).alias("drop_share"), F.lit(float(a)).alias("cost_share")) for v in drops for a in cost_shares])
    cases = sums.select("product", "cap", "net", "c", "now", F.inline(grid))
    value = F.col("net") * (1 - F.col("drop_share")) - F.col("c") * (1 - F.col("cost_share") * F.col("drop_share"))
    cases = cases.withColumn("v", value)
    keys = [F.col(k) for k in ("product", "cap", "drop_share", "cost_share")]
    out = cases.groupingSets([keys, keys[1:]], *keys).agg(F.sum("v").alias("profit"), F.sum("now").alias("now"), F.sum("net").alias("net"), F.sum("c").alias("c"), F.grouping_id().cast("long").alias("level"))
    even = F.try_divide(F.col("net") - F.col("c") - F.col("now"), F.col("net") - F.col("cost_share") * F.col("c"))
    return out.select("product", "cap", "drop_share", "cost_share", "profit", (F.col("profit") - F.col("now")).alias("uplift"), even.alias("tolerance"), "level")


def business_report(df: DataFrame, value: str, date_column: str, base: tuple[date, date], current: tuple[date, date], grain: str = "month", dimensions: list[str] = (), filters: dict[str, str] | None = None, roles: B.Roles | None = None) -> dict:
    """A report of a summed metric: comparison, calendar series with anomalies, up to 2 dimensions (top 50), and the bridge if roles are given.

    Windows are [start, end) and at most 3653 days, for days 2000. Only aggregated rows reach the driver.
    """
    start, end = base[0], current[1]
    if not base[0] < base[1] <= current[0] < current[1] or (end - start).days > (2000 if grain == "day" else 3653):
        raise ContractError("the windows are out of order or too long")
    if len(dimensions) > 2 or len(filters or {}) > 8:
        raise ContractError("at most 2 dimensions and 8 filters")
    from tallyspark.operators.attribution import driver_table
    from tallyspark.operators.relational import matching

    rows = matching(df, filters or {})
    day = F.col(quoted(date_column)).try_cast("date")
    rows = rows.withColumn(value, F.col(quoted(value)).try_cast("double"))
    within = lambda w: F.coalesce((day >= F.lit(w[0])) & (day < F.lit(w[1])), F.lit(False))
    b, c = within(base), within(current)
    totals = rows.agg(F.sum(F.when(b, F.col(quoted(value)))).alias("base"), F.sum(F.when(c, F.col(quoted(value)))).alias("current"), F.count_if(b).alias("base_rows"), F.count_if(c).alias("current_rows"), F.count_if(day.isNull()).alias("undated")).first().asDict()
    delta = totals["current"] - totals["base"] if totals["current"] is not None and totals["base"] is not None else None
    series = calendar_series(rows, date_column, value, grain, start, end)
    parts = {d: [r.asDict() for r in driver_table(rows, value, [d], b, c).orderBy(F.abs("diff").desc(), F.col(quoted(d)).asc_nulls_first()).limit(50).collect()] for d in dimensions}
    checks = [t for t, bad in (("rows without a date were left out", totals["undated"]), ("the base window has no rows", not totals["base_rows"]), ("the current window has no rows", not totals["current_rows"])) if bad]
    steps = [f"look into {d} {rows_[0][d]}" for d, rows_ in parts.items() if rows_]
    bridge = [r.asDict() for r in B.profit_bridge(rows, tuple(map(str, base)), tuple(map(str, current)), roles).collect()] if roles else None
    return {"comparison": totals | {"delta": delta, "change_pct": delta * 100 / abs(totals["base"]) if delta is not None and totals["base"] else None}, "series": [r.asDict() for r in series.orderBy("bucket").collect()], "anomalies": [r.asDict() for r in anomalies(series).collect()], "dimensions": parts, "bridge": bridge, "checks": checks, "next_steps": steps}


def default_windows(df: DataFrame, date_column: str, grain: str = "month") -> tuple[tuple[date, date], tuple[date, date]]:
    """The latest bucket of the data and the one before."""
    last = df.select(F.max(F.col(quoted(date_column)).try_cast("date")).alias("d")).select(period_start(grain, F.col("d")).alias("d"), F.expr({"day": "date_add(d, -1)", "week": "date_add(trunc(d, 'week'), -7)", "month": "add_months(trunc(d, 'month'), -1)", "quarter": "add_months(trunc(d, 'quarter'), -3)", "year": "add_months(trunc(d, 'year'), -12)"}[grain]).alias("b"), F.expr({"day": "date_add(d, 1)", "week": "date_add(trunc(d, 'week'), 7)", "month": "add_months(trunc(d, 'month'), 1)", "quarter": "add_months(trunc(d, 'quarter'), 3)", "year": "add_months(trunc(d, 'year'), 12)"}[grain]).alias("e")).first()
    if last.d is None:
        raise ContractError("there is no date")
    return (last.b, last.d), (last.d, last.e)
