import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import attribution as A
from tallyspark.operators import bridge as B
from tallyspark.operators import contracts as C
from tallyspark.operators import orders as O


def periods():
    return F.col("month") == 1, F.col("month") == 2


@pytest.fixture(scope="module")
def monthly(spark):
    return spark.createDataFrame([(1, "East", "Digital", 5000.0), (1, "East", "Food", 2000.0), (1, "North", "Digital", 3000.0), (2, "East", "Digital", 2000.0), (2, "East", "Food", 2500.0), (2, "North", "Digital", 3200.0)], "month int, region string, category string, profit double")


def test_driver_closes(monthly, rows):
    d = A.driver_table(monthly, "profit", ["region"], *periods())
    got = {r.region: (r.base, r.current, r.diff) for r in d.collect()}
    assert got == {"East": (7000, 4500, -2500), "North": (3000, 3200, 200)}
    assert math.isclose(sum(r.contribution for r in d.collect()), 1)
    path = {(r.depth, r.member): r.diff for r in A.driver_path(monthly, "profit", ["region", "category"], *periods()).collect()}
    assert path[1, "East"] == -2500 and path[2, "East / Digital"] == -3000 and sum(v for (k, _), v in path.items() if k == 2) == -2300
    members = A.shapley_members(monthly, "profit", ["region", "category"], *periods()).collect()
    assert {r.dimension: sum(x.diff for x in members if x.dimension == r.dimension) for r in members} == {"region": -2300, "category": -2300}


def test_driver_with_nulls_overlap_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, None), (2, "a", 3.0), (3, "b", 9.0)], "month int, g string, v double")
    got = {r.g: (r.base, r.current) for r in A.driver_table(df, "v", ["g"], periods()[0], periods()[0] | periods()[1]).collect()}
    assert got == {None: (5, 5), "a": (0, 3)}
    assert A.driver_table(df.limit(0), "v", ["g"], *periods()).collect() == []


def test_rate_and_volume(spark):
    df = spark.createDataFrame([(1, "East", 10.0, 2.0), (2, "East", 12.0, 3.0)], "month int, region string, price double, qty double")
    r = A.rate_volume(df, "region", "price", "qty", *periods()).first()
    assert (r.volume_effect, r.rate_effect, r.interaction, r.shapley_volume, r.shapley_rate) == (10, 4, 2, 11, 5)


def test_variance_by_hand(spark):
    vd = spark.createDataFrame([("E", "E", 1.0), ("E", "E", 3.0), ("W", "W", 10.0), ("W", "W", 12.0), ("E", None, 99.0)], "region string, category string, y double")
    out = A.variance_shares(vd, "y", ["region", "category"])
    assert (out["n"], out["sst"], out["population_variance"]) == (4, 85, 21.25)
    assert out["factors"]["region"]["ssb"] == 81 and out["factors"]["region"]["f"] == 40.5
    assert out["sequential"] == {"region": 81, "category": 0} and out["shapley"] == {"region": 40.5, "category": 40.5}
    grid = spark.createDataFrame([(a, b, y) for a, b, ys in (("A", "X", (1, 3)), ("A", "Y", (5, 7)), ("B", "X", (2, 4)), ("B", "Y", (8, 10))) for y in map(float, ys)], "a string, b string, y double")
    out = A.variance_shares(grid, "y", ["a", "b"])
    assert (out["sst"], out["factors"]["a"]["ssb"], out["factors"]["b"]["ssb"], out["interaction"]) == (68, 8, 50, 2)
    wide = spark.createDataFrame([("a", "a", "a", "a", "z", 1.0), ("a", "a", "a", "a", "z", 3.0), ("b", "b", "b", "b", "z", 10.0), ("b", "b", "b", "b", "z", 12.0)], "d1 string, d2 string, d3 string, d4 string, d5 string, y double")
    out = A.variance_shares(wide, "y", ["d1", "d2", "d3", "d4", "d5"])
    assert out["skipped"] == ["d5"] and all(math.isclose(v, 20.25) for v in out["shapley"].values())
    assert A.variance_shares(wide.limit(0), "y", ["d1"])["n"] == 0


# contracts
T = [("2024-01-01", "A", "u1", 10.0, 2.0), ("2024-01-02", "B", "u1", 20.0, 4.0), ("2024-02-01", "A", "u1", 30.0, 3.0), ("2024-02-02", "B", "u2", 400.0, 4.0)]
SCHEMA = "dt string, g string, id string, n double, d double"


def windows(**more):
    return C.Windows(**{"column": "dt", "base_start": date(2024, 1, 1), "base_end": date(2024, 2, 1), "current_start": date(2024, 2, 1), "current_end": date(2024, 3, 1), "complete_until": date(2024, 3, 1)} | more)


def frame(spark, metric, data=T, **more):
    return C.tagged(spark.createDataFrame(data, SCHEMA), metric, windows(**more))


def test_compare_kinds(spark):
    r = C.compare(frame(spark, C.Metric("ratio", numerator="n", denominator="d"))).first()
    assert r.base == 5 and math.isclose(r.current, 430 / 7)
    r = C.compare(frame(spark, C.Metric("distinct_count", "id"))).first()
    assert (r.base, r.current) == (1, 2)
    r = C.compare(frame(spark, C.Metric("closing_balance", "n", entities=("id",)))).first()
    assert (r.base, r.base_rows, r.current) == (20, 1, 430)


def test_refusals(spark):
    with pytest.raises(C.ContractError):
        C.decompose_dimension(frame(spark, C.Metric("distinct_count", "id")), "g")
    with pytest.raises(C.ContractError, match="two balances"):
        frame(spark, C.Metric("closing_balance", "n", entities=("id",)), [*T, ("2024-01-02", "B", "u1", 1.0, 1.0)])
    with pytest.raises(C.ContractError, match="complete"):
        windows(complete_until=None)
    with pytest.raises(C.ContractError, match="unequal"):
        windows(current_end=date(2024, 4, 1), complete_until=date(2024, 4, 1))
    with pytest.raises(C.ContractError, match="unreadable"):
        frame(spark, C.Metric("sum", "n"), [*T, ("2024-01-05", "A", "u", None, 1.0)])
    with pytest.raises(C.ContractError, match="no rows"):
        frame(spark, C.Metric("sum", "n"), T[:2])
    with pytest.raises(C.ContractError, match="zero"):
        C.decompose_ratio(frame(spark, C.Metric("ratio", numerator="n", denominator="d"), [(*r[:4], 0.0) for r in T]))
    with pytest.raises(C.ContractError):
        C.Metric("ratio", column="n", numerator="a", denominator="b")


def test_days_cross_zones(spark):
    data = [("2024-01-31T23:30:00Z", "A", "u", 1.0, 1.0), ("2024-01-05T00:00:00+02:00", "A", "u", 2.0, 1.0), ("2024-02-05T10:00:00-0500", "A", "u", 4.0, 1.0)]
    r = C.compare(frame(spark, C.Metric("sum", "n"), data, mode="aware_timestamp", zone="Europe/Berlin")).first()
    assert (r.base, r.current) == (2, 5)


def test_decompositions_close(spark):
    f = frame(spark, C.Metric("sum", "n"))
    parts = {(r.member, r.is_top): r.diff for r in C.decompose_dimension(f, "g", 1).collect()}
    assert parts == {("B", True): 380, ("(other)", False): 20}
    r = C.decompose_ratio(frame(spark, C.Metric("ratio", numerator="n", denominator="d"))).first()
    assert math.isclose(r.numerator_effect + r.denominator_effect, r.delta)
    assert sorted((r.period, r.value) for r in C.series(f).collect()) == [("base", 30), ("current", 430)]


def test_sensitivity_and_values_without_spread(spark):
    base = [(f"2024-01-{k + 1:02d}", "A", f"u{k}", 10.0 + k % 3, 1.0) for k in range(12)]
    now = [(f"2024-02-{k + 1:02d}", "A", f"u{k}", 10.0 + k % 3, 1.0) for k in range(11)] + [("2024-02-20", "A", "u1", 900.0, 1.0)]
    f = frame(spark, C.Metric("sum", "n"), base + now)
    for method in ("zscore", "iqr", "mad"):
        got = {r.scenario: (r.current, r.current_rows) for r in C.sensitivity(f, "n", method).collect()}
        assert got["reviewed"] == (got["all"][0] - 900, 11)
    got = {r.scenario: r.current_rows for r in C.sensitivity(f, "n", "mad", entity="id").collect()}
    assert got == {"all": 12, "reviewed": 10}
    flat = frame(spark, C.Metric("sum", "n"), [(d, g, i, 5.0, e) for d, g, i, _, e in T])
    assert not any(r._flag for r in C.flagged(flat, "n", "mad").collect())


# bridge and orders
SALES = "order_id string, order_date string, region string, channel string, product_id string, quantity double, unit_price double, discount double, sales double, cogs double, profit double"
Y1, Y2 = ("2024-01-01", "2025-01-01"), ("2025-01-01", "2026-01-01")


def line(order, year, q, p, d, c, product="s", channel="web", residual=0.0, region="r"):
    sales = q * p * (1 - d) + residual
    return (order, f"{year}-03-01", region, channel, product, float(q), float(p), float(d), float(sales), float(q * c), float(sales - q * c))


@pytest.mark.parametrize("now, effect, value", [((20, 10, 0, 4), "volume", 60), ((10, 12, 0, 4), "price", 20), ((10, 10, 0.2, 4), "discount", -20), ((10, 10, 0, 5), "cost", -10)])
def test_one_factor_at_a_time(spark, now, effect, value):
    df = spark.createDataFrame([line("a", 2024, 10, 10, 0, 4), line("b", 2025, *now)], SALES)
    r = {x.scenario: x for x in B.profit_bridge(df, Y1, Y2).collect()}["observed"]
    assert math.isclose(r[effect], value) and abs(r.error) < 1e-9
    assert all(abs(r[e]) < 1e-9 for e in B.EFFECTS if e != effect)


def test_bridge_with_new_products_residuals_and_refusals(spark):
    df = spark.createDataFrame([line("bad", 2024, 1, 300, 0, 4, residual=100), line("bad", 2024, 2, 10, 0, 4), line("good", 2024, 3, 20, 0.1, 5, residual=0.004), line("x", 2025, 3, 20, 0.1, 5), line("y", 2025, 5, 7, 0.5, 1, product="new")], SALES)
    got = {x.scenario: x for x in B.profit_bridge(df, Y1, Y2).collect()}
    assert math.isclose(got["observed"].residual, -100.004) and math.isclose(got["review"].residual, -0.004, abs_tol=1e-9)
    assert all(abs(r.error) < 1e-9 for r in got.values())
    with pytest.raises(C.ContractError):
        B.profit_bridge(spark.createDataFrame([(*line("a", 2024, 1, 1, 0, 1)[:-1], 55.0), line("b", 2025, 1, 1, 0, 1)], SALES), Y1, Y2)


def test_order_classes(spark):
    base = [line(f"b{k}", 2024, 1, 100, 0.1, 50) for k in range(6)]
    now = [line("large", 2025, 100, 100, 0.1, 50), line("discount", 2025, 1, 100, 0.5, 50), line("bad", 2025, 1, 100, 0.1, 50, residual=410), line("unknown", 2025, 1, 100, 0.1, 50, product="B")]
    got = O.order_classes(spark.createDataFrame(base + now, SALES), Y1, Y2).collect()
    assert {r.order: r.order_class for r in got if r.period == "current"} == {"large": "large_order_checks_passed", "discount": "discount_outlier", "bad": "amount_mismatch", "unknown": "insufficient_evidence"}
    assert math.isclose(sum(r.contribution for r in got), sum(x[-1] for x in now) - sum(x[-1] for x in base))


def test_reconciliation(spark):
    df = spark.createDataFrame([line("a", 2024, 1, 100, 0, 50), line("bad", 2025, 1, 50, 0, 10, residual=450), line("bad", 2025, 1, 50, 0, 10, residual=450)], SALES)
    (r,) = O.reconcile_orders(df, Y1, Y2).collect()
    assert (r.order, r.observed_multiplier, r.matching, r.copies) == ("bad", 10.0, [10.0], 2)
    d = {x.effect: x.difference for x in O.bridge_without(df, ["bad"], Y1, Y2).collect()}
    assert math.isclose(d["delta"], 980)


def test_discount_drivers_close_to_the_bridge(spark):
    df = spark.createDataFrame([line("a", 2024, 10, 100, 0.1, 50), line("c", 2024, 5, 100, 0.3, 50, channel="shop"), line("b", 2025, 10, 100, 0.2, 50), line("d", 2025, 9, 100, 0.3, 50, channel="shop"), line("e", 2025, 4, 10, 0.2, 5, product="new")], SALES)
    parts = O.discount_drivers(df, Y1, Y2, "channel").collect()
    bridge = {x.scenario: x for x in B.profit_bridge(df, Y1, Y2).collect()}["observed"]
    assert math.isclose(sum(r.discount_effect for r in parts), bridge.discount)
    one = O.discount_drivers(spark.createDataFrame([line("a", 2024, 10, 100, 0.1, 50), line("b", 2025, 10, 100, 0.2, 50)], SALES), Y1, Y2, "channel").first()
    assert math.isclose(one.rate_effect, -100) and abs(one.structure_effect) < 1e-9


def test_audit_and_scenarios(spark):
    base = [line(f"b{k}", 2024, 1, 100, 0.1, 50, region="A") for k in range(3)]
    df = spark.createDataFrame([*base, line("loss", 2025, 10, 100, 0.6, 50, region="A"), line("safe", 2025, 10, 100, 0.2, 50, region="B")], SALES)
    got = {r.order: r for r in O.audit_orders(df, Y1, Y2, "region", "channel").collect()}
    assert got["loss"].priority == "P1_LOSS" and math.isclose(got["loss"].burden, 500) and got["loss"].profit == -100
    assert math.isclose(got["safe"].burden, 100) and got["safe"].levels == "product_channel"
    only = df.filter("order_id = 'loss'")
    case = {(r.drop_share, r.cost_share): r for r in O.discount_scenarios(only, Y2, [0.2], [0.0, 0.5], [0.0, 1.0]).filter("level = 8").collect()}
    assert math.isclose(case[0.0, 1.0].profit, 300) and math.isclose(case[0.5, 1.0].profit, 150) and math.isclose(case[0.5, 1.0].tolerance, 4 / 3) and math.isclose(case[0.5, 0.0].profit, -100) and abs(case[0.5, 0.0].uplift) < 1e-9
