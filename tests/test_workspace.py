import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.engine import guard
from tallyspark.engine.workspace import Context, Guide, Workspace
from tallyspark.operators import attribution, bridge, orders


@pytest.fixture(scope="module")
def erp(spark, tmp_path_factory):
    """Order lines of an invented shop: two years, a few of them inflated."""
    rng, rows = random.Random(42), []
    for k in range(600):
        day = date(2024, 1, 1) + timedelta(days=rng.randint(0, 730))
        q, p, d = rng.randint(1, 9), rng.choice([10.0, 25.0, 80.0]), rng.choice([0.0, 0.1, 0.2])
        sales = round(q * p * (1 - d) * (10 if k % 200 == 7 else 1), 2)
        rows.append((f"o{k // 2}", str(day), rng.choice(["East", "North"]), f"p{p}", float(q), p, d, sales, q * p * 0.5, sales - q * p * 0.5))
    folder = str(tmp_path_factory.mktemp("erp") / "lines.parquet")
    spark.createDataFrame(rows, "order_id string, order_date string, region string, product_id string, quantity double, unit_price double, discount double, sales double, cogs double, profit double").write.parquet(folder)
    return folder


def test_end_to_end(spark, erp, tmp_path):
    w = Workspace(spark, "erp")
    w.load("lines", erp)
    assert [d["name"] for d in w.session.listing()] == ["lines"] and w.catalog.status("lines") == "draft"
    out = w.run("aggregate", "lines", dims=["region"], metrics=["sales"], funcs=["SUM"])
    assert {r["region"] for r in out["rows"]} == {"East", "North"} and out["warnings"] == ["lines is draft"] and out["evidence"]["query_sha256"]
    assert w.sql("select count(*) n from lines")["rows"] == [{"n": 600}]
    assert w.sql("select * from lines", limit=5)["truncated"]
    with pytest.raises(guard.GuardError):
        w.sql("select * from lines", endorsed_only=True)
    with pytest.raises(guard.GuardError):
        w.sql("drop table lines")
    assert w.health()["score"] < 100
    w.catalog.endorse("lines", "endorsed")
    again = w.trail.replay(w.trail.export("monthly"), {0: {"funcs": ["AVG"]}})
    assert "sales_avg" in again[0]["rows"][0] and again[0]["warnings"] == []
    assert w.export("lines", f"sqlite:///{tmp_path}/x.db", "t") == 600


def test_report_and_drivers_close(spark, erp):
    df = spark.read.parquet(erp)
    roles = orders.discover_roles(df)
    assert roles["date"] == "order_date" and roles["profit"] == "profit" and roles["order"] == "order_id"
    r = orders.business_report(df, "profit", "order_date", (date(2024, 1, 1), date(2025, 1, 1)), (date(2025, 1, 1), date(2026, 1, 1)), "quarter", ["region"], roles=bridge.Roles())
    delta = r["comparison"]["delta"]
    assert abs(sum(x["diff"] for x in r["dimensions"]["region"]) - delta) < 1e-6 and len(r["series"]) == 8 and r["series"][4]["year_before"] == r["series"][0]["value"]
    assert abs(next(b for b in r["bridge"] if b["scenario"] == "observed")["delta"] - delta) < 1e-6 and all(abs(b["error"]) < 1e-6 for b in r["bridge"])
    base, current = F.col("order_date") < "2025", F.col("order_date").between("2025", "2025-12-31")
    d = attribution.driver_report(df, "profit", ["region", "product_id"], base, current, rate="unit_price", volume="quantity")
    assert d["closes"] and abs(d["delta"] - delta) < 1e-6 and {b["depth"] for b in d["branches"]} == {1, 2}
    assert attribution.driver_report(df, "profit", ["region"], base, current, "AVG")["closes"] is False
    (b0, b1), (c0, c1) = orders.default_windows(df, "order_date", "month")
    assert b1 == c0 and b0.day == 1 and c1 > c0
    with pytest.raises(orders.ContractError):
        orders.business_report(df, "profit", "order_date", (date(2025, 1, 1), date(2024, 1, 1)), (date(2025, 1, 1), date(2026, 1, 1)))


def test_context():
    c = Context()
    c.rules.append("Ratios are ratios of sums.")
    for g in (Guide("a", "x", ("t",)), Guide("b", "y"), Guide("c", "z", ("u",))):
        c.register(g)
    c.endorse("b", "endorsed")
    assert [g["name"] for g in c.resolve(["t"])["guides"]] == ["b", "a"] and [g["name"] for g in c.resolve(["t"], True)["guides"]] == ["b"]
    c.endorse("a", "deprecated")
    assert [g["name"] for g in c.resolve(["t", "u"])["guides"]] == ["b", "c"] and c.resolve([])["rules"]
