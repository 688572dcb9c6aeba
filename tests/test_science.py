import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import tails
from tallyspark.operators import insight, mining, stats
from tallyspark.streaming import events


@pytest.mark.parametrize("got, want", [
    (lambda: tails.t_two_sided(2.228139, 10), 0.05), (lambda: tails.t_two_sided(0, 5), 1.0), (lambda: tails.t_two_sided(-12.7062, 1), 0.05), (lambda: tails.f_tail(4.102821, 2, 10), 0.05), (lambda: tails.f_tail(0, 2, 10), 1.0),
    (lambda: tails.chi2_tail(3.841459, 1), 0.05), (lambda: tails.chi2_tail(18.307038, 10), 0.05), (lambda: tails.chi2_tail(2.0, 10), 0.9963402), (lambda: tails.normal_cdf(1.959964), 0.975), (lambda: tails.t_quantile(0.05, 10), 2.228139),
    (lambda: tails.studentized_range_tail(3.578, 3, 20), 0.05), (lambda: tails.studentized_range_tail(3.151, 2, 10), 0.05), (lambda: tails.studentized_range_tail(4.232, 5, 20), 0.05), (lambda: tails.studentized_range_tail(3.314, 3, 1e9), 0.05),
])
def test_tails_against_tables(got, want):
    assert math.isclose(got(), want, abs_tol=2e-4)


def test_false_discovery():
    np.testing.assert_allclose(tails.benjamini_hochberg([0.01, 0.04, 0.03, 0.5]), [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_correlation(spark):
    rng = random.Random(2)
    data = [(x := rng.gauss(0, 1), 2 * x + rng.gauss(0, 0.1), 5.0, rng.gauss(1e9, 1)) for _ in range(300)] + [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(data, "a double, b double, flat double, big double")
    got = {(r.a, r.b): r for r in stats.correlation(df, ["a", "b", "flat", "big"]).collect()}
    good = np.array([d for d in data[:300]])
    assert math.isclose(got["a", "b"].r, np.corrcoef(good[:, 0], good[:, 1])[0, 1], rel_tol=1e-9) and got["a", "b"].high and got["a", "b"].significant
    assert math.isclose(got["a", "big"].r, np.corrcoef(good[:, 0], good[:, 3])[0, 1], rel_tol=1e-6)
    assert (got["a", "flat"].r, got["a", "flat"].p) == (0, 1)
    rank = stats.correlation(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 40.0), (9.0, 30.0)], "a double, b double"), ["a", "b"], "spearman").first()
    assert math.isclose(rank.r, np.corrcoef([1, 2, 2, 4], [1, 2, 4, 3])[0, 1])
    assert stats.correlation(df.limit(0), ["a", "b"]).first().n == 0


def test_simpson(spark):
    df = spark.createDataFrame([("A", 1.0, 5.0), ("A", 2.0, 4.0), ("A", 3.0, 3.0), ("B", 6.0, 10.0), ("B", 7.0, 9.0), ("B", 8.0, 8.0), (None, None, 1.0)], "grp string, x double, y double")
    assert {r.group for r in stats.simpson(df, "grp", ["x", "y"]).collect()} == {"A", "B"}


def test_t_tests(spark):
    rng = random.Random(42)
    data = [(g, rng.gauss(m, 15)) for g, m in (("a", 100), ("b", 120)) for _ in range(100)]
    r = stats.t_test(spark.createDataFrame(data, "g string, v double"), "v", "g")
    a, b = (np.array([v for k, v in data if k == g]) for g in "ab")
    pooled = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert r["method"] == "pooled" and math.isclose(r["t"], (a.mean() - b.mean()) / (pooled * math.sqrt(0.02))) and r["p"] < 0.001 and r["significant"]
    wide = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(60)] + [("b", rng.gauss(0, 30)) for _ in range(60)], "g string, v double")
    assert stats.t_test(wide, "v", "g")["method"] == "welch"
    p = stats.paired_t_test(spark.createDataFrame([(float(k), float(k + 1)) for k in range(1, 6)], "x double, y double"), "x", "y")
    assert p["n"] == 5 and p["significant"] and p["p"] == 0
    with pytest.raises(ValueError):
        stats.t_test(wide.filter("g = 'a'"), "v", "g")


def test_anova_and_pairs(spark):
    rng = random.Random(1)
    one = [rng.gauss(100, 15) for _ in range(100)]
    df = spark.createDataFrame([(g, x + m) for g, m in (("a", 0.0), ("b", 2.0), ("c", 40.0)) for x in one], "g string, v double")
    r = stats.anova(df, "v", "g")
    assert r["significant"] and {(x["a"], x["b"]): x["p"] < 0.05 for x in r["pairs"]} == {("a", "b"): False, ("a", "c"): True, ("b", "c"): True}
    hand = stats.anova(spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 5.0), ("B", 7.0)], "g string, v double"), "v", "g")
    assert math.isclose(hand["ssb"], 19.2) and math.isclose(hand["f"], 14.4)


def test_two_way_anova(spark):
    df = spark.createDataFrame([(1.0, "A", "X"), (2.0, "A", "X"), (10.0, "A", "Y"), (11.0, "A", "Y"), (3.0, "B", "X"), (4.0, "B", "X"), (30.0, "B", "Y"), (32.0, "B", "Y")], "y double, a string, b string")
    r = {x["factor"]: x for x in stats.two_way_anova(df, "y", "a", "b")}
    # balanced, so the sums of squares are those of the margins
    assert math.isclose(r["C(a)"]["ss"], 8 * ((6 - 11.625) ** 2 + (17.25 - 11.625) ** 2) / 2) and r["C(a)"]["df"] == 1
    assert math.isclose(r["residual"]["ss"], 3.5) and r["C(a)"]["p"] < 0.001 and r["C(a):C(b)"]["p"] < 0.001


def test_chi_square_with_correction(spark):
    df = spark.createDataFrame([(a, b) for a, b, n in (("x", "u", 10), ("x", "v", 20), ("y", "u", 30), ("y", "v", 15), (None, "u", 5)) for _ in range(n)], "a string, b string")
    r = stats.chi_square(df, "a", "b")
    t = np.array([[10, 20], [30, 15]])
    e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
    assert math.isclose(r["chi2"], ((abs(t - e) - 0.5) ** 2 / e).sum()) and r["df"] == 1 and r["n"] == 75


def test_mann_whitney(spark):
    data = [("a", v) for v in (1.0, 2.0, 2.0, 3.0, 5.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 7.0, 8.0, 9.0)]
    r = stats.mann_whitney(spark.createDataFrame(data, "g string, v double"), "v", "g")
    u = sum((x > y) + 0.5 * (x == y) for g, x in data if g == "a" for h, y in data if h == "b")
    assert r["u"] == u and 0.01 < r["p"] < 0.1


def test_regression(spark):
    rng = random.Random(3)
    data = [(5 + 2.5 * (a := rng.gauss(1e4, 3)) - 1.2 * (b := rng.gauss(0, 1)) + rng.gauss(0, 0.5), a, b, k) for k in range(200)] + [(None, 1.0, 1.0, 999)]
    df = spark.createDataFrame(data, "y double, x1 double, x2 double, k int")
    r = stats.ols(df, "y", ["x1", "x2"], order="k")
    m = np.array([d for d in data[:200]])
    x = np.column_stack([np.ones(200), m[:, 1], m[:, 2]])
    beta, *_ = np.linalg.lstsq(x, m[:, 0], rcond=None)
    e = m[:, 0] - x @ beta
    se = np.sqrt(e @ e / 197 * np.diag(np.linalg.inv(x.T @ x)))
    np.testing.assert_allclose([t["coefficient"] for t in r["terms"]], beta, rtol=1e-4)
    np.testing.assert_allclose([t["se"] for t in r["terms"]], se, rtol=1e-4)
    assert r["n"] == 200 and r["dropped"] == 1 and r["r2"] > 0.99 and r["terms"][1]["vif"] < 1.1
    assert math.isclose(r["durbin_watson"], (np.diff(e) ** 2).sum() / (e @ e), rel_tol=1e-4)
    with pytest.raises(ValueError):
        stats.ols(df.limit(2), "y", ["x1", "x2"])


def test_logistic(spark):
    rng = random.Random(4)
    data = [(float(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * (x := rng.gauss(0, 1)))))), x) for _ in range(3000)]
    r = stats.logistic(spark.createDataFrame(data, "y double, x double"), "y", ["x"])
    w = {t["term"]: t["coefficient"] for t in r["terms"]}
    assert abs(w["intercept"] - 0.5) < 0.15 and abs(w["x"] - 1.5) < 0.2 and r["p"] < 1e-10 and 0.1 < r["mcfadden_r2"] < 0.5


def test_outliers_and_forest(spark):
    df = spark.createDataFrame([(0.0,)] * 100 + [(9999.0,)] * 3 + [(None,)], "sales double")
    n, top = insight.outliers(df, "sales", k=1)
    assert n == 3 and top.count() == 1
    assert insight.outliers(df, "sales", "iqr")[0] == 3 and insight.outliers(df.limit(0), "sales")[0] == 0 and insight.outliers(df.limit(0), "sales", "iqr")[0] == 0
    rng = random.Random(5)
    pts = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(990)] + [(30.0 + k, -30.0) for k in range(6)] + [(None, 1.0)], "a double, b double")
    hit = insight.isolation_forest(pts, ["a", "b"]).filter("is_outlier").collect()
    assert sum(r.a > 20 for r in hit) == 6 and len(hit) <= 12


def test_trend_and_turn(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}", "a", float(m * 3)) for m in range(1, 13)] + [(f"2024-{m:02d}", "b", float(min(m, 13 - m))) for m in range(1, 13)] + [(None, "a", 1.0)], "t string, g string, v double")
    got = {r.group: r for r in insight.trend(df, "t", "v", "g").collect()}
    assert math.isclose(got["a"].slope, 3) and got["a"].direction == "up" and got["a"].significant and got["a"].change_point is None
    assert got["b"].change_point == "2024-07"


def test_dominance(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 10.0), ("d", 10.0), ("e", -5.0), ("a", None)], "c string, v double")
    r = insight.dominance(df, "c", "v", 1).first()
    assert (r.categories, r.total, r.top_share, r.pareto_80) == (4, 100, 0.5, 2) and math.isclose(r.gini, 0.35)
    e = insight.dominance(df.limit(0), "c", "v").first()
    assert (e.categories, e.gini, e.top_share, e.pareto_80) == (0, 0, 0, 0)
    rng = random.Random(6)
    for _ in range(3):
        v = [rng.choice([1.0, 2.0, 5.0, rng.random() * 30]) for _ in range(rng.randint(1, 60))]
        r = insight.dominance(spark.createDataFrame([(str(k), x) for k, x in enumerate(v)], "c string, v double"), "c", "v").first()
        run = np.cumsum(sorted(v, reverse=True))
        assert r.pareto_80 == (run < 0.8 * sum(v) - 1e-9).sum() + 1


def test_discover(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([("East" if k % 9 else "West", x := 10.0 + rng.random(), x * 2 + rng.random() * 0.01) for k in range(200)] + [("East", 900.0, 1800.0)], "region string, sales double, profit double")
    out = insight.discover(df)
    kinds = [f["kind"] for f in out["insights"]]
    assert kinds[0] == "anomaly" and "correlation" in kinds and len(out["graph"]["nodes"]) == len(kinds) and out["graph"]["edges"]
    assert len(insight.discover(df, lambda f: f[:1])["insights"]) == 1


def test_mining(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(c + rng.gauss(0, 0.1), c + rng.gauss(0, 0.1)) for c in (0.0, 5.0, 9.0) for _ in range(20)] + [(None, 1.0)], "f1 double, f2 double")
    rows, out = mining.kmeans(df, ["f1", "f2"])
    assert out["k"] == 3 and rows.count() == 60 and sum(p["n"] for p in out["profiles"]) == 60
    with pytest.raises(ValueError):
        mining.kmeans(df.limit(5), ["f1", "f2"])
    buys = spark.createDataFrame([(f"c{k}", f"2024-01-{k + 1:02d}", f"o{i}", 10.0 * k) for k in range(8) for i in range(k + 1)] + [(None, "2024-01-01", "x", 1.0)], "c string, d string, o string, a double")
    got = {r.customer: r for r in mining.rfm(buys, "c", "d", "o", "a", "2024-02-01").collect()}
    assert len(got) == 8 and (got["c7"].recency, got["c7"].frequency, got["c7"].r, got["c7"].f, got["c7"].m) == (24, 8, 5, 4, 4) and (got["c0"].r, got["c0"].f) == (2, 1)


@pytest.mark.parametrize("method", ["arima", "holt"])
def test_forecast(spark, method):
    months = [f"{2022 + k // 12}-{k % 12 + 1:02d}" for k in range(24)]
    df = spark.createDataFrame([(m, 100.0 + 5 * k) for k, m in enumerate(months) if m != "2023-06"], "ym string, val double")
    assert mining.calendar(df, "ym", "val")["missing"] == 1 and mining.calendar(df, "ym", "val")["season"] == 12
    r = mining.forecast(df.unionByName(spark.createDataFrame([("2023-06", 185.0)], "ym string, val double")), "ym", "val", 6, method)
    assert len(r["forecast"]) == 6 and all(x > 0 for x in r["forecast"]) and abs(r["forecast"][0] - 220) < 8 and r["low"][5] <= r["forecast"][5] <= r["high"][5]
    assert mining.calendar(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "ym string, val double"), "ym", "val")["grain"] == "not_a_date"


def test_stream_drops_repeats_and_closes_windows(spark, tmp_path):
    data = [(k % 40, f"2024-01-01 00:{k % 40:02d}:00", "u", 1.0) for k in range(80)] + [(99, "2024-01-01 03:00:00", "u", 1.0)]
    spark.createDataFrame(data, "event_id int, ts string, user_id string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, ts timestamp, user_id string, value double").parquet(str(tmp_path / "in"))
    for name, frame in (("fresh", events.fresh_events(stream, late="4 hours")), ("windows", events.windowed(stream, ["user_id"], "value", length="10 minutes")), ("sessions", events.sessions(stream))):
        events.to_parquet(frame, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 41
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "windows")).collect()) == [20, 20, 20, 20]
    assert [r.events for r in spark.read.parquet(str(tmp_path / "sessions")).collect()] == [80]


def test_discovery_reads_all_columns(spark, monkeypatch):
    from tallyspark.plans import science

    seen = []
    monkeypatch.setattr(science.I, "discover", lambda df: seen.append(df.columns) or {"insights": []})
    science.discover_insights(spark, "/root/testdata/sf0.001")
    assert {"order_date", "discount", "cogs"} <= set(seen[0])
