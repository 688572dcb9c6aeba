import json
import math

import pytest

from tallyspark.operators import value_counts as V

ROWS = "dataset_name string, load_no int, k string, c string, x double, q int, n int, value string, column_name string"
CATALOG = "dataset_name string, load_no int, updated_at string, row_count long, columns_json string, spec string"
SPEC = [
    {"name": "k", "physical_type": "string", "semantic_type": "IDENTIFIER", "is_nullable": False, "comment": "pattern ^A[0-9]+$"},
    {"name": "c", "physical_type": "string", "semantic_type": "DIMENSION_CATEGORICAL", "is_nullable": True, "comment": None},
    {"name": "x", "physical_type": "double", "semantic_type": "MEASURE", "is_nullable": True, "comment": "range 0..10"},
    {"name": "q", "physical_type": "int32", "semantic_type": "MEASURE", "is_nullable": True, "comment": "range 1..5"},
    {"name": "k", "physical_type": "string", "semantic_type": "TEXT", "is_nullable": True, "comment": "pattern ^B$"},
    {"name": "absent", "physical_type": "int", "semantic_type": "MEASURE", "is_nullable": False, "comment": None},
]
COLUMNS = ["k", "c", "x", "q"]


def frames(spark, rows, counts, spec=SPEC):
    data = spark.createDataFrame([("d", load, k, c, x, q, 1, "clash", "clash") for load, k, c, x, q in rows], ROWS)
    catalog = spark.createDataFrame([("d", load, f"2025-01-{day:02d}T00:00:00Z", n, json.dumps(spec), "clash") for load, day, n in counts], CATALOG)
    return data, catalog


def found(spark, rows, counts):
    data, catalog = frames(spark, rows, counts)
    p = V.profile(data, catalog, COLUMNS)
    return {(r.load_no, r.column_name, r.finding) for r in V.findings(p, data, catalog).collect()}


BASE = [(1, f"A{i}", "uv"[i % 2], 5.0 + i % 3, 3) for i in range(10)]


def second(change):
    return [(2, *change(i, (f"A{i}", "uv"[i % 2], 5.0 + i % 3, 3))) for i in range(10)]


def test_nothing_to_find(spark):
    assert found(spark, BASE + second(lambda i, r: r), [(1, 1, 10), (2, 1, 10)]) == set()


def test_latest_registration_counts_and_repeats_lie_as_rows(spark):
    assert found(spark, BASE + BASE[:1], [(1, 1, 10), (1, 2, 11), (1, 2, 11)]) == set()
    assert found(spark, BASE, [(1, 1, 10), (1, 2, 11), (2, 1, 4)]) == {(1, "*", "row_count"), (2, "*", "row_count")}


@pytest.mark.parametrize("change, finding", [
    (lambda i, r: (None, *r[1:]) if i == 0 else r, ("k", "null_in_required")),
    (lambda i, r: ("xA1", *r[1:]) if i == 0 else r, ("k", "pattern")),
    (lambda i, r: (r[0], r[1], 10.5, 3) if i == 0 else r, ("x", "range")),
    (lambda i, r: (*r[:3], 6) if i == 0 else r, ("q", "range")),
    (lambda i, r: (r[0], None, *r[2:]) if i < 2 else r, ("c", "null_share")),
    (lambda i, r: (r[0], "w" if i < 4 else r[1], *r[2:]), ("c", "mix")),
    (lambda i, r: (r[0], r[1], 8.0, 3), ("x", "level")),
    (lambda i, r: (f"A{i % 4}", *r[1:]), ("k", "distinct")),
])
def test_each_finding_alone(spark, change, finding):
    got = found(spark, BASE + second(change), [(1, 1, 10), (2, 1, 10)])
    assert (2, *finding) in got
    assert all(f[0] == 2 for f in got)


def test_bounds_are_allowed_and_a_null_share_of_exactly_the_limit_is_none(spark):
    edge = [(1, f"A{i}", "u", 0.0 if i else 10.0, 5) for i in range(20)]
    assert not {f for f in found(spark, edge, [(1, 1, 20)])}
    rows = edge + [(2, f"A{i}", None if i < 3 else "u", 0.0 if i else 10.0, 5) for i in range(20)]
    assert (2, "c", "null_share") not in found(spark, rows, [(1, 1, 20), (2, 1, 20)])


def test_profile_figures(spark):
    data, catalog = frames(spark, [(1, "A1", "u", 1.0, 1), (1, "A1", "u", 3.0, 1), (1, "A2", "v", None, 1), (1, "A3", None, 5.0, 1)], [(1, 1, 4)])
    p = {r.column_name: r for r in V.profile(data, catalog, COLUMNS).collect()}
    assert set(p) == set(COLUMNS)
    assert (p["x"].n_rows, p["x"].n_null, p["x"].n_distinct, p["x"].min_value, p["x"].max_value, p["x"].mean) == (4, 1, 3, "1.0", "5.0", 3.0)
    assert math.isclose(p["x"].deviation, math.sqrt(8 / 3))
    assert math.isclose(p["c"].entropy, -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert p["q"].deviation == 0.0 and p["q"].entropy == 0.0


def test_deltas_maintain_counts(spark):
    data, _ = frames(spark, [(1, "a", "u", 1.0, 1), (1, "b", "u", 1.0, 1), (2, "a", "u", 1.0, 1), (2, "a", "w", 1.0, 1), (4, "a", "w", 1.0, 1)], [])
    history = V.maintained_history(V.value_counts(data, ["k"])).filter("value = 'a'").orderBy("load_no").select("load_no", "delta", "n").collect()
    assert [tuple(r) for r in history] == [(1, 1, 1), (2, 1, 2), (3, -2, 0), (4, 1, 1), (5, -1, 0)]


def test_store_applies_loads_one_by_one(spark, tmp_path, rows):
    store = V.ValueCountStore(spark, str(tmp_path / "store"), ["c"])
    one, _ = frames(spark, [(1, "a", "u", 1.0, 1), (1, "b", "u", 1.0, 1), (1, "b", None, 1.0, 1)], [])
    two, _ = frames(spark, [(2, "a", "u", 1.0, 1), (2, "b", "w", 1.0, 1), (2, "b", None, 1.0, 1)], [])
    store.apply(one)
    assert rows(store.apply(two).select("value", "delta")) == [("u", -1), ("w", 1)]
    assert rows(store.current().select("value", "load_no", "n")) == [("u", 2, 1), ("w", 2, 1), (None, 2, 1)]
    with pytest.raises(ValueError, match="already"):
        store.apply(two)
    with pytest.raises(ValueError, match="one load"):
        store.apply(one.unionByName(two.withColumn("load_no", two.load_no + 5)))


@pytest.mark.parametrize("at_once", [32, 2, 1])
def test_replay_side_by_side_is_the_replay_by_sums(spark, rows, monkeypatch, at_once):
    monkeypatch.setattr(V, "LOADS_AT_ONCE", at_once)
    data, _ = frames(spark, [(1, "a", "u", 1.0, 1), (1, "b", None, 1.0, 1), (2, "a", "u", 1.0, 1), (2, "a", "w", 1.0, 1), (4, "a", "w", 1.0, 1), (7, "c", None, 1.0, 1)], [])
    key = ["dataset_name", "column_name", "value", "load_no", "n", "delta"]
    want = rows(V.maintained_history(V.value_counts(data, ["k", "c"])).filter("n > 0 or delta <> 0").select(*key))
    assert rows(V.maintained(data, ["k", "c"]).select(*key)) == want


def test_figures_of_a_store_load_by_load_are_those_of_a_recount(spark, tmp_path):
    change = second(lambda i, r: (f"B{i}" if i < 3 else r[0], "w" if i < 4 else None if i == 5 else r[1], 12.5 if i == 9 else r[2], i % 4))
    third = [(3, *r[1:]) for r in BASE[:6]]
    data, catalog = frames(spark, BASE + change + third, [(1, 1, 10), (2, 1, 10), (3, 2, 6)])
    store = V.ValueCountStore(spark, "file://" + str(tmp_path / "store"), COLUMNS)
    parts = [store.changes(data.filter(data.load_no == k)) for k in (1, 2, 3)]
    kinds = {c: k for c, k in data.dtypes if c in COLUMNS}
    applied = V.figures(parts[0].unionByName(parts[1]).unionByName(parts[2]), V.specifications(V.counting_registrations(catalog)), kinds)
    key = lambda r: (r.load_no, r.column_name)
    one, two = sorted(applied.collect(), key=key), sorted(V.profile(data, catalog, COLUMNS).collect(), key=key)
    assert len(one) == 12
    for a, b in zip(one, two, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x == pytest.approx(y)
    own = {key(r): r for r in two}
    assert own[2, "k"].n_off == 3 and (own[2, "k"].min_value, own[2, "k"].max_value) == ("A3", "B2")
    assert own[2, "c"].shift == pytest.approx(0.5 * (abs(2 / 9 - 5 / 10) + abs(3 / 9 - 5 / 10) + 4 / 9))


def test_nulls_and_empty_tables(spark):
    assert found(spark, [], []) == set()
    data, catalog = frames(spark, BASE, [])
    assert V.quality_findings(data.select("dataset_name", "load_no", *COLUMNS), catalog).collect() == []
    blank = spark.createDataFrame([(None, 1, "a", "b", 1.0, 1, 1, "v", "c"), ("d", None, "a", "b", 1.0, 1, 1, "v", "c")], ROWS)
    assert V.value_counts(blank, COLUMNS).collect() == []
