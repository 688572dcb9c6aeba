import itertools
import json
import random

import pytest

from tallyspark.operators import schema_drift as D

CATALOG = "dataset_name string, load_no int, updated_at string, row_count long, columns_json string, old string, new string"
RECORDS = "dataset_name string, load_no int, record_no long, payload string, names string, p int"


def frames(spark, loads, records):
    catalog = spark.createDataFrame([("d", n, f"2025-01-{n:02d}", 1, json.dumps([{"name": a, "physical_type": t} for a, t in cols]), "x", "y") for n, cols in loads], CATALOG)
    return catalog, spark.createDataFrame([("d", n, k, p if p is None or isinstance(p, str) else json.dumps(p), "clash", 1) for n, k, p in records], RECORDS)


def changes(spark, loads, records):
    return {tuple(r)[1:] for r in D.schema_changes(*frames(spark, loads, records)).collect()}


def shared(old, new, n=6):
    """n records of load 1 that come again in load 2, as dictionaries made from their number."""
    return [(1, k, old(k)) for k in range(n)] + [(2, k, new(k)) for k in range(n)]


def test_rename_by_content_and_not_by_name(spark):
    loads = [(1, [("region", "string"), ("qty", "int32")]), (2, [("Region", "text"), ("area", "varchar"), ("qty", "integer")])]
    got = changes(spark, loads, shared(lambda k: {"region": f"r{k}", "qty": k}, lambda k: {"Region": f"other{k}", "area": f"r{k}", "qty": k}))
    assert got == {(2, "renamed", "region", "area"), (2, "added", "", "Region")}


def test_retyped_and_both(spark):
    loads = [(1, [("a", "int32"), ("day", "date")]), (2, [("a", "bigint"), ("on", "timestamp[us]")])]
    got = changes(spark, loads, shared(lambda k: {"a": k, "day": f"2025-01-0{k + 1}"}, lambda k: {"a": k, "on": f"2025-01-0{k + 1} 00:00:00"}))
    assert got == {(2, "retyped", "a", "a"), (2, "renamed", "day", "on"), (2, "retyped", "day", "on")}


def test_numbers_and_flags_agree_in_other_spellings(spark):
    loads = [(1, [("a", "decimal128(18, 2)"), ("f", "bool")]), (2, [("b", "double"), ("g", "int32")])]
    got = changes(spark, loads, shared(lambda k: {"a": f"{k}.50", "f": k % 2 == 0}, lambda k: {"b": k + 0.5, "g": int(k % 2 == 0)}))
    assert {g for g in got if g[1] == "renamed"} == {(2, "renamed", "a", "b"), (2, "renamed", "f", "g")}


def test_spellings_and_order_are_no_change(spark):
    one = [("a", "int64"), ("b", "double precision"), ("c", "NUMERIC(18,2)"), ("d", "timestamp without time zone"), ("e", "text")]
    two = [("e", "VARCHAR"), ("d", "TIMESTAMP"), ("c", "decimal128(18, 2)"), ("b", "float64"), ("a", "BIGINT")]
    assert changes(spark, [(1, one), (2, two)], []) == set()


def test_without_shared_records_names_go_and_come(spark):
    loads = [(1, [("a", "string")]), (2, [("b", "string")])]
    assert changes(spark, loads, [(1, 1, {"a": "x"}), (2, 2, {"b": "x"})]) == {(2, "removed", "a", ""), (2, "added", "", "b")}
    assert changes(spark, loads, shared(lambda k: {"a": "x"}, lambda k: {"b": "x"}, 1)) == {(2, "removed", "a", ""), (2, "added", "", "b")}


def test_odd_rows_and_empty_tables(spark):
    loads = [(1, [("a", "string"), (None, "string")]), (2, [("b", "string"), ("b", "int")]), (4, [("c", "string")])]
    records = shared(lambda k: {"a": f"v{k}"}, lambda k: {"b": f"v{k}"}) + [(1, 1, None), (2, 2, "not json"), (1, None, {"a": "x"}), (None, 1, {"a": "x"}), (1, 0, {"a": "v0"})]
    assert changes(spark, loads, records) == {(2, "renamed", "a", "b")}
    assert changes(spark, [], []) == set()
    assert changes(spark, loads[:1], []) == set()


def test_minimum_cost_assignment_against_all_permutations():
    rng = random.Random(5)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            cost = [[rng.randint(0, 9) for _ in range(n)] for _ in range(n)]
            got = D.assign(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_nested_fields_and_moves():
    old = D.schema_tree([("a", "struct<x:int,y:struct<z:string>>"), ("b", "struct<w:string>")])
    new = D.schema_tree([("a", "struct<x:bigint>"), ("b", "struct<w:string,y:struct<z:string>>")])
    _, ops = D.edit_script(old, new, {})
    assert set(ops) == {("retyped", "a.x", "a.x"), ("moved", "a.y", "b.y")}
    cost, ops = D.edit_script(old, old, {})
    assert (cost, ops) == (0.0, [])


@pytest.mark.parametrize("types, wide", [(["int", "bigint"], "bigint"), (["int", "double"], "double"), (["decimal(18,2)", "int"], "decimal(18,2)"), (["date", "timestamp"], "timestamp"), (["boolean", "int"], "string"), (["string", "int"], "string")])
def test_common_types(types, wide):
    assert D.common_type(types) == wide


def test_one_consistent_table(spark):
    loads = [(1, [("a", "int32"), ("gone", "string")]), (2, [("b", "bigint")]), (3, [("b", "bigint"), ("gone", "int32")]), (4, [("gone", "bigint")])]
    records = shared(lambda k: {"a": k, "gone": f"g{k}"}, lambda k: {"b": k}) + [(3, k, {"b": k, "gone": 1, "extra": 5}) for k in range(9)] + [(4, k, {"gone": k}) for k in range(6)]
    # load 4 renames b to the name of a column that load 3 still had, which goes
    catalog, raw = frames(spark, loads, records)
    got = {(r.load_no, r.record_no): r.fields for r in D.unified_records(catalog, raw).collect()}
    assert got[1, 3] == {"b": "3", "gone": "g3"}
    assert got[2, 3] == {"b": "3"}
    assert got[3, 8] == {"b": "8", "gone": "1"}
    assert got[4, 5] == {"gone": "5"}
    table = D.dataset_table(catalog, raw, "d")
    assert dict(table.dtypes) == {"load_no": "int", "record_no": "bigint", "b": "bigint", "gone": "string"}
    assert table.filter("load_no = 1 and record_no = 3").select("b", "gone").first() == (3, "g3")


def test_a_rename_onto_an_earlier_name(spark):
    loads = [(1, [("a", "string"), ("c", "int32")]), (2, [("c", "int32")]), (3, [("a", "int32")])]
    records = shared(lambda k: {"a": f"x{k}", "c": k}, lambda k: {"c": k}) + [(3, k, {"a": k}) for k in range(6)]
    catalog, raw = frames(spark, loads, records)
    got = {(r.load_no, r.record_no): r.fields for r in D.unified_records(catalog, raw).collect()}
    assert (got[1, 2], got[2, 2], got[3, 2]) == ({"a__2": "x2", "a": "2"}, {"a": "2"}, {"a": "2"})
