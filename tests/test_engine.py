import json
import sqlite3
import subprocess
import sys
import zipfile
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.engine import evidence, guard, session, types
from tallyspark.operators import catalog, events, narrative, ontology, profile, quality, relational, semantic, transform
from tallyspark.sinks import writers
from tallyspark.sources import readers

REPO = Path(__file__).resolve().parents[1]


# guards
@pytest.mark.parametrize("text", ["a = 1; drop table t", "a = (select max(x) from t)", "exists (select 1)", "a in (select b from t)", "reflect('java.lang.System', 'exit')", "a ==", ""])
def test_predicates_refused(spark, text):
    with pytest.raises(guard.GuardError):
        guard.predicate(spark, text)


@pytest.mark.parametrize("text", ["drop table t", "insert into t values (1)", "create table t as select 1", "select 1; select 2", "select * from parquet.`/etc`", "set x = 1", "select java_method('a', 'b')", "delete from t", "create temp view v as select 1", "cache table t"])
def test_statements_refused(spark, text):
    with pytest.raises(guard.GuardError):
        guard.read_only(spark, text)


@pytest.mark.parametrize("text", ["select 1", "with a as (select 1 x) select * from a", "select * from range(3)", "select a, count(*) from (values (1)) t(a) group by a", "select * from t where x in (select y from u)", "explain select 1"])
def test_statements_allowed(spark, text):
    assert guard.read_only(spark, text) == text


def test_names():
    for bad in ("", "a b", "1a", "a;b", "x" * 200, None):
        with pytest.raises(guard.GuardError):
            guard.identifier(bad)
    assert guard.table_name("a.b.c") == "a.b.c" and guard.quoted("日`期") == "`日``期`"
    with pytest.raises(guard.GuardError):
        guard.table_name("a.b.c.d")


def test_sessions(spark):
    m = session.SessionManager(spark, idle_seconds=10)
    one, two = m.get("one"), m.get("two")
    one.register("日期 表", one.spark.range(3), "postgres://u:secret@h/db")
    assert one.table("日期 表").count() == 3 and "secret" not in one.listing()[0]["source"]
    with pytest.raises(guard.GuardError):
        two.table("日期 表")
    for bad in ("", "a/b", "..", "x" * 129):
        with pytest.raises(guard.GuardError):
            m.get(bad)
    with pytest.raises(guard.GuardError):
        one.register("a;b", one.spark.range(1))
    assert m.sweep(now=two.used_at + 100) == ["one", "two"] and m.ids() == []


def test_evidence(spark):
    r = evidence.Recorder("op", "sum", k=1)
    r.ran(spark.range(3))
    e = r.done(rows_scanned=3).as_dict()
    assert e["rows_scanned"] == 3 and len(e["query_sha256"]) == 64 and e["plan"] and e["causal_claim"] is False


def test_semantic_types(spark):
    df = spark.range(200).selectExpr("id as user_id", "id % 3 as kind", "id * 1.5 as amount", "cast(id as string) as word", "cast(id % 4 as string) as grp", "date'2024-01-01' as day", "array(id) as a", "true as flag")
    assert types.semantic_types(df) == {"user_id": "IDENTIFIER", "kind": "DIMENSION_CATEGORICAL", "amount": "MEASURE", "word": "IDENTIFIER", "grp": "DIMENSION_CATEGORICAL", "day": "DIMENSION_TEMPORAL", "a": "TEXT", "flag": "DIMENSION_CATEGORICAL"}
    assert set(types.semantic_types(df.limit(0))) == set(df.columns)
    late = spark.range(9000).selectExpr("if(id < 6000, 1, id) as n", "if(id < 6000, 'x', cast(id as string)) as t")  # no prefix tells what follows
    assert types.semantic_types(late) == types.semantic_types(late.orderBy(late.n.desc())) == {"n": "MEASURE", "t": "TEXT"}


def test_moments(spark):
    df = spark.createDataFrame([(x, 5.0) for x in (1.0, 2.0, 4.0, 10.0)], "a double, flat double")
    r = df.agg(types.sample_skewness("a"), types.sample_kurtosis("a"), types.sample_skewness("flat"), types.sample_kurtosis("flat")).first()
    assert round(r[0], 5) == 1.46933 and round(r[1], 5) == 2.03077 and r[2] is None and r[3] is None
    assert df.limit(2).agg(types.sample_skewness("a"), types.sample_kurtosis("a")).first() == (None, None)


# relational
def test_subtotals_differ_from_nulls_and_ties_are_ordered(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "g string, v int")
    got = {(r.g, r.level): r.v_sum for r in relational.aggregate(df, ["g"], ["v"], ["sum"], mode="rollup").collect()}
    assert got == {("a", 0): 4, (None, 0): 2, (None, 1): 6}
    assert [r.g for r in relational.aggregate(spark.createDataFrame([("b", 1), ("a", 1)], "g string, v int"), ["g"], ["v"], ["sum"], limit=5).collect()] == ["a", "b"]
    assert relational.aggregate(df.limit(0), ["g"], ["v"], ["sum"]).collect() == []


def test_top_with_remainder_closes(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(10)] + [(None, -50.0)], "k string, v double")
    got = {(r.k, r.is_top): (r.v, r.members) for r in relational.top_with_remainder(df, "k", "v", 2).collect()}
    assert got == {(None, True): (-50, 1), ("k9", True): (9, 1), ("(other)", False): (36, 9)}


def test_plans_push_filters_and_prune(spark, tmp_path):
    spark.range(100).selectExpr("id a", "id b", "id c").write.parquet(str(tmp_path / "t"))
    df = relational.aggregate(readers.read(spark, str(tmp_path / "t")), ["a"], ["b"], ["sum"], "b > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,5)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_profile_and_top_values(spark):
    df = spark.range(1000).selectExpr("id order_id", "case when id % 2 = 0 then 'x' else 'y' end region", "id * 1.0 revenue", "case when id % 20 = 0 then null else 0.1 end discount")
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert got["discount"].n_null == 50 and got["revenue"].semantic_type == "MEASURE" and got["revenue"].p50 == 499.5 and got["region"].n_distinct == 2
    assert profile.quality_score(profile.profile(df)).first().score == 100
    tops = [(r.value, r.n, r.place) for r in profile.top_values(df, ["region"], 1).collect()]
    assert tops == [("x", 500, 1)]
    assert {r.n_rows for r in profile.profile(df.limit(0)).collect()} == {0}


# transforms and quality
def test_clean(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (1, 10.0, "a"), (2, None, "b"), (3, 9999.0, None)], "id int, amount double, tag string")
    got = sorted(tuple(r) for r in transform.clean(df, {"amount": "MEDIAN", "tag": "MODE"}, {"amount": (None, 100.0)}, ["id"]).collect())
    assert got == [(1, 10.0, "a"), (2, 10.0, "b"), (3, 100.0, "a")]
    assert transform.clean(df.filter("id = 2"), {"amount": "MEAN"}).first().amount == 0.0
    for bad in ({"fill": {"nope": 1}}, {"fill": {"amount": True}}, {"clip": {"amount": (2.0, 1.0)}}):
        with pytest.raises(ValueError):
            transform.clean(df, **bad)
    assert transform.clean(df.limit(0), {"amount": "MEAN"}, dedup=["id"]).collect() == []


def test_wide_join_renames(spark):
    fact = spark.createDataFrame([(1, 5)], "id int, age int")
    dim = spark.createDataFrame([(1, 7, "x")], "id int, age int, city string")
    out = transform.wide_join(fact, [("dimu", dim, "fact.id = dimu.id"), ("dim2", dim, "fact.id = dim2.id")])
    assert out.columns == ["id", "age", "dimu_id", "dimu_age", "city", "dim2_id", "dim2_age", "dim2_city"]


def test_versions_merge_and_roll_back(spark, tmp_path):
    (tmp_path / "t").mkdir()
    t = transform.VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, 10), (2, 20)], "id int, v int"), "id")
    t.write(spark.createDataFrame([(2, 99), (3, 30)], "id int, v int"), "id")
    assert sorted(tuple(r) for r in t.current().collect()) == [(1, 10), (2, 99), (3, 30)]
    with pytest.raises(guard.GuardError):
        t.write(spark.createDataFrame([(2,)], "other int"), "id")
    t.rollback()
    assert sorted(tuple(r) for r in t.current().collect()) == [(1, 10), (2, 20)]


def test_model_graph(spark, tmp_path):
    g = transform.ModelGraph(spark, str(tmp_path))
    g.add(transform.Model("ma", "select 1 as x"))
    g.add(transform.Model("mb", "with q as (select * from ma) select * from q"))
    g.add(transform.Model("mc", "select * from mb join other on true", "table"))
    assert g.models["mb"].depends_on == ["ma"] and g.stages() == [["ma"], ["mb"], ["mc"]] and g.downstream("ma") == ["mb", "mc"]
    assert g.run(["mb"]) == ["ma", "mb"]
    g.add(transform.Model("ma", "select * from mc"))
    with pytest.raises(ValueError, match="circle"):
        g.stages()


def test_suite_and_drift(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (None, 50.0)], "id int, v double")
    a = quality.Assertion
    got = [(r.failures, r.passed) for r in quality.run_suite(df, [a("not_null", "id"), a("unique", "id"), a("unique", "id", nulls_repeat=False), a("between", "v", 0, 10), a("row_count", low=1, high=2), a("odd", "v")]).orderBy("place").collect()]
    assert got == [(1, False), (2, False), (1, False), (1, False), (1, False), (1, False)]
    assert quality.schema_drift(df, {"id": "INTEGER", "v": "bigint", "w": "text"}) == [("removed", "w", "string", ""), ("retyped", "v", "bigint", "double")]
    assert quality.context_health([], {}, ["m"], ["g"])["score"] == 100
    assert quality.context_health([{"operator": "sql", "tables": ["t"], "governed": False, "warnings": ["w"]}], {"t": "draft"}, [], [])["score"] == 15


# events
def test_funnel_is_a_set_and_can_be_ordered(spark):
    rows = [("u1", "a", 1), ("u1", "b", 2), ("u1", "c", 3), ("u2", "b", 1), ("u2", "a", 2), ("u3", "b", 1), (None, "a", 1), ("u1", "a", 1)]
    df = spark.createDataFrame(rows, "user_id string, event_name string, t int")
    assert [r.users for r in events.funnel(df, ["a", "b", "c"]).collect()] == [2, 2, 1]
    assert [r.users for r in events.funnel(df, ["a", "b", "c"], at="t", ordered=True).collect()] == [2, 1, 1]
    assert [(r.users, r.rate_from_first) for r in events.funnel(df.limit(0), ["a", "b"]).collect()] == [(0, 0.0), (0, 0.0)]


def test_flow_across_ranges_of_a_hot_session(spark):
    rng = __import__("random").Random(1)
    rows = [("hot", k, rng.choice("abc")) for k in range(400)] + [(f"s{k}", t, rng.choice("abc")) for k in range(30) for t in range(5)] + [(None, 1, "a"), ("hot", None, "a"), ("x", 1, None)]
    by: dict = {}
    for s, t, p in rows:
        if s is not None and p is not None:
            by.setdefault(s, []).append((-1 if t is None else t, p))
    want: dict = {}
    for steps in by.values():
        steps.sort()
        for (_, a), (_, b) in zip(steps, steps[1:]):
            if a != b:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "s string, t int, p string")
    assert {(r.source, r.target): r.n for r in events.flow(df, "s", "p", "t").collect()} == want
    assert events.flow(df.limit(0), "s", "p", "t").collect() == []


def test_top_per_group(spark):
    df = spark.createDataFrame([("hot", k % 97) for k in range(500)] + [("b", 1), (None, 3), (None, 4)], "g string, v int")
    got = {}
    for r in relational.top_per_group(df, ["g"], [F.col("v").desc()], 3).collect():
        got.setdefault(r.g, []).append((r.place, r.v))
    assert {g: sorted(x) for g, x in got.items()} == {"hot": [(1, 96), (2, 96), (3, 96)], "b": [(1, 1)], None: [(1, 4), (2, 3)]}


# semantic layer, ontology, catalogue
@pytest.fixture
def store(spark):
    f = spark.createDataFrame
    s = semantic.Store(spark, {
        "u_customers": f([(1, "e"), (2, "w")], "customer_id int, region string"), "u_lines": f([(1, 1, "s"), (2, 1, "t")], "line_id int, order_id int, sku string"),
        "u_orders": f([(1, 1, 10.0, 1, 2), (2, 2, 5.0, 2, 1), (3, None, 1.0, 1, 1)], "order_id int, customer_id int, amount double, buyer_id int, seller_id int"), "u_desks": f([(1, "n"), (2, "s")], "desk_id int, desk string"),
        "u_daily": f([("2024-01-01", 10.0), ("2024-01-03", 5.0)], "order_date string, amount double").withColumn("order_date", F.to_date("order_date")),
    })
    e = semantic.Entity
    s.add_model(semantic.Model("customers", "u_customers", [e("customer", "customer_id", True)], ["region"]))
    s.add_model(semantic.Model("desks", "u_desks", [e("buyer", "desk_id", True), e("seller", "desk_id", True)], ["desk"]))
    s.add_model(semantic.Model("orders", "u_orders", [e("order", "order_id", True), e("customer", "customer_id"), e("buyer", "buyer_id"), e("seller", "seller_id")]))
    s.add_model(semantic.Model("lines", "u_lines", [e("order", "order_id")], ["sku"]))
    s.add_model(semantic.Model("daily", "u_daily", [], [], "order_date"))
    s.add_metric(semantic.Metric("revenue", "orders", "sum(amount)"))
    s.add_metric(semantic.Metric("people", "customers", "count(*)"))
    s.add_metric(semantic.Metric("daily_sum", "daily", "sum(amount)"))
    s.add_metric(semantic.Metric("so_far", kind="cumulative", inputs=("daily_sum",)))
    s.add_metric(semantic.Metric("each", kind="ratio", inputs=("revenue", "people")))
    return s


def test_governed_queries(store):
    got = {r.region: (r.revenue, r.people) for r in store.query(["revenue", "people"], ["region"]).collect()}
    assert got == {"e": (10, 1), "w": (5, 1), None: (1, None)}
    with pytest.raises(semantic.SemanticError, match="multiply"):
        store.query(["revenue"], ["sku"])
    with pytest.raises(semantic.SemanticError, match="more than one way"):
        store.query(["revenue"], ["desk"])
    assert [r.so_far for r in store.query(["so_far"], ["order_date"]).orderBy("order_date").collect()] == [10, 10, 15]
    assert store.query(["each"]).first().each == 8
    with pytest.raises(semantic.SemanticError):
        store.query(["revenue"], endorsed_only=True)


def test_definitions_round_trip(store):
    text, versions = store.export(), {n: m.version() for n, m in store.metrics.items()}
    other = semantic.Store(store.spark, store.tables)
    other.load(text)
    assert {n: m.version() for n, m in other.metrics.items()} == versions
    other.load("semantic_models: [{name: x, model: u_orders, measures: [{name: total, agg: sum, expr: amount}]}]\nmetrics: [{name: t2, type: simple, type_params: {measure: total}}]")
    assert other.query(["t2"]).first().t2 == 16


def test_traversal_and_actions(spark, tmp_path):
    f = spark.createDataFrame
    o = ontology.Ontology(spark, {"s": f([(1, "a"), (2, "b")], "id int, n string"), "p": f([(10, 1), (11, 1), (12, 2)], "pid int, sid int"), "j": f([(10, 100), (10, 100), (11, 101)], "a int, b int"), "i": f([(100,), (101,)], "iid int"), "e": f([(1, None), (2, 1), (3, 2), (4, 1)], "id int, boss int")}, str(tmp_path / "edits"))
    for n, t, k in (("S", "s", "id"), ("P", "p", "pid"), ("I", "i", "iid"), ("E", "e", "id")):
        o.add_object(ontology.ObjectType(n, t, k, {"twice": f"{k} * 2"}))
    o.add_link(ontology.LinkType("buys", "S", "P", "id", "sid"))
    o.add_link(ontology.LinkType("items", "P", "I", "pid", "iid", "many_to_many", "j", "a", "b"))
    o.add_link(ontology.LinkType("leads", "E", "E", "id", "boss"))
    assert [h.count() for h in o.traverse("S", ["buys", "items"], "n = 'a'")] == [2, 2]
    assert [sorted(r.key for r in h.collect()) for h in o.traverse("E", ["leads", "leads"], "id = 1")] == [[2, 4], [3]]
    with pytest.raises(ontology.OntologyError):
        o.traverse("S", ["buys", "buys"])
    assert {tuple(r) for r in o.query("S", ["twice"], "id = 2").collect()} == {(2, 4)}
    o.actions["fix"] = ontology.ActionType("fix", "S", {"n": "string", "k": "integer"})
    for bad in ({"n": "x"}, {"n": "x", "k": "1"}, {"n": "x", "k": True}, {"n": "x", "k": 1, "z": 2}):
        with pytest.raises(ontology.OntologyError):
            o.execute("fix", "S-1", bad)
    assert o.execute("fix", "S-1", {"n": "x", "k": 1}, dry_run=True)["dry_run"] and not o.audit
    o.execute("fix", "S-1", {"n": "x", "k": None})
    assert sorted((r.column_name, r.new_value) for r in spark.read.parquet(str(tmp_path / "edits")).collect()) == [("k", None), ("n", "x")]
    with pytest.raises(ontology.OntologyError):
        o.remove_object("S")
    assert o.graph()["broken"] == []


def test_catalog_and_trail(spark, tmp_path):
    c = catalog.Catalog(str(tmp_path / "c.db"))
    c.register("t", [("a", "int")], "orders of the day", ["x"])
    c.endorse("t", "endorsed")
    c.register("t", [("a", "int")], "orders")
    assert catalog.Catalog(str(tmp_path / "c.db")).status("t") == "endorsed" and c.search("ORDERS")[0]["name"] == "t"
    assert c.record_lineage(spark, "v", "select * from t") == ["t"] and c.record_lineage(spark, "w", "select * from v") == ["v"] and c.impact("t") == ["v", "w"]
    assert c.check(["t", "u"]) == ["u is not registered"]
    c.endorse("t", "deprecated")
    with pytest.raises(guard.GuardError):
        c.check(["t"])
    trail = catalog.Trail({"add": lambda a, b: a + b["x"]})
    assert trail.run("add", a=1, b={"x": 2}) == 3
    assert trail.replay(trail.export("p"), {0: {"b": {"x": 10}}}) == [11] and len(trail.steps) == 2


def test_words_and_charts():
    assert narrative.change_text("Sales", 10, 12) == "Sales rose from 10.00 to 12.00 (+20.0%)."
    assert "can't" in narrative.change_text("Sales", None, 1)
    assert narrative.waterfall(10, {"a": 5, "b": -3}, 12)["gap"] == 0


# sources and sinks
def test_csv_json_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    assert sorted(tuple(r) for r in readers.read(spark, str(tmp_path / "a.csv"), columns=["b"], where="a > 1").collect()) == [("y",)]
    (tmp_path / "b.csv").write_text("a,b\n1,x\nz,y\n")
    with pytest.raises(readers.SourceError, match="don't fit"):
        readers.read(spark, str(tmp_path / "b.csv"), schema="a int, b string")
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read(spark, str(tmp_path / "a.json")).count() == readers.read(spark, str(tmp_path / "a.jsonl")).count() == 2
    for bad in ("x.xls", "x.foo", "ftp://h/x"):
        with pytest.raises(readers.SourceError):
            readers.read(spark, bad)


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "d.db")
    df = spark.createDataFrame([(1, 1.5, "a", Decimal("12345678901234567890.12"), True), (None,) * 5], "i long, d double, s string, m decimal(38,2), b boolean")
    assert writers.write(df, f"sqlite:///{path}", "t") == 2 and writers.write(df.limit(1), f"sqlite:///{path}", "t", "append") == 1
    got = readers.read(spark, path, "t").collect()
    assert len(got) == 3 and got[0].m == "12345678901234567890.12" and got[0].i == 1
    assert readers.read(spark, path, "select i from t where i is not null").count() == 2
    with pytest.raises(readers.SourceError):
        readers.read(spark, path, "select 1; drop table t")
    with pytest.raises(guard.GuardError):
        readers.read(spark, path, 't" --')
    assert sqlite3.connect(path).execute("select count(*) from t").fetchone() == (3,)


def xlsx(path, rows, shared=()):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx(path, '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>d</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="D2" t="b"><v>1</v></c></row><row><c r="A3"><v>3</v></c><c r="D3" t="s"><v>1</v></c></row>', ["n", "x"])
    df = readers.read(spark, path)
    assert df.columns == ["n", "n_2", "col_3", "d"] and dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["n_2"] == "double"
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, None, "True"), (3, None, None, "x")]
    with pytest.raises(readers.SourceError, match="no sheet"):
        readers.read(spark, path, "Two")


def test_traces(spark, tmp_path):
    span = {"traceId": "t1", "spanId": "s1", "name": "GET", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000120000000", "attributes": [{"key": "http.route", "value": {"stringValue": "/cart"}}, {"key": "n", "value": {"intValue": "5"}}]}
    (tmp_path / "o.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "checkout"}}]}, "scopeSpans": [{"spans": [span]}]}]}))
    r = readers.read_traces(spark, str(tmp_path / "o.json"), "2025-01-01T00:00:00").first()
    assert (r.service_name, r.duration_ms, r.page_path, r.timestamp_ms) == ("checkout", 120.0, "/cart", 1_700_000_000_000) and json.loads(r.properties)["n"] == "5"
    (tmp_path / "e.json").write_text(json.dumps({"events": [{"event_name": "a", "odd": 7}, {"event_name": "b", "odd": None}]}))
    got = readers.read_traces(spark, str(tmp_path / "e.json"), "2025-01-01T00:00:00").orderBy("event_name").collect()
    assert got[0].properties == '{"odd":"7"}' and got[0].created_at == "2025-01-01T00:00:00Z" and got[0].event_id != got[1].event_id


def test_documents_and_filters():
    names, rows = readers.normalised_documents([{"a": 1, "b": {"x": [1]}}, {"a": None, "c": Decimal("1.10")}])
    assert names == ["a", "b", "c"] and rows[0]["b"] == '{"x": [1]}' and rows[1]["c"] == Decimal("1.10")
    with pytest.raises(readers.SourceError, match="mixes"):
        readers.normalised_documents([{"a": 1}, {"a": "x"}])
    with pytest.raises(readers.SourceError):
        readers.normalised_documents([{"a": Decimal("1" * 39)}])
    with pytest.raises(readers.SourceError):
        readers.check_filter({"a": [{"$where": "x"}]})


def test_audience_webhooks_and_pushes(spark):
    df = spark.createDataFrame([(1, "e"), (2, "e"), (3, "w")], "id int, region string")
    assert writers.audience(df, "region = 'e'", ["id"], 1) == {"total": 2, "rows": [{"id": 1}], "truncated": True}
    assert writers.webhook_body("slack", "T", "x")["text"] == "*T*\nx"
    waits = []
    assert writers.push({"a": 1}, lambda b: False, 3, waits.append) == {"status": "FAILED", "attempts": 3, "body": {"a": 1}} and waits == [0.5, 1.0]


# the repository as a whole
def test_core_stands_without_the_text_operators():
    code = "import sys; sys.modules['tallyspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p8_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True).returncode == 0
    named = [p for p in (REPO / "tallyspark").rglob("*.py") if "llm" not in p.parts and "tallyspark.llm" in p.read_text()]
    assert named == []


