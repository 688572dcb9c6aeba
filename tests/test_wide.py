import json
from datetime import datetime

import pytest

from tallyspark.operators import wide

EDITS = "instance_id string, column_name string, new_value string, executed_at timestamp_ntz, prefix int, position string, value double, name string"
ONTOLOGY = "object_name string, id_prefix string, primary_key_column string, properties_json string, cells int"


def ontology(spark):
    props = lambda *p: json.dumps([{"name": n, "data_type": t, "is_primary_key": n == "key"} for n, t in p])
    return spark.createDataFrame([
        ("Thing", "THG", "key", props(("key", "string"), ("label", "string"), ("size", "integer"), ("rate", "float"), ("on", "boolean"), ("at", "timestamp")), 1),
        ("Other", "OTH", "key", props(("key", "string"), ("size", "string")), 2), ("Broken", None, "key", None, 3),
    ], ONTOLOGY)


def edits(spark, *rows):
    return spark.createDataFrame([(i, c, v, t and datetime(2025, 1, t), 1, "x", 0.5, "clash") for i, c, v, t in rows], EDITS)


def found(spark, *rows):
    o = ontology(spark)
    return {(r.instance_id, r.column_name): r.value_text for r in wide.filled_cells(wide.wide_table(edits(spark, *rows), o), o).collect()}


def test_latest_edit_decides_in_loose_spelling(spark):
    got = found(spark, ("thg-1", " Label ", "old", 1), (" THG-1", "LABEL", " new ", 2), ("THG-1", "label", "older", 1), ("THG-1", "label", " new ", 2))
    assert got == {("THG-1", "label"): "new"}


def test_marker_or_unreadable_value_empties_the_cell(spark):
    rows = [("THG-1", "label", "x", 1), ("THG-1", "label", "N/A", 2), ("THG-1", "size", "5", 1), ("THG-1", "size", "5.5", 2), ("THG-1", "on", "yes", 1), ("THG-1", "on", None, 2)]
    o = ontology(spark)
    table = wide.wide_table(edits(spark, *rows), o).collect()
    assert len(table) == 1 and table[0].object_name == "Thing"
    assert [table[0][f"Thing__{c}"] for c in ("label", "size", "on")] == [None] * 3
    assert found(spark, *rows) == {}


@pytest.mark.parametrize("value, text", [
    ("1,234", "1234"), ("８１８９８", "81898"), ("482e0", "482"), ("-15.0", "-15"), ("+7", "7"), (" 3 ", "3"), ("1e", None), ("12/4", None), ("148641e-2", None), ("--", None), ("9" * 30, None), ("", None),
])
def test_integers(spark, value, text):
    assert found(spark, ("THG-1", "size", value, 1)).get(("THG-1", "size")) == text


@pytest.mark.parametrize("value, text", [
    ("¥3115.10", "3115.10"), ("$39,110.7", "39110.70"), ("７７９６．８９", "7796.89"), ("8646604e-2", "86466.04"), ("-.5", "-0.50"), ("12 345.6", "12345.60"), ("1.2.3", None), ("ca. 40", None), ("12,5x", None), ("2d", None),
])
def test_floats(spark, value, text):
    assert found(spark, ("THG-1", "rate", value, 1)).get(("THG-1", "rate")) == text


@pytest.mark.parametrize("value, text", [
    ("2025-11-18T09:45:54", "2025-11-18 09:45:54"), ("24.11.2025", "2025-11-24 00:00:00"), ("2025年6月1日", "2025-06-01 00:00:00"), ("20250326", "2025-03-26 00:00:00"), ("2025-03-23 00:09:37.120000", "2025-03-23 00:09:37"),
    ("2026/3/6 19:07", "2026-03-06 19:07:00"), ("2026-02-30", None), ("31.04.2025", None), ("2025-01-01 25:00", None), ("2025", None), ("Q3", None),
])
def test_timestamps(spark, value, text):
    assert found(spark, ("THG-1", "at", value, 1)).get(("THG-1", "at")) == text


def test_type_belongs_to_the_object(spark):
    assert found(spark, ("THG-1", "size", "07", 1), ("OTH-1", "size", "07", 1)) == {("THG-1", "size"): "7", ("OTH-1", "size"): "07"}


def test_nulls_unknown_names_ties_and_long_texts(spark):
    long = "x" * 200_000
    rows = [(None, "label", "a", 1), ("THG-2", None, "a", 1), ("THG-2", "label", "a", None), ("THG-2", "unknown", "a", 1), ("ZZZ-2", "label", "a", 1), ("THG-2", "key", "a", 1), ("THG-3", "label", "a", 1), ("THG-3", "label", "b", 1), ("THG-3", "label", None, 1), ("THG-4", "label", long, 1)]
    assert found(spark, *rows) == {("THG-3", "label"): "b", ("THG-4", "label"): long}


def test_empty(spark):
    assert found(spark) == {}
    none = spark.createDataFrame([], ONTOLOGY)
    assert wide.wide_table(edits(spark, ("THG-1", "label", "a", 1)), none).collect() == []
