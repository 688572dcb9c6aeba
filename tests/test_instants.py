from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tallyspark.functions import zones
from tallyspark.operators import instants

TRACES = "event_id string, contract_id long, created_at string, event_date string, timestamp_ms long, ingested_at timestamp_ntz, value string, timezone string"
CONTRACTS = "contract_id long, time_column string, input_mode string, timezone string, event_id string, value int"


def run(spark, rows, zone="Europe/Berlin", mode="aware_timestamp", column="created_at"):
    at = TRACES.split(", ").index(f"{column} {'long' if column == 'timestamp_ms' else 'string'}")
    data = []
    for k, v in enumerate(rows):
        row = [f"e{k:02d}", 1, None, None, None, datetime(2024, 1, 1), "clash", "clash"]
        row[at] = v
        data.append(tuple(row))
    c = spark.createDataFrame([(1, column, mode, zone, "x", 1)], CONTRACTS)
    got = {r.event_id: r.utc_us for r in instants.event_instants(spark.createDataFrame(data, TRACES), c).collect()}
    return [None if (u := got.get(f"e{k:02d}")) is None else datetime.fromtimestamp(u / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")[: -3 if u % 1000 == 0 else 26] for k in range(len(rows))]


@pytest.mark.parametrize("value, utc", [
    ("2024-03-31T01:23:24.629716Z", "2024-03-31 01:23:24.629716"), ("2023-12-26t19:20:02z", "2023-12-26 19:20:02.000"), ("  2025-10-26  00:35:12.255160 ", "2025-10-25 22:35:12.255160"), ("1737609927958", "2025-01-23 05:25:27.958"),
    ("10.11.2023 20:13", "2023-11-10 19:13:00.000"), ("Apr 18, 2024 3:14:43 PM CEST", "2024-04-18 13:14:43.000"), ("2026年5月22日 11:16:14", "2026-05-22 09:16:14.000"), ("2024年9月11日 下午10:01:39.635997", "2024-09-11 20:01:39.635997"),
    ("2025-06-27T19:09:19.781+0200", "2025-06-27 17:09:19.781"), ("1754696668044324", "2025-08-08 23:44:28.044324"), ("20260615T151751Z", "2026-06-15 15:17:51.000"), ("2023-09-14 03:41:29 GMT-5", "2023-09-14 08:41:29.000"),
    ("2023-01-02 15:15:38 GMT+5:30", "2023-01-02 09:45:38.000"), ("Fri, 20 Jun 2025 08:48:34 -0700", "2025-06-20 15:48:34.000"), ("1672543111.400", "2023-01-01 03:18:31.400"), ("1672567362470258000", "2023-01-01 10:02:42.470258"),
    ("20250326", "2025-03-25 23:00:00.000"), ("2023/01/02 08:33:09,426", "2023-01-02 07:33:09.426"), ("2-Jan-2023 07:54:13 UTC", "2023-01-02 07:54:13.000"), ("2024-10-27 02:30:00", "2024-10-27 00:30:00.000"), ("2024-10-27 02:30:00 CET", "2024-10-27 01:30:00.000"),
    ("2024-03-31 02:30:00", None), ("0000-00-00 00:00:00", None), ("2025-02-30", None), ("25:61", None), ("yesterday", None), ("", None), (None, None), ("-1", None), ("0", None), ("2024-01-01 10:00:00 XYZ", None), ("9" * 100_000, None), ("2024-11-31T08:00:00Z", None),
    ("12:5 2024", None), ("13/13/2024", None), ("1/1/24 13:00 PM", None),
])
def test_notations(spark, value, utc):
    assert run(spark, [value]) == [utc]


def test_order_of_slashed_dates_is_kept_within_a_contract(spark):
    assert run(spark, ["03/04/2024 10:00", "25/12/2024", "1/2/24 12:05 AM"], "UTC") == ["2024-04-03 10:00:00.000", "2024-12-25 00:00:00.000", "2024-02-01 00:05:00.000"]
    assert run(spark, ["03/04/2024 10:00", "12/25/2024"], "UTC") == ["2024-03-04 10:00:00.000", "2024-12-25 00:00:00.000"]


def test_ingestion_tells_the_order_where_no_value_does(spark):
    assert run(spark, ["02/01/2024", "01/02/2024 00:00"], "UTC")[0] == "2024-02-01 00:00:00.000"
    assert run(spark, ["03/01/2024", "04/01/2024"], "UTC") == ["2024-01-03 00:00:00.000", "2024-01-04 00:00:00.000"]


def test_days_are_midnights_of_the_zone(spark):
    assert run(spark, ["2024-07-01", "2024-07-01T23:30:00Z", "20 Apr 2026"], "America/New_York", "date") == ["2024-07-01 04:00:00.000", "2024-07-01 04:00:00.000", "2026-04-20 04:00:00.000"]


def test_numbers_in_a_long_column(spark):
    assert run(spark, [1742579965, 1742579965000, 20250326, None, 0, -5], "UTC", column="timestamp_ms") == ["2025-03-21 17:59:25.000", "2025-03-21 17:59:25.000", "2025-03-26 00:00:00.000", None, None, None]


def test_an_abbreviation_is_one_of_the_contracts_zone(spark):
    assert run(spark, ["2024-01-10 12:00:00 CST"], "Asia/Shanghai") == ["2024-01-10 04:00:00.000"]
    assert run(spark, ["2024-01-10 12:00:00 CST"], "America/Chicago") == ["2024-01-10 18:00:00.000"]


def test_repeats_unknown_contracts_and_empty_tables(spark):
    t = spark.createDataFrame([("a", 1, "2024-01-01T00:00:00Z", None, None, None, "v", "z")] * 3 + [("b", 2, "2024-01-01T00:00:00Z", None, None, None, "v", "z"), (None, 1, "2024-01-01", None, None, None, "v", "z"), ("c", None, "2024-01-01", None, None, None, "v", "z"), ("d", 3, "2024-01-01", None, None, None, "v", "z")], TRACES)
    c = spark.createDataFrame([(1, "created_at", "aware_timestamp", "UTC", "x", 1), (1, "created_at", "aware_timestamp", "UTC", "x", 1), (3, "created_at", "aware_timestamp", "No/Zone", "x", 1), (4, None, None, None, "x", 1)], CONTRACTS)
    assert [tuple(r) for r in instants.event_instants(t, c).collect()] == [("a", 1_704_067_200_000_000)]
    assert instants.event_instants(t.limit(0), c).collect() == [] and instants.event_instants(t, c.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["Europe/Berlin", "Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu", "Pacific/Apia", "America/Sao_Paulo"])
def test_zone_tables_agree_with_the_database(name):
    table, z = zones.zone_table(name), ZoneInfo(name)
    rng = np.random.default_rng(1)
    seconds = np.concatenate([rng.integers(0, 1_900_000_000, 300), *[table.starts[1:] + d for d in (-3601, -1, 0, 1, 3600)]])
    wall = [datetime.fromtimestamp(int(s), z).replace(tzinfo=None) for s in seconds if 0 < s < 3_000_000_000]
    us = np.array([int((w - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for w in wall])
    want = [int(w.replace(tzinfo=z, fold=0).timestamp()) * 1_000_000 for w in wall]
    assert table.to_utc(us).tolist() == want
    assert table.version


def test_old_and_late_dates_know_their_zone(spark):
    assert run(spark, ["1940-07-01 12:00:00", "1916-07-01 12:00:00", "2150-07-01 12:00:00", "x" * 500]) == ["1940-07-01 10:00:00.000", "1916-07-01 10:00:00.000", "2150-07-01 10:00:00.000", None]
