"""Mixed timestamp notations and time zones into one UTC instant.

Each value is tokenised into a shape mask of character classes (digit, letter, other characters as they are). All values
of one mask have the same length and the same places for the same fields, so each distinct mask is turned into a parser
once per worker, and the parser reads the whole group by slicing a character matrix. Wall times are converted through
transition tables of the zone database (``functions.zones``). The order of day and month in slashed dates is decided per
contract by votes of all its rows, which are combined on the map side; rows join contracts by their id and are never
grouped by it. All workers must have the driver's version of the zone database; one that differs raises.

Defined results: null, blank, impossible and unrecognised values, zero and negative numbers, wall times that never occur,
unknown zones, unknown abbreviations and rows without contract or event id give no row; a wall time that occurs twice is
the earlier instant; absent digits are zero, digits beyond microseconds are cut off; a repeated event is one row (the
least instant, should its rows differ). Where no value of a contract tells the order of day and month, the reading
nearer to ingestion is taken over all its rows, month first in a tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.zones import NEVER, database_version, zone_table

MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Bounds of plausible epoch numbers, in seconds: 2022 to the end of 2027, with a day on either side.
EPOCH_FROM, EPOCH_TO = 1_640_908_800, 1_830_384_000
TIME_COLUMNS = ("created_at", "event_date", "timestamp_ms")
#: Contracts up to which their terms are broadcast; beyond, rows join them by a shuffle.
BROADCAST_CONTRACTS = 50_000
_CLOCK = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_TAIL = rf"(?:(?:[Tt]| +){_CLOCK}(?: ?(?P<ap>[AaPp][Mm]))?(?:(?P<z>[Zz])| ?(?P<abbr>[A-Za-z]{{2,5}})?(?:(?P<sign>[+-])(?P<zh>9{{1,2}})(?::?(?P<zm>99))?)?)?)?$"
_FORMS = [
    ("ymd", rf"^(?P<y>9999)(?P<sep>[-/.])(?P<mo>9{{1,2}})(?P=sep)(?P<d>9{{1,2}}){_TAIL}"),
    ("ymd", rf"^(?P<y>9999)年(?P<mo>9{{1,2}})月(?P<d>9{{1,2}})日(?: *(?P<cn>[上下]午)?{_CLOCK})?$"),
    ("slash", rf"^(?P<a>9{{1,2}})/(?P<b>9{{1,2}})/(?P<y>99(?:99)?){_TAIL}"),
    ("dmy", rf"^(?P<d>9{{1,2}})\.(?P<mo>9{{1,2}})\.(?P<y>99(?:99)?){_TAIL}"),
    ("compact", rf"^(?P<y>9999)(?P<mo>99)(?P<d>99)(?:[Tt ]?(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?(?:(?P<z>[Zz])|(?P<sign>[+-])(?P<zh>99):?(?P<zm>99)?)?)?$"),
    ("dmony", rf"^(?:[A-Za-z]{{3,9}}, ?)?(?P<d>9{{1,2}})[- ](?P<mon>[A-Za-z]{{3,9}})[- ](?P<y>9999){_TAIL}"),
    ("dmony", rf"^(?P<mon>[A-Za-z]{{3,9}}) (?P<d>9{{1,2}}), ?(?P<y>9999){_TAIL}"),
]
_COMPILED = [(k, re.compile(p)) for k, p in _FORMS]
_NUMBER = re.compile(r"^(?P<n>9{9,19})(?:\.(?P<f>9+))?$")


def shape_mask(text: str) -> str:
    """Digits as 9; every letter and mark as it is, for words of one mask share their length but not their letters."""
    return re.sub(r"[0-9]", "9", text)


@lru_cache(maxsize=20_000)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]], dict[str, str]] | None:
    """(kind, places of the digit fields, letter fields) of a mask, or None if it isn't a timestamp's."""
    m = _NUMBER.match(mask)
    if m and len(m["n"]) != 8:
        return "number", {k: m.span(k) for k in ("n", "f") if m[k]}, {}
    for kind, pattern in _COMPILED:
        if m := pattern.match(mask):
            fields = {k: m.span(k) for k, v in m.groupdict().items() if v and set(v) == {"9"}}
            words = {k: v for k, v in m.groupdict().items() if v and set(v) != {"9"}}
            if "mon" in words and words["mon"][:3].lower() not in MONTHS:
                continue
            return kind, fields, words
    return None


def _digits(chars: np.ndarray, place: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for k in range(*place):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _fraction(chars: np.ndarray, place: tuple[int, int], digits: int = 6) -> np.ndarray:
    width = min(place[1] - place[0], digits)
    return _digits(chars, (place[0], place[0] + width)) * 10 ** (digits - width)


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (mo >= 1) & (mo <= 12) & (y >= 1900) & (y <= 2200) & (d >= 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, mo, 1) - 1
    first = months.astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1, ok & (d <= length)


def _numbers(chars: np.ndarray, fields: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of epoch numbers whose unit is the one that puts them into the plausible years."""
    n = _digits(chars, fields["n"])
    out, ok = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    for scale in (1, 1_000, 1_000_000, 1_000_000_000):
        fits = ~ok & (n >= EPOCH_FROM * scale) & (n <= EPOCH_TO * scale)
        us = n * (1_000_000 // scale) if scale <= 1_000_000 else n // (scale // 1_000_000)
        if "f" in fields and scale < 1_000_000:
            us = us + _fraction(chars, fields["f"], 6 if scale == 1 else 3)
        out, ok = np.where(fits, us, out), ok | fits
    return out, ok


def parse_group(texts: np.ndarray, mask: str, zone: str, day_first: bool, as_date: bool) -> np.ndarray:
    """UTC microseconds of texts that share a mask, zone, order of day and month, and mode; NEVER where unreadable."""
    none = np.full(len(texts), NEVER, np.int64)
    parser, table = parser_of(mask), zone_table(zone)
    if parser is None or table is None:
        return none
    kind, fields, words = parser
    chars = np.ascontiguousarray(texts.astype(f"U{len(mask)}")).view(np.uint32).reshape(len(texts), len(mask))
    if kind == "number":
        us, ok = _numbers(chars, fields)
        if as_date:  # the day on which the instant falls in the zone
            k = np.searchsorted(table.starts, us // 1_000_000, side="right") - 1
            local = us + table.offsets[k] * 1_000_000
            us = table.to_utc(local - local % 86_400_000_000)
        return np.where(ok, us, NEVER)
    get = lambda k: _digits(chars, fields[k]) if k in fields else np.zeros(len(texts), np.int64)
    y = get("y")
    if "y" in fields and fields["y"][1] - fields["y"][0] == 2:
        y = y + 2000
    if kind == "slash":
        d, mo = (get("a"), get("b")) if day_first else (get("b"), get("a"))
    else:
        d, mo = get("d"), np.full(len(texts), MONTHS[words["mon"][:3].lower()], np.int64) if "mon" in words else get("mo")
    days, ok = _days(y, mo, d)
    h, mi, s = get("h"), get("mi"), get("s")
    half = words.get("ap", "").lower() or {"上午": "am", "下午": "pm"}.get(words.get("cn", ""), "")
    if half:
        ok &= (h >= (0 if words.get("cn") else 1)) & (h <= 12)
        h = h % 12 + (12 if half == "pm" else 0)
    ok &= (h <= 23) & (mi <= 59) & (s <= 59)
    midnight = days * 86_400_000_000
    if as_date:
        return np.where(ok, table.to_utc(midnight), NEVER)
    wall = midnight + (h * 3600 + mi * 60 + s) * 1_000_000 + (_fraction(chars, fields["f"]) if "f" in fields else 0)
    abbr = words.get("abbr", "").upper()
    if "zh" in fields:
        if abbr not in ("", "UTC", "GMT"):
            return none
        zh, zm = get("zh"), get("zm")
        ok &= (zh <= 18) & (zm <= 59)
        shift = (zh * 3600 + zm * 60) * (-1 if words["sign"] == "-" else 1)
        return np.where(ok, wall - shift * 1_000_000, NEVER)
    if "z" in words:
        return np.where(ok, wall, NEVER)
    if abbr:
        shift = table.offset_of(abbr, wall)
        if shift is None and abbr in ("UTC", "GMT"):
            shift = np.zeros(len(texts), np.int64)
        return none if shift is None else np.where(ok, wall - shift * 1_000_000, NEVER)
    return np.where(ok, table.to_utc(wall), NEVER)


def parse_batch(value: pd.Series, zone: pd.Series, day_first: pd.Series, as_date: pd.Series) -> pd.Series:
    """UTC microseconds of each value, null where unreadable."""
    text = value.fillna("").str.strip().str.replace(r"\s+", " ", regex=True)
    frame = pd.DataFrame({"mask": text.str.replace(r"[0-9]", "9", regex=True), "zone": zone.fillna(""), "day_first": day_first.fillna(False), "as_date": as_date.fillna(False)})
    out = np.full(len(text), NEVER, np.int64)
    raw = text.to_numpy(object)
    for (mask, z, first, dated), at in frame.groupby(["mask", "zone", "day_first", "as_date"], sort=False).indices.items():
        if mask and z:
            out[at] = parse_group(raw[at], mask, z, bool(first), bool(dated))
    return pd.Series(out, dtype="Int64").mask(out == NEVER)


def _slashed(value: Column) -> tuple[Column, Column, Column]:
    pattern = r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?:[^0-9].*)?$"
    a, b, y = (F.regexp_extract(value, pattern, k).try_cast("int") for k in (1, 2, 3))
    return a, b, F.when(y < 100, y + 2000).otherwise(y)


def _day_orders(rows: DataFrame) -> DataFrame:
    """(contract_id, day_first): the order of day and month in the contract's slashed dates."""
    a, b, y = _slashed(F.col("value"))
    dated = lambda d, m: F.abs(F.datediff(F.to_date("ingested_at"), F.make_date(y, m, d)))
    both = (a <= 12) & (b <= 12) & (a >= 1) & (b >= 1)
    nearer = F.when(both & F.col("ingested_at").isNotNull(), F.signum(dated(b, a) - dated(a, b)))
    votes = rows.filter(F.col("value").rlike(r"^\s*[0-9]{1,2}/")).groupBy("contract_id").agg(
        F.sum(F.when((a > 12) & (a <= 31) & (b <= 12), 1).when((b > 12) & (b <= 31) & (a <= 12), -1).otherwise(0)).alias("told"), F.coalesce(F.sum(nearer), F.lit(0)).alias("near")
    )
    return votes.select("contract_id", F.when(F.col("told") != 0, F.col("told") > 0).otherwise(F.col("near") > 0).alias("day_first"))


def event_instants(traces: DataFrame, contracts: DataFrame) -> DataFrame:
    """(event_id, utc_us): one UTC instant per event whose time can be read."""
    terms = contracts.select("contract_id", "time_column", "timezone", (F.col("input_mode") == "date").alias("as_date")).dropDuplicates(["contract_id"])
    small = terms.count() <= BROADCAST_CONTRACTS
    hint = F.broadcast if small else lambda df: df
    named = F.col("time_column")
    value = F.lit(None).cast("string")
    for c in TIME_COLUMNS:
        kind = dict(traces.dtypes)[c]
        text = F.col(c).cast("string") if kind in ("string", "bigint", "int") else F.col(c).cast("bigint").cast("string")
        value = F.when(named == c, text).otherwise(value)
    rows = traces.select("event_id", "contract_id", "ingested_at", *TIME_COLUMNS).filter("event_id is not null").join(hint(terms), "contract_id").select("event_id", "contract_id", "ingested_at", "timezone", "as_date", value.alias("value"))
    rows = rows.filter("value is not null and timezone is not null")
    ordered = rows.join(hint(_day_orders(rows)), "contract_id", "left").select("event_id", "value", "timezone", F.coalesce("day_first", F.lit(False)).alias("day_first"), F.coalesce("as_date", F.lit(False)).alias("as_date"))

    version = database_version()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if database_version() != version:
            raise RuntimeError(f"this worker's time zone database is {database_version()}, the driver's {version}")
        for b in batches:
            out = pd.DataFrame({"event_id": b["event_id"], "utc_us": parse_batch(b["value"], b["timezone"], b["day_first"], b["as_date"])})
            yield out[out["utc_us"].notna()]

    parsed = ordered.mapInPandas(convert, "event_id string, utc_us bigint")
    return parsed.groupBy("event_id").agg(F.min("utc_us").alias("utc_us"))
