"""Readers: files, databases and event traces as frames, chosen by the scheme of a URI."""

from __future__ import annotations

import os
import re
import sqlite3
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.engine import guard
from tallyspark.operators.events import TRACE_COLUMNS


class SourceError(ValueError):
    """The source can't be read."""


def read(spark: SparkSession, uri: str, target: str | None = None, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, **options) -> DataFrame:
    """A table, query or file; columns and where reach the scan where its format can use them."""
    scheme = urlparse(uri).scheme.lower()
    if len(scheme) <= 1 or scheme == "file":
        df = read_file(spark, uri.removeprefix("file://"), target, **options)
    elif scheme in CONNECTORS:
        df = CONNECTORS[scheme](spark, uri, target, **options)
    elif scheme in ("s3", "s3a", "hdfs", "gs", "abfss"):
        df = read_file(spark, uri, target, **options)
    else:
        raise SourceError(f"no connector for {scheme!r}; there are {sorted(CONNECTORS)}")
    if where:
        df = df.filter(guard.predicate(spark, where))
    if columns:
        df = df.select(*[guard.quoted(c) for c in guard.columns(df, columns)])
    return df if limit is None else df.limit(limit)


def read_file(spark: SparkSession, path: str, target: str | None = None, **options) -> DataFrame:
    """A file by its ending, or a SQLite or DuckDB database by its first bytes."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if os.path.isfile(path):
        with open(path, "rb") as f:
            head = f.read(16)
        if head.startswith(b"SQLite format 3"):
            return read_sqlite(spark, path, target)
        if head[8:12] == b"DUCK":
            return read_duckdb(spark, path, target)
    readers = {".parquet": read_parquet, ".csv": read_csv, ".tsv": lambda s, p, **o: read_csv(s, p, sep="\t", **o), ".json": read_json, ".jsonl": read_json, ".ndjson": read_json, ".orc": lambda s, p, **o: s.read.options(**o).orc(p)}
    if ending in readers:
        return readers[ending](spark, path, **options)
    if ending == ".xlsx":
        return read_xlsx(spark, path, target, **options)
    if ending == ".xls":
        raise SourceError("legacy .xls isn't read; save it as .xlsx")
    if os.path.isdir(path):
        return read_parquet(spark, path, **options)
    raise SourceError(f"don't know how to read {path!r}")


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With header; a row that doesn't fit fails the read with samples. Give a schema to avoid the inferring pass."""
    base = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **options}
    kind = T._parse_datatype_string(schema) if schema else spark.read.options(inferSchema=True, **base).csv(path).schema
    fields = T.StructType([f for f in kind.fields if f.name != "_corrupt"] + [T.StructField("_corrupt", T.StringType())])
    df = spark.read.options(**base).schema(fields).csv(path)
    # the whole rows are looked at, so that a short row isn't pruned into a good one
    bad = df.filter(F.col("_corrupt").isNotNull()).limit(5).collect()
    if bad:
        raise SourceError(f"rows that don't fit: {[r['_corrupt'] for r in bad]}")
    return df.drop("_corrupt")


def read_json(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """One object per line, or for .json an array."""
    reader = spark.read.options(multiLine=path.lower().endswith(".json"), **options)
    return (reader.schema(schema) if schema else reader).json(path)


def _one_select(target: str | None) -> str:
    if not target:
        raise SourceError("name a table or a SELECT")
    if re.match(r"(?is)^\s*(select|with)\b", target):
        if ";" in target.rstrip().rstrip(";"):
            raise SourceError("a single SELECT")
        return target.rstrip().rstrip(";")
    return f'SELECT * FROM "{guard.identifier(target)}"'


def read_sqlite(spark: SparkSession, path: str, target: str | None = None, block: int = 50_000) -> DataFrame:
    """A table or SELECT of a SQLite file, which is local by nature, through Arrow blocks."""
    import pyarrow as pa

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        cursor = db.execute(_one_select(target))
        names = [c[0] for c in cursor.description]
        columns: list[list] = [[] for _ in names]
        while rows := cursor.fetchmany(block):
            for c, values in zip(columns, zip(*rows, strict=True), strict=True):
                c += values
    finally:
        db.close()
    arrays = []
    for values in columns:
        kinds = {type(v) for v in values if v is not None}
        kind = pa.int64() if kinds <= {int} and kinds else pa.float64() if kinds and kinds <= {int, float} else pa.binary() if kinds == {bytes} else pa.string()
        arrays.append(pa.array([None if v is None else str(v) if kind == pa.string() else v for v in values], kind))
    return spark.createDataFrame(pa.table(dict(zip(names, arrays, strict=True))))


def read_duckdb(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    import duckdb

    with duckdb.connect(path, read_only=True) as db:
        return spark.createDataFrame(db.execute(_one_select(target)).fetch_arrow_table())


def read_jdbc(spark: SparkSession, uri: str, target: str | None = None, column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options) -> DataFrame:
    """A table or SELECT over JDBC, in parallel ranges of a column if bounds are given. The driver jar must be present."""
    parts = urlparse(uri)
    kinds = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mssql": "sqlserver", "sqlserver": "sqlserver"}
    kind = kinds[parts.scheme.split("+")[0]]
    host = f"{parts.hostname}" + (f":{parts.port}" if parts.port else "")
    url = f"jdbc:sqlserver://{host};databaseName={parts.path.lstrip('/')}" if kind == "sqlserver" else f"jdbc:{kind}://{host}/{parts.path.lstrip('/')}"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({_one_select(target)}) t" if re.match(r"(?is)^\s*(select|with)\b", target or "") else guard.table_name(target or ""))
    for k, v in ({"user": parts.username, "password": parts.password} | options).items():
        if v is not None:
            reader = reader.option(k, v)
    if column and bounds:
        reader = reader.option("partitionColumn", guard.identifier(column)).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", min(max(1, partitions), 256))
    return reader.load()


FIND_OPERATORS = frozenset("$eq $ne $gt $gte $lt $lte $in $nin $and $or $not $nor $exists $regex $options $size $all $elemMatch $type".split())


def check_filter(query) -> None:
    """Refuses document filters with other operators than FIND_OPERATORS."""
    if isinstance(query, dict):
        for k, v in query.items():
            if k.startswith("$") and k not in FIND_OPERATORS:
                raise SourceError(f"operator {k} isn't allowed")
            check_filter(v)
    elif isinstance(query, list):
        for v in query:
            check_filter(v)


def normalised_documents(documents: list[dict]) -> tuple[list[str], list[dict]]:
    """(names, rows) of documents: all keys in order of appearance, nested values as JSON text, mixed types refused."""
    import json
    from decimal import Decimal

    names: list[str] = []
    kinds: dict[str, type] = {}
    rows = []
    for d in documents:
        row = {}
        for k, v in d.items():
            if k not in names:
                names.append(k)
            if isinstance(v, dict | list):
                v = json.dumps(v, ensure_ascii=False, default=str, sort_keys=True)
            elif v is not None and not isinstance(v, bool | int | float | str | bytes | Decimal | datetime):
                v = str(v)
            if isinstance(v, Decimal) and len(v.as_tuple().digits) > 38:
                raise SourceError(f"{k} has a decimal of over 38 digits")
            if v is not None and kinds.setdefault(k, type(v)) is not type(v):
                raise SourceError(f"{k} mixes {kinds[k].__name__} and {type(v).__name__}")
            row[k] = v
        rows.append(row)
    return names, rows


def read_mongo(spark: SparkSession, uri: str, target: str | None = None, query: dict | None = None, **options) -> DataFrame:
    """A collection through the Mongo Spark connector, where it is installed."""
    import json

    check_filter(query or {})
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("collection", guard.identifier(target or ""))
    if query:
        reader = reader.option("aggregation.pipeline", json.dumps([{"$match": query}]))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _cell_column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None = None) -> list[list]:
    """The cells of a sheet by name (default the first): numbers, booleans, dates and text."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(f"{_REL}id") for s in book.iter(f"{_NS}sheet")}
        if sheet is not None and sheet not in sheets:
            raise SourceError(f"no sheet {sheet!r}; there are {list(sheets)}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[sheets[sheet] if sheet is not None else next(iter(sheets.values()))]
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            formats = styles.find(f"{_NS}cellXfs")
            for k, x in enumerate(formats if formats is not None else []):
                n = int(x.get("numFmtId", 0))
                if 14 <= n <= 22 or 45 <= n <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower()):
                    dated.add(k)
        root = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
        out = []
        for row in root.iter(f"{_NS}row"):
            cells: list = []
            for c in row.iter(f"{_NS}c"):
                at = _cell_column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is None or v.text is None or kind == "e":
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = v.text == "1"
                elif kind == "n":
                    x = float(v.text)
                    cells[at] = datetime(1899, 12, 30) + timedelta(days=x) if int(c.get("s", 0)) in dated else int(x) if x.is_integer() and "." not in v.text and "E" not in v.text.upper() else x
                else:
                    cells[at] = v.text
            out.append(cells)
        return out


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, **_) -> DataFrame:
    """A sheet with its first row as header: blank names become col_<n>, repeated ones get a suffix.

    A column is the widest of bool, int, float, datetime and text that its cells need.
    """
    import pyarrow as pa

    rows = sheet_rows(path, sheet)
    if not rows:
        return spark.createDataFrame([], "col_1 string")
    width = max(map(len, rows))
    names: list[str] = []
    for k in range(width):
        head = rows[0][k] if k < len(rows[0]) else None
        base = str(head).strip() if head not in (None, "") else f"col_{k + 1}"
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    arrays = []
    for k in range(width):
        values = [r[k] if k < len(r) else None for r in rows[1:]]
        kinds = {type(v) for v in values if v is not None}
        kind = pa.bool_() if kinds == {bool} else pa.int64() if kinds and kinds <= {bool, int} else pa.float64() if kinds and kinds <= {bool, int, float} else pa.timestamp("us") if kinds == {datetime} else pa.string()
        cast = {pa.int64(): int, pa.float64(): float, pa.string(): str}.get(kind, lambda v: v)
        arrays.append(pa.array([None if v is None else cast(v) for v in values], kind))
    return spark.createDataFrame(pa.table(dict(zip(names, arrays, strict=True))))


_SPAN = "traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, status struct<code:string>, attributes array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_OTLP = f"resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeSpans:array<struct<spans:array<struct<{_SPAN.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>>>>>"


def read_otlp(spark: SparkSession, path: str, ingested_at: str) -> DataFrame:
    """OTLP JSON spans in the trace schema; attributes are JSON in ``properties``."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    raw = spark.read.schema(_OTLP).option("multiLine", True).json(path)
    spans = raw.select(F.explode("resourceSpans").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.explode("s.spans").alias("x"))
    service = F.get(F.filter("ra", lambda a: a["key"] == "service.name"), F.lit(0))["value"]["stringValue"]
    attributes = F.map_from_entries(F.transform(F.coalesce("x.attributes", F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>")), lambda a: F.struct(a["key"], text(a["value"]))))
    start, end = F.col("x.startTimeUnixNano").cast("decimal(20,0)"), F.col("x.endTimeUnixNano").cast("decimal(20,0)")
    df = spans.withColumn("at", attributes).select(
        F.col("x.spanId").alias("event_id"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.col("x.parentSpanId").alias("parent_span_id"), F.col("at")["session.id"].alias("session_id"), F.col("at")["user.id"].alias("user_id"),
        F.lit("span").alias("event_type"), F.col("x.name").alias("event_name"), service.alias("service_name"), F.coalesce(F.col("at")["http.route"], F.col("at")["url.path"]).alias("page_path"), F.col("at")["url.full"].alias("page_url"), F.lit(None).cast("string").alias("page_title"),
        F.col("x.status.code").alias("status_code"), F.date_format(F.timestamp_micros((start / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.to_json("at").alias("properties"), ((end - start) / 1_000_000).cast("double").alias("duration_ms"), (start / 1_000_000).cast("long").alias("timestamp_ms"),
    )
    return _trace_defaults(df, ingested_at)


def trace_records(df: DataFrame, ingested_at: str) -> DataFrame:
    """Any frame of events in the trace schema; other columns are folded into ``properties`` as JSON."""
    known = {c: F.col(guard.quoted(c)).cast("double" if c == "duration_ms" else "long" if c == "timestamp_ms" else "string") for c in TRACE_COLUMNS if c in df.columns}
    rest = [c for c in df.columns if c not in TRACE_COLUMNS]
    kinds = {"duration_ms": "double", "timestamp_ms": "long"}
    if rest:
        folded = F.to_json(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(guard.quoted(c)).cast("string") for c in rest])), lambda k, v: v.isNotNull()))
        known["properties"] = F.coalesce(known.get("properties", F.lit(None).cast("string")), folded)
    return _trace_defaults(df.select(*[known.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in TRACE_COLUMNS]), ingested_at)


def _trace_defaults(df: DataFrame, ingested_at: str) -> DataFrame:
    """Ids and times that are missing: a hash of the row, and the ingestion time, which is a parameter."""
    stamp = F.lit(ingested_at).cast("timestamp_ntz")
    filled = df.withColumn("event_id", F.coalesce("event_id", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in TRACE_COLUMNS]), 256)))
    return filled.withColumns({
        "event_type": F.coalesce("event_type", F.lit("custom")), "created_at": F.coalesce("created_at", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "timestamp_ms": F.coalesce("timestamp_ms", F.unix_millis(F.coalesce(F.col("created_at").try_cast("timestamp"), stamp.cast("timestamp")))),
    }).select(*TRACE_COLUMNS)


def read_traces(spark: SparkSession, path: str, ingested_at: str) -> DataFrame:
    """OTLP JSON, an object with ``events``, or any file of events."""
    if path.lower().endswith(".json"):
        head = spark.read.option("multiLine", True).json(path)
        if "resourceSpans" in head.columns:
            return read_otlp(spark, path, ingested_at)
        if "events" in head.columns:
            return trace_records(head.select(F.inline("events")), ingested_at)
        return trace_records(head, ingested_at)
    return trace_records(read_file(spark, path), ingested_at)


CONNECTORS: dict[str, Callable[..., DataFrame]] = {
    "postgres": read_jdbc, "postgresql": read_jdbc, "mysql": read_jdbc, "mssql": read_jdbc, "sqlserver": read_jdbc, "mongodb": read_mongo, "mongodb+srv": read_mongo,
    "sqlite": lambda s, u, t=None, **o: read_sqlite(s, u.split("://", 1)[1].removeprefix("/") if not u.startswith("sqlite:////") else u[len("sqlite:///"):], t),
    "duckdb": lambda s, u, t=None, **o: read_duckdb(s, u.split("://", 1)[1], t),
}
