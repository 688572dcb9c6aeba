"""Writers: files, databases, audiences and webhook bodies."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable
from decimal import Decimal
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.engine import guard


class SinkError(ValueError):
    """The destination can't be written."""


def write(df: DataFrame, uri: str, table: str | None = None, mode: str = "replace", block: int = 50_000) -> int | None:
    """Writes a frame to a folder (.parquet, .csv), a SQLite file or a database; rows where they are counted on the way."""
    if mode not in ("replace", "append"):
        raise SinkError("modes are replace and append")
    scheme = urlparse(uri).scheme.lower()
    if scheme == "sqlite":
        return write_sqlite(df, uri.split("://", 1)[1].removeprefix("/") if not uri.startswith("sqlite:////") else uri[len("sqlite:///"):], table or "", mode, block)
    if scheme in ("postgres", "postgresql", "mysql", "mssql"):
        return write_jdbc(df, uri, table or "", mode, block)
    path = uri.removeprefix("file://")
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if mode != "replace":
        raise SinkError("files are replaced only")
    if ending == ".csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif ending in (".parquet", ""):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        raise SinkError(f"don't know how to write {ending!r}")
    return None


def _sqlite_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "INTEGER"
    return "REAL" if isinstance(kind, T.FloatType | T.DoubleType) else "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "replace", block: int = 50_000) -> int:
    """One transaction into a local SQLite file, partition by partition; decimals keep their digits as text."""
    guard.identifier(table)
    names = ", ".join('"' + f.name.replace('"', '""') + f'" {_sqlite_type(f.dataType)}' for f in df.schema.fields)
    n = 0
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("PRAGMA journal_mode = WAL")
        db.execute("BEGIN")
        if mode == "replace":
            db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
        plain = lambda v: str(v) if isinstance(v, Decimal) or not isinstance(v, bool | int | float | str | bytes | bytearray | type(None)) else v
        rows: list[tuple] = []
        put = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'
        for row in df.toLocalIterator():
            rows.append(tuple(map(plain, row)))
            n += 1
            if len(rows) >= block:
                db.executemany(put, rows)
                rows = []
        db.executemany(put, rows)
        db.execute("COMMIT")
    except BaseException:
        if db.in_transaction:
            db.execute("ROLLBACK")
        raise
    finally:
        db.close()
    return n


def write_jdbc(df: DataFrame, uri: str, table: str, mode: str, block: int) -> None:
    """Over JDBC in parallel batches; replacing truncates the table in place. The driver jar must be present."""
    parts = urlparse(uri)
    kind = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mssql": "sqlserver"}[parts.scheme]
    host = f"{parts.hostname}" + (f":{parts.port}" if parts.port else "")
    url = f"jdbc:sqlserver://{host};databaseName={parts.path.lstrip('/')}" if kind == "sqlserver" else f"jdbc:{kind}://{host}/{parts.path.lstrip('/')}"
    writer = df.write.format("jdbc").option("url", url).option("dbtable", guard.table_name(table)).option("batchsize", block).option("truncate", True)
    for k, v in (("user", parts.username), ("password", parts.password)):
        if v:
            writer = writer.option(k, v)
    writer.mode("overwrite" if mode == "replace" else "append").save()


def audience(df: DataFrame, where: str | None, columns: list[str], limit: int = 1000) -> dict:
    """{total, rows, truncated}: total counts all matches, rows holds at most ``limit``."""
    hit = df.filter(guard.predicate(df.sparkSession, where)) if where else df
    guard.columns(df, columns)
    rows = hit.select(*[guard.quoted(c) for c in columns]).limit(limit + 1).collect()
    total = len(rows) if len(rows) <= limit else hit.count()
    return {"total": total, "rows": [r.asDict() for r in rows[:limit]], "truncated": total > limit}


def webhook_body(kind: str, title: str, text: str) -> dict:
    """The message body that a chat service takes."""
    bodies = {
        "feishu": {"msg_type": "post", "content": {"post": {"zh_cn": {"title": title, "content": [[{"tag": "text", "text": text}]]}}}},
        "dingtalk": {"msgtype": "markdown", "markdown": {"title": title, "text": f"### {title}\n{text}"}},
        "slack": {"text": f"*{title}*\n{text}"},
        "wecom": {"msgtype": "markdown", "markdown": {"content": f"**{title}**\n{text}"}},
        "generic": {"title": title, "text": text},
    }
    if kind not in bodies:
        raise SinkError(f"kinds are {sorted(bodies)}")
    return bodies[kind]


def push(body: dict, send: Callable[[dict], bool], attempts: int = 3, wait: Callable[[float], None] | None = None) -> dict:
    """Sends through the given function, trying again after 0.5, 1, 2 ... seconds; a failure keeps the body."""
    import time

    for k in range(attempts):
        try:
            if send(body):
                return {"status": "SENT", "attempts": k + 1}
        except OSError:
            pass
        if k + 1 < attempts:
            (wait or time.sleep)(0.5 * 2**k)
    return {"status": "FAILED", "attempts": attempts, "body": body}
