"""Analysis sessions: isolated name spaces over one Spark application."""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyspark.engine.guard import GuardError

IDLE_SECONDS = 1800
_SECRET = re.compile(r"(?i)(://[^:/@\s]+:)[^@\s]+@|((?:password|passwd|pwd|token|secret)=)[^&;\s]+")


def redacted(source: str) -> str:
    """A source description without passwords."""
    return _SECRET.sub(lambda m: f"{m[1]}***@" if m[1] else f"{m[2]}***", source or "")


@dataclass
class Dataset:
    """A registered table."""

    name: str
    source: str
    columns: list[tuple[str, str]]
    size_bytes: int
    registered_at: float = field(default_factory=time.time)


class Session:
    """One caller's tables: temp views of a Spark session of their own."""

    def __init__(self, session_id: str, spark: SparkSession, memory_budget: int) -> None:
        self.id, self.spark, self.memory_budget = session_id, spark.newSession(), memory_budget
        self.datasets: dict[str, Dataset] = {}
        self.lock = threading.RLock()
        self.used_at = time.time()

    def register(self, name: str, df: DataFrame, source: str = "") -> Dataset:
        """Makes a frame of this session's Spark session a named table, within the session's budget of planned bytes."""
        if not name or len(name) > 128 or any(c in name for c in "'\";`") or any(ord(c) < 32 for c in name):
            raise GuardError(f"not a dataset name: {name!r}")
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        held = sum(d.size_bytes for n, d in self.datasets.items() if n != name and d.source == "")
        if not source and size < 1 << 60 and held + size > self.memory_budget:
            raise GuardError(f"the session may hold {self.memory_budget} bytes; {name} needs {size}")
        with self.lock:
            df.createOrReplaceTempView("`" + name + "`" if not re.match(r"^\w+$", name) else name)
            self.datasets[name] = Dataset(name, redacted(source), list(df.dtypes), size)
        return self.datasets[name]

    def table(self, name: str) -> DataFrame:
        if name not in self.datasets:
            raise GuardError(f"no dataset {name!r} in this session")
        self.used_at = time.time()
        return self.spark.table("`" + name + "`")

    def listing(self) -> list[dict]:
        return [{"name": d.name, "columns": len(d.columns), "bytes": d.size_bytes, "source": d.source} for d in sorted(self.datasets.values(), key=lambda d: d.name)]

    def close(self) -> None:
        for name in list(self.datasets):
            self.spark.catalog.dropTempView(name)
        self.datasets.clear()


class SessionManager:
    """Sessions by id; idle ones are closed by ``sweep``."""

    def __init__(self, spark: SparkSession, memory_budget: int = 4 << 30, idle_seconds: float = IDLE_SECONDS) -> None:
        self.spark, self.memory_budget, self.idle_seconds = spark, memory_budget, idle_seconds
        self._sessions: dict[str, Session] = {}
        self._lock = threading.RLock()

    def get(self, session_id: str) -> Session:
        """The session of an id, made if there is none."""
        if not 1 <= len(session_id) <= 128 or ".." in session_id or re.search(r"[/\\\x00-\x1f]", session_id):
            raise GuardError(f"not a session id: {session_id!r}")
        with self._lock:
            if session_id not in self._sessions:
                self._sessions[session_id] = Session(session_id, self.spark, self.memory_budget)
            session = self._sessions[session_id]
            session.used_at = time.time()
            return session

    def drop(self, session_id: str) -> bool:
        with self._lock:
            session = self._sessions.pop(session_id, None)
        if session:
            session.close()
        return session is not None

    def ids(self) -> list[str]:
        return sorted(self._sessions)

    def sweep(self, now: float | None = None) -> list[str]:
        """Closes sessions that were idle for too long; returns their ids."""
        now = time.time() if now is None else now
        old = [i for i, s in list(self._sessions.items()) if now - s.used_at > self.idle_seconds]
        for i in old:
            self.drop(i)
        return old
