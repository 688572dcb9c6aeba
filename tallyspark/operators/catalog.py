"""Catalogue of tables with endorsement, persisted in SQLite, and the trail of analysis steps with playbooks."""

from __future__ import annotations

import copy
import json
import sqlite3
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tallyspark.engine import guard

STATUSES = ("draft", "endorsed", "deprecated")


class Catalog:
    """Assets by name; a file keeps them between runs, ':memory:' doesn't."""

    def __init__(self, path: str = ":memory:") -> None:
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS asset (name TEXT PRIMARY KEY, body TEXT NOT NULL, status TEXT NOT NULL, updated_at TEXT NOT NULL)")
        self.db.execute("CREATE TABLE IF NOT EXISTS lineage (target TEXT, source TEXT, PRIMARY KEY (target, source))")

    def register(self, name: str, columns: list[tuple[str, str]], description: str = "", tags: list[str] | None = None, status: str = "draft") -> None:
        if status not in STATUSES:
            raise ValueError(f"statuses are {STATUSES}")
        body = json.dumps({"columns": columns, "description": description, "tags": tags or []}, ensure_ascii=False)
        with self.db:
            self.db.execute("INSERT INTO asset VALUES (?, ?, ?, ?) ON CONFLICT(name) DO UPDATE SET body = excluded.body, updated_at = excluded.updated_at", (name, body, status, datetime.now(timezone.utc).isoformat()))

    def endorse(self, name: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"statuses are {STATUSES}")
        with self.db:
            if not self.db.execute("UPDATE asset SET status = ? WHERE name = ?", (status, name)).rowcount:
                raise KeyError(name)

    def delete(self, name: str) -> bool:
        with self.db:
            return self.db.execute("DELETE FROM asset WHERE name = ?", (name,)).rowcount > 0

    def search(self, text: str = "", status: str | None = None) -> list[dict]:
        """Assets whose name, description, tags or columns hold the text."""
        rows = self.db.execute("SELECT name, body, status FROM asset ORDER BY name").fetchall()
        return [{"name": n, "status": s, **json.loads(b)} for n, b, s in rows if (not status or s == status) and text.lower() in f"{n} {b}".lower()]

    def status(self, name: str) -> str | None:
        row = self.db.execute("SELECT status FROM asset WHERE name = ?", (name,)).fetchone()
        return row[0] if row else None

    def record_lineage(self, spark: SparkSession, target: str, sql: str) -> list[str]:
        """Sources of a target, read from its parsed query."""
        sources = guard.referenced_tables(spark, sql)
        with self.db:
            self.db.executemany("INSERT OR IGNORE INTO lineage VALUES (?, ?)", [(target, s) for s in sources])
        return sources

    def impact(self, name: str) -> list[str]:
        """Everything that depends on an asset, nearest first."""
        out, front = [], [name]
        while front:
            found = self.db.execute(f"SELECT DISTINCT target FROM lineage WHERE source IN ({','.join('?' * len(front))}) ORDER BY target", front).fetchall()
            front = [t for (t,) in found if t not in out and t != name]
            out += front
        return out

    def check(self, tables: list[str], endorsed_only: bool = False) -> list[str]:
        """Warnings for tables that aren't endorsed; deprecated ones, and all others with endorsed_only, are refused."""
        warnings = []
        for t in tables:
            s = self.status(t)
            if s == "deprecated" or endorsed_only and s != "endorsed":
                raise guard.GuardError(f"{t} is {s or 'not registered'}")
            if s != "endorsed":
                warnings.append(f"{t} is {s or 'not registered'}")
        return warnings


@dataclass
class Step:
    """One operator call."""

    operator: str
    parameters: dict
    tables: list[str] = field(default_factory=list)
    governed: bool = True
    warnings: list[str] = field(default_factory=list)


class Trail:
    """Steps in order; a playbook is their parameters, and replays with changes."""

    def __init__(self, operators: dict[str, Callable]) -> None:
        self.operators, self.steps = operators, []

    def run(self, operator: str, tables: list[str] | None = None, **parameters):
        if operator not in self.operators:
            raise KeyError(operator)
        result = self.operators[operator](**parameters)
        self.steps.append(Step(operator, copy.deepcopy(parameters), tables or []))
        return result

    def export(self, name: str) -> str:
        return json.dumps({"name": name, "steps": [asdict(s) for s in self.steps]}, ensure_ascii=False, default=str)

    def replay(self, playbook: str, changes: dict[int, dict] | None = None) -> list:
        """Runs the steps with the parameters of ``changes`` (by place) merged into theirs, nested ones too."""
        steps = json.loads(playbook)["steps"]
        return [self.run(s["operator"], s["tables"], **merged(s["parameters"], (changes or {}).get(k, {}))) for k, s in enumerate(steps)]


def merged(base: dict, change: dict) -> dict:
    """A copy of base with change laid over it; dictionaries merge, other values are replaced."""
    out = copy.deepcopy(base)
    for k, v in change.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
