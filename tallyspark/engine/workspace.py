"""A workspace: one session with its catalogue, context and trail, in which operators run by name with evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tallyspark.engine import guard
from tallyspark.engine.evidence import Recorder
from tallyspark.engine.session import Session, SessionManager
from tallyspark.operators import attribution, insight, profile, quality, relational, stats, transform
from tallyspark.operators.catalog import Catalog, Step, Trail
from tallyspark.sinks import writers
from tallyspark.sources import readers


@dataclass
class Guide:
    """A piece of context: what an analyst should know about some tables or metrics."""

    name: str
    text: str
    about: tuple[str, ...] = ()
    status: str = "draft"


class Context:
    """Rules of a workspace and guides with endorsement; deprecated guides are never given."""

    def __init__(self) -> None:
        self.rules: list[str] = []
        self.guides: dict[str, Guide] = {}

    def register(self, guide: Guide) -> None:
        self.guides[guide.name] = guide

    def endorse(self, name: str, status: str) -> None:
        if status not in ("draft", "endorsed", "deprecated"):
            raise ValueError("draft, endorsed or deprecated")
        self.guides[name].status = status

    def resolve(self, subjects: list[str], endorsed_only: bool = False) -> dict:
        """The rules, and the guides about the subjects (or about nothing in particular), endorsed ones first."""
        fit = [g for g in self.guides.values() if g.status != "deprecated" and (g.status == "endorsed" or not endorsed_only) and (not g.about or set(g.about) & set(subjects))]
        return {"rules": list(self.rules), "guides": [{"name": g.name, "text": g.text, "status": g.status} for g in sorted(fit, key=lambda g: (g.status != "endorsed", g.name))]}


#: Operators that take a frame and keyword parameters and return a frame.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "profile": profile.profile, "aggregate": relational.aggregate, "pivot": relational.pivot, "top_values": profile.top_values, "correlation": stats.correlation, "clean": transform.clean, "trend": insight.trend,
    "dominance": insight.dominance, "simpson": stats.simpson, "moment_cells": attribution.moment_cells, "quality": quality.run_suite,
}


class Workspace:
    """Tables by name, operators by name, and a record of every step."""

    def __init__(self, manager: SessionManager | SparkSession, session_id: str = "default", catalog: Catalog | None = None) -> None:
        manager = manager if isinstance(manager, SessionManager) else SessionManager(manager)
        self.session: Session = manager.get(session_id)
        self.catalog, self.context = catalog or Catalog(), Context()
        self.trail = Trail({name: self._runner(name) for name in OPERATORS} | {"sql": lambda text, limit=100, endorsed_only=False: self._sql(text, limit, endorsed_only)})

    @property
    def spark(self) -> SparkSession:
        return self.session.spark

    def load(self, name: str, uri: str, target: str | None = None, **options) -> DataFrame:
        """Reads a source into a named table and registers it in the catalogue as a draft."""
        df = readers.read(self.spark, uri, target, **options)
        self._register(name, df, uri)
        return df

    def load_traces(self, name: str, path: str, ingested_at: str | None = None) -> DataFrame:
        """Reads event traces into a named table."""
        df = readers.read_traces(self.spark, path, ingested_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))
        self._register(name, df, path)
        return df

    def _register(self, name: str, df: DataFrame, source: str) -> None:
        self.session.register(name, df, source)
        self.catalog.register(name, list(df.dtypes))

    def run(self, operator: str, table: str, limit: int = 2500, **parameters) -> dict:
        """{rows, truncated, evidence, warnings} of an operator over a named table."""
        return self.trail.run(operator, [table], table=table, limit=limit, **parameters)

    def _runner(self, name: str) -> Callable[..., dict]:
        def call(table: str, limit: int = 2500, **parameters) -> dict:
            warnings = self.catalog.check([table])
            recorder = Recorder(name, OPERATORS[name].__doc__.split("\n")[0], **{k: v for k, v in parameters.items() if isinstance(v, str | int | float | list | dict | bool | None)})
            return self._result(recorder, OPERATORS[name](self.session.table(table), **parameters), limit, warnings)

        return call

    def sql(self, text: str, limit: int = 100, endorsed_only: bool = False) -> dict:
        """A single reading statement over the session's tables, marked as ungoverned."""
        result = self.trail.run("sql", guard.referenced_tables(self.spark, text), text=text, limit=limit, endorsed_only=endorsed_only)
        self.trail.steps[-1].governed = False
        return result

    def _sql(self, text: str, limit: int, endorsed_only: bool) -> dict:
        warnings = self.catalog.check(guard.referenced_tables(self.spark, guard.read_only(self.spark, text)), endorsed_only)
        return self._result(Recorder("sql", "ungoverned_sql"), self.spark.sql(text), limit, warnings)

    @staticmethod
    def _result(recorder: Recorder, df: DataFrame, limit: int, warnings: list[str]) -> dict:
        rows = recorder.ran(df.limit(limit + 1)).collect()
        kept = [{k: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v for k, v in r.asDict().items()} for r in rows[:limit]]
        evidence = recorder.done(rows_used=len(kept), warnings=warnings, truncated=len(rows) > limit)
        return {"rows": kept, "truncated": len(rows) > limit, "evidence": evidence.as_dict(), "warnings": warnings}

    def export(self, table: str, uri: str, target: str | None = None, mode: str = "replace") -> int | None:
        return writers.write(self.session.table(table), uri, target, mode)

    def health(self, metrics: list[str] = ()) -> dict:
        """How well the steps so far are grounded."""
        steps = [{"operator": s.operator, "tables": s.tables, "governed": s.governed, "warnings": s.warnings} for s in self.trail.steps if isinstance(s, Step)]
        return quality.context_health(steps, {t: self.catalog.status(t) for s in steps for t in s["tables"]}, list(metrics), list(self.context.guides))
