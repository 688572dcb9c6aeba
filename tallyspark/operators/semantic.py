"""Metrics and models: governed definitions that compile to plans which aggregate before they join."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.engine import guard

STATUSES = ("draft", "endorsed", "deprecated")


class SemanticError(ValueError):
    """The query isn't covered by the models."""


@dataclass(frozen=True)
class Entity:
    """A join key of a model: primary (unique there) or foreign."""

    name: str
    column: str
    primary: bool = False


@dataclass
class Model:
    """A table with its keys, dimensions and time column."""

    name: str
    table: str
    entities: list[Entity] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    time: str | None = None


@dataclass
class Metric:
    """kind simple (an aggregate expression over a model), ratio (of two metrics) or cumulative (of one)."""

    name: str
    model: str = ""
    expression: str = ""
    kind: str = "simple"
    inputs: tuple[str, ...] = ()
    status: str = "draft"
    description: str = ""

    def version(self) -> str:
        """A hash of what the metric computes."""
        body = {k: v for k, v in asdict(self).items() if k not in ("status", "description")}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]


class Store:
    """Models and metrics by name, and the tables they stand on."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables
        self.models: dict[str, Model] = {}
        self.metrics: dict[str, Metric] = {}

    def add_model(self, model: Model) -> None:
        have = self.tables[model.table].columns
        missing = [c for c in [*model.dimensions, *(e.column for e in model.entities), *([model.time] if model.time else [])] if c not in have]
        if missing:
            raise SemanticError(f"{model.table} has no {missing}")
        self.models[model.name] = model

    def add_metric(self, metric: Metric) -> str:
        guard.identifier(metric.name)
        if metric.kind == "simple":
            if metric.model not in self.models:
                raise SemanticError(f"no model {metric.model!r}")
            guard.predicate(self.spark, metric.expression)
        elif metric.kind not in ("ratio", "cumulative") or any(m not in self.metrics for m in metric.inputs) or len(metric.inputs) != (2 if metric.kind == "ratio" else 1):
            raise SemanticError("a ratio has two known metrics, a cumulative metric one")
        if metric.status not in STATUSES:
            raise SemanticError(f"statuses are {STATUSES}")
        self.metrics[metric.name] = metric
        return metric.version()

    def _path(self, start: Model, dimension: str) -> list[tuple[Model, Entity, Entity]]:
        """The one way of at most two foreign-to-primary joins from a model to the one that has the dimension."""
        if dimension in start.dimensions or dimension == start.time:
            return []
        found, refused = [], False

        def search(model: Model, path: list, seen: set[str]) -> None:
            nonlocal refused
            if len(path) == 2:
                return
            for e in model.entities:
                for other in self.models.values():
                    if other.name in seen:
                        continue
                    for p in other.entities:
                        if p.name != e.name:
                            continue
                        if not p.primary:
                            refused = refused or dimension in other.dimensions
                            continue
                        step = [*path, (other, e, p)]
                        if dimension in other.dimensions:
                            found.append(step)
                        search(other, step, seen | {other.name})

        search(start, [], {start.name})
        shortest = [p for p in found if len(p) == min(map(len, found))] if found else []
        if len(shortest) > 1:
            raise SemanticError(f"{dimension} can be reached from {start.name} in more than one way")
        if not shortest:
            raise SemanticError(f"{dimension} would multiply the rows of {start.name}" if refused else f"{dimension} can't be reached from {start.name}")
        return shortest[0]

    def _simple(self, metric: Metric, dimensions: list[str], where: str | None) -> DataFrame:
        model = self.models[metric.model]
        rows = self.tables[model.table]
        if where:
            rows = rows.filter(guard.predicate(self.spark, where))
        kept = [F.col(guard.quoted(c)).alias(c) for c in rows.columns]
        rows = rows.select(*kept)
        for k, d in enumerate(dimensions):
            key = None
            for n, (other, own, their) in enumerate(self._path(model, d)):
                left = own.column if key is None else key.get(own.column)
                wanted = [their.column, *(e.column for e in other.entities), d if d in other.dimensions else their.column]
                right = self.tables[other.table].select(*[F.col(guard.quoted(c)).alias(f"_{k}_{n}_{c}") for c in dict.fromkeys(wanted)])
                rows = rows.join(right, rows[left].eqNullSafe(right[f"_{k}_{n}_{their.column}"]) & rows[left].isNotNull(), "left")
                key = {c: f"_{k}_{n}_{c}" for c in dict.fromkeys(wanted)}
            rows = rows.withColumn(f"_d{k}", F.col(guard.quoted(d if key is None else key[d])))
        return rows.groupBy(*[F.col(f"_d{k}").alias(d) for k, d in enumerate(dimensions)]).agg(F.expr(metric.expression).cast("double").alias(metric.name))

    def query(self, names: list[str], dimensions: list[str] = (), where: str | None = None, endorsed_only: bool = False) -> DataFrame:
        """One row per dimension values with a column per metric; each metric is aggregated on its own table first."""
        dimensions = list(dimensions)
        for n in names:
            if n not in self.metrics:
                raise SemanticError(f"no metric {n!r}")
            if self.metrics[n].status == "deprecated" or endorsed_only and self.metrics[n].status != "endorsed":
                raise SemanticError(f"metric {n} is {self.metrics[n].status}")
        frames = []
        for n in names:
            m = self.metrics[n]
            if m.kind == "simple":
                frames.append(self._simple(m, dimensions, where))
            elif m.kind == "ratio":
                both = self.query(list(m.inputs), dimensions, where)
                frames.append(both.select(*dimensions, F.try_divide(m.inputs[0], m.inputs[1]).alias(n)))
            else:
                frames.append(self._cumulative(m, dimensions, where))
        out = frames[0]
        for other in frames[1:]:
            right = other.select(*[F.col(guard.quoted(d)).alias(f"_r{k}") for k, d in enumerate(dimensions)], other.columns[-1])
            on = F.lit(True)
            for k, d in enumerate(dimensions):
                on = on & F.col(guard.quoted(d)).eqNullSafe(F.col(f"_r{k}"))
            mine = [c for c in out.columns if c not in dimensions]
            out = out.join(right, on, "full").select(*[F.coalesce(F.col(guard.quoted(d)), F.col(f"_r{k}")).alias(d) for k, d in enumerate(dimensions)], *mine, other.columns[-1])
        return out

    def _cumulative(self, metric: Metric, dimensions: list[str], where: str | None) -> DataFrame:
        """The running sum over a daily spine without gaps; the first dimension is the model's time."""
        base = self.metrics[metric.inputs[0]]
        time = self.models[base.model].time
        if dimensions != [time]:
            raise SemanticError(f"a cumulative metric is asked by {time} alone")
        daily = self._simple(base, [time], where).groupBy(F.to_date(time).alias(time)).agg(F.sum(base.name).alias("v")).filter(F.col(time).isNotNull())
        spine = daily.agg(F.min(time).alias("a"), F.max(time).alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias(time))
        w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)  # one row per day
        return spine.join(daily, time, "left").select(time, F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias(metric.name))

    def export(self) -> str:
        """All definitions as YAML."""
        import yaml

        return yaml.safe_dump({
            "semantic_models": [{"name": m.name, "model": m.table, "entities": [{"name": e.name, "expr": e.column, "type": "primary" if e.primary else "foreign"} for e in m.entities], "dimensions": [{"name": d} for d in m.dimensions], "defaults": {"agg_time_dimension": m.time}} for m in self.models.values()],
            "metrics": [{"name": m.name, "type": m.kind, "type_params": {"model": m.model, "expr": m.expression, "inputs": list(m.inputs)}, "meta": {"status": m.status}} for m in self.metrics.values()],
        }, sort_keys=False, allow_unicode=True)

    def load(self, text: str) -> list[str]:
        """Registers the definitions of ``export``'s form; measures with agg and expr are read too."""
        import yaml

        data = yaml.safe_load(text) or {}
        measures: dict[str, tuple[str, str]] = {}
        for m in data.get("semantic_models", []):
            table = str(m.get("model", m["name"])).removeprefix("ref('").removesuffix("')")
            self.add_model(Model(m["name"], table, [Entity(e["name"], e.get("expr", e["name"]), e.get("type") in ("primary", "unique")) for e in m.get("entities", [])], [d["name"] for d in m.get("dimensions", [])], (m.get("defaults") or {}).get("agg_time_dimension")))
            for x in m.get("measures", []):
                form = {"sum": "sum({})", "average": "avg({})", "count": "count({})", "count_distinct": "count(distinct {})", "min": "min({})", "max": "max({})", "median": "median({})"}[x["agg"]]
                measures[x["name"]] = m["name"], form.format(x.get("expr", x["name"]))
        done = []
        for m in data.get("metrics", []):
            p = m.get("type_params", {})
            name_of = lambda x: x["name"] if isinstance(x, dict) else x
            if m["type"] == "simple":
                model, expression = (p["model"], p["expr"]) if "expr" in p else measures[name_of(p["measure"])]
                metric = Metric(m["name"], model, expression)
            else:
                inputs = tuple(p["inputs"]) if p.get("inputs") else (name_of(p["numerator"]), name_of(p["denominator"])) if m["type"] == "ratio" else (name_of(p["measure"]),)
                for i in inputs:
                    if i not in self.metrics and i in measures:
                        self.add_metric(Metric(i, *measures[i]))
                metric = Metric(m["name"], kind=m["type"], inputs=inputs)
            metric.status = (m.get("meta") or {}).get("status", "draft")
            self.add_metric(metric)
            done.append(m["name"])
        return done

