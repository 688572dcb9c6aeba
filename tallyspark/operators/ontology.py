"""Objects and links over tables: queries, traversal of links, and actions with an audit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine import guard


class OntologyError(ValueError):
    """The object, link or action isn't defined or not allowed."""


@dataclass
class ObjectType:
    """A kind of thing: its table, key, and properties (a column, or a formula over columns)."""

    name: str
    table: str
    key: str
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class LinkType:
    """source.source_key = target.target_key, or through a junction table's two columns."""

    name: str
    source: str
    target: str
    source_key: str
    target_key: str
    cardinality: str = "one_to_many"
    junction: str | None = None
    junction_source: str | None = None
    junction_target: str | None = None


@dataclass
class ActionType:
    """An edit with typed parameters: write_back to the side table, or a handler (sync, webhook)."""

    name: str
    object_type: str
    parameters: dict[str, str]
    kind: str = "write_back"
    handler: Callable[[dict], object] | None = None


CASTS = {"string": str, "integer": int, "float": float, "boolean": bool}


class Ontology:
    """Object types, links and actions over named tables; edits go to a side table, sources stay as they are."""

    EDITS = "instance_id string, object_type string, column_name string, new_value string, action string, executed_at timestamp_ntz, audit_hash string"

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], edits_folder: str | None = None) -> None:
        self.spark, self.tables, self.edits_folder = spark, tables, edits_folder
        self.objects: dict[str, ObjectType] = {}
        self.links: dict[str, LinkType] = {}
        self.actions: dict[str, ActionType] = {}
        self.audit: list[dict] = []

    def add_object(self, o: ObjectType) -> None:
        guard.columns(self.tables[o.table], [o.key])
        for p in o.properties.values():
            guard.predicate(self.spark, p)
        self.objects[o.name] = o

    def add_link(self, link: LinkType) -> None:
        for n in (link.source, link.target):
            if n not in self.objects:
                raise OntologyError(f"no object type {n!r}")
        guard.columns(self.tables[self.objects[link.source].table], [link.source_key])
        guard.columns(self.tables[self.objects[link.target].table], [link.target_key])
        if link.junction:
            guard.columns(self.tables[link.junction], [link.junction_source, link.junction_target])
        self.links[link.name] = link

    def remove_object(self, name: str) -> None:
        used = [x.name for x in self.links.values() if name in (x.source, x.target)] + [a.name for a in self.actions.values() if a.object_type == name]
        if used:
            raise OntologyError(f"{name} is used by {used}")
        self.objects.pop(name, None)

    def query(self, name: str, properties: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
        """The key and properties of the objects that match."""
        if name not in self.objects:
            raise OntologyError(f"no object type {name!r}")
        o = self.objects[name]
        wanted = properties if properties is not None else list(o.properties)
        unknown = [p for p in wanted if p not in o.properties]
        if unknown:
            raise OntologyError(f"{name} has no {unknown}")
        rows = self.tables[o.table].select("*", *[F.expr(o.properties[p]).alias(f"_p_{p}") for p in o.properties])
        if where:
            rows = self.tables[o.table].filter(guard.predicate(self.spark, where)).select("*", *[F.expr(o.properties[p]).alias(f"_p_{p}") for p in o.properties])
        out = rows.select(F.col(guard.quoted(o.key)).alias(o.key), *[F.col(f"_p_{p}").alias(p) for p in wanted if p != o.key])
        return out.limit(limit) if limit is not None else out

    def traverse(self, start: str, path: list[str], where: str | None = None) -> list[DataFrame]:
        """Per hop the distinct keys of the reached objects, as one chain of joins that never visits the driver.

        A link may be walked either way. A path may not return to an object type, except by a link from a type to itself,
        which leaves out the keys of earlier hops.
        """
        o = self.objects[start]
        rows = self.tables[o.table]
        keys = (rows.filter(guard.predicate(self.spark, where)) if where else rows).select(F.col(guard.quoted(o.key)).alias("key")).filter("key is not null").distinct()
        seen_types, at, out, visited = {start}, start, [], keys
        for n in path:
            if n not in self.links:
                raise OntologyError(f"no link {n!r}")
            link = self.links[n]
            if at not in (link.source, link.target):
                raise OntologyError(f"{n} doesn't start at {at}")
            forward = link.source == at
            to = link.target if forward else link.source
            if to in seen_types and to != at:
                raise OntologyError(f"the path returns to {to}")
            own, their = (link.source_key, link.target_key) if forward else (link.target_key, link.source_key)
            a, b = self.objects[at], self.objects[to]
            left = self.tables[a.table].select(F.col(guard.quoted(a.key)).alias("key"), F.col(guard.quoted(own)).alias("own")).join(keys, "key", "left_semi").select("own").distinct()
            if link.junction:
                j1, j2 = (link.junction_source, link.junction_target) if forward else (link.junction_target, link.junction_source)
                mid = self.tables[link.junction].select(F.col(guard.quoted(j1)).alias("own"), F.col(guard.quoted(j2)).alias("other"))
                left = mid.join(left, "own", "left_semi").select(F.col("other").alias("own")).distinct()
            right = self.tables[b.table].select(F.col(guard.quoted(their)).alias("own"), F.col(guard.quoted(b.key)).alias("key"))
            keys = right.join(left, "own", "left_semi").select("key").filter("key is not null").distinct()
            if to == at:
                keys = keys.join(visited, "key", "left_anti")
                visited = visited.unionByName(keys)
            else:
                visited = keys
            seen_types.add(to)
            at = to
            out.append(keys)
        return out

    def graph(self) -> dict:
        """Nodes, edges, and edges whose tables are missing."""
        edges = [{"link": x.name, "from": x.source, "to": x.target, "cardinality": x.cardinality} for x in self.links.values()]
        broken = [x.name for x in self.links.values() if any(self.objects[n].table not in self.tables for n in (x.source, x.target) if n in self.objects) or x.source not in self.objects or x.target not in self.objects or (x.junction and x.junction not in self.tables)]
        return {"nodes": sorted(self.objects), "edges": edges, "broken": broken}

    def execute(self, action: str, instance: str, values: dict, now: datetime | None = None, dry_run: bool = False) -> dict:
        """Checks the parameters, and writes an edit per parameter or calls the handler; every run is audited."""
        if action not in self.actions:
            raise OntologyError(f"no action {action!r}")
        a = self.actions[action]
        unknown, missing = set(values) - set(a.parameters), set(a.parameters) - set(values)
        if unknown or missing:
            raise OntologyError(f"unknown {sorted(unknown)}, missing {sorted(missing)}")
        for n, kind in a.parameters.items():
            want = CASTS[kind]
            if values[n] is not None and (not isinstance(values[n], want) and not (want is float and isinstance(values[n], int)) or want is not bool and isinstance(values[n], bool)):
                raise OntologyError(f"{n} is a {kind}")
        at = now or datetime.now(timezone.utc).replace(tzinfo=None)
        body = {"action": action, "instance": instance, "values": values, "at": at.isoformat()}
        digest = hashlib.sha256((json.dumps(body, sort_keys=True, default=str) + (self.audit[-1]["hash"] if self.audit else "")).encode()).hexdigest()
        entry = body | {"hash": digest, "dry_run": dry_run}
        if not dry_run:
            if a.kind == "write_back":
                if not self.edits_folder:
                    raise OntologyError("there is no folder for edits")
                rows = [(instance, a.object_type, n, None if v is None else str(v).lower() if isinstance(v, bool) else str(v), action, at, digest) for n, v in values.items()]
                self.spark.createDataFrame(rows, self.EDITS).write.mode("append").parquet(self.edits_folder)
            else:
                entry["result"] = a.handler(body) if a.handler else None
            self.audit.append(entry)
        return entry
