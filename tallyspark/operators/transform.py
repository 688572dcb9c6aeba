"""Cleaning, wide tables by joins, model graphs, and incremental merges into versioned folders."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine import guard
from tallyspark.operators.relational import latest_per_key


def clean(df: DataFrame, fill: dict[str, object] | None = None, clip: dict[str, tuple[float | None, float | None]] | None = None, dedup: list[str] | None = None) -> DataFrame:
    """Fills nulls (a constant, or MEAN, MEDIAN, MODE), clips numbers, and keeps one row per key: the greatest.

    Fills come from one aggregate; a mean or median of nothing is 0, a mode of nothing leaves nulls.
    """
    fill, clip = fill or {}, clip or {}
    guard.columns(df, [*fill, *clip, *(dedup or [])])
    kinds = {"MEAN": F.avg, "MEDIAN": F.median, "MODE": lambda c: F.mode(c, True)}
    measured = {c: how for c, how in fill.items() if isinstance(how, str) and how.upper() in kinds}
    known = df.agg(*[kinds[how.upper()](F.col(guard.quoted(c))).alias(f"f{k}") for k, (c, how) in enumerate(measured.items())]).first() if measured else None
    values = {c: known[f"f{k}"] if known[f"f{k}"] is not None or how.upper() == "MODE" else 0.0 for k, (c, how) in enumerate(measured.items())}
    for c, how in fill.items():
        if isinstance(how, bool):
            raise ValueError(f"{c} can't be filled with a boolean")
        value = values.get(c, how) if c in measured else how
        if value is not None:
            df = df.withColumn(c, F.coalesce(F.col(guard.quoted(c)), F.lit(value).cast(df.schema[c].dataType)))
    for c, (low, high) in clip.items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"the bounds of {c} are inverted")
        x = F.col(guard.quoted(c))
        if low is not None:
            x = F.when(x < low, F.lit(low)).otherwise(x)
        if high is not None:
            x = F.when(x > high, F.lit(high)).otherwise(x)
        df = df.withColumn(c, x.cast(df.schema[c].dataType))
    if dedup:
        rest = [c for c in df.columns if c not in dedup]
        df = latest_per_key(df, dedup, rest[0]).select(*df.columns) if rest else df.distinct()
    return df


def wide_join(fact: DataFrame, dims: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """The fact left-joined with each (name, frame, condition); conditions name columns as fact.x and <name>.y.

    Columns that collide become <name>_<column>, and <name>_<column>_2 and so on if that is taken too.
    """
    out, taken = fact.alias("fact"), list(fact.columns)
    kept = [F.col(f"fact.{guard.quoted(c)}").alias(c) for c in fact.columns]
    for name, dim, on in dims:
        guard.identifier(name)
        out = out.join(dim.alias(name), guard.predicate(fact.sparkSession, on), "left")
        for c in dim.columns:
            shown, n = (c if c not in taken else f"{name}_{c}"), 1
            while shown in taken:
                n += 1
                shown = f"{name}_{c}_{n}"
            taken.append(shown)
            kept.append(F.col(f"{name}.{guard.quoted(c)}").alias(shown))
    return out.select(*kept)


def merge(old: DataFrame | None, new: DataFrame, key: str | None) -> DataFrame:
    """Old rows whose key isn't in ``new``, and all of ``new``; without key or old rows only ``new``."""
    if old is None or key is None:
        return new
    guard.columns(new, [key])
    keys = new.select(F.col(guard.quoted(key)).alias("_k")).distinct()
    return old.join(keys, old[key].eqNullSafe(keys["_k"]), "left_anti").unionByName(new)


class VersionedTable:
    """A Parquet table as immutable version folders and a pointer; readers see the last complete version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.removeprefix("file://")

    def versions(self) -> list[str]:
        path = os.path.join(self.folder, "LOG")
        return open(path).read().split() if os.path.exists(path) else []

    def current(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(os.path.join(self.folder, v[-1])) if v else None

    def _point(self, versions: list[str]) -> None:
        with open(os.path.join(self.folder, "LOG.new"), "w") as f:
            f.write("\n".join(versions))
        os.replace(os.path.join(self.folder, "LOG.new"), os.path.join(self.folder, "LOG"))

    def write(self, df: DataFrame, key: str | None = None) -> str:
        """A new version: ``df``, or with a key ``df`` merged into the current one. A failure leaves the current one."""
        name = f"v-{uuid.uuid4().hex}"
        merge(self.current(), df, key).write.parquet(os.path.join(self.folder, name))
        self._point([*self.versions(), name])
        return name

    def rollback(self) -> None:
        v = self.versions()
        if len(v) < 2:
            raise ValueError("there is no version before")
        self._point(v[:-1])


@dataclass
class Model:
    """A named query; kind is view, table or incremental (then key)."""

    name: str
    sql: str
    kind: str = "view"
    key: str | None = None
    depends_on: list[str] = field(default_factory=list)


class ModelGraph:
    """Models that read each other, run in the order of their dependencies."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.models = spark, folder, {}

    def add(self, model: Model) -> Model:
        """Registers a model; without given dependencies they are read from its parsed query."""
        guard.identifier(model.name)
        if model.kind not in ("view", "ephemeral", "table", "incremental"):
            raise ValueError(f"no kind {model.kind!r}")
        guard.read_only(self.spark, model.sql)
        model.depends_on = model.depends_on or guard.referenced_tables(self.spark, model.sql)
        self.models[model.name] = model
        return model

    def stages(self, wanted: list[str] | None = None) -> list[list[str]]:
        """Groups that can run at once, in order; ``wanted`` brings its ancestors with it."""
        need, stack = set(), list(wanted or self.models)
        while stack:
            n = stack.pop()
            if n in self.models and n not in need:
                need.add(n)
                stack += self.models[n].depends_on
        left = {n: {x for x in self.models[n].depends_on if x in need} for n in need}
        out = []
        while left:
            free = sorted(n for n, x in left.items() if not x)
            if not free:
                raise ValueError(f"the models {sorted(left)} depend on each other in a circle")
            out.append(free)
            left = {n: x - set(free) for n, x in left.items() if n not in free}
        return out

    def run(self, wanted: list[str] | None = None) -> list[str]:
        """Runs models stage by stage; returns their names. A failing model leaves its last version."""
        done = []
        for stage in self.stages(wanted):
            for name in stage:
                m = self.models[name]
                df = self.spark.sql(guard.read_only(self.spark, m.sql))
                if m.kind in ("view", "ephemeral"):
                    df.createOrReplaceTempView(name)
                else:
                    store = VersionedTable(self.spark, os.path.join(self.folder, name))
                    os.makedirs(store.folder, exist_ok=True)
                    store.write(df, m.key if m.kind == "incremental" else None)
                    store.current().createOrReplaceTempView(name)
                done.append(name)
        return done

    def downstream(self, name: str) -> list[str]:
        """All models that read a table directly or through others."""
        out, front = [], [name]
        while front:
            front = sorted({m.name for m in self.models.values() if set(m.depends_on) & set(front)} - set(out))
            out += front
        return out


