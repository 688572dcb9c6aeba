"""Schemas that drift between loads: edit scripts from tree edit distance, compiled into projections.

Each load's schema is a tree (columns, and the fields nested in struct types). Between consecutive loads the top-down
unordered tree edit distance is computed: children that keep their name are matched, the others by minimum-cost
assignment among rename, delete and insert; a subtree that is deleted at one place and inserted with the same shape at
another is a move. The cost of a rename comes from content: a load repeats records of the load before, so the shared
records are compared field by field, once for all candidate pairs, in one map-side combined aggregation by record.

Scripts are composed per dataset into one name and type per column and load, which every record is projected through.

Defined results: the registration with the latest updated_at states a load's schema; loads without a registration, and
first loads, have no changes; a rename needs MIN_SHARED shared records with both values present, of which a share of
AGREEMENT agrees; without it a column that goes and one that comes are removed and added. Unreadable payloads are
records without fields; repeated records count once; nulls are no evidence of agreement but a null against a value is
disagreement. Empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.value_counts import counting_registrations

MIN_SHARED, AGREEMENT = 2, 0.9
DELETE = INSERT = 1.0
RETYPE, RENAME, FORBIDDEN = 0.25, 0.5, 1e6
#: Spellings of one type (fixed values of the contract).
SPELLINGS = {
    "int": ("int", "int32", "integer"), "bigint": ("bigint", "int64", "long"), "double": ("double", "float64", "double precision"),
    "string": ("string", "varchar", "text"), "date": ("date", "date32[day]"),
    "timestamp": ("timestamp", "timestamp[us]", "timestamp without time zone"), "boolean": ("bool", "boolean"),
}
_CANON = {s: t for t, names in SPELLINGS.items() for s in names}
_DECIMAL = re.compile(r"^(?:decimal128|decimal|numeric)\((\d+),(\d+)\)$")
_WIDER = ("boolean", "int", "bigint", "decimal", "double")
SPARK_TYPES = {"int": "int", "bigint": "bigint", "double": "double", "string": "string", "date": "date", "timestamp": "timestamp_ntz", "boolean": "boolean"}


def canonical_type(text: str | None) -> str:
    """The one spelling of a physical type; unknown types are lower-cased."""
    low = " ".join((text or "").lower().split())
    if low in _CANON:
        return _CANON[low]
    tight = low.replace(" ", "")
    if m := _DECIMAL.match(tight):
        return f"decimal({m[1]},{m[2]})"
    return _CANON.get(tight, tight)


def common_type(types: list[str]) -> str:
    """The narrowest type that holds values of all given canonical types."""
    kinds = sorted(set(types))
    if len(kinds) == 1:
        return kinds[0]
    if set(kinds) == {"date", "timestamp"}:
        return "timestamp"
    base = [k.split("(")[0] for k in kinds]
    if all(b in _WIDER[1:] for b in base):
        if "double" in base:
            return "double"
        decimals = [tuple(map(int, _DECIMAL.match(k).groups())) for k in kinds if k.startswith("decimal")]
        if not decimals:
            return "bigint"
        scale = max(s for _, s in decimals)
        whole = max([p - s for p, s in decimals] + [19 if "bigint" in base else 10])
        return f"decimal({min(38, whole + scale)},{scale})"
    return "string"


@dataclass
class Node:
    """A column or nested field."""

    name: str
    kind: str
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def shape(self) -> tuple:
        return self.kind, tuple(sorted((n, c.shape()) for n, c in self.children.items()))


def _split(text: str) -> list[str]:
    """The parts of a type list at the outermost commas."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def node_of(name: str, physical_type: str) -> Node:
    """A node with the fields of struct<...>, list<...>, array<...> and map<...> types as children."""
    m = re.match(r"^\s*(struct|list|array|map)\s*<(.*)>\s*$", physical_type or "", re.I | re.S)
    if not m:
        return Node(name, canonical_type(physical_type))
    outer, inner = m[1].lower(), _split(m[2])
    pairs = [p.split(":", 1) for p in inner] if outer == "struct" else [[("key", "value")[k] if outer == "map" else "item", p] for k, p in enumerate(inner)]
    return Node(name, outer, {p[0].strip(): node_of(p[0].strip(), p[-1].strip()) for p in pairs})


def schema_tree(columns: list[tuple[str, str]]) -> Node:
    """The tree of a list of (name, physical type); of repeated names the first counts."""
    root = Node("", "schema")
    for name, kind in columns:
        if name is not None:
            root.children.setdefault(name, node_of(name, kind))
    return root


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a minimum-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        low, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[col] = True
            at, step, nxt = owner[col], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    reduced = cost[at - 1][j - 1] - u[at] - v[j]
                    if reduced < low[j]:
                        low[j], way[j] = reduced, col
                    if low[j] < step:
                        step, nxt = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col], col = owner[way[col]], way[col]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def edit_script(old: Node, new: Node, content: dict[tuple[str, str], tuple[int, int]], path: str = "") -> tuple[float, list[tuple[str, str, str]]]:
    """(cost, operations) of the cheapest script from old to new; operations are (kind, old path, new path).

    content: for (old path, new path) the number of shared records with a value on either side, and how many agree.
    """
    cost, ops = 0.0, []
    for name in (n for n in old.children if n in new.children):
        a, b, at = old.children[name], new.children[name], f"{path}{name}"
        if a.kind != b.kind:
            cost += RETYPE
            ops.append(("retyped", at, at))
        if a.children or b.children:
            c, more = edit_script(a, b, content, f"{at}.")
            cost, ops = cost + c, ops + more
    gone = [n for n in old.children if n not in new.children]
    come = [n for n in new.children if n not in old.children]
    g, c = len(gone), len(come)
    scripts: dict[tuple[int, int], tuple[float, list]] = {}
    matrix = [[FORBIDDEN] * (g + c) for _ in range(g + c)]
    for i, a in enumerate(gone):
        for j, b in enumerate(come):
            x, y = old.children[a], new.children[b]
            shared, agree = content.get((f"{path}{a}", f"{path}{b}"), (0, 0))
            same_shape = bool(x.children) and x.shape() == y.shape()
            if (shared >= MIN_SHARED and agree >= AGREEMENT * shared) or same_shape:
                inner = edit_script(x, y, content, f"{path}{a}.") if x.children or y.children else (0.0, [])
                retype = RETYPE if x.kind != y.kind else 0.0
                scripts[i, j] = (RENAME + retype + (1 - agree / shared if shared else 0.5) + inner[0], inner[1])
                matrix[i][j] = scripts[i, j][0]
        matrix[i][c + i] = DELETE * old.children[a].size()
    for j, b in enumerate(come):
        matrix[g + j][j] = INSERT * new.children[b].size()
        for i in range(g):
            matrix[g + j][c + i] = 0.0
    chosen = assign(matrix) if matrix else []
    for i, j in enumerate(chosen):
        if i < g and j < c:
            a, b = f"{path}{gone[i]}", f"{path}{come[j]}"
            ops.append(("renamed", a, b))
            if old.children[gone[i]].kind != new.children[come[j]].kind:
                ops.append(("retyped", a, b))
            ops += scripts[i, j][1]
        elif i < g:
            ops.append(("removed", f"{path}{gone[i]}", ""))
        elif j < c:
            ops.append(("added", "", f"{path}{come[j]}"))
        cost += matrix[i][j]
    return cost, _with_moves(old, new, ops) if path == "" else ops


def _at(node: Node, path: str) -> Node:
    for part in path.split("."):
        if part not in node.children:
            return Node("", "?")
        node = node.children[part]
    return node


def _with_moves(old: Node, new: Node, ops: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """A removed and an added node of one name and shape under different parents become one move."""
    removed = [o[1] for o in ops if o[0] == "removed"]
    moved: dict[str, str] = {}
    for kind, _, b in ops:
        if kind != "added":
            continue
        for a in removed:
            apart = a.rpartition(".")[0] != b.rpartition(".")[0]
            if a not in moved and apart and a.rpartition(".")[2] == b.rpartition(".")[2] and _at(old, a).shape() == _at(new, b).shape():
                moved[a] = b
                break
    back = {b: a for a, b in moved.items()}
    kept = [o for o in ops if not (o[0] == "removed" and o[1] in moved or o[0] == "added" and o[2] in back)]
    return kept + [("moved", a, b) for a, b in moved.items()]


def _same(a: Column, b: Column) -> Column:
    """Whether two values in text are the same content in whatever type they are written."""
    number = a.try_cast("decimal(38,6)") == b.try_cast("decimal(38,6)")
    flag = lambda c: F.when(F.lower(c).isin("true", "t", "1", "yes"), 1).when(F.lower(c).isin("false", "f", "0", "no"), 0)
    day = r"^\d{4}-\d{2}-\d{2}"
    # a day and an instant of that day are one content; two instants must agree in full
    shorter = F.least(F.length(a), F.length(b))
    dates = a.rlike(day) & b.rlike(day) & (
        (F.translate(a, "T", " ") == F.translate(b, "T", " ")) | ((shorter == 10) & (F.substring(a, 1, 10) == F.substring(b, 1, 10)))
    )
    return F.coalesce((a == b) | number | (flag(a) == flag(b)) | dates, F.lit(False))


def load_pairs(catalog: DataFrame) -> DataFrame:
    """(dataset_name, load_no, old, new, gone, come): the schemas of each load and the load before."""
    at = counting_registrations(catalog).select("dataset_name", "load_no", F.transform("spec", lambda s: F.struct(s["name"].alias("name"), s["physical_type"].alias("kind"))).alias("cols"))
    before = at.select("dataset_name", (F.col("load_no") + 1).cast("int").alias("load_no"), F.col("cols").alias("old"))
    names = lambda c: F.filter(F.transform(c, lambda s: s["name"]), lambda n: n.isNotNull())
    both = at.withColumnRenamed("cols", "new").join(before, ["dataset_name", "load_no"])
    return both.withColumns({"gone": F.array_except(names("old"), names("new")), "come": F.array_except(names("new"), names("old"))})


def content_evidence(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dataset_name, load_no, evidence): for each candidate pair of names the shared records and how many agree."""
    rows = records.filter("dataset_name is not null and load_no is not null and record_no is not null").select(
        "dataset_name", "load_no", "record_no", F.from_json("payload", "map<string,string>").alias("p")
    )
    wanted = pairs.filter(F.size("gone") * F.size("come") > 0).select("dataset_name", "load_no", "gone", "come")
    sides = F.array(
        F.struct((F.col("load_no") - 1).cast("int").alias("own"), F.col("load_no").alias("pair"), F.col("gone").alias("names"), F.lit(True).alias("is_old")),
        F.struct(F.col("load_no").alias("own"), F.col("load_no").alias("pair"), F.col("come").alias("names"), F.lit(False).alias("is_old")),
    )
    sides = wanted.select("dataset_name", F.inline(sides)).withColumnRenamed("own", "load_no")
    values = F.transform("names", lambda n: F.element_at("p", n))
    seen = rows.join(sides, ["dataset_name", "load_no"]).select("dataset_name", "pair", "record_no", F.when(F.col("is_old"), values).alias("old"), F.when(~F.col("is_old"), values).alias("new"))
    one = seen.groupBy("dataset_name", F.col("pair").alias("load_no"), "record_no").agg(F.max("old").alias("old"), F.max("new").alias("new")).filter("old is not null and new is not null")
    cells = F.flatten(F.transform("old", lambda a, i: F.transform("new", lambda b, j: F.struct(
        i.alias("i"), j.alias("j"), (a.isNotNull() | b.isNotNull()).cast("long").alias("shared"), (a.isNotNull() & b.isNotNull()).cast("long").alias("filled"), _same(a, b).cast("long").alias("agree")))))
    sums = one.select("dataset_name", "load_no", F.inline(cells)).groupBy("dataset_name", "load_no", "i", "j").agg(*[F.sum(c).alias(c) for c in ("shared", "filled", "agree")])
    return sums.groupBy("dataset_name", "load_no").agg(F.collect_list(F.struct("i", "j", "shared", "filled", "agree")).alias("evidence"))


SCRIPT = "dataset_name string, load_no int, change_kind string, old_name string, new_name string"


def schema_changes(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """(dataset_name, load_no, change_kind, old_name, new_name): the edit scripts between consecutive loads."""
    pairs = load_pairs(catalog)
    known = pairs.join(content_evidence(records, pairs), ["dataset_name", "load_no"], "left").select(
        "dataset_name", "load_no", F.to_json("old").alias("old"), F.to_json("new").alias("new"), F.to_json("gone").alias("gone"), F.to_json("come").alias("come"), F.to_json("evidence").alias("evidence")
    )

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gone, come = json.loads(r.gone), json.loads(r.come)
                content = {(gone[e["i"]], come[e["j"]]): (e["shared"] if e["filled"] >= MIN_SHARED else 0, e["agree"]) for e in json.loads(r.evidence or "[]")}
                trees = [schema_tree([(c.get("name"), c.get("kind")) for c in json.loads(t)]) for t in (r.old, r.new)]
                out += [(r.dataset_name, r.load_no, *op) for op in edit_script(*trees, content)[1]]
            yield pd.DataFrame(out, columns=["dataset_name", "load_no", "change_kind", "old_name", "new_name"])

    return known.mapInPandas(scripts, SCRIPT)


PROJECTION = "dataset_name string, load_no int, source_name string, column_name string, column_type string"


def compile_projections(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """(dataset_name, load_no, source_name, column_name, column_type): where each load's column goes.

    A column keeps one name over all loads, its newest, and a name that comes back is the same column; if a rename gives it
    a name that an earlier column had, that one gets the suffix __2, __3 and so on. Its type holds the values of all loads. Groups hold schemas only, never records.
    """
    specs = counting_registrations(catalog).select("dataset_name", "load_no", F.to_json(F.transform("spec", lambda s: F.struct(s["name"].alias("name"), s["physical_type"].alias("kind")))).alias("spec"))
    renames = changes.filter("change_kind = 'renamed' and instr(old_name, '.') = 0").groupBy("dataset_name", "load_no").agg(F.to_json(F.collect_list(F.struct("old_name", "new_name"))).alias("renames"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        import json

        group = group.sort_values("load_no")
        at: dict[str, int] = {}
        last_name: list[str] = []
        kinds: list[list[str]] = []
        rows: list[tuple[int, str, int]] = []
        for r in group.itertuples(index=False):
            new_of = {x["old_name"]: x["new_name"] for x in json.loads(r.renames)} if isinstance(r.renames, str) else {}
            carried = {n: k for n, k in at.items() if n not in new_of} | {new_of[n]: k for n, k in at.items() if n in new_of}
            now: dict[str, int] = {}
            for c in json.loads(r.spec or "[]"):
                name = c.get("name")
                if name is None or name in now:
                    continue
                k = carried.get(name)
                if k is None:
                    k = len(last_name)
                    last_name.append(name)
                    kinds.append([])
                now[name], last_name[k] = k, name
                kinds[k].append(canonical_type(c.get("kind")))
                rows.append((r.load_no, name, k))
            at = {**{n: k for n, k in carried.items() if n not in now}, **now}
        final, taken = {}, set()
        for k in range(len(last_name) - 1, -1, -1):
            name, n = last_name[k], 1
            while name in taken:
                n += 1
                name = f"{last_name[k]}__{n}"
            taken.add(name)
            final[k] = name
        return pd.DataFrame(
            [(group["dataset_name"].iloc[0], load, source, final[k], common_type(kinds[k])) for load, source, k in rows],
            columns=["dataset_name", "load_no", "source_name", "column_name", "column_type"],
        )

    return specs.join(renames, ["dataset_name", "load_no"], "left").groupBy("dataset_name").applyInPandas(fold, PROJECTION)


def unified_records(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """(dataset_name, load_no, record_no, fields): every record once per load, its fields under the consistent names.

    fields is a map from column_name to text that the column's type reads; undeclared payload keys are left out.
    """
    plan = compile_projections(catalog, schema_changes(catalog, records))
    maps = plan.groupBy("dataset_name", "load_no").agg(F.map_from_entries(F.collect_list(F.struct("source_name", "column_name"))).alias("names"))
    rows = records.filter("dataset_name is not null and load_no is not null and record_no is not null").groupBy("dataset_name", "load_no", "record_no").agg(F.max("payload").alias("payload"))
    read = rows.join(maps, ["dataset_name", "load_no"]).withColumn("p", F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")))
    kept = F.map_filter("p", lambda k, v: v.isNotNull() & F.element_at("names", k).isNotNull())
    return read.select("dataset_name", "load_no", "record_no", F.transform_keys(kept, lambda k, _: F.element_at("names", k)).alias("fields"))


def dataset_table(catalog: DataFrame, records: DataFrame, dataset: str) -> DataFrame:
    """One dataset's records as one table with a typed column per declared column."""
    own_c, own_r = catalog.filter(F.col("dataset_name") == dataset), records.filter(F.col("dataset_name") == dataset)
    plan = compile_projections(own_c, schema_changes(own_c, own_r)).select("column_name", "column_type").distinct().limit(10_001).collect()
    if len(plan) > 10_000:
        raise ValueError("more than 10000 columns")
    rows = unified_records(own_c, own_r)
    return rows.select("load_no", "record_no", *[
        F.element_at("fields", p.column_name).try_cast(SPARK_TYPES.get(p.column_type, p.column_type if p.column_type.startswith("decimal") else "string")).alias(p.column_name)
        for p in sorted(plan, key=lambda p: p.column_name)
    ])
