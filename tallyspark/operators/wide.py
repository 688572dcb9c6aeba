"""Attribute–value rows into wide, typed tables.

The newest edit of each cell is found with a map-side combined ``max`` of (time, value), so an instance that holds a
third of all rows costs one partial row per map task. The grid of every instance and every attribute of its object type
is completed, current values are left-joined to it, each instance's cells are collected in attribute order (an array
whose length is the number of declared attributes, never the number of edits), and the fixed indices of that array are
projected through try casts of the declared type.

Defined results: an edit without id, name or time (null or blank) doesn't count; ids and names compare without case and
outer blanks; undeclared names and instances of no declared type are left out; of two edits of one cell with one time
the greater text wins, a text before null; a blank marker (see BLANK_MARKERS) or a value that can't be read in the
declared type leaves the cell null; an instance all of whose cells are null is still a row. Empty input gives no rows.
Only the named columns are read, so further columns with any names don't matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine.shared import trimmed

#: Values that clear a cell, compared in lower case without outer blanks.
BLANK_MARKERS = ("", "none", "null", "n/a")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
#: The ontology is metadata read on the driver; more declared attributes than this are refused.
MAX_ATTRIBUTES = 20_000
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　−"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " -"
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"
_TIME = r"(?:[Tt ] *([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)(?:[.,][0-9]+)?Z?)?$"
_YEAR_FIRST = r"^([0-9]{4})(?:[-/.]|年)([0-9]{1,2})(?:[-/.]|月)([0-9]{1,2})日? *" + _TIME
_DAY_FIRST = r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4}) *" + _TIME
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})" + _TIME


@dataclass(frozen=True)
class Attribute:
    """One declared property: its object type, place in the array of that type, name and data_type."""

    prefix: str
    object_name: str
    position: int
    name: str
    data_type: str

    @property
    def column(self) -> str:
        return f"{self.object_name}__{self.name}"


def read_attributes(ontology: DataFrame) -> list[Attribute]:
    """The declared properties other than primary keys; rows without prefix or properties are skipped."""
    kept = ontology.filter("id_prefix <> '' and properties_json <> ''")
    if (n := kept.count()) > MAX_ATTRIBUTES:
        raise ValueError(f"{n} object types; at most {MAX_ATTRIBUTES} attributes are read on the driver")
    rows = kept.select("object_name", "id_prefix", "primary_key_column", "properties_json").collect()
    out = []
    for row in rows:
        if not row.id_prefix or not row.properties_json:
            continue
        place = 0
        for prop in json.loads(row.properties_json):
            name = str(prop["name"]).strip().lower()
            if prop.get("is_primary_key") or name == (row.primary_key_column or "").strip().lower():
                continue
            out.append(Attribute(row.id_prefix.strip().upper(), row.object_name, place, name, prop["data_type"].strip().lower()))
            place += 1
    if len(out) > MAX_ATTRIBUTES:
        raise ValueError(f"{len(out)} declared attributes; at most {MAX_ATTRIBUTES} are read on the driver")
    return out


def plain_text(value: Column, data_type: Column) -> Column:
    """The value in the one spelling that a cast to its type reads, or null where it is a marker or unreadable."""
    text = trimmed(value)
    narrow = trimmed(F.translate(value, _WIDE, _NARROW))
    bare = F.regexp_replace(narrow, r"[\p{Sc},\s   ]", "")
    number = F.when(bare.rlike(_NUMBER), bare)
    exact = number.try_cast("decimal(38,10)")
    integer = F.when(exact == F.floor(exact), exact.cast("decimal(28,0)").cast("string"))
    low = F.lower(narrow)
    boolean = F.when(low.isin(*TRUE_WORDS), F.lit("true")).when(low.isin(*FALSE_WORDS), F.lit("false"))

    def stamp(pattern: str, order: str) -> Column:
        clock = F.regexp_extract(narrow, pattern, 4)
        return F.concat(F.regexp_replace(narrow, pattern, order), F.lit(" "), F.when(clock == "", F.lit("00:00:00")).otherwise(clock))

    time = (
        F.when(narrow.rlike(_YEAR_FIRST), stamp(_YEAR_FIRST, "$1-$2-$3"))
        .when(narrow.rlike(_DAY_FIRST), stamp(_DAY_FIRST, "$3-$2-$1"))
        .when(narrow.rlike(_COMPACT), stamp(_COMPACT, "$1-$2-$3"))
    )
    read = (
        F.when(data_type == "string", text)
        .when(data_type == "float", number)
        .when(data_type == "integer", integer)
        .when(data_type == "boolean", boolean)
        .when(data_type.isin("timestamp", "date"), time)
        .otherwise(text)
    )
    return F.when(~F.lower(text).isin(*BLANK_MARKERS), read)


#: The Spark type of each data_type; others stay text.
CASTS = {"string": "string", "float": "double", "integer": "bigint", "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date"}


def cell_text(c: Column, data_type: str) -> Column:
    """A typed cell in the output spelling of its type."""
    if data_type == "float":
        return c.try_cast("decimal(38,2)").cast("string")
    if data_type == "timestamp":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _attribute_rows(spark: SparkSession, attributes: list[Attribute]) -> DataFrame:
    rows = [(a.prefix, a.object_name, a.position, a.name, a.data_type) for a in attributes]
    return spark.createDataFrame(rows, "prefix string, object_name string, position int, name string, data_type string")


def current_cells(edits: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(id, prefix, position, value): the newest edit of each declared cell, its value in the plain spelling or null."""
    known = _attribute_rows(edits.sparkSession, attributes)
    counting = _counting(edits)
    newest = (
        counting.join(F.broadcast(known.select("prefix", "name", "position", "data_type")), ["prefix", "name"])
        .groupBy("id", "prefix", "position", "data_type")
        .agg(F.max(F.struct("executed_at", "new_value")).alias("newest"))
    )
    return newest.select("id", "prefix", "position", plain_text(F.col("newest.new_value"), F.col("data_type")).alias("value"))


def _counting(edits: DataFrame) -> DataFrame:
    rows = edits.select(
        F.upper(trimmed("instance_id")).alias("id"), F.lower(trimmed("column_name")).alias("name"), F.col("new_value").cast("string").alias("new_value"), "executed_at"
    ).filter("id <> '' and name <> '' and executed_at is not null")
    return rows.withColumn("prefix", F.substring_index("id", "-", 1))


def wide_table(edits: DataFrame, ontology: DataFrame) -> DataFrame:
    """One row per instance: instance_id, object_name and a typed column <object>__<property> per declared property.

    Columns of other object types are null in a row. The attribute list is metadata of checked size (MAX_ATTRIBUTES)
    and the only thing broadcast.
    """
    attributes = read_attributes(ontology)
    spark = edits.sparkSession
    known = _attribute_rows(spark, attributes)
    instances = _counting(edits).select("id", "prefix").join(F.broadcast(known.select("prefix").distinct()), "prefix", "left_semi").distinct()
    grid = instances.join(F.broadcast(known.select("prefix", "object_name", "position")), "prefix").select("id", "object_name", "position")
    filled = grid.join(current_cells(edits, attributes).select("id", "position", "value"), ["id", "position"], "left")
    rows = filled.groupBy("id", "object_name").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("cells"))
    rows = rows.select("id", "object_name", F.transform("cells", lambda c: c["value"]).alias("v"))
    cells = [
        F.when(F.col("object_name") == a.object_name, F.get("v", F.lit(a.position)).try_cast(CASTS.get(a.data_type, "string"))).alias(a.column)
        for a in attributes
    ]
    return rows.select(F.col("id").alias("instance_id"), "object_name", *cells)


def filled_cells(wide: DataFrame, ontology: DataFrame) -> DataFrame:
    """(instance_id, column_name, value_text) of the cells of ``wide_table`` that aren't null."""
    attributes = read_attributes(ontology)
    by_type: dict[str, list[Attribute]] = {}
    for a in attributes:
        by_type.setdefault(a.object_name, []).append(a)
    kind = "array<struct<column_name:string,value_text:string>>"
    cells = F.lit(None).cast(kind)
    for object_name, own in by_type.items():
        texts = F.array(*[F.struct(F.lit(a.name).alias("column_name"), cell_text(F.col(f"`{a.column}`"), a.data_type).alias("value_text")) for a in own])
        cells = F.when(F.col("object_name") == object_name, texts).otherwise(cells)
    return wide.select("instance_id", F.inline(F.filter(cells, lambda c: c["value_text"].isNotNull())))
