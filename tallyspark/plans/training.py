"""Queries of the general training-data operators (p1, p2, p4 and p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine.shared import table
from tallyspark.operators import instants, schema_drift, value_counts, wide
from tallyspark.plans import training_sql

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table."""
    ontology = table(spark, d, "ontology_objects")
    return wide.filled_cells(wide.wide_table(table(spark, d, "writeback_table"), ontology), ontology)


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per object instance."""
    return wide.wide_table(table(spark, d, "writeback_table"), table(spark, d, "ontology_objects"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Where sales_lines break their registration or differ from the load before."""
    return value_counts.quality_findings(table(spark, d, "sales_lines"), table(spark, d, "catalog_tables"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile of every listed column and load."""
    p = value_counts.profile(table(spark, d, "sales_lines"), table(spark, d, "catalog_tables"))
    keep = ["dataset_name", "load_no", "column_name", "semantic_type", "n_rows", "n_null", "n_distinct"]
    return p.select(*keep, *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("mean", 4), ("deviation", 4), ("entropy", 6), ("shift", 6))])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every schema change between consecutive loads."""
    return schema_drift.schema_changes(table(spark, d, "catalog_tables"), table(spark, d, "raw_records")).filter("change_kind <> 'moved'")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every record under its dataset's consistent column names."""
    rows = schema_drift.unified_records(table(spark, d, "catalog_tables"), table(spark, d, "raw_records"))
    return rows.select("dataset_name", "load_no", "record_no", F.to_json("fields").alias("fields"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant per event whose time can be read."""
    return instants.event_instants(table(spark, d, "trace_rows"), table(spark, d, "time_contracts"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_wide": p1_wide, "p2_found": p2_found, "p2_profile": p2_profile, "p4_found": p4_found, "p4_unified": p4_unified, "p5_found": p5_found}
SQL: dict[str, str] = {"p1_found": training_sql.P1, "p2_found": training_sql.P2, "p2_profile": training_sql.P2_PROFILE, "p4_found": training_sql.P4}
