"""Queries of the llm operators (p3 and p6 to p8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.engine.shared import table
from tallyspark.llm import leakage, packing, sentences, spectral_rank

#: Edits that p7_edited allows in a run.
EDITS = 2


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every team with its strength, rank and connected part."""
    return spectral_rank.rank_teams(table(spark, d, "matches"), table(spark, d, "teams"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest teams."""
    return p3_ranking(spark, d).orderBy("rank").limit(10).select("team_name")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container, for every budget."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_budgets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing puts into more than one container."""
    return packing.split_documents(p6_packing(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each budget beside a certified lower bound and what plain largest first needs."""
    r = packing.packing_report(table(spark, d, "documents"), table(spark, d, "context_budgets"))
    return r.select("budget_name", "capacity_tokens", "n_full", "n_packed", "n_by_program", "n_largest_first", F.round("bound", 4).alias("bound"), F.round("plain_volume", 4).alias("plain_volume"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the documents they leaked into."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the documents they leaked into, runs with up to two edits included."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), max_errors=EDITS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence, heading and list item of every document."""
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p3_ranking": p3_ranking, "p6_found": p6_found, "p6_packing": p6_packing, "p6_report": p6_report, "p7_found": p7_found, "p7_edited": p7_edited, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6}


P6 = """
SELECT budget_name, doc_id FROM documents, context_budgets
WHERE octet_length(encode(coalesce(text, ''))) + 1 > capacity_tokens
"""
