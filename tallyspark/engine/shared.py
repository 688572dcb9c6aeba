"""Helpers for reading tables and for cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that are trimmed from ids, names and values: ASCII blanks, no-break space, ideographic space.
BLANKS = " \t\r\n\u000b\u000c 　"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where a local session leaves it unset, a temporary one.

    Raises RuntimeError on a cluster without the setting, since a machine-local folder would be lost with the machine.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf)
        return conf
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"tallyspark-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def trimmed(c: Column | str) -> Column:
    """Text without outer blanks (see BLANKS); null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
