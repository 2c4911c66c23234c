"""New folders that driver and executors share, and tables in them that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(spark) -> str:
    """Under spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine.

    It goes when the driver's Python ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark, path: str) -> None:
    from . import files

    try:
        files.delete(spark, path)
    except Exception:  # the session has ended: its folder goes with it
        pass


def materialise(rows: DataFrame) -> DataFrame:
    """The rows written as a table and read again: they outlive every executor, and go when the driver ends."""
    spark = rows.sparkSession
    path = folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
