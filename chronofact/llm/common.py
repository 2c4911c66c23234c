"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: x20 and x09 to x0D.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (held := spark.sparkContext.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder goes with it
        pass


def keep_until_end(spark: SparkSession, path: str) -> None:
    """A folder of intermediate files goes when the driver's Python ends."""
    atexit.register(_delete, spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Unlike a local checkpoint the rows outlive every executor. The files go when
    the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_row(batches: Iterator[pa.RecordBatch], *, make: Callable, schema: pa.Schema, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Feed make(**columns) slices of at most `rows` rows; it returns columns or None."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            out = make(*(part.column(i) for i in range(part.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, schema.types, strict=True)], schema=schema)


def arrow_schema(ddl_fields: list[tuple[str, pa.DataType]]) -> tuple[pa.Schema, str]:
    """An Arrow schema and the same as Spark DDL."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    return pa.schema(ddl_fields), ", ".join(f"`{n}` {names[t]}" for n, t in ddl_fields)


def map_rows(df: DataFrame, make: Callable, fields: list[tuple[str, pa.DataType]], rows: int = 2000) -> DataFrame:
    """mapInArrow over slices: make gets one Arrow array for each column of df."""
    schema, ddl = arrow_schema(fields)
    return df.mapInArrow(partial(by_row, make=make, schema=schema, rows=rows), ddl)


def crc_mod(column: str, n: int):
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
