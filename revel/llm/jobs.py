"""Spark-side helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from revel.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: it cuts the
    lineage, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of finished jobs: its cleaner acts on what the driver's collector has found
    unreachable, which a driver with room to spare looks for too seldom for a job of many rounds."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def pieces_for(spark: SparkSession, size: int, each: int) -> int:
    """How many groups hold ``size`` bytes at about ``each`` bytes a group, at
    least one for each shuffle partition."""
    return max(partitions(spark), math.ceil(size / each))


def batch_bytes(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound the session's Arrow batches by fewer bytes than Spark's default of 64 MB, unless the session has its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) == 64 << 20:
        spark.conf.set(name, str(most))


def lean(task, keep_encoders: bool = False):
    """A ``mapInArrow`` function that gives memory back: what earlier stages left in a reused Python worker (token encoders, unless the
    task itself uses them, and tables of powers) goes when a task begins, and freed pages return to the system at its end."""

    def run(batches):
        from revel.llm import arrays, tokens

        if not keep_encoders:
            tokens.forget()
        arrays.forget()
        trim()
        yield from task(batches)
        arrays.forget()
        trim()

    return run


def trim() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def schema(first: dict[str, DataType], ddl: str) -> StructType:
    """Columns of given types, then those of a DDL string."""
    out = StructType()
    for name, kind in first.items():
        out = out.add(name, kind)
    return StructType([*out, *StructType.fromDDL(ddl)])
