"""Tables that a job writes once to the shared folder and reads back.

The folder is ``spark.checkpoint.dir`` of the session. A written table cuts the
lineage and outlives lost executors; tables of finished rounds are deleted.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.scale import shared_dir


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one that no column of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return freed memory to the system, as a Python worker stays idle for long between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


class Stages:
    """Folder of one job with named tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Have the driver look for shuffled data that nothing reads any more, which else stays on disk until it runs short of memory."""
        gc.collect()
        self.spark._jvm.System.gc()
