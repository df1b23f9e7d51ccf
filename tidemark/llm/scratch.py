"""Tables that cut lineage: written to the shared folder, read again, dropped when used up."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming.run import shared_folder


#: Folders of this process's jobs.
_MADE: list[str] = []


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables of all jobs so far; results that were not read yet need them."""
    while _MADE:
        _delete(spark, _MADE.pop())


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage where that has spread over half of the heap.

    A job of many small queries leaves plans, events of tasks and broadcasts behind; until they are collected the heap
    grows to all it may have, and Spark keeps the shuffle files of finished tables.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        gc.collect()  # Python's references to plans go first
        spark._jvm.java.lang.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the frame's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


class Scratch:
    """Tables of one job; those that a lazy result reads stay in the folder until ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
        self.n = 0
        _MADE.append(self.top)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        tidy(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def buckets(self, df: DataFrame, key: str) -> DataFrame:
        """As ``table``, but dealt by ``key``: joins on it move the other side only."""
        self.n += 1
        name, path = f"tidemark_{self.top.rsplit('/', 1)[1]}_{self.n}", f"{self.top}/{self.n}"
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(count, key).option("path", path).saveAsTable(name)
        tidy(self.spark)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name; the files stay, and ``out`` knows them
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no unread result needs."""
        for df in tables:
            _delete(self.spark, df._tidemark_path)
