"""Runs a streaming frame over what its sources hold now."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for applications that have none set.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset and Spark is local, one folder of this machine for the application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return _OWN[app]


def drained(df: DataFrame) -> DataFrame:
    """The rows that the stream emits until its sources are used up, from files in the shared folder."""
    spark = df.sparkSession
    top = f"{shared_folder(spark).rstrip('/')}/tidemark/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/rows")
