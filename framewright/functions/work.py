"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the checkpoint folder set on the context; a folder of our own only in local mode with neither."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and not context.getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
    return (found or context.getCheckpointDir().get()).rstrip("/")


_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: its lineage ends here, and Spark knows the table's size when it plans a join."""
    path = f"{shared_dir(df.sparkSession)}/framewright-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the work tables that this process has written, which results still read until then; how many there were."""
    found = len(_made)
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found
