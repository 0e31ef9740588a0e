"""Tables written in between, in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    A session without that setting gets a folder in its warehouse, which executors share too.
    """
    root = spark.conf.get(FOLDER_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(name: str = "stage", made: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A step that writes a table to the shared folder and goes on from there.

    Use it where a result is read more than once: it is computed once, the lineage ends
    there, and losing an executor costs no recomputation of what was written.  ``made``
    collects the paths, for ``remove`` once the job has written its result.
    """

    def write_and_read(df: DataFrame) -> DataFrame:
        path = shared_folder(df.sparkSession, name)
        if made is not None:
            made.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return write_and_read
