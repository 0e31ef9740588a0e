"""Silver: one table per source, partitioned by ingestion date, category and brand.

``root`` is a folder, with one folder of parquet per ingestion date, or a ``Catalog`` of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.sources import catalog
from signalmart.sources.bronze import read_or_empty, rebalanced
from signalmart.sources.catalog import Catalog

PARTITIONS = ("category", "brand_name")
SCHEMAS = catalog.SILVER


def _day_folder(root: str, source: str, day: str) -> str:
    return f"{root}/{source}/ingestion_date={day}"


def write_silver(df: DataFrame, root: str | Catalog, source: str, day: str, mode: str = "overwrite") -> None:
    """Write one run's rows, all of ingestion date ``day``.

    ``overwrite`` replaces the day as a whole, also by no rows, so a run after a correction leaves
    nothing of the run before; ``append`` adds to it.
    """
    if isinstance(root, Catalog):
        return catalog.write_day(df, root.silver(source), day, mode)
    rebalanced(df.drop("ingestion_date"), PARTITIONS).write.partitionBy(*PARTITIONS).mode(mode).option(
        "partitionOverwriteMode", "static"
    ).parquet(_day_folder(root, source, day))


def write_silver_days(df: DataFrame, root: str | Catalog, source: str) -> None:
    """Add the rows of many ingestion dates in one pass."""
    if isinstance(root, Catalog):
        return catalog.write_days(df, root.silver(source))
    layout = ("ingestion_date", *PARTITIONS)
    rebalanced(df, layout).write.partitionBy(*layout).mode("append").parquet(f"{root}/{source}")


def read_silver(spark: SparkSession, root: str | Catalog, source: str, ingestion_date: str | None = None) -> DataFrame:
    """Rows of one ingestion date, of which nothing but its own partitions is listed, or all rows."""
    if isinstance(root, Catalog):
        where = None if ingestion_date is None else F.col("ingestion_date") == ingestion_date
        return catalog.read_table(spark, root.silver(source), where, SCHEMAS[source].fieldNames())
    path = f"{root}/{source}"
    return read_or_empty(
        spark, path if ingestion_date is None else _day_folder(root, source, ingestion_date), SCHEMAS[source], "parquet",
        basePath=path)
