"""Gold: the brand health table by processed date, as a folder of parquet, in a ``Catalog``, or in a warehouse by JDBC."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.plans.gold import last_week
from signalmart.sources import catalog
from signalmart.sources.bronze import read_or_empty, rebalanced
from signalmart.sources.catalog import Catalog

TABLE = "BRAND_HEALTH"
PARTITIONS = ("processed_date",)


def week_before(as_of: str) -> str:
    day = date.fromisoformat(as_of)
    return date.fromordinal(day.toordinal() - C.WOW_DAYS).isoformat()


def lowercase_columns(df: DataFrame) -> DataFrame:
    """Lower-case names: warehouses tend to answer in upper case."""
    return df.toDF(*[c.lower() for c in df.columns])


def write_gold(df: DataFrame, path: str | Catalog, mode: str = "overwrite", day: str | None = None) -> None:
    """Write the rows of their processed dates, replacing those dates or appending to them.

    With ``day`` all rows are of that processed date, which is replaced as a whole, also by no rows.
    """
    if isinstance(path, Catalog):
        if day is None:
            raise ValueError("a catalog table is written by processed date: name the day")
        return catalog.write_day(df, path.gold(), day, mode)
    if day is not None:
        rebalanced(df.drop("processed_date"), ()).write.mode(mode).parquet(f"{path}/processed_date={day}")
        return None
    rebalanced(df, PARTITIONS).write.partitionBy(*PARTITIONS).mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def read_gold(spark: SparkSession, path: str | Catalog, processed_date: str | None = None) -> DataFrame:
    where = None if processed_date is None else F.col("processed_date") == F.lit(processed_date).cast("date")
    if isinstance(path, Catalog):
        return catalog.read_table(spark, path.gold(), where, schemas.BRAND_HEALTH.fieldNames())
    df = read_or_empty(spark, path, schemas.BRAND_HEALTH, "parquet")
    return df if where is None else df.where(where)


def read_history(spark: SparkSession, path: str | Catalog, as_of: str) -> DataFrame:
    """Comparison columns of the gold rows one week before ``as_of``; no rows on a first run."""
    return last_week(read_gold(spark, path, week_before(as_of)), week_before(as_of))


def write_gold_jdbc(
    df: DataFrame, url: str, properties: Mapping[str, str], table: str = TABLE, connections: int = 8
) -> None:
    """Append to a warehouse table over a bounded number of connections."""
    df.write.option("numPartitions", connections).jdbc(url, table, mode="append", properties=dict(properties))


def history_query(as_of: str, table: str = TABLE) -> str:
    """The warehouse query for last week's comparison columns."""
    return (
        "SELECT brand_name, category, brand_type, brand_health_index AS last_week_index, health_label AS last_week_label, "
        "sentiment_normalized AS last_week_sentiment, trend_normalized AS last_week_trend "
        f"FROM {table} WHERE processed_date = DATE '{week_before(as_of)}'"
    )


def read_history_jdbc(
    spark: SparkSession, url: str, properties: Mapping[str, str], as_of: str, table: str = TABLE
) -> DataFrame:
    """``read_history`` from a warehouse, which runs the projection and the date filter itself."""
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    return lowercase_columns(reader.option("query", history_query(as_of, table)).load())
