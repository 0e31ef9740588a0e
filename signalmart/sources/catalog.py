"""Partitioned tables of the session's catalog, beside the folders of the other sources.

The catalog keeps the list of partitions, so a predicate on partition columns is answered from it: only the matching folders are
looked at, and neither files nor folders of other days are listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart import schemas

SILVER_PARTITIONS = ("ingestion_date", "category", "brand_name")
GOLD_PARTITIONS = ("processed_date",)
SILVER = {"news": schemas.NEWS_SILVER, "stocks": schemas.STOCKS_SILVER, "trends": schemas.TRENDS_SILVER}


def quoted(name: str) -> str:
    """A table name, with each of its parts quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Catalog:
    """Where tables are kept: a database, and optionally a folder for them that is not the database's own.

    Given to readers, writers and jobs in place of a path.
    """

    database: str = "default"
    location: str | None = None
    prefix: str = ""

    def name(self, table: str) -> str:
        return f"{self.database}.{self.prefix}{table}"

    def silver(self, source: str) -> str:
        return self.name(f"silver_{source}")

    def gold(self) -> str:
        return self.name("brand_health")

    def folder(self, name: str) -> str | None:
        return f"{self.location.rstrip('/')}/{name.rsplit('.', 1)[-1]}" if self.location else None

    def create(self, spark: SparkSession) -> None:
        """Create the silver and gold tables that do not exist."""
        for source, schema in SILVER.items():
            create_table(spark, self.silver(source), schema, SILVER_PARTITIONS, self.folder(self.silver(source)))
        create_table(spark, self.gold(), schemas.BRAND_HEALTH, GOLD_PARTITIONS, self.folder(self.gold()))


def create_table(
    spark: SparkSession, name: str, schema: T.StructType, partitions: Sequence[str], location: str | None = None
) -> None:
    """A parquet table with these partition columns, last in it as everywhere in Spark; nothing if it exists.

    An overwrite of a partition clears what lies below it, also folders that it brings no rows for.
    """
    columns = [f for f in schema if f.name not in partitions] + [schema[p] for p in partitions]
    spelled = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in columns)
    keys = ", ".join(map(quoted, partitions))
    place = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({spelled}) USING parquet "
              f"OPTIONS ('partitionOverwriteMode' = 'static') PARTITIONED BY ({keys}){place}")


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(quoted(name)) if c.isPartition]


def write_day(df: DataFrame, name: str, day: str, mode: str = "overwrite") -> None:
    """Write one day's rows, the day being the first partition column.

    ``overwrite`` replaces the whole day in one step, also by no rows; ``append`` adds to it.
    """
    spark = df.sparkSession
    first, *rest = partition_columns(spark, name)
    columns = [c.name for c in spark.catalog.listColumns(quoted(name)) if c.name != first]
    rows = df.select(*columns).hint("rebalance", *map(F.col, rest))
    keys = ", ".join([f"{quoted(first)} = {literal(day)}", *map(quoted, rest)])
    verb = "OVERWRITE TABLE" if mode == "overwrite" else "INTO"
    spark.sql(f"INSERT {verb} {quoted(name)} PARTITION ({keys}) SELECT * FROM {{rows}}", rows=rows)


def write_days(df: DataFrame, name: str) -> None:
    """Add rows of many days in one pass; each goes to the partitions its columns name."""
    spark = df.sparkSession
    keys = partition_columns(spark, name)
    columns = [c.name for c in spark.catalog.listColumns(quoted(name))]
    df.select(*columns).hint("rebalance", *map(F.col, keys)).write.insertInto(quoted(name))


def read_table(spark: SparkSession, name: str, where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table, or its partitions that fulfil a predicate, columns in a schema's order."""
    df = spark.table(quoted(name))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession, name: str) -> DataFrame:
    """What the catalog knows of a table's partitions, one column each."""
    keys = partition_columns(spark, name)
    listed = spark.sql(f"SHOW PARTITIONS {quoted(name)}")
    part = lambda k: F.url_decode(F.replace(F.regexp_extract("partition", f"(?:^|/){k}=([^/]*)", 1), F.lit("+"), F.lit("%2B")))
    return listed.select(*[part(k).alias(k) for k in keys])
