"""Bronze: JSON lines in a directory layout by category, brand and day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart import schemas

DAY_COLUMNS = ["year", "month", "day"]
# Trends land per category, the other two per category and brand.
UNIT_COLUMNS = {"news": ["category", "brand"], "stocks": ["category", "brand"], "trends": ["category"]}
SCHEMAS = {"news": schemas.NEWS_BRONZE, "stocks": schemas.STOCKS_BRONZE, "trends": schemas.TRENDS_BRONZE}


def _layout(source: str) -> list[str]:
    return [*UNIT_COLUMNS[source], *DAY_COLUMNS]


def _day_folders(root: str, source: str, day: str) -> str:
    """A pattern of the day's folders of all units."""
    d = date.fromisoformat(day)
    return f"{root}/{source}{'/*' * len(UNIT_COLUMNS[source])}/year={d.year}/month={d.month:02}/day={d.day:02}"


def rebalanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a directory side by side, with large directories split and small ones merged by size."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_bronze(df: DataFrame, root: str, source: str, day: str | None = None, mode: str = "append") -> None:
    """Land records below ``root/source``; ``day`` is the landing day, by default the one in ``ingested_at``.

    Units without records leave no directory, so a later run tries them again.
    """
    landed = F.lit(day).cast("date") if day else F.to_date(F.substring("ingested_at", 1, 10))
    layout = _layout(source)
    placed = df.withColumn("_day", landed).withColumns({
        "year": F.year("_day"),
        "month": F.format_string("%02d", F.month("_day")),
        "day": F.format_string("%02d", F.dayofmonth("_day")),
    }).drop("_day")
    if "brand" in layout:
        placed = placed.withColumn("brand", F.col("brand_name"))
    rebalanced(placed, layout).write.partitionBy(*layout).mode(mode).json(f"{root}/{source}")


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str
) -> DataFrame:
    """The files below ``path``, or no rows when there is nothing at that path; other errors are raised.

    Columns come in the order of the schema, directory columns included.
    """
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_bronze(spark: SparkSession, root: str, source: str, day: str | None = None) -> DataFrame:
    """Landed records of one day, or of all days.

    Types come from the table's schema, so there is no pass over the files to infer
    them; of a day only its own folders are listed and read.
    """
    schema = SCHEMAS[source]
    layout = _layout(source)
    missing = [c for c in layout if c not in schema.fieldNames()]
    with_layout = T.StructType([
        *schema.fields, *[T.StructField(c, T.IntegerType() if c in DAY_COLUMNS else T.StringType()) for c in missing]
    ])
    base = f"{root}/{source}"
    path = base if day is None else _day_folders(root, source, day)
    return read_or_empty(spark, path, with_layout, basePath=base).select(*schema.fieldNames())


DAMAGED = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "file", "record")])
RECORD = "_damaged_record"


def read_sound(spark: SparkSession, root: str, source: str, day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``read_bronze`` that goes on over damage: the readable records, and ``source, file, record`` of the others.

    A record that is no JSON object, or whose values do not have their types, is damaged; the record's text is kept.  A file that
    breaks off (a truncated archive) gives the records before the break.  Damage is told while parsing: no pass of its own.
    """
    schema = SCHEMAS[source]
    layout = [c for c in _layout(source) if c not in schema.fieldNames()]
    read = T.StructType([*schema.fields, *[T.StructField(c, T.IntegerType() if c in DAY_COLUMNS else T.StringType()) for c in layout],
                         T.StructField(RECORD, T.StringType())])
    base = f"{root}/{source}"
    try:
        parsed = spark.read.schema(read).options(
            basePath=base, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, ignoreCorruptFiles="true", ignoreMissingFiles="true",
        ).json(base if day is None else _day_folders(root, source, day))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([], DAMAGED)
    # Spark parses just the columns that a query needs.  What is damaged must not depend on them, so all are named here;
    # nothing of them is kept, and they are looked at for damaged records only.
    others = F.concat_ws("", *[F.col(c).cast("string") for c in schema.fieldNames()])
    record = F.when(F.col(RECORD).isNotNull(), F.concat(F.col(RECORD), F.substring(others, 1, 0)))
    damaged = parsed.where(record.isNotNull()).select(
        F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), record.alias("record"))
    return parsed.where(record.isNull()).select(*schema.fieldNames()), damaged


def quarantine(damaged: DataFrame, root: str, source: str, day: str) -> dict[str, int]:
    """Keep a day's damaged records aside, in place of those of an earlier run; returns their number per file."""
    folder = f"{root}/_quarantine/{source}/day={day}"
    damaged.write.mode("overwrite").parquet(folder)
    kept = damaged.sparkSession.read.schema(DAMAGED).parquet(folder)
    return {r.file: r["count"] for r in kept.groupBy("file").count().collect()}  # one per damaged file


def read_quarantine(spark: SparkSession, root: str, source: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/_quarantine/{source}", T.StructType([*DAMAGED, T.StructField("day", T.StringType())]), "parquet")


def landed_units(spark: SparkSession, root: str, source: str, day: str) -> DataFrame:
    """Units that already landed on a day, for ``operators.landing.skip_existing``.

    The day's files are listed and not opened: no column of their content is asked for.
    """
    units = UNIT_COLUMNS[source]
    names = T.StructType([T.StructField(c, T.StringType()) for c in units])
    try:
        files = spark.read.format("binaryFile").option("basePath", f"{root}/{source}").load(_day_folders(root, source, day))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], names).withColumnRenamed("brand", "brand_name")
    # From the paths, because values of directory columns are guessed to be numbers or dates.
    named = [F.url_decode(F.replace(F.regexp_extract("path", f"/{c}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias(c) for c in units]
    return files.select(*named).distinct().withColumnRenamed("brand", "brand_name")
