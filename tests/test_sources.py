"""Readers and writers: schemas, pruning, repeated runs."""

import datetime as dt
import os

import pytest
from helpers import plan, rows, shape
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from signalmart import schemas
from signalmart.plans.gold import week_over_week
from signalmart.sources import bronze, gold, shared, silver


def trend_rows(spark, days=("2024-01-01", "2024-01-02"), brands=("Thums Up", "A/B=c")):
    data = [(b, "private", "Cat 1", "term", d, k, "m", "IN", f"{d}T03:00:00Z", "s", "bronze", False)
            for k, b in enumerate(brands) for d in days]
    return spark.createDataFrame(data, schemas.TRENDS_BRONZE)


def news_rows(spark, day):
    data = [("A b", "private", None, "C", "t", 1, "Head é \"x\"\n2", None, "s", None, "u", f"{day}T00:00:00Z",
             f"{day}T01:00:00Z", "newsapi", "bronze")]
    return spark.createDataFrame(data, schemas.NEWS_BRONZE)


def test_bronze_layout_and_roundtrip(spark, root):
    bronze.write_bronze(trend_rows(spark), root, "trends")
    bronze.write_bronze(news_rows(spark, "2024-01-05"), root, "news")
    assert os.path.isdir(f"{root}/trends/category=Cat 1/year=2024/month=01/day=02")
    assert os.path.isdir(f"{root}/news/category=C/brand=A b/year=2024/month=01/day=05")
    assert rows(bronze.read_bronze(spark, root, "trends")) == rows(trend_rows(spark))
    got = bronze.read_bronze(spark, root, "news")
    assert shape(got.schema) == shape(schemas.NEWS_BRONZE)
    assert rows(got) == rows(news_rows(spark, "2024-01-05"))


def test_bronze_day_is_pruned_by_directory(spark, root):
    bronze.write_bronze(trend_rows(spark), root, "trends")
    day = bronze.read_bronze(spark, root, "trends", "2024-01-02")
    assert {r.date for r in day.collect()} == {"2024-01-02"}
    assert day.inputFiles() and all("/year=2024/month=01/day=02/" in f for f in day.inputFiles())


def test_landing_day_can_be_given(spark, root):
    bronze.write_bronze(trend_rows(spark), root, "trends", day="2024-03-09")
    assert bronze.read_bronze(spark, root, "trends", "2024-03-09").count() == 4
    assert rows(bronze.landed_units(spark, root, "trends", "2024-03-09")) == [("Cat 1",)]
    assert bronze.landed_units(spark, root, "trends", "2024-03-10").isEmpty()
    bronze.write_bronze(news_rows(spark, "2024-01-05"), root, "news")
    units = bronze.landed_units(spark, root, "news", "2024-01-05")
    assert units.columns == ["category", "brand_name"] and rows(units) == [("C", "A b")]


def test_nothing_landed_is_no_rows_but_other_errors_are_raised(spark, root):
    assert bronze.read_bronze(spark, root, "stocks", "2024-01-01").isEmpty()
    assert shape(silver.read_silver(spark, root, "news", "2024-01-01").schema) == shape(schemas.NEWS_SILVER)
    assert gold.read_history(spark, f"{root}/none", "2024-01-08").isEmpty()
    bronze.write_bronze(trend_rows(spark).where("false"), root, "trends")
    assert bronze.read_bronze(spark, root, "trends", "2024-01-01").isEmpty()
    with pytest.raises(Exception) as error:
        bronze.read_or_empty(spark, root, schemas.LEXICON, "no-such-format")
    assert not isinstance(error.value, AnalysisException) or error.value.getCondition() != "PATH_NOT_FOUND"


def silver_rows(spark, day, brands=("A", "B", "C")):
    data = [(b, "private", "c", day, k, 0.0, 0.0, False, "IN", None, False, "g", day) for k, b in enumerate(brands)]
    return spark.createDataFrame(data, schemas.TRENDS_SILVER)


def test_a_silver_run_replaces_its_day_and_append_adds(spark, root):
    first = silver_rows(spark, "2024-01-01")
    for day in ("2024-01-01", "2024-01-02", "2024-01-01"):
        silver.write_silver(silver_rows(spark, day), root, "trends", day)
    assert silver.read_silver(spark, root, "trends").count() == 6
    assert rows(silver.read_silver(spark, root, "trends", "2024-01-01")) == rows(first)
    silver.write_silver(first, root, "trends", "2024-01-01", mode="append")
    assert silver.read_silver(spark, root, "trends", "2024-01-01").count() == 6
    silver.write_silver(silver_rows(spark, "2024-01-01", "A"), root, "trends", "2024-01-01")
    assert [r.brand_name for r in silver.read_silver(spark, root, "trends", "2024-01-01").collect()] == ["A"]
    silver.write_silver(first.where("false"), root, "trends", "2024-01-01")
    assert silver.read_silver(spark, root, "trends", "2024-01-01").isEmpty()
    assert silver.read_silver(spark, root, "trends").count() == 3


def test_a_day_of_silver_lists_just_its_folder(spark, root):
    for day in ("2024-01-01", "2024-01-02"):
        silver.write_silver(silver_rows(spark, day), root, "trends", day)
    scan = silver.read_silver(spark, root, "trends", "2024-01-01").select("brand_name", "trend_score", "ingestion_date")
    assert scan.schema["ingestion_date"].dataType.simpleString() == "string"
    assert {r.ingestion_date for r in scan.collect()} == {"2024-01-01"}
    assert scan.inputFiles() and all("ingestion_date=2024-01-01" in f for f in scan.inputFiles())
    assert "ReadSchema: struct<trend_score:bigint>" in plan(scan.select("brand_name", "trend_score"))


def test_landed_units_come_from_the_listing(spark, root):
    bronze.write_bronze(trend_rows(spark), root, "trends")
    units = bronze.landed_units(spark, root, "trends", "2024-01-01")
    assert "Scan json" not in plan(units) and "content" not in plan(units)
    assert bronze.landed_units(spark, f"{root}/none", "trends", "2024-01-01").isEmpty()



def gold_rows(spark, day, index=50.0, brands=("A", "B")):
    empty = spark.createDataFrame([], schemas.BRAND_HEALTH)
    data = [(b, "c", "listed", "WEAK", dt.date.fromisoformat(day), index, 50.0, 40) for b in brands]
    df = spark.createDataFrame(data, "brand_name string, category string, brand_type string, health_label string, processed_date date,"
                                     " brand_health_index double, sentiment_normalized double, trend_normalized bigint")
    return empty.unionByName(df, allowMissingColumns=True)


def test_gold_days_are_replaced_and_history_is_the_week_before(spark, root):
    path = f"{root}/gold"
    for day, index in (("2024-01-01", 40.0), ("2024-01-08", 50.0), ("2024-01-08", 60.0)):
        gold.write_gold(gold_rows(spark, day, index), path)
    assert rows(gold.read_gold(spark, path, "2024-01-08").select("brand_name", "brand_health_index")) == [
        ("A", 60.0), ("B", 60.0)]
    history = gold.read_history(spark, path, "2024-01-08")
    assert history.schema.fieldNames() == schemas.LAST_WEEK.fieldNames()
    rest = ("c", "listed", 40.0, "WEAK", 50.0, 40)
    assert rows(history) == [("A", *rest), ("B", *rest)]
    text = plan(history)
    assert "processed_date" in text[text.index("PartitionFilters"):]
    compared = week_over_week(gold.read_gold(spark, path, "2024-01-08").drop(*[
        c for c in schemas.BRAND_HEALTH.fieldNames() if "week" in c or "wow" in c or "shift" in c
        or c in ("label_changed",)]), history)
    assert rows(compared.select("brand_name", "index_change_wow", "wow_direction")) == [
        ("A", 20.0, "IMPROVING"), ("B", 20.0, "IMPROVING")]


def test_lowercase_columns(spark):
    df = spark.createDataFrame([(1, 2)], "BRAND_NAME int, Last_Week int")
    assert gold.lowercase_columns(df).columns == ["brand_name", "last_week"]


def test_jdbc_calls_without_a_database(spark, monkeypatch):
    """No database is started here: only what would be sent to it is checked."""
    from pyspark.sql import DataFrameWriter
    sent = {}
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, url, table, mode=None, properties=None: sent.update(
        url=url, table=table, mode=mode, properties=properties))
    gold.write_gold_jdbc(gold_rows(spark, "2024-01-08"), "jdbc:x:y", {"user": "u"})
    assert sent == {"url": "jdbc:x:y", "table": "BRAND_HEALTH", "mode": "append", "properties": {"user": "u"}}
    assert gold.history_query("2026-03-22").endswith("FROM BRAND_HEALTH WHERE processed_date = DATE '2026-03-15'")
    with pytest.raises(ValueError):
        gold.history_query("2026-03-22' OR '1'='1")


def test_stage_writes_to_the_folder_named_by_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    staged = shared.stage("probe")(spark.range(5).select(F.col("id").alias("x")))
    assert rows(staged) == [(k,) for k in range(5)]
    assert all(folder in f for f in staged.inputFiles())
    assert shared.shared_folder(spark, "a") != shared.shared_folder(spark, "a")


def test_shuffle_partitions_follow_the_largest_shuffle():
    from signalmart.session import shuffle_partitions
    assert shuffle_partitions(10) == 200
    assert shuffle_partitions(5 * 1024 ** 4) == 40_960
