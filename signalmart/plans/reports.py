"""The analyst reports over the gold table, for one processed date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C


def _on(gold: DataFrame, as_of: str) -> DataFrame:
    return gold.where(F.col("processed_date") == F.lit(as_of).cast("date"))


def _mean(column: str, scale: int) -> Column:
    return F.round(F.avg(column), scale)


def _mean_index() -> Column:
    """Mean of the two-decimal index, summed exactly: ties then round the same in any order of tasks."""
    index = F.col("brand_health_index")
    total = F.sum(index.cast("decimal(18,2)")).cast("double")
    return F.round(total / F.nullif(F.count(index), F.lit(0)), 2)


def leaderboard(gold: DataFrame, as_of: str) -> DataFrame:
    """Brands by index, best first; brands without an index lead, as in the warehouse."""
    return _on(gold, as_of).select(
        "brand_name", "category", "brand_health_index", "health_label", "alert_flag"
    ).orderBy(F.desc_nulls_first("brand_health_index"), "brand_name", "category")


def alert_list(gold: DataFrame, as_of: str) -> DataFrame:
    """Brands with an alert and its reason, worst first."""
    return _on(gold, as_of).where("alert_flag").select(
        "brand_name", "category", "brand_health_index", "health_label", "alert_reason"
    ).orderBy(F.asc_nulls_last("brand_health_index"), "brand_name", "category")


def category_summary(gold: DataFrame, as_of: str) -> DataFrame:
    """Brands, mean index, STRONG and HEALTHY brands and alerts per category."""
    return _on(gold, as_of).groupBy("category").agg(
        F.count("brand_name").alias("total_brands"),
        _mean_index().alias("avg_health"),
        F.count_if(F.col("health_label") == "STRONG").alias("strong"),
        F.count_if(F.col("health_label") == "HEALTHY").alias("healthy"),
        F.count_if("alert_flag").alias("alerts"),
    ).orderBy(F.desc_nulls_first("avg_health"), "category")


def week_over_week_report(gold: DataFrame, as_of: str) -> DataFrame:
    """Index and label against last week, largest fall first."""
    return _on(gold, as_of).select(
        "brand_name",
        F.col("brand_health_index").alias("this_week"),
        F.col("last_week_index").alias("last_week"),
        F.col("index_change_wow").alias("change"),
        "wow_direction",
        "label_changed",
        F.col("last_week_label").alias("was"),
        F.col("health_label").alias("now"),
    ).orderBy(F.asc_nulls_last("change"), "brand_name")


def brand_type_summary(gold: DataFrame, as_of: str) -> DataFrame:
    """Listed against private brands: count, mean index, mean sentiment, mean trend score."""
    return _on(gold, as_of).groupBy("brand_type").agg(
        F.count("brand_name").alias("brand_count"),
        _mean_index().alias("avg_health"),
        _mean("avg_daily_sentiment", 4).alias("avg_sentiment"),
        _mean("trend_score", 2).alias("avg_trend"),
    )


def preview(gold: DataFrame, n: int = C.PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` brands by name with their headline columns."""
    return gold.select(
        "brand_name", "brand_health_index", "health_label", "alert_flag", "index_change_wow", "wow_direction"
    ).orderBy("brand_name", "brand_health_index").limit(n)
