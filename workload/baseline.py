"""The same silver tables by windows over raw rows, as a yardstick.

Every figure is a window over rows that are not summed up, sentiment is a Python function per row, each table is counted
by a job of its own before one task writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import labels, text
from signalmart.sources.shared import shared_folder
from workload.inputs import AS_OF, LEXICON, Inputs


def write_single(df: DataFrame, name: str, schema) -> DataFrame:
    """Count, then write with one task."""
    df = df.withColumn("ingestion_date", F.lit(AS_OF)).select(*schema.fieldNames())
    df.count()
    path = shared_folder(df.sparkSession, name)
    df.repartition(1).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scorer():
    valences = dict(LEXICON)

    @F.udf("double")
    def score(headline):
        import re
        total = sum(valences.get(word, 0.0) for word in re.findall("[a-z]+", headline.lower()))
        return total / (total * total + 15.0) ** 0.5

    return score


def change(now: Column, base: Column, scale: int) -> Column:
    return F.when(base > 0, F.round((now - base) / base * 100, scale)).otherwise(0.0)


def news(i: Inputs) -> DataFrame:
    day = ["brand_name", "category", "brand_type", "news_date"]
    rows = i.news_bronze.where("headline is not null and brand_name is not null and url is not null").dropDuplicates(["url", "brand_name"])
    rows = rows.withColumns({"news_date": text.date_of(F.col("published_at")), "score": _scorer()("headline")})
    rows = rows.withColumns({"label": labels.sentiment_label(F.col("score")), "week": text.iso_week(F.col("news_date"))})

    def count_over(*keys: str) -> Column:
        return F.count("url").over(Window.partitionBy(*keys))

    of_day = Window.partitionBy(*day)
    wide = rows.select(
        *day, count_over(*day).alias("daily_article_count"), F.avg("score").over(of_day).alias("avg_daily_sentiment"),
        F.count_if(F.col("label") == "POSITIVE").over(of_day).alias("positive_count"),
        F.count_if(F.col("label") == "NEGATIVE").over(of_day).alias("negative_count"),
        F.round(count_over("category", "brand_name", "week") / count_over("category", "week") * 100, 2).alias("share_of_voice_pct"),
    ).distinct()
    trailing = Window.partitionBy("brand_name").orderBy("news_date").rowsBetween(1 - C.ROLLING_ROWS, 0)
    moving = wide.withColumn("rolling_7d_avg", F.round(F.avg("daily_article_count").over(trailing), 2)).withColumn(
        "news_velocity", change(F.col("daily_article_count"), F.col("rolling_7d_avg"), 2))
    return write_single(moving.withColumn("coverage_trend", labels.coverage_trend(F.col("news_velocity"))), "plain-news", schemas.NEWS_SILVER)


def stocks(i: Inputs, bars: DataFrame | None = None) -> DataFrame:
    rows = (i.stocks_bronze if bars is None else bars).where("close_price > 0").dropDuplicates(["ticker", "date"])
    series = Window.partitionBy("ticker").orderBy("date")
    moving = rows.withColumn("daily_change_pct", change(F.col("close_price"), F.lag("close_price").over(series), 4)).withColumn(
        "volatility_7d", F.round(F.stddev("daily_change_pct").over(series.rowsBetween(1 - C.ROLLING_ROWS, 0)), 4))
    return write_single(moving.withColumns({
        "stock_date": F.col("date"), "price_signal": labels.price_signal(F.col("daily_change_pct")), "data_source": F.lit(C.STOCKS_SOURCE),
    }), "plain-stocks", schemas.STOCKS_SILVER)


def trends(i: Inputs) -> DataFrame:
    rows = i.trends_bronze.where("trend_score is not null and brand_name is not null").dropDuplicates(["brand_name", "date"])
    series, whole = Window.partitionBy("brand_name").orderBy("date"), Window.partitionBy("brand_name")
    mean, spread = F.avg("trend_score").over(whole), F.stddev("trend_score").over(whole)
    scored = rows.withColumns({
        "trend_momentum": change(F.col("trend_score"), F.lag("trend_score").over(series), 2),
        "trend_zscore": F.when(spread > 0, F.round((F.col("trend_score") - mean) / spread, 4)).otherwise(0.0),
    })
    return write_single(scored.withColumns({
        "trend_date": F.col("date"), "is_anomaly": labels.is_anomaly(F.col("trend_zscore")), "data_source": F.lit(C.TRENDS_SOURCE),
    }), "plain-trends", schemas.TRENDS_SILVER)
