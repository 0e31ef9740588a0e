"""Gold: one composite health row per brand and day."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import labels, scaling
from signalmart.operators.rows import dedupe, latest_on_dates, latest_per_key

JOIN_KEYS = ["brand_name", "category", "brand_type"]
NEWS_COLUMNS = [
    "avg_daily_sentiment", "share_of_voice_pct", "news_velocity", "coverage_trend", "daily_article_count",
]
TRENDS_COLUMNS = ["trend_score", "trend_momentum", "is_anomaly"]
STOCKS_COLUMNS = ["close_price", "daily_change_pct", "volatility_7d", "price_signal", "stock_available"]
WOW_COLUMNS = [
    "last_week_index", "last_week_label", "index_change_wow", "wow_direction", "label_changed",
    "sentiment_shift", "trend_shift",
]


def join_sources(news: DataFrame, trends: DataFrame, stocks: DataFrame, as_of: str, grain: str = "latest") -> DataFrame:
    """News per brand with its trends and, where there are any, its share prices.

    ``grain="latest"`` takes the newest row per brand and source up to ``as_of``: one
    row per brand, category and type.  ``grain="all"`` joins every row of the given tables on the brand
    keys alone, so its output multiplies; give it one ingestion.
    """
    sources = [(news, "news_date", NEWS_COLUMNS), (trends, "trend_date", TRENDS_COLUMNS),
               (stocks, "stock_date", STOCKS_COLUMNS)]
    if grain == "latest":
        limit = {"news_date": F.lit(as_of).cast("date")}
        sources = [
            (latest_per_key(df.select(*JOIN_KEYS, date, *columns), JOIN_KEYS, date, limit.get(date, F.lit(as_of))),
             date, columns)
            for df, date, columns in sources
        ]
    elif grain != "all":
        raise ValueError(f"grain must be 'latest' or 'all', not {grain!r}")
    per_source = [df.select(*JOIN_KEYS, *columns) for df, _, columns in sources]
    joined = per_source[0].join(per_source[1], JOIN_KEYS, "left").join(per_source[2], JOIN_KEYS, "left")
    return joined.withColumn("stock_available", labels.holds(F.col("stock_available")))


def join_sources_on(
    news: DataFrame, trends: DataFrame, stocks: DataFrame, dates: Sequence[str], visible: Callable[[str], Column] | None = None
) -> DataFrame:
    """``join_sources`` of several days, with their ``processed_date``: every source is read once for all of them.

    ``visible`` may tell which rows a date sees besides those up to it.
    """
    sources = [(news, "news_date", NEWS_COLUMNS), (trends, "trend_date", TRENDS_COLUMNS), (stocks, "stock_date", STOCKS_COLUMNS)]
    seen_by = ["ingestion_date"] if visible else []
    latest = [
        latest_on_dates(df.select(*JOIN_KEYS, date, *columns, *seen_by), JOIN_KEYS, date, dates, "processed_date", visible)
        .select(*JOIN_KEYS, "processed_date", *columns) for df, date, columns in sources
    ]
    joined = reduce(lambda left, right: left.join(right, [*JOIN_KEYS, "processed_date"], "left"), latest)
    return joined.withColumn("stock_available", labels.holds(F.col("stock_available")))


def join_size(news: DataFrame, trends: DataFrame, stocks: DataFrame) -> DataFrame:
    """Rows per brand that ``grain="all"`` would produce, without producing them."""
    sizes = [df.groupBy(*JOIN_KEYS).agg(F.count("*").alias(name))
             for name, df in (("news_rows", news), ("trends_rows", trends), ("stocks_rows", stocks))]
    joined = sizes[0].join(sizes[1], JOIN_KEYS, "left").join(sizes[2], JOIN_KEYS, "left")
    factors = [F.coalesce(name, F.lit(1)) for name in ("trends_rows", "stocks_rows")]
    return joined.withColumn("joined_rows", F.col("news_rows") * factors[0] * factors[1])


def normalize(joined: DataFrame) -> DataFrame:
    return joined.withColumns({
        "sentiment_normalized": scaling.sentiment_normalized(F.col("avg_daily_sentiment")),
        "trend_normalized": scaling.trend_normalized(F.col("trend_score")),
        "stock_normalized": scaling.stock_normalized(F.col("stock_available"), F.col("daily_change_pct")),
    })


def health(normalized: DataFrame, listed: dict | None = None, private: dict | None = None) -> DataFrame:
    """Composite index and its label; other weights may be given per brand type."""
    weights = {name: value for name, value in (("listed", listed), ("private", private)) if value}
    index = scaling.composite_index(F.col("stock_available"), **weights)
    return normalized.withColumn("brand_health_index", index).withColumn(
        "health_label", labels.health_label(F.col("brand_health_index"))
    )


def alerts(df: DataFrame) -> DataFrame:
    inputs = [F.col("avg_daily_sentiment"), F.col("is_anomaly"), F.col("coverage_trend")]
    return df.withColumns({"alert_flag": labels.alert_flag(*inputs), "alert_reason": labels.alert_reason(*inputs)})


def last_week(gold: DataFrame, day: Column | str) -> DataFrame:
    """The comparison columns of the gold rows processed on ``day``."""
    return gold.where(F.col("processed_date") == F.lit(day).cast("date")).select(
        *JOIN_KEYS,
        F.col("brand_health_index").alias("last_week_index"),
        F.col("health_label").alias("last_week_label"),
        F.col("sentiment_normalized").alias("last_week_sentiment"),
        F.col("trend_normalized").alias("last_week_trend"),
    )


def _compare(compared: DataFrame, any_history: Column) -> DataFrame:
    """The comparison columns of rows that carry last week's."""
    change = scaling.point_change(F.col("brand_health_index"), F.col("last_week_index"))
    label_changed = labels.holds(F.col("health_label") != F.col("last_week_label"))
    return compared.withColumn("index_change_wow", change).withColumn("_any_history", any_history).withColumns({
        "wow_direction": F.when(F.col("_any_history"), labels.wow_direction(F.col("index_change_wow"))),
        "label_changed": F.when(F.col("_any_history"), label_changed),
        "sentiment_shift": scaling.point_change(F.col("sentiment_normalized"), F.col("last_week_sentiment")),
        "trend_shift": scaling.point_change(
            F.col("trend_normalized"), F.col("last_week_trend")
        ).cast("double"),
    }).drop("_any_history", "last_week_sentiment", "last_week_trend")


def week_over_week(gold: DataFrame, history: DataFrame | None) -> DataFrame:
    """Compare with last week's rows.

    Without any history all seven columns are null.  With history, a brand that is missing
    from it counts as STABLE and unchanged.  Whether there is history is a scalar
    subquery of the plan, not a count on the driver.
    """
    if history is None:
        fields = {f.name: f.dataType for f in schemas.BRAND_HEALTH if f.name in WOW_COLUMNS}
        return gold.withColumns({name: F.lit(None).cast(fields[name]) for name in WOW_COLUMNS})
    any_history = history.agg((F.count("*") > 0).alias("any_history")).scalar()
    return _compare(gold.join(dedupe(history, JOIN_KEYS), JOIN_KEYS, "left"), any_history)


def week_over_week_on(gold: DataFrame, history: DataFrame, days: int = C.WOW_DAYS) -> DataFrame:
    """The same for rows of several processed dates, each compared with ``history`` of ``days`` before it."""
    before = history.select(
        *JOIN_KEYS, F.date_add("processed_date", days).alias("processed_date"),
        F.col("brand_health_index").alias("last_week_index"), F.col("health_label").alias("last_week_label"),
        F.col("sentiment_normalized").alias("last_week_sentiment"), F.col("trend_normalized").alias("last_week_trend"))
    keys = [*JOIN_KEYS, "processed_date"]
    dates = before.select("processed_date").distinct().withColumn("_had", F.lit(True))  # one row per day
    joined = gold.join(dedupe(before, keys), keys, "left").join(F.broadcast(dates), "processed_date", "left")
    return _compare(joined, F.coalesce("_had", F.lit(False))).drop("_had")


def current_on(
    news: DataFrame, trends: DataFrame, stocks: DataFrame, dates: Sequence[str], visible: Callable[[str], Column] | None = None
) -> DataFrame:
    """The gold rows of several dates without their comparison, from one pass over each source."""
    return alerts(health(normalize(join_sources_on(news, trends, stocks, dates, visible))))


def brand_health(
    news: DataFrame, trends: DataFrame, stocks: DataFrame, as_of: str, history: DataFrame | None = None,
) -> DataFrame:
    """The gold table for ``as_of`` from the three silver tables."""
    current = alerts(health(normalize(join_sources(news, trends, stocks, as_of))))
    dated = current.withColumn("processed_date", F.lit(as_of).cast("date"))
    return week_over_week(dated, history).select(*schemas.BRAND_HEALTH.fieldNames())
