"""Explicit schemas of every table, so that no reader infers types."""

from pyspark.sql import types as T

STRING, DOUBLE, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
BOOL, DATE = T.BooleanType(), T.DateType()


def _table(*groups: tuple[T.DataType, str]) -> T.StructType:
    """Nullable columns in order, given as groups of one type and their names."""
    return T.StructType([T.StructField(name, kind) for kind, names in groups for name in names.split()])


BRANDS = _table(
    (STRING, "brand_name category brand_type news_ticker ticker exchange"),
    (T.ArrayType(STRING), "search_terms"),
    (STRING, "trend_term"),
)

ARTICLE = _table(
    (STRING, "title description url publishedAt author"),
    (_table((STRING, "name")), "source"),
)

NEWS_PAYLOAD = _table(
    (STRING, "brand_name search_term"),
    (INT, "term_pos"),
    (STRING, "status"),
    (T.ArrayType(ARTICLE), "articles"),
)

OHLC_RAW = _table((STRING, "ticker"), (DATE, "date"), (DOUBLE, "open high low close volume"))

NEWS_BRONZE = _table(
    (STRING, "brand_name brand_type ticker category search_term"),
    (LONG, "article_id"),
    (STRING, "headline description source_name author url published_at ingested_at pipeline_source data_layer"),
)

STOCKS_BRONZE = _table(
    (STRING, "brand_name brand_type category ticker exchange date"),
    (DOUBLE, "open_price high_price low_price close_price"),
    (LONG, "volume"),
    (DOUBLE, "daily_change_pct price_range"),
    (STRING, "ingested_at pipeline_source data_layer"),
    (BOOL, "stock_available"),
)

TRENDS_BRONZE = _table(
    (STRING, "brand_name brand_type category search_term date"),
    (LONG, "trend_score"),
    (STRING, "timeframe geo ingested_at pipeline_source data_layer"),
    (BOOL, "stock_available"),
)

NEWS_SILVER = _table(
    (STRING, "brand_name category brand_type"),
    (DATE, "news_date"),
    (LONG, "daily_article_count"),
    (DOUBLE, "avg_daily_sentiment share_of_voice_pct"),
    (LONG, "positive_count negative_count"),
    (DOUBLE, "rolling_7d_avg news_velocity"),
    (STRING, "coverage_trend ingestion_date"),
)

STOCKS_SILVER = _table(
    (STRING, "brand_name brand_type category ticker exchange stock_date"),
    (DOUBLE, "open_price close_price high_price low_price"),
    (LONG, "volume"),
    (DOUBLE, "daily_change_pct volatility_7d"),
    (STRING, "price_signal ingested_at"),
    (BOOL, "stock_available"),
    (STRING, "data_source ingestion_date"),
)

TRENDS_SILVER = _table(
    (STRING, "brand_name brand_type category trend_date"),
    (LONG, "trend_score"),
    (DOUBLE, "trend_momentum trend_zscore"),
    (BOOL, "is_anomaly"),
    (STRING, "geo ingested_at"),
    (BOOL, "stock_available"),
    (STRING, "data_source ingestion_date"),
)

BRAND_HEALTH = _table(
    (STRING, "brand_name brand_type category"),
    (DATE, "processed_date"),
    (DOUBLE, "avg_daily_sentiment"),
    (LONG, "trend_score"),
    (DOUBLE, "trend_momentum share_of_voice_pct"),
    (LONG, "daily_article_count"),
    (DOUBLE, "news_velocity"),
    (STRING, "coverage_trend"),
    (DOUBLE, "close_price daily_change_pct volatility_7d"),
    (STRING, "price_signal"),
    (BOOL, "stock_available"),
    (DOUBLE, "sentiment_normalized"),
    (LONG, "trend_normalized"),
    (DOUBLE, "stock_normalized brand_health_index"),
    (STRING, "health_label"),
    (BOOL, "is_anomaly alert_flag"),
    (STRING, "alert_reason"),
    (DOUBLE, "last_week_index"),
    (STRING, "last_week_label"),
    (DOUBLE, "index_change_wow"),
    (STRING, "wow_direction"),
    (BOOL, "label_changed"),
    (DOUBLE, "sentiment_shift trend_shift"),
)

LAST_WEEK = _table(
    (STRING, "brand_name"),
    (STRING, "category"),
    (STRING, "brand_type"),
    (DOUBLE, "last_week_index"),
    (STRING, "last_week_label"),
    (DOUBLE, "last_week_sentiment"),
    (LONG, "last_week_trend"),
)

LEXICON = _table((STRING, "term"), (DOUBLE, "valence"))
