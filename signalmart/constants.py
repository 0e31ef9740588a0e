"""Thresholds, weights and labels used by the signal operators, in one place.

A *band* is ``(operator, threshold, label)``; bands are tried in order and the
first one that holds gives the label, see ``functions.labels.band``.
"""

# Sentiment label of a score in [-1, 1].
SENTIMENT_BANDS = (
    (">=", 0.05, "POSITIVE"),
    ("<=", -0.05, "NEGATIVE"),
)
SENTIMENT_DEFAULT = "NEUTRAL"

# Coverage trend of a news velocity in percent.
COVERAGE_BANDS = (
    (">", 20, "ACCELERATING"),
    ("<", -20, "DECELERATING"),
)
COVERAGE_DEFAULT = "STABLE"

# Price signal of a daily change in percent.
PRICE_BANDS = (
    (">", 2.0, "STRONG_UP"),
    (">", 0.5, "UP"),
    ("<", -2.0, "STRONG_DOWN"),
    ("<", -0.5, "DOWN"),
)
PRICE_DEFAULT = "FLAT"

# Health label of the composite index; a null index falls through to the default.
HEALTH_BANDS = (
    (">=", 75, "STRONG"),
    (">=", 55, "HEALTHY"),
    (">=", 35, "WEAK"),
)
HEALTH_DEFAULT = "AT_RISK"

# Week-over-week direction of the index change in points.
WOW_BANDS = (
    (">", 5, "IMPROVING"),
    ("<", -5, "DECLINING"),
)
WOW_DEFAULT = "STABLE"

# Composite index weights by normalised signal, summed in this order.
LISTED_WEIGHTS = {
    "sentiment_normalized": 0.30,
    "trend_normalized": 0.30,
    "stock_normalized": 0.30,
    "share_of_voice_pct": 0.10,
}
PRIVATE_WEIGHTS = {
    "sentiment_normalized": 0.40,
    "trend_normalized": 0.40,
    "share_of_voice_pct": 0.20,
}

# Anomaly and alert rules.
ANOMALY_ZSCORE = 2.0
ALERT_SENTIMENT = -0.5
REASON_SENTIMENT = "High negative sentiment"
REASON_ANOMALY = "Abnormal trend spike — zscore > 2"
REASON_COVERAGE = "Accelerating negative coverage"

# Stock change of -5 % .. +5 % maps to 0 .. 100, an unknown change to 50.
STOCK_CHANGE_LIMIT = 5
STOCK_UNKNOWN = 50.0

# Rolling windows, look-backs and page sizes.
ROLLING_ROWS = 7
WOW_DAYS = 7
LAST_BARS = 2
NEWS_PAGE_SIZE = 20
PREVIEW_ROWS = 12

# Normalisation constant of the compound sentiment score (Hutto & Gilbert, ICWSM 2014).
COMPOUND_ALPHA = 15.0

# Markers and lineage literals of the landed records.
REMOVED_TITLE = "[Removed]"
NEWS_LANGUAGE = "en"
BRONZE_LAYER = "bronze"
NEWS_SOURCE = "newsapi"
STOCKS_SOURCE = "yfinance"
TRENDS_SOURCE = "google_trends"
TRENDS_TIMEFRAME = "today 1-m"
TRENDS_GEO = "IN"
