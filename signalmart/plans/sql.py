"""The library for SQL users: functions of the session, and the reports as statements with parameters.

``register`` creates temporary SQL functions with the thresholds and weights of ``constants``; Spark inlines them, so a statement
with them is planned like the column expressions.  ``REPORTS`` are statements over a table ``brand_health`` with the parameter
``:as_of``; run them with ``spark.sql(REPORTS[name], args={"as_of": day})`` or ``report``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from signalmart import constants as C
from signalmart.sources.catalog import Catalog, literal, quoted


def band(value: str, bands: Iterable[tuple[str, float, str]], default: str) -> str:
    rules = " ".join(f"WHEN {value} {compare} {threshold} THEN {literal(name)}" for compare, threshold, name in bands)
    return f"CASE {rules} ELSE {literal(default)} END"


def weighted(weights: Mapping[str, float]) -> str:
    return " + ".join(f"{name} * {weight}D" for name, weight in weights.items())


_ALERTS = [
    (f"sentiment < {C.ALERT_SENTIMENT}", C.REASON_SENTIMENT), ("anomaly", C.REASON_ANOMALY),
    ("trend = 'ACCELERATING' AND sentiment < 0", C.REASON_COVERAGE),
]
_REASON = " ".join(f"WHEN {rule} THEN {literal(reason)}" for rule, reason in _ALERTS)
_SIGNALS = "sentiment DOUBLE, anomaly BOOLEAN, trend STRING"
_LIMIT = C.STOCK_CHANGE_LIMIT

# Name: parameters, result, body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "sentiment_label": ("score DOUBLE", "STRING", band("score", C.SENTIMENT_BANDS, C.SENTIMENT_DEFAULT)),
    "coverage_trend": ("velocity DOUBLE", "STRING", band("velocity", C.COVERAGE_BANDS, C.COVERAGE_DEFAULT)),
    "price_signal": ("change_pct DOUBLE", "STRING", band("change_pct", C.PRICE_BANDS, C.PRICE_DEFAULT)),
    "health_label": ("index DOUBLE", "STRING", band("index", C.HEALTH_BANDS, C.HEALTH_DEFAULT)),
    "wow_direction": ("change DOUBLE", "STRING", band("change", C.WOW_BANDS, C.WOW_DEFAULT)),
    "is_anomaly": ("zscore DOUBLE", "BOOLEAN", f"coalesce(abs(zscore) > {C.ANOMALY_ZSCORE}, false)"),
    "alert_reason": (_SIGNALS, "STRING", f"CASE {_REASON} END"),
    "alert_flag": (_SIGNALS, "BOOLEAN", f"CASE {_REASON} END IS NOT NULL"),
    "sentiment_normalized": ("sentiment DOUBLE", "DOUBLE", "round((sentiment + 1) / 2 * 100, 2)"),
    "trend_normalized": ("score BIGINT", "BIGINT", "CASE WHEN score < 0 THEN 0 WHEN score > 100 THEN 100 ELSE score END"),
    "stock_normalized": (
        "available BOOLEAN, change_pct DOUBLE", "DOUBLE",
        f"CASE WHEN available THEN round(coalesce(CASE WHEN change_pct < -{_LIMIT} THEN 0D WHEN change_pct > {_LIMIT} THEN 100D "
        f"ELSE (change_pct + {_LIMIT}) * {50 / _LIMIT}D END, {C.STOCK_UNKNOWN}D), 2) END"),
    "health_index": (
        "available BOOLEAN, sentiment_normalized DOUBLE, trend_normalized BIGINT, stock_normalized DOUBLE, share_of_voice_pct DOUBLE",
        "DOUBLE", f"round(CASE WHEN available THEN {weighted(C.LISTED_WEIGHTS)} ELSE {weighted(C.PRIVATE_WEIGHTS)} END, 2)"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]


# The mean of the two-decimal index is summed exactly, so ties round alike in any order of tasks.
_MEAN = ("round(CAST(sum(CAST(brand_health_index AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(brand_health_index), 0), 2)")

REPORTS: dict[str, str] = {
    "leaderboard": """
        SELECT brand_name, category, brand_health_index, health_label, alert_flag FROM brand_health
        WHERE processed_date = CAST(:as_of AS DATE) ORDER BY brand_health_index DESC NULLS FIRST, brand_name, category""",
    "alert_list": """
        SELECT brand_name, category, brand_health_index, health_label, alert_reason FROM brand_health
        WHERE processed_date = CAST(:as_of AS DATE) AND alert_flag ORDER BY brand_health_index NULLS LAST, brand_name, category""",
    "category_summary": f"""
        SELECT category, count(brand_name) AS total_brands, {_MEAN} AS avg_health, count_if(health_label = 'STRONG') AS strong,
            count_if(health_label = 'HEALTHY') AS healthy, count_if(alert_flag) AS alerts
        FROM brand_health WHERE processed_date = CAST(:as_of AS DATE) GROUP BY category ORDER BY avg_health DESC NULLS FIRST, category""",
    "week_over_week_report": """
        SELECT brand_name, brand_health_index AS this_week, last_week_index AS last_week, index_change_wow AS change, wow_direction,
            label_changed, last_week_label AS was, health_label AS now
        FROM brand_health WHERE processed_date = CAST(:as_of AS DATE) ORDER BY change NULLS LAST, brand_name""",
    "brand_type_summary": f"""
        SELECT brand_type, count(brand_name) AS brand_count, {_MEAN} AS avg_health, round(avg(avg_daily_sentiment), 4) AS avg_sentiment,
            round(avg(trend_score), 2) AS avg_trend
        FROM brand_health WHERE processed_date = CAST(:as_of AS DATE) GROUP BY brand_type""",
}


def report(gold: DataFrame | Catalog, name: str, as_of: str, spark: SparkSession | None = None) -> DataFrame:
    """A report as its statement gives it, over gold rows or the gold table of a catalog (with its session)."""
    if isinstance(gold, Catalog):
        if spark is None:
            raise ValueError("a table of the catalog needs its session")
        return spark.sql(REPORTS[name].replace("FROM brand_health", f"FROM {quoted(gold.gold())}"), args={"as_of": as_of})
    return gold.sparkSession.sql(REPORTS[name].replace("FROM brand_health", "FROM {gold}"), args={"as_of": as_of}, gold=gold)
