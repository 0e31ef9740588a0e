"""Gold: grains, branches of the comparison with last week, the published results."""

import datetime as dt

import pytest
from helpers import plan, rows, shape
from pyspark.sql import functions as F

from signalmart import schemas
from signalmart.plans import gold as G
from signalmart.plans import reports as R

AS_OF = "2026-03-22"

# brand, category, type, index, last week's index; 12 brands of the published report.
GOLDEN = [
    ("HUL", "Health", "listed", 81.2, None),
    ("ITC", "Snacks", "listed", 78.4, None),
    ("Coca-Cola", "Beverages", "listed", 74.3, None),
    ("Dabur", "Health", "listed", 71.8, 69.2),
    ("Himalaya", "Health", "private", 68.5, None),
    ("Haldirams", "Snacks", "private", 65.2, 61.4),
    ("PepsiCo", "Beverages", "listed", 62.1, 63.4),
    ("Lays", "Snacks", "private", 58.7, 57.1),
    ("Thums Up", "Beverages", "private", 54.3, 53.9),
    ("Limca", "Beverages", "private", 48.6, 55.2),
    ("Kurkure", "Snacks", "private", 41.2, 43.8),
    ("Patanjali", "Health", "private", 34.8, 51.6),
]


@pytest.fixture(scope="module")
def golden(spark):
    """The gold table of the 12 brands, with labels, alerts and comparison computed by the operators."""
    current = spark.createDataFrame(
        [(b, c, t, i, -0.6 if b == "Patanjali" else 0.2, 50.0, 40) for b, c, t, i, _ in GOLDEN],
        "brand_name string, category string, brand_type string, brand_health_index double,"
        " avg_daily_sentiment double, sentiment_normalized double, trend_normalized bigint")
    from signalmart.functions import labels
    labelled = G.alerts(current.withColumns({
        "health_label": labels.health_label(F.col("brand_health_index")),
        "is_anomaly": F.lit(False), "coverage_trend": F.lit("STABLE"),
        "trend_score": F.col("trend_normalized"), "processed_date": F.lit(AS_OF).cast("date"),
    }))
    history = spark.createDataFrame(
        [(b, c, t, i, 45.0, 41) for b, c, t, _, i in GOLDEN if i is not None],
        "brand_name string, category string, brand_type string, last_week_index double, last_week_sentiment double, last_week_trend bigint"
    ).withColumn("last_week_label", labels.health_label(F.col("last_week_index")))
    return G.week_over_week(labelled, history)


def test_leaderboard_matches_the_published_one(golden):
    expected = ["STRONG"] * 2 + ["HEALTHY"] * 6 + ["WEAK"] * 3 + ["AT_RISK"]
    got = R.leaderboard(golden, AS_OF).collect()
    assert [r.brand_name for r in got] == [b for b, *_ in GOLDEN]
    assert [r.health_label for r in got] == expected
    assert [r.alert_flag for r in got] == [False] * 11 + [True]


def test_alert_list(golden):
    assert [tuple(r) for r in R.alert_list(golden, AS_OF).collect()] == [
        ("Patanjali", "Health", 34.8, "AT_RISK", "High negative sentiment")]


def test_category_summary_rounds_half_up(golden):
    assert [tuple(r) for r in R.category_summary(golden, AS_OF).collect()] == [
        ("Health", 4, 64.08, 1, 2, 1), ("Snacks", 4, 60.88, 1, 2, 0), ("Beverages", 4, 59.83, 0, 2, 0)]


def test_week_over_week_report(golden):
    got = [(r.brand_name, r.this_week, r.last_week, r.change, r.wow_direction, r.label_changed)
           for r in R.week_over_week_report(golden, AS_OF).collect()]
    assert got[:8] == [
        ("Patanjali", 34.8, 51.6, -16.8, "DECLINING", True),
        ("Limca", 48.6, 55.2, -6.6, "DECLINING", True),
        ("Kurkure", 41.2, 43.8, -2.6, "STABLE", False),
        ("PepsiCo", 62.1, 63.4, -1.3, "STABLE", False),
        ("Thums Up", 54.3, 53.9, 0.4, "STABLE", False),
        ("Lays", 58.7, 57.1, 1.6, "STABLE", False),
        ("Dabur", 71.8, 69.2, 2.6, "STABLE", False),
        ("Haldirams", 65.2, 61.4, 3.8, "STABLE", False)]
    assert all(row[2:] == (None, None, "STABLE", False) for row in got[8:])


def test_brand_type_summary(golden):
    got = {r.brand_type: (r.brand_count, r.avg_health) for r in R.brand_type_summary(golden, AS_OF).collect()}
    assert got == {"listed": (5, 73.56), "private": (7, 53.04)}


def test_reports_read_one_date(golden):
    assert R.leaderboard(golden, "2026-03-21").isEmpty()
    assert R.preview(golden, 3).count() == 3


def silver(spark, news, trends, stocks):
    """Silver tables from (brand, date, ...) tuples of the columns gold reads."""
    n = spark.createDataFrame(
        [(b, "c", t, dt.date.fromisoformat(d), s, 40.0, v, c, 3) for b, t, d, s, v, c in news],
        "brand_name string, category string, brand_type string, news_date date, avg_daily_sentiment double,"
        " share_of_voice_pct double, news_velocity double, coverage_trend string, daily_article_count bigint")
    t = spark.createDataFrame(
        [(b, "c", k, d, s, 1.0, a) for b, k, d, s, a in trends],
        "brand_name string, category string, brand_type string, trend_date string, trend_score bigint,"
        " trend_momentum double, is_anomaly boolean")
    s = spark.createDataFrame(
        [(b, "c", "listed", d, 10.0, c, 1.0, "UP", True) for b, d, c in stocks],
        "brand_name string, category string, brand_type string, stock_date string, close_price double,"
        " daily_change_pct double, volatility_7d double, price_signal string, stock_available boolean")
    return n, t, s


NEWS = [("A", "listed", "2026-03-20", 0.1, 0.0, "STABLE"), ("A", "listed", "2026-03-21", 0.2, 30.0, "ACCELERATING"),
        ("A", "listed", "2026-03-25", 0.9, 0.0, "STABLE"), ("P", "private", "2026-03-22", -0.6, 0.0, "STABLE"),
        ("L", "listed", "2026-03-22", 0.0, 0.0, "STABLE")]
TRENDS = [("A", "listed", f"2026-03-{d}", d, False) for d in (19, 20, 21)] + [
    ("P", "private", "2026-03-22", 80, True), ("Q", "private", "2026-03-22", 80, False)]
STOCKS = [("A", "2026-03-20", 1.0), ("A", "2026-03-21", 2.0)]


def test_latest_grain_has_one_row_per_brand(spark):
    tables = silver(spark, NEWS, TRENDS, STOCKS)
    gold = G.brand_health(*tables, AS_OF)
    assert shape(gold.schema) == shape(schemas.BRAND_HEALTH)
    got = {r.brand_name: r for r in gold.collect()}
    assert set(got) == {"A", "P", "L"} and gold.count() == 3  # news drives, Q has none
    a = got["A"]
    assert (a.avg_daily_sentiment, a.trend_score, a.daily_change_pct, a.stock_available) == (0.2, 21, 2.0, True)
    assert (a.sentiment_normalized, a.trend_normalized, a.stock_normalized) == (60.0, 21, 70.0)
    assert a.brand_health_index == round(60 * .3 + 21 * .3 + 70 * .3 + 40 * .1, 2)
    assert got["P"].brand_health_index == round(20 * .4 + 80 * .4 + 40 * .2, 2) and got["P"].alert_flag
    listed_without_price = got["L"]
    assert listed_without_price.stock_available is False and listed_without_price.stock_normalized is None
    assert listed_without_price.brand_health_index is None and listed_without_price.health_label == "AT_RISK"


def test_a_brand_in_two_categories_keeps_both_rows(spark):
    news, trends, stocks = silver(spark, NEWS, TRENDS, STOCKS)
    other = news.where("brand_name = 'A' and news_date < '2026-03-21'").withColumn("category", F.lit("d"))
    gold = G.brand_health(news.unionByName(other), trends, stocks, AS_OF)
    got = {(r.category, r.brand_type): r.trend_score for r in gold.where("brand_name = 'A'").collect()}
    assert got == {("c", "listed"): 21, ("d", "listed"): None}


def test_all_grain_multiplies_and_its_size_is_known_before(spark):
    tables = silver(spark, NEWS[:2], TRENDS[:3], STOCKS)
    assert G.join_sources(*tables, AS_OF, grain="all").count() == 12
    assert rows(G.join_size(*tables).select("brand_name", "joined_rows")) == [("A", 12)]
    with pytest.raises(ValueError):
        G.join_sources(*tables, AS_OF, grain="week")


def test_first_run_has_no_comparison(spark):
    tables = silver(spark, NEWS, TRENDS, STOCKS)
    empty = spark.createDataFrame([], schemas.LAST_WEEK)
    for history in (None, empty):
        gold = G.brand_health(*tables, AS_OF, history)
        assert shape(gold.schema) == shape(schemas.BRAND_HEALTH)
        assert {tuple(r) for r in gold.select(*G.WOW_COLUMNS).collect()} == {(None,) * 7}


def test_brand_missing_from_history_is_stable(spark):
    tables = silver(spark, NEWS, TRENDS, STOCKS)
    history = spark.createDataFrame([("A", "c", "listed", 20.0, "AT_RISK", 50.0, 30), ("A", "c", "listed", 99.0, "STRONG", 50.0, 30),
                                     ("P", "c", "private", 48.0, "WEAK", 21.5, None)], schemas.LAST_WEEK)
    gold = G.brand_health(*tables, AS_OF, history)
    got = {r.brand_name: tuple(r) for r in gold.select("brand_name", *G.WOW_COLUMNS).collect()}
    assert gold.count() == 3  # duplicated history does not multiply
    assert got["A"][1:] == (20.0, "AT_RISK", 29.3, "IMPROVING", True, 10.0, -9.0)
    assert got["P"][1:] == (48.0, "WEAK", 0.0, "STABLE", False, -1.5, None)
    assert got["L"][1:] == (None, None, None, "STABLE", False, None, None)


def test_gold_stays_in_the_jvm_and_has_no_cross_join(spark):
    tables = silver(spark, NEWS, TRENDS, STOCKS)
    text = plan(G.brand_health(*tables, AS_OF, spark.createDataFrame([], schemas.LAST_WEEK)))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "Subquery" in text


def test_index_stays_within_bounds(spark):
    from signalmart.functions import scaling
    corners = [(a, s, t, c) for a in (True, False) for s in (-1.0, 1.0) for t in (-5, 0, 100, 300) for c in (-9.0, 9.0, None)]
    df = spark.createDataFrame(corners, "stock_available boolean, avg_daily_sentiment double, trend_score bigint,"
                                        " daily_change_pct double").withColumn("share_of_voice_pct", F.lit(100.0))
    index = G.health(G.normalize(df)).agg(F.min("brand_health_index"), F.max("brand_health_index")).first()
    assert index[0] >= 0 and index[1] <= 100
    assert scaling.rescale(F.lit(0.0), -1, 1) is not None
