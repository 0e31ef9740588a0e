"""The daily jobs from landed records to reports."""

import datetime as dt

import pytest
from helpers import plan, rows, shape
from pyspark.sql import functions as F

from signalmart import schemas
from signalmart.operators import landing as L
from signalmart.plans import jobs, news, reports, stocks, trends
from signalmart.sources import bronze, gold, silver
from signalmart.sources.shared import stage

LEXICON = [("great", 3.0), ("poor", -2.5)]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, schemas.LEXICON)


def land_day(spark, root, day, tone):
    brands = L.brand_dim(spark)
    moment = f"{day}T00:05:00Z"
    data = [(b, "t", 0, "ok", [(f"{tone} news {n}", None, f"{b}-{n}-{day}", f"{day}T0{n}:00:00Z", None, ("S",))
                               for n in range(1 + k % 3)])
            for k, b in enumerate(r[0] for r in brands.select("brand_name").orderBy("brand_name").collect())]
    bronze.write_bronze(L.shape_news(spark.createDataFrame(data, schemas.NEWS_PAYLOAD), brands, moment), root, "news")
    last = dt.date.fromisoformat(day)
    bars = [(r.ticker, last - dt.timedelta(days=n), 10.0, 11.0, 9.0, 10.0 - n, 5.0)
            for r in brands.where("ticker is not null").collect() for n in (0, 1)]
    bronze.write_bronze(L.shape_stocks(spark.createDataFrame(bars, schemas.OHLC_RAW), brands, moment), root, "stocks")
    terms = [r[0] for r in brands.select("trend_term").collect()]
    wide = spark.createDataFrame(
        [(last - dt.timedelta(days=n), *[50 + n + k for k in range(len(terms))]) for n in range(10)],
        "date date, " + ", ".join(f"`{t}` int" for t in terms))
    bronze.write_bronze(L.shape_trends(wide, brands, moment, terms), root, "trends")


def test_two_weeks_end_to_end_and_repeated(spark, root, lexicon):
    b, s, g = f"{root}/bronze", f"{root}/silver", f"{root}/gold"
    land_day(spark, b, "2026-03-15", "great")
    assert jobs.run_silver(spark, b, s, "2026-03-15", lexicon) == {"news": 12, "stocks": 10, "trends": 120}
    assert jobs.run_gold(spark, s, g, "2026-03-15") == 12
    assert gold.read_gold(spark, g).where("wow_direction is not null").isEmpty()

    land_day(spark, b, "2026-03-22", "poor")
    for _ in range(2):  # a repeated run changes nothing
        jobs.run_silver(spark, b, s, "2026-03-22", lexicon)
        jobs.run_gold(spark, s, g, "2026-03-22")
    assert silver.read_silver(spark, s, "news").count() == 24
    table = gold.read_gold(spark, g)
    assert table.count() == 24 and table.schema["processed_date"].dataType.simpleString() == "date"
    board = reports.leaderboard(table, "2026-03-22").collect()
    assert len(board) == 12 and all(r.alert_flag for r in board)
    compared = reports.week_over_week_report(table, "2026-03-22").collect()
    assert {r.wow_direction for r in compared} == {"DECLINING"}
    assert reports.alert_list(table, "2026-03-22").count() == 12


def test_landing_twice_skips_what_is_there(spark, root):
    brands = L.brand_dim(spark)
    day, moment = "2026-03-22", "2026-03-22T00:05:00Z"

    def records(names):
        data = [(b, "t", 0, "ok", [("Title", None, f"u-{b}", moment, None, ("S",))]) for b in names]
        return L.shape_news(spark.createDataFrame(data, schemas.NEWS_PAYLOAD), brands, moment)

    first = {r.brand_name: tuple(r)[2:] for r in jobs.land(records(["HUL", "Lays"]), brands, root, "news", day).collect()}
    assert len(first) == 13
    assert (first["HUL"], first["Dabur"], first[None]) == ((1, False), (0, False), (2, False))
    second = {r.brand_name: tuple(r)[2:]
              for r in jobs.land(records(["HUL", "Lays", "Dabur"]), brands, root, "news", day).collect()}
    assert (second["HUL"], second["Dabur"], second["ITC"]) == ((0, True), (1, False), (0, False))
    assert second[None] == (1, True)
    assert bronze.read_bronze(spark, root, "news", day).count() == 3


def test_trends_land_by_category(spark, root):
    brands = L.brand_dim(spark)
    wide = spark.createDataFrame([(dt.date(2026, 3, 21), 5, 6)], "date date, `Thums Up` int, `Lays India` int")
    rows_of = L.shape_trends(wide, brands, "2026-03-22T00:30:00Z", ["Thums Up", "Lays India"])
    summary = jobs.land(rows_of, brands, root, "trends", "2026-03-22")
    assert rows(summary) == sorted([("Beverages", 1, False), ("Health", 0, False), ("Snacks", 1, False),
                                    (None, 2, False)], key=repr)


def test_analysts_can_use_sql(spark, root, lexicon):
    b, s, g = f"{root}/bronze", f"{root}/silver", f"{root}/gold"
    land_day(spark, b, "2026-03-22", "great")
    jobs.run_silver(spark, b, s, "2026-03-22", lexicon)
    jobs.run_gold(spark, s, g, "2026-03-22")
    gold.read_gold(spark, g).createOrReplaceTempView("brand_health")
    by_sql = spark.sql("""
        SELECT CATEGORY, COUNT(BRAND_NAME) AS N, SUM(CASE WHEN ALERT_FLAG THEN 1 ELSE 0 END) AS ALERTS
        FROM BRAND_HEALTH WHERE PROCESSED_DATE = DATE '2026-03-22' GROUP BY CATEGORY""")
    by_report = reports.category_summary(gold.read_gold(spark, g), "2026-03-22")
    assert rows(by_sql) == rows(by_report.select("category", "total_brands", "alerts"))


def test_missing_sources_are_left_out(spark, root, lexicon):
    assert jobs.run_silver(spark, f"{root}/b", f"{root}/s", "2026-03-22", lexicon) == {
        "news": 0, "stocks": 0, "trends": 0}
    assert jobs.run_gold(spark, f"{root}/s", f"{root}/g", "2026-03-22") == 0


def news_frame(spark):
    data = [("A", "listed", "c", f"u{n % 40}", f"{'great' if n % 3 else 'poor'} words {n}", f"2026-03-{1 + n % 9:02d}T00:00:00Z",
             f"t{n:03d}") for n in range(100)] + [("B", "private", "c", "u1", "plain", "someday", "t9"),
                                                  ("B", "private", None, "u2", "plain", "2026-03-02", "t9"),
                                                  (None, "private", "c", "u3", "x", "2026-03-02", "t9"),
                                                  ("B", "private", "c", None, "x", "2026-03-02", "t9"),
                                                  ("B", "private", "c", "u4", None, "2026-03-02", "t9")]
    return spark.createDataFrame(data, "brand_name string, brand_type string, category string, url string,"
                                       " headline string, published_at string, ingested_at string").withColumns(
        {"ticker": F.lit(None).cast("string"), "source_name": F.lit("s")})


def test_news_silver_staged_equals_lazy(spark, lexicon):
    df = news_frame(spark)
    lazy = news.news_silver(df, "2026-03-22", lexicon)
    assert shape(lazy.schema) == shape(schemas.NEWS_SILVER)
    assert rows(lazy) == rows(news.news_silver(df, "2026-03-22", lexicon, stage=stage()))
    copies = df.unionByName(df.limit(50))
    assert rows(lazy) == rows(news.news_silver(copies, "2026-03-22", lexicon, long_texts=True))
    total = lazy.agg(F.sum("daily_article_count")).first()[0]
    assert total == 42  # 40 distinct urls of A, two complete articles of B
    assert lazy.where("news_date is null").count() == 1


def test_news_silver_needs_a_scorer(spark):
    with pytest.raises(ValueError):
        news.news_silver(news_frame(spark), "2026-03-22")


def test_lazy_news_silver_reads_and_shuffles_the_articles_once(spark, root, lexicon):
    news_frame(spark).write.parquet(f"{root}/n")
    df = news.news_silver(spark.read.parquet(f"{root}/n"), "2026-03-22", lexicon)
    df.collect()
    final = plan(df)
    assert "ReusedExchange" in final
    assert "Python" not in final


def test_trends_silver_shuffles_twice(spark):
    """Once to de-duplicate, with partial aggregation, and once for all series operators."""
    text = plan(trends.trends_silver(trend_frame(spark), "2026-03-22"))
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text


def trend_frame(spark):
    data = [("A", "listed", "c", f"2026-03-{d:02d}", 100 if d == 20 else d % 4, "IN", f"t{n}", True)
            for d in range(1, 21) for n in range(2)] + [("A", "listed", "c", "2026-03-21", None, "IN", "t", True)]
    return spark.createDataFrame(data, "brand_name string, brand_type string, category string, date string,"
                                       " trend_score bigint, geo string, ingested_at string, stock_available boolean")


def test_trends_silver_schema_and_spike(spark):
    df = trends.trends_silver(trend_frame(spark), "2026-03-22")
    assert shape(df.schema) == shape(schemas.TRENDS_SILVER)
    assert df.count() == 20
    assert [r.trend_date for r in df.where("is_anomaly").collect()] == ["2026-03-20"]


def test_stocks_silver_schema_and_first_bar(spark):
    data = [("A", "listed", "c", "T", "X", f"2026-03-{d:02d}", 1.0, 2.0, 0.5, price, 10, "t", True)
            for d, price in ((1, 100.0), (2, 103.0), (3, 0.0), (4, 103.6), (5, 100.0))]
    df = spark.createDataFrame(data, "brand_name string, brand_type string, category string, ticker string,"
                                     " exchange string, date string, open_price double, high_price double,"
                                     " low_price double, close_price double, volume bigint, ingested_at string,"
                                     " stock_available boolean")
    silver_df = stocks.stocks_silver(df, "2026-03-22")
    assert shape(silver_df.schema) == shape(schemas.STOCKS_SILVER)
    got = [(r.stock_date[-2:], r.daily_change_pct, r.price_signal) for r in silver_df.orderBy("stock_date").collect()]
    assert got == [("01", 0.0, "FLAT"), ("02", 3.0, "STRONG_UP"), ("04", 0.5825, "UP"), ("05", -3.4749, "STRONG_DOWN")]
    assert silver_df.orderBy("stock_date").first().volatility_7d is None
