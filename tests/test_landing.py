"""Shaping of raw payloads into bronze records."""

import datetime as dt

from helpers import rows
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.operators import landing as L

NOW = "2026-03-22T00:05:00+00:00"


def article(title, url="u1", published="2026-03-22T01:00:00Z", source="Paper"):
    return (title, None, url, published, None, (source,) if source else None)


def payloads(spark, data):
    return spark.createDataFrame(data, schemas.NEWS_PAYLOAD)


def test_default_brands(spark):
    brands = L.brand_dim(spark)
    assert brands.count() == 12
    assert {tuple(r) for r in brands.groupBy("brand_type").count().collect()} == {("listed", 5), ("private", 7)}
    assert brands.where((F.col("brand_type") == "listed") != F.col("ticker").isNotNull()).isEmpty()
    terms = L.search_terms(brands)
    assert terms.count() == 20
    assert rows(terms.where("brand_name = 'HUL'").select("term_pos", "search_term")) == [
        (0, "Hindustan Unilever"), (1, "HUL India")]


def test_shape_news(spark):
    raw = payloads(spark, [
        ("Coca-Cola", "Coca Cola India", 0, "ok", [
            article("A", "u1"), article("[Removed]", "u2"), article("", "u3"), article(None, "u4"),
            article("no url", None), article("empty url", ""), article("B", "u5", None, None)]),
        ("Coca-Cola", "Coke India", 1, "ok", [article("A again", "u1"), article("C", "u6")]),
        ("Limca", "Limca drink India", 0, "ok", [article("A too", "u1")]),
        ("Limca", "empty", 1, "ok", []),
        ("Unknown", "term", 0, "ok", [article("X", "u9")]),
    ])
    news = L.shape_news(raw, L.brand_dim(spark), NOW)
    assert news.schema.fieldNames() == schemas.NEWS_BRONZE.fieldNames()
    got = rows(news.select("brand_name", "ticker", "category", "search_term", "headline", "source_name", "url"))
    assert got == sorted([
        ("Coca-Cola", "KO", "Beverages", "Coca Cola India", "A", "Paper", "u1"),
        ("Coca-Cola", "KO", "Beverages", "Coca Cola India", "B", None, "u5"),
        ("Coca-Cola", "KO", "Beverages", "Coke India", "C", "Paper", "u6"),
        ("Limca", None, "Beverages", "Limca drink India", "A too", "Paper", "u1"),
    ], key=repr)
    first = news.first()
    assert (first.ingested_at, first.pipeline_source, first.data_layer) == (NOW, "newsapi", "bronze")
    assert news.where("article_id is null").isEmpty()


def test_fallback_is_decided_on_the_raw_articles(spark):
    primary = payloads(spark, [
        ("A", "t1", 0, "ok", [article("[Removed]")]),
        ("A", "t2", 1, "ok", []),
        ("B", "t1", 0, "error", [article("ignored")]),
    ])
    secondary = payloads(spark, [(b, t, 0, "ok", [article(f"second {b} {t}")])
                                 for b, t in (("A", "t1"), ("A", "t2"), ("B", "t1"), ("C", "t1"))])
    chosen = L.explode_articles(L.with_fallback(L.ok_articles(primary), secondary, ["brand_name", "search_term"]))
    assert rows(chosen.select("headline")) == [("[Removed]",), ("second A t2",), ("second B t1",), ("second C t1",)]
    asked = L.with_fallback(L.ok_articles(primary), secondary, ["brand_name", "search_term"], responded=primary)
    assert rows(asked.select("brand_name", "search_term")) == [("A", "t1"), ("A", "t2"), ("B", "t1")]
    assert rows(L.drop_removed(chosen).select("brand_name", "search_term")) == [("A", "t2"), ("B", "t1"), ("C", "t1")]


def test_top_articles_per_term_and_language(spark):
    data = [("A", "t", "en", f"2026-03-{d:02d}", f"u{d}") for d in range(1, 26)] + [("A", "t", "de", "2026-04-01", "x"),
                                                                                  ("A", "t2", "en", None, "y")]
    df = spark.createDataFrame(data, "brand_name string, search_term string, lang string, published_at string, url string")
    top = L.top_articles(df)
    assert top.count() == 21 and top.where("lang <> 'en'").isEmpty()
    assert top.where("search_term = 't'").agg(F.min("published_at")).first()[0] == "2026-03-06"
    assert L.top_articles(df, n=1, language=None).count() == 2


def test_shape_stocks(spark):
    day = dt.date(2026, 3, 21)
    bars = spark.createDataFrame([
        ("KO", day, 70.0, 71.23456, 69.5, 70.7, 1000.0),
        ("KO", dt.date(2026, 3, 22), 0.0, 1.0, 0.0, 0.5, 2.9),
        ("XX", day, 1.0, 1.0, 1.0, 1.0, 1.0),
    ], schemas.OHLC_RAW)
    stocks = L.shape_stocks(bars, L.brand_dim(spark), NOW).orderBy("date")
    assert stocks.schema.fieldNames() == schemas.STOCKS_BRONZE.fieldNames()
    first, second = stocks.collect()
    assert (first.brand_name, first.date, first.high_price, first.daily_change_pct) == (
        "Coca-Cola", "2026-03-21", 71.2346, 1.0)
    assert first.price_range == 1.7346 and first.stock_available is True
    assert (second.daily_change_pct, second.volume) == (0.0, 2)


def test_shape_trends_skips_terms_without_a_column(spark):
    brands = L.brand_dim(spark).where("category = 'Beverages'")
    terms = [r[0] for r in brands.select("trend_term").collect()]
    wide = spark.createDataFrame(
        [(dt.date(2026, 3, 21), 50, 40, 30, False), (dt.date(2026, 3, 22), 60, 45, 35, True)],
        "date date, `Coca Cola India` int, `Pepsi India` int, `Thums Up` int, isPartial boolean")
    trends = L.shape_trends(wide, brands, NOW, terms)
    assert trends.schema.fieldNames() == schemas.TRENDS_BRONZE.fieldNames()
    assert rows(trends.select("brand_name", "date", "trend_score", "stock_available")) == [
        ("Coca-Cola", "2026-03-21", 50, True), ("Coca-Cola", "2026-03-22", 60, True),
        ("PepsiCo", "2026-03-21", 40, True), ("PepsiCo", "2026-03-22", 45, True),
        ("Thums Up", "2026-03-21", 30, False), ("Thums Up", "2026-03-22", 35, False)]
    first = trends.first()
    assert (first.timeframe, first.geo, first.pipeline_source) == (C.TRENDS_TIMEFRAME, C.TRENDS_GEO, C.TRENDS_SOURCE)


def test_skip_existing_and_summary(spark):
    units = spark.createDataFrame([("c", "A"), ("c", "B"), ("d", "C")], "category string, brand_name string")
    incoming = spark.createDataFrame([("c", "A", 1), ("c", "A", 2), ("d", "C", 3)],
                                     "category string, brand_name string, v int")
    landed = spark.createDataFrame([("d", "C"), ("d", "C")], units.schema)
    fresh = L.skip_existing(incoming, landed, ["category", "brand_name"])
    assert rows(fresh) == [("c", "A", 1), ("c", "A", 2)]
    summary = L.ingest_summary(units, fresh, ["category", "brand_name"], landed)
    assert rows(summary) == sorted([
        ("c", "A", 2, False), ("c", "B", 0, False), ("d", "C", 0, True), (None, None, 2, True)], key=repr)


def test_summary_of_an_empty_run(spark):
    units = spark.createDataFrame([("c", "A")], "category string, brand_name string")
    summary = L.ingest_summary(units, units.where("false"), ["category", "brand_name"])
    assert rows(summary) == sorted([("c", "A", 0, False), (None, None, 0, False)], key=repr)
