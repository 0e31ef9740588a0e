"""Catalog tables, the state daily runs leave, several days in one pass, damaged input, counts, SQL."""

import datetime as dt
import gzip
import math
import os
import re

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F
from test_jobs import LEXICON, land_day
from test_sources import silver_rows

from signalmart import schemas
from signalmart.functions import labels, scaling
from signalmart.operators import context, landing, moments, rows as R, tails
from signalmart.operators.counting import Counts
from signalmart.plans import gold as G
from signalmart.plans import jobs, reports, sql, stocks
from signalmart.sources import bronze, catalog, gold, silver
from signalmart.sources.catalog import Catalog
from signalmart.sources.seen import SeenKeys
from signalmart.sources.state import DayState


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, schemas.LEXICON)


@pytest.fixture
def tables(spark, root, request):
    where = Catalog(location=f"{root}/tables", prefix=re.sub(r"\W", "_", request.node.name) + "_")
    where.create(spark)
    yield where
    for source in silver.SCHEMAS:
        spark.sql(f"DROP TABLE {where.silver(source)}")
    spark.sql(f"DROP TABLE {where.gold()}")


# --- catalog --------------------------------------------------------------------------

def test_a_catalog_day_is_one_set_of_partitions(spark, tables):
    days = [f"2024-01-{d:02}" for d in range(1, 31)]
    whole = silver_rows(spark, days[0])
    for day in days[1:]:
        whole = whole.unionByName(silver_rows(spark, day))
    silver.write_silver_days(whole, tables, "trends")
    assert rows(silver.read_silver(spark, tables, "trends")) == rows(whole)
    day = silver.read_silver(spark, tables, "trends", days[6])
    assert rows(day) == rows(silver_rows(spark, days[6]))
    text = plan(day)
    assert "InMemoryFileIndex(3 paths)" in text and "PartitionFilters: [isnotnull(ingestion_date" in text
    assert len(day.inputFiles()) == 3 and all(f"ingestion_date={days[6]}/" in f for f in day.inputFiles())
    assert catalog.partitions(spark, tables.silver("trends")).count() == 90


def test_a_catalog_run_replaces_its_day_as_a_whole(spark, tables):
    for day in ("2024-01-01", "2024-01-02", "2024-01-01"):
        silver.write_silver(silver_rows(spark, day), tables, "trends", day)
    assert silver.read_silver(spark, tables, "trends").count() == 6
    silver.write_silver(silver_rows(spark, "2024-01-01"), tables, "trends", "2024-01-01", mode="append")
    assert silver.read_silver(spark, tables, "trends", "2024-01-01").count() == 6
    silver.write_silver(silver_rows(spark, "2024-01-01", ("A", "o'B/=+ c")), tables, "trends", "2024-01-01")
    assert [r.brand_name for r in silver.read_silver(spark, tables, "trends", "2024-01-01").orderBy("brand_name").collect()] == ["A", "o'B/=+ c"]
    assert ("2024-01-01", "c", "o'B/=+ c") in rows(catalog.partitions(spark, tables.silver("trends")))
    silver.write_silver(silver_rows(spark, "2024-01-01").where("false"), tables, "trends", "2024-01-01")
    assert silver.read_silver(spark, tables, "trends", "2024-01-01").isEmpty()
    assert silver.read_silver(spark, tables, "trends").count() == 3
    tables.create(spark)  # tables that exist stay


def test_jobs_over_a_catalog_equal_jobs_over_folders(spark, root, tables, lexicon):
    for day, tone in (("2026-03-15", "great"), ("2026-03-22", "poor")):
        land_day(spark, f"{root}/b", day, tone)
        for where, table in ((f"{root}/s", f"{root}/g"), (tables, tables)):
            jobs.run_silver(spark, f"{root}/b", where, day, lexicon)
            assert jobs.run_gold(spark, where, table, day) == 12
    assert rows(gold.read_gold(spark, tables)) == rows(gold.read_gold(spark, f"{root}/g"))
    history = gold.read_history(spark, tables, "2026-03-22")
    assert history.count() == 12 and "InMemoryFileIndex(1 paths)" in plan(history)
    assert rows(sql.report(tables, "leaderboard", "2026-03-22", spark)) == rows(reports.leaderboard(gold.read_gold(spark, tables), "2026-03-22"))
    with pytest.raises(ValueError):
        gold.write_gold(history, tables)


def test_a_gold_day_without_rows_leaves_none(spark, root, lexicon):
    b, s, g = f"{root}/b", f"{root}/s", f"{root}/g"
    land_day(spark, b, "2026-03-22", "great")
    jobs.run_silver(spark, b, s, "2026-03-22", lexicon)
    assert jobs.run_gold(spark, s, g, "2026-03-22") == 12
    silver.write_silver(spark.createDataFrame([], schemas.NEWS_SILVER), s, "news", "2026-03-22")
    assert jobs.run_gold(spark, s, g, "2026-03-22") == 0
    assert gold.read_gold(spark, g, "2026-03-22").isEmpty()


# --- several days in one pass ----------------------------------------------------------

def test_latest_on_dates_equals_one_date_at_a_time(spark):
    data = [(k % 5, f"2024-01-{1 + (7 * k) % 28:02}", k, None if k % 4 else "x") for k in range(60)] + [(None, "2024-01-03", 7, "n")]
    df = spark.createDataFrame(data, "key int, day string, value int, more string")
    dates = ["2024-01-02", "2024-01-10", "2024-01-31", "2023-12-31"]
    got = R.latest_on_dates(df, ["key"], "day", dates, "as_of")
    assert plan(got).count("Exchange hashpartitioning") == 1
    want = [(*r, dt.date.fromisoformat(d)) for d in dates for r in rows(R.latest_per_key(df, ["key"], "day", F.lit(d)))]
    assert rows(got) == sorted(want, key=repr)


def test_a_backfill_equals_daily_runs(spark, root, lexicon):
    b, s = f"{root}/b", f"{root}/s"
    days = ["2026-03-08", "2026-03-15", "2026-03-22", "2026-03-23"]
    for day, tone in zip(days, ("great", "poor", "great", "plain")):
        land_day(spark, b, day, tone)
        jobs.run_silver(spark, b, s, day, lexicon)
        jobs.run_gold(spark, s, f"{root}/daily", day)
    assert jobs.run_gold(spark, s, f"{root}/backfill", days[0]) == 12
    assert jobs.backfill_gold(spark, s, f"{root}/backfill", days[1:]) == dict.fromkeys(days[1:], 12)
    want = rows(gold.read_gold(spark, f"{root}/daily"))
    assert rows(gold.read_gold(spark, f"{root}/backfill")) == want
    jobs.backfill_gold(spark, s, f"{root}/backfill", days[1:])
    assert rows(gold.read_gold(spark, f"{root}/backfill")) == want
    assert {r.wow_direction for r in gold.read_gold(spark, f"{root}/backfill", days[3]).collect()} == {None}


# --- seen keys ------------------------------------------------------------------------

@pytest.fixture
def seen(spark, root):
    keys = SeenKeys(spark, "default.seen_test", ("url", "brand_name"), 1_000, root).create(4)
    yield keys
    for table in (keys.table, f"{keys.table}_filter"):
        spark.sql(f"DROP TABLE {table}")


def test_keys_of_earlier_days_are_dropped_and_reruns_agree(spark, seen):
    def day(*keys):
        return spark.createDataFrame([(*k, n) for n, k in enumerate(keys)], "url string, brand_name string, n int")

    first, second = day(("a", "A"), ("b", "A"), ("a", "B"), ("a", "A")), day(("a", "A"), ("c", "A"), ("b", "B"), (None, "A"), (None, "A"))
    for _ in range(2):  # the second time is a repeated run
        assert rows(seen.unseen(first, "2024-01-01")) == rows(first)
        seen.add(first, "2024-01-01")
    assert rows(seen.unseen(second, "2024-01-02")) == rows(second.where("url is null or url != 'a' or brand_name != 'A'"))
    seen.add(day(("z", "Z")), "2024-01-01")  # a corrected run takes back what it added
    assert rows(seen.unseen(second, "2024-01-02")) == rows(second)
    assert seen.unseen(day(("z", "Z")), "2024-01-01").count() == 1


def test_the_filter_passes_all_seen_keys_and_few_others(spark, seen):
    key = lambda low, high: spark.range(low, high).select(
        F.concat(F.lit("https://e.org/"), "id").alias("url"), (F.col("id") % 3).cast("string").alias("brand_name"))
    seen.add(key(0, 1_000), "2024-01-01")
    assert seen.likely(key(0, 1_000), "2024-01-02").count() == 1_000
    assert seen.likely(key(10_000, 14_000), "2024-01-02").count() < 400
    assert seen.unseen(key(500, 1_500), "2024-01-02").count() == 500


def test_the_history_of_keys_is_not_shuffled(spark, root):
    seen = SeenKeys(spark, "default.seen_plan", ("url",), 1_000, root).create()
    try:
        df = spark.range(50).select(F.col("id").cast("string").alias("url"))
        seen.add(df, "2024-01-01")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(seen.seen(df.hint("merge"), "2024-01-02"))
        assert text.count("Bucketed: true") == 2
        for scan in re.finditer(r"[^\n]*Scan parquet[^\n]*seen_plan[^\n]*", text):
            above = text[:scan.start()].rstrip().rsplit("\n", 4)[1:]
            assert not any("Exchange" in line for line in above[-2:])
        assert text.count("Exchange hashpartitioning") <= 3  # the day's keys only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in (seen.table, f"{seen.table}_filter"):
            spark.sql(f"DROP TABLE {table}")


# --- moments and tails ----------------------------------------------------------------

def test_moments_merge_like_a_scan(spark):
    data = [(k % 3, k // 17, float(1_000_000 + (k * 37) % 11) if k % 7 else None) for k in range(200)] + [(9, 0, None), (8, 0, 5.0)]
    df = spark.createDataFrame(data, "key int, part int, value double")
    whole = moments.merged(moments.moments(df, ["key", "part"], "value"), ["key"], "part")
    got = {r.key: (r.n, r.mean, r.m2) for r in whole.collect()}
    assert set(got) == {0, 1, 2, 8}
    for key, (n, mean, m2) in got.items():
        values = [v for k, _, v in data if k == key and v is not None]
        centre = math.fsum(values) / len(values)
        assert n == len(values) and mean == pytest.approx(centre, rel=1e-14)
        assert m2 == pytest.approx(math.fsum((v - centre) ** 2 for v in values), rel=1e-9, abs=1e-6)
    again = moments.merged(whole.withColumn("part", F.lit(0)), ["key"], "part")
    assert rows(again) == rows(whole)


def test_a_compacted_state_tells_the_same(spark, root):
    state = DayState(spark, root)
    df = spark.createDataFrame([(f"B{k % 3}", f"2024-01-{1 + k % 5:02}", k * k % 23) for k in range(90)], "brand_name string, day string, trend_score long")
    state.compact("m", "2024-01-01", jobs.MOMENTS, ["brand_name"])
    for day in (f"2024-01-{d:02}" for d in range(1, 6)):
        state.write(moments.moments(df.where(F.col("day") == day), ["brand_name"], "trend_score"), "m", day)
    merged = lambda: {r[0]: r[1:] for r in rows(moments.merged(state.before("m", "9", jobs.MOMENTS), ["brand_name"], "state_day"))}
    before = merged()
    state.compact("m", "2024-01-05", jobs.MOMENTS, ["brand_name"])
    assert state.before("m", "9", jobs.MOMENTS).count() == 6
    after = merged()
    assert after.keys() == before.keys() and all(after[k] == pytest.approx(before[k]) for k in after)
    assert state.latest("none", "9", jobs.MOMENTS) is None


def bars(spark, days):
    data = [(f"B{k}", "listed", "c", f"T{k}", "X", f"2024-03-{d:02}", 1.0, 2.0, 0.5, 100.0 + (d * (k + 3) * 7) % 13, 10, "t", True)
            for k in range(3) for d in days if (d + k) % 6]
    return spark.createDataFrame(data, "brand_name string, brand_type string, category string, ticker string, exchange string, date string,"
                                       " open_price double, high_price double, low_price double, close_price double, volume bigint,"
                                       " ingested_at string, stock_available boolean")


def test_days_from_a_tail_equal_the_whole_history(spark):
    whole = stocks.stocks_silver(bars(spark, range(1, 29)), "d")
    tail, built = None, None
    for days in (range(1, 4), range(4, 5), range(5, 17), range(17, 29)):
        part = bars(spark, days)
        out = stocks.stocks_silver(part, "d", tail=tail)
        built = out if built is None else built.unionByName(out)
        following = stocks.tail_of(part, tail)
        tail = spark.createDataFrame(following.collect(), following.schema)
    assert rows(built) == rows(whole)
    assert stocks.stocks_silver(bars(spark, range(20, 29)), "d", tail=tail).isEmpty()  # built before


def test_a_tail_keeps_series_that_pause(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, t int")
    tail = tails.next_tail(df, None, ["k"], "t", 1)
    assert rows(tail) == [("a", 2), ("b", 1)]
    more = spark.createDataFrame([("a", 3), ("a", 1), ("c", 9)], "k string, t int")
    assert rows(tails.next_tail(more, tail, ["k"], "t", 1)) == [("a", 3), ("b", 1), ("c", 9)]
    marked = rows(tails.with_tail(more, tail, ["k"], "t"))
    assert marked == sorted([("a", 3, False), ("a", 2, True), ("b", 1, True), ("c", 9, False)], key=repr)
    assert ("a", 1, False) in rows(tails.with_tail(more, tail, ["k"], "t", late=True))


def test_silver_from_state_reaches_over_all_days(spark, root, lexicon):
    """The last day equals one that reads all landed days again."""
    days = [f"2026-03-{d}" for d in range(15, 24)]
    b = f"{root}/b"
    for k, day in enumerate(days):
        land_day(spark, b, day, ("great", "poor", "plain")[k % 3])
        jobs.run_silver(spark, b, f"{root}/s", day, lexicon, state=f"{root}/state")
    jobs.run_silver(spark, b, f"{root}/s", days[-1], lexicon, state=f"{root}/state")  # repeated
    jobs.run_silver(spark, b, f"{root}/whole", days[-1], lexicon, look_back=len(days) - 1)
    for source, day, columns in (("stocks", "stock_date", ["ticker", "close_price", "daily_change_pct", "volatility_7d"]),
                                 ("trends", "trend_date", ["brand_name", "trend_score", "trend_momentum", "trend_zscore"]),
                                 ("news", "news_date", ["brand_name", "daily_article_count", "rolling_7d_avg", "news_velocity"])):
        got = silver.read_silver(spark, f"{root}/s", source, days[-1]).where(F.col(day).cast("string") == days[-1]).select(*columns)
        want = silver.read_silver(spark, f"{root}/whole", source, days[-1]).where(F.col(day).cast("string") == days[-1]).select(*columns)
        assert got.count() > 0 and rows(got) == rows(want), source
    with pytest.raises(ValueError):
        jobs.run_silver(spark, b, f"{root}/s", days[-1], lexicon, state=f"{root}/state", look_back=1)


def test_silver_without_articles_of_earlier_days(spark, root, lexicon):
    b = f"{root}/b"
    land_day(spark, b, "2026-03-22", "great")
    again = bronze.read_bronze(spark, b, "news", "2026-03-22").where("brand_name = 'HUL'").withColumn("ingested_at", F.lit("2026-03-23T00:05:00Z"))
    land_day(spark, b, "2026-03-23", "poor")
    bronze.write_bronze(again, b, "news")
    keys = SeenKeys(spark, "default.seen_job", ("url", "brand_name"), 1_000, root).create(4)
    try:
        for day in ("2026-03-22", "2026-03-23", "2026-03-23"):
            jobs.run_silver(spark, b, f"{root}/s", day, lexicon, seen=keys)
            total = silver.read_silver(spark, f"{root}/s", "news", day).agg(F.sum("daily_article_count")).first()[0]
            assert total == 24
    finally:
        for table in (keys.table, f"{keys.table}_filter"):
            spark.sql(f"DROP TABLE {table}")


# --- landing in one call ----------------------------------------------------------------

def test_land_news(spark, root):
    brands = landing.brand_dim(spark)
    day, moment = "2026-03-22", "2026-03-22T00:05:00Z"

    def answer(origin, brand, term, status, *articles):
        return (brand, term, 0, status, [(t, None, u, f"2026-03-2{k}T00:00:00Z", None, ("S",)) for k, (t, u) in enumerate(articles)], origin)

    payloads = spark.createDataFrame([
        answer("primary", "HUL", "one", "ok", ("[Removed]", "x"), ("Kept", "u1"), ("Newest", "u2")),
        answer("secondary", "HUL", "one", "ok", ("Not needed", "u3")),
        answer("primary", "ITC", "two", "ok"), answer("secondary", "ITC", "two", "ok", ("Stands in", "u4"), ("Again", "u4")),
        answer("primary", "Lays", "three", "error", ("Wrong", "u5")), answer("secondary", "Lays", "three", "ok", ("Other", "u6")),
        answer("secondary", "Dabur", "four", "ok", ("Request failed", "u7")),
    ], "brand_name string, search_term string, term_pos int, status string,"
       " articles array<struct<title:string,description:string,url:string,publishedAt:string,author:string,source:struct<name:string>>>, origin string")
    summary = jobs.land_news(payloads, brands, root, day, moment, per_term=2)
    found = {r.brand_name: (r.records, r.skipped) for r in summary.collect()}
    assert (found["HUL"], found["ITC"], found["Lays"], found["Dabur"], found[None]) == ((2, False), (1, False), (1, False), (0, False), (4, False))
    assert {r.headline for r in bronze.read_bronze(spark, root, "news", day).collect()} == {"Kept", "Newest", "Stands in", "Other"}
    second = jobs.land_news(payloads, brands, root, day, moment)
    assert {r.brand_name: (r.records, r.skipped) for r in second.collect()}["HUL"] == (0, True)
    assert {r.brand_name: (r.records, r.skipped) for r in summary.collect()} == found  # a later run does not change it


# --- damaged input ----------------------------------------------------------------------

def test_damaged_files_and_records_are_put_aside(spark, root, lexicon):
    b, s = f"{root}/b", f"{root}/s"
    land_day(spark, b, "2026-03-22", "great")
    folder = f"{b}/news/category=Health/brand=HUL/year=2026/month=03/day=22"
    with open(f"{folder}/broken.json", "w") as file:
        file.write('{"brand_name": "HUL", "headline": "cut o\nnot json at all\n{"brand_name": "HUL", "category": "Health", "brand_type": "listed", '
                   '"headline": "sound", "url": "sound", "published_at": "2026-03-22T00:00:00Z", "ingested_at": "2026-03-22T01"}\n')
    with open(f"{folder}/cut.json.gz", "wb") as file:
        file.write(gzip.compress(b'{"brand_name": "HUL"}\n' * 1000)[:30])
    stocks_file = f"{b}/stocks/category=Health/brand=HUL/year=2026/month=03/day=22/wrong.json"
    with open(stocks_file, "w") as file:
        file.write('{"brand_name": "HUL", "ticker": "H", "date": "2026-03-22", "close_price": "much"}\n')
    whole = jobs.run_silver(spark, b, f"{root}/none", "2026-03-21", lexicon, tolerant=True)
    assert whole == {"news": 0, "stocks": 0, "trends": 0}
    written = jobs.run_silver(spark, b, s, "2026-03-22", lexicon, tolerant=True)
    assert written["trends"] == 120 and written["stocks"] == 10 and written["news"] >= 12
    kept = bronze.read_quarantine(spark, b, "news").collect()
    assert {os.path.basename(r.file) for r in kept} == {"broken.json"} and len(kept) == 2 and {r.day for r in kept} == {"2026-03-22"}
    assert [r.record for r in bronze.read_quarantine(spark, b, "stocks").collect()][0].count("much") == 1
    sound, damaged = bronze.read_sound(spark, b, "news", "2026-03-22")
    assert sound.where("headline = 'sound'").count() == 1 and bronze.quarantine(damaged, b, "news", "2026-03-22") == {kept[0].file: 2}


# --- counts and SQL ----------------------------------------------------------------------

def test_counts_come_from_the_run_itself(spark):
    counts = Counts()
    df = counts.at(counts.at(spark.range(100), "all").where("id % 4 = 0"), "some")
    with pytest.raises(ValueError):
        counts.at(df, "all")
    df.groupBy((F.col("id") % 3).alias("k")).count().write.format("noop").mode("overwrite").save()
    assert counts.rows() == {"all": 100, "some": 25}
    assert rows(counts.table(spark)) == [("all", 100), ("some", 25)]


def test_job_counts(spark, root, lexicon):
    land_day(spark, f"{root}/b", "2026-03-22", "great")
    counts = Counts()
    written = jobs.run_silver(spark, f"{root}/b", f"{root}/s", "2026-03-22", lexicon, counts=counts)
    found = counts.rows()
    assert {s: found[f"{s}_silver"] for s in written} == written and found["news_landed"] == 24 and found["trends_landed"] == 120


def test_sql_functions_equal_the_column_expressions(spark):
    names = sql.register(spark, "fn_")
    assert "fn_health_index" in names
    values = [None, -101.0, -5.1, -5.0, -2.1, -0.6, -0.5, -0.05, 0.0, 0.05, 0.4, 0.6, 2.1, 5.0, 20.0, 21.0, 35.0, 55.0, 75.0, 99.5]
    data = [(v, None if v is None else int(v), flag, trend) for v in values for flag in (True, False, None) for trend in ("ACCELERATING", "STABLE", None)]
    df = spark.createDataFrame(data, "v double, n long, flag boolean, trend string")
    v, n, flag, trend = (F.col(c) for c in df.columns)
    pairs = {
        "fn_sentiment_label(v)": labels.sentiment_label(v), "fn_coverage_trend(v)": labels.coverage_trend(v),
        "fn_price_signal(v)": labels.price_signal(v), "fn_health_label(v)": labels.health_label(v), "fn_wow_direction(v)": labels.wow_direction(v),
        "fn_is_anomaly(v)": labels.is_anomaly(v), "fn_alert_flag(v, flag, trend)": labels.alert_flag(v, flag, trend),
        "fn_alert_reason(v, flag, trend)": labels.alert_reason(v, flag, trend), "fn_sentiment_normalized(v)": scaling.sentiment_normalized(v),
        "fn_trend_normalized(n)": scaling.trend_normalized(n), "fn_stock_normalized(flag, v)": scaling.stock_normalized(flag, v),
    }
    for call, column in pairs.items():
        assert df.select(F.expr(call).alias("a"), column.alias("b")).where("not (a <=> b)").isEmpty(), call
    named = df.select(flag.alias("stock_available"), v.alias("sentiment_normalized"), n.alias("trend_normalized"), v.alias("stock_normalized"),
                      v.alias("share_of_voice_pct"))
    call = "fn_health_index(stock_available, sentiment_normalized, trend_normalized, stock_normalized, share_of_voice_pct)"
    assert named.select(F.expr(call).alias("a"), scaling.composite_index(F.col("stock_available")).alias("b")).where("not (a <=> b)").isEmpty()


def test_reports_as_statements(spark, root, lexicon):
    b, s, g = f"{root}/b", f"{root}/s", f"{root}/g"
    for day, tone in (("2026-03-15", "great"), ("2026-03-22", "poor")):
        land_day(spark, b, day, tone)
        jobs.run_silver(spark, b, s, day, lexicon)
        jobs.run_gold(spark, s, g, day)
    table = gold.read_gold(spark, g)
    for name in sql.REPORTS:
        got, want = sql.report(table, name, "2026-03-22"), getattr(reports, name)(table, "2026-03-22")
        assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] or rows(got) == rows(want), name
    with pytest.raises(ValueError):
        sql.report(Catalog(), "leaderboard", "2026-03-22")


# --- context ----------------------------------------------------------------------------

def brute_context(text, lexicon, rules):
    words = re.findall("[A-Za-z]+", text or "")
    loud = [w == w.upper() and len(w) > 1 for w in words]
    total = 0.0
    for k, word in enumerate(words):
        value = lexicon.get(word.lower(), 0.0)
        if not value:
            continue
        sign = math.copysign(1.0, value)
        if loud[k] and not all(loud):
            value += sign * rules.capitals
        before = [words[k - d].lower() for d in (1, 2, 3) if k >= d]
        for word_, damping in zip(before, rules.damping):
            value += sign * rules.boosters.get(word_, 0.0) * damping
        total += value * rules.negation if any(w in rules.negations for w in before) else value
    return total / math.sqrt(total * total + 15)


def test_context_against_brute_force(spark):
    lexicon = {"great": 3.1, "poor": -2.1, "good": 1.9, "so": 0.4}
    texts = ["great", "not great", "NOT GREAT", "a GREAT day", "very great and not at all poor", "extremely very really good", "never so poor",
             "without any of the good", "slightly POOR", "", None, "nothing", "great great not great", "éàé good", "I am GOOD", "x " * 500 + "not good"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "great")], "id int, text string").dropDuplicates()
    table = spark.createDataFrame(list(lexicon.items()), schemas.LEXICON)
    got = {r.id: r.sentiment_score for r in context.sentiment_in_context(df, "text", table, ["id"]).collect()}
    assert got == {k: pytest.approx(brute_context(t, lexicon, context.Rules()), abs=1e-12) for k, t in enumerate(texts)}
    assert "Python" not in plan(context.sentiment_in_context(df, "text", table, ["id"]))


def test_gold_days_compare_each_with_its_own_week(spark):
    data = [("A", "c", "listed", d, i, "STRONG", 50.0, 40) for d, i in (("2024-01-01", 50.0), ("2024-01-08", 60.0), ("2024-01-15", 52.0))]
    data += [("B", "c", "listed", "2024-01-08", 70.0, "STRONG", 50.0, 40)]
    df = spark.createDataFrame(data, "brand_name string, category string, brand_type string, processed_date string, brand_health_index double,"
                                     " health_label string, sentiment_normalized double, trend_normalized long").withColumn(
        "processed_date", F.col("processed_date").cast("date"))
    got = {(r.brand_name, str(r.processed_date)): (r.index_change_wow, r.wow_direction) for r in G.week_over_week_on(df, df).collect()}
    assert got == {("A", "2024-01-01"): (None, None), ("A", "2024-01-08"): (10.0, "IMPROVING"), ("A", "2024-01-15"): (-8.0, "DECLINING"),
                   ("B", "2024-01-08"): (None, "STABLE")}
