"""Thresholds and null branches of the column expressions."""

from pyspark.sql import functions as F

from signalmart.functions import labels, scaling, text


def apply(spark, expression, values, kind="double"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("x"))).collect()]


def test_sentiment_label_thresholds(spark):
    got = apply(spark, labels.sentiment_label, [0.05, 0.0499, 0.0, -0.0499, -0.05, 1.0, None])
    assert got == ["POSITIVE", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEGATIVE", "POSITIVE", "NEUTRAL"]


def test_coverage_trend_thresholds(spark):
    got = apply(spark, labels.coverage_trend, [20.0, 20.01, -20.0, -20.01, None])
    assert got == ["STABLE", "ACCELERATING", "STABLE", "DECELERATING", "STABLE"]


def test_price_signal_thresholds(spark):
    got = apply(spark, labels.price_signal, [2.01, 2.0, 0.51, 0.5, 0.0, -0.5, -0.51, -2.0, -2.01])
    assert got == ["STRONG_UP", "UP", "UP", "FLAT", "FLAT", "FLAT", "DOWN", "DOWN", "STRONG_DOWN"]


def test_health_label_thresholds_and_null_index(spark):
    got = apply(spark, labels.health_label, [75.0, 74.99, 55.0, 54.99, 35.0, 34.99, None])
    assert got == ["STRONG", "HEALTHY", "HEALTHY", "WEAK", "WEAK", "AT_RISK", "AT_RISK"]


def test_wow_direction_thresholds(spark):
    assert apply(spark, labels.wow_direction, [5.0, 5.01, -5.0, -5.01, None]) == [
        "STABLE", "IMPROVING", "STABLE", "DECLINING", "STABLE"]


def test_anomaly_needs_more_than_two_deviations_either_way(spark):
    assert apply(spark, labels.is_anomaly, [2.0, 2.0001, -2.0, -2.0001, None]) == [False, True, False, True, False]


def test_alerts_first_reason_wins_and_unknown_is_no_alert(spark):
    cases = [
        (-0.6, True, "ACCELERATING", "High negative sentiment"),
        (-0.5, True, "ACCELERATING", "Abnormal trend spike — zscore > 2"),
        (-0.1, False, "ACCELERATING", "Accelerating negative coverage"),
        (-0.1, None, "ACCELERATING", "Accelerating negative coverage"),
        (0.0, False, "ACCELERATING", None),
        (-0.1, False, "STABLE", None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(cases, "s double, a boolean, c string, expected string")
    inputs = [F.col("s"), F.col("a"), F.col("c")]
    got = df.select("expected", labels.alert_reason(*inputs).alias("r"), labels.alert_flag(*inputs).alias("f")).collect()
    assert all(r["r"] == r["expected"] and r["f"] == (r["expected"] is not None) for r in got)


def test_rescaled_sentiment(spark):
    assert apply(spark, scaling.sentiment_normalized, [-1.0, 0.0, 1.0, 0.12345, None]) == [0.0, 50.0, 100.0, 56.17, None]


def test_trend_clamp_keeps_type_and_null(spark):
    df = spark.createDataFrame([(-1,), (0,), (55,), (100,), (101,), (None,)], "x bigint")
    out = df.select(scaling.trend_normalized(F.col("x")).alias("y"))
    assert out.schema["y"].dataType.simpleString() == "bigint"
    assert [r.y for r in out.collect()] == [0, 0, 55, 100, 100, None]


def test_stock_normalized_branches(spark):
    cases = [(True, 5.0, 100.0), (True, 5.1, 100.0), (True, -5.0, 0.0), (True, -7.0, 0.0), (True, 0.0, 50.0),
             (True, 1.2345, 62.35), (True, None, 50.0), (False, 1.0, None), (False, None, None)]
    df = spark.createDataFrame(cases, "a boolean, x double, expected double")
    got = df.select("expected", scaling.stock_normalized(F.col("a"), F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [r.expected for r in got]


def test_composite_index_by_availability_and_null_parts(spark):
    df = spark.createDataFrame(
        [(True, 80.0, 60, 50.0, 40.0), (False, 80.0, 60, None, 40.0), (True, 80.0, 60, None, 40.0),
         (False, 80.0, None, None, 40.0)],
        "a boolean, sentiment_normalized double, trend_normalized bigint, stock_normalized double,"
        " share_of_voice_pct double")
    got = [r[0] for r in df.select(scaling.composite_index(F.col("a"))).collect()]
    assert got == [61.0, 64.0, None, None]


def test_other_weights(spark):
    df = spark.createDataFrame([(False, 10.0, 90)], "a boolean, sentiment_normalized double, trend_normalized bigint")
    index = scaling.composite_index(F.col("a"), {"sentiment_normalized": 1.0}, {"trend_normalized": 1.0})
    assert df.select(index).first()[0] == 90.0


def test_dates_are_taken_as_written_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = apply(spark, text.date_of, ["2026-03-22T01:00:00Z", "soon", None], "string")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [str(d) if d else None for d in got] == ["2026-03-22", None, None]


def test_weeks_around_new_year(spark):
    df = spark.createDataFrame([("2024-12-30",), ("2027-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = df.select(text.iso_week(F.col("d")), text.iso_year_week(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1, 202501), (53, 202653)]


def test_words_cover_the_whole_text(spark):
    long_text = "Good, " * 5000 + "bad"
    df = spark.createDataFrame([(long_text,), ("",), ("123",), ("It's GOOD!",)], "t string")
    got = [[w for w in r[0] if w] for r in df.select(text.words(F.col("t"))).collect()]
    assert got[0] == ["good"] * 5000 + ["bad"]
    assert got[1:] == [[], [], ["it", "s", "good"]]


def test_article_id_is_stable_and_null_safe(spark):
    df = spark.createDataFrame([("u", "t"), ("u", "t"), ("v", "t"), (None, None)], "u string, p string")
    ids = [r[0] for r in df.select(text.article_id(F.col("u"), F.col("p"))).collect()]
    assert ids[0] == ids[1] != ids[2] and None not in ids
