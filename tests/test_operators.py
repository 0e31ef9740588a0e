"""Row picking, series, share of voice and sentiment."""

import itertools
import random
import statistics

import pandas as pd
import pytest
from helpers import plan, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalmart.operators import rows as R
from signalmart.operators import series as S
from signalmart.operators.sentiment import score_with, scorer, sentiment
from signalmart.operators.sizing import broadcast_if_small, is_small
from signalmart.operators.voice import share_of_voice


# --- rows -------------------------------------------------------------------------

def test_dedupe_keeps_the_first_by_order_whatever_the_partitioning(spark):
    data = [("a", 1, t, f"p{t}") for t in range(50)] + [(None, 1, 5, "x"), (None, 1, 4, "y"), ("b", None, 1, "z")]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k string, j int, t int, p string").repartition(5 + seed)
        assert rows(R.dedupe(df, ["k", "j"], ["t"])) == rows(
            spark.createDataFrame([("a", 1, 0, "p0"), (None, 1, 4, "y"), ("b", None, 1, "z")], df.schema))


def test_dedupe_is_deterministic_without_an_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2)], "k string, v int")
    assert rows(R.dedupe(df, ["k"])) == [("a", 1)]


def test_dedupe_aggregates_before_the_shuffle(spark):
    text = plan(R.dedupe(spark.range(10).withColumn("k", F.lit("hot")), ["k"], ["id"]))
    assert "partial_min" in text and "Window" not in text


def test_latest_per_key_looks_no_further_than_as_of(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01", 1), ("a", "2024-01-03", 3), ("a", "2024-01-05", 5), ("b", None, 7), ("c", "2024-02-01", 9)],
        "k string, d string, v int")
    assert rows(R.latest_per_key(df, ["k"], "d", F.lit("2024-01-04"))) == [("a", "2024-01-03", 3)]
    assert rows(R.latest_per_key(df, ["k"], "d")) == [("a", "2024-01-05", 5), ("b", None, 7), ("c", "2024-02-01", 9)]


def test_first_n_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(k, n) for k in "ab" for n in range(30)], "k string, n int")
    top = R.first_n(df, ["k"], [F.desc("n")], 2)
    assert rows(top) == [("a", 28), ("a", 29), ("b", 28), ("b", 29)]
    text = plan(top)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_last_n_of_a_short_series(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-01", 1), ("b", "2024-01-02", 2),
                                ("b", "2024-01-03", 3)], "k string, d string, v int")
    assert rows(R.last_n(df, ["k"], "d", 2)) == [("a", "2024-01-01", 1), ("b", "2024-01-02", 2), ("b", "2024-01-03", 3)]


# --- series -----------------------------------------------------------------------

def series(spark, values, start="2024-01-01", skip=()):
    days = [str(d.date()) for d in pd.date_range(start, periods=len(values) + len(skip))]
    days = [d for k, d in enumerate(days) if k not in skip]
    return spark.createDataFrame([("a", d, v) for d, v in zip(days, values)], "k string, d string, v double")


def test_pct_change_first_row_zero_base_and_null(spark):
    df = series(spark, [10.0, 11.0, 0.0, 5.0, None, 4.0])
    got = [r.c for r in S.pct_change(df, "v", ["k"], "d", "c").orderBy("d").collect()]
    assert got == [0.0, 10.0, -100.0, 0.0, None, 0.0]


def test_pct_change_with_a_longer_lag(spark):
    df = series(spark, [10.0, 11.0, 12.0])
    assert [r.c for r in S.pct_change(df, "v", ["k"], "d", "c", lag=2).orderBy("d").collect()] == [0.0, 0.0, 20.0]


def test_rolling_stddev_is_null_for_one_row_and_counts_seven_rows(spark):
    values = [float(v) for v in (1, 4, 2, 8, 5, 7, 3, 9, 6)]
    got = [r.s for r in S.rolling_stddev(series(spark, values), "v", ["k"], "d", "s").orderBy("d").collect()]
    assert got[0] is None
    for k in range(1, len(values)):
        assert got[k] == pytest.approx(statistics.stdev(values[max(0, k - 6):k + 1]), abs=5e-5)


def test_rows_and_days_differ_on_a_gapped_series(spark):
    df = series(spark, [2.0, 2.0, 10.0], skip=range(2, 12))
    by_rows = [r.a for r in S.rolling_avg(df, "v", ["k"], "d", "a").orderBy("d").collect()]
    by_days = [r.a for r in S.rolling_avg(df, "v", ["k"], "d", "a", frame="days").orderBy("d").collect()]
    assert by_rows == [2.0, 2.0, 4.67] and by_days == [2.0, 2.0, 10.0]
    with pytest.raises(ValueError):
        S.rolling_avg(df, "v", ["k"], "d", "a", frame="weeks")


def test_velocity_uses_the_rounded_average(spark):
    df = series(spark, [1.0, 1.0, 2.0])
    last = S.velocity(df, "v", ["k"], "d", "x").orderBy(F.desc("d")).first()
    assert last.rolling_7d_avg == 1.33 and last.x == 50.38  # (2 - 1.33) / 1.33, not (2 - 4/3) / (4/3)


def test_zscore_without_spread_or_with_one_row(spark):
    assert [r.z for r in S.zscore(series(spark, [5.0, 5.0, 5.0]), "v", ["k"], "z").collect()] == [0.0] * 3
    assert S.zscore(series(spark, [5.0]), "v", ["k"], "z").first().z == 0.0


def test_zscore_against_the_definition(spark):
    values = [3.0, 5.0, 4.0, 20.0, 6.0]
    got = [r.z for r in S.zscore(series(spark, values), "v", ["k"], "z").orderBy("d").collect()]
    mean, std = statistics.mean(values), statistics.stdev(values)
    assert got == pytest.approx([(v - mean) / std for v in values], abs=5e-5)


def gapped(spark, seed, n=120):
    draw = random.Random(seed)
    days = pd.date_range("2023-11-01", periods=400)
    data = []
    for key in ("a", "b", None):
        chosen = sorted(draw.sample(range(len(days)), n if key == "a" else n // 10))
        data += [(key, str(days[d].date()), round(draw.uniform(0, 9), 2)) for d in chosen]
    return spark.createDataFrame(data, "k string, d string, v double")


@pytest.mark.parametrize("width", [4, 7, 9, 10])  # by year, month, ten days, day
def test_split_series_give_the_same_signals(spark, width):
    df = gapped(spark, width)

    def signals(part, keys):
        moved = S.pct_change(part, "v", keys, "d", "c", scale=4)
        return S.velocity(S.rolling_stddev(moved, "c", keys, "d", "s"), "v", keys, "d", "x")

    whole = S.in_periods(df, ["k"], "d", None, 7, signals)
    cut = S.in_periods(df, ["k"], "d", lambda day: F.substring(day, 1, width), 7, signals)
    assert rows(cut) == rows(whole)


def test_lead_rows_reach_over_short_periods(spark):
    df = spark.createDataFrame([("a", d, d) for d in range(10)], "k string, d int, v int")
    cut = S.with_lead_rows(df, ["k"], "d", F.col("d"), 3)
    assert rows(cut.where("_period = 5").select("d", "_lead")) == [(2, True), (3, True), (4, True), (5, False)]
    assert cut.where("not _lead").count() == 10


def test_zscore_of_long_series_is_the_same(spark):
    df = gapped(spark, 1)
    assert rows(S.zscore(df, "v", ["k"], "z")) == rows(S.zscore(df, "v", ["k"], "z", long_series=True))


# --- share of voice ---------------------------------------------------------------

def articles(spark, seed=3, n=600):
    draw = random.Random(seed)
    weights = {"b0": 20, "b1": 5, "b2": 3, "b3": 1, "b4": 1}  # one brand holds two thirds
    data = []
    for _ in range(n):
        b = draw.choices(list(weights), list(weights.values()))[0]
        data.append((b, None if b == "b4" else "c" + str(int(b[1]) % 2), draw.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "brand string, category string, week int")


def test_aggregated_share_equals_two_windows_over_raw_rows(spark):
    raw = articles(spark)
    counts = raw.groupBy("brand", "category", "week").agg(F.count("*").alias("n"))
    ours = share_of_voice(counts, ["brand"], ["category", "week"], "n", "share").drop("n")
    everyone = F.count("*").over(Window.partitionBy("category", "week"))
    own = F.count("*").over(Window.partitionBy("category", "brand", "week"))
    literal = raw.withColumn("share", F.round(own / everyone * 100, 2)).distinct()
    assert rows(ours) == rows(literal)


def test_shares_of_a_group_sum_to_hundred(spark):
    counts = articles(spark, seed=9).groupBy("brand", "category", "week").agg(F.count("*").alias("n"))
    shares = share_of_voice(counts, ["brand"], ["category", "week"], "n")
    for r in shares.groupBy("category", "week").agg(F.sum("share_of_voice_pct").alias("s")).collect():
        assert r.s == pytest.approx(100, abs=0.05)


# --- sentiment --------------------------------------------------------------------

LEXICON = [("good", 2.0), ("bad", -2.5), ("very", 0.5)]


def brute(text):
    words, word = [], ""
    for ch in itertools.chain(text.lower(), " "):
        if "a" <= ch <= "z":
            word += ch
        else:
            words.append(word)
            word = ""
    s = sum(dict(LEXICON).get(w, 0.0) for w in words)
    return s / (s * s + 15) ** 0.5


def test_sentiment_against_brute_force_on_whole_texts(spark):
    texts = ["Good good BAD", "nothing here", "", "42", "very-good", "x " * 20_000 + "bad", "goodbad", "Bad.", "é good"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lexicon = spark.createDataFrame(LEXICON, "term string, valence double")
    got = {r.k: r.sentiment_score for r in sentiment(df, "t", lexicon, ["k"]).collect()}
    assert got == {k: pytest.approx(brute(t)) for k, t in enumerate(texts)}


def test_copies_of_a_row_are_scored_once(spark):
    df = spark.createDataFrame([(1, "good"), (1, "good"), (2, "bad")], "k int, t string")
    lexicon = spark.createDataFrame(LEXICON, "term string, valence double")
    got = dict(rows(sentiment(df, "t", lexicon, ["k"])))
    assert got == {1: pytest.approx(brute("good")), 2: pytest.approx(brute("bad"))}


def test_large_lexicon_gives_the_same_scores_by_a_shuffled_join(spark, monkeypatch):
    from signalmart.operators import sentiment as module
    df = spark.createDataFrame([(k, "good bad good" if k % 3 else "none") for k in range(200)], "k int, t string")
    lexicon = spark.createDataFrame(LEXICON, "term string, valence double")
    small = sentiment(df, "t", lexicon, ["k"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(module, "broadcast_if_small", lambda other: other)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = sentiment(df, "t", lexicon, ["k"])
        assert "SortMergeJoin" in plan(large) and "BroadcastHashJoin" in plan(small)
        assert rows(large) == rows(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scoring_after_dedupe_needs_no_further_shuffle(spark):
    df = spark.createDataFrame([("u", "b", "good")], "url string, brand string, t string")
    lexicon = spark.createDataFrame(LEXICON, "term string, valence double")
    text = plan(sentiment(R.dedupe(df, ["url", "brand"]), "t", lexicon, ["url", "brand"]))
    assert text.count("Exchange hashpartitioning") == 1


def test_plugged_in_scorer(spark):
    def make():
        return lambda text: len(text) / 10

    df = spark.createDataFrame([(1, "abc"), (2, "")], "k int, t string")
    assert rows(score_with(df, "t", scorer(make), ["k"])) == [(1, 0.3), (2, 0.0)]


def test_failing_scorer_fails_the_job(spark):
    def make():
        raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "abc")], "k int, t string")
    with pytest.raises(Exception, match="no model"):
        score_with(df, "t", scorer(make), ["k"]).collect()


def test_size_check_bounds_rows_and_bytes(spark):
    df = spark.range(100)
    assert is_small(df, 100) and not is_small(df, 99) and not is_small(df, 100, 50)
    assert is_small(df.where("false"))
    assert broadcast_if_small(df, 99) is df


def test_the_kept_row_does_not_depend_on_the_columns(spark):
    df = spark.createDataFrame([("k", 1, s, h) for s, h in [("z", "a"), ("a", "b"), ("m", "c"), ("b", None)]],
                               "k string, t int, s string, h string")
    whole = R.dedupe(df, ["k"], ["t"], ties=["s", "h"]).first()
    for columns in (["s"], ["h"], ["h", "s"]):
        row = R.dedupe(df, ["k"], ["t"], columns, ["s", "h"]).first()
        assert all(row[c] == whole[c] for c in columns) and "_tie" not in row.asDict()
