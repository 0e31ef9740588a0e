"""Silver news: from landed articles to one row per brand and day."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import labels, text
from signalmart.operators.rows import dedupe, tie_key
from signalmart.operators.sentiment import score_with, sentiment
from signalmart.operators.series import in_periods, velocity
from signalmart.operators.tails import continued, next_tail
from signalmart.operators.voice import share_of_voice

ARTICLE_KEYS = ["url", "brand_name"]
DAY_KEYS = ["brand_name", "category", "brand_type", "news_date"]
LOAD_ORDER = ["ingested_at", "published_at"]
# Decide between articles that were loaded and published at the same time.
TIES = ["category", "brand_type", "ticker", "source_name", "headline"]
SCORED_COLUMNS = ["category", "brand_type", "news_date", "headline"]


def standardize(bronze: DataFrame) -> DataFrame:
    """The columns silver works on, with the publication date."""
    return bronze.select(
        "brand_name", "brand_type", "category", "ticker", "headline", "source_name", "published_at", "url",
        "ingested_at",
        text.date_of(F.col("published_at")).alias("news_date"),
        F.lit(C.NEWS_SOURCE).alias("data_source"),
    )


def drop_incomplete(articles: DataFrame) -> DataFrame:
    return articles.dropna(subset=["headline", "brand_name", "url"])


def clean(bronze: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Standardised, complete articles, one per url and brand: the one loaded first; all columns or those named."""
    return dedupe(drop_incomplete(standardize(bronze)), ARTICLE_KEYS, LOAD_ORDER, columns, TIES)


def score(articles: DataFrame, lexicon: DataFrame | None, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sentiment score and label per article."""
    carry = [c for c in SCORED_COLUMNS if c != "headline"]
    if scorer is not None:
        scored = score_with(articles, "headline", scorer, ARTICLE_KEYS, carry)
    elif lexicon is not None:
        scored = sentiment(articles, "headline", lexicon, ARTICLE_KEYS, carry)
    else:
        raise ValueError("silver news needs a lexicon or a scorer")
    return scored.withColumn("sentiment_label", labels.sentiment_label(F.col("sentiment_score")))


def score_before_dedupe(bronze: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``score(clean(...))`` in the other order, for long texts.

    The text is reduced to its score where it is read, so that only narrow rows are
    shuffled (twice); ``score`` after ``clean`` shuffles the texts (once) and scores
    no copies, which suits headlines.
    """
    articles = drop_incomplete(standardize(bronze)).withColumn("_article", tie_key(TIES))
    carry = [c for c in SCORED_COLUMNS if c != "headline"]
    scored = sentiment(articles, "headline", lexicon, [*ARTICLE_KEYS, *LOAD_ORDER, "_article"], carry)
    unique = dedupe(scored, ARTICLE_KEYS, [*LOAD_ORDER, "_article"]).drop(*LOAD_ORDER, "_article")
    return unique.withColumn("sentiment_label", labels.sentiment_label(F.col("sentiment_score")))


def daily(scored: DataFrame) -> DataFrame:
    """Article count, mean sentiment and label counts per brand and day."""
    label = F.col("sentiment_label")
    return scored.groupBy(*DAY_KEYS).agg(
        F.count("*").alias("daily_article_count"),
        F.avg("sentiment_score").alias("avg_daily_sentiment"),
        F.count_if(label == "POSITIVE").alias("positive_count"),
        F.count_if(label == "NEGATIVE").alias("negative_count"),
    )


def signals(
    per_day: DataFrame, period: Callable[[Column], Column] = text.iso_week, frame: str = "rows",
    split: Callable[[Column], Column] | None = None, tail: DataFrame | None = None,
) -> DataFrame:
    """Rolling average, velocity, coverage trend and share of voice of the daily rows.

    Share of voice is computed from the daily counts, which gives the same shares as
    counting raw articles: a day belongs to one week and the daily keys contain category
    and brand.  ``split`` cuts long series, for example by ``text.year_of``; it needs a brand
    to keep its category and type, so that it has one row per day.  With a ``tail`` the days go on from
    earlier ones, late days in their places among them; shares are those within the days given.
    """
    def moves(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return velocity(df, "daily_article_count", keys, "news_date", "news_velocity", frame=frame)

    if tail is None:
        moving = in_periods(per_day, ["brand_name"], "news_date", split, C.ROLLING_ROWS - 1, moves)
    else:
        moving = continued(per_day, tail, ["brand_name"], "news_date", moves, late=True)
    moving = moving.withColumn("coverage_trend", labels.coverage_trend(F.col("news_velocity")))
    weekly = moving.withColumn("week_number", period(F.col("news_date")))
    return share_of_voice(weekly, ["brand_name"], ["category", "week_number"], "daily_article_count")


def tail_of(per_day: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """The daily rows the next day's velocity looks back to, see ``operators.tails``."""
    return next_tail(per_day.where(F.col("news_date").isNotNull()), tail, ["brand_name"], "news_date", C.ROLLING_ROWS - 1, late=True)


def news_silver(
    bronze: DataFrame, as_of: str, lexicon: DataFrame | None = None, *,
    scorer: Callable[[Column], Column] | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None, long_texts: bool = False,
    period: Callable[[Column], Column] = text.iso_week, frame: str = "rows",
    split: Callable[[Column], Column] | None = None, tail: DataFrame | None = None,
) -> DataFrame:
    """Silver news of the given articles.

    The daily rows are read twice, for the brand's series and for the category totals.
    ``stage`` (see ``sources.shared.stage``) writes them to a table in between, so that
    the articles are scored once; without it the plan stays lazy and only the article
    shuffle is shared.  ``long_texts`` scores with the lexicon before de-duplicating.
    """
    per_day = per_day_of(bronze, lexicon, scorer, long_texts)
    if stage is not None:
        per_day = stage(per_day)
    return finished(signals(per_day, period, frame, split, tail), as_of)


def per_day_of(
    bronze: DataFrame, lexicon: DataFrame | None, scorer: Callable[[Column], Column] | None = None, long_texts: bool = False
) -> DataFrame:
    """Scored, de-duplicated and summed up by brand and day."""
    if long_texts and scorer is None and lexicon is not None:
        return daily(score_before_dedupe(bronze, lexicon))
    return daily(score(clean(bronze, SCORED_COLUMNS), lexicon, scorer))


def finished(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.withColumn("ingestion_date", F.lit(as_of)).select(*schemas.NEWS_SILVER.fieldNames())
