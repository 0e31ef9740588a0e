"""The daily batch jobs: shaped records to bronze, bronze to silver, silver to gold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart import constants as C
from signalmart import schemas
from signalmart.operators.counting import Counts
from signalmart.operators.landing import choose_source, ingest_summary, shape_news, skip_existing
from signalmart.operators.moments import merged
from signalmart.plans import news, stocks, trends
from signalmart.plans.gold import JOIN_KEYS, brand_health, current_on, week_over_week_on
from signalmart.sources.bronze import landed_units, quarantine, read_bronze, read_sound, write_bronze
from signalmart.sources.catalog import Catalog
from signalmart.sources.gold import read_gold, read_history, week_before, write_gold
from signalmart.sources.seen import SeenKeys
from signalmart.sources.shared import remove, stage
from signalmart.sources.silver import SCHEMAS, read_silver, write_silver
from signalmart.sources.state import DayState

HISTORY = [*JOIN_KEYS, "processed_date", "brand_health_index", "health_label", "sentiment_normalized", "trend_normalized"]
_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()
STOCKS_TAIL = T.StructType([*[T.StructField(c, _STRING) for c in (
    "brand_name", "brand_type", "category", "ticker", "exchange", "date", "stock_date", "ingested_at")], *[
    T.StructField(f"{p}_price", _DOUBLE) for p in ("open", "close", "high", "low")], T.StructField("volume", _LONG)])
TRENDS_TAIL = T.StructType([*[T.StructField(c, _STRING) for c in (
    "brand_name", "brand_type", "category", "date", "trend_date", "geo", "ingested_at")],
    T.StructField("trend_score", _LONG), T.StructField("stock_available", T.BooleanType())])
MOMENTS = T.StructType([T.StructField("brand_name", _STRING), T.StructField("n", _LONG), T.StructField("mean", _DOUBLE), T.StructField("m2", _DOUBLE)])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass here while the plan runs, without a job of its own."""
    observation = Observation(name)
    return df.observe(observation, F.count("*").alias("rows")), observation


def land(records: DataFrame, units: DataFrame, root: str, source: str, day: str) -> DataFrame:
    """Land the records of units that have nothing on that day yet; returns the summary of the run.

    ``units`` lists what was to be landed, with the keys of the source (category and
    brand, or just category for trends).  Units that have landed are skipped, units without
    records are reported with zero and tried again by the next run.  Records are shaped once: what is written
    and counted is the same table, and later runs do not change the summary.
    """
    spark = records.sparkSession
    made: list[str] = []
    try:
        # Written, because the listing of what was there before must not change with this run.
        before = stage("landed-units", made)(landed_units(spark, root, source, day))
        keys = before.columns
        fresh = stage("landing", made)(skip_existing(records, before, keys))
        write_bronze(fresh, root, source, day)
        return stage("landing-summary")(ingest_summary(units, fresh, keys, before))
    finally:
        for path in made:
            remove(spark, path)


def land_news(
    payloads: DataFrame, brands: DataFrame, root: str, day: str, ingested_at: str, per_term: int | None = C.NEWS_PAGE_SIZE,
) -> DataFrame:
    """Land a day's news responses in one call: choose, limit, shape, skip what has landed, write, sum up.

    ``payloads`` holds primary and secondary responses (``origin``).  Per brand and search term the secondary ones stand in where the
    primary request was answered without articles.  Returns the summary of ``land``.
    """
    chosen = choose_source(payloads, ["brand_name", "search_term"]).drop("origin")
    return land(shape_news(chosen, brands, ingested_at, per_term), brands, root, "news", day)


NEWS_TAIL = T.StructType([
    f for f in schemas.NEWS_SILVER if f.name in (*news.DAY_KEYS, "daily_article_count", "avg_daily_sentiment", "positive_count", "negative_count")])


class Builders:
    """The silver rows of each source from its landed records, with or without the state of earlier days."""

    def __init__(self, spark: SparkSession, as_of: str, state: str | None, seen: SeenKeys | None, made: list[str], **options) -> None:
        self.spark, self.as_of, self.seen, self.made, self.options = spark, as_of, seen, made, options
        self.state = DayState(spark, state) if state else None

    def news(self, landed: DataFrame) -> DataFrame:
        if self.seen is not None:
            landed = stage("news-unseen", self.made)(self.seen.unseen(landed, self.as_of))
        per_day = stage("news-daily", self.made)(news.per_day_of(landed, **self.options))
        tail = None
        if self.state:
            tail = self.state.latest("news_tail", self.as_of, NEWS_TAIL)
            self.state.write(news.tail_of(per_day, tail), "news_tail", self.as_of)
        if self.seen is not None:
            self.seen.add(news.drop_incomplete(news.standardize(landed)), self.as_of)
        return news.finished(news.signals(per_day, tail=tail), self.as_of)

    def stocks(self, landed: DataFrame) -> DataFrame:
        tail = None
        if self.state:
            tail = self.state.latest("stocks_tail", self.as_of, STOCKS_TAIL)
            self.state.write(stocks.tail_of(landed, tail).select(*STOCKS_TAIL.fieldNames()), "stocks_tail", self.as_of)
        return stocks.stocks_silver(landed, self.as_of, tail=tail)

    def trends(self, landed: DataFrame) -> DataFrame:
        if not self.state:
            return trends.trends_silver(landed, self.as_of)
        tail = self.state.latest("trends_tail", self.as_of, TRENDS_TAIL)
        self.state.write(trends.tail_of(landed, tail).select(*TRENDS_TAIL.fieldNames()), "trends_tail", self.as_of)
        today = stage("trends-moments", self.made)(trends.moments_of(landed, tail))
        self.state.write(today, "trends_moments", self.as_of)
        earlier = self.state.before("trends_moments", self.as_of, MOMENTS)
        whole = merged(earlier.unionByName(today.withColumn("state_day", F.lit(self.as_of))), ["brand_name"], "state_day")
        return trends.trends_silver(landed, self.as_of, tail=tail, state=whole)


def run_silver(
    spark: SparkSession, bronze_root: str, silver_root: str | Catalog, as_of: str, lexicon: DataFrame | None = None,
    scorer: Callable[[Column], Column] | None = None, mode: str = "overwrite", long_texts: bool = False,
    look_back: int = 0, state: str | None = None, seen: SeenKeys | None = None, tolerant: bool = False,
    counts: Counts | None = None,
) -> dict[str, int]:
    """Build the silver tables of one landing day; a source without records gets an empty day.

    ``look_back`` adds the records landed on that many days before, so that rolling figures see them.  ``state`` names a folder
    in which runs leave the last rows of every series and the moments of the trend scores for the next: figures then reach over all days
    built so, and no earlier record is read.  ``seen`` drops articles that landed on an earlier day.  ``tolerant`` puts damaged records of the day aside
    (``sources.bronze.read_quarantine`` tells which) in place of failing.  ``counts`` gets the landed and the written rows of every source, counted
    while they pass.  All rows carry ``as_of`` as ingestion date.  The sources are independent and run side by side.  Returns the
    rows written per source.
    """
    if state and look_back:
        raise ValueError("either the records of earlier days are read again or their state is")
    if isinstance(silver_root, Catalog):
        silver_root.create(spark)
    made: list[str] = []
    builders = Builders(spark, as_of, state, seen, made, lexicon=lexicon, scorer=scorer, long_texts=long_texts)

    def run(source: str) -> int:
        last = date.fromisoformat(as_of).toordinal()
        days = [date.fromordinal(last - k).isoformat() for k in range(look_back + 1)]
        landed = reduce(DataFrame.unionByName, [read(source, day) for day in days])
        if landed.isEmpty():
            write_silver(spark.createDataFrame([], SCHEMAS[source]), silver_root, source, as_of, mode)
            return 0
        if counts is not None:
            landed = stage(f"{source}-landed", made)(counts.at(landed, f"{source}_landed"))
        rows, observation = observed(getattr(builders, source)(landed), f"silver-{source}")
        if counts is not None:
            rows = counts.at(rows, f"{source}_silver")
        write_silver(rows, silver_root, source, as_of, mode)
        return observation.get["rows"]

    def read(source: str, day: str) -> DataFrame:
        if not tolerant:
            return read_bronze(spark, bronze_root, source, day)
        sound, damaged = read_sound(spark, bronze_root, source, day)
        quarantine(damaged, bronze_root, source, day)
        return sound

    try:
        with ThreadPoolExecutor(len(SCHEMAS)) as pool:
            return dict(zip(SCHEMAS, pool.map(run, SCHEMAS)))
    finally:
        for path in made:
            remove(spark, path)


def build_gold(
    spark: SparkSession, silver_root: str | Catalog, as_of: str, history: DataFrame | None = None
) -> DataFrame:
    """The gold rows of one day from that day's silver, for any sink."""
    sources = (read_silver(spark, silver_root, s, as_of) for s in ("news", "trends", "stocks"))
    return brand_health(*sources, as_of, history)


def run_gold(
    spark: SparkSession, silver_root: str | Catalog, gold_path: str | Catalog, as_of: str, mode: str = "overwrite",
) -> int:
    """Build the gold rows of one day and write them to the gold table; returns their number.

    ``overwrite`` replaces the day as a whole, also by no rows.
    """
    if isinstance(gold_path, Catalog):
        gold_path.create(spark)
    made: list[str] = []
    try:
        # A table that is written cannot be read by the same plan.
        history = stage("gold-history", made)(read_history(spark, gold_path, as_of))
        rows, observation = observed(build_gold(spark, silver_root, as_of, history), "gold")
        write_gold(rows, gold_path, mode, as_of)
        return observation.get["rows"]
    finally:
        for path in made:
            remove(spark, path)


def backfill_gold(
    spark: SparkSession, silver_root: str | Catalog, gold_path: str | Catalog, days: Sequence[str]
) -> dict[str, int]:
    """Build the gold rows of several days from one pass over each silver source; returns the rows per day.

    A day sees the silver of its own ingestion, as in ``run_gold``.  It is compared with the day a week before, if that is
    one of the days, and else with what the gold table has of it.
    """
    if isinstance(gold_path, Catalog):
        gold_path.create(spark)
    days = sorted(set(days))
    made: list[str] = []
    sources = [read_silver(spark, silver_root, s).where(F.col("ingestion_date").isin(days)) for s in ("news", "trends", "stocks")]
    try:
        current = stage("gold-days", made)(current_on(*sources, days, lambda day: F.col("ingestion_date") == day))
        before = [week_before(day) for day in days if week_before(day) not in days]
        kept = read_gold(spark, gold_path).where(F.col("processed_date").cast("string").isin(before))
        history = current.select(*HISTORY).unionByName(kept.select(*HISTORY))
        rows = stage("gold-compared", made)(week_over_week_on(current, history).select(*schemas.BRAND_HEALTH.fieldNames()))
        written = {str(r.processed_date): r.n for r in rows.groupBy("processed_date").agg(F.count("*").alias("n")).collect()}
        for day in days:  # each replaces its own partition; the rows are few
            write_gold(rows.where(F.col("processed_date") == F.lit(day).cast("date")), gold_path, day=day)
        return {day: written.get(day, 0) for day in days}
    finally:
        for path in made:
            remove(spark, path)
