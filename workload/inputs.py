"""The library's input tables, derived from the generated tables.

Every generated row takes part: whole tables, whole texts.  A brand is one of the 25
of ``part``; documents are assigned to brands by a hash of their text (so exact copies
meet and de-duplication has work), events by their user.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import text as X
from signalmart.operators.landing import lineage_columns, shape_ohlc
from signalmart.plans.gold import current_on, last_week, week_over_week
from signalmart.plans.news import news_silver
from signalmart.plans.stocks import stocks_silver
from signalmart.plans.trends import trends_silver
from signalmart.sources.gold import week_before
from signalmart.sources.shared import stage

AS_OF = "2024-01-30"
LAST_WEEK = week_before(AS_OF)
BRANDS = 25
LISTED = 10
LOADED_AT = "2024-01-31T00:00:00Z"

# Valences are multiples of 0.5, so their sums are exact in any order.
LEXICON = [
    ("the", 1.0), ("and", -1.5), ("of", 1.0), ("with", -2.0), ("that", 1.5),
    ("by", -1.0), ("or", -1.5), ("is", 2.0), ("it", 0.5), ("on", -0.5),
]


def hash_number(value: Column) -> Column:
    """A stable non-negative number from a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def brand_columns(k: Column) -> dict[str, Column]:
    """Name, category and type of brand number ``k`` in 1..25."""
    return {
        "brand_name": F.concat(F.lit("Brand#"), k.cast("string")),
        "category": F.concat(F.lit("C"), (k % 3).cast("string")),
        "brand_type": F.when(k <= LISTED, "listed").otherwise("private"),
    }


@dataclass(frozen=True)
class Inputs:
    """Lazy input tables over one directory of generated tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- dimension ---

    @cached_property
    def brands(self) -> DataFrame:
        """One row per brand of ``part``; its search terms are its part types."""
        k = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
        types = self.table("part").groupBy("p_brand").agg(
            F.sort_array(F.collect_set(F.concat_ws(" ", "p_brand", "p_type"))).alias("search_terms")
        )
        ticker = F.when(F.col("k") <= LISTED, F.concat(F.lit("T"), F.col("k").cast("string")))
        return types.withColumn("k", k).withColumns(brand_columns(F.col("k"))).select(
            "brand_name", "category", "brand_type",
            ticker.alias("news_ticker"), ticker.alias("ticker"),
            F.when(F.col("k") <= LISTED, F.when(F.col("k") % 2 == 0, "NYSE").otherwise("NSE")).alias("exchange"),
            "search_terms",
            F.col("search_terms")[0].alias("trend_term"),
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(LEXICON, "term string, valence double")

    # --- news ---

    @cached_property
    def news_bronze(self) -> DataFrame:
        """One article per document, in the order of ``doc_id``; the headline is the whole text.

        Blank texts have no headline, texts with a run of number signs no readable date.  Articles land
        on their day, so every landing day has rows.
        """
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
        keyed = self.table("documents").withColumn("k", (hash_number(F.col("text")) % BRANDS + 1).cast("int"))
        return keyed.withColumns(brand_columns(F.col("k"))).select(
            "brand_name", "brand_type", "category",
            F.when(F.col("k") <= LISTED, F.concat(F.lit("T"), F.col("k").cast("string"))).alias("ticker"),
            F.col("source").alias("search_term"),
            F.when(F.trim("text") != "", F.col("text")).alias("headline"),
            F.col("source").alias("source_name"),
            F.concat(F.lit("u"), F.md5("text")).alias("url"),
            F.when(F.contains("text", F.lit("###")), F.lit("unknown")).otherwise(
                F.date_format(day, "yyyy-MM-dd'T12:00:00Z'")
            ).alias("published_at"),
            F.concat(
                F.date_format(day, "yyyy-MM-dd'T'"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
            ).alias("ingested_at"),
            "lang",
        )

    @cached_property
    def news_tied(self) -> DataFrame:
        """The articles under a hundred urls, brands by their order: many texts of a url are loaded at the same time."""
        k = (F.col("doc_id") % BRANDS + 1).cast("int")
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
        return self.table("documents").withColumn("k", k).withColumns(brand_columns(F.col("k"))).select(
            "brand_name", "brand_type", "category",
            F.when(F.col("k") <= LISTED, F.concat(F.lit("T"), F.col("k").cast("string"))).alias("ticker"),
            F.when(F.trim("text") != "", F.col("text")).alias("headline"),
            F.col("source").alias("source_name"),
            F.concat(F.lit("u"), (F.col("doc_id") % 100).cast("string")).alias("url"),
            F.concat(day, F.lit("T12:00:00Z")).alias("published_at"),
            day.alias("ingested_at"),
        )

    @cached_property
    def payloads(self) -> DataFrame:
        """One response per document: the brand's answer for a source, one article per line of the text.

        Lines whose hash ends in 7 are withdrawn; responses not in English failed.
        """
        keyed = self.table("documents").withColumn("k", (hash_number(F.col("text")) % BRANDS + 1).cast("int"))

        def article(line: Column) -> Column:
            digest = F.md5(line)
            none = F.lit(None).cast("string")
            return F.struct(
                F.when(F.right(digest, F.lit(1)) == "7", C.REMOVED_TITLE).otherwise(line).alias("title"),
                none.alias("description"),
                F.concat(F.lit("u"), digest).alias("url"),
                F.date_format(
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")),
                    "yyyy-MM-dd'T12:00:00Z'",
                ).alias("publishedAt"),
                none.alias("author"),
                F.struct(F.col("source").alias("name")).alias("source"),
            )

        return keyed.select(
            brand_columns(F.col("k"))["brand_name"].alias("brand_name"),
            F.col("source").alias("search_term"),
            F.col("doc_id").alias("term_pos"),
            "lang",
            F.when(F.col("lang") == C.NEWS_LANGUAGE, "ok").otherwise("error").alias("status"),
            F.transform(F.split("text", "\n"), article).alias("articles"),
        )

    @cached_property
    def payloads_of_both(self) -> DataFrame:
        """The same responses from a primary source and, all of them answered, from a secondary one."""
        return self.payloads.withColumn("origin", F.explode(F.array(F.lit("primary"), F.lit("secondary"))))

    # --- stocks ---

    @cached_property
    def _events(self) -> DataFrame:
        """Events with their brand, day and half day: every day is delivered twice."""
        keyed = self.table("events").withColumn("k", (F.col("user_id") % BRANDS + 1).cast("int"))
        return keyed.withColumns({"date": F.to_date("ts"), "half": F.when(F.hour("ts") < 12, 1).otherwise(2)})

    def _loaded_at(self) -> Column:
        return F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T"), F.format_string("%02d", F.col("half") * 11))

    @cached_property
    def ohlc_raw(self) -> DataFrame:
        """Raw bars of the listed brands, one per day and half day, from all their events."""
        bars = self._events.where(F.col("k") <= LISTED).groupBy("k", "date", "half").agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        return bars.withColumns(brand_columns(F.col("k"))).select(
            "brand_name", "brand_type", "category",
            F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"),
            F.when(F.col("k") % 2 == 0, "NYSE").otherwise("NSE").alias("exchange"),
            self._loaded_at().alias("ingested_at"),
            "date", "open", "high", "low", "close", "volume",
        )

    @cached_property
    def stocks_bronze(self) -> DataFrame:
        return shape_ohlc(self.ohlc_raw).withColumn("stock_available", F.lit(True))

    @cached_property
    def lineitem_bars(self) -> DataFrame:
        """Bars of all brands from the line items of their parts: one per brand and ship date."""
        order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
        parts = self.table("part").select("p_partkey", "p_brand")
        joined = self.table("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        bars = joined.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
            F.min_by("l_extendedprice", order).alias("open"), F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", order).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        k = F.regexp_extract("ticker", "[0-9]+", 0).cast("int")
        named = bars.withColumns(brand_columns(k)).withColumns({
            "exchange": F.lit("NYSE"), "ingested_at": F.lit(LOADED_AT), "stock_available": F.lit(True),
        })
        return shape_ohlc(named)

    # --- trends ---

    @cached_property
    def trends_bronze(self) -> DataFrame:
        """Interest of every brand per day and half day, scaled to the busiest one."""
        counts = self._events.groupBy("k", "date", "half").agg(F.count("*").alias("n"))
        busiest = counts.agg(F.max("n")).scalar()
        scaled = counts.withColumn("top", busiest).withColumn(
            "trend_score", F.expr("(200 * n + top) div (2 * top)")
        )
        return scaled.withColumns(brand_columns(F.col("k"))).select(
            "brand_name", "brand_type", "category",
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            "trend_score",
            F.lit(C.TRENDS_GEO).alias("geo"),
            self._loaded_at().alias("ingested_at"),
            (F.col("k") <= LISTED).alias("stock_available"),
        )

    @cached_property
    def trends_wide(self) -> DataFrame:
        """Interest per day with one column per event type."""
        kinds = ["click", "error", "purchase", "signup", "view"]
        counts = self._events.groupBy("date").pivot("event_type", kinds).agg(F.count("event_id"))
        return counts.withColumn("isPartial", F.lit(False))

    TERMS = ("click", "error", "purchase", "signup", "view", "absent")

    @cached_property
    def brand_terms(self) -> DataFrame:
        """The brand of every event type: the one whose number is the length of its name."""
        terms = self._events.select(F.col("event_type").alias("search_term")).distinct()
        return terms.withColumns(brand_columns(F.length("search_term") % BRANDS + 1))

    # --- silver and gold ---

    @cached_property
    def news_silver(self) -> DataFrame:
        """Headlines here are whole documents, so they are scored before anything is shuffled."""
        return news_silver(self.news_bronze, AS_OF, self.lexicon, stage=stage("news-daily"), long_texts=True)

    @cached_property
    def stocks_silver(self) -> DataFrame:
        return stocks_silver(self.stocks_bronze, AS_OF)

    @cached_property
    def trends_silver(self) -> DataFrame:
        return trends_silver(self.trends_bronze, AS_OF)

    @cached_property
    def gold_days(self) -> DataFrame:
        """This and last week's gold rows from one pass over each silver table; written, as the comparison reads both."""
        return stage("gold-days")(current_on(self.news_silver, self.trends_silver, self.stocks_silver, [LAST_WEEK, AS_OF]))

    @property
    def today(self) -> DataFrame:
        return self.gold_days.where(F.col("processed_date") == F.lit(AS_OF).cast("date"))

    @cached_property
    def history(self) -> DataFrame:
        """Last week's comparison columns, from the gold rows of that day."""
        return last_week(self.gold_days, LAST_WEEK)

    @cached_property
    def gold(self) -> DataFrame:
        return week_over_week(self.today, self.history).select(*schemas.BRAND_HEALTH.fieldNames())
