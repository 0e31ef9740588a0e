"""Shaping landed raw payloads into bronze records.

The raw responses are tables or files; fetching them is not part of the library.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.brands import DEFAULT_BRANDS
from signalmart.functions import text as X
from signalmart.operators.rows import dedupe, first_n
from signalmart.operators.sizing import broadcast_if_small


# --- entity dimension -------------------------------------------------------------

def brand_dim(spark: SparkSession, rows: Iterable[tuple] = DEFAULT_BRANDS) -> DataFrame:
    """The entity dimension, one row per brand."""
    return spark.createDataFrame(list(rows), schemas.BRANDS)


def search_terms(brands: DataFrame) -> DataFrame:
    """One row per brand and news search term, with the term's position."""
    rest = [c for c in brands.columns if c != "search_terms"]
    return brands.select(*rest, F.posexplode("search_terms").alias("term_pos", "search_term"))


# --- lineage ----------------------------------------------------------------------

def lineage_columns(
    df: DataFrame, source: str, ingested_at: Column | str, layer: str = C.BRONZE_LAYER, **extra: str
) -> DataFrame:
    """Add source, layer and load time; the load time is a parameter, never the wall clock."""
    moment = F.lit(ingested_at)
    literals = {"pipeline_source": source, "data_layer": layer, **extra}
    return df.withColumns({"ingested_at": moment} | {name: F.lit(value) for name, value in literals.items()})


# --- news -------------------------------------------------------------------------

def with_fallback(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str], responded: DataFrame | None = None
) -> DataFrame:
    """Primary rows, plus the secondary rows of the keys the primary has nothing for.

    Decide on unfiltered rows: a unit whose primary rows are all dropped later keeps them.
    With ``responded``, the primary responses of any status, a unit whose primary request
    failed altogether is left out instead of falling back.
    """
    keys = list(keys)
    substitutes = secondary.join(primary.select(*keys).distinct(), keys, "left_anti")
    if responded is not None:
        substitutes = substitutes.join(responded.select(*keys).distinct(), keys, "left_semi")
    return primary.unionByName(substitutes)


def choose_source(payloads: DataFrame, keys: Sequence[str], origin: str = "origin") -> DataFrame:
    """Of primary and secondary responses in one table, those ``with_fallback`` takes.

    The decision is one conditional aggregate over the narrow columns: whether the unit's primary request was answered, and whether with
    articles.  Failed or empty primary responses go, and all secondary ones of units that need none.
    """
    keys = list(keys)
    primary = F.col(origin) == "primary"
    useful = primary & (F.col("status") == "ok") & (F.size("articles") > 0)
    narrow = payloads.select(*keys, primary.alias("_answered"), F.coalesce(useful, F.lit(False)).alias("_useful"))
    units = narrow.groupBy(*keys).agg(F.bool_or("_answered").alias("_answered"), F.bool_or("_useful").alias("_has"))
    wanted = units.where("_answered").select(*keys, F.when(F.col("_has"), "primary").otherwise("secondary").alias(origin))
    kept = payloads.join(broadcast_if_small(wanted), [*keys, origin])
    return kept.where((F.col(origin) == "secondary") | ((F.col("status") == "ok") & (F.size("articles") > 0)))


def ok_articles(payloads: DataFrame) -> DataFrame:
    """Payloads with status ok and at least one article."""
    return payloads.where((F.col("status") == "ok") & (F.size("articles") > 0))


def explode_articles(payloads: DataFrame) -> DataFrame:
    """One row per article of every payload, with the article's position.

    The ``coalesce`` keeps Spark from testing the array in a filter of its own, which would
    build an array that is computed rather than read several times over.
    """
    article = F.col("_article")
    rest = [c for c in payloads.columns if c not in ("articles", "status")]
    return payloads.select(*rest, F.posexplode(F.coalesce("articles", F.array())).alias("article_pos", "_article")).select(
        *rest,
        "article_pos",
        article["title"].alias("headline"),
        article["description"].alias("description"),
        article["source"]["name"].alias("source_name"),
        article["author"].alias("author"),
        article["url"].alias("url"),
        article["publishedAt"].alias("published_at"),
    )


def drop_removed(df: DataFrame, title: str = "headline") -> DataFrame:
    """Drop withdrawn articles and those without a title."""
    return df.where((F.col(title) != C.REMOVED_TITLE) & X.filled(F.col(title)))


def dedupe_first_seen(df: DataFrame, url: str = "url", brand: str = "brand_name") -> DataFrame:
    """Keep the article seen first per brand and url, by term and then article position."""
    return dedupe(df.where(X.filled(F.col(url))), [brand, url], ["term_pos", "article_pos"])


def top_articles(
    df: DataFrame, keys: Sequence[str] = ("brand_name", "search_term"), n: int = C.NEWS_PAGE_SIZE,
    language: str | None = C.NEWS_LANGUAGE, published: str = "published_at",
) -> DataFrame:
    """The newest ``n`` articles per brand and search term, in one language."""
    if language is not None:
        df = df.where(F.col("lang") == language)
    ties = [F.col(c) for c in df.columns if c != published and c not in keys]
    return first_n(df, keys, [F.desc_nulls_last(published), *ties], n)


def shape_news(payloads: DataFrame, brands: DataFrame, ingested_at: Column | str, per_term: int | None = None) -> DataFrame:
    """Bronze news records of all payloads: explode, drop withdrawn, dedupe, enrich.

    ``per_term`` keeps the newest so many articles of every brand and search term, withdrawn ones counted.
    """
    articles = explode_articles(payloads)
    if per_term is not None:
        articles = top_articles(articles, n=per_term, language=None)
    articles = dedupe_first_seen(drop_removed(articles))
    meta = broadcast_if_small(
        brands.select("brand_name", "brand_type", "category", F.col("news_ticker").alias("ticker"))
    )
    named = articles.join(meta, "brand_name").withColumn(
        "article_id", X.article_id(F.col("url"), F.col("published_at"))
    )
    return lineage_columns(named, C.NEWS_SOURCE, ingested_at).select(*schemas.NEWS_BRONZE.fieldNames())


# --- stocks -----------------------------------------------------------------------

def shape_ohlc(df: DataFrame) -> DataFrame:
    """Rounded prices, whole volume, intraday change in percent and price range of raw bars."""
    change = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(0.0)
    rest = [c for c in df.columns if c not in ("date", "open", "high", "low", "close", "volume")]
    return df.select(
        *rest,
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.round(p, 4).alias(f"{p}_price") for p in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
        F.round(change, 4).alias("daily_change_pct"),
        F.round(F.col("high") - F.col("low"), 4).alias("price_range"),
    )


def shape_stocks(bars: DataFrame, brands: DataFrame, ingested_at: Column | str) -> DataFrame:
    """Bronze stock records of raw bars keyed by ticker."""
    meta = broadcast_if_small(
        brands.where(F.col("ticker").isNotNull())
        .select("brand_name", "brand_type", "category", "ticker", "exchange")
    )
    named = shape_ohlc(bars).join(meta, "ticker").withColumn("stock_available", F.lit(True))
    return lineage_columns(named, C.STOCKS_SOURCE, ingested_at).select(*schemas.STOCKS_BRONZE.fieldNames())


# --- trends -----------------------------------------------------------------------

def unpivot_terms(wide: DataFrame, terms: Sequence[str], date: str = "date") -> DataFrame:
    """One row per date and term of a wide interest table; terms without a column are skipped."""
    present = [t for t in terms if t in wide.columns]
    scores = wide.select(F.col(date).alias("date"), *[F.col(f"`{t}`").cast("bigint").alias(t) for t in present])
    return scores.unpivot(["date"], [F.col(f"`{t}`") for t in present], "search_term", "trend_score")


def name_terms(df: DataFrame, brand_terms: DataFrame) -> DataFrame:
    """Look up the brand of each search term and whether it has a share price."""
    meta = brand_terms.select("search_term", "brand_name", "brand_type", "category")
    return df.join(broadcast_if_small(meta), "search_term").withColumn(
        "stock_available", F.col("brand_type") == "listed"
    )


def shape_trends(wide: DataFrame, brands: DataFrame, ingested_at: Column | str, terms: Sequence[str]) -> DataFrame:
    """Bronze trend records of a wide interest table with one column per term."""
    brand_terms = brands.withColumn("search_term", F.col("trend_term"))
    named = name_terms(unpivot_terms(wide, terms), brand_terms).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd")
    )
    landed = lineage_columns(
        named, C.TRENDS_SOURCE, ingested_at, timeframe=C.TRENDS_TIMEFRAME, geo=C.TRENDS_GEO
    )
    return landed.select(*schemas.TRENDS_BRONZE.fieldNames())


# --- idempotent landing -----------------------------------------------------------

def skip_existing(incoming: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows of units that have not landed yet."""
    return incoming.join(landed.select(*keys).distinct(), list(keys), "left_anti")


def ingest_summary(
    units: DataFrame, landed: DataFrame, keys: Sequence[str], skipped: DataFrame | None = None
) -> DataFrame:
    """Records per unit, zero included, with a skipped flag, and a total row with null keys."""
    keys = list(keys)
    counts = landed.groupBy(*keys).agg(F.count("*").alias("records"))
    summary = units.select(*keys).distinct().join(counts, keys, "left")
    if skipped is None:
        summary = summary.withColumn("skipped", F.lit(False))
    else:
        flag = skipped.select(*keys).distinct().withColumn("skipped", F.lit(True))
        summary = summary.join(flag, keys, "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    columns = [F.col(k) for k in keys]
    return summary.groupingSets([columns, []], *columns).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.bool_or("skipped"), F.lit(False)).alias("skipped"),
    )
