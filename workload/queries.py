"""One query per operator: each takes the input tables and returns a lazy result.

Means over many rows are rounded, because the last digits of a floating-point sum
depend on the order in which tasks finish.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import text as X
from signalmart.operators import landing as L
from signalmart.operators import voice
from signalmart.operators.context import Rules
from signalmart.operators.context import sentiment_in_context as in_context
from signalmart.operators.counting import Counts
from signalmart.operators.moments import merged, moments, zscore_from
from signalmart.operators.rows import last_n
from signalmart.operators.sentiment import scorer
from signalmart.plans import gold as G
from signalmart.plans import jobs, sql
from signalmart.plans import news as N
from signalmart.plans import reports as R
from signalmart.plans import stocks as S
from signalmart.plans import trends as T
from signalmart.sources import bronze, gold as gold_tables, silver
from signalmart.sources.catalog import Catalog
from signalmart.sources.seen import SeenKeys
from signalmart.sources.shared import shared_folder, stage
from signalmart.sources.state import DayState
from workload.inputs import AS_OF, LAST_WEEK, LEXICON, LOADED_AT, Inputs

SCAN_DAY = "2024-01-15"

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, column: str = "avg_daily_sentiment") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


# --- landing ----------------------------------------------------------------------

@query
def brand_dim(i: Inputs) -> DataFrame:
    """The dimension as a caller gives it, row by row: one per brand of ``part``."""
    known = i.brands.select(*schemas.BRANDS.fieldNames()).collect()
    return L.search_terms(L.brand_dim(i.spark, map(tuple, known))).select(
        "brand_name", "category", "brand_type", "ticker", "exchange", "term_pos", "search_term"
    )


@query
def shape_news(i: Inputs) -> DataFrame:
    return L.shape_news(i.payloads, i.brands, LOADED_AT)


def _landed_news(i: Inputs) -> tuple[str, DataFrame]:
    root = shared_folder(i.spark, "bronze")
    return root, jobs.land_news(i.payloads_of_both, i.brands, root, AS_OF, LOADED_AT)


@query
def land_news(i: Inputs) -> DataFrame:
    """Both sources' responses to landed records, in one call; the records as read back."""
    root, _ = _landed_news(i)
    return bronze.read_bronze(i.spark, root, "news", AS_OF)


@query
def land_news_summary(i: Inputs) -> DataFrame:
    return _landed_news(i)[1]


@query
def news_drop_removed(i: Inputs) -> DataFrame:
    kept = L.drop_removed(L.explode_articles(i.payloads))
    return kept.select("brand_name", "search_term", "term_pos", "article_pos", "headline", "url")


@query
def article_id(i: Inputs) -> DataFrame:
    return i.news_bronze.select(
        "url", "published_at", X.article_id(F.col("url"), F.col("published_at")).alias("article_id")
    )


@query
def article_id_uniqueness(i: Inputs) -> DataFrame:
    ids = i.news_bronze.select("brand_name", X.article_id(F.col("url"), F.col("published_at")).alias("article_id"))
    return ids.groupBy("brand_name").agg(
        F.count("*").alias("n_articles"), F.countDistinct("article_id").alias("n_ids")
    )


@query
def news_dedup_first(i: Inputs) -> DataFrame:
    unique = L.dedupe_first_seen(L.drop_removed(L.explode_articles(i.payloads)))
    return unique.select("brand_name", "url", "search_term", "term_pos", "article_pos", "headline")


@query
def source_fallback(i: Inputs) -> DataFrame:
    answers = i.payloads.withColumn("n_articles", F.size("articles"))
    primary = L.ok_articles(answers).withColumn("origin", F.lit("primary"))
    secondary = answers.withColumn("origin", F.lit("secondary"))
    chosen = L.with_fallback(primary, secondary, ["brand_name", "search_term"], responded=answers)
    return chosen.select("brand_name", "search_term", "term_pos", "n_articles", "origin")


@query
def news_top_n_per_term(i: Inputs) -> DataFrame:
    return L.top_articles(L.explode_articles(i.payloads)).select(
        "brand_name", "search_term", "term_pos", "article_pos", "published_at", "headline"
    )


@query
def ohlc_shape(i: Inputs) -> DataFrame:
    return L.shape_ohlc(i.ohlc_raw)


@query
def last_n_bars(i: Inputs) -> DataFrame:
    bars = S.clean(i.stocks_bronze, ["close_price", "volume"]).drop("ingested_at")
    return last_n(bars, ["ticker"], "date", C.LAST_BARS)


@query
def trends_unpivot(i: Inputs) -> DataFrame:
    return L.unpivot_terms(i.trends_wide, i.TERMS)


@query
def trends_term_join(i: Inputs) -> DataFrame:
    return L.name_terms(L.unpivot_terms(i.trends_wide, i.TERMS), i.brand_terms)


@query
def lineage_columns(i: Inputs) -> DataFrame:
    return L.lineage_columns(
        i.trends_bronze.select("brand_name", "date", "trend_score"), C.TRENDS_SOURCE, LOADED_AT,
        timeframe=C.TRENDS_TIMEFRAME, geo=C.TRENDS_GEO,
    )


UNIT = ["brand_name", "search_term", "published_at"]


@query
def ingest_skip_existing(i: Inputs) -> DataFrame:
    landed = i.news_bronze.where(F.col("lang") != C.NEWS_LANGUAGE)
    return L.skip_existing(i.news_bronze, landed, UNIT).select(*UNIT, "url", "lang")


@query
def ingest_summary(i: Inputs) -> DataFrame:
    landed = i.news_bronze.where(F.col("lang") == C.NEWS_LANGUAGE)
    skipped = i.news_bronze.where(F.col("headline").isNull())
    return L.ingest_summary(i.brands, landed, ["category", "brand_name"], skipped)


# --- sources and sinks ------------------------------------------------------------

def _landed(i: Inputs, source: str, rows: DataFrame) -> str:
    root = shared_folder(i.spark, "bronze")
    bronze.write_bronze(rows, root, source)
    return root


@query
def scan_news_day(i: Inputs) -> DataFrame:
    root = _landed(i, "news", i.news_bronze.drop("lang"))
    day = bronze.read_bronze(i.spark, root, "news", SCAN_DAY)
    return day.select("brand_name", "brand_type", "category", "headline", "url", "published_at", "ingested_at")


@query
def scan_stocks_day(i: Inputs) -> DataFrame:
    root = _landed(i, "stocks", i.stocks_bronze)
    day = bronze.read_bronze(i.spark, root, "stocks", SCAN_DAY)
    return day.select("brand_name", "category", "ticker", "date", "close_price", "volume", "stock_available")


@query
def scan_trends_day(i: Inputs) -> DataFrame:
    root = _landed(i, "trends", i.trends_bronze)
    day = bronze.read_bronze(i.spark, root, "trends", SCAN_DAY)
    return day.select("brand_name", "category", "date", "trend_score", "geo", "stock_available")


@query
def landed_units(i: Inputs) -> DataFrame:
    """Units that have landed: one without records leaves no folder and is tried again."""
    root = shared_folder(i.spark, "bronze")
    jobs.land(i.trends_bronze.where("category <> 'C0'"), i.brands, root, "trends", SCAN_DAY)
    return bronze.landed_units(i.spark, root, "trends", SCAN_DAY)


@query
def scan_sound(i: Inputs) -> DataFrame:
    """Sound and damaged records of a table in which files with broken records lie, one for every line of the documents."""
    root = _landed(i, "trends", i.trends_bronze)
    line = F.explode(F.split("text", "\n"))
    broken = i.table("documents").select(line.alias("line")).select(F.concat(F.lit('{"brand_name": "'), F.md5("line")).alias("value"))
    day = SCAN_DAY.split("-")
    broken.write.mode("append").text(f"{root}/trends/category=C1/year={day[0]}/month={day[1]}/day={day[2]}")
    sound, damaged = bronze.read_sound(i.spark, root, "trends")
    kinds = [df.groupBy("brand_name").agg(F.count("*").alias("n_records")).withColumn("kind", F.lit(kind)) for kind, df in (
        ("sound", sound), ("damaged", damaged.withColumn("brand_name", F.lit(None).cast("string"))))]
    return kinds[0].unionByName(kinds[1])


@query
def bronze_roundtrip(i: Inputs) -> DataFrame:
    root = _landed(i, "trends", i.trends_bronze)
    return bronze.read_bronze(i.spark, root, "trends").select(*i.trends_bronze.columns)


@query
def silver_roundtrip(i: Inputs) -> DataFrame:
    """A repeated run replaces its own partitions."""
    root = shared_folder(i.spark, "silver")
    for _ in range(2):
        silver.write_silver(i.trends_silver, root, "trends", AS_OF)
    return silver.read_silver(i.spark, root, "trends").drop("ingested_at")


@query
def silver_rerun_corrected(i: Inputs) -> DataFrame:
    """A second run of the day without the private brands leaves nothing of them."""
    root = shared_folder(i.spark, "silver")
    for rows in (i.trends_silver, i.trends_silver.where("brand_type = 'listed'")):
        silver.write_silver(rows, root, "trends", AS_OF)
    return silver.read_silver(i.spark, root, "trends", AS_OF).select("brand_name", "category", "trend_date", "trend_score")


@query
def silver_scan_by_ingestion(i: Inputs) -> DataFrame:
    """One day of a table that holds every day."""
    root = shared_folder(i.spark, "silver")
    silver.write_silver_days(i.trends_silver.withColumn("ingestion_date", F.col("trend_date")), root, "trends")
    return silver.read_silver(i.spark, root, "trends", SCAN_DAY).select(*SCANNED)


SCANNED = ["brand_name", "category", "trend_date", "trend_score", "trend_zscore", "ingestion_date"]


def _catalog(i: Inputs) -> Catalog:
    """Tables of their own, in the shared folder."""
    catalog = Catalog(location=shared_folder(i.spark, "catalog"), prefix=f"t{uuid.uuid4().hex}_")
    catalog.create(i.spark)
    return catalog


@query
def silver_catalog_scan(i: Inputs) -> DataFrame:
    """The same from a catalog table, with the day as a predicate on its partitions."""
    catalog = _catalog(i)
    silver.write_silver_days(i.trends_silver.withColumn("ingestion_date", F.col("trend_date")), catalog, "trends")
    return silver.read_silver(i.spark, catalog, "trends", SCAN_DAY).select(*SCANNED)


@query
def silver_catalog_rerun(i: Inputs) -> DataFrame:
    """A corrected run replaces its day in the catalog, partitions without rows included, and leaves the other days."""
    catalog = _catalog(i)
    daily = stage("daily")(i.trends_silver.withColumn("ingestion_date", F.col("trend_date")))
    silver.write_silver_days(daily, catalog, "trends")
    again = daily.where((F.col("ingestion_date") == SCAN_DAY) & (F.col("brand_type") == "listed"))
    silver.write_silver(again, catalog, "trends", SCAN_DAY)
    return silver.read_silver(i.spark, catalog, "trends").select(*SCANNED)


@query
def history_catalog_scan(i: Inputs) -> DataFrame:
    """Last week's columns from a gold table of the catalog."""
    catalog = _catalog(i)
    for day in (LAST_WEEK, AS_OF):
        on = i.gold_days.where(F.col("processed_date") == F.lit(day).cast("date"))
        gold_tables.write_gold(G.week_over_week(on, None), catalog, day=day)
    return gold_tables.read_history(i.spark, catalog, AS_OF)


@query
def gold_roundtrip(i: Inputs) -> DataFrame:
    """Repeating a day's write replaces that day."""
    path = shared_folder(i.spark, "gold")
    gold = stage("gold")(i.gold)
    for _ in range(2):
        gold_tables.write_gold(gold, path)
    return rounded(gold_tables.read_gold(i.spark, path, AS_OF))


@query
def history_scan(i: Inputs) -> DataFrame:
    path = shared_folder(i.spark, "gold")
    gold_tables.write_gold(G.week_over_week(i.gold_days, None), path)
    return gold_tables.read_history(i.spark, path, AS_OF)


@query
def stage_counts(i: Inputs) -> DataFrame:
    """Rows at six places, from the one run that builds all three sources."""
    counts = Counts()
    ends = [
        counts.at(N.clean(counts.at(i.news_bronze, "news_bronze"), []), "news_clean"),
        counts.at(S.stocks_silver(counts.at(i.stocks_bronze, "stocks_bronze"), AS_OF), "stocks_silver"),
        counts.at(T.trends_silver(counts.at(i.trends_bronze, "trends_bronze"), AS_OF), "trends_silver"),
    ]
    together = reduce(DataFrame.unionByName, [end.select("brand_name") for end in ends])
    together.write.format("noop").mode("overwrite").save()
    return counts.table(i.spark)


# --- from the state of earlier days ----------------------------------------------------

# The days up to which the generated history lands, in three runs.
CUTS = ("2024-01-11", "2024-01-21")
RUNS = ("2024-01-10", "2024-01-20", AS_OF)


def _runs(df: DataFrame, day: str) -> list[tuple[str, DataFrame]]:
    """The rows of each run."""
    at = F.substring(F.col(day).cast("string"), 1, 10)
    parts = [at < CUTS[0], (at >= CUTS[0]) & (at < CUTS[1]), at >= CUTS[1]]
    return [(label, df.where(part)) for label, part in zip(RUNS, parts)]


def _state(i: Inputs) -> DayState:
    return DayState(i.spark, shared_folder(i.spark, "state"))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query
def news_seen_days(i: Inputs) -> DataFrame:
    """Articles that land again on later days are dropped: each run asks what the runs before have seen."""
    seen = SeenKeys(i.spark, f"default.seen_{uuid.uuid4().hex}", tuple(N.ARTICLE_KEYS), 1_000_000, shared_folder(i.spark, "seen")).create()
    fresh = []
    for label, rows in _runs(i.news_bronze, "ingested_at"):
        fresh.append(stage("fresh")(seen.unseen(N.clean(rows, ["news_date"]), label)))
        seen.add(fresh[-1], label)
    return _together(fresh).select("brand_name", "url", "news_date", "ingested_at")


@query
def trend_zscore_state(i: Inputs) -> DataFrame:
    """Z-scores from the merged moments of the runs, two of them compacted, in place of the history."""
    state, scores = _state(i), stage("scores")(T.clean(i.trends_bronze, ["trend_score"]).withColumn("trend_date", F.col("date")))
    for label, rows in _runs(scores, "date"):
        state.compact("moments", label, jobs.MOMENTS, ["brand_name"])
        state.write(moments(rows, ["brand_name"], "trend_score"), "moments", label)
    whole = merged(state.before("moments", "9999", jobs.MOMENTS), ["brand_name"], "state_day")
    return zscore_from(scores, whole, "trend_score", ["brand_name"], "trend_zscore").select("brand_name", "trend_date", "trend_zscore")


@query
def stocks_silver_from_state(i: Inputs) -> DataFrame:
    """Each run goes on from the bars the run before has left."""
    state, built = _state(i), []
    for label, rows in _runs(i.stocks_bronze, "date"):
        tail = state.latest("tail", label, jobs.STOCKS_TAIL)
        built.append(S.stocks_silver(rows, AS_OF, tail=tail))
        state.write(S.tail_of(rows, tail).select(*jobs.STOCKS_TAIL.fieldNames()), "tail", label)
    return _together(built)


@query
def news_velocity_from_state(i: Inputs) -> DataFrame:
    state, built = _state(i), []
    per_day = stage("news-daily")(N.per_day_of(i.news_bronze, i.lexicon, long_texts=True).where("news_date is not null"))
    for label, rows in _runs(per_day, "news_date"):
        tail = state.latest("tail", label, jobs.NEWS_TAIL)
        built.append(N.signals(rows, tail=tail))
        state.write(N.tail_of(rows, tail), "tail", label)
    return _together(built).select("brand_name", "news_date", "daily_article_count", "rolling_7d_avg", "news_velocity")


@query
def lowercase_columns(i: Inputs) -> DataFrame:
    upper = i.trends_bronze.select(
        F.col("brand_name").alias("BRAND_NAME"), F.col("date").alias("Date"), F.col("trend_score").alias("TREND_Score")
    )
    return gold_tables.lowercase_columns(upper)


# --- silver news ------------------------------------------------------------------

@query
def news_standardize(i: Inputs) -> DataFrame:
    return N.standardize(i.news_bronze)


@query
def news_filter_nulls(i: Inputs) -> DataFrame:
    return N.drop_incomplete(N.standardize(i.news_bronze)).select("brand_name", "url", "headline", "published_at")


@query
def news_dedup(i: Inputs) -> DataFrame:
    return N.clean(i.news_bronze, ["source_name", "news_date"])


def _scored(i: Inputs) -> DataFrame:
    return N.score(N.clean(i.news_bronze, N.SCORED_COLUMNS), i.lexicon)


@query
def news_dedup_ties(i: Inputs) -> DataFrame:
    """Many texts of a url loaded at the same time: the kept one does not depend on the columns asked for."""
    return N.clean(i.news_tied, ["source_name", "headline", "ingested_at"]).select(
        "brand_name", "url", "source_name", "headline", "ingested_at")


@query
def news_scores_ties(i: Inputs) -> DataFrame:
    scored = N.score(N.clean(i.news_tied, N.SCORED_COLUMNS), i.lexicon)
    return rounded(scored.select("brand_name", "url", "sentiment_score"), "sentiment_score")


@query
def news_scores_ties_long(i: Inputs) -> DataFrame:
    """The same in the other order of work."""
    return rounded(N.score_before_dedupe(i.news_tied, i.lexicon).select("brand_name", "url", "sentiment_score"), "sentiment_score")


@query
def sentiment_before_dedupe(i: Inputs) -> DataFrame:
    scored = N.score_before_dedupe(i.news_bronze, i.lexicon)
    return rounded(scored.select("brand_name", "url", "news_date", "sentiment_score"), "sentiment_score")


@query
def sentiment_lexicon(i: Inputs) -> DataFrame:
    return rounded(_scored(i).select("brand_name", "url", "sentiment_score"), "sentiment_score")


def _word_scores() -> Callable[[str], float]:
    """A scorer as a user may bring one: plain Python, built once a worker."""
    valences, words = dict(LEXICON), re.compile("[a-z]+")

    def score(text: str) -> float:
        total = sum(valences.get(word, 0.0) for word in words.findall(text.lower()))
        return total / (total * total + C.COMPOUND_ALPHA) ** 0.5

    return score


@query
def sentiment_scorer(i: Inputs) -> DataFrame:
    """A plugged-in scorer in place of the lexicon's join."""
    scored = N.score(N.clean(i.news_bronze, N.SCORED_COLUMNS), None, scorer(_word_scores))
    return rounded(scored.select("brand_name", "url", "sentiment_score"), "sentiment_score")


# Words of the generated texts in the roles of the rules.
CONTEXT = Rules(negations=("in", "für", "les"), boosters={"to": 0.293, "for": 0.293, "a": -0.293, "was": -0.293})


@query
def sentiment_in_context(i: Inputs) -> DataFrame:
    """Negation, boosters and capitals among the three words before a word."""
    articles = N.clean(i.news_bronze, ["headline"])
    scored = in_context(articles, "headline", i.lexicon, N.ARTICLE_KEYS, rules=CONTEXT)
    return rounded(scored.select("brand_name", "url", "sentiment_score"), "sentiment_score")


@query
def sentiment_label(i: Inputs) -> DataFrame:
    return _scored(i).select("brand_name", "url", "sentiment_label")


@query
def news_daily_agg(i: Inputs) -> DataFrame:
    return rounded(N.daily(_scored(i)))


@query
def news_share_per_week(i: Inputs) -> DataFrame:
    """Share of voice with the ISO year in the week key, per brand and week."""
    days = N.clean(i.news_bronze, ["category", "news_date"]).groupBy("brand_name", "category", X.iso_year_week(F.col("news_date")).alias("week"))
    return voice.share_of_voice(days.agg(F.count("*").alias("n")), ["brand_name"], ["category", "week"], "n")


@query
def share_of_voice(i: Inputs) -> DataFrame:
    return i.news_silver.select("brand_name", "category", "brand_type", "news_date", "share_of_voice_pct")


@query
def news_velocity(i: Inputs) -> DataFrame:
    return i.news_silver.select(
        "brand_name", "news_date", "daily_article_count", "rolling_7d_avg", "news_velocity"
    )


@query
def coverage_trend(i: Inputs) -> DataFrame:
    return i.news_silver.select("brand_name", "news_date", "coverage_trend")


@query
def news_silver_split(i: Inputs) -> DataFrame:
    """The same with every series cut into the thirds of the month, de-duplicating first, without a written table."""
    thirds = N.news_silver(
        i.news_bronze, AS_OF, i.lexicon, split=lambda day: F.substring(day.cast("string"), 1, 9)
    )
    return rounded(thirds)


@query
def news_silver(i: Inputs) -> DataFrame:
    return rounded(i.news_silver)


# --- silver stocks ----------------------------------------------------------------

@query
def stocks_filter_price(i: Inputs) -> DataFrame:
    return S.drop_unpriced(i.stocks_bronze).select("ticker", "date", "ingested_at", "close_price")


@query
def stocks_dedup(i: Inputs) -> DataFrame:
    return S.clean(i.stocks_bronze, ["close_price"])


def _bars(i: Inputs) -> DataFrame:
    return S.clean(i.stocks_bronze, S.BAR_COLUMNS).withColumn("stock_date", F.col("date"))


@query
def stock_returns(i: Inputs) -> DataFrame:
    return S.returns(_bars(i)).select("ticker", "stock_date", "close_price", "daily_change_pct")


@query
def stock_volatility(i: Inputs) -> DataFrame:
    return i.stocks_silver.select("ticker", "stock_date", "volatility_7d")


@query
def stock_volatility_days(i: Inputs) -> DataFrame:
    """Volatility over seven calendar days in place of seven rows."""
    bars = S.volatility(S.returns(_bars(i)), "days")
    return bars.select("ticker", "stock_date", "volatility_7d")


@query
def price_signal(i: Inputs) -> DataFrame:
    return i.stocks_silver.select("ticker", "stock_date", "price_signal")


@query
def stocks_silver(i: Inputs) -> DataFrame:
    return i.stocks_silver


@query
def stocks_silver_lineitem(i: Inputs) -> DataFrame:
    return S.stocks_silver(i.lineitem_bars, AS_OF)


@query
def stocks_silver_split(i: Inputs) -> DataFrame:
    """The same with every series cut by year."""
    return S.stocks_silver(i.lineitem_bars, AS_OF, split=X.year_of)


# --- silver trends ----------------------------------------------------------------

@query
def trends_filter_nulls(i: Inputs) -> DataFrame:
    return T.drop_incomplete(i.trends_bronze).select("brand_name", "date", "ingested_at", "trend_score")


@query
def trends_dedup(i: Inputs) -> DataFrame:
    return T.clean(i.trends_bronze, ["trend_score"])


@query
def trend_momentum(i: Inputs) -> DataFrame:
    scores = T.clean(i.trends_bronze, ["trend_score"]).withColumn("trend_date", F.col("date"))
    return T.momentum(scores).select("brand_name", "trend_date", "trend_score", "trend_momentum")


@query
def trend_zscore(i: Inputs) -> DataFrame:
    return i.trends_silver.select("brand_name", "trend_date", "trend_zscore")


@query
def trend_anomaly(i: Inputs) -> DataFrame:
    """Which brands are unusual on which day?"""
    return i.trends_silver.where("is_anomaly").select("brand_name", "trend_date", "trend_score", "trend_zscore")


@query
def trends_silver(i: Inputs) -> DataFrame:
    return i.trends_silver


@query
def trends_silver_split(i: Inputs) -> DataFrame:
    """The same with every series cut into the thirds of the month."""
    return T.trends_silver(i.trends_bronze, AS_OF, split=lambda day: F.substring(day, 1, 9))


# --- gold -------------------------------------------------------------------------

def _joined(i: Inputs) -> DataFrame:
    """The three silver tables joined; each is read once, so none needs to be written first."""
    return G.join_sources(i.news_silver, i.trends_silver, i.stocks_silver, AS_OF)


@query
def gold_join(i: Inputs) -> DataFrame:
    return rounded(_joined(i))


@query
def gold_join_fanout(i: Inputs) -> DataFrame:
    """How many rows the join on brand keys alone has per brand."""
    return G.join_size(i.news_silver, i.trends_silver, i.stocks_silver)


@query
def normalize_signals(i: Inputs) -> DataFrame:
    return G.normalize(_joined(i)).select(
        "brand_name", "sentiment_normalized", "trend_normalized", "stock_normalized", "stock_available"
    )


@query
def health_index(i: Inputs) -> DataFrame:
    return G.health(G.normalize(_joined(i))).select("brand_name", "brand_health_index")


@query
def health_label(i: Inputs) -> DataFrame:
    return G.health(G.normalize(_joined(i))).select("brand_name", "health_label")


@query
def alerts(i: Inputs) -> DataFrame:
    return G.alerts(_joined(i)).select("brand_name", "is_anomaly", "coverage_trend", "alert_flag", "alert_reason")


@query
def gold_wow(i: Inputs) -> DataFrame:
    return i.gold.select("brand_name", *G.WOW_COLUMNS)


@query
def gold_wow_first_run(i: Inputs) -> DataFrame:
    """With a history that has no rows for the day, as on a first run."""
    first = G.week_over_week(i.today, i.history.where("false"))
    return first.select("brand_name", "brand_health_index", *G.WOW_COLUMNS)


@query
def gold_brand_health(i: Inputs) -> DataFrame:
    return rounded(i.gold)


@query
def gold_days(i: Inputs) -> DataFrame:
    """Two processed dates with their comparison, from one pass over each silver table."""
    rows = G.week_over_week_on(i.gold_days, i.gold_days)
    return rounded(rows.select(*schemas.BRAND_HEALTH.fieldNames()))


@query
def health_sql(i: Inputs) -> DataFrame:
    """The index by the functions for SQL users."""
    sql.register(i.spark, "health_")
    normal = i.spark.sql("""
        SELECT *, health_sentiment_normalized(avg_daily_sentiment) AS sentiment_normalized, health_trend_normalized(trend_score) AS trend_normalized,
            health_stock_normalized(stock_available, daily_change_pct) AS stock_normalized,
            health_alert_flag(avg_daily_sentiment, is_anomaly, coverage_trend) AS alert_flag,
            health_alert_reason(avg_daily_sentiment, is_anomaly, coverage_trend) AS alert_reason FROM {joined}""", joined=_joined(i))
    return i.spark.sql("""
        SELECT *, health_health_label(brand_health_index) AS health_label FROM (
            SELECT brand_name, sentiment_normalized, trend_normalized, stock_normalized, alert_flag, alert_reason, health_health_index(
                stock_available, sentiment_normalized, trend_normalized, stock_normalized, share_of_voice_pct) AS brand_health_index
            FROM {normal})""", normal=normal)


@query
def gold_preview(i: Inputs) -> DataFrame:
    return R.preview(i.gold)


@query
def q1_leaderboard(i: Inputs) -> DataFrame:
    return R.leaderboard(i.gold, AS_OF)


@query
def q2_alerts(i: Inputs) -> DataFrame:
    return R.alert_list(i.gold, AS_OF)


@query
def q3_category(i: Inputs) -> DataFrame:
    return R.category_summary(i.gold, AS_OF)


@query
def q4_wow(i: Inputs) -> DataFrame:
    return R.week_over_week_report(i.gold, AS_OF)


@query
def q5_brand_type(i: Inputs) -> DataFrame:
    return R.brand_type_summary(i.gold, AS_OF)


def _as_sql(name: str, report: str) -> None:
    def run(i: Inputs) -> DataFrame:
        return sql.report(i.gold, report, AS_OF)

    run.__name__, run.__doc__ = f"{name}_sql", "The same as a statement with a parameter."
    query(run)


for _name, _report in (("q1_leaderboard", "leaderboard"), ("q2_alerts", "alert_list"), ("q3_category", "category_summary"),
                       ("q4_wow", "week_over_week_report"), ("q5_brand_type", "brand_type_summary")):
    _as_sql(_name, _report)
