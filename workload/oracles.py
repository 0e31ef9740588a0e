"""SQL with the same results as the queries, for DuckDB over the generated tables.

Written from the definition of each signal, on purpose in another shape than the Spark
plans: share of voice counts raw articles in two windows, the rows to keep come from
``row_number``, the size of the fan-out from the join itself.
"""

from __future__ import annotations

import re

from workload.inputs import AS_OF, BRANDS, LAST_WEEK, LEXICON, LISTED, LOADED_AT
from workload.queries import SCAN_DAY


def rnd(value: str, scale: int) -> str:
    """Round half up on the decimal text of a double, as Spark does."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {scale}) AS DOUBLE)"


def brand(k: str) -> str:
    return (
        f"'Brand#' || {k} AS brand_name, 'C' || ({k} % 3) AS category, "
        f"CASE WHEN {k} <= {LISTED} THEN 'listed' ELSE 'private' END AS brand_type"
    )


HASHED_BRAND = f"CAST('0x' || left(md5(text), 8) AS BIGINT) % {BRANDS} + 1"
DOC_DAY = "DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER)"
DAY_TEXT = "strftime(date, '%Y-%m-%d')"
LOADED_HALF = f"{DAY_TEXT} || 'T' || CASE half WHEN 1 THEN '11' ELSE '22' END"

# Every value with its length, nulls as a dash.
TIE = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("category", "brand_type", "ticker", "source_name", "headline"))

VIEWS: dict[str, str] = {
    "brands": f"""
        SELECT {brand('k')}, CASE WHEN k <= {LISTED} THEN 'T' || k END AS ticker,
               CASE WHEN k <= {LISTED} THEN CASE WHEN k % 2 = 0 THEN 'NYSE' ELSE 'NSE' END END AS exchange, search_terms
        FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k,
                     list_sort(list(DISTINCT p_brand || ' ' || p_type)) AS search_terms FROM part GROUP BY p_brand)""",
    "lexicon": "SELECT term, CAST(valence AS DOUBLE) AS valence FROM (VALUES "
               + ", ".join(f"('{t}', {v})" for t, v in LEXICON) + ") v(term, valence)",
    "news_bronze": f"""
        SELECT {brand('k')}, CASE WHEN k <= {LISTED} THEN 'T' || k END AS ticker, source AS search_term,
               CASE WHEN trim(text) <> '' THEN text END AS headline, source AS source_name, 'u' || md5(text) AS url,
               CASE WHEN contains(text, '###') THEN 'unknown'
                    ELSE strftime({DOC_DAY}, '%Y-%m-%d') || 'T12:00:00Z' END AS published_at,
               strftime({DOC_DAY}, '%Y-%m-%d') || 'T' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS ingested_at, lang
        FROM (SELECT *, {HASHED_BRAND} AS k FROM documents)""",
    "lines": f"""
        SELECT 'Brand#' || ({HASHED_BRAND}) AS brand_name, source AS search_term, doc_id AS term_pos, lang,
               strftime({DOC_DAY}, '%Y-%m-%d') || 'T12:00:00Z' AS published_at,
               unnest(string_split(text, chr(10))) AS line,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS article_pos
        FROM documents""",
    "articles": """
        SELECT brand_name, search_term, term_pos, lang, article_pos, published_at, search_term AS source_name,
               CASE WHEN right(md5(line), 1) = '7' THEN '[Removed]' ELSE line END AS headline,
               'u' || md5(line) AS url FROM lines""",
    "titled": "SELECT * FROM articles WHERE headline <> '[Removed]' AND headline IS NOT NULL AND headline <> ''",
    "first_seen": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, url
               ORDER BY term_pos, article_pos) AS rn FROM titled WHERE url IS NOT NULL AND url <> '') WHERE rn = 1""",
    "landed_news": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, url ORDER BY term_pos, article_pos) AS nth FROM (
            SELECT *, row_number() OVER (PARTITION BY brand_name, search_term ORDER BY published_at DESC, term_pos, article_pos) AS rn
            FROM articles a WHERE lang = 'en' OR NOT EXISTS (
                SELECT 1 FROM documents d WHERE d.lang = 'en' AND d.source = a.search_term
                AND 'Brand#' || (CAST('0x' || left(md5(d.text), 8) AS BIGINT) % {BRANDS} + 1) = a.brand_name))
            WHERE rn <= 20 AND headline <> '[Removed]' AND headline <> '') WHERE nth = 1""",
    "tagged_events": f"""
        SELECT *, user_id % {BRANDS} + 1 AS k, CAST(ts AS DATE) AS date,
               CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS half FROM events""",
    "ohlc_raw": f"""
        SELECT {brand('k')}, 'T' || k AS ticker, CASE WHEN k % 2 = 0 THEN 'NYSE' ELSE 'NSE' END AS exchange,
               {LOADED_HALF} AS ingested_at, * EXCLUDE (k)
        FROM (SELECT k, date, half, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
                     arg_max(value, event_id) AS close, count(*) AS volume
              FROM tagged_events WHERE k <= {LISTED} GROUP BY k, date, half)""",
    "stocks_bronze": f"""
        SELECT brand_name, brand_type, category, ticker, exchange, ingested_at, {DAY_TEXT} AS date,
               {rnd('open', 4)} AS open_price, {rnd('high', 4)} AS high_price, {rnd('low', 4)} AS low_price,
               {rnd('close', 4)} AS close_price, volume,
               CASE WHEN open > 0 THEN {rnd('(close - open) / open * 100', 4)} ELSE 0.0::DOUBLE END AS daily_change_pct,
               {rnd('high - low', 4)} AS price_range, TRUE AS stock_available FROM ohlc_raw""",
    "lineitem_bars": f"""
        SELECT {brand('k')}, 'Brand#' || k AS ticker, 'NYSE' AS exchange, '{LOADED_AT}' AS ingested_at,
               {DAY_TEXT} AS date, {rnd('open', 4)} AS open_price, {rnd('high', 4)} AS high_price,
               {rnd('low', 4)} AS low_price, {rnd('close', 4)} AS close_price, CAST(volume AS BIGINT) AS volume
        FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k, CAST(l_shipdate AS DATE) AS date,
                     first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
                     max(l_extendedprice) AS high, min(l_extendedprice) AS low,
                     last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
                     sum(l_quantity) AS volume
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "trends_bronze": f"""
        SELECT {brand('k')}, {DAY_TEXT} AS date,
               CAST((200 * n + max(n) OVER ()) // (2 * max(n) OVER ()) AS BIGINT) AS trend_score, 'IN' AS geo,
               {LOADED_HALF} AS ingested_at, k <= {LISTED} AS stock_available
        FROM (SELECT k, date, half, count(*) AS n FROM tagged_events GROUP BY k, date, half)""",
    "interest": """
        SELECT date, event_type AS search_term, count(*) AS trend_score FROM tagged_events GROUP BY 1, 2""",
    "news_standard": f"""
        SELECT brand_name, brand_type, category, ticker, headline, source_name, published_at, url, ingested_at,
               TRY_CAST(left(published_at, 10) AS DATE) AS news_date, 'newsapi' AS data_source FROM news_bronze""",
    "news_complete": """
        SELECT * FROM news_standard WHERE headline IS NOT NULL AND brand_name IS NOT NULL AND url IS NOT NULL""",
    "news_clean": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url, brand_name
        ORDER BY ingested_at, published_at) AS rn FROM news_complete) WHERE rn = 1""",
    "tied_articles": f"""
        SELECT {brand('k')}, source AS source_name, text AS headline, 'u' || (doc_id % 100) AS url,
               CASE WHEN k <= {LISTED} THEN 'T' || k END AS ticker, strftime({DOC_DAY}, '%Y-%m-%d') AS ingested_at,
               strftime({DOC_DAY}, '%Y-%m-%d') || 'T12:00:00Z' AS published_at
        FROM (SELECT *, doc_id % {BRANDS} + 1 AS k FROM documents)""",
    "tied_clean": f"""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url, brand_name
        ORDER BY ingested_at, published_at, md5({TIE}))
        AS rn FROM tied_articles WHERE trim(headline) <> '') WHERE rn = 1""",
    "tied_scores": """
        SELECT c.url, c.brand_name, sum(coalesce(valence, 0)) AS s
        FROM (SELECT url, brand_name, unnest(list_concat([''], regexp_extract_all(lower(headline), '[a-z]+'))) AS term FROM tied_clean) c
        LEFT JOIN lexicon USING (term) GROUP BY 1, 2""",
    "hits": """
        SELECT url, brand_name, sum(valence) AS s
        FROM (SELECT url, brand_name, unnest(regexp_extract_all(lower(headline), '[a-z]+')) AS term FROM news_clean)
        JOIN lexicon USING (term) GROUP BY 1, 2""",
    "news_scored": """
        SELECT *, CASE WHEN score >= 0.05 THEN 'POSITIVE' WHEN score <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
        FROM (SELECT n.*, coalesce(s / sqrt(s * s + 15), 0.0::DOUBLE) AS score, week(news_date) AS week
              FROM news_clean n LEFT JOIN hits USING (url, brand_name))""",
    "news_voiced": f"""
        SELECT *, {rnd('''count(*) OVER (PARTITION BY category, brand_name, week)
                          / count(*) OVER (PARTITION BY category, week) * 100''', 2)} AS share FROM news_scored""",
    "news_daily": """
        SELECT brand_name, category, brand_type, news_date, count(*) AS daily_article_count,
               avg(score) AS avg_daily_sentiment, any_value(share) AS share_of_voice_pct,
               count(*) FILTER (label = 'POSITIVE') AS positive_count,
               count(*) FILTER (label = 'NEGATIVE') AS negative_count
        FROM news_voiced GROUP BY brand_name, category, brand_type, news_date""",
    "news_rolling": f"""
        SELECT *, {rnd('''avg(daily_article_count) OVER (PARTITION BY brand_name ORDER BY news_date NULLS FIRST
                          ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)''', 2)} AS rolling_7d_avg FROM news_daily""",
    "news_silver": f"""
        SELECT *, CASE WHEN news_velocity > 20 THEN 'ACCELERATING' WHEN news_velocity < -20 THEN 'DECELERATING'
                       ELSE 'STABLE' END AS coverage_trend, '{AS_OF}' AS ingestion_date
        FROM (SELECT *, CASE WHEN rolling_7d_avg > 0 THEN
              {rnd('(daily_article_count - rolling_7d_avg) / rolling_7d_avg * 100', 2)} ELSE 0.0::DOUBLE END
              AS news_velocity FROM news_rolling)""",
    "trends_clean": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, date ORDER BY ingested_at) AS rn
        FROM trends_bronze WHERE trend_score IS NOT NULL AND brand_name IS NOT NULL) WHERE rn = 1""",
    "trends_stats": """
        SELECT *, lag(trend_score) OVER (PARTITION BY brand_name ORDER BY date) AS prev,
               avg(trend_score) OVER (PARTITION BY brand_name) AS mean,
               stddev_samp(trend_score) OVER (PARTITION BY brand_name) AS std FROM trends_clean""",
    "trends_silver": f"""
        SELECT *, abs(trend_zscore) > 2.0 AS is_anomaly FROM (
        SELECT brand_name, brand_type, category, date AS trend_date, trend_score, geo, ingested_at, stock_available,
               CASE WHEN prev > 0 THEN {rnd('(trend_score - prev) / prev * 100', 2)} ELSE 0.0::DOUBLE END AS trend_momentum,
               CASE WHEN std > 0 THEN {rnd('(trend_score - mean) / std', 4)} ELSE 0.0::DOUBLE END AS trend_zscore,
               'google_trends' AS data_source, '{AS_OF}' AS ingestion_date FROM trends_stats)""",
    "stocks_clean": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ingested_at) AS rn
        FROM stocks_bronze WHERE close_price > 0) WHERE rn = 1""",
}


def silver_stocks(bars: str) -> str:
    """Returns, volatility and signal of the clean bars in a view."""
    return f"""
        SELECT brand_name, brand_type, category, ticker, exchange, date AS stock_date, open_price, close_price,
               high_price, low_price, volume, change AS daily_change_pct, {rnd('deviation', 4)} AS volatility_7d,
               CASE WHEN change > 2.0 THEN 'STRONG_UP' WHEN change > 0.5 THEN 'UP' WHEN change < -2.0 THEN 'STRONG_DOWN'
                    WHEN change < -0.5 THEN 'DOWN' ELSE 'FLAT' END AS price_signal,
               ingested_at, TRUE AS stock_available, 'yfinance' AS data_source, '{AS_OF}' AS ingestion_date
        FROM (SELECT *, stddev_samp(change) OVER (PARTITION BY ticker ORDER BY date
                        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS deviation
              FROM (SELECT *, CASE WHEN prev > 0 THEN {rnd('(close_price - prev) / prev * 100', 4)}
                              ELSE 0.0::DOUBLE END AS change
                    FROM (SELECT *, lag(close_price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM {bars})))"""


def latest(view: str, date: str, day: str) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, category, brand_type
        ORDER BY {date} DESC) AS rn FROM {view} WHERE {date} <= '{day}') WHERE rn = 1)"""


def joined(day: str) -> str:
    return f"""
        SELECT n.brand_name, n.brand_type, n.category, avg_daily_sentiment, share_of_voice_pct, news_velocity,
               coverage_trend, daily_article_count, trend_score, trend_momentum, is_anomaly,
               close_price, s.daily_change_pct, volatility_7d, price_signal,
               coalesce(s.stock_available, FALSE) AS stock_available
        FROM {latest('news_silver', 'news_date', day)} n
        LEFT JOIN {latest('trends_silver', 'trend_date', day)} t USING (brand_name, category, brand_type)
        LEFT JOIN {latest('stocks_silver', 'stock_date', day)} s USING (brand_name, category, brand_type)"""


def scored(view: str) -> str:
    listed = ("sentiment_normalized * 0.30::DOUBLE + trend_normalized * 0.30::DOUBLE + stock_normalized * 0.30::DOUBLE"
              " + share_of_voice_pct * 0.10::DOUBLE")
    private = ("sentiment_normalized * 0.40::DOUBLE + trend_normalized * 0.40::DOUBLE"
               " + share_of_voice_pct * 0.20::DOUBLE")
    return f"""
        SELECT *, CASE WHEN brand_health_index >= 75 THEN 'STRONG' WHEN brand_health_index >= 55 THEN 'HEALTHY'
                       WHEN brand_health_index >= 35 THEN 'WEAK' ELSE 'AT_RISK' END AS health_label,
               coalesce(is_anomaly, FALSE) OR coalesce(avg_daily_sentiment < -0.5, FALSE)
                   OR coalesce(coverage_trend = 'ACCELERATING' AND avg_daily_sentiment < 0, FALSE) AS alert_flag,
               CASE WHEN avg_daily_sentiment < -0.5 THEN 'High negative sentiment'
                    WHEN is_anomaly THEN 'Abnormal trend spike — zscore > 2'
                    WHEN coverage_trend = 'ACCELERATING' AND avg_daily_sentiment < 0
                    THEN 'Accelerating negative coverage' END AS alert_reason
        FROM (SELECT *, {rnd(f'CASE WHEN stock_available THEN {listed} ELSE {private} END', 2)} AS brand_health_index
              FROM (SELECT *, {rnd('(avg_daily_sentiment + 1) / 2 * 100', 2)} AS sentiment_normalized,
                           CASE WHEN trend_score > 100 THEN 100 WHEN trend_score < 0 THEN 0 ELSE trend_score END
                               AS trend_normalized,
                           CASE WHEN stock_available THEN CASE WHEN daily_change_pct IS NULL THEN 50.0::DOUBLE ELSE
                               {rnd('least(100.0::DOUBLE, greatest(0.0::DOUBLE, (daily_change_pct + 5) * 10))', 2)}
                               END END AS stock_normalized
                    FROM {view}))"""


VIEWS["stocks_silver"] = silver_stocks("stocks_clean")
VIEWS["joined"] = joined(AS_OF)
VIEWS["joined_before"] = joined(LAST_WEEK)
VIEWS["scored"] = scored("joined")
VIEWS["before"] = scored("joined_before")
VIEWS["gold"] = f"""
    SELECT *, CASE WHEN index_change_wow > 5 THEN 'IMPROVING' WHEN index_change_wow < -5 THEN 'DECLINING'
                   ELSE 'STABLE' END AS wow_direction
    FROM (SELECT g.*, DATE '{AS_OF}' AS processed_date,
                 p.brand_health_index AS last_week_index, p.health_label AS last_week_label,
                 {rnd('g.brand_health_index - p.brand_health_index', 2)} AS index_change_wow,
                 coalesce(g.health_label <> p.health_label, FALSE) AS label_changed,
                 {rnd('g.sentiment_normalized - p.sentiment_normalized', 2)} AS sentiment_shift,
                 CAST(g.trend_normalized - p.trend_normalized AS DOUBLE) AS trend_shift
          FROM scored g LEFT JOIN before p USING (brand_name))"""

GOLD_COLUMNS = """brand_name, brand_type, category, processed_date, trend_score, trend_momentum, share_of_voice_pct,
    daily_article_count, news_velocity, coverage_trend, close_price, daily_change_pct, volatility_7d, price_signal,
    stock_available, sentiment_normalized, trend_normalized, stock_normalized, brand_health_index, health_label,
    is_anomaly, alert_flag, alert_reason, last_week_index, last_week_label, index_change_wow, wow_direction,
    label_changed, sentiment_shift, trend_shift, """ + rnd("avg_daily_sentiment", 6) + " AS avg_daily_sentiment"

NEWS_COLUMNS = """brand_name, category, brand_type, news_date, daily_article_count, share_of_voice_pct, positive_count,
    negative_count, rolling_7d_avg, news_velocity, coverage_trend, ingestion_date, """ + rnd(
    "avg_daily_sentiment", 6) + " AS avg_daily_sentiment"

WOW_COLUMNS = ("last_week_index, last_week_label, index_change_wow, wow_direction, label_changed,"
               " sentiment_shift, trend_shift")

BARS_COLUMNS = ("brand_name, brand_type, category, ticker, exchange, ingested_at, date, open_price, high_price,"
                " low_price, close_price, volume, daily_change_pct, price_range")

# The mean of decimals is exact, that of doubles depends on their order.
MEAN_INDEX = "avg(CAST(brand_health_index AS DECIMAL(18,2)))"

ARTICLE_ID = "CAST('0x' || left(md5(url || ' ' || coalesce(published_at, '')), 15) AS BIGINT)"
BRONZE_NEWS = f"""brand_name, brand_type, ticker, category, search_term, {ARTICLE_ID} AS article_id, headline,
    CAST(NULL AS VARCHAR) AS description, source_name, CAST(NULL AS VARCHAR) AS author, url, published_at, '{LOADED_AT}' AS ingested_at,
    'newsapi' AS pipeline_source, 'bronze' AS data_layer"""


def boost(word: str) -> str:
    return f"CASE WHEN {word} IN ('to', 'for') THEN 0.293::DOUBLE WHEN {word} IN ('a', 'was') THEN -0.293::DOUBLE ELSE 0.0::DOUBLE END"


UNIT = "brand_name, search_term, published_at"


def with_views(body: str) -> str:
    """The body preceded by the views it needs, in order of definition."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    order = [name for name in ORDER if name in needed]
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order) + "\n" + body if order else body


def _sorted_views() -> list[str]:
    """Views after the views they read."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        done.append(name)

    for name in VIEWS:
        visit(name)
    return done


ORDER = _sorted_views()

_BODIES: dict[str, str] = {
    "brand_dim": """
        SELECT brand_name, category, brand_type, ticker, exchange, unnest(search_terms) AS search_term,
               CAST(generate_subscripts(search_terms, 1) - 1 AS INTEGER) AS term_pos FROM brands""",
    "shape_news": f"""
        SELECT {BRONZE_NEWS} FROM first_seen JOIN brands USING (brand_name)""",
    "land_news": f"SELECT {BRONZE_NEWS} FROM landed_news JOIN brands USING (brand_name)",
    "land_news_summary": """
        WITH units AS (SELECT b.category, b.brand_name, count(n.url) AS records FROM brands b LEFT JOIN landed_news n USING (brand_name) GROUP BY ALL)
        SELECT *, FALSE AS skipped FROM units
        UNION ALL SELECT NULL, NULL, CAST(sum(records) AS BIGINT), FALSE FROM units""",
    "news_drop_removed": "SELECT brand_name, search_term, term_pos, article_pos, headline, url FROM titled",
    "article_id": """
        SELECT url, published_at,
               CAST('0x' || left(md5(url || ' ' || coalesce(published_at, '')), 15) AS BIGINT) AS article_id FROM news_bronze""",
    "article_id_uniqueness": """
        SELECT brand_name, count(*) AS n_articles, count(DISTINCT url || ' ' || published_at) AS n_ids
        FROM news_bronze GROUP BY brand_name""",
    "news_dedup_first": "SELECT brand_name, url, search_term, term_pos, article_pos, headline FROM first_seen",
    "source_fallback": f"""
        WITH answers AS (SELECT 'Brand#' || ({HASHED_BRAND}) AS brand_name, source AS search_term, doc_id AS term_pos,
                         CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_articles, lang FROM documents)
        SELECT * EXCLUDE (lang), 'primary' AS origin FROM answers WHERE lang = 'en'
        UNION ALL
        SELECT * EXCLUDE (lang), 'secondary' AS origin FROM answers a WHERE NOT EXISTS (
            SELECT 1 FROM answers p WHERE p.lang = 'en' AND p.brand_name = a.brand_name
            AND p.search_term = a.search_term)""",
    "news_top_n_per_term": """
        SELECT brand_name, search_term, term_pos, article_pos, published_at, headline
        FROM (SELECT *, row_number() OVER (PARTITION BY brand_name, search_term
                     ORDER BY published_at DESC, term_pos, article_pos) AS rn FROM articles WHERE lang = 'en')
        WHERE rn <= 20""",
    "ohlc_shape": f"SELECT {BARS_COLUMNS} FROM stocks_bronze",
    "last_n_bars": """
        SELECT ticker, date, close_price, volume FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM stocks_clean) WHERE rn <= 2""",
    "trends_unpivot": "SELECT date, search_term, trend_score FROM interest",
    "trends_term_join": f"""
        SELECT date, search_term, trend_score, {brand(f'(length(search_term) % {BRANDS} + 1)')},
               length(search_term) % {BRANDS} + 1 <= {LISTED} AS stock_available FROM interest""",
    "lineage_columns": f"""
        SELECT brand_name, date, trend_score, '{LOADED_AT}' AS ingested_at, 'google_trends' AS pipeline_source,
               'bronze' AS data_layer, 'today 1-m' AS timeframe, 'IN' AS geo FROM trends_bronze""",
    "ingest_skip_existing": f"""
        SELECT {UNIT}, url, lang FROM news_bronze WHERE ({UNIT}) NOT IN (
        SELECT ({UNIT}) FROM news_bronze WHERE lang <> 'en')""",
    "ingest_summary": """
        WITH units AS (SELECT b.category, b.brand_name,
            (SELECT count(*) FROM news_bronze n WHERE n.lang = 'en' AND n.brand_name = b.brand_name) AS records,
            b.brand_name IN (SELECT brand_name FROM news_bronze WHERE headline IS NULL) AS skipped FROM brands b)
        SELECT * FROM units
        UNION ALL SELECT NULL, NULL, CAST(sum(records) AS BIGINT), bool_or(skipped) FROM units""",
    "scan_news_day": f"""
        SELECT brand_name, brand_type, category, headline, url, published_at, ingested_at FROM news_bronze
        WHERE ingested_at LIKE '{SCAN_DAY}%'""",
    "scan_stocks_day": f"""
        SELECT brand_name, category, ticker, date, close_price, volume, stock_available FROM stocks_bronze
        WHERE ingested_at LIKE '{SCAN_DAY}%'""",
    "scan_trends_day": f"""
        SELECT brand_name, category, date, trend_score, geo, stock_available FROM trends_bronze
        WHERE ingested_at LIKE '{SCAN_DAY}%'""",
    "landed_units": "SELECT DISTINCT category FROM trends_bronze WHERE category <> 'C0'",
    "scan_sound": """
        SELECT brand_name, count(*) AS n_records, 'sound' AS kind FROM trends_bronze GROUP BY brand_name
        UNION ALL SELECT NULL, count(*), 'damaged' FROM lines""",
    "bronze_roundtrip": "SELECT * FROM trends_bronze",
    "silver_roundtrip": "SELECT * EXCLUDE (ingested_at) FROM trends_silver",
    **dict.fromkeys(("silver_scan_by_ingestion", "silver_catalog_scan"), f"""
        SELECT brand_name, category, trend_date, trend_score, trend_zscore, trend_date AS ingestion_date
        FROM trends_silver WHERE trend_date = '{SCAN_DAY}'"""),
    "silver_catalog_rerun": f"""
        SELECT brand_name, category, trend_date, trend_score, trend_zscore, trend_date AS ingestion_date
        FROM trends_silver WHERE trend_date <> '{SCAN_DAY}' OR brand_type = 'listed'""",
    "gold_roundtrip": f"SELECT {GOLD_COLUMNS} FROM gold",
    **dict.fromkeys(("history_scan", "history_catalog_scan"), """
        SELECT brand_name, category, brand_type, brand_health_index AS last_week_index, health_label AS last_week_label,
               sentiment_normalized AS last_week_sentiment, trend_normalized AS last_week_trend FROM before"""),
    "stage_counts": " UNION ALL ".join(
        f"SELECT '{v}' AS stage, count(*) AS n_rows FROM {v}"
        for v in ("news_bronze", "news_clean", "stocks_bronze", "stocks_silver", "trends_bronze", "trends_silver")),
    "silver_rerun_corrected": """
        SELECT brand_name, category, trend_date, trend_score FROM trends_silver WHERE brand_type = 'listed'""",
    "news_dedup_ties": "SELECT brand_name, url, source_name, headline, ingested_at FROM tied_clean",
    **dict.fromkeys(("news_scores_ties", "news_scores_ties_long"), f"""
        SELECT brand_name, url, {rnd('s / sqrt(s * s + 15)', 6)} AS sentiment_score FROM tied_scores"""),
    "lowercase_columns": "SELECT brand_name, date, trend_score FROM trends_bronze",
    "news_standardize": "SELECT * FROM news_standard",
    "news_filter_nulls": "SELECT brand_name, url, headline, published_at FROM news_complete",
    "news_dedup": "SELECT brand_name, url, source_name, published_at, ingested_at, news_date FROM news_clean",
    **dict.fromkeys(("sentiment_lexicon", "sentiment_scorer"),
                    f"SELECT brand_name, url, {rnd('score', 6)} AS sentiment_score FROM news_scored"),
    "sentiment_before_dedupe": f"""
        SELECT brand_name, url, news_date, {rnd('score', 6)} AS sentiment_score FROM news_scored""",
    "sentiment_in_context": f"""
        WITH tokens AS (
            SELECT url, brand_name, unnest(regexp_extract_all(headline, '[A-Za-z]+')) AS w,
                   generate_subscripts(regexp_extract_all(headline, '[A-Za-z]+'), 1) AS pos FROM news_clean),
        around AS (
            SELECT *, lower(w) AS term, w = upper(w) AND length(w) > 1 AS loud,
                   bool_or(w <> upper(w) OR length(w) = 1) OVER (PARTITION BY url, brand_name) AS mixed,
                   lag(lower(w), 1) OVER o AS b1, lag(lower(w), 2) OVER o AS b2, lag(lower(w), 3) OVER o AS b3
            FROM tokens WINDOW o AS (PARTITION BY url, brand_name ORDER BY pos)),
        raised AS (
            SELECT url, brand_name, coalesce(b1 IN ('in', 'für', 'les'), FALSE) OR coalesce(b2 IN ('in', 'für', 'les'), FALSE)
                       OR coalesce(b3 IN ('in', 'für', 'les'), FALSE) AS negated,
                   valence + CASE WHEN loud AND mixed THEN sign(valence) * 0.733::DOUBLE ELSE 0.0::DOUBLE END
                   + sign(valence) * ({boost('b1')}) + sign(valence) * ({boost('b2')}) * 0.95::DOUBLE
                   + sign(valence) * ({boost('b3')}) * 0.9::DOUBLE AS v
            FROM around JOIN lexicon USING (term)),
        sums AS (SELECT url, brand_name, sum(CASE WHEN negated THEN v * -0.74::DOUBLE ELSE v END) AS s FROM raised GROUP BY ALL)
        SELECT brand_name, url, coalesce({rnd('s / sqrt(s * s + 15)', 6)}, 0.0::DOUBLE) AS sentiment_score
        FROM news_clean LEFT JOIN sums USING (url, brand_name)""",
    "news_seen_days": "SELECT brand_name, url, news_date, ingested_at FROM news_clean",
    "news_velocity_from_state": f"""
        WITH rolled AS (
            SELECT brand_name, news_date, daily_article_count, {rnd("""avg(daily_article_count) OVER (PARTITION BY brand_name
                   ORDER BY news_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", 2)} AS rolling_7d_avg
            FROM news_daily WHERE news_date IS NOT NULL)
        SELECT *, CASE WHEN rolling_7d_avg > 0 THEN {rnd('(daily_article_count - rolling_7d_avg) / rolling_7d_avg * 100', 2)}
                  ELSE 0.0::DOUBLE END AS news_velocity FROM rolled""",
    "sentiment_label": "SELECT brand_name, url, label AS sentiment_label FROM news_scored",
    "news_daily_agg": f"""
        SELECT brand_name, category, brand_type, news_date, daily_article_count,
               {rnd('avg_daily_sentiment', 6)} AS avg_daily_sentiment, positive_count, negative_count FROM news_daily""",
    "news_share_per_week": f"""
        SELECT brand_name, category, week, n, {rnd('n / sum(n) OVER (PARTITION BY category, week) * 100', 2)}
               AS share_of_voice_pct
        FROM (SELECT brand_name, category, CAST(yearweek(news_date) AS INTEGER) AS week, count(*) AS n
              FROM news_clean GROUP BY ALL)""",
    "share_of_voice": "SELECT brand_name, category, brand_type, news_date, share_of_voice_pct FROM news_silver",
    "news_velocity": """
        SELECT brand_name, news_date, daily_article_count, rolling_7d_avg, news_velocity FROM news_silver""",
    "coverage_trend": "SELECT brand_name, news_date, coverage_trend FROM news_silver",
    "news_silver": f"SELECT {NEWS_COLUMNS} FROM news_silver",
    "news_silver_split": f"SELECT {NEWS_COLUMNS} FROM news_silver",
    "stocks_filter_price": "SELECT ticker, date, ingested_at, close_price FROM stocks_bronze WHERE close_price > 0",
    "stocks_dedup": "SELECT ticker, date, ingested_at, close_price FROM stocks_clean",
    "stock_returns": "SELECT ticker, stock_date, close_price, daily_change_pct FROM stocks_silver",
    "stock_volatility": "SELECT ticker, stock_date, volatility_7d FROM stocks_silver",
    "stock_volatility_days": f"""
        SELECT ticker, stock_date, {rnd('''stddev_samp(daily_change_pct) OVER (PARTITION BY ticker
               ORDER BY CAST(stock_date AS DATE) RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)''', 4)}
               AS volatility_7d FROM stocks_silver""",
    "price_signal": "SELECT ticker, stock_date, price_signal FROM stocks_silver",
    **dict.fromkeys(("stocks_silver", "stocks_silver_from_state"), "SELECT * FROM stocks_silver"),
    "stocks_silver_lineitem": silver_stocks("lineitem_bars"),
    "stocks_silver_split": silver_stocks("lineitem_bars"),
    "trends_filter_nulls": """
        SELECT brand_name, date, ingested_at, trend_score FROM trends_bronze WHERE trend_score IS NOT NULL""",
    "trends_dedup": "SELECT brand_name, date, ingested_at, trend_score FROM trends_clean",
    "trend_momentum": "SELECT brand_name, trend_date, trend_score, trend_momentum FROM trends_silver",
    **dict.fromkeys(("trend_zscore", "trend_zscore_state"), "SELECT brand_name, trend_date, trend_zscore FROM trends_silver"),
    "trend_anomaly": "SELECT brand_name, trend_date, trend_score, trend_zscore FROM trends_silver WHERE is_anomaly",
    "trends_silver": "SELECT * FROM trends_silver",
    "trends_silver_split": "SELECT * FROM trends_silver",
    "gold_join": f"SELECT * REPLACE ({rnd('avg_daily_sentiment', 6)} AS avg_daily_sentiment) FROM joined",
    "gold_join_fanout": """
        SELECT brand_name, category, brand_type, any_value(news_rows) AS news_rows, any_value(trends_rows) AS trends_rows,
               any_value(stocks_rows) AS stocks_rows, count(*) AS joined_rows
        FROM (SELECT *, count(*) OVER (PARTITION BY brand_name, category, brand_type) AS news_rows FROM news_silver)
        LEFT JOIN (SELECT brand_name, category, brand_type,
                   count(*) OVER (PARTITION BY brand_name, category, brand_type) AS trends_rows FROM trends_silver)
             USING (brand_name, category, brand_type)
        LEFT JOIN (SELECT brand_name, category, brand_type,
                   count(*) OVER (PARTITION BY brand_name, category, brand_type) AS stocks_rows FROM stocks_silver)
             USING (brand_name, category, brand_type)
        GROUP BY brand_name, category, brand_type""",
    "normalize_signals": """
        SELECT brand_name, sentiment_normalized, trend_normalized, stock_normalized, stock_available FROM scored""",
    "health_index": "SELECT brand_name, brand_health_index FROM scored",
    "health_label": "SELECT brand_name, health_label FROM scored",
    "alerts": "SELECT brand_name, is_anomaly, coverage_trend, alert_flag, alert_reason FROM scored",
    "gold_wow": f"SELECT brand_name, {WOW_COLUMNS} FROM gold",
    "gold_wow_first_run": """
        SELECT brand_name, brand_health_index, CAST(NULL AS DOUBLE) AS last_week_index,
               CAST(NULL AS VARCHAR) AS last_week_label, CAST(NULL AS DOUBLE) AS index_change_wow,
               CAST(NULL AS VARCHAR) AS wow_direction, CAST(NULL AS BOOLEAN) AS label_changed,
               CAST(NULL AS DOUBLE) AS sentiment_shift, CAST(NULL AS DOUBLE) AS trend_shift FROM scored""",
    "gold_brand_health": f"SELECT {GOLD_COLUMNS} FROM gold",
    "gold_days": f"""
        SELECT {GOLD_COLUMNS} FROM (
            SELECT * FROM gold UNION ALL BY NAME SELECT *, DATE '{LAST_WEEK}' AS processed_date FROM before)""",
    "health_sql": """
        SELECT brand_name, sentiment_normalized, trend_normalized, stock_normalized, alert_flag, alert_reason, brand_health_index, health_label
        FROM scored""",
    "gold_preview": """
        SELECT brand_name, brand_health_index, health_label, alert_flag, index_change_wow, wow_direction FROM gold
        ORDER BY brand_name, brand_health_index LIMIT 12""",
    "q1_leaderboard": f"""
        SELECT brand_name, category, brand_health_index, health_label, alert_flag FROM gold
        WHERE processed_date = DATE '{AS_OF}' ORDER BY brand_health_index DESC NULLS FIRST""",
    "q2_alerts": f"""
        SELECT brand_name, category, brand_health_index, health_label, alert_reason FROM gold
        WHERE processed_date = DATE '{AS_OF}' AND alert_flag ORDER BY brand_health_index""",
    "q3_category": f"""
        SELECT category, count(brand_name) AS total_brands, {rnd(MEAN_INDEX, 2)} AS avg_health,
               count(*) FILTER (health_label = 'STRONG') AS strong, count(*) FILTER (health_label = 'HEALTHY') AS healthy,
               count(*) FILTER (alert_flag) AS alerts
        FROM gold WHERE processed_date = DATE '{AS_OF}' GROUP BY category ORDER BY avg_health DESC""",
    "q4_wow": f"""
        SELECT brand_name, brand_health_index AS this_week, last_week_index AS last_week, index_change_wow AS change,
               wow_direction, label_changed, last_week_label AS was, health_label AS now
        FROM gold WHERE processed_date = DATE '{AS_OF}' ORDER BY index_change_wow NULLS LAST""",
    "q5_brand_type": f"""
        SELECT brand_type, count(brand_name) AS brand_count, {rnd(MEAN_INDEX, 2)} AS avg_health,
               {rnd('avg(avg_daily_sentiment)', 4)} AS avg_sentiment, {rnd('avg(trend_score)', 2)} AS avg_trend
        FROM gold WHERE processed_date = DATE '{AS_OF}' GROUP BY brand_type""",
}


def _complete(body: str) -> str:
    """Views in front of the body, merged with the body's own leading WITH."""
    sql = with_views(body).strip()
    own = body.strip()
    if own.startswith("WITH ") and sql != own:
        head = sql[: -len(own)].rstrip() if sql.endswith(own) else sql[: sql.rindex(own)]
        return head + ",\n" + own[len("WITH "):]
    return sql


for _name in ("q1_leaderboard", "q2_alerts", "q3_category", "q4_wow", "q5_brand_type"):
    _BODIES[f"{_name}_sql"] = _BODIES[_name]

ORACLES: dict[str, str] = {name: _complete(body) for name, body in _BODIES.items()}
