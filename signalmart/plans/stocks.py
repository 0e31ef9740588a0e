"""Silver stocks: daily returns, volatility and price signal per ticker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import labels
from signalmart.operators.rows import dedupe
from signalmart.operators.series import in_periods, pct_change, rolling_stddev
from signalmart.operators.tails import continued, next_tail

BAR_KEYS = ["ticker", "date"]
BAR_COLUMNS = [
    "brand_name", "brand_type", "category", "exchange", "open_price", "close_price", "high_price", "low_price", "volume",
]


def drop_unpriced(bronze: DataFrame) -> DataFrame:
    """Bars with a positive close; a null close is dropped as well."""
    return bronze.where(F.col("close_price") > 0)


def clean(bronze: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Priced bars, one per ticker and date: the one loaded first; all columns or those named."""
    return dedupe(drop_unpriced(bronze), BAR_KEYS, ["ingested_at"], columns, BAR_COLUMNS)


def returns(bars: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Close-to-close change in percent; it replaces the intraday change of the landed bar."""
    return pct_change(bars, "close_price", keys, "stock_date", "daily_change_pct", scale=4)


def volatility(bars: DataFrame, frame: str = "rows", keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return rolling_stddev(bars, "daily_change_pct", keys, "stock_date", "volatility_7d", frame=frame)


def _bars(bronze: DataFrame) -> DataFrame:
    return clean(bronze, BAR_COLUMNS).withColumn("stock_date", F.col("date"))


def tail_of(bronze: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """The bars the next day's signals look back to, see ``operators.tails``."""
    return next_tail(_bars(bronze), tail, ["ticker"], "stock_date", C.ROLLING_ROWS)


def stocks_silver(
    bronze: DataFrame, as_of: str, *, frame: str = "rows", split: Callable[[Column], Column] | None = None,
    tail: DataFrame | None = None,
) -> DataFrame:
    """Silver stocks of the given bars; ``split`` cuts long series, for example by ``text.year_of``.

    With a ``tail`` the bars go on from those of earlier days.
    """
    def signals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return volatility(returns(df, keys), frame, keys)

    bars = _bars(bronze)
    if tail is None:
        moving = in_periods(bars, ["ticker"], "stock_date", split, C.ROLLING_ROWS, signals)
    else:
        moving = continued(bars, tail, ["ticker"], "stock_date", signals)
    return moving.withColumns({
        "price_signal": labels.price_signal(F.col("daily_change_pct")),
        "stock_available": F.lit(True),
        "data_source": F.lit(C.STOCKS_SOURCE),
        "ingestion_date": F.lit(as_of),
    }).select(*schemas.STOCKS_SILVER.fieldNames())
