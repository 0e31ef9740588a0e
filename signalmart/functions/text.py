"""Text and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmart import constants as C

def words(text: Column) -> Column:
    """Lower-case letter runs of the whole text, led by an empty entry.

    The leading entry makes sure that exploding keeps texts without a word.  Another one
    follows the last word when the text goes on after it.  A null text is one without words.
    """
    return F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit("")))), "[^a-z]+")


def compound(valence_sum: Column, alpha: float = C.COMPOUND_ALPHA) -> Column:
    """Squash a valence sum to (-1, 1)."""
    return valence_sum / F.sqrt(valence_sum * valence_sum + alpha)


def filled(text: Column) -> Column:
    """Neither null nor empty."""
    return F.length(text) > 0


def date_of(timestamp_text: Column) -> Column:
    """Calendar date written in an ISO-8601 text, null when malformed.

    The date is taken as written: going through a timestamp would shift it by the
    session time zone.
    """
    return timestamp_text.try_cast("date")


def year_of(day: Column) -> Column:
    """Year of a date or an ISO-8601 text, as text."""
    return F.substring(day.cast("string"), 1, 4)


def iso_week(day: Column) -> Column:
    """ISO week number without the year."""
    return F.weekofyear(day)


def iso_year_week(day: Column) -> Column:
    """ISO year and week as ``year * 100 + week``."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def article_id(url: Column, published_at: Column) -> Column:
    """Stable surrogate id, 60 bits of a digest; not a join key."""
    digest = F.md5(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(published_at, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
