"""Sentiment of texts from a lexicon, or from a plugged-in scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.functions import text as X
from signalmart.operators.sizing import broadcast_if_small


def sentiment(
    df: DataFrame, text: str, lexicon: DataFrame, keys: Sequence[str], carry: Sequence[str] = (),
    out: str = "sentiment_score",
) -> DataFrame:
    """Score each row by the valences of its words: ``keys``, ``carry`` and ``out`` are returned.

    ``lexicon`` has the columns ``term`` (unique) and ``valence``; ``keys`` identify a text,
    copies of a row give one result, and ``carry`` are further columns.  Words that are not
    in the lexicon drop out right after the join, before anything is aggregated.  With a
    lexicon of checked small size the join is a broadcast, and when ``df`` already is hash
    partitioned by ``keys`` (as after ``dedupe``) no shuffle is needed at all; a larger
    lexicon becomes a shuffled join whose hot words adaptive execution splits.
    """
    kept = [*keys, *carry]
    words = df.select(*kept, F.posexplode(X.words(F.col(text))).alias("_pos", "term"))
    valued = words.join(broadcast_if_small(lexicon.select("term", "valence")), "term", "left")
    first = F.col("_pos") == 0
    total, copies = F.sum(F.coalesce("valence", F.lit(0.0))), F.count_if(first)
    return valued.where(first | F.col("valence").isNotNull()).groupBy(*kept).agg(
        X.compound(total / copies).alias(out)
    )


def scorer(make: Callable[[], Callable[[str], float]]) -> Callable[[Column], Column]:
    """A column function of a Python scorer, for ``score_with``.

    ``make`` is called once per worker process and batch stream, where it may load its
    model or rules; the function it returns scores one text.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score_text = make()
        for batch in batches:
            yield batch.map(score_text)

    return score


def score_with(
    df: DataFrame, text: str, scorer: Callable[[Column], Column], keys: Sequence[str], carry: Sequence[str] = (),
    out: str = "sentiment_score",
) -> DataFrame:
    """Score with a user's column function instead of a lexicon, see ``scorer``.

    A failing scorer fails the job: a silent 0.0 would label every text NEUTRAL.
    """
    return df.select(*keys, *carry, scorer(F.col(text)).cast("double").alias(out))
