"""Sentiment that looks at the words before a word: negation, boosters, capitals.

The rules and their values follow Hutto and Gilbert (ICWSM 2014).  A word with a valence is looked at together with the three words
before it, which are picked by position from the text's token array, so everything stays one row per word and column
expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.functions import text as X
from signalmart.operators.sizing import broadcast_if_small

# Fixed values of the published rules.
NEGATION = -0.74
BOOST = 0.293
CAPITALS = 0.733
DAMPING = (1.0, 0.95, 0.9)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "despite", "didnt", "doesnt", "dont", "hadnt", "hardly", "hasnt", "havent", "isnt",
    "neither", "never", "no", "nobody", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldnt", "uhuh", "wasnt",
    "werent", "without", "wont", "wouldnt",
)
BOOSTERS = {
    **dict.fromkeys(("absolutely", "amazingly", "completely", "considerably", "deeply", "enormously", "entirely", "especially", "extremely",
                     "highly", "incredibly", "more", "most", "particularly", "really", "remarkably", "so", "thoroughly", "totally",
                     "very"), BOOST),
    **dict.fromkeys(("almost", "barely", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly",
                     "somewhat"), -BOOST),
}


@dataclass(frozen=True)
class Rules:
    """What turns a valence round, what raises or lowers it, and by how much capitals raise it."""

    negations: Sequence[str] = NEGATIONS
    boosters: Mapping[str, float] = field(default_factory=lambda: BOOSTERS)
    negation: float = NEGATION
    capitals: float = CAPITALS
    damping: Sequence[float] = DAMPING


def tokens(text: Column) -> Column:
    """Letter runs as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))


def _booster(word: Column, boosters: Mapping[str, float]) -> Column:
    """The booster's value, 0.0 for other words and beyond the beginning."""
    value = F.lit(0.0)
    for amount in sorted(set(boosters.values())):
        value = F.when(word.isin([w for w, a in boosters.items() if a == amount]), amount).otherwise(value)
    return value


def _adjusted(rules: Rules) -> Column:
    """The valence of a word among its neighbours."""
    sign = F.signum("valence")
    raised = F.col("valence") + F.when(F.col("shouted"), sign * rules.capitals).otherwise(0.0)
    for k, damping in enumerate(rules.damping):
        raised = raised + sign * _booster(F.col("before")[k], rules.boosters) * damping
    negated = F.exists("before", lambda w: F.coalesce(w.isin(list(rules.negations)), F.lit(False)))
    return F.when(negated, raised * rules.negation).otherwise(raised)


def sentiment_in_context(
    df: DataFrame, text: str, lexicon: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), rules: Rules | None = None,
    out: str = "sentiment_score",
) -> DataFrame:
    """``operators.sentiment.sentiment`` with the rules of context: ``keys``, ``carry`` and ``out`` are returned.

    Capitals count in texts that are not all in capitals.  ``keys`` identify a text; a null text scores 0.0.
    """
    rules = rules or Rules()
    kept = [*keys, *carry]
    reach = len(rules.damping)
    words = df.select(*kept, tokens(F.col(text)).alias("_words"))
    shouting = lambda w: (w == F.upper(w)) & (F.length(w) > 1)
    mixed = F.exists("_words", lambda w: ~shouting(w))
    words = words.withColumn("_mixed", mixed)

    def token(word: Column, at: Column) -> Column:
        before = [F.lower(F.get("_words", at - k)) for k in range(1, reach + 1)]
        return F.struct(F.lower(word).alias("term"), (F.col("_mixed") & shouting(word)).alias("shouted"), F.array(*before).alias("before"))

    exploded = words.select(*kept, F.explode_outer(F.transform("_words", token)).alias("_token"))
    placed = exploded.select(*kept, "_token.*")
    # Words without a valence drop out after the join; texts without any keep one row with 0.0.
    valued = placed.join(broadcast_if_small(lexicon.select("term", "valence")), "term", "left")
    scored = valued.select(*kept, F.when(F.col("valence") != 0, _adjusted(rules)).otherwise(0.0).alias("_value"))
    return scored.groupBy(*kept).agg(X.compound(F.sum("_value")).alias(out))
