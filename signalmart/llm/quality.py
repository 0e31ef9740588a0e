"""Quality rules: word statistics, and a log-likelihood ratio of hashed n-grams between trusted and all text.

Two multinomials over ``BUCKETS`` hashed words and word pairs are counted: one over the trusted documents, one
over the raw corpus.  A document's score is the mean over its n-grams of ``log p_trusted - log p_raw``; it
is kept when the score reaches a fixed threshold, so the same tables always give the same verdicts.

The raw corpus is every document.  The trusted ones are labelled documents of good quality, ``TRUSTED`` at most
(those whose id hashes lowest), which bounds the broadcast that marks them.  Everything is built-in
expressions: repeated windows are found by sorting a document's window hashes and then compared word by word.

Null text has no words and fails.  Null ids are never trusted.  Repeated rows count as often as they stand there.
Without trusted documents every score is 0.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.sources.shared import stage

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BUCKETS = 1 << 14
TRUSTED = 20_000
# Between labelled good documents (-0.065 and more) and bad ones (-0.125 and less); the first version, -0.045, cost 15 of 1,000 good ones.
LEAST_SCORE = -0.09


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _from(array: str, first: int, without: int) -> Column:
    """The array from its element ``first`` on, without as many elements in all as ``without``."""
    return F.slice(array, first, F.greatest(F.size(array) - without, F.lit(0)))


def paired(hashes: str) -> Column:
    """A hash of every two neighbours."""
    return F.zip_with(_from(hashes, 1, 1), _from(hashes, 2, 1), lambda a, b: F.xxhash64(a, b))


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, " " + SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + SPACES, "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _equal_text(array: str) -> Column:
    """Elements of a sorted array of ``text, at`` whose text equals that of a neighbour."""
    return F.filter(array, lambda x, i: (F.get(array, i + 1)["text"] == x["text"]) | (F.get(array, i - 1)["text"] == x["text"]))


def with_repeated_words(df: DataFrame, tokens: str, hashes: str, pairs: str) -> DataFrame:
    """Add ``n_repeat_words``: words in windows of three that are found twice or more in the document.

    ``hashes`` has a hash for each word, ``pairs`` for each two.  Window hashes are cut so that the window's
    place fits into the low bits and sorted as plain numbers; windows next to an equal one are compared as text.
    """
    low = F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(size({tokens}), 2))) as int)) - 1")
    windows = F.zip_with(_from(pairs, 1, 1), _from(hashes, 3, 2), lambda p, h: F.xxhash64(p, h))
    steps = df.withColumn("_low", low).withColumn("_windows", windows).withColumn("_windows", F.sort_array(F.transform(
        "_windows", lambda h, i: h.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long")))))

    def next_to(step: int) -> Column:
        # What differs in the low bits only; numbers of different sign may pass too, the texts tell.
        return F.filter("_windows", lambda x, i: x.bitwiseXOR(F.get("_windows", i + step)) <= F.col("_low"))

    steps = steps.withColumn("_before", next_to(1)).withColumn("_likely", F.when(
        F.size("_before") > 0, F.array_union("_before", next_to(-1))).otherwise(F.col("_before"))).drop("_windows", "_before")
    place = lambda x: x.bitwiseAND(F.col("_low")).cast("int")
    steps = steps.withColumn("_spelled", F.sort_array(F.transform("_likely", lambda x: F.struct(
        F.concat_ws(" ", F.slice(tokens, place(x) + 1, WINDOW)).alias("text"), place(x).alias("at")))))
    found = F.sort_array(F.transform(_equal_text("_spelled"), lambda x: x["at"]))
    steps = steps.withColumn("_found", found).drop("_spelled", "_likely", "_low")
    covered = F.aggregate(
        F.transform("_found", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_found", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, c: total + c)
    return steps.withColumn("n_repeat_words", covered).drop("_found")


def bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(most)


def ratios(docs: DataFrame, trusted: DataFrame) -> Column:
    """A constant array: the log ratio of every bucket, one added to every count."""
    marked = docs.join(F.broadcast(trusted), docs["doc_id"] == trusted["_trusted"], "left")
    grams = marked.select(hashed(words(F.coalesce("text", F.lit("")))).alias("_hashes"), "_trusted").select(
        F.explode(F.concat("_hashes", paired("_hashes"))).alias("gram"),
        F.when(F.col("_trusted").isNotNull(), 1).otherwise(0).alias("good")).withColumn("bucket", bucket(F.col("gram")))
    # One row per bucket from here on, however large the corpus is.
    counts = stage("llr-counts")(grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("n_good")))
    n, n_good = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    ratio = F.log((F.col("n_good") + 1) / F.lit(n_good + BUCKETS)) - F.log((F.col("n") + 1) / F.lit(n + BUCKETS))
    found = dict(map(tuple, counts.select("bucket", F.round(ratio, 6)).collect())) if n_good else {}
    return F.split(F.lit(",".join(str(found.get(b, 0.0)) for b in range(BUCKETS))), ",").cast("array<double>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the word statistics, ``base_failed``, ``score`` and ``kept`` of every document."""
    ratio = ratios(docs, trusted_ids(labels))
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id"), text.alias("_text"), words(text).alias("_words")).withColumn(
        "_hashes", hashed(F.col("_words"))).withColumn("_pairs", paired("_hashes"))
    total = F.lit(0.0)
    for grams in ("_hashes", "_pairs"):
        total = F.aggregate(grams, total, lambda sum_, g: sum_ + F.get(ratio, bucket(g)))
    counted = with_repeated_words(split.select(
        "doc_id", "_words", "_hashes", "_pairs",
        F.size("_words").cast("long").alias("n_words"), word_chars(F.col("_text")).alias("word_chars"),
        n_symbols(F.col("_text")).alias("n_symbols"), n_dup_lines(F.col("_text")).alias("n_dup_lines"),
        total.alias("_total"), (F.size("_hashes") + F.size("_pairs")).alias("_grams")), "_words", "_hashes", "_pairs")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    score = F.when(F.col("_grams") > 0, F.col("_total") / F.col("_grams")).otherwise(0.0)
    verdicts = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        score.alias("score")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST_SCORE))
    # A filter on a verdict would be pushed below the steps above and repeat each of them inside itself; not so through a generator.
    return verdicts.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
