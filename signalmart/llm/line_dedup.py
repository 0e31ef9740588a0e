"""Line de-duplication against levelled, sorted runs of line keys.

A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Documents arrive in batches of ascending
ids.  The keys of a batch are merge-joined with the runs of all batches before: those found there were seen in a smaller
document, so every line with such a key goes.  The others become a new run, and their first document keeps its lines.

*Runs.*  A run is a table of key digests, dealt into buckets by digest and sorted within them.  Runs and the aggregated keys of a batch are
dealt alike, so neither is shuffled for the join.  ``fan_out`` runs of a level are compacted into one of the next, which keeps
their number within ``fan_out`` times the logarithm of the number of batches.

*Hot lines.*  Keys are aggregated before they are shuffled.  Where verdicts return to the lines, keys with at least
``1 / HOT_SHARE`` of the batch's lines (so ``HOT_SHARE`` of them at most) are broadcast, the others joined by digest.

Only keys of ``least`` code points or more count.  Rows with one id are one document; null ids are one document before all others, so
they lose nothing.  Ids are integers.  A null text is one empty line.  A batch holds a range of ids; uneven ids make uneven batches, not
other results.  Digests are 128 bits of SHA-256.  An empty table gives no rows.  Everything is built-in expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.sources.shared import remove, shared_folder, stage

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
BATCHES = 6
FAN_OUT = 3
HOT_SHARE = 1_000
LINES = "holder long, body long, pos int, digest binary"
# The id null stands for.
FIRST = -(2**63)
# Lets Spark use that buckets of one file are sorted.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def folded(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """``holder, body, pos, digest`` of every line whose key is long enough; ``body`` tells the rows of one id apart."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(
        F.coalesce(F.col(id_column), F.lit(FIRST)).alias("holder"), F.xxhash64(text).alias("body"),
        F.posexplode(lines_of(folded(text))).alias("pos", "line"))
    keyed = split.select("holder", "body", "pos", F.btrim("line", F.lit(SPACES)).alias("key"))
    return keyed.where(F.char_length("key") >= least).select(
        "holder", "body", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("digest"))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class LineRuns:
    """The keys of all batches so far, as levels of sorted and bucketed runs."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int | None = None) -> None:
        if fan_out < 2:
            raise ValueError("levels hold at least two runs")
        self.spark, self.fan_out = spark, fan_out
        # As many as a shuffle has partitions, so that a batch's aggregated keys lie like the runs.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def keys(self, run: str) -> DataFrame:
        """Digests that were new with this run."""
        return self.spark.table(run).where("not seen").select("digest")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_folder(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        remove(self.spark, self.paths.pop(run))

    def add(self, lines: DataFrame) -> str:
        """Merge the keys of a batch into the runs; names the table of their verdicts.

        ``digest, first, n, seen``: the smallest holder in the batch, the number of lines, and whether a run had the key.
        The table is the batch's run too, until ``settle``.
        """
        found = lines.groupBy("digest").agg(F.min("holder").alias("first"), F.count("*").alias("n"))
        seen = F.lit(False)
        for k, run in enumerate(self.runs()):
            found = found.hint("merge").join(self.keys(run).withColumn(f"_{k}", F.lit(True)).hint("merge"), "digest", "left")
            seen = seen | F.col(f"_{k}").isNotNull()
        with setting(self.spark, SORTED_BUCKETS, "true"):
            return self._write(found.select("digest", "first", "n", seen.alias("seen")).repartition(self.buckets, "digest"))

    def settle(self, run: str) -> None:
        """Count a batch's table among the runs, and compact the levels that are full."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_out:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.keys(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.keys(other))  # no key is new in two runs
            run = self._write(merged.withColumn("seen", F.lit(False)).repartition(self.buckets, "digest"))
            for old in full:
                self._forget(old)
            level += 1

    def close(self) -> None:
        for run in list(self.paths):
            self._forget(run)


def dropped_in(lines: DataFrame, verdicts: DataFrame, n_lines: int) -> DataFrame:
    """``holder, body, pos`` of the lines of a batch that go."""
    hot_from = max(2, n_lines // HOT_SHARE)
    hot = verdicts.where(F.col("n") > hot_from).select("digest", "first", "seen")
    common = lines.join(F.broadcast(hot), "digest").where(F.col("seen") | (F.col("holder") > F.col("first")))
    stays = verdicts.where(~F.col("seen")).select("digest", F.col("first").alias("holder"))
    others = lines.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(stays.hint("merge"), ["digest", "holder"], "left_anti")
    return common.select("holder", "body", "pos").unionByName(others.select("holder", "body", "pos"))


def dropped_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_CHARS, batches: int = BATCHES,
    fan_out: int = FAN_OUT, made: list[str] | None = None,
) -> DataFrame:
    """``holder, body, pos`` of all lines that go: the id, a hash of the text, the line's place from 0.

    ``made`` gets the folder of the result, for ``remove``.
    """
    spark = docs.sparkSession
    lines = keyed_lines(docs, id_column, text_column, least)
    low, high = docs.agg(F.min(id_column), F.max(id_column)).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // batches))
    number = F.expr(f"cast(greatest(0, (cast(holder as decimal(38,0)) - {low}) div {width}) as int)")
    staged = shared_folder(spark, "lines")
    lines.withColumn("batch", number).write.partitionBy("batch").parquet(staged)
    everything = spark.read.schema(f"{LINES}, batch int").parquet(staged)
    sizes = dict(map(tuple, everything.groupBy("batch").count().collect()))
    runs = LineRuns(spark, fan_out)
    out = shared_folder(spark, "lines-dropped")
    if made is not None:
        made.append(out)
    try:
        for batch in sorted(sizes):
            part = everything.where(F.col("batch") == batch).drop("batch")
            run = runs.add(part)
            dropped_in(part, spark.table(run), sizes[batch]).write.mode("append").parquet(out)
            runs.settle(run)
    finally:
        runs.close()
        remove(spark, staged)
    return spark.read.schema("holder long, body long, pos int").parquet(out) if sizes else spark.createDataFrame(
        [], "holder long, body long, pos int")


def _without(lines: str, places: str) -> Column:
    """The array without the elements at the sorted places: what lies between them, in one walk."""
    before = lambda i: F.when(i > 0, F.get(places, i - 1)).otherwise(-1)
    between = F.transform(places, lambda p, i: F.slice(lines, before(i) + 2, p - before(i) - 1))
    last = F.get(places, F.size(places) - 1)
    return F.concat(F.flatten(between), F.slice(lines, last + 2, F.size(lines) - last - 1))


def without_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_CHARS, batches: int = BATCHES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row; ``n_lines`` counts before dropping."""
    made: list[str] = []
    gone = dropped_lines(docs, id_column, text_column, least, batches, fan_out, made)
    # Rows that repeat id and text name the same places.
    places = stage("line-places")(gone.groupBy("holder", "body").agg(F.sort_array(F.collect_set("pos")).alias("places")))
    for path in made:
        remove(docs.sparkSession, path)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"))
    joined = rows.join(places.withColumnRenamed("holder", "_holder").withColumnRenamed("body", "_body"),
                       (F.col("doc_id") == F.col("_holder")) & (F.col("body") == F.col("_body")), "left")
    split = joined.select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_without("lines", "places"), "\n"))
    result = split.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    # A filter on the result is not pushed into the steps above.
    return result.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
