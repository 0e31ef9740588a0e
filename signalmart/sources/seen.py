"""Keys seen on earlier days: a table bucketed by key, asked through a Bloom filter.

The filter has 64-bit words; a key sets ``BITS`` bits of one word, so it is tested by one lookup.  Both tables hold the
keys of a day as a partition of its own: a repeated run of a day replaces what that day added and looks at the days
before it only.  Rows of a day are dealt to the buckets to be compared, the history is never shuffled, and of its keys only
those reach the exact comparison whose bits are all set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.catalog import literal, quoted
from signalmart.sources.shared import stage

BITS = 4
# Bits of the filter per key that is expected.
BITS_PER_KEY = 10


@dataclass(frozen=True)
class SeenKeys:
    """Two tables of the catalog: ``table`` with the keys, ``table_filter`` with the filter.

    ``expected`` keys size the filter; more make it pass more keys on to the exact comparison, not wrong.  It must not
    change once days were added.  Keys with a null are never seen.
    """

    spark: SparkSession
    table: str
    keys: tuple[str, ...]
    expected: int = 100_000_000
    location: str | None = None

    @property
    def words(self) -> int:
        return max(1, self.expected * BITS_PER_KEY // 64)

    def create(self, buckets: int | None = None) -> SeenKeys:
        """Create the tables if they do not exist; as many buckets as a shuffle has partitions, by default."""
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = ", ".join(map(quoted, self.keys))
        for name, columns, by in (
            (self.table, ", ".join(f"{quoted(k)} string" for k in self.keys), keys),
            (f"{self.table}_filter", "word bigint, bits bigint", "word"),
        ):
            place = f" LOCATION {literal(self.location + '/' + name.rsplit('.', 1)[-1])}" if self.location else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({columns}, first_day string) USING parquet "
                           f"PARTITIONED BY (first_day) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS{place}")
        return self

    def _word(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.words).cast("bigint"))

    def _mask(self) -> Column:
        number = F.xxhash64(F.lit("bits"), *self.keys)
        mask = F.lit(0).cast("bigint")
        for k in range(BITS):
            place = F.shiftrightunsigned(number, 6 * k).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
        return mask

    def _before(self, table: str, day: str) -> DataFrame:
        return self.spark.table(quoted(table)).where(F.col("first_day") < day)

    def likely(self, candidates: DataFrame, day: str) -> DataFrame:
        """The keys whose bits an earlier day has set: all that were seen and a few more."""
        asked = candidates.withColumns({"_word": self._word(), "_mask": self._mask()})
        words = self._before(f"{self.table}_filter", day).select("word", "bits")
        held = F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
        return asked.join(words, (F.col("_word") == F.col("word")) & held, "left_semi").select(*self.keys)

    def seen(self, df: DataFrame, day: str) -> DataFrame:
        """Which keys of ``df`` were seen before ``day``."""
        candidates = df.select(*self.keys).dropna().distinct()
        return self.likely(candidates, day).join(self._before(self.table, day).select(*self.keys), list(self.keys), "left_semi")

    def unseen(self, df: DataFrame, day: str) -> DataFrame:
        """The rows of ``df`` whose key was not seen before ``day``."""
        known = stage("seen-keys")(self.seen(df, day))
        return df.join(broadcast_if_small(known), list(self.keys), "left_anti")

    def add(self, df: DataFrame, day: str) -> None:
        """Remember the keys of ``df`` as seen on ``day``, in place of what was added for that day before."""
        keys = df.select(*self.keys).dropna().distinct()
        filled = keys.select(self._word().alias("word"), self._mask().alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        for table, rows, by in ((self.table, keys, self.keys), (f"{self.table}_filter", filled, ("word",))):
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.sql(f"INSERT OVERWRITE TABLE {quoted(table)} PARTITION (first_day = {literal(day)}) SELECT * FROM {{rows}}",
                           rows=rows.repartition(n, *by))
