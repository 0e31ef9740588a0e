"""What a daily run leaves for the next one: small tables, one folder per day.

A run reads the days before its own and replaces its own, so it can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart.operators.moments import merged
from signalmart.sources.bronze import read_or_empty
from signalmart.sources.shared import stage


@dataclass(frozen=True)
class DayState:
    """The states below one folder, by name."""

    spark: SparkSession
    root: str

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, day: str) -> None:
        """Keep ``df`` as the state of ``day``, in place of what was kept for it."""
        df.write.mode("overwrite").parquet(f"{self._folder(name)}/state_day={day}")

    def before(self, name: str, day: str, schema: T.StructType) -> DataFrame:
        """All that was kept on days before, with its ``state_day``."""
        kept = read_or_empty(self.spark, self._folder(name), T.StructType([*schema, T.StructField("state_day", T.StringType())]), "parquet")
        return kept.where(F.col("state_day") < day)

    def latest(self, name: str, day: str, schema: T.StructType) -> DataFrame | None:
        """What the last day before ``day`` has kept; nothing on a first run."""
        kept = self.before(name, day, schema)
        last = kept.agg(F.max("state_day")).first()[0]
        return None if last is None else kept.where(F.col("state_day") == last).drop("state_day")

    def compact(self, name: str, day: str, schema: T.StructType, keys: list[str]) -> None:
        """Merge the moments of all days before ``day`` into one part, which then counts as the last of these days."""
        kept = self.before(name, day, schema)
        last = kept.agg(F.max("state_day")).first()[0]
        if last is None:
            return
        whole = stage("moments")(merged(kept, keys, "state_day"))
        old = [r.state_day for r in kept.select("state_day").distinct().collect() if r.state_day != last]  # one per day
        self.write(whole, name, last)
        for gone in old:
            self.write(whole.where("false"), name, gone)
