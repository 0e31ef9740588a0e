"""Row counts of several places in a plan, collected from the one run that computes its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counts:
    """Named places whose rows are counted while they pass.

    ``at`` marks a place and leaves the rows as they are.  Once the result of a plan with the mark was written or collected,
    ``rows`` has its number; no job counts.  Of a place that is run twice the first run counts.
    """

    def __init__(self) -> None:
        self.observations: dict[str, Observation] = {}

    def at(self, df: DataFrame, name: str) -> DataFrame:
        if name in self.observations:
            raise ValueError(f"there is a place {name!r} already")
        self.observations[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self.observations[name], F.count("*").alias("rows"))

    def rows(self) -> dict[str, int]:
        """Waits for the runs that hold the places."""
        return {name: observation.get["rows"] for name, observation in self.observations.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows().items()), "stage string, n_rows long")
