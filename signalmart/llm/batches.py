"""Size of the batches that tasks hand to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, because texts may be long; a smaller bound is left as it is.

    Rows alone (10,000 a batch by default) would let very long texts fill a worker's memory.
    """
    now = spark.conf.get(SETTING).rstrip("b")  # with a unit, as the default has
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(SETTING, str(BATCH_BYTES))
