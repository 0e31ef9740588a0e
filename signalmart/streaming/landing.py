"""Landing raw response files as they arrive, with Structured Streaming.

The stream's checkpoint remembers which files were taken, so a run handles just the
new ones: the incremental alternative to ``operators.landing.skip_existing``.  Series
operators need whole histories, so silver and gold stay batch jobs over what has landed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signalmart.sources.bronze import write_bronze


def land_new_files(
    spark: SparkSession, raw_path: str, raw_schema: T.StructType, shape: Callable[[DataFrame], DataFrame],
    root: str, source: str, checkpoint: str, day: str | None = None, fmt: str = "json",
    max_files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Shape the raw files that are new below ``raw_path``, append them to bronze, then stop.

    A batch that failed half-way is written again by the next run; the silver tables
    de-duplicate what lands twice.
    """
    raw = spark.readStream.schema(raw_schema).option("maxFilesPerTrigger", max_files_per_batch).format(fmt).load(raw_path)

    def land(batch: DataFrame, batch_id: int) -> None:
        write_bronze(shape(batch), root, source, day)

    writer = raw.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(land).start()
