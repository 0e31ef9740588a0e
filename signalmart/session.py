"""Session settings the operators rely on, and a builder that applies them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles, splits hot join keys and picks broadcasts from
# measured sizes; everything else about the physical plan is left to Catalyst.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Shuffled bytes one task should get; it then sorts in memory next to its neighbours.
BYTES_PER_TASK = 128 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int, at_least: int = 200) -> int:
    """Setting for ``spark.sql.shuffle.partitions``: adaptive execution merges small partitions, but splits
    only the skewed ones, so the number has to fit the largest shuffle (for these plans, the articles)."""
    return max(at_least, -(-shuffled_bytes // BYTES_PER_TASK))


def build_session(app_name: str = "signalmart", master: str | None = None, **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments use ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
