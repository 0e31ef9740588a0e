"""Exact de-duplication by distributed MSD radix partitioning.

Texts are split by their length and first bytes, groups of more than one are split by the
next bytes, and so on until a group is a single text or its texts have ended.
Groups that ended hold equal texts: every byte was compared, no digest decides.  The digits
grow eightfold with every level, so a text of n bytes takes about log8(n) levels, and
only texts that still share everything so far go on to the next level.

Null text counts as empty.  The row with the largest id stays; null ids are smallest, and of
rows with the same id one stays.  Other columns are not looked at.  An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import remove, shared_folder, stage

FIRST_DIGIT = 32
GROWTH = 8


def _digit(rest: Column, width: int) -> Column:
    return F.substring(rest, 1, width)


def _singles(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lit(0).cast("long").alias("row"), F.col("doc_id").alias("keep_id"),
                       F.lit(0).cast("long").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), "text_sha256")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_column).alias("doc_id"), body.alias("rest"))
    first = {"length": F.octet_length("rest").cast("long"), "digit": _digit(F.col("rest"), FIRST_DIGIT)}
    sha = F.sha2("rest", 256).alias("text_sha256")

    # Level 0 runs on narrow rows: most texts differ from all others in length or first bytes.
    narrow = stage("radix-narrow")(texts.withColumns(first).select("doc_id", "length", "digit", sha))
    shared = stage("radix-shared")(
        narrow.groupBy("length", "digit").agg(F.count("*").alias("n")).where("n > 1")
        .select("length", "digit", F.monotonically_increasing_id().alias("gid")))
    done = [_singles(narrow.join(shared, ["length", "digit"], "left_anti"))]

    path = shared_folder(spark, "radix-active")
    texts.withColumns(first).join(broadcast_if_small(shared), ["length", "digit"]).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "gid", "length", sha,
        F.expr(f"substring(rest, {FIRST_DIGIT + 1})").alias("rest"),
    ).write.parquet(path)
    active, seen, width = spark.read.parquet(path), FIRST_DIGIT, FIRST_DIGIT * GROWTH
    while not active.isEmpty():
        parts = stage("radix-parts")(
            active.select("gid", "doc_id", "row", "length", _digit(F.col("rest"), width).alias("digit"))
            .groupBy("gid", "digit", "length")
            .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
            .select("*", F.monotonically_increasing_id().alias("next_gid")))
        ended = parts["length"] <= seen + width
        settled = active.withColumn("digit", _digit(F.col("rest"), width)).drop("length").join(
            parts.where((F.col("group_size") == 1) | ended), ["gid", "digit"])
        done.append(stage("radix-done")(settled.select(
            "doc_id", "row", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size",
            "text_sha256")))
        following = shared_folder(spark, "radix-active")
        active.withColumn("digit", _digit(F.col("rest"), width)).drop("length").join(
            parts.where((F.col("group_size") > 1) & ~ended), ["gid", "digit"],
        ).select("doc_id", "row", F.col("next_gid").alias("gid"), "length", "text_sha256",
                 F.expr(f"substring(rest, {width + 1})").alias("rest")).write.parquet(following)
        remove(spark, path)
        path, active = following, spark.read.schema(active.schema).parquet(following)
        seen, width = seen + width, width * GROWTH
    remove(spark, path)

    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_row") == F.col("row"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; rows that repeat id and text leave one."""
    keys = stage("radix-copies")(
        exact_groups(docs).where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
        .agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_n")))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)

    def matching(keys: DataFrame, how: str) -> DataFrame:
        keys = broadcast_if_small(keys)
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (sha == keys["_sha"]), how)

    repeated = stage("radix-repeated")(keys.where("_kept and _n > 1").select("_id", "_sha"))
    if repeated.isEmpty():
        return matching(keys.where("not _kept").select("_id", "_sha"), "left_anti")
    once = matching(repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return matching(keys.where("not _kept or _n > 1").select("_id", "_sha"), "left_anti").unionByName(once)
