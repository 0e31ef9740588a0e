"""A Merkle manifest of a table, with a witness for every row, built by streaming aligned appends.

A leaf digests the columns of a row.  The leaves of a group, in order, form a tree: runs of three nodes become their digest
until one is left, the group's subroot; the subroots, in order, form the tree of the root.

*Appending.*  ``Appender`` takes nodes from left to right and holds one open run per level.  A node in an open run carries
a partial witness, the siblings it needs so far.  Every sibling that completes extends the witnesses of those before it and
starts with them; a run that is full becomes a node of the level above, to which the witnesses below then refer.

*Blocks.*  A group is cut at multiples of a power of three, so blocks are whole subtrees and can be appended side by side,
one sorted stream each.  The roots of blocks are the next round's nodes: further appends to the same tree, until each group
has one node.  A block's witness, from the rounds above it, is joined to the witnesses within.  So a group with
a third of all rows is spread like any other, and a task holds one block.

Leaves of a group come in the order of the id, then of the leaf; null ids first.  Rows that repeat are leaves of their own.
A null group is a group, before all others.  Null columns have a digest of their own, different from empty ones.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import remove, stage

ARITY = 3
# Levels of a block's subtree: 729 leaves.
BLOCK_LEVELS = 6
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows handed to Spark at once.
ROWS = 5_000
DIGEST = 32


def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """Hex digest of the values, each with its length in bytes; a null is a dash."""
    spelled = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[
        F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in spelled]), 256)


class Node:
    """A complete subtree: its digest, its siblings so far, and the subtree it became part of."""

    __slots__ = ("digest", "siblings", "above")

    def __init__(self, digest: str) -> None:
        self.digest, self.siblings, self.above = digest, [], None

    def witness(self) -> list[str]:
        """Siblings from here to the root, left to right in every run."""
        found, node = [], self
        while node is not None:
            found += node.siblings
            node = node.above
        return found


class Appender:
    """A tree that grows to the right."""

    def __init__(self) -> None:
        self.open: list[list[Node]] = []  # the open run of every level
        self.made: list[int] = []  # nodes so far of every level

    def append(self, digest_: str) -> Node:
        node = Node(digest_)
        self._add(node, 0)
        return node

    def _add(self, node: Node, level: int) -> None:
        if level == len(self.open):
            self.open.append([])
            self.made.append(0)
        run = self.open[level]
        self.made[level] += 1
        for before in run:
            before.siblings.append(node.digest)
            node.siblings.append(before.digest)
        run.append(node)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        above = Node(digest(node.digest for node in run))
        for node in run:
            node.above = above
        self._add(above, level + 1)

    def close(self, levels: int | None = None) -> str:
        """Complete what is open and return the root: at ``levels`` above the leaves, or where one node is left."""
        level = 0
        while True:
            if level == levels or (levels is None and self.made[level] == 1):
                return self.open[level][0].digest
            if self.open[level]:
                self._complete(level)
            level += 1


def fold(leaf: str, siblings: Sequence[str], place: int, count: int) -> tuple[str, Sequence[str]]:
    """The root of a tree of ``count`` leaves from the leaf at ``place``; also the siblings not used."""
    used = 0
    while count > 1:
        first = place - place % ARITY
        width = min(ARITY, count - first)
        run = list(siblings[used:used + width - 1])
        used += width - 1
        run.insert(place - first, leaf)
        leaf, place, count = digest(run), place // ARITY, -(-count // ARITY)
    return leaf, siblings[used:]


def _hex(raw: bytes) -> list[str]:
    return [raw[i:i + DIGEST].hex() for i in range(0, len(raw), DIGEST)]


def placed(rows: DataFrame, order: Sequence[str], made: list[str]) -> DataFrame:
    """Rows with their ``place`` in the ``tree`` and the tree's ``count``, sorted by Spark in ranges.

    Only sizes are brought together per tree, one number for every range.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = stage("merkle-ranges", made)(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", within))
    parts = Window.partitionBy("tree")
    before = F.sum("_n").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = stage("merkle-pieces", made)(
        ranged.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(parts).alias("count")))
    return ranged.join(broadcast_if_small(pieces), ["tree", "_part"]).withColumn(
        "place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def _append(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Append the sorted nodes of every block; each node comes back with its witness, each block's root as a row of its own."""
    block = ARITY**levels
    out: list[tuple] = []
    held: list[tuple] = []
    nodes: list[Node] = []
    tree, key, schema, at = Appender(), None, None, {}

    def finish() -> None:
        count = held[0][at["count"]]
        root = tree.close(levels if count > block else None)
        for row, node in zip(held, nodes):
            out.append((*row, False, bytes.fromhex("".join(node.witness()))))
        above = dict(tree=key[0], place=key[1], count=-(-count // block), node=bytes.fromhex(root))
        out.append((*[above.get(c) for c in at], True, b""))

    def rows() -> pa.RecordBatch:
        arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    for batch in batches:
        if schema is None:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            schema = pa.schema([*batch.schema, pa.field("is_root", pa.bool_()), pa.field("witness", pa.binary())])
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            this = row[at["tree"]], row[at["place"]] // block
            if this != key:
                if held:
                    finish()
                    if len(out) >= ROWS:
                        yield rows()
                held, nodes, tree, key = [], [], Appender(), this
            held.append(row)
            nodes.append(tree.append(row[at["node"]].hex()))
    if held:
        finish()
        yield rows()


def grown(nodes: DataFrame, levels: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes with their witness up to the root of their tree, and the roots: ``tree, node``.

    Nodes have ``tree, place, count, node``; other columns are carried.
    """
    rounds, current, block = [], nodes, ARITY**levels
    while True:
        most = current.agg(F.max("count")).first()[0] or 1
        columns = current.columns
        schema = T.StructType([*current.schema, T.StructField("is_root", T.BooleanType()), T.StructField("witness", T.BinaryType())])
        ordered = current.withColumn("_block", F.expr(f"place div {block}")).repartition("tree", "_block").sortWithinPartitions("tree", "place")
        done = stage("merkle-blocks", made)(ordered.select(*columns).mapInArrow(lambda batches: _append(batches, levels), schema))
        rounds.append(done.where("not is_root").drop("is_root"))
        current = done.where("is_root").select("tree", "place", "count", "node")
        if most <= block:
            break
    # From the top: what is above a block belongs to everything in it.
    above = None
    for done in reversed(rounds):
        if above is not None:
            over = broadcast_if_small(above.select("tree", F.col("place").alias("_block"), F.col("witness").alias("_above")))
            done = done.withColumn("_block", F.expr(f"place div {block}")).join(over, ["tree", "_block"]).withColumn(
                "witness", F.concat("witness", "_above")).drop("_block", "_above")
        above = done
    return above, current.select("tree", "node")


def manifest(
    docs: DataFrame, columns: Sequence[str] = LEAF_COLUMNS, group: str = "source", order: str = "doc_id",
    carry: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, witness, place, count, group_place, groups`` of every row, and ``carry``.

    ``witness`` are the siblings' digests end to end, level by level from the leaf to the root, left to right in a run.  Digests are
    binary; ``place`` and ``count`` tell the leaf's position in its group, ``group_place`` and ``groups`` the group's among all.
    """
    carried = carry or {}
    names = {name: f"carry_{k}" for k, name in enumerate(carried)}
    made: list[str] = []
    leaves = stage("merkle-leaves", made)(docs.select(
        F.col(order).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        F.unhex(leaf_digest(*[F.col(c) for c in columns])).alias("node"),
        F.monotonically_increasing_id().alias("nr"),  # spreads rows that repeat over ranges
        *[value.alias(names[name]) for name, value in carried.items()]))
    try:
        rows, subroots = grown(placed(leaves, ["id", "node", "nr"], made).drop("nr"), block_levels, made)
        tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node"), ["group"], made)
        groups, root = grown(tops, block_levels, made)
        only = root.first()  # one row at most
        of_group = stage("merkle-groups", made)(groups.select(
            F.col("group").alias("tree"), F.col("node").alias("subroot"), F.lit(bytes(only.node) if only else None).cast("binary").alias("root"),
            F.col("place").alias("group_place"), F.col("count").alias("groups"), F.col("witness").alias("_above")))
        result = rows.join(broadcast_if_small(of_group), "tree").select(
            F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.concat("witness", "_above").alias("witness"),
            "place", "count", "group_place", "groups", *[F.col(names[name]).alias(name) for name in carried])
        return stage("merkle-manifest")(result)
    finally:
        for path in made:
            remove(docs.sparkSession, path)


@F.pandas_udf(T.BinaryType())
def folded(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The root that a leaf and its witness lead to: leaf, witness, place, count, group_place, groups."""
    for leaf, witness, *at in rows:
        roots = []
        for node, raw, place, count, group_place, groups in zip(leaf, witness, *at):
            subroot, rest = fold(node.hex(), _hex(raw), place, count)
            roots.append(bytes.fromhex(fold(subroot, rest, group_place, groups)[0]))
        yield pd.Series(roots, dtype=object)


def folded_root(leaf: Column) -> Column:
    return folded(leaf, "witness", "place", "count", "group_place", "groups")


def text_of(digest_: Column) -> Column:
    return F.lower(F.hex(digest_))


def proof_digest() -> Column:
    """One digest of all siblings, from left to right and from the leaf to the root."""
    return F.sha2(text_of(F.col("witness")), 256)
