"""N-gram Jaccard join over count vectors in R-trees.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold.

*Which sets meet.*  Any set that links to one of n shingles shares ``percent`` of the n, so if all sets order their shingles
alike, linked sets have one of the first ``n - needed + 1`` in common.  The order puts frequent shingles last: all
shingles of the corpus are counted in a table of ``COUNTERS`` hashed counters, whose size does not depend on the corpus.
Rows of (shingle, set) are sorted by Spark and read in one stream, which yields the meetings of two and more sets.

*Points.*  The shingles of a set are hashed into groups, and the set becomes the point of its group counts.  The points of a
meeting are bulk loaded into an R-tree.  The sum of coordinate minima of a point and a node's upper corner bounds
the overlap with everything below the node.  What passes in the leaves strings sets together; no link is lost, and of those that
just met by chance hardly any pass.

*Verification.*  Each connected component of such strings is searched on its own, with finer points, and what passes is verified
on the full sets.  Pairs that earlier links already connect are not verified again.
A component that is too large for one task is cut into tiles (``search``).

Equal sets are one point from the start, so copies never multiply.  Sets are compared as 64-bit hashes.

Null text and text without words: an empty set, linked with nothing.  Null ids: never the name of a component; where all
ids of a component are null, so is its name.  Rows that repeat id and text get the same answer.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches
from signalmart.llm.components import components
from signalmart.llm.shingles import mix, shingle_set
from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import stage

# Hashed counters of shingles: their number bounds what is sent to every worker.
COUNTERS = 1 << 20
SLICES = 64
FAN_OUT = 16
# Sets that one meeting gathers.
CROWD = 20_000
# Groups of a point, at most.
MOST_GROUPS = 1 << 14
# Shingles of the sets that one task holds while it searches.
TILE_SHINGLES = 4_000_000
# Sets that are compared with all others first: of a large component with its tiles, of a group with its members.
HUBS = 16


@dataclass(frozen=True)
class Threshold:
    """``percent`` of the union must be shared."""

    percent: int

    def needed(self, total):
        """The least overlap of two linked sets with ``total`` elements between them."""
        return -(-self.percent * total // (100 + self.percent))

    def linked(self, overlap: int, total: int) -> bool:
        return 100 * overlap >= self.percent * (total - overlap)

    def leading(self, n: int) -> int:
        """How many of n shingles a linked set cannot miss altogether."""
        return n - -(-self.percent * n // 100) + 1


def count_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Counters of all shingles of all documents, each counted once a document.

    Tasks send their counters in slices, which are added up slice by slice, in two steps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 64):
                found = [shingle_set(text, words) for text in batch["text"].iloc[at:at + 64]]
                total += np.bincount(counter(np.concatenate(found)), minlength=COUNTERS)
        yield from sliced({k: part for k, part in enumerate(np.split(total, SLICES)) if part.any()})

    def sliced(parts: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        if parts:
            yield pd.DataFrame({"slice": pd.Series(list(parts), dtype="int64"), "counts": [zlib.compress(v.tobytes(), 1) for v in parts.values()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["slice"].tolist(), batch["counts"]):
                part = np.frombuffer(zlib.decompress(data), dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield from sliced(sums)

    schema = "slice long, counts binary"
    parts = docs.select("text").mapInPandas(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    parts = parts.repartition("slice", "salt").drop("salt").mapInPandas(added, schema)
    out = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
    for row in parts.repartition("slice").mapInPandas(added, schema).toLocalIterator():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.ravel()


def counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def leading_shingles(shingles: np.ndarray, counts: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The rarest shingles of a set, as many as a linked set cannot miss."""
    order = np.lexsort((shingles, counts[counter(shingles)]))
    return shingles[order[:threshold.leading(len(shingles))]].view(np.int64)


def owner_of(shingles: np.ndarray) -> int:
    """The name of a set: 64 bits of a hash of its shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def point_of(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by group, about eight a group, one byte each or, where one does not fit, all in four."""
    groups = 1 << int(np.clip(np.ceil(np.log2(max(1, len(shingles)) / 8)), 4, np.log2(MOST_GROUPS)))
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return bytes([int(counts.max() > 255)]) + counts.astype(np.uint32 if counts.max() > 255 else np.uint8).tobytes()


def same_groups(points: list[bytes]) -> np.ndarray:
    """Points brought to the coarsest grouping among them: halves of a finer one are added up."""
    counts = [np.frombuffer(p, dtype=np.uint32 if p[0] else np.uint8, offset=1).astype(np.int32) for p in points]
    groups = min(map(len, counts))
    return np.stack([c.reshape(-1, groups).sum(axis=0) for c in counts]).astype(np.int32)


def sketch(docs: DataFrame, words: int, threshold: Threshold, counts: Broadcast) -> DataFrame:
    """``doc_id, text_hash, n, owner, leading, point`` of every document; the last two only for the first of equal sets in a batch."""

    @F.pandas_udf("n long, owner long, leading array<long>, point binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, owners, leading, points, seen = [], [], [], [], set()
            for text in batch:
                found = shingle_set(text, words)
                owner = owner_of(found)
                fresh = len(found) and owner not in seen
                sizes.append(len(found))
                owners.append(owner)
                leading.append(leading_shingles(found, counts.value, threshold) if fresh else None)
                points.append(point_of(found) if fresh else None)
                seen.add(owner)
            yield pd.DataFrame({"n": sizes, "owner": owners, "leading": pd.Series(leading, dtype=object),
                                "point": pd.Series(points, dtype=object)})

    return with_text_hash(docs).select("doc_id", "text_hash", run("text").alias("_s")).select("doc_id", "text_hash", "_s.*")


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def meetings(sketches: DataFrame, threshold: Threshold, crowd: int = CROWD) -> DataFrame:
    """``meeting, owner, loose`` of sets of comparable size that share a leading shingle; meetings of the same sets are one.

    Rows of a shingle come by size, and a step too large for a link ends a meeting.  More than ``crowd`` sets are not
    gathered: each is ``loose``, a string from the first of them, whose name the meeting then has.
    """

    def found(starts: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
        size = np.diff(np.concatenate([starts, [len(owner)]]))
        row = np.repeat(np.arange(len(starts)), size)
        distinct = np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
        row, owner = row[distinct], owner[distinct]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        name = np.add.reduceat(mix(owner.view(np.uint64)), starts).view(np.int64)
        keep = np.bincount(row)[row] > 1
        return pd.DataFrame({"meeting": name[row][keep], "owner": owner[keep], "loose": False}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        head = None  # shingle, last size and first set of a crowd that goes on
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            shingle, size, owner = (batch[c].to_numpy() for c in ("shingle", "n", "owner"))
            fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (threshold.percent * size[1:] > 100 * size[:-1])])
            starts = np.flatnonzero(fresh)
            if head is not None:
                if shingle[0] == head[0] and threshold.percent * size[0] <= 100 * head[1]:
                    end = int(starts[1]) if len(starts) > 1 else len(owner)
                    yield pd.DataFrame({"meeting": head[2], "owner": owner[:end], "loose": True})
                    head = (head[0], size[end - 1], head[2])
                    starts = starts[1:] - end
                    shingle, size, owner = shingle[end:], size[end:], owner[end:]
                    if not len(owner):
                        held = None
                        continue
                head = None
            last = int(starts[-1])
            if last:
                yield found(starts[:-1], owner[:last])
            held = pd.DataFrame({"shingle": shingle[last:], "n": size[last:], "owner": owner[last:]})
            if len(held) > crowd:
                head, held = (shingle[-1], size[-1], owner[last]), None
                yield pd.DataFrame({"meeting": head[2], "owner": owner[last + 1:], "loose": True})
        if held is not None and len(held) > 1:
            yield found(np.zeros(1, dtype=np.int64), held["owner"].to_numpy())

    rows = sketches.select("owner", "n", F.explode("leading").alias("shingle"))
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n", "owner").mapInPandas(
        run, "meeting long, owner long, loose boolean").distinct()


def strings(met: DataFrame, points: DataFrame, threshold: Threshold) -> DataFrame:
    """Edges ``a, b`` that string together the sets of a meeting whose points allow a link."""

    def bounded(owners: list[int], sizes: np.ndarray, points: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(owners) == 2:
            small, large = sorted(map(int, sizes))
            if 100 * small >= threshold.percent * large:
                bound = int(np.minimum(*same_groups(points)).sum())
                if bound >= threshold.needed(small + large):
                    yield owners[0], owners[1]
            return
        counts = same_groups(points)
        tree = CountTree(counts, sizes)
        for i, j in connections(len(owners), lambda i: tree.search(counts[i], int(sizes[i]), threshold)):
            yield owners[i], owners[j]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            name = rows["meeting"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, int)
            edges: list[tuple[int, int]] = []
            owners, sizes, points = rows["owner"].tolist(), rows["n"].to_numpy(), rows["point"].tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                edges += bounded(owners[a:b], sizes[a:b], points[a:b])
            held = rows.iloc[cuts[-1]:] if len(cuts) else rows
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
        if held is not None and len(held):
            yield pd.DataFrame(list(bounded(held["owner"].tolist(), held["n"].to_numpy(), held["point"].tolist())),
                               columns=["a", "b"], dtype="int64")

    rows = met.where("not loose").join(points, "owner").select("meeting", "owner", "n", "point")
    close = rows.repartition("meeting").sortWithinPartitions("meeting", "owner").mapInPandas(run, "a long, b long")
    return close.unionByName(met.where("loose").select(F.col("meeting").alias("a"), F.col("owner").alias("b"))).distinct()


def connections(
    n: int, near: Callable[[int], np.ndarray], linked: Callable[[int, int], bool] | None = None, asking: Sequence[int] | None = None,
) -> list[tuple[int, int]]:
    """Pairs that connect what is connected by ``near`` members (that are ``linked``, if given).

    What is connected already is never looked at again.  A few members ask first, each one outside the largest part so far;
    then only those still outside it ask, as two members inside it need no further pair.  So a group of near copies is walked a few times,
    not once a member.  With ``asking``, just these ask.
    """
    labels = np.arange(n)
    todo = np.ones(n, dtype=bool)
    edges: list[tuple[int, int]] = []

    def ask(i: int) -> None:
        todo[i] = False
        found = near(i)
        found = found[labels[found] != labels[i]]
        if not len(found):
            return
        if linked is None:
            _, first = np.unique(labels[found], return_index=True)
            chosen = found[first].tolist()
        else:
            parts: set[int] = set()
            chosen = []
            for j, part in zip(found.tolist(), labels[found].tolist()):
                if part not in parts and linked(i, j):
                    parts.add(part)
                    chosen.append(j)
        if chosen:
            edges.extend((i, j) for j in chosen)
            labels[np.isin(labels, labels[chosen])] = labels[i]

    if asking is not None:
        for i in asking:
            ask(i)
        return edges
    for _ in range(HUBS):
        outside = np.flatnonzero(todo & (labels != np.bincount(labels).argmax()))
        if not len(outside):
            return edges
        ask(int(outside[0]))
    main = int(np.flatnonzero(labels == np.bincount(labels).argmax())[0])
    for i in np.flatnonzero(todo).tolist():
        if labels[i] != labels[main]:
            ask(i)
    return edges


class CountTree:
    """R-tree over points of group counts, bulk loaded; nodes keep their upper corner and their range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN_OUT:
            corner, low, high = self.levels[-1]
            starts = np.arange(0, len(corner), FAN_OUT)
            self.levels.append((np.maximum.reduceat(corner, starts), np.minimum.reduceat(low, starts),
                                np.maximum.reduceat(high, starts)))

    def search(self, point: np.ndarray, size: int, threshold: Threshold) -> np.ndarray:
        """Points whose summed minima reach what a link needs, best first."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            at = at[(threshold.percent * low[at] <= 100 * size) & (100 * high[at] >= threshold.percent * size)]
            bound = np.minimum(corner[at], point).sum(axis=1, dtype=np.int64)
            smallest = np.maximum(low[at], -(-threshold.percent * size // 100))
            fits = bound >= threshold.needed(size + smallest)
            at, bound = at[fits], bound[fits]
            if depth:
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                at = at[at < below]
        return self.order[at[np.argsort(-bound, kind="stable")]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def local_links(owners: list[int], sets: list[np.ndarray], asks: list[bool], threshold: Threshold) -> list[tuple[int, int]]:
    """Links that connect what is connected; where some sets ask, only their pairs with the others are searched."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = 1 << int(np.clip(np.ceil(np.log2(max(1.0, sizes.mean() / 3))), 6, 11))
    points = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
    across = any(asks)
    indexed = [i for i, asking in enumerate(asks) if not asking]
    if not indexed:
        return []
    tree, at = CountTree(points[indexed], sizes[indexed]), np.array(indexed)
    name = np.array(owners)

    def near(i: int) -> np.ndarray:
        found = at[tree.search(points[i], int(sizes[i]), threshold)]
        return found[name[found] != name[i]]

    def linked_(i: int, j: int) -> bool:
        return threshold.linked(overlap(sets[i], sets[j]), int(sizes[i] + sizes[j]))

    pairs = connections(len(sets), near, linked_, [i for i, asking in enumerate(asks) if asking] if across else None)
    return [(owners[i], owners[j]) for i, j in pairs]


def _cells(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Links of each ``cell`` of ``cell, asks, owner, shingles``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("owner")
        found = local_links(rows["owner"].tolist(), [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]],
                            rows["asks"].tolist(), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cell").applyInPandas(run, "a long, b long")


def _copies(rows: DataFrame, times: DataFrame, count: str, name: str) -> DataFrame:
    """Every row once for each number below its component's ``count``."""
    numbers = times.where(F.col(count) > 0).select("component", F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name))
    return rows.join(numbers, "component")


def search(sets: DataFrame, threshold: Threshold, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links ``a, b`` within each component of ``component, owner, n, shingles``.

    A component that fits into a tile is searched at once.  The tiles of a larger one are searched each on
    its own, then against a few hubs, which connects what is densely linked.  What is then not in the component's main
    part is searched against all tiles; pairs within the main part are connected already.  So a large group of near
    copies is moved a fixed number of times, not once for every pair of tiles.
    """
    tiles = stage("join-tiles")(sets.groupBy("component").agg(
        F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles"), F.count("*").alias("members")))
    placed = sets.join(tiles.select("component", "tiles"), "component").withColumn(
        "tile", F.pmod(F.hash("owner"), F.col("tiles")))
    cell = F.concat_ws(":", "component", "tile")
    alone = stage("join-alone")(_cells(
        placed.select(cell.alias("cell"), F.lit(False).alias("asks"), "owner", "shingles"), threshold))
    large = tiles.where("tiles > 1")
    if large.isEmpty():
        return alone
    members = placed.where("tiles > 1").drop("tiles")
    of_members = members.select(cell.alias("cell"), F.lit(False).alias("asks"), "owner", "shingles")

    by_owner = Window.partitionBy("component").orderBy("owner")
    hubs = sets.select("component", "owner").join(large, "component").withColumn("_k", F.row_number().over(by_owner)).where(
        F.col("_k") <= HUBS).select("component", "owner")
    asking = _copies(sets.join(hubs, ["component", "owner"]), large, "tiles", "tile").select(
        cell.alias("cell"), F.lit(True).alias("asks"), "owner", "shingles")
    to_hubs = stage("join-hubs")(alone.unionByName(_cells(of_members.unionByName(asking), threshold)))

    known = components(to_hubs).withColumnsRenamed({"node": "owner", "component": "part"})
    parts = stage("join-parts")(members.select("component", "owner", "n").join(known, "owner", "left").withColumn(
        "part", F.coalesce("part", "owner")))
    main = parts.groupBy("component", "part").count().groupBy("component").agg(
        F.max(F.struct("count", "part"))["part"].alias("part"))
    outside = parts.join(main, ["component", "part"], "left_anti").select("component", "owner", "n")
    blocks = stage("join-blocks")(outside.groupBy("component").agg(
        F.ceil(F.sum("n") / tile_shingles).cast("int").alias("blocks")).join(large, "component"))
    outside = members.join(outside.drop("n"), ["component", "owner"], "left_semi").join(
        blocks.select("component", "blocks"), "component").withColumn(
        "block", F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int")).drop("tile")
    cell = F.concat_ws(":", "component", "tile", "block")
    columns = [cell.alias("cell"), "asks", "owner", "shingles"]
    rows = _copies(members, blocks, "blocks", "block").withColumn("asks", F.lit(False)).select(*columns).unionByName(
        _copies(outside, blocks, "tiles", "tile").withColumn("asks", F.lit(True)).select(*columns))
    return to_hubs.unionByName(_cells(rows, threshold))


def linked(
    docs: DataFrame, words: int = 3, percent: int = 90, tile_shingles: int = TILE_SHINGLES, crowd: int = CROWD,
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, owner, component_id``: every document with its component of linked documents."""
    threshold = Threshold(percent)
    bound_batches(docs.sparkSession)
    counts = docs.sparkSession.sparkContext.broadcast(count_shingles(docs, words))
    sketches = stage("join-sketches")(sketch(docs, words, threshold, counts))
    met = stage("join-meetings")(meetings(sketches, threshold, crowd))
    points = sketches.where("point is not null").select("owner", "n", "point").dropDuplicates(["owner"])
    around = stage("join-around")(components(stage("join-strings")(strings(met, points, threshold))))

    # The full sets of those that met others: their texts are read again.
    first = sketches.where("n > 0").groupBy("owner").agg(F.min(F.struct("doc_id", "text_hash")).alias("_f")).select(
        "owner", "_f.*")
    asked = stage("join-asked")(first.join(around.select(F.col("node").alias("owner")), "owner", "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    small = broadcast_if_small(asked)
    texts = with_text_hash(docs)
    texts = texts.join(small, texts["doc_id"].eqNullSafe(small["_id"]) & (texts["text_hash"] == small["_hash"]), "left_semi")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [shingle_set(text, words) for text in batch["text"].iloc[at:at + 256]]
                yield pd.DataFrame({"owner": [owner_of(s) for s in found], "n": [len(s) for s in found],
                                    "shingles": [s.tobytes() for s in found]})

    sets = stage("join-sets")(
        texts.select("text").mapInPandas(full, "owner long, n long, shingles binary")
        .join(around.withColumnRenamed("node", "owner"), "owner").dropDuplicates(["owner"]))
    links = stage("join-links")(search(sets, threshold, tile_shingles))
    joined = components(links).withColumnRenamed("node", "owner")

    named = sketches.where("n > 0").groupBy("owner").agg(F.min("doc_id").alias("_least")).join(joined, "owner", "left") \
        .withColumn("component", F.coalesce("component", "owner"))
    names = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_owner = stage("join-names")(named.select("owner", "component").join(names, "component").select("owner", "component_id"))
    rows = sketches.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "owner")
    return rows.where("n_shingles > 0").join(of_owner, "owner").unionByName(
        rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def document_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    return linked(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, with its own columns; all without words stay.

    Of a component without ids all rows stay; rows that share the smallest id stay as well.
    """
    rows = linked(docs, words, percent).where(
        "component_id is not null and (doc_id is null or doc_id != component_id)")
    gone = stage("join-gone")(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    gone = broadcast_if_small(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")
