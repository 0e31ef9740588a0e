"""Source divergence audit: how far the sources of a language are apart in the words they use, in exact integers.

*First pass.*  Tasks count in how many documents of a language a term stands and hand on partial counts; terms in at least ``least``
documents of a language are its vocabulary.

*Perfect hashes.*  The vocabulary is cut into shards, and every shard gets a minimal perfect hash: keys are dealt into small buckets,
and each bucket, largest first, takes the first displacement that puts all its keys on free slots; buckets of one key take what is left.
The hashes are broadcast with their keys, because a term that is not in the vocabulary has a slot as well: only comparing it with the stored key
tells.

*Second pass.*  Tasks count the terms of every (language, source) group and add them to the group's dense slots.  What is shuffled
are blocks of these slots, without the empty ones; they are added up as they come in, one block at a time.

*Bound.*  At most ``head_keys`` terms of ``head_bytes`` are broadcast, those in most documents, which are nearly all
occurrences; a task holds at most ``DENSE`` slots and hands them on when it would need more.  Terms beyond the bound are
counted in the same pass, shuffled as text and joined to the vocabulary, so the result is the same.

Probabilities, distances and sums are integers.  Sources are compared block by block, all sources of a language side by
side; the more sources, the fewer slots a block has.  A block hands on its first terms of each source and its sums.

Null text, language and source are taken as empty.  Rows that repeat are documents of their own.  Groups without terms take
part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches
from signalmart.llm.shingles import mix
from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import stage

LEAST = 3
UNIT = 1_000_000_000
RANKS = 200
# Broadcast vocabulary at most, keys of a shard and of a bucket, on average.
HEAD_KEYS = 2_000_000
HEAD_BYTES = 64 * 1024 * 1024
SHARD_KEYS = 10_000
BUCKET_KEYS = 4
# Terms a task counts before it looks them up or hands them on, slots it holds, slots of a block, cells of a block with all sources.
PENDING = 300_000
DENSE = 16_000_000
# Occurrences a slot of four bytes takes.
MOST_TOKENS = 2**30
BLOCK = 4_096
CELLS = 2_000_000
# Counts beyond this need more than 64 bits on the way.
LARGE = 2**63 // UNIT - 2
SEED = 42  # of Spark's xxhash64
STEP = np.uint64(0x9E37_79B9_7F4A_7C15)

# A-Z become a-z, every other ASCII character but a-z a space; bytes of longer characters stay.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(FOLD).split()


def key_of(term: bytes, lang: str) -> bytes:
    """Terms hold no zero byte."""
    return term + b"\0" + lang.encode()


def plain(docs: DataFrame) -> DataFrame:
    text, *names = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source"))
    return docs.select(*[n.alias(c) for n, c in zip(names, ("lang", "source"))], text.cast("binary").alias("body"))


# --- vocabulary ------------------------------------------------------------------------

def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        flat = [(lang, term, n) for lang, found in counts.items() for term, n in found.items()]
        counts.clear()
        columns = list(zip(*flat)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(values, type) for values, type in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "term", "n_docs"])

    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(set(terms_of(body)))
            if sum(map(len, counts.values())) > PENDING:
                yield rows()
    yield rows()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term, n_docs`` of the terms in enough documents of the language; terms are UTF-8 bytes."""
    parts = plain(docs).select("lang", "body").mapInArrow(_document_counts, "lang string, term binary, n_docs long")
    return parts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least)


def head_from(kept: DataFrame, head_keys: int, head_bytes: int) -> int:
    """The least power (of the fourth root of two) of document counts whose terms still fit into the broadcast."""
    size = F.octet_length("term") + F.octet_length("lang") + 17
    bins = kept.groupBy(_power().alias("power")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    keys, held, lowest = 0, 0, 10_000
    for row in sorted(bins, key=lambda r: -r.power):
        keys, held = keys + row.n, held + row.bytes
        if keys > head_keys or held > head_bytes:
            break
        lowest = row.power
    return lowest


def _power() -> Column:
    return F.floor(4 * F.log2("n_docs")).cast("int")


# --- perfect hashes --------------------------------------------------------------------

def displaced(hashes: np.ndarray, displacement: np.ndarray | int, size: int) -> np.ndarray:
    return (mix(hashes + np.asarray(displacement, dtype=np.uint64) * STEP) % np.uint64(size)).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: np.ndarray | int) -> np.ndarray:
    return (mix(hashes ^ STEP) % np.asarray(buckets, dtype=np.uint64)).astype(np.int64)


def minimal_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slots of the given (different) hashes: a permutation of all slots.

    A displacement below zero names the slot of the bucket's only key.
    """
    n = len(hashes)
    buckets = -(-n // BUCKET_KEYS)
    of = bucket_of(hashes, buckets)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    displacements, slots, free = np.zeros(buckets, dtype=np.int64), np.empty(n, dtype=np.int64), np.ones(n, dtype=bool)
    sizes = np.diff(starts)
    for bucket in np.argsort(-sizes, kind="stable").tolist():
        members = order[starts[bucket]:starts[bucket + 1]]
        if len(members) < 2:
            break
        first = 0
        while True:
            tried = np.arange(first, first + 64)
            places = displaced(hashes[members][None, :], tried[:, None], n)
            ordered = np.sort(places, axis=1)
            fits = free[places].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                chosen = int(fits.argmax())
                displacements[bucket], slots[members] = tried[chosen], places[chosen]
                free[places[chosen]] = False
                break
            first += 64
            if first > 1 << 24:
                raise ValueError("two keys of a shard have the same hash")
    left = iter(np.flatnonzero(free).tolist())
    for bucket in np.flatnonzero(sizes == 1).tolist():
        slot = next(left)
        displacements[bucket], slots[order[starts[bucket]]] = -1 - slot, slot
    return displacements, slots


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    hashes = pdf["hash"].to_numpy().astype(np.uint64)
    displacements, slots = minimal_hash(hashes)
    terms: list[bytes] = [b""] * len(slots)
    for slot, term in zip(slots.tolist(), pdf["term"]):
        terms[slot] = bytes(term)
    return pd.DataFrame({"shard": [int(pdf["shard"].iat[0])], "displacements": [displacements.tolist()], "terms": [terms]})


@dataclass(frozen=True)
class PerfectHash:
    """The broadcast table: slots are numbered through all shards of a language, from 0 for each language."""

    langs: dict[str, tuple[int, int, int, int]]  # first shard, shards, first slot, slots
    first_bucket: np.ndarray
    first_slot: np.ndarray  # by shard; one more at the end, as above
    displacements: np.ndarray
    key_ends: np.ndarray
    keys: bytes

    def find(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """Slots of different terms within the language, -1 for those not in it."""
        if lang not in self.langs or not terms:
            return np.full(len(terms), -1)
        shard, shards, base, _ = self.langs[lang]
        suffix = b"\0" + lang.encode()
        hashes = np.fromiter((xxhash.xxh64_intdigest(term + suffix, SEED) for term in terms), dtype=np.uint64, count=len(terms))
        at = shard + (hashes.astype(np.int64) % shards)
        buckets, sizes = self.first_bucket[at + 1] - self.first_bucket[at], self.first_slot[at + 1] - self.first_slot[at]
        chosen = self.displacements[self.first_bucket[at] + bucket_of(hashes, buckets)]
        moved = (mix(hashes + np.maximum(chosen, 0).astype(np.uint64) * STEP) % sizes.astype(np.uint64)).astype(np.int64)
        slots = self.first_slot[at] + np.where(chosen < 0, -1 - chosen, moved)
        ends, keys = self.key_ends, self.keys
        same = [keys[a:b] == term for term, a, b in zip(terms, ends[slots].tolist(), ends[slots + 1].tolist())]
        return np.where(same, slots - base, -1)


def perfect_hash(head: DataFrame) -> tuple[PerfectHash, DataFrame]:
    """The perfect hash of a bounded vocabulary, and ``lang, slot, term``."""
    langs, shard, slot = {}, 0, 0
    for lang, n in sorted(map(tuple, head.groupBy("lang").count().collect())):
        langs[lang] = (shard, -(-n // SHARD_KEYS), slot, n)
        shard, slot = shard + langs[lang][1], slot + n
    spark = head.sparkSession
    dealt = spark.createDataFrame([(k, *v) for k, v in langs.items()], "lang string, first long, shards long, base long, n long")
    key = F.concat("term", F.lit(b"\0"), F.col("lang").cast("binary"))
    keyed = head.join(F.broadcast(dealt), "lang").withColumn("hash", F.xxhash64(key)).withColumn(
        "shard", F.col("first") + F.pmod("hash", "shards"))
    built = stage("perfect-hashes")(keyed.select("shard", "hash", "term").groupBy("shard").applyInPandas(
        _build_shard, "shard long, displacements array<long>, terms array<binary>"))
    rows = {r.shard: r for r in built.collect()}  # at most the head's bound
    empty: tuple[list, list] = ([], [])
    parts = [(rows[k].displacements, rows[k].terms) if k in rows else empty for k in range(shard)]
    terms = [bytes(t) for _, part in parts for t in part]
    ends = lambda sizes: np.cumsum([0, *sizes]).astype(np.int64)
    table = PerfectHash(
        langs, ends(len(d) for d, _ in parts), ends(len(t) for _, t in parts),
        np.array([x for d, _ in parts for x in d], dtype=np.int64), ends(map(len, terms)), b"".join(terms))
    of_lang = [(lang, k) for lang, (first, n, _, _) in langs.items() for k in range(first, first + n)]
    bases = [(k, lang, int(table.first_slot[k]) - langs[lang][2]) for lang, k in of_lang]
    slots = built.join(F.broadcast(spark.createDataFrame(bases, "shard long, lang string, base long")), "shard").select(
        "lang", "base", F.posexplode("terms").alias("at", "term")).select("lang", (F.col("base") + F.col("at")).alias("slot"), "term")
    return table, slots


# --- second pass -----------------------------------------------------------------------

BLOCKS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("counts", pa.binary()),
                    ("term", pa.binary()), ("n", pa.int64())])
SUMS = "lang string, source string, block int, counts binary, term binary, n long"


def packed(counts: np.ndarray) -> bytes:
    """A block's counts without zeros: places of two bytes, and counts of one byte, or of eight if one needs more."""
    at = np.flatnonzero(counts)
    wide = int(counts[at].max(initial=0) > 255)
    return bytes([wide]) + at.astype("<u2").tobytes() + counts[at].astype("<i8" if wide else "u1").tobytes()


def add_packed(data: bytes, to: np.ndarray) -> None:
    n = (len(data) - 1) // (10 if data[0] else 3)
    at = np.frombuffer(data, dtype="<u2", count=n, offset=1)
    to[at] += np.frombuffer(data, dtype="<i8" if data[0] else "u1", count=n, offset=1 + 2 * n)


class Slots:
    """Dense counts of the groups a task sees; terms without a slot are kept by name where ``rest`` asks for them."""

    def __init__(self, table: PerfectHash, rest: bool, block: int = BLOCK, pending: int = PENDING, dense: int = DENSE) -> None:
        self.table, self.rest, self.block, self.most_pending, self.most_dense = table, rest, block, pending, dense
        self.pending: dict[tuple[str, str], Counter] = {}
        self.dense: dict[tuple[str, str], np.ndarray] = {}
        self.tokens = 0

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.pending.setdefault((lang, source), Counter()).update(terms)
        self.tokens += len(terms)

    def crowded(self) -> bool:
        return sum(map(len, self.pending.values())) > self.most_pending or self.tokens > MOST_TOKENS

    def look_up(self) -> Iterator[pa.RecordBatch]:
        """Empty what is pending into the slots."""
        others: list[tuple] = []
        for (lang, source), counter in self.pending.items():
            terms = list(counter)
            slots = self.table.find(lang, terms)
            n = np.fromiter(counter.values(), dtype=np.int64, count=len(terms))
            found = slots >= 0
            if found.any():
                if (lang, source) not in self.dense:
                    size = self.table.langs[lang][3]
                    if size + sum(map(len, self.dense.values())) > self.most_dense:
                        yield from self.blocks()
                    self.dense[lang, source] = np.zeros(size, dtype=np.int32)
                self.dense[lang, source][slots[found]] += n[found].astype(np.int32)
            if self.rest:
                others += [(lang, source, None, None, terms[k], int(n[k])) for k in np.flatnonzero(~found)]
        self.pending.clear()
        if self.tokens > MOST_TOKENS:
            yield from self.blocks()
            self.tokens = 0
        if others:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*others), BLOCKS)], schema=BLOCKS)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """Hand on the slots, block by block."""
        for (lang, source), counts in self.dense.items():
            numbers = [k for k in range(-(-len(counts) // self.block)) if counts[k * self.block:(k + 1) * self.block].any()]
            parts = [counts[k * self.block:(k + 1) * self.block] for k in numbers]
            if numbers:
                yield block_rows(lang, source, numbers, parts)
        self.dense.clear()


def block_rows(lang: str, source: str, numbers: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    n = len(numbers)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n), pa.array([source] * n), pa.array(numbers, pa.int32()), pa.array(list(map(packed, parts)), pa.binary()),
         pa.nulls(n, pa.binary()), pa.array([int(p.sum()) for p in parts], pa.int64())], schema=BLOCKS)


def _add_up(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of equal keys, which lie side by side."""
    key, total = None, np.zeros(block, dtype=np.int64)
    for batch in batches:
        for *this, data in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if this != key:
                if key is not None:
                    yield block_rows(*key[:2], key[2:], [total])
                key = this
                total[:] = 0
            add_packed(data, total)
    if key is not None:
        yield block_rows(*key[:2], key[2:], [total])


def recount(
    docs: DataFrame, kept: DataFrame, head_keys: int = HEAD_KEYS, head_bytes: int = HEAD_BYTES, block: int = BLOCK, pending: int = PENDING,
    dense: int = DENSE,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Occurrences of every kept term in every group.

    ``lang, source, block, counts, n`` for the terms with slots (``packed``, and their sum), ``lang, block, terms`` with their names, and
    ``lang, source, term, n`` for the others, if there are any.
    """
    spark = docs.sparkSession
    lowest = head_from(kept, head_keys, head_bytes)
    tail = kept.where(_power() < lowest)
    rest = not tail.isEmpty()
    table, slots = perfect_hash(kept.where(_power() >= lowest))
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Slots(shared.value, rest, block, pending, dense)
        for batch in batches:
            for lang, source, body in zip(*[column.to_pylist() for column in batch.columns]):
                counts.add(lang, source, terms_of(body))
                if counts.crowded():
                    yield from counts.look_up()
        yield from counts.look_up()
        yield from counts.blocks()

    found = plain(docs).mapInArrow(count, SUMS)
    if rest:
        found = stage("recount")(found)
    keys = ["lang", "source", "block"]
    parts = found.where("block is not null").repartition(*keys).sortWithinPartitions(*keys)
    sums = stage("slot-counts")(parts.mapInArrow(lambda batches: _add_up(batches, block), SUMS).select(*keys, "counts", "n"))
    placed = slots.withColumn("block", F.expr(f"cast(slot div {block} as int)"))
    names = placed.groupBy("lang", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "term"))), lambda x: x["term"]).alias("terms"))
    if not rest:
        return sums, names, None
    by_name = found.where("block is null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    named = by_name.join(tail.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    return sums, names, stage("term-counts")(named)


# --- distances -------------------------------------------------------------------------

def shares(n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (n + 1) / total)``, exact."""
    if n.size and n.max() > LARGE:
        n, totals = n.astype(object), totals.astype(object)
    return (UNIT * (n + 1) // totals + 1).astype(np.int64)


def _compare(counts: np.ndarray, terms: list[bytes], groups: pd.DataFrame, ranks: int) -> pd.DataFrame:
    """Distances of all sources of a language over some of its terms: rows of ``counts`` are the sources of ``groups``."""
    names = groups["source"].tolist()
    size, lang_total = int(groups["terms"].iat[0]), int(groups["lang_total"].iat[0])
    found = []
    if terms:
        p = shares(counts, (groups["total"].to_numpy() + size)[:, None])
        q = shares(counts.sum(axis=0), np.array(lang_total + size))
        over = np.where((counts > 0) & (p > q), (p - q) ** 2 // q, -1)
    for k, name in enumerate(names):
        apart = ((p[k] - p) ** 2 // p).sum(axis=1) if terms else np.zeros(len(names), dtype=np.int64)
        found += [(name, "pair", other, int(v)) for j, (other, v) in enumerate(zip(names, apart)) if j != k]
        if terms:
            values = over[k]
            least = np.partition(values, len(values) - ranks)[len(values) - ranks] if len(values) > ranks else 0
            first = sorted((-int(values[j]), terms[j]) for j in np.flatnonzero((values >= 0) & (values >= least)))
            found += [(name, "term", term.decode("utf-8", "replace"), -v) for v, term in first[:ranks]]
    out = pd.DataFrame(found, columns=["source", "part", "item", "value"])
    out.insert(0, "lang", groups["lang"].iat[0])
    return out


DISTANCES = "lang string, source string, part string, item string, value long"


def audit(
    docs: DataFrame, least: int = LEAST, ranks: int = RANKS, head_keys: int = HEAD_KEYS, head_bytes: int = HEAD_BYTES, cells: int = CELLS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the other sources of the language, by distance.  Part ``term``: what the source uses more than its language, the first
    ``ranks``.
    """
    bound_batches(docs.sparkSession)
    kept = stage("vocabulary")(vocabulary(docs, least))
    known = stage("audit-sources")(plain(docs).select("lang", "source").distinct())
    most = known.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    block = max(1, min(BLOCK, cells // most))
    sums, names, others = recount(docs, kept, head_keys, head_bytes, block)

    occurrences = sums.select("lang", "source", "n")
    if others is not None:
        occurrences = occurrences.unionByName(others.select("lang", "source", "n"))
    totals = occurrences.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    groups = known.join(totals, ["lang", "source"], "left").join(
        kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").fillna(0, ["total", "terms"])
    groups = stage("audit-groups")(groups.withColumns({"lang_total": F.sum("total").over(in_lang)}))

    def beside(blocks: DataFrame) -> DataFrame:
        """All sources of the language for every block."""
        return groups.join(broadcast_if_small(blocks), "lang").groupBy("lang", "block")

    def dense(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        names_of = rows.loc[rows["terms"].notna(), "terms"]
        terms = [bytes(x) for x in names_of.iat[0]] if len(names_of) else []
        counts = np.zeros((len(sources), len(terms)), dtype=np.int64)
        held = rows[rows["terms"].isna()]
        at = {name: k for k, name in enumerate(sources["source"])}
        for name, values in zip(held["source"], held["counts"]):
            add_packed(values, counts[at[name]])
        return _compare(counts, terms, sources, ranks)

    def sparse(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        codes, terms = pd.factorize(rows["term"].map(bytes))
        counts = np.zeros((len(sources), len(terms)), dtype=np.int64)
        at = {name: k for k, name in enumerate(sources["source"])}
        counts[rows["source"].map(at).to_numpy(dtype=np.int64), codes] = rows["n"].to_numpy()
        return _compare(counts, list(terms), sources, ranks)

    rows = sums.drop("n").withColumn("terms", F.lit(None).cast("array<binary>")).unionByName(names.select(
        "lang", F.lit("").alias("source"), "block", F.lit(None).cast("binary").alias("counts"), "terms"))
    # A language without terms has one block without names, for its pairs.
    blocks = names.select("lang", "block").unionByName(groups.where("terms = 0").select("lang", F.lit(0).alias("block")).distinct())
    found = rows.groupBy("lang", "block").cogroup(beside(blocks)).applyInPandas(dense, DISTANCES)
    if others is not None:
        numbers = groups.groupBy("lang").agg(F.first("terms").alias("terms"), F.count("*").alias("sources")).select(
            "lang", F.ceil(F.col("terms") * F.col("sources") / cells).cast("int").alias("blocks")).where("blocks > 0")
        numbers = broadcast_if_small(numbers)
        dealt = others.join(numbers, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
        # Only blocks that have terms.
        found = found.unionByName(dealt.groupBy("lang", "block").cogroup(
            beside(stage("audit-blocks")(dealt.select("lang", "block").distinct()))).applyInPandas(sparse, DISTANCES))
    found = stage("distances")(found)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", rank).unionByName(over)
