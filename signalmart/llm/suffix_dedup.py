"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A byte is removed when some string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id,
or earlier in the same one.

*Sampling.*  Every string of ``length`` bytes is represented by one place inside it, its anchor: where the hash of
the next ``anchor`` bytes is smallest.  Equal strings have their anchor at the same offset.  About one place in 35
is an anchor; it stands for the strings that start within a range of bytes before it.  Anchors whose bytes
are found only once (told by 64-bit hashes, sorted by Spark) cannot belong to a repeated string and go no further.

*Runs.*  The others become sorted suffixes: the bytes from the anchor on as far as its strings reach, then those before
it, backwards.  Each task sorts its own into runs, drops all but the first of equal ones (their strings are repeats), and
sends runs front-coded: the length of the prefix shared with the entry before, and the rest.

*Merge.*  A loser tree merges the runs of a partition.  Each loser knows how long a prefix it shares with the last winner, so
entries are compared from there on and never before.  Equal entries of different runs are repeats of the first.

*Partial repeats.*  Entries that share the anchor's bytes but differ further out can still share some strings.
Sorting both sides bounds which strings those can be; just those are looked up, whole, by content.
Anchors with more than ``most`` places are told before runs are made, by counting hashes.  Their entries are in no merge of
runs: tasks drop what repeats among a few of them.  Where at most ``most`` entries of an anchor are left, those are compared
by themselves; else Spark groups their strings by content.

Null text: empty.  Null ids come first.  Rows that repeat id and text are one document and get the same answer; rows
that share just the id come in the order of a hash of their text.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches
from signalmart.llm.shingles import BASE, INVERSE, mix
from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import stage

LENGTH = 100
# Bytes of text whose places are computed at once, entries of a run, entries one merge holds, places that share an anchor,
# and entries of crowded anchors whose strings are compared at once.
CHUNK_BYTES = 1 << 18
RUN_ENTRIES = 50_000
MERGE_ENTRIES = 120_000
GROUP_ENTRIES = 10_000
CROWD_ENTRIES = 1_000
VALUE = np.random.default_rng(77_003).integers(1, 2**63, 256, dtype=np.uint64)
PLACE = np.uint64(2**31 - 1)
FIRST_ID = -(2**63)
MARK = 2**62
SPANS = "doc_id long, text_hash long, start long, stop long"
# What a row of ``runs`` is: a run of that partition, a span, or an entry of a crowded anchor.
SPAN, CROWDED = -1, -2
RUNS = f"partition long, run binary, {SPANS}, anchor long, right binary, left binary, offsets array<int>"


@dataclass(frozen=True)
class Sampling:
    """Length of the strings, and of the bytes an anchor is chosen by."""

    length: int = LENGTH

    def __post_init__(self) -> None:
        if not 3 <= self.length <= 254:
            raise ValueError("strings have 3 to 254 bytes")

    @property
    def anchor(self) -> int:
        return max(1, self.length // 3)

    @property
    def reach(self) -> int:
        """How far before its anchor a string can start."""
        return self.length - self.anchor

    @property
    def width(self) -> int:
        """Bytes of an entry: right side, left side, and the lengths of both."""
        return self.length + self.reach + 2


_up = np.ones(1, dtype=np.uint64)
_down = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if n > len(_up):
        size = 1 << n.bit_length()
        up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _up, _down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _up, _down


def anchors(body: np.ndarray, stops: np.ndarray, sampling: Sampling) -> tuple[np.ndarray, ...]:
    """Hash, place, and first and last string start of every anchor in texts laid end to end."""
    n, k, length = len(body), sampling.anchor, sampling.length
    if n < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(VALUE[body] * up[:n], out=sums[1:])
    hashes = mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
    lowest = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - k + 1, 1
    while width * 2 <= span:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if span > width:
        lowest = np.minimum(lowest[:width - span], lowest[span - width:])
    chosen = (lowest & PLACE).astype(np.int64)
    whole = np.ones(len(chosen), dtype=bool)  # strings that end within their text
    for stop in stops.tolist():
        whole[max(0, stop - length + 1):stop] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    place = chosen[starts]
    change = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(place) - 1]])
    at = place[first]
    return hashes[at], at, starts[first], starts[last]


def _chunks(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES`` together."""
    start, size = 0, 0
    for i, body in enumerate(bodies):
        if size and size + len(body) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(body)
    if start < len(bodies):
        yield start, len(bodies)


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(bodies), dtype=np.uint8), np.cumsum([len(b) for b in bodies])


def _bodies(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def _documents(docs: DataFrame) -> DataFrame:
    """Ids (null first), a hash of the text, and a name for both."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"),
                       F.xxhash64("text").alias("text_hash"), F.col("text")).withColumn("doc", F.xxhash64("doc_id", "text_hash"))


def _known_repeats(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors repeat within these, told by a sign, and one more row, ``MARK``, for each of their hashes."""
    if not len(hashes):
        return places, hashes
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(hashes), dtype=bool)
    again[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    marks = hashes[order][np.concatenate([same, [False]]) & ~np.concatenate([[False], same])]
    return np.where(again, ~places, places), marks


def sampled(docs: DataFrame, sampling: Sampling) -> DataFrame:
    """``hash, doc, place``: all anchors; ``place`` packs the anchor and the two offsets of its strings.

    Anchors that repeat within a batch have ``~place``: they are known to repeat, whatever others have.  Rows of one document
    count once in a batch; those of several batches give equal anchors, of which ``repeated_spans`` takes one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("doc")
            names, bodies = batch["doc"].to_numpy(), _bodies(batch["text"])
            found = []
            for first, last in _chunks(bodies):
                body, stops = _joined(bodies[first:last])
                hashes, at, low, high = anchors(body, stops, sampling)
                owner = np.searchsorted(stops, at, side="right")
                begin = np.concatenate([[0], stops])[owner]
                found.append((hashes.view(np.int64), names[first:last][owner],
                              ((at - begin) << 24) + ((at - low) << 12) + (at - high)))
            if found:
                hashes, doc, place = (np.concatenate(x) for x in zip(*found))
                place, marks = _known_repeats(hashes, place)
                yield pd.DataFrame({"hash": np.concatenate([hashes, marks]),
                                    "doc": np.concatenate([doc, np.zeros(len(marks), np.int64)]),
                                    "place": np.concatenate([place, np.full(len(marks), MARK)])})

    return _documents(docs).select("doc", "text").mapInPandas(run, "hash long, doc long, place long")


def repeated(anchor_rows: DataFrame) -> DataFrame:
    """``hash, doc, place`` of the anchors whose hash is there more than once.

    Anchors known to repeat are dealt by their place, so that none of the tasks gets all of a frequent one; the mark
    that stands for them goes where their hash belongs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, again = None, False  # the row not decided yet, and whether it equals the one before
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            key, place = batch["hash"].to_numpy(), batch["place"].to_numpy()
            same = key[1:] == key[:-1]
            found = np.concatenate([[again], same]) | np.concatenate([same, [False]]) | (place < 0)
            found &= place != MARK
            again = bool(same[-1]) if len(same) else again
            held = batch.iloc[-1:]
            rows = batch.iloc[found[:-1].nonzero()[0]]
            yield rows.assign(place=np.where(rows["place"] < 0, ~rows["place"], rows["place"]))
        if held is not None:
            last = int(held["place"].iloc[0])
            if last < 0 or again and last != MARK:
                yield held.assign(place=~last if last < 0 else last)

    dealt = F.when(F.col("place") < 0, F.xxhash64("doc", "place")).otherwise(F.col("hash"))
    return anchor_rows.repartition(dealt).sortWithinPartitions("hash").mapInPandas(run, "hash long, doc long, place long")


def crowded_told(found: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``doc, place`` with ``~place`` for anchors that more than ``most`` places have, and how many places are not of those."""
    counts = stage("suffix-crowded")(found.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most))
    crowd = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = found.join(broadcast_if_small(counts.select("hash", F.lit(True).alias("_crowd"))), "hash", "left")
    place = F.when(F.col("_crowd"), F.bitwise_not("place")).otherwise(F.col("place"))
    return told.select("doc", place.alias("place")), found.count() - crowd


def entries(body: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, sampling: Sampling) -> np.ndarray:
    """One row of ``width`` bytes per anchor: bytes from it on, bytes before it backwards, and how many of each."""
    pad = np.zeros(sampling.length, dtype=np.uint8)
    padded = np.concatenate([pad, body, pad])
    ahead, back = np.arange(sampling.length), np.arange(sampling.reach)
    out = np.empty((len(at), sampling.width), dtype=np.uint8)
    for i in range(0, len(at), 10_000):
        here = at[i:i + 10_000, None] + sampling.length
        row = out[i:i + 10_000]
        row[:, :sampling.length] = np.where(ahead < right[i:i + 10_000, None], padded[here + ahead], 0)
        row[:, sampling.length:-2] = np.where(back < left[i:i + 10_000, None], padded[here - 1 - back], 0)
    out[:, -2], out[:, -1] = right + 1, left + 1
    return out


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length of the prefix each sorted row shares with the one before, and the rests end to end."""
    shared = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    rest = np.arange(rows.shape[1]) >= shared[:, None]
    return shared.astype(np.uint16), rows[rest].tobytes()


def _pack_run(rows: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray, at: np.ndarray) -> bytes:
    shared, rest = front_coded(rows)
    head = np.array([len(rows)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(
        head + shared.tobytes() + doc_id.astype(np.int64).tobytes() + text_hash.astype(np.int64).tobytes()
        + at.astype(np.int64).tobytes() + rest)


def _open_run(data: bytes, width: int) -> Iterator[tuple[bytes, int, tuple[int, int, int]]]:
    """Entries of a run in order: bytes, prefix shared with the entry before, place."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    shared = np.frombuffer(data, np.uint16, n, 8).tolist()
    at = 8 + 2 * n
    doc_id, text_hash, place = (np.frombuffer(data, np.int64, n, at + 8 * n * i).tolist() for i in range(3))
    at += 24 * n
    entry = b""
    for i in range(n):
        step = width - shared[i]
        entry = entry[:shared[i]] + data[at:at + step]
        at += step
        yield entry, shared[i], (doc_id[i], text_hash[i], place[i])


def _span(place: tuple[int, int, int], entry: bytes) -> tuple[int, int, int, int]:
    """Document and bytes of all strings that an entry stands for."""
    return place[0], place[1], place[2] - entry[-1] + 1, place[2] + entry[-2] - 1


def open_strings(rows: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray, at: np.ndarray, anchor: np.ndarray,
                 sampling: Sampling) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Spans of strings that come earlier among these entries, and the entries with the offsets of all other strings."""
    right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    low = sampling.length - right
    counts = left - low + 1
    who = np.repeat(np.arange(len(rows)), counts)
    o = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts - low, counts)
    start = at[who] - o
    by_place = np.lexsort((start, text_hash[who], doc_id[who]))
    who, o, start = who[by_place], o[by_place], start[by_place]
    ahead = np.arange(sampling.length)
    content = np.empty((len(who), sampling.length + 1), dtype=np.uint8)
    content[:, :-1] = np.take(rows, who[:, None] * sampling.width + np.where(
        ahead < o[:, None], sampling.length + ahead, ahead - o[:, None]))
    content[:, -1] = o + 1
    order = np.argsort(content.view(f"S{sampling.length + 1}").ravel(), kind="stable")
    content = content[order]
    first = np.ones(len(who), dtype=bool)
    first[order[1:]] = (content[1:] != content[:-1]).any(axis=1)

    again = np.flatnonzero(~first)
    again = again[np.lexsort((start[again], who[again]))]
    begins = np.ones(len(again), dtype=bool)
    begins[1:] = (np.diff(who[again]) != 0) | (np.diff(start[again]) != 1)
    head, tail = again[begins], again[np.append(begins[1:], True)[:len(again)]]
    spans = pd.DataFrame({"doc_id": doc_id[who[head]], "text_hash": text_hash[who[head]],
                          "start": start[head], "stop": start[tail] + sampling.length})

    left_open = np.flatnonzero(first)
    left_open = left_open[np.argsort(who[left_open], kind="stable")]
    owners, cuts = np.unique(who[left_open], return_index=True)
    kept = pd.DataFrame({
        "doc_id": doc_id[owners], "text_hash": text_hash[owners], "start": at[owners],
        "anchor": anchor[owners].view(np.int64),
        "right": [rows[k, :right[k]].tobytes() for k in owners],
        "left": [rows[k, sampling.length:sampling.length + left[k]].tobytes() for k in owners],
        "offsets": np.split(o[left_open].astype(np.int32), cuts[1:])})
    return spans, kept


def runs(texts: DataFrame, partitions: int, sampling: Sampling) -> DataFrame:
    """Front-coded runs (``partition, run``), spans of what already repeats within a run, and entries of crowded anchors.

    Places of crowded anchors are those below zero.
    """
    names = [c.split()[0] for c in RUNS.split(", ")]

    def made(kind: int, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(partition=kind, **{c: 0 for c in ("stop",) if c not in frame})
        return frame.assign(**{c: None for c in names if c not in frame})[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.random.default_rng(5).integers(1, 2**63, sampling.anchor, dtype=np.uint64) | np.uint64(1)

        def sorted_run(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
            rows, doc_id, text_hash, at, crowd = (np.concatenate(p) for p in zip(*parts))
            parts.clear()  # entries are held once while they are sorted, not in their parts as well
            order = np.lexsort((at, text_hash, doc_id))
            order = order[np.argsort(rows[order].view(f"S{sampling.width}").ravel(), kind="stable")]
            rows, doc_id, text_hash, at, crowd = rows[order], doc_id[order], text_hash[order], at[order], crowd[order]
            fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            other = ~fresh & ((doc_id != doc_id[head]) | (text_hash != text_hash[head]) | (at != at[head]))
            if other.any():
                yield made(SPAN, pd.DataFrame({
                    "doc_id": doc_id[other], "text_hash": text_hash[other],
                    "start": at[other] - rows[other, -1] + 1, "stop": at[other] + rows[other, -2] - 1}))
            hashes = mix(rows[:, :sampling.anchor].astype(np.uint64) @ weights)
            hot = np.flatnonzero(fresh & crowd)
            for i in range(0, len(hot), CROWD_ENTRIES):
                cut = hot[i:i + CROWD_ENTRIES]
                spans, kept = open_strings(rows[cut], doc_id[cut], text_hash[cut], at[cut], hashes[cut], sampling)
                yield made(SPAN, spans)
                yield made(CROWDED, kept)
            fresh &= ~crowd
            rows, doc_id, text_hash, at = rows[fresh], doc_id[fresh], text_hash[fresh], at[fresh]
            dealt = hashes[fresh] % np.uint64(partitions)
            for p in np.unique(dealt).tolist():
                own = dealt == p
                yield made(p, pd.DataFrame({"run": [_pack_run(rows[own], doc_id[own], text_hash[own], at[own])],
                                            "doc_id": 0, "text_hash": 0, "start": 0}))

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            bodies = _bodies(batch["text"])
            for first, last in _chunks(bodies):
                body, stops = _joined(bodies[first:last])
                places = batch["places"].iloc[first:last]
                counts = [len(p) for p in places]
                packed = np.concatenate([np.asarray(p, dtype=np.int64) for p in places])
                owner = np.repeat(np.arange(first, last), counts)
                begin = np.concatenate([[0], stops])[owner - first]
                crowd = packed < 0
                packed = np.where(crowd, ~packed, packed)
                at, low, high = packed >> 24, (packed >> 12) & 4_095, packed & 4_095
                ids, hashes = batch["doc_id"].to_numpy()[owner], batch["text_hash"].to_numpy()[owner]
                for i in range(0, len(at), RUN_ENTRIES):
                    cut = slice(i, i + RUN_ENTRIES)
                    rows = entries(body, (at + begin)[cut], low[cut], sampling.length - high[cut], sampling)
                    held.append((rows, ids[cut], hashes[cut], at[cut], crowd[cut]))
                    n += len(rows)
                    if n >= RUN_ENTRIES:
                        yield from sorted_run(held)
                        held, n = [], 0
        if n:
            yield from sorted_run(held)

    return texts.select("doc_id", "text_hash", "text", "places").mapInPandas(run, RUNS)


def merged(sources: list[Iterator], width: int) -> Iterator[tuple[bytes, int, tuple[int, int, int]]]:
    """Merge sorted sources with a loser tree: entries in order, with the prefix shared with the entry before.

    ``known`` is the prefix that a source's entry shares with the last entry given out.  The one that
    shares more comes first; only between equals are bytes compared, from that length on.
    """
    n = len(sources)
    entry: list[bytes | None] = [None] * n
    known = [0] * n
    place: list = [None] * n

    def draw(s: int) -> None:
        following = next(sources[s], None)
        entry[s], known[s], place[s] = following if following else (None, -1, None)

    def wins(a: int, b: int) -> bool:
        """Whether a comes before b; the loser's ``known`` becomes what it shares with the winner."""
        if known[a] != known[b]:
            return known[a] > known[b]
        if entry[a] is None:
            return True
        x, y, i = entry[a], entry[b], known[a]
        while i < width and x[i:i + 16] == y[i:i + 16]:
            i += 16
        while i < width and x[i] == y[i]:
            i += 1
        first = i >= width and place[a] <= place[b] or i < width and x[i] < y[i]
        known[b if first else a] = min(i, width)
        return first

    size = 1
    while size < n:
        size *= 2
    loser = [-1] * size

    def build(node: int) -> int:
        """The winner below a node."""
        if node >= size:
            return node - size if node - size < n else -1
        a, b = build(2 * node), build(2 * node + 1)
        if a < 0 or b < 0:
            return max(a, b)
        won = wins(a, b)
        loser[node] = b if won else a
        return a if won else b

    for s in range(n):
        draw(s)
    winner = build(1) if n else -1
    while winner >= 0 and entry[winner] is not None:
        yield entry[winner], known[winner], place[winner]
        draw(winner)
        node = (winner + size) // 2
        while node:
            other = loser[node]
            if other >= 0 and not wins(winner, other):
                loser[node], winner = winner, other
            node //= 2


def shared_strings(group: list[tuple[bytes, tuple[int, int, int]]], ahead: list[int], sampling: Sampling) -> Iterator[tuple]:
    """Spans of strings that repeat among different entries of one anchor.

    ``ahead`` is the prefix that an entry shares with the entry before it.
    """
    length, n = sampling.length, len(group)
    lefts = [e[length:-2] for e, _ in group]
    order = sorted(range(n), key=lefts.__getitem__)
    back = [0] * n
    for x, y in zip(order, order[1:]):
        a, b, i = lefts[x], lefts[y], 0
        while i < len(a) and a[i] == b[i]:
            i += 1
        back[x], back[y] = max(back[x], i), max(back[y], i)
    found: dict[bytes, list[tuple[int, int]]] = {}
    for k, (e, _) in enumerate(group):
        right = min(e[-2] - 1, max(ahead[k] if k else 0, ahead[k + 1] if k + 1 < n else 0))
        left = min(e[-1] - 1, back[k])
        for o in range(max(0, length - right), left + 1):
            found.setdefault(bytes([o]) + e[length:length + o] + e[:length - o], []).append((k, o))
    later: dict[int, list[int]] = {}
    for who in found.values():
        if len(who) > 1:
            first = min(who, key=lambda w: (*group[w[0]][1][:2], group[w[0]][1][2] - w[1]))
            for w in who:
                if w is not first:
                    later.setdefault(w[0], []).append(group[w[0]][1][2] - w[1])
    for k, starts in later.items():
        doc_id, text_hash, _ = group[k][1]
        starts.sort()
        begin = end = starts[0]
        for s in starts[1:]:
            if s > end + 1:
                yield doc_id, text_hash, begin, end + length
                begin = s
            end = s
        yield doc_id, text_hash, begin, end + length


def merge_spans(parts: DataFrame, sampling: Sampling) -> DataFrame:
    """Spans from all runs of each partition; no anchor has more entries there than ``crowded_told`` lets through."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spans: list[tuple] = []
        group: list[tuple[bytes, tuple[int, int, int]]] = []
        ahead: list[int] = []

        def close() -> None:
            if len(group) > 1:
                spans.extend(shared_strings(group, ahead, sampling))
            group.clear()
            ahead.clear()

        leader = None
        sources = [_open_run(data, sampling.width) for data in rows["run"]]
        for e, shared, place in merged(sources, sampling.width):
            if shared >= sampling.width and leader is not None:
                if place != leader:
                    spans.append(_span(place, e))
                continue
            leader = place
            if shared < sampling.anchor:
                close()
            group.append((e, place))
            ahead.append(shared)
        close()
        return pd.DataFrame(spans, columns=["doc_id", "text_hash", "start", "stop"]).astype("int64")

    return parts.groupBy("partition").applyInPandas(run, SPANS)


def entry_spans(rows: DataFrame, sampling: Sampling) -> DataFrame:
    """The same spans for the entries of anchors that have few: each anchor's are compared by themselves."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        both = sorted((right.ljust(sampling.length, b"\0") + left.ljust(sampling.reach, b"\0") + bytes([len(right) + 1, len(left) + 1]), place)
                      for right, left, *place in found[["right", "left", "doc_id", "text_hash", "start"]].itertuples(index=False))
        spans: list[tuple] = []
        group: list[tuple[bytes, tuple[int, int, int]]] = []
        ahead: list[int] = []
        for e, place in both:
            last, i = group[-1][0] if group else b"", 0
            if e == last:
                spans.append(_span(place, e))
                continue
            while i < len(last) and e[i] == last[i]:
                i += 1
            if i < sampling.anchor:
                spans.extend(shared_strings(group, ahead, sampling))
                group, ahead = [], []
            group.append((e, tuple(place)))
            ahead.append(i)
        spans.extend(shared_strings(group, ahead, sampling))
        return pd.DataFrame(spans, columns=["doc_id", "text_hash", "start", "stop"]).astype("int64")

    return rows.groupBy("anchor").applyInPandas(run, SPANS)


def crowded_spans(rows: DataFrame, sampling: Sampling) -> DataFrame:
    """The same spans for entries of crowded anchors: their open strings, grouped by content in Spark.

    A string that many entries share comes once from each ``CROWD_ENTRIES`` of a run, not from every entry.
    """
    length = sampling.length
    strings = rows.select(
        "doc_id", "text_hash", F.col("start").alias("at"), "right", "left",
        F.explode("offsets").alias("o"),
    ).select("doc_id", "text_hash", (F.col("at") - F.col("o")).alias("start"), F.concat(
        F.unhex(F.lpad(F.hex(F.col("o").cast("long")), 4, "0")), F.expr("substring(left, 1, o)"),
        F.expr(f"substring(right, 1, {length} - o)")).alias("content"))
    first = strings.groupBy("content").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("_first"),
                                           F.count("*").alias("_n")).where("_n > 1")
    later = strings.join(first, "content").where(F.struct("doc_id", "text_hash", "start") != F.col("_first"))
    return later.select("doc_id", "text_hash", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = GROUP_ENTRIES) -> DataFrame:
    """``doc_id, text_hash, start, stop``: bytes covered by a string that starts earlier too; spans may overlap."""
    sampling = Sampling(length)
    bound_batches(docs.sparkSession)
    found = stage("suffix-places")(repeated(sampled(docs, sampling)))
    told, ordinary = crowded_told(found, most)
    partitions = max(1, -(-ordinary // MERGE_ENTRIES))
    places = told.groupBy("doc").agg(F.collect_set("place").alias("places"))
    once = _documents(docs).dropDuplicates(["doc"])  # by tasks first, so that a row repeated often is in none of them often
    made = stage("suffix-runs")(runs(once.join(places, "doc"), partitions, sampling))
    columns = ["doc_id", "text_hash", "start", "stop"]
    spans = stage("suffix-spans")(merge_spans(made.where("partition >= 0").select("partition", "run"), sampling))
    crowded = made.where(F.col("partition") == CROWDED)
    large = broadcast_if_small(stage("suffix-large")(
        crowded.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most)).select("anchor"))
    return made.where(F.col("partition") == SPAN).select(*columns).unionByName(spans).unionByName(
        entry_spans(crowded.join(large, "anchor", "left_anti"), sampling)).unionByName(
        crowded_spans(crowded.join(large, "anchor", "left_semi"), sampling))


def _with_spans(docs: DataFrame, length: int, most: int) -> DataFrame:
    """``docs`` in a struct ``_d``, its text's id and hash, and the list of its spans."""
    spans = repeated_spans(docs, length, most).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("_spans"))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return whole.join(spans, ["doc_id", "text_hash"], "left")


def union(spans: list | np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in (spans if spans is not None else [])):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remaining(body: bytes, removed: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for span in removed for x in span], len(body)]
    return b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def report(docs: DataFrame, length: int = LENGTH, most: int = GROUP_ENTRIES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def measure(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for body, found in zip(_bodies(texts), spans):
            removed = union(found)
            kept = remaining(body, removed)
            rows.append((len(body), len(body) - len(kept), len(removed), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, length, most).select(
        F.col("_d.doc_id").alias("doc_id"), measure("_d.text", "_spans").alias("_m")).select("doc_id", "_m.*")


def drop_repeats(docs: DataFrame, length: int = LENGTH, most: int = GROUP_ENTRIES) -> DataFrame:
    """Documents without their repeated bytes, with their own columns and ``n_chars`` counted anew.

    A character that a removed run cuts is dropped; so is a document of which nothing is left.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([remaining(body, union(found)).decode("utf-8", "ignore") for body, found in zip(_bodies(texts), spans)],
                         dtype=object)

    rows = _with_spans(docs, length, most)
    # Called non-deterministic, so that the filter does not call it a second time, with Python workers of its own.
    cut = rows.where("_spans is not null").withColumn("_text", kept.asNondeterministic()("_d.text", "_spans")).where("_text != ''")
    changed = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return rows.where("_spans is null").select("_d.*").unionByName(
        cut.select(*[changed.get(c, F.col(f"_d.`{c}`")).alias(c) for c in docs.columns]))
