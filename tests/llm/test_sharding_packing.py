import zlib
from collections import defaultdict

from signalmart.llm import packing, sharding


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in rows:
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_rows_and_groups_of_odd_documents(documents):
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check_shards(sharding.shard_documents(documents, 3).collect(), texts, 3)


def test_empty(nothing):
    assert sharding.shard_documents(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0


def test_levels_of_bundles_keep_the_balance(spark):
    texts = [(k, "x" * (1 + k * 7919 % 500) + str(k % 900)) for k in range(3_000)] + [(9_000 + k, "hot") for k in range(1_500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = sharding.shard_documents(df, 4, per_heap=100).collect()
    check_shards(rows, texts, 4)
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    # The hot group is 1500 * 11 bytes; no shard exceeds the mean by more than the largest bundle.
    assert max(loads.values()) - min(loads.values()) <= 1_000


def test_a_single_heap_is_longest_first(spark):
    items = spark.createDataFrame([(str(k), b) for k, b in enumerate([8, 7, 6, 5, 4])], "item string, bytes long")
    large, small = sharding.schedule(items, 2)
    loads = defaultdict(int)
    for r in large.unionByName(small).join(items, "item").collect():
        loads[r["shard"]] += r["bytes"]
    assert sorted(loads.values()) == [13, 17]


def test_best_fit_and_downsizing():
    bins, offsets, fills, sizes = packing.pack([900, 600, 400, 100, 50], (256, 512, 1024))
    assert bins == [0, 1, 1, 0, 2] and offsets == [0, 0, 600, 900, 0]
    assert fills == [1000, 1000, 50] and sizes == [1024, 1024, 256]


def test_opening_takes_the_cheapest_size_per_token():
    cheapest = min((512, 1024, 2048, 4096), key=lambda c: packing.cost(c) / c)
    bins, _, fills, sizes = packing.pack([100] * 200, (512, 1024, 2048, 4096))
    assert fills[0] == cheapest // 100 * 100 and set(sizes[:-1]) == {cheapest}


def test_every_token_is_packed_once(documents):
    rows = packing.pack_documents(documents, (64, 256, 1024), per_part=4).collect()
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want, got = defaultdict(int), defaultdict(int)
    for i, t in texts:
        want[i] += len([w for w in (t or "").replace("\x0b", " ").split() if w]) + 1
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert want == got
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        assert [m.bin_offset for m in members] == [sum(x.length for x in members[:k]) for k in range(len(members))]
        assert {m.bin_fill for m in members} == {sum(m.length for m in members)}
        assert {m.capacity for m in members} == {min(c for c in (64, 256, 1024) if c >= members[0].bin_fill)}


def test_packing_wastes_little(spark):
    df = spark.createDataFrame([(k, "w " * (k * 7919 % 3_000)) for k in range(2_000)], "doc_id long, text string")
    bins = packing.pack_documents(df).select("bin_id", "bin_fill", "capacity").distinct().collect()
    assert sum(b.bin_fill for b in bins) >= 0.97 * sum(b.capacity for b in bins)
