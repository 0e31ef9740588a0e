import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalmart.llm import divergence_audit as audit
from signalmart.llm import line_dedup, merkle_manifest, queries

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines ----------------------------------------------------------------------------

def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute_lines(rows, least=line_dedup.LEAST_CHARS):
    """What stays of every row by the definition; a null id comes before all."""
    rank = lambda i: -(2**63) if i is None else i
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            first[line_key(line)] = min(first.get(line_key(line), rank(i)), rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < least or first[line_key(x)] == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got_lines(docs, **options):
    return sorted(map(tuple, line_dedup.without_repeated_lines(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("batches, fan_out", [(1, 2), (5, 2), (7, 3)])
def test_lines_equal_the_definition(spark, batches, fan_out):
    rng = random.Random(batches)
    pool = [f"{'  ' * (k % 3)}Common Line number {k % 40}{' ' * (k % 4)}\t" for k in range(60)] + ["short", "", "  ", "ÀÉÎ ŒÇÑ ABCD", "àÉÎ ŒÇÑ abcd"]
    rows = [(k * 7 % 101 if k % 9 else None, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, rows[1][1]), (503, rows[1][1]), (503, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_lines(docs, batches=batches, fan_out=fan_out) == brute_lines(rows)


def test_odd_documents_lines(documents, nothing):
    assert got_lines(documents) == brute_lines([(r.doc_id, r.text) for r in documents.collect()])
    assert line_dedup.without_repeated_lines(nothing).count() == 0


def test_a_line_of_every_document_and_very_long_texts(spark):
    rows = [(k, f"the line that everyone has\nown line number {k}") for k in range(3_000)]
    rows += [(4_000, "\n".join(f"long text line {k % 2_500}" for k in range(30_000))),
             (4_001, "\n".join(f"long text line {k}" for k in range(5_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = line_dedup.without_repeated_lines(docs).where("n_dropped > 0 and kept_text like '%1%'")
    by_id = {i: row for i, *row in brute_lines(rows)}
    assert {r.doc_id: list(r)[1:] for r in kept.collect()} == {i: row for i, row in by_id.items() if row[1] and "1" in row[2]}


def test_runs_are_levelled_and_removed(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2, buckets=4)
    batch = lambda k: spark.range(k * 10, k * 10 + 15).select(
        F.lit(k).cast("long").alias("holder"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    try:
        for k in range(5):
            run = runs.add(batch(k))
            assert spark.table(run).where("seen").count() == (5 if k else 0)
            plan = spark.table(run)._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan or "bucketed" in plan.lower()
            runs.settle(run)
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        assert sum(runs.keys(run).count() for run in runs.runs()) == 55
    finally:
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    with pytest.raises(ValueError):
        line_dedup.LineRuns(spark, fan_out=1)


# --- manifest -------------------------------------------------------------------------

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return sha("".join(map(field, row)))


def tree_of(nodes):
    """Root of a list of digests, and each one's siblings and path."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, above_under = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k:k + 3]
            for j, owners in enumerate(under[k:k + 3]):
                for leaf in owners:
                    paths[leaf].append((j, run))
            above.append(sha("".join(run)))
            above_under.append([leaf for owners in under[k:k + 3] for leaf in owners])
        nodes, under = above, above_under
    return nodes[0], paths


def climb(node, path):
    for j, run in path:
        node = sha("".join([*run[:j], node, *run[j + 1:]]))
    return node


def brute_manifest(rows):
    """The contract's result from rows of doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        leaves = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[source] = (leaves, *tree_of([leaf_of(r) for r in leaves]))
    root, group_paths = tree_of([trees[s][1] for s in order]) if order else (None, [])
    out = []
    for source, above in zip(order, group_paths):
        leaves, subroot, paths = trees[source]
        for row, path in zip(leaves, paths):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            other = (*row[:4], row[4].replace("\n", "")) if even and row[4] is not None else row
            siblings = "".join("".join(run[:j] + run[j + 1:]) for j, run in [*path, *above])
            folded = climb(leaf_of(other), [*path, *above])
            out.append((row[0], leaf_of(row), subroot, root, sha(siblings), folded, folded == root))
    return sorted(out, key=repr)


def got_manifest(spark, docs, folder, monkeypatch=None, levels=None):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    if levels:
        whole = merkle_manifest.manifest
        monkeypatch.setattr(merkle_manifest, "manifest", lambda *a, **k: whole(*a, **k, block_levels=levels))
    return sorted(map(tuple, queries.op12_merkle_manifest(spark, folder).collect()), key=repr)


def leaf_rows(docs):
    return [tuple(r) for r in docs.select(*merkle_manifest.LEAF_COLUMNS).collect()]


def test_odd_documents_manifest(spark, documents, nothing, root):
    assert got_manifest(spark, documents, f"{root}/odd") == brute_manifest(leaf_rows(documents))
    assert got_manifest(spark, nothing, f"{root}/none") == []


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_are_appended_like_leaves(spark, root, monkeypatch, levels):
    """Small blocks make many rounds; sizes around the powers of three leave open runs on every level."""
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "c": 26, "d": 27, "e": 28, "z\u00e9": 82, "hot": 200, **{f"s{k:02}": 1 for k in range(25)}}
    rows = [(None if k % 31 == 30 else k // 2, source, "en" if k % 3 else None, k, f"line {k}\nend" if k % 5 else None)
            for source, n in sizes.items() for k in range(n)]
    random.Random(levels).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert got_manifest(spark, docs, f"{root}/blocks", monkeypatch, levels) == brute_manifest(rows)


def test_a_witness_proves_its_own_leaf_only(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    rows = merkle_manifest.manifest(docs, ["doc_id", "text"])
    other = F.lead("leaf").over(merkle_manifest.Window.orderBy("place"))
    tried = rows.withColumn("other", F.coalesce(other, F.unhex(F.lit("00")))).select(
        (merkle_manifest.folded_root(F.col("leaf")) == F.col("root")).alias("own"),
        (merkle_manifest.folded_root(F.col("other")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in tried.collect()} == {(True, False)}


def test_appended_witnesses_grow_with_each_sibling():
    tree = merkle_manifest.Appender()
    nodes = [tree.append(sha(str(k))) for k in range(2)]
    assert nodes[0].witness() == [sha("1")] and nodes[1].witness() == [sha("0")]
    nodes += [tree.append(sha(str(k))) for k in range(2, 4)]
    assert nodes[0].witness() == [sha("1"), sha("2")] and nodes[3].witness() == []
    top = tree.close()
    want, paths = tree_of([sha(str(k)) for k in range(4)])
    assert top == want
    for node, path in zip(nodes, paths):
        assert node.witness() == [x for j, run in path for x in run[:j] + run[j + 1:]]


# --- audit ----------------------------------------------------------------------------

def brute_audit(rows, least=3, ranks=200):
    """The contract's result from rows of lang, source, text."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in documents:
        kept = {t for t, n in documents[lang].items() if n >= least}
        sources = sorted(s for k, s in counts if k == lang)

        def prices(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: prices(counts[lang, s]) for s in sources}
        q = prices(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(found[:most])]
    return sorted(out)


def audit_rows(docs):
    return [tuple(r) for r in docs.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("bounds", [{}, {"head_keys": 25}, {"head_keys": 0}, {"head_bytes": 900}])
def test_audit_equals_the_definition(spark, bounds, monkeypatch):
    """Also with a broadcast for only some of the terms, or none."""
    monkeypatch.setattr(audit, "SHARD_KEYS", 7)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Word", "\u00e9t\u00e9", "na\u00efve", "x") for b in "abcdefghijklmnop"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s\u00e9", None]),
             " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40)))) for _ in range(200)]
    rows += [("fr", "one", None), ("fr", "two", ""), ("fr", "three", "alone [x] `y` {z}"), ("it", "only", "a b a b")] + [("en", "s1", "UP up\u0000up_Up")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert sorted(map(tuple, audit.audit(docs, **bounds).collect())) == brute_audit(rows)


def test_odd_documents_audit(documents, nothing):
    assert sorted(map(tuple, audit.audit(documents).collect())) == brute_audit(audit_rows(documents))
    assert audit.audit(nothing).count() == 0


def test_tasks_hand_on_what_they_cannot_hold(documents, monkeypatch):
    counted = audit.recount
    monkeypatch.setattr(audit, "recount", lambda *a: counted(*a, pending=5, dense=1))
    assert sorted(map(tuple, audit.audit(documents, least=1, cells=50).collect())) == brute_audit(audit_rows(documents), least=1)


def test_perfect_hashes_are_minimal_and_verify_keys(spark):
    assert [r.h for r in spark.sql("SELECT xxhash64(CAST('abc' AS BINARY)) AS h").collect()] == [
        int(np.uint64(xxhash.xxh64_intdigest(b"abc", 42)).astype(np.int64))]
    hashes = np.random.default_rng(1).integers(0, 2**63, 5_000).astype(np.uint64)
    _, slots = audit.minimal_hash(hashes)
    assert sorted(slots.tolist()) == list(range(5_000))
    terms = [(lang, f"{lang}{k}".encode(), 5) for lang in ("en", "de") for k in range(300)]
    table, slots = audit.perfect_hash(spark.createDataFrame(terms, "lang string, term binary, n_docs long"))
    named = {(r.lang, bytes(r.term)): r.slot for r in slots.collect()}
    assert len(named) == 600 and sorted(named.values()) == sorted([*range(300)] * 2)
    asked = [t for lang, t, _ in terms if lang == "en"]
    assert table.find("en", asked).tolist() == [named["en", t] for t in asked]
    assert set(table.find("de", asked + [b"unknown"]).tolist()) == {-1} and table.find("xx", [b"a"]).tolist() == [-1]


def test_large_counts_are_exact():
    n = np.array([0, 9_000_000_000, 12_345_678_901_234], dtype=np.int64)
    assert audit.shares(n, np.array(77_777_777_777_777)).tolist() == [1 + 10**9 * (int(x) + 1) // 77_777_777_777_777 for x in n]


def test_packed_counts():
    for values in ([0, 0, 0], [0, 1, 255], [7, 0, 256], [2**40, 0, 1]):
        to = np.array([1, 1, 1])
        audit.add_packed(audit.packed(np.array(values)), to)
        assert to.tolist() == [v + 1 for v in values]
    keys = [("en", "s", 0, [1, 0, 3]), ("en", "s", 0, [0, 300, 1]), ("en", "t", 0, [5, 0, 0]), ("en", "t", 2, [0, 0, 9])]
    batches = [audit.block_rows(lang, source, [block], [np.array(values)]) for lang, source, block, values in keys]
    got = [row for batch in audit._add_up(iter(batches), 3) for row in batch.to_pylist()]
    assert [(r["source"], r["block"], r["n"]) for r in got] == [("s", 0, 305), ("t", 0, 5), ("t", 2, 9)]
    total = np.zeros(3, dtype=np.int64)
    audit.add_packed(got[0]["counts"], total)
    assert total.tolist() == [1, 300, 4]
