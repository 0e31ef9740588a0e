import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import plan

from signalmart.llm import exact_dedup, jaccard_join, suffix_dedup
from signalmart.llm.components import components
from signalmart.llm.shingles import shingle_set


def key(value):
    return (value is not None, value or 0)


# --- exact ----------------------------------------------------------------------------

def test_exact_groups_of_odd_documents(documents):
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = sorted((key(i), key(max(groups[t or ""], key=key)), len(groups[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    rows = exact_dedup.exact_groups(documents).collect()
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    kept = defaultdict(int)
    for r in rows:
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_levels_tell_late_differences_apart(spark):
    base = "z" * 5_000
    texts = [(k, base[:k * 300] + chr(97 + k % 2) + base[k * 300 + 1:]) for k in range(16)] * 2 + [(50, base), (51, base)]
    rows = {(r.doc_id, r.group_size, r.keep_id) for r in exact_dedup.exact_groups(
        spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows == {(k, 2, k) for k in range(16)} | {(50, 2, 51), (51, 2, 51)}


def test_drop_copies_keeps_one_row_of_each(documents, nothing):
    rows = exact_dedup.drop_copies(documents).collect()
    assert len(rows) == len({r.text or "" for r in rows}) == documents.selectExpr("coalesce(text, '')").distinct().count()
    assert {r.doc_id for r in rows if r.text and r.text.startswith("The quick")} == {2}
    assert exact_dedup.drop_copies(documents).columns == documents.columns
    assert exact_dedup.drop_copies(nothing).count() == 0 and exact_dedup.exact_groups(nothing).count() == 0


# --- components -----------------------------------------------------------------------

def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(-5, -7), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 120)} | {-5: -7, -7: -7}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Jaccard --------------------------------------------------------------------------

def shingles(text, words):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    return frozenset(tuple(found[k:k + words]) for k in range(max(1, len(found) - words + 1)))


def brute_components(texts, words, percent):
    sets = [(i, shingles(t, words)) for i, t in texts]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            shared = len(a & b)
            if a and b and 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[root(x)] = root(y)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((key(i), len(s), key(least.get(root(k)) if s else i)) for k, (i, s) in enumerate(sets))


def near_copies(seed, families, members, words):
    random.seed(seed)
    rows = []
    for f in range(families):
        base = [f"w{random.randrange(400)}" for _ in range(words)]
        for _ in range(members):
            copy = list(base)
            for _ in range(random.randrange(0, 4)):
                copy[random.randrange(len(copy))] = f"W{random.randrange(400)}"
            rows.append((len(rows), " ".join(copy[random.randrange(3):])))
    return rows


@pytest.mark.parametrize(("words", "percent", "tile"), [(3, 90, 4_000_000), (5, 80, 4_000_000), (3, 80, 700), (5, 80, 701)])
def test_components_match_all_pairs(spark, words, percent, tile):
    texts = near_copies(words, 6, 25, 60) + [(900 + k, " ".join(["one", "two", "three", "four"][:k])) for k in range(5)]
    crowd = tile - 697 if tile < 1_000 else jaccard_join.CROWD
    got = jaccard_join.linked(spark.createDataFrame(texts, "doc_id long, text string"), words, percent, tile, crowd).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute_components(texts, words, percent)


def test_odd_documents_join(documents, nothing):
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = jaccard_join.document_components(documents).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute_components(texts, 3, 90)
    assert jaccard_join.document_components(nothing).count() == 0
    kept = jaccard_join.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and {3, 4, 5, 9, 10, 13} <= set(ids)


def test_shingle_sets_ignore_only_ascii_case_and_spaces():
    assert list(shingle_set("A b\tC  d", 3)) == list(shingle_set("a B c\nD", 3))
    assert list(shingle_set("É b c", 3)) != list(shingle_set("é b c", 3))
    assert len(shingle_set(None, 3)) == len(shingle_set(" \n", 3)) == 0
    assert len(shingle_set("a b", 3)) == 1 and shingle_set("a b", 3)[0] != shingle_set("a b", 2)[0]


def test_long_words_of_a_pattern_are_told_apart(spark):
    """Thue-Morse words and their mirror images: sums of powers modulo 2^64 take them for equal."""
    rows = []
    for n in (16, 17, 64, 1_024, 2_048, 4_096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        rows += [(len(rows) + k, w) for k, w in enumerate((word, word.translate(str.maketrans("ab", "ba")), word.upper()))]
    rows += [(100 + k, f"{'X' * 1_500} two {'é' * 700} {k % 2}") for k in range(4)]
    got = jaccard_join.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute_components(rows, 3, 90)


def test_a_group_of_near_copies_is_walked_a_few_times():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 40).astype(np.uint64)
    n = 5_000
    sets = [np.unique(np.concatenate([np.delete(base, i % 40), draw.integers(0, 2**63, 1).astype(np.uint64)])) for i in range(n)]
    looked = []
    verify = jaccard_join.overlap
    jaccard_join.overlap = lambda a, b: looked.append(1) or verify(a, b)
    try:
        links = jaccard_join.local_links(list(range(n)), sets, [False] * n, jaccard_join.Threshold(90))
    finally:
        jaccard_join.overlap = verify
    assert len(links) == n - 1 and len(looked) <= 2 * jaccard_join.HUBS * n


@pytest.mark.parametrize("verified", [False, True])
def test_connections_equal_all_pairs(verified):
    random.seed(6)
    for n in (1, 2, 30, 120):
        near = {i: {j for j in range(n) if random.random() < 1.2 / n} for i in range(n)}
        for i in range(n):
            for j in near[i]:
                near[j].add(i)
        holds = lambda i, j: (i * 7 + j * 7) % 3 > 0
        pairs = jaccard_join.connections(n, lambda i: np.array(sorted(near[i]), dtype=np.int64), holds if verified else None)
        assert all(j in near[i] and (not verified or holds(i, j)) for i, j in pairs)

        def parts(edges):
            of = list(range(n))
            for i, j in edges:
                a, b = of[i], of[j]
                of = [a if x == b else x for x in of]
            return [of.index(x) for x in of]

        assert parts(pairs) == parts([(i, j) for i in near for j in near[i] if not verified or holds(i, j)])


@pytest.mark.parametrize("percent", [80, 90])
def test_leading_shingles_of_linked_sets_meet(percent):
    random.seed(percent)
    threshold = jaccard_join.Threshold(percent)
    counts = np.random.default_rng(1).integers(0, 4, jaccard_join.COUNTERS)
    draw = np.random.default_rng(2)
    linked = 0
    for n in [*range(1, 40), 100, 300]:
        for _ in range(10):
            a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.97], draw.integers(0, 2**63, n // 20, dtype=np.uint64)]))
            if len(b) and threshold.linked(jaccard_join.overlap(a, b), len(a) + len(b)):
                linked += 1
                first = [set(jaccard_join.leading_shingles(x, counts, threshold).tolist()) for x in (a, b)]
                assert first[0] & first[1]
    assert linked > 100


# --- byte strings ---------------------------------------------------------------------

def brute_repeats(texts, length):
    seen, out = set(), {}
    order = sorted(texts, key=lambda r: key(r[0]))
    for i, t in order:
        body = (t or "").encode()
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            if body[s:s + length] in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(body[s:s + length])
        kept = bytes(c for c, hit in zip(body, covered) if not hit)
        spans = sum(1 for k in range(len(body)) if covered[k] and (not k or not covered[k - 1]))
        out[key(i)] = (len(body), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "most"), [(100, 20_000), (100, 2), (30, 20_000), (30, 3)])
def test_repeats_match_brute_force(spark, length, most):
    random.seed(length + most)
    parts = ["".join(random.choice("ab é\x00") for _ in range(random.randint(20, 70))) for _ in range(25)]
    texts = [(k, None if k % 19 == 0 else "".join(random.choice(parts) for _ in range(random.randint(0, 10)))) for k in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {key(r.doc_id): tuple(r)[1:] for r in suffix_dedup.report(df, length, most).collect()}
    assert got == brute_repeats(texts, length)


def test_a_phrase_between_different_words_is_in_no_merge(spark, monkeypatch):
    """A phrase shorter than the strings gives one entry per document; a merge sees at most ``most`` of them."""
    random.seed(8)
    phrase = "all rights reserved, printed on paper of the same old mill"
    noise = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(60, 150))) for _ in range(400)]
    texts = [(k, noise[k] + phrase + noise[-k if k % 5 else 0]) for k in range(300)]
    largest = []
    merge = suffix_dedup.merge_spans

    def watched(parts, sampling, *rest):
        for rows in parts.toPandas().groupby("partition")["run"]:
            entries = [e[:sampling.anchor] for data in rows[1] for e, _, _ in suffix_dedup._open_run(data, sampling.width)]
            largest.append(max(entries.count(a) for a in set(entries)))
        return merge(parts, sampling, *rest)

    monkeypatch.setattr(suffix_dedup, "merge_spans", watched)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {key(r.doc_id): tuple(r)[1:] for r in suffix_dedup.report(df, 100, 40).collect()}
    assert got == brute_repeats(texts, 100)
    assert max(largest) <= 40


@pytest.mark.parametrize("doc_id", [1, None])
def test_repeated_rows_are_sampled_once(spark, monkeypatch, doc_id):
    """Many rows with one id and text are one document: its places come once, not once for each pair of rows."""
    random.seed(9)
    body = "".join(random.choice("abcdefgh ") for _ in range(2_000))
    texts = [(doc_id, body)] * 60 + [(5, body[500:900] + "another ending"), (6, "short")]
    handed = []
    run = suffix_dedup.runs

    def watched(rows, *rest):
        handed.extend(len(r.places) for r in rows.select("places").collect())
        return run(rows, *rest)

    monkeypatch.setattr(suffix_dedup, "runs", watched)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = [(key(r.doc_id), tuple(r)[1:]) for r in suffix_dedup.report(df).collect()]
    want = brute_repeats([(doc_id, body), *texts[60:]], 100)
    assert len(rows) == 62 and all(found == want[i] for i, found in rows)
    assert sum(handed) <= 2_000 / 10


def test_repeats_of_odd_documents(documents, nothing):
    texts = {(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()}
    once = [r for r in texts if r[0] not in (None, 12)]
    want = brute_repeats(once, 100)
    rows = [(key(r.doc_id), tuple(r)[1:]) for r in suffix_dedup.report(documents).collect()]
    assert len(rows) == documents.count()
    assert all(found == want[i] for i, found in rows if i in want)
    assert suffix_dedup.report(nothing).count() == 0


def test_drop_repeats_keeps_columns_and_first_passages(documents, nothing):
    rows = {r.doc_id: r for r in suffix_dedup.drop_repeats(documents).collect()}
    assert suffix_dedup.drop_repeats(documents).columns == documents.columns
    assert "this passage of plain words" in rows[9].text and "this passage of plain words" not in rows[10].text
    assert 8 not in rows and rows[10].n_chars == len(rows[10].text) and rows[10].owner == "tie"
    assert suffix_dedup.drop_repeats(nothing).count() == 0


def test_repeats_are_cut_out_by_one_call(documents):
    """Not once for the filter and once more for the text: each call has Python workers of its own."""
    assert plan(suffix_dedup.drop_repeats(documents)).count("ArrowEvalPython") == 1


def test_loser_tree_merges_and_tells_shared_prefixes():
    random.seed(1)
    width = 8
    lists = [sorted(bytes(random.choice(b"ab") for _ in range(width)) for _ in range(random.randint(0, 30))) for _ in range(7)]

    def source(n):
        before = b""
        for k, e in enumerate(lists[n]):
            shared = next((i for i in range(width) if k == 0 or e[i] != before[i]), width)
            yield e, shared, (n, k, 0)
            before = e

    out = list(suffix_dedup.merged([source(n) for n in range(7)], width))
    assert [e for e, _, _ in out] == sorted(e for entries in lists for e in entries)
    for (x, _, _), (y, shared, _) in zip(out, out[1:]):
        assert shared == next((i for i in range(width) if x[i] != y[i]), width)
