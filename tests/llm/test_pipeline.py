"""The pipeline against the stages done by brute force, and on odd and empty documents."""

import re
import sys
from collections import defaultdict

import corpus_pipeline
import __spark_entry__ as entry_points
from check import compare, duck
from signalmart.llm import hd_language, queries
from test_dedup import key, near_copies, shingles


def brute_remove(rows, length):
    """Texts without repeated bytes, in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        body = (t or "").encode()
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            if body[s:s + length] in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(body[s:s + length])
        out[i] = (body, bytes(c for c, hit in zip(body, covered) if not hit), any(covered))
    return out


def expected_tokens(spark, docs):
    rows = {(r.doc_id, r.text) for r in hd_language.identify(docs).join(docs.select("doc_id", "text"), "doc_id").where(
        f"lang_pred != 'und' and score >= {hd_language.LEAST_SCORE}").collect()}
    last = {}
    for i, t in rows:
        last[t] = max(last.get(t, i), i)
    rows = sorted((i, t) for t, i in last.items())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t, 5) for i, t in rows}
    for a, _ in rows:
        for b, _ in rows:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = [(i, t) for i, t in rows if root(i) == i]
    out = {}
    for i, (_, kept, cut) in brute_remove(rows, 100).items():
        text = kept.decode("utf-8", "ignore")
        if text or not cut:
            out[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = near_copies(11, 8, 6, 90)
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(500 + k, f"start {k} {passage} end {k * k} " + " ".join(f"v{k * 97 + j}" for j in range(50))) for k in range(12)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, "12 34"), (703, "")]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == expected_tokens(spark, docs) and len(got) < len(rows) - 20


def test_stages_keep_the_columns_of_documents(spark, documents, nothing):
    for docs in (documents, nothing):
        for name, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, "").columns == documents.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "suffix_dedup", "best_fit_packing"]


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES if name != "pipeline")
    assert numbers == list(range(1, 14)) and set(queries.QUERIES) <= set(entry_points.queries())
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and "signalmart.llm" in sys.modules
    assert key(None) < key(0)


def test_oracles(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name, sql in queries.ORACLES.items():
        assert compare(spark, duck(sf_dir), sf_dir, name, queries.QUERIES[name], sql).startswith("ok")
