import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmart.llm import hd_language, quality

SF_DIR = "/root/testdata/sf0.01"


# --- language -------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = hd_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert found.where("held_out").count() == sum(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs.collect())


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(hd_language.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, hd_language.identify(docs).collect())) == sorted(map(tuple, hd_language.identify(other).collect()))


def test_odd_documents_language(documents, nothing):
    rows = hd_language.identify(documents).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert {k: by[k].lang_pred for k in (3, 4, 5, 13)} == dict.fromkeys((3, 4, 5, 13), "und")
    assert by[3].score == 0 and {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert hd_language.identify(nothing).count() == 0
    kept = hd_language.keep_identified(documents)
    assert kept.columns == documents.columns and {r.score for r in kept.collect()} <= {f"x{k}" for k in range(21)}
    assert not {3, 4, 5, 13} & {r.doc_id for r in kept.collect()}


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(k, text, "en" if k % 2 else "de") for k, text in enumerate(["the words here", "die worte da"] * 6)]
                                 + [(50, "\u0301\u0301 \u0300", "en"), (51, "\u20d0\U0001e8d0", None), (52, "e\u0301", None), (53, "\u4e2d", None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in hd_language.identify(docs).collect()}
    assert got[50] == got[51] == "und" and got[52] != "und" and got[53] != "und"


def test_without_training_rows_everything_is_unknown(documents):
    assert {r.lang_pred for r in hd_language.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundles_equal_the_definition():
    vectors = hd_language.Vectors(64)
    texts = ["Hello, wörld 123 hello", "x"]
    got = hd_language.bundle([hd_language.text_grams(t) for t in texts], vectors)
    for text, row in zip(texts, got):
        codes = hd_language.letters(text).tolist()
        want = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            want += np.roll(vectors.of_letter(a), 2) * np.roll(vectors.of_letter(b), 1) * vectors.of_letter(c)
        assert np.array_equal(row, want)
    assert "".join(map(chr, hd_language.letters("Ab, c!"))) == " ab c "


# --- quality --------------------------------------------------------------------------

def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def statistics(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed) for r in rows)


def test_statistics_of_odd_documents(spark, documents, nothing):
    random.seed(2)
    more = [(100 + k, "".join(random.choice(["a ", "b ", "c\n", "<é> ", "\x0b", "#d ", "ü"]) for _ in range(random.randrange(400))))
            for k in range(150)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (None, 1, 0), (9, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert statistics(rows) == sorted((r.doc_id is not None, r.doc_id or 0, *brute_statistics(r.text)) for r in docs.collect())
    assert all(r.kept == (not r.base_failed and r.score >= quality.LEAST_SCORE) for r in rows)
    assert quality.scored(nothing, labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.where("false")).collect()} == {0.0}


def test_good_and_bad_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_score_is_the_mean_log_ratio(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 8)
    docs = spark.createDataFrame([(1, "a b a"), (2, "c c"), (3, "d"), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in quality.scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()}
    grams = docs.select("doc_id", quality.hashed(quality.words(F.col("text"))).alias("h")).withColumn("p", quality.paired("h")).select(
        "doc_id", F.transform(F.concat("h", "p"), quality.bucket).alias("b")).collect()
    raw, good = Counter(), Counter()
    for r in grams:
        raw.update(r.b)
        good.update(r.b if r.doc_id == 1 else [])
    for r in grams:
        ratios = [np.log((good[b] + 1) / (good.total() + 8)) - np.log((raw[b] + 1) / (raw.total() + 8)) for b in r.b]
        assert rows[r.doc_id] == pytest.approx(np.mean(ratios) if ratios else 0.0, abs=1e-5)


def test_the_main_path_has_no_python(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.scored(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_verdicts_can_be_filtered(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    table = quality.scored(docs, labels)
    rows = table.collect()
    for condition, holds in (("kept", lambda r: r.kept), ("not base_failed", lambda r: not r.base_failed),
                             ("n_repeat_words > 3", lambda r: r.n_repeat_words > 3)):
        assert {r.doc_id for r in table.where(condition).collect()} == {r.doc_id for r in rows if holds(r)}
