import base64
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalmart.llm import bpe, license_scan, warc
from signalmart.sources.shared import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pieces():
    return bpe.pieces(PATH)


def strange_texts():
    random.seed(4)
    yield from ("", " \n", "Hello World's don't <|endoftext|>x<|startoftext|>", "ΣΑΣ İstanbul ﬁ é \x1c x\x85y", "日本語テキスト 한국어", "a" * 3_000)
    for alphabet in ("aet", "etaoinshrdlu", "ab!", "éaß ", "".join(map(chr, range(32, 127)))):
        yield "".join(random.choice(alphabet) for _ in range(4_000))


def test_ids_and_decoding_match_the_library(library, pieces):
    for text in strange_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        n, spelled_ids, decoded = pieces.summary(text)
        assert list(pieces.encode(text)) == ids and n == len(ids) and spelled_ids == " ".join(map(str, ids))
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_every_character_gets_the_ids_of_the_library(library, pieces):
    """All code points, among letters and on their own; some were made letters after the library's Unicode tables."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}" for c in codes[k:k + 400]) for k in range(0, len(codes), 400)]
    for k, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert list(pieces.encode(text)) == want.ids, hex(codes[400 * k])


def test_chunks_change_nothing(pieces, monkeypatch):
    for text in strange_texts():
        n, ids, spelled = pieces.summary(text)
        want = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(spelled.encode()).hexdigest())
        assert pieces.digests(text) == want
        assert "".join(bpe.chunks(text, 7)) == text
        monkeypatch.setattr(bpe, "chunks", lambda t, cut=bpe.chunks: cut(t, 7) if cut.__name__ == "chunks" else cut(t))
        assert pieces.digests(text) == want
        monkeypatch.undo()


def test_new_words_are_learnt_from_where_the_word_before_left(pieces, monkeypatch):
    """A word that begins like another costs its own end only, and its tokens are those it has alone."""
    random.seed(5)
    stem = "".join(random.choice("etaoinsh") for _ in range(40))
    words = [stem[:random.randrange(1, 40)] + random.choice(("", "s", "é", "日本", "ß", "zq")) for _ in range(2_000)]
    fresh, calls, last = bpe.Pieces(PATH), 0, bpe.Encoder._last

    def counted(*args):
        nonlocal calls
        calls += 1
        return last(*args)

    monkeypatch.setattr(bpe.Encoder, "_last", counted)
    assert len(fresh.digests_of([" ".join(words[:1_000]), "", " ".join(words[1_000:])])) == 3
    monkeypatch.undo()
    assert calls < sum(len(fresh.spelt(w)) for w in set(words)) / 3
    for w in set(words):
        ids = list(pieces.encode_word(w))
        assert fresh.known[w] == (len(ids), " ".join(map(str, ids)), " ".join(pieces.tokens[i] for i in ids))


def test_texts_learnt_together_give_what_each_gives_alone(pieces, monkeypatch):
    texts = [*strange_texts(), "old words\tagain " * 30, "\ua7cb \u1c89x \U00010d50\u0558 a\u088fb"]
    want = [pieces.digests(t) for t in texts]
    monkeypatch.setattr(bpe, "LEARNT", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    assert bpe.Pieces(PATH).digests_of(texts) == want and bpe.Pieces(PATH).digests_of([]) == []


def test_tokenize_returns_ids_and_text(documents, nothing, pieces):
    rows = bpe.tokenize(documents, PATH).collect()
    texts = {(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()}
    assert len(rows) == documents.count() and bpe.tokenize(nothing, PATH).count() == 0
    got = {(r.doc_id, tuple(r.ids)) for r in rows}
    assert got == {(i, tuple(pieces.encode(t or ""))) for i, t in texts}
    assert {r.decoded.strip() for r in rows if r.doc_id == 1} == {"the quick brown fox jumps over the lazy dog near the river bank today ."}


def test_the_encoder_streams_in_constant_memory(pieces):
    """Tokens come out while a very long word is still being read."""
    read = 0

    def letters():
        nonlocal read
        for _ in range(60_000):
            read += 1
            yield random.choice("etaoin")

    behind = 0
    emitted = 0
    for token in pieces.encoder.encode(letters()):
        emitted += len(token.removesuffix(bpe.END))
        behind = max(behind, read - emitted)
    assert emitted == 60_000 and behind <= 2 * pieces.encoder.window + 2


def test_the_lookahead_bound_holds_on_small_merge_lists():
    """No letter beyond the bound changes the tokens before it."""
    random.seed(8)
    for _ in range(40):
        merges, tokens = [], ["a", "b"]
        while len(merges) < 8:
            pair = (random.choice(tokens), random.choice(tokens))
            if "".join(pair) not in tokens and len("".join(pair)) <= 8:
                merges.append(pair)
                tokens.append("".join(pair))
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", "a</w>", "b</w>", *tokens]))}
        m = bpe.Merges(vocabulary, merges)
        encoder = bpe.Encoder(m)
        for _ in range(30):
            text = [random.choice("ab") for _ in range(random.randrange(1, 120))]
            want = m.merge([*text[:-1], text[-1] + bpe.END])
            if all(t in m.size for t in want):
                assert list(encoder.encode(text)) == want


def test_round_trip_to_text(pieces):
    text = "naïve café 日本 test"
    decoder = bpe.Decoder(pieces.tokens, plain=True, special=frozenset(pieces.special.values()))
    assert "".join(decoder.feed(pieces.encode(text))) + decoder.close() == text.lower() + " "


def test_odd_documents_encode(documents, nothing, library):
    rows = bpe.encode_documents(documents, PATH).collect()
    want = []
    for i, text in ((r.doc_id, r.text) for r in documents.collect()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows) == sorted(want)
    assert bpe.encode_documents(nothing, PATH).count() == 0


# --- WARC -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://a{k % 3}.example.com:8080/p{k % 5}?q={k % 2}#f", f"<p>{k % 4}\r\n\r\nWARC/1.1\r\né</p>") for k in range(1, 40)]
    rows += [(50, None, None), (51, "", ""), (52, "not a url\r\nX: y", "<p>1"), (None, "http://b.org", "<p>none"), (None, "http://b.org", "<p>1"),
             (60, "http://b.org/", "x" * 300_000), (2**60 + 1, "https://u@H.ORG", "big id"), (5, "http://b.org", "second of five"),
             (1, "http://a1.example.com:8080/p1?q=1#f", "<p>1\r\n\r\nWARC/1.1\r\né</p>")]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha string")


def test_archives_read_back(pages):
    first = {}
    for r in pages.collect():
        body = (r.html or "").encode()
        if r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        body = (r.html or "").encode()
        leader = first.get(body)
        revisit = leader is not None and r.page_id != leader
        want.append((str(r.page_id), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "revisit" if revisit else "response", str(leader if revisit else None)))
    got = warc.archive_and_read(pages).collect()
    assert sorted((str(r.page_id), *tuple(r)[1:4], str(r.refers_to)) for r in got) == sorted(want)
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_index_finds_just_the_captures_of_a_key(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 3)
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 12)
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder)
    captures = warc.read_captures(spark, folder)
    index = warc.build_index(captures)
    assert index.select("range").distinct().count() > 1 and index.count() > 12
    for key in ("org,b)/", "com,example,a1)/p1?q=1", "", "com,example,a1)/p", "zzz"):
        found = warc.lookup(index, spark.createDataFrame([(key,)], "key string")).collect()
        assert sorted(map(str, found)) == sorted(map(str, captures.where(captures["key"] == key).collect()))
    read = warc.fetch(spark, folder, warc.lookup(index, spark.createDataFrame([("org,b)/",)], "key string")))
    assert sorted(str(r.page_id) for r in read.collect()) == ["5", "60", "None", "None"]


def test_short_payloads_are_never_revisits(spark, pages):
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder, revisit_from=10_000)
    kinds = warc.fetch(spark, folder, warc.read_captures(spark, folder)).groupBy("record_type").count().collect()
    assert {r.record_type for r in kinds} == {"response"}


# --- licenses -------------------------------------------------------------------------

def test_licenses_and_their_wording(spark, nothing):
    mit = license_scan.TEMPLATES["MIT text"]
    rows = [(1, "words\nLicensed under CC BY-NC 4.0.\nmore"), (2, "Released under the MIT\nLicense."), (3, None), (4, ""),
            (5, "the license of a driver"), (6, "x " * 50_000 + mit.replace("free of charge", "without charge") + " y" * 50_000),
            (7, "Licensed under the Apache License, Version 2.0. All rights reserved."), (7, "no such word"), (None, "All Rights Reserved")]
    found = license_scan.scan_documents(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, block string"))
    confirmed = sorted((str(r.doc_id), r.license, r.n_differences) for r in found.where("confirmed").collect())
    assert confirmed == [("1", "CC-BY-NC-4.0", 0), ("2", "MIT", 0), ("6", "MIT text", 3), ("7", "Apache-2.0", 0), ("7", "reserved", 0),
                         ("None", "reserved", 0)]
    mended = found.where("license = 'MIT text'").first()
    assert (mended.missing, mended.extra, mended.start) == (["free", "of"], ["without"], 50_000)
    assert [r.confirmed for r in found.where("doc_id = 5").collect()] == [False]
    assert license_scan.scan_documents(nothing).count() == 0


def test_license_lines_of_the_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "reserved"}
    want = {(r.doc_id, name) for r in docs.collect() for line, name in lines.items() if line in r.text}
    got = {(r.doc_id, r.license) for r in license_scan.scan_documents(docs).where("confirmed").collect()}
    assert want and want == got
