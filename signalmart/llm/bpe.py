"""BPE encoding and decoding as streaming transducers over a public tokenizer file.

The encoder reads a word symbol by symbol.  For every position it keeps the last token of the
tokenization of the word up to there; that token is the one whose pair with the token before
is left alone by the merges.  Any longer tokenization passes through one of the last ``longest``
positions, so once the chains of those positions have met, everything before the meeting point is
stable and is emitted.  ``lookahead`` bounds from the merge list how far a merge can reach to the right:
a chain of overlapping merges of ever higher priority.  So memory does not grow with the word.
Short words that are new to a worker are gone through in alphabetical order, from where they leave the word before.

The decoder is a state machine over bytes: it holds at most the open bytes of one character.

Text handling (``Pieces``) follows the file's normalizer and pre-tokenizer: NFC, lower case, words with ends.  What is a letter is told by
the installed ``regex``, but for those that came after the tables of the tokenizers library (``NEWER``), which takes
them for signs.  Texts are worked on in chunks that end at white space, where no word and no composition goes on.
Null text counts as empty.  Other columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches

END = "</w>"
# The pre-tokenizer's pattern, with Unicode's white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"[\p{{L}}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
# The same for lower-case ASCII.
ASCII_WORDS = r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+"
# The same where some letters and numbers count as signs.
WORDS_BUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]|(?:[^{space}\p{{L}}\p{{N}}]|[{newer}])+"
# Characters of a text that are worked on at once.
CHUNK = 1 << 16
# Characters whose new words are learnt together.
LEARNT = 1 << 20
# Words up to this length are remembered, this many at most.
REMEMBERED_LENGTH = 64
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# Letters and numbers of Unicode that came after the tables of the tokenizers library, for which they are signs.
NEWER = (
    "0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f")
# Capitals that the library brings to lower case and Python's older tables do not; ranges by a common distance.
CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
NEWER_CLASS = "".join("-".join(f"\\U{int(end, 16):08x}" for end in item.split("-")) for item in NEWER.split())
# Every capital and newer character is in here: one quick class, since ranges beyond U+FFFF are tried one after the other.
RARE = re.compile("[" + "".join(chr(c) for c in CAPITALS if c <= 0xFFFF)
                  + "".join("-".join(f"\\u{end}" for end in item.split("-")) for item in NEWER.split() if len(item.split("-")[0]) == 4)
                  + "\\U00010000-\\U0010ffff]")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` that end behind white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + size
        space = ASCII_SPACE.search(text, end) if end < len(text) else None
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


ASCII_SPACE = re.compile(r"[ \t\n\r]")
BYTES = {symbol: byte for byte, symbol in enumerate(byte_symbols())}


class Merges:
    """A merge list: ranks, the tokens' spellings, and whether two tokens stay apart."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], end: str = END) -> None:
        self.ids, self.end = vocabulary, end
        self.rank = {pair: rank for rank, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        if len(self.parts) < len(self.rank):
            raise ValueError("two merges make the same token")
        spelled = {t: self.symbols(t) for t in vocabulary if t in self.parts or len(self.symbols(t)) == 1}
        # Tokens that the merges make of their own spelling, and how many symbols they have.
        self.size = {t: len(s) for t, s in spelled.items() if len(s) == 1 or self.merge(s) == [t]}
        self.longest = max(self.size.values(), default=1)
        # Beginnings of tokens, whole ones too: where none of these is, no token is looked for.
        self.begun = {"", end, *self.size, *("".join(s[:k]) for t, s in spelled.items() if t in self.size for k in range(1, len(s)))}
        self._apart: dict[tuple[str, str], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.lookahead = self._lookahead()

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if token != self.end else token
        return [*body[:-1], body[-1:] + token[len(body):]]

    def merge(self, symbols: list[str]) -> list[str]:
        """The plain definition, for short inputs: the leftmost pair of the lowest rank, again and again."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), len(self.rank)))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """What stands at one edge of a token while it is built: symbol, rank that makes it, rank that takes it in."""
        known = self._edges[side].get(token)
        if known is None:
            known, taken, at = [], len(self.rank), token
            while at in self.parts:
                made = self.rank[self.parts[at]]
                known.append((at, made, taken))
                at, taken = self.parts[at][side], made
            known.append((at, -1, taken))
            self._edges[side][token] = known
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges leave these two tokens side by side.

        They do unless some merge joins what stands at the two edges at the same time.  Of equal merges
        the leftmost comes first, so one inside the left token wins, one inside the right token loses.
        """
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) >= REMEMBERED:
                self._apart.clear()
            known, rank = True, self.rank.get
            for a, made_a, taken_a in self._edge(left, 1):
                for b, made_b, taken_b in self._edge(right, 0):
                    joined = rank((a, b))
                    if joined is not None and made_a < joined < taken_a and made_b < joined <= taken_b:
                        known = False
            self._apart[left, right] = known
        return known

    def _lookahead(self) -> int:
        """Symbols to the right of a token that can decide about it, at most.

        A merge is undone only by one of higher priority that takes a beginning of its right part, and so on:
        the longest such chain, in symbols, over the merges in order of priority.
        """
        reach: dict[str, int] = {}  # by left part: the farthest chain of the merges so far
        farthest = 0
        for left, right in self.rank:
            here, spine = len(self.symbols(right)), right
            while spine:
                here = max(here, len(self.symbols(spine)) + reach.get(spine, 0))
                spine = self.parts[spine][0] if spine in self.parts else ""
            reach[left] = max(reach.get(left, 0), here)
            farthest = max(farthest, here)
        return farthest


class Encoder:
    """Tokens of one word at a time, emitted as soon as nothing to the right can change them."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.window = merges.longest + merges.lookahead

    def _last(self, text: str, ending: str, last: list[str], first: int) -> tuple[str, int]:
        """The last token of ``text`` and ``ending``, and where the longest beginning of a token that reaches the end starts.

        ``last`` has the last token at each position before (at first the one before the text); ``first`` is that start
        one symbol earlier: what begins before it has ended.
        """
        size, begun, apart, known = self.merges.size, self.merges.begun, self.merges.apart, self.merges._apart
        while (token := text[first:] + ending) not in begun:
            first += 1
        for start in range(first, len(text)):
            if token in size and (not (before := last[start]) or (known.get((before, token)) or apart(before, token))):
                return token, first
            token = text[start + 1:] + ending
        raise ValueError(f"no token for {text[-1:]!r}")

    def _chain(self, last: list[str], end: int) -> list[str]:
        """Tokens up to a position, in order."""
        size, tokens = self.merges.size, []
        while end:
            tokens.append(last[end])
            end -= size[last[end]]
        tokens.reverse()
        return tokens

    def encode(self, symbols: Iterable[str]) -> Iterator[str]:
        """``symbols`` in byte characters; the last one is taken with the end mark."""
        m = self.merges
        # Since the last emitted boundary: symbols, and the last token at each position (first the one before it).
        text, last, tail, first = "", [""], None, 0
        for symbol in symbols:
            if tail is not None:
                text += tail
                token, first = self._last(text, "", last, first)
                last.append(token)
                if len(text) >= 2 * self.window:
                    n = len(text)
                    meeting = set(range(n - m.longest + 1, n + 1))
                    while len(meeting) > 1:
                        i = max(meeting)
                        meeting.remove(i)
                        meeting.add(i - m.size[last[i]])
                    boundary = meeting.pop()
                    if boundary:
                        yield from self._chain(last, boundary)
                        text, last, first = text[boundary:], last[boundary:], max(first - boundary, 0)
            tail = symbol
        if tail is None:
            return
        text += tail
        last.append(self._last(text, m.end, last, first)[0])
        yield from self._chain(last, len(text))

    def encode_sorted(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Tokens of short words, each in byte characters: one that begins like the word before goes on from there."""
        text, last, firsts = "", [""], [0]
        for word in words:
            n = len(word)
            same, most = 0, min(n - 1, len(text))
            while same < most and word[same] == text[same]:
                same += 1
            del last[same + 1:], firsts[same + 1:]
            first, text = firsts[same], word[:-1]
            for end in range(same + 1, n):
                token, first = self._last(word[:end], "", last, first)
                last.append(token)
                firsts.append(first)
            token = self._last(word, self.merges.end, last, first)[0]
            yield [*self._chain(last, n - self.merges.size[token]), token]


class Decoder:
    """Text from ids, piece by piece.

    ``plain=False`` gives the tokens' own spelling, one space between two; ``plain=True`` gives the text
    that the bytes spell, with a space for every word end.
    """

    def __init__(self, tokens: dict[int, str], plain: bool, special: frozenset[int] = frozenset()) -> None:
        self.tokens, self.plain, self.special = tokens, plain, special
        self.open = codecs.getincrementaldecoder("utf-8")("replace") if plain else None
        self.started = False

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            token = self.tokens[i]
            if not self.plain:
                yield " " + token if self.started else token
                self.started = True
            elif i in self.special:
                yield self.open.decode(b"", final=True) + token
            else:
                body = token.removesuffix(END)
                yield self.open.decode(bytes(BYTES[c] for c in body)) + " " * (body != token)

    def close(self) -> str:
        return self.open.decode(b"", final=True) if self.open else ""


class Pieces:
    """Words of a text as the tokenizer file cuts them, and their ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])
        self.encoder = Encoder(self.merges)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words_of, self.ascii_words_of = regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.newer = re.compile(f"[{NEWER_CLASS}]")
        self.words_but = regex.compile(WORDS_BUT.format(newer=NEWER_CLASS, space=SPACE), flags=regex.V1)
        self.symbol_of = byte_symbols()
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def words(self, text: str) -> list[str]:
        """Words in order, special tokens among them as they are."""
        parts = self.cut.split(text) if self.cut else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if part.isascii():
                    out += self.ascii_words_of.findall(part)
                    continue
                known = True
                if RARE.search(part):
                    if CAPITAL.search(part):
                        part = part.translate(CAPITALS)
                    known = not self.newer.search(part)
                out += (self.words_of if known else self.words_but).findall(part)
        return out

    def spelt(self, word: str) -> str:
        """The word in byte characters."""
        if word.isascii() and word.isprintable():  # these stand for themselves
            return word
        return "".join([self.symbol_of[b] for b in word.encode("utf-8", "replace")])

    def encode_word(self, word: str) -> Iterator[int]:
        if word in self.special:
            return iter([self.special[word]])
        return map(self.merges.ids.__getitem__, self.encoder.encode(self.spelt(word)))

    def described(self, ids: Iterable[int]) -> tuple[int, str, str]:
        """Number of tokens, their ids and their spelling."""
        ids = list(ids)
        return len(ids), " ".join(map(str, ids)), "".join(Decoder(self.tokens, plain=False).feed(ids))

    def learn(self, words: set[str]) -> None:
        """Describe the short ones of these words.  Words are remembered in two generations, so memory is bounded."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, new = self.known, []
        for word in words.difference(known):
            if word in self.older:
                known[word] = self.older[word]
            elif word in self.special:
                known[word] = self.described([self.special[word]])
            elif len(word) <= REMEMBERED_LENGTH:
                new.append(word)
        new.sort()
        for word, tokens in zip(new, self.encoder.encode_sorted(map(self.spelt, new))):
            known[word] = self.described(map(self.merges.ids.__getitem__, tokens))

    def summary(self, text: str) -> tuple[int, str, str]:
        """The same of a whole text."""
        words = self.words(text)
        self.learn(set(words))
        return self.joined(words)

    def joined(self, words: list[str]) -> tuple[int, str, str]:
        """The same of words that are learnt or long."""
        got = list(map(self.known.get, words))
        if None in got:
            long = {w: self.described(self.encode_word(w)) for w in {w for w, g in zip(words, got) if g is None}}
            got = [g or long[w] for w, g in zip(words, got)]
        return sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of their ids and of their spelling, which are never whole in memory."""
        return self.digests_of([text])[0]

    def digests_of(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """``digests`` of each text; the new words of many chunks are learnt together."""
        found, waiting, size = [], [], 0

        def finish() -> None:
            nonlocal waiting, size
            self.learn({word for _, words in waiting for word in words})
            for row, words in waiting:
                n, ids, spelled = self.joined(words)
                if n:
                    between = b" " if row[0] else b""
                    row[1].update(between + ids.encode())
                    row[2].update(between + spelled.encode())
                    row[0] += n
            waiting, size = [], 0

        for text in texts:
            found.append([0, hashlib.sha256(), hashlib.sha256()])
            for chunk in chunks(text):
                waiting.append((found[-1], self.words(chunk)))
                size += len(chunk)
                if size >= LEARNT:
                    finish()
        finish()
        return [(n, of_ids.hexdigest(), of_spelling.hexdigest()) for n, of_ids, of_spelling in found]

    def encode(self, text: str) -> Iterator[int]:
        for chunk in chunks(text):
            for word in self.words(chunk):
                yield from self.encode_word(word)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per worker and file."""
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text; ``path`` must exist on every executor."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = pieces(path)
        for batch in texts:
            rows = tokenizer.digests_of(text or "" for text in batch)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("doc_id"), encoded(F.col(text_column)).alias("_e")).select("doc_id", "_e.*")


def tokenize(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every text: its token ids, and the text their bytes spell, lower-cased and with a space at word ends."""

    @F.pandas_udf("ids array<int>, decoded string")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = pieces(path)
        special = frozenset(tokenizer.special.values())
        for batch in texts:
            rows = []
            for text in batch:
                ids = list(tokenizer.encode(text or ""))
                decoder = Decoder(tokenizer.tokens, plain=True, special=special)
                rows.append((ids, "".join(decoder.feed(ids)) + decoder.close()))
            yield pd.DataFrame(rows, columns=["ids", "decoded"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("doc_id"), tokens(F.col(text_column)).alias("_t")).select("doc_id", "_t.*")
