"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The n-gram ``abc`` is the product of a's vector permuted
twice, b's permuted once and c's; a text is the sum of its n-grams' vectors, a language the sum over its
texts.  A text gets the language with the largest cosine, both taken relative to the mean of all languages.

The permutation is a rotation and letter vectors follow from the code point alone, so every worker
builds the same vectors.  Sums are kept as counts of n-grams and multiplied once per batch.

Training counts n-grams per language over all rows of the training fold; prototypes are a handful of
vectors, one per language.  A null language is not learnt from; a null text, or one without a
letter, is ``und`` with score 0.  Null ids belong to no fold that is held out.  Without any training row
every prediction is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches

UNKNOWN = "und"
DIMENSIONS = 1024
ORDER = 3
SEED = 20_011
# A word boundary is a letter of its own.
GAP = 0x20
# Characters of text that are worked on at once, and n-grams whose vectors a worker remembers.
CHUNK = 100_000
CHUNK_TEXTS = 200
REMEMBERED = 6_000
# Code points take 21 bits, three of them an int64.
BITS = 21


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters and the marks on them, with one gap between words and at the ends.

    Empty without a letter: marks alone are none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    high = int(codes.max(initial=0))
    if high < len(KIND):
        kinds = KIND[codes]
    else:
        kinds = np.array([kind(c) for c in codes.tolist()], dtype=np.int8)
    keep = kinds > 0
    if not (kinds == 2).any():
        return codes[:0].astype(np.int64)
    out = np.where(keep, codes, GAP)
    edge = np.full(1, GAP, dtype=out.dtype)
    out = np.concatenate([edge, out, edge])
    return out[np.concatenate([[True], (out[1:] != GAP) | (out[:-1] != GAP)])].astype(np.int64)


def kind(code: int) -> int:
    """2 for letters, 1 for marks, 0 for all else."""
    return {"L": 2, "M": 1}.get(unicodedata.category(chr(code))[0], 0)


KIND = np.array([kind(c) for c in range(0x800)], dtype=np.int8)


def grams(codes: np.ndarray) -> np.ndarray:
    """Packed n-grams of a text's letters."""
    n = len(codes) - ORDER + 1
    if n <= 0:
        return codes[:0]
    packed = codes[:n]
    for k in range(1, ORDER):
        packed = (packed << BITS) | codes[k:n + k]
    return packed


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts."""
    return np.unique(grams(letters(text or "")), return_counts=True)


class Vectors:
    """Vectors of n-grams, each built once while it is remembered."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.made = np.empty((0, dimensions), dtype=np.float32)

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) > REMEMBERED:
                self.letter.clear()
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letter[code] = 2 * bits - 1
        return self.letter[code]

    def build(self, packed: int) -> np.ndarray:
        bound = np.ones(self.dimensions, dtype=np.int8)
        for k in range(ORDER):
            bound = bound * np.roll(self.of_letter((packed >> (BITS * k)) & (2**BITS - 1)), k)
        return bound

    def __call__(self, packed: np.ndarray) -> np.ndarray:
        """One row per n-gram."""
        if len(packed) > REMEMBERED:
            return np.stack([self.build(g) for g in packed.tolist()]).astype(np.float32)
        wanted = packed.tolist()
        new = [g for g in wanted if g not in self.row]
        if len(self.row) + len(new) > REMEMBERED:
            self.row, self.made, new = {}, self.made[:0], wanted
        if new:
            at = len(self.row)
            self.row.update((g, at + i) for i, g in enumerate(new))
            if at + len(new) > len(self.made):
                room = np.empty((min(REMEMBERED, 2 * (at + len(new))), self.dimensions), dtype=np.float32)
                room[:at] = self.made[:at]
                self.made = room
            for i, g in enumerate(new):
                self.made[at + i] = self.build(g)
        return self.made[[self.row[g] for g in wanted]]


def bundle(texts: list[tuple[np.ndarray, np.ndarray]], vectors: Vectors) -> np.ndarray:
    """The sum of each text's n-gram vectors."""
    union, place = np.unique(np.concatenate([g for g, _ in texts]), return_inverse=True)
    counts = np.zeros((len(texts), len(union)), dtype=np.float32)
    owner = np.repeat(np.arange(len(texts)), [len(g) for g, _ in texts])
    counts[owner, place] = np.concatenate([c for _, c in texts])
    out = np.zeros((len(texts), vectors.dimensions), dtype=np.float32)
    for at in range(0, len(union), REMEMBERED):
        out += counts[:, at:at + REMEMBERED] @ vectors(union[at:at + REMEMBERED])
    return out


@dataclass(frozen=True)
class Profiles:
    """Prototypes of the learnt languages, centred, and what to centre with."""

    languages: list[str]
    prototypes: np.ndarray
    mean: np.ndarray

    def scores(self, texts: np.ndarray) -> np.ndarray:
        """Cosine of every text with every language."""
        size = np.linalg.norm(texts, axis=1, keepdims=True)
        centred = texts / np.where(size == 0, 1, size) - self.mean
        length = np.linalg.norm(centred, axis=1, keepdims=True)
        return (centred / np.where(length == 0, 1, length)) @ self.prototypes.T


def learn(docs: DataFrame, text: Column, lang: Column, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all languages of ``docs``; n-grams are counted in Spark, then each gets its vector once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for code, body in zip(batch["_lang"], batch["_text"]):
                g, n = text_grams(body)
                if len(g):
                    found.setdefault(code, []).append(np.stack([g, n]))
            for code, parts in found.items():
                joined = np.concatenate(parts, axis=1)
                union, place = np.unique(joined[0], return_inverse=True)
                total = np.zeros(len(union), dtype=np.int64)
                np.add.at(total, place, joined[1])
                yield pd.DataFrame({"lang": code, "gram": union, "n": total})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(dimensions)
        for batch in batches:
            for code, rows in batch.groupby("lang"):
                vector = np.zeros(dimensions, dtype=np.int64)
                for gram, n in zip(rows["gram"].tolist(), rows["n"].tolist()):
                    vector += n * vectors.build(gram).astype(np.int64)
                yield pd.DataFrame({"lang": code, "place": np.arange(dimensions), "value": vector})

    bound_batches(docs.sparkSession)
    counted = docs.select(lang.alias("_lang"), text.alias("_text")).where("_lang is not null and _text is not null") \
        .mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Whole numbers, so the order of summation does not matter; one vector per language comes to the driver.
    found = counted.mapInPandas(summed, "lang string, place long, value long").groupBy("lang", "place").agg(
        F.sum("value").cast("double").alias("value")).groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector")
    ).orderBy("lang").collect()
    if not found:
        return Profiles([], np.zeros((0, dimensions), "float32"), np.zeros(dimensions, "float32"))
    raw = np.array([row["vector"] for row in found])
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    mean = raw.mean(axis=0) if len(found) > 1 else np.zeros(dimensions)
    centred = raw - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    return Profiles([row["lang"] for row in found], centred.astype("float32"), mean.astype("float32"))


def predict(docs: DataFrame, profiles: Profiles, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, brought to 0..1)."""

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(dimensions)
        names = np.array([*profiles.languages, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
            size = 0

            def settle() -> None:
                cosine = profiles.scores(bundle([t for _, t in held], vectors))
                rows = [i for i, _ in held]
                best[rows] = cosine.argmax(axis=1)
                score[rows] = np.clip((1 + cosine.max(axis=1).astype("float64")) / 2, 0, 1)

            for i, body in enumerate(batch):
                found = text_grams(body)
                if len(found[0]) and profiles.languages:
                    held.append((i, found))
                    size += len(body)
                    if size >= CHUNK or len(held) >= CHUNK_TEXTS:
                        settle()
                        held, size = [], 0
            if held:
                settle()
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    return docs.withColumn("_guess", guess(text)).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")],
                                                         "_guess.lang_pred", "_guess.score")


def held_out(id_column: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    profiles = learn(docs.where(~held_out()), F.col("text"), F.col("lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles, F.col("text")).drop("text")


# A text in none of the learnt languages is about as near to all of them.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents that are not ``und``, with their own columns.

    Once two languages are learnt no score is below 0.5, so ``LEAST_SCORE`` rejects nothing more: texts in a language
    that was not learnt, and random letters, stay.
    """
    profiles = learn(docs.where(~held_out()), F.col("text"), F.col("lang"))
    columns = [F.col(f"_d.`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.col("text").alias("_text"))
    known = predict(whole, profiles, F.col("_text")).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*columns)
