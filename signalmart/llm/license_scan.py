"""License scans by conditional compression.

Wherever a keyword stands, the block of words around it is compressed on its own and with each template as
zstandard raw dictionary.  Templates are ranked by how many bytes that saves; the best few are aligned with the text
word by word, and the one with the fewest exact wording differences is confirmed if these are few enough.

Spark filters the documents that have a keyword at all; only those reach Python, whole.  Null texts have no
blocks.  Null ids and repeated rows are rows like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.batches import bound_batches

# Wordings of public licenses and their usual notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "BSD clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "reserved": "All rights reserved",
}
KEYWORDS = ("license", "licence", "licensed", "licenced", "copyright", "reserved", "permission", "redistribution",
            "redistribute", "warranties", "warranty")
WORD = re.compile(r"[a-z0-9]+")
# Words before and after a keyword that make a block, templates that are aligned, and differences a template may have.
AROUND = 12
ALIGNED = 3
MOST_DIFFERENT_PERCENT = 10
BLOCK = "array<struct<block:int,license:string,saved_bytes:int,n_differences:int,confirmed:boolean,start:int,stop:int," \
        "missing:array<string>,extra:array<string>>>"


class Scanner:
    """Templates ready for compression; built once in every worker."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.plain = zstandard.ZstdCompressor(level=3)
        self.words = {name: WORD.findall(text.lower()) for name, text in templates.items()}
        self.given = {
            name: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
                " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, words in self.words.items()}

    def ranked(self, words: list[str], at: int, low: int) -> list[tuple[int, str]]:
        """Bytes saved and names of the templates, by the share of the block that they save.

        A short template is asked about a short block: the words around ``at`` that it could cover, from ``low`` on.
        """
        out = []
        for name, compressor in self.given.items():
            reach = min(AROUND, len(self.words[name]))
            data = " ".join(words[max(low, at - reach):at + reach + 1]).encode()
            alone = len(self.plain.compress(data))
            saved = alone - len(compressor.compress(data))
            out.append((-saved / alone, name, saved))
        return [(saved, name) for _, name, saved in sorted(out)]

    def align(self, words: list[str], at: int, name: str) -> tuple[int, int, int, list[str], list[str]]:
        """Differences between a template and the words around ``at``, and where the template lies."""
        template = self.words[name]
        low = max(0, at - len(template))
        nearby = words[low:at + len(template) + 1]
        matcher = SequenceMatcher(None, template, nearby, autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        if not blocks:
            return len(template), at, at, template, []
        first, last = blocks[0], blocks[-1]
        missing, extra, i, j = list(template[:first.a]), [], first.a, first.b
        for b in blocks:
            missing += template[i:b.a]
            extra += nearby[j:b.b]
            i, j = b.a + b.size, b.b + b.size
        missing += template[last.a + last.size:]
        return len(missing) + len(extra), low + first.b, low + last.b + last.size, missing, extra

    def scan(self, text: str) -> list[tuple]:
        """The blocks of a text, each with its best template; ``start`` and ``stop`` count words."""
        words = WORD.findall(text.lower())
        out: list[tuple] = []
        reached = 0
        for at, word in enumerate(words):
            if at < reached or word not in KEYWORDS:
                continue
            best = None
            for saved, name in self.ranked(words, at, reached)[:ALIGNED]:
                differences, start, stop, missing, extra = self.align(words, at, name)
                size = len(self.words[name])
                key = (100 * differences > MOST_DIFFERENT_PERCENT * size, differences / size, -size, name)
                if best is None or key < best[0]:
                    best = (key, name, saved, differences, start, stop, missing, extra)
            if best:
                key, name, saved, differences, start, stop, missing, extra = best
                out.append((len(out), name, saved, differences, not key[0], start, stop, missing, extra))
                reached = stop if not key[0] else at + 1
        return out


def scan_documents(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per block with a keyword: its document, best template, bytes saved and exact wording differences."""

    @F.pandas_udf(BLOCK)
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates)
        names = [part.split(":")[0] for part in BLOCK[len("array<struct<"):].replace("array<string>", "s").rstrip(">").split(",")]
        for batch in batches:
            yield pd.Series([[dict(zip(names, row)) for row in scanner.scan(text)] for text in batch], dtype=object)

    bound_batches(docs.sparkSession)
    keyword = rf"(?i)(?<![a-z0-9])({'|'.join(KEYWORDS)})(?![a-z0-9])"
    found = docs.select("doc_id", "text").where(F.col("text").rlike(keyword)).select(
        "doc_id", F.explode(blocks("text")).alias("_b"))
    return found.select("doc_id", "_b.*")
