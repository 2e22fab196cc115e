"""Licence scan: headers and licence files found by TF-IDF cosine to templates, and inheritance from the nearest directory above.

A text is compared as sparse vectors of word counts times inverse document frequency, which is counted over
all files: the whole file with full licence texts, its first words with the openings of long ones, its leading comment,
with comment marks removed and lines joined, with full texts and standard headers, and its lines and sentences,
also those wrapped over several lines, with one-sentence notices. A unit without any of a template's weightiest
words cannot reach the threshold, so most are passed over at once.
Licence files, and files that mostly consist of a notice, stand for their directory; files without a notice of their
own take the licence of the nearest directory above them that has such a file, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values
from sparkloom.llm.decontaminate import words_of
from sparkloom.llm.license_texts import HEADERS, OPENINGS, TEXTS
from sparkloom.session import stored

#: Licence names and the notices that announce them.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words that turn a notice into its opposite.
NEGATIONS = frozenset(b"not no never neither nor isn aren wasn weren cannot".split())
_lines = re.compile(rb"[\r\n]+")
_sentence = re.compile(rb"(?<=[.!?])[ \t]+")
_blank = re.compile(rb"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_marks = re.compile(rb"""^[ \t]*(?:/\*+|\*+/?|//+!?|#+!?|--+|;+|%+|<!--|"{3}|'{3})?[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$""")
_comment = re.compile(
    rb"""\A\s*(?:#![^\n]*\n\s*)?(/\*.*?\*/|<!--.*?-->|"{3}.*?"{3}|'{3}.*?'{3}|(?:[ \t]*(?://|#|--|;|%)[^\n]*(?:\n|\Z))+)""", re.S
)


def header_of(text: bytes) -> bytes:
    """The leading comment of a file, without its marks; empty if there is none."""
    found = _comment.match(text)
    return b" ".join(_marks.sub(b"", line) for line in found[1].splitlines()) if found else b""


def units_of(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(from, to, text)`` of the units in turn, by number of line part: each sentence in a line,
    then, of each paragraph, each sentence that runs over several lines, without comment marks."""
    number = 0
    for paragraph in _blank.split(text):
        parts: list[tuple[int, bytes]] = []  # (number, part of a line)
        for line in _lines.split(paragraph):
            for part in _sentence.split(line):
                yield number, number + 1, part
                parts.append((number, part))
                number += 1
        begin = 0
        for i, (_, part) in enumerate(parts):
            if i + 1 == len(parts) or part.rstrip().endswith((b".", b"!", b"?", b":")):
                if i > begin:
                    yield parts[begin][0], parts[i][0] + 1, b" ".join(_marks.sub(b"", p) for _, p in parts[begin : i + 1])
                begin = i + 1


@dataclass(frozen=True)
class LicenseMatcher:
    """Templates as weighted vectors. Words outside all templates weigh as if no file had them."""

    names: list[str]
    vectors: list[dict[bytes, float]]
    sizes: list[int]  # words
    denied: list[int]  # negations
    idf: dict[bytes, float]
    other: float
    threshold: float
    needed: frozenset[bytes]

    @classmethod
    def build(cls, templates, files: int, counts: dict[bytes, int], threshold: float) -> LicenseMatcher:
        split = [words_of(text.encode()) for _, text in templates]
        idf = {w: math.log((1 + files) / (1 + counts.get(w, 0))) + 1 for w in sorted({w for words in split for w in words})}
        other = math.log(1 + files) + 1
        vectors, needed = [], set()
        for words in split:
            raw = {w: n * idf[w] for w, n in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            vector = {w: x / norm for w, x in raw.items()}
            vectors.append(vector)
            rest = 1.0
            for w in sorted(vector, key=lambda w: (-vector[w], w)):  # without these the cosine stays below the threshold
                if math.sqrt(max(0.0, rest)) < threshold:
                    break
                needed.add(w)
                rest -= vector[w] ** 2
        denied = [sum(w in NEGATIONS for w in words) for words in split]
        return cls([n for n, _ in templates], vectors, [len(w) for w in split], denied, idf, other, threshold, frozenset(needed))

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """The best score and name, ties to the name that sorts first; none below the threshold. A unit
        of at most 60 words must not hold more negations than the template."""
        if self.needed.isdisjoint(words):
            return None
        counts = Counter(words)
        raw = {w: n * self.idf.get(w, self.other) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        denied = sum(n for w, n in counts.items() if w in NEGATIONS) if len(words) <= 60 else 0
        found = None
        for name, vector, own in zip(self.names, self.vectors, self.denied):
            if denied > own:
                continue
            score = sum(x * raw[w] for w, x in vector.items() if w in raw) / norm
            if score >= self.threshold - 1e-12 and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name)
        return found


@dataclass(frozen=True)
class LicenseScanner:
    """The matchers of one-sentence notices, of headers, of whole files and of openings."""

    notices: LicenseMatcher
    headers: LicenseMatcher
    texts: LicenseMatcher
    openings: LicenseMatcher
    file_share: float

    def whole(self, words: list[bytes]) -> tuple[float, str] | None:
        """The best match of the whole file with a full text, or of its first words with an opening, if it is thrice as long or more."""
        found = [self.texts.best(words)]
        found += [self.openings.best(words[:n]) for n in sorted(set(self.openings.sizes)) if len(words) >= 3 * n]
        return min((x for x in found if x), key=lambda x: (-x[0], x[1]), default=None)

    def scan(self, text: bytes) -> tuple[list[tuple[int, str, float]], tuple[float, str] | None, bool]:
        """``(unit number, licence, score)`` of the notices in a text, the best match, and whether the file stands for its directory."""
        words = words_of(text)
        there = set(words)
        if all(m.needed.isdisjoint(there) for m in (self.notices, self.headers, self.texts, self.openings)):
            return [], None, False
        whole = self.whole(words)
        found, own, total, taken = [], 0, 0, set()
        for begin, end, unit in units_of(text):
            words = words_of(unit)
            size = sum(map(len, words))
            if end == begin + 1:
                total += size
            if words and taken.isdisjoint(range(begin, end)) and (best := self.notices.best(words)):
                found.append((begin, best[1], best[0]))
                taken.update(range(begin, end))
                own += size
        words = words_of(header_of(text))
        header = self.headers.best(words) if words else None
        share = max(own, sum(map(len, words)) if header else 0) / total if total else 0.0
        matches = [whole] if whole else [(s, n) for _, n, s in found] + ([header] if header else [])
        best = min(matches, key=lambda x: (-x[0], x[1]), default=None)
        return sorted(found), best, bool(whole) or best is not None and share >= self.file_share


def term_counts(files: DataFrame, text_col: str, vocab: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of files, and of those that have each word of ``vocab`` (which is bounded by the templates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in byte_values(batch.column(0)):
                counts[b""] += 1
                counts.update(vocab.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = files.select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


def scan_licenses(
    files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, headers=HEADERS, texts=TEXTS,
    openings=OPENINGS, threshold: float = 0.75, text_threshold: float = 0.85, file_share: float = 0.5,
) -> DataFrame:
    """One row per row of ``files``: ``(id_col, path_col, notices, license, score, how, from_path)``.

    ``notices``: units with a cosine of ``threshold`` or more to a notice, as (unit, license, score); a unit with more
    negations than the notice is none. A file whose whole words have a cosine of ``text_threshold`` or more to a full text, or
    whose first words have it to an opening, is a licence file (``how`` 'file'). Else ``license`` is that of the best
    notice or leading comment, ties to the name that sorts first; ``how`` is then 'header', or 'file' where these make
    up ``file_share`` or more of the words. Licence files stand for their directory. Rows without a match
    inherit from the nearest directory at or above their own that has such a file (``how`` 'inherited',
    ``from_path`` the file; of several the best score, then the least path); else all three are null.
    Null and empty texts have no notice; a null path has no directory and neither gives nor takes.
    Repeated rows give repeated results; other columns are ignored; an empty table gives none.
    """
    vocab = frozenset(w for _, text in (*templates, *headers, *texts, *openings) for w in words_of(text.encode()))
    total, counts = term_counts(files, text_col, vocab)
    kinds = ((templates, threshold), ((*headers, *texts), threshold), (texts, text_threshold), (openings, text_threshold))
    scanner = LicenseScanner(*(LicenseMatcher.build(t, total, counts, least) for t, least in kinds), file_share)
    sent = files.sparkSession.sparkContext.broadcast(scanner)
    kind = files.schema[id_col].dataType.simpleString()
    notice = pa.list_(pa.struct([("unit", pa.int64()), ("license", pa.string()), ("score", pa.float64())]))
    match = pa.struct([("s", pa.float64()), ("license", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            found = [scanner.scan(t) for t in byte_values(batch.column(2))]
            notices = pa.array([[{"unit": i, "license": n, "score": s} for i, n, s in own] for own, _, _ in found], notice)
            best = pa.array([x and {"s": -x[0], "license": x[1]} for _, x, _ in found], match)
            stands = pa.array([x for _, _, x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), notices, best, stands], ["id", "path", "notices", "best", "stands"])

    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    schema = f"id {kind}, path string, notices array<struct<unit:bigint,license:string,score:double>>, best struct<s:double,license:string>, stands boolean"
    scanned = stored(rows.mapInArrow(run, schema).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "scanned")

    own = scanned.where(F.col("path").isNotNull() & F.col("stands"))
    holders = own.groupBy("dir").agg(F.min(F.struct(F.col("best.s").alias("s"), "path", F.col("best.license").alias("license"))).alias("by"))
    dirs = scanned.where(F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")  # a directory and those above it, to the root
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))).alias("a"))
    nearest = above.select("dir", "a.depth", "a.up").distinct().join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("by", "depth").alias("by"))
    nearest = stored(nearest.select(F.col("dir").alias("at"), "by"), "nearest")

    told = scanned.join(nearest, scanned.dir == F.col("at"), "left")
    has = F.col("best").isNotNull()
    return told.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "notices",
        F.when(has, F.col("best.license")).otherwise(F.col("by.license")).alias("license"),
        F.when(has, -F.col("best.s")).otherwise(-F.col("by.s")).alias("score"),
        F.when(F.col("stands"), "file").when(has, "header").when(F.col("by").isNotNull(), "inherited").alias("how"),
        F.when(~has, F.col("by.path")).alias("from_path"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id")
    return found.select("doc_id", "path", F.size("notices").alias("n_notices"), "license", F.round("score", 6).alias("score"), "how", "from_path")
