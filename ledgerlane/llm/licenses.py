"""Licence scans: TF-IDF cosine of text to licence notices, and inheritance from the nearest directory.

Each line of a file, and each run of lines without an empty one between them up to twice the words of the
longest notice, is compared with templates of licence notices as a sparse vector: a word's weight is its count
times its inverse document frequency over all files; words that no template has weigh as words of no file. The
whole file is compared with whole licence texts in the same way, with 1 + log of the counts. A file's own
licence is that of its best lines at ``LEAST`` or more, or of the whole text that it equals at ``LEAST_WHOLE``
or more, which goes first. A file that equals a whole text, or whose licence lines hold half of its words, is a
licence file and covers its directory and all below; a file without a licence inherits from the nearest
directory above it that has one.

Lines and files without an anchor word are not compared: anchors are chosen so that, without any, no template
can be reached. Frequencies are counted over all files, for the templates' words only.

Defined results: null and empty texts have no licence of their own but may inherit; a null path has no
directory; of equal scores the template named first wins, of licence files of one directory the best score,
then the smallest path; rows are scanned one by one, also equal ones; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut_lineage, map_texts, salted_left
from ledgerlane.llm.licence_texts import WHOLE

LEAST, FILE_SHARE, LEAST_WHOLE = 0.6, 0.5, 0.8
#: Bytes of words: ASCII letters and digits, and all of other scripts' letters.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Identifiers of public licences and the names they are called by.
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "MIT License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-1.0", "Eclipse Public License, version 1.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("CDDL-1.0", "Common Development and Distribution License, version 1.0"),
    ("BSL-1.0", "Boost Software License, version 1.0"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("Zlib", "zlib License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal License"),
    ("Unlicense", "Unlicense"),
)
#: Sentences in which a licence is named.
FORMS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This program is distributed under the terms of the {}.", "Licensed under the {}. See LICENSE for details.")
#: Other notices by which public licences are declared.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
TEMPLATES = (
    tuple((name, form.format(full)) for name, full in NAMES for form in FORMS)
    + tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in NAMES))
    + NOTICES
)


def words(text: str) -> list[bytes]:
    """Words of a text in lower case (ASCII letters only)."""
    return text.encode().lower().translate(_SPLIT).split()


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words(t))
#: Counts of the words of whole licence texts.
WHOLE_COUNTS = tuple((name, {w.encode(): int(n) for w, n in zip(t.split()[::2], t.split()[1::2], strict=True)}) for name, t in WHOLE)
WHOLE_VOCABULARY = frozenset(w for _, counts in WHOLE_COUNTS for w in counts)
#: Most words of lines that are joined: a notice may be wrapped.
JOINED = 2 * max(len(words(t)) for _, t in TEMPLATES)


def frequencies(files: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of files, and of those that hold each word of the templates."""
    asked = VOCABULARY | WHOLE_VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter({b"": batch.num_rows})
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(asked.intersection(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    sums = map_texts(files.select(F.col("text").cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the templates' words
    found = {bytes(r["word"]): r["n"] for r in sums}
    return found.pop(b"", 0), found


class Scanner:
    def __init__(self, files: int, found: dict[bytes, int]) -> None:
        self.rare = math.log(files + 2)
        self.idf = {w: math.log((files + 2) / (found.get(w, 0) + 1)) for w in VOCABULARY}
        self.vectors = []
        for name, t in TEMPLATES:
            vector = {w: n * self.idf[w] for w, n in Counter(words(t)).items()}
            self.vectors.append((name, vector, math.sqrt(sum(v * v for v in vector.values())) or 1.0))
        self.holding: dict[bytes, list[tuple[int, float]]] = {}
        for i, (_, vector, _) in enumerate(self.vectors):
            for w, v in vector.items():
                self.holding.setdefault(w, []).append((i, v))
        # the words of largest weight, until what is left of every template is too little for LEAST
        self.anchors: set[bytes] = set()
        for w in sorted(VOCABULARY, key=lambda w: (-self.idf[w], w)):
            if all(sum(v * v for x, v in vector.items() if x not in self.anchors) < (LEAST * norm) ** 2 for _, vector, norm in self.vectors):
                break
            self.anchors.add(w)

        # whole texts, and their anchors in the same way
        self.whole_idf = {w: math.log((files + 2) / (found.get(w, 0) + 1)) for w in WHOLE_VOCABULARY}
        self.whole = []
        for name, counts in WHOLE_COUNTS:
            vector = {w: (1 + math.log(n)) * self.whole_idf[w] for w, n in counts.items()}
            self.whole.append((name, vector, math.sqrt(sum(v * v for v in vector.values())) or 1.0))
        self.whole_anchors: set[bytes] = set()
        left = [size * size for _, _, size in self.whole]
        for w in sorted(WHOLE_VOCABULARY, key=lambda w: (-self.whole_idf[w], w)):
            if all(x < (LEAST_WHOLE * size) ** 2 for x, (_, _, size) in zip(left, self.whole, strict=True)):
                break
            self.whole_anchors.add(w)
            left = [x - vector.get(w, 0.0) ** 2 for x, (_, vector, _) in zip(left, self.whole, strict=True)]

    def file(self, every: list[bytes]) -> tuple[str | None, float]:
        """Best whole licence text of a file's words and its cosine."""
        weights = {w: (1 + math.log(n)) * self.whole_idf.get(w, self.rare) for w, n in Counter(every).items()}
        norm, best = math.sqrt(sum(v * v for v in weights.values())), (None, 0.0)
        for name, vector, size in self.whole:
            score = sum(v * vector[w] for w, v in weights.items() if w in vector) / (norm * size) if norm else 0.0
            best = (name, score) if score > best[1] else best
        return best

    def line(self, own: list[bytes]) -> tuple[str | None, float]:
        """Best template of a line's words and its cosine."""
        counts = Counter(own)
        norm = math.sqrt(sum((n * self.idf.get(w, self.rare)) ** 2 for w, n in counts.items()))
        dots: dict[int, float] = {}
        for w, n in counts.items():
            for i, v in self.holding.get(w, ()):
                dots[i] = dots.get(i, 0.0) + n * self.idf[w] * v
        best = (None, 0.0)
        for i in sorted(dots):  # of equal scores the template named first
            name, _, size = self.vectors[i]
            if norm and dots[i] / (norm * size) > best[1] + 1e-12:
                best = (name, dots[i] / (norm * size))
        return best

    def text(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, score, whether it is a licence file) of a whole text."""
        if not text:
            return None, 0.0, False
        every = words(text)
        if not self.whole_anchors.isdisjoint(every):
            name, score = self.file(every)
            if score >= LEAST_WHOLE:
                return name, min(score, 1.0), True
        if self.anchors.isdisjoint(every):
            return None, 0.0, False
        lines = [words(x) for x in text.split("\n")]
        hits = [not self.anchors.isdisjoint(x) for x in lines]
        found = []
        for i in range(len(lines)):
            own, hit = [], False
            for j in range(i, len(lines)):
                if not lines[j] or (j > i and len(own) + len(lines[j]) > JOINED):
                    break
                own, hit = own + lines[j], hit or hits[j]
                if hit:
                    name, score = self.line(own)
                    if score >= LEAST:
                        found.append((-score, i, j, name))
        # the best runs of lines that don't overlap
        best, licensed, used = (None, 0.0), 0, set()
        for score, i, j, name in sorted(found, key=lambda x: x[:3]):
            if used.isdisjoint(range(i, j + 1)):
                used.update(range(i, j + 1))
                licensed += sum(len(x) for x in lines[i : j + 1])
                best = best if best[0] else (name, -score)
        return (*best, bool(best[0]) and licensed >= FILE_SHARE * len(every))


def scanned(files: DataFrame) -> DataFrame:
    """id, path, own_license, own_score and is_file of every row of files (id, path, text)."""
    n, found = frequencies(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(n, found)
        for batch in batches:
            out = [scanner.text(t.as_py()) for t in batch.column(2)]
            more = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["id", "path", "own_license", "own_score", "is_file"])

    return map_texts(files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string")), run, "id long, path string, own_license string, own_score double, is_file boolean")


def licensed(files: DataFrame) -> DataFrame:
    """Licence of every row of files (id, path, text): id, path, license, score, basis (header, file,
    inherited or none) and license_path, the directory it comes from."""
    rows = cut_lineage(scanned(files).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    best = F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    covers = rows.filter("is_file and path is not null").groupBy("dir").agg(F.min(best).alias("b")).select("dir", "b.license", "b.score")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = rows.filter("path is not null").select("dir").distinct().select(F.col("dir").alias("own"), F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_union(above, F.array(F.lit(""))))).alias("dir"))
    nearest = dirs.join(covers, "dir").groupBy("own").agg(F.max_by(F.struct("dir", "license", "score"), F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).alias("n"))
    nearest = nearest.select(F.col("own").alias("dir"), F.col("n.dir").alias("from_dir"), F.col("n.license").alias("dir_license"), F.col("n.score").alias("dir_score"))
    out = salted_left(rows, nearest, "dir")
    basis = F.when(F.col("is_file"), "file").when(F.col("own_license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    own = F.col("own_license").isNotNull()
    return out.select(
        "id", "path", F.coalesce("own_license", "dir_license").alias("license"), F.when(own, F.col("own_score")).otherwise(F.coalesce("dir_score", F.lit(0.0))).alias("score"),
        basis.alias("basis"), F.when(own, F.col("dir")).otherwise(F.col("from_dir")).alias("license_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: each source is a directory, each language of it one below."""
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string")).alias("path"), "text")
