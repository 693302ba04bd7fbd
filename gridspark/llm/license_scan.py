"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line and paragraph of a file, and a licence file as a whole, is a sparse vector of term counts times inverse
document frequency, counted over all files for every word. A licence file has the licence of the full text nearest to
it as a whole, if that is near enough; else, like any other file, it has that of an SPDX tag, or of the notice with the
highest cosine of one unit, if that is high enough. Notices that stand in several licences count only without others.

The weights of the template terms are known to every task. Other words of a unit only lengthen its vector, so the best
template does not hang on them: a unit without any is settled at once, and one that may still reach the threshold if
each of them had the least weight waits for a join with the frequencies of its words, which stay a table.

Lines are looked at only where they can reach the threshold: by Cauchy-Schwarz the cosine is at most the share of the
template's length that lies in shared terms, so a line without any of a template's heaviest terms, those whose rest
is too short, is below it. Finding these anchor terms in the text is a plain search.

A file without a licence of its own takes that of the licence file in its directory, or else in the nearest one above.
Directories are joined with their ancestors, not files with files, so a directory with a third of all files is one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed, shared_table

THRESHOLD = 0.75
FULL_THRESHOLD = 0.9  # of whole licence files and full texts; long English texts share many words
FULL, TAG, NOTICE, GENERIC = range(4)  # kinds of evidence, the strongest first
HELD_WORDS = 1 << 18  # distinct words that a task counts before it hands them on
# Notices and headers by which files name their licence.
_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{0} either version {2} of the License, or (at your option) any later version."
_GNU_NAMES = [("GPL-1.0", "General Public License", "1"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
              ("LGPL-2.0", "Library General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
              ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]
_CC_NAMES = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
             ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
TEMPLATES = {
    "0BSD": ("Released under the BSD Zero Clause License.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    "Artistic-2.0": ("Released under the Artistic License 2.0.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Released under the Simplified BSD License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    **{f"CC-{short}-4.0": (f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
       for short, name in _CC_NAMES},
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
                "Licensed under the Eclipse Public License 1.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
                "Licensed under the Eclipse Public License 2.0."),
    **{name: (f"This work is licensed under the GNU {title}, version {version}.", f"Licensed under the GNU {title}, version {version}.",
              f"Released under the GNU {title} v{version}.",
              f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title}, version {version}.",
              _GNU.format(";", title, version)) for name, title, version in _GNU_NAMES},
    "ISC": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License 2.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "Zlib": ("Released under the zlib License.",),
}
# Notices that stand in several licences.
SHARED_TEMPLATES = {
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.",),
    "proprietary": ("All rights reserved.",),
}
_ID = r"\(?(?=[\w.+-]*[A-Z0-9])[A-Za-z][\w.+-]*\)?|\(?0BSD\)?"
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*((?:{_ID})(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:{_ID}))*)")


def full_texts() -> dict[str, str]:
    """Whole texts of common licences by name, read on the driver; that of AGPL-3.0 is GPL-3.0 with what differs in it."""
    texts = {p.stem: p.read_text() for p in (Path(__file__).parent / "licenses").glob("*.txt")}
    texts["AGPL-3.0"] = re.sub(r"(?i)GNU (General Public License)", r"GNU Affero \1", texts["GPL-3.0"]) + (
        "Remote Network Interaction: if you modify the Program, your modified version must prominently offer all users "
        "interacting with it remotely through a computer network an opportunity to receive the Corresponding Source.")
    return texts


def tagged(text: str) -> str | None:
    """The first SPDX expression of a text; the forms of a GNU licence have one name."""
    for found in _TAG.finditer(text):
        name = re.sub(r"-only\b|-or-later\b|\+", "", found[1].rstrip("."))
        if name not in ("NONE", "NOASSERTION"):
            return name
    return None


_MARKS = re.compile(r"[^\w]+")


def terms(text: str) -> list[str]:
    return [t for t in _MARKS.split(text.lower()) if t]


class Scanner:
    """Templates as unit vectors, and the search for lines that match them."""

    def __init__(self, files: int, frequency: dict[str, int], templates: dict[str, tuple[str, ...]], threshold: float,
                 common: dict[str, tuple[str, ...]], full: dict[str, str]):
        self.least = {FULL: FULL_THRESHOLD, NOTICE: threshold, GENERIC: threshold}
        kinds = {NOTICE: templates, GENERIC: common, FULL: {name: (text,) for name, text in full.items()}}
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in sorted(vocabulary(templates, common, full))}
        self.names = {kind: [name for name in sorted(given) for _ in given[name]] for kind, given in kinds.items()}
        self.holders = {kind: {} for kind in kinds}  # of a term: its templates, with its weight in them
        anchors = set()
        for kind, given in kinds.items():
            for i, text in enumerate(text for name in sorted(given) for text in given[name]):
                vector, squares, _ = self.weights(text)
                vector = {t: w / (math.sqrt(squares) or 1.0) for t, w in vector.items()}
                for t, w in vector.items():
                    self.holders[kind].setdefault(t, []).append((i, w))
                rest, heavy = 1.0, sorted(vector, key=lambda t: (-vector[t], t))
                for t in heavy if kind != FULL else []:
                    if rest < threshold ** 2 - 1e-9:
                        break
                    anchors.add(t)
                    rest -= vector[t] ** 2
        self.anchors = sorted(anchors)

    def weights(self, text: str) -> tuple[dict[str, float], float, Counter]:
        """Weights of the template terms of a unit, the sum of their squares, and the counts of all other words."""
        counts = Counter(terms(text))
        weights = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        return weights, sum(w * w for w in weights.values()), Counter({t: n for t, n in counts.items() if t not in self.idf})

    def match(self, text: str, kinds: tuple[int, ...]) -> list[tuple[int, str, float, float, Counter]]:
        """Of each kind the nearest template of one unit of text, with its product, the unit's squares and other words.

        Left out if the cosine is too low even if each other word had the least weight, one. Ties go to the first name.
        """
        weights, squares, others = self.weights(text)
        size, out = math.sqrt(squares + sum(n * n for n in others.values())), []
        for kind in kinds:
            products = [0.0] * len(self.names[kind])
            for t, w in weights.items():
                for i, own in self.holders[kind].get(t, ()):
                    products[i] += own * w
            best = max(products, default=0.0)
            if best and best >= (self.least[kind] - 1e-9) * size:
                name = next(n for n, p in zip(self.names[kind], products) if p * (1 + 1e-12) >= best)
                out.append((kind, name, best, squares, others))
        return out

    def scan(self, text: str | None, whole: bool) -> tuple:
        """(kind, licence, cosine) of a file's settled units, (None, None, 0.0) without any, and those that wait for frequencies."""
        text = text or ""
        lowered = text.lower()
        found = self.match(text, (FULL,)) if whole else []
        if present := [a for a in self.anchors if a in lowered]:
            units = set(text.split("\n")) | set(re.split(r"\n\s*\n", text)) | ({text} if whole else set())
            found += [m for u in units for low in [u.lower()] if any(a in low for a in present) for m in self.match(u, (NOTICE, GENERIC))]
        settled = [(kind, -product / math.sqrt(squares), name) for kind, name, product, squares, others in found if not others]
        settled = [m for m in settled if -m[1] >= self.least[m[0]]]
        if "spdx-license-identifier" in lowered and (name := tagged(text)):
            settled.append((TAG, -1.0, name))
        kind, least, own = min(settled, default=(None, 0.0, None))
        bound = lambda m: -m[2] / math.sqrt(m[3] + sum(n * n for n in m[4].values()))
        waits = sorted({(*m[:4], " ".join(sorted(m[4].elements()))) for m in found
                        if m[4] and (own is None or (m[0], bound(m)) <= (kind, least + 1e-9))})
        return kind, own, -least or 0.0, *(list(map(list, zip(*waits))) or [[] for _ in range(5)])


def vocabulary(templates: dict[str, tuple[str, ...]], common: dict[str, tuple[str, ...]], full: dict[str, str]) -> set[str]:
    return {t for given in (templates, common, {name: (text,) for name, text in full.items()})
            for own in given.values() for text in own for t in terms(text)}


def word_frequency(df: DataFrame, text: str) -> DataFrame:
    """(t, n): in how many files each word occurs; the row of the empty word counts the files."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update({"", *_MARKS.split((value or "").lower())})
                if len(seen) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    return df.select(F.col(f"`{text}`")).mapInArrow(count, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))


def squares_of_others(asked: DataFrame, words: DataFrame, files: int) -> DataFrame:
    """(x, s): the summed squared weights of each distinct text ``others`` of words, under its hash ``x``."""
    counts = asked.select("x", "others").dropDuplicates(["x"]).select("x", F.explode(F.split("others", " ")).alias("t")).groupBy(
        "x", "t").agg(F.count("*").alias("c"))
    weight = F.col("c") * (F.log((1.0 + files) / (1 + F.coalesce("n", F.lit(0)))) + 1)
    # Added up in order, so that a sum does not hang on the order of the rows.
    return counts.join(words, "t", "left").groupBy("x").agg(F.array_sort(F.collect_list(weight * weight)).alias("w")).select(
        "x", F.aggregate("w", F.lit(0.0), lambda s, w: s + w).alias("s"))


def directory(path: Column) -> Column:
    """The path without its last part; the empty root for a name alone."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every directory above and including a directory, from the root on."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(
        F.slice(parts, F.lit(1), k), "/")))


def scan_licenses(df: DataFrame, key: str, path: str, text: str, is_license_file: str,
                  templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD,
                  common: dict[str, tuple[str, ...]] = SHARED_TEMPLATES, full: dict[str, str] | None = None) -> DataFrame:
    """(key, path, own_license, cosine, license, inherited_from) of each file.

    ``own_license`` is that of the file's own text, with its cosine (0.0 without one, 1.0 for a tag); ``license`` is the same, or the
    one inherited from the directory ``inherited_from``. Of several licence files in a directory the highest cosine
    counts, ties by name. NULL and empty texts have no licence of their own; a NULL path inherits nothing; a NULL
    flag reads as false. Rows are neither dropped nor merged, and other columns are not read.
    """
    full = full_texts() if full is None else full
    words = shared_table(word_frequency(df, text))
    frequency = {r["t"]: r["n"] for r in words.where(F.col("t").isin("", *sorted(vocabulary(templates, common, full)))).collect()}
    files = frequency.pop("", 0)
    shared = df.sparkSession.sparkContext.broadcast(Scanner(files, frequency, templates, threshold, common, full))  # the templates only
    rows = df.select(F.monotonically_increasing_id().alias("r"), F.col(f"`{key}`").alias("k"), F.col(f"`{path}`").alias("p"),
                     F.col(f"`{text}`").alias("t"), F.coalesce(F.col(f"`{is_license_file}`"), F.lit(False)).alias("f"))

    def make():
        scanner = shared.value
        return lambda texts, whole: list(map(list, zip(*[scanner.scan(t, w) for t, w in zip(texts, whole)]))) or [[]] * 8

    listed = lambda name, kind: T.StructField(name, T.ArrayType(kind()))
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("own", T.StringType()), T.StructField("cosine", T.DoubleType()),
              listed("kinds", T.IntegerType), listed("name", T.StringType), listed("product", T.DoubleType),
              listed("squares", T.DoubleType), listed("others", T.StringType)]
    scanned = shared_table(computed(rows, ["t", "f"], fields, make, ["r", "k", "p", "f"]))
    waits = scanned.select("r", F.explode(F.arrays_zip("kinds", "name", "product", "squares", "others")).alias("e")).select(
        "r", "e.*", F.md5("e.others").alias("x"))
    cosine = F.col("product") / F.sqrt(F.col("squares") + F.col("s"))
    evidence = lambda kind, c, name: F.struct(F.col(kind).alias("kind"), (-F.col(c)).alias("c"), F.col(name).alias("own"))
    late = waits.join(squares_of_others(waits, words, files), "x").withColumn("late", cosine).where(
        F.col("late") >= F.when(F.col("kinds") == FULL, FULL_THRESHOLD).otherwise(threshold)).groupBy("r").agg(
        F.min(evidence("kinds", "late", "name")).alias("late"))
    best = F.least(F.when(F.col("own").isNotNull(), evidence("kind", "cosine", "own")), "late")
    own = shared_table(scanned.join(late, "r", "left").withColumn("best", best).select(
        "k", "p", "f", F.col("best.own").alias("own"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("cosine"),
        directory(F.col("p")).alias("d")))
    given = own.where("f and own is not null and d is not null").groupBy("d").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "own")).alias("best")).select(
        F.col("d").alias("above"), F.col("best.own").alias("passed"))
    asking = own.where("own is null and d is not null").select("d").distinct()
    nearest = asking.select("d", F.explode(F.array_distinct(ancestors(F.col("d")))).alias("above")).join(given, "above").groupBy("d").agg(
        F.max(F.struct(F.length("above").alias("n"), "above", "passed")).alias("best")).select(
        F.col("d").alias("at"), F.col("best.above").alias("above"), F.col("best.passed").alias("passed"))
    joined = own.join(nearest, (F.col("d") == F.col("at")) & F.col("own").isNull(), "left")
    return joined.select(F.col("k").alias(key), F.col("p").alias(path), F.col("own").alias("own_license"), "cosine",
                         F.coalesce("own", "passed").alias("license"), F.col("above").alias("inherited_from"))
