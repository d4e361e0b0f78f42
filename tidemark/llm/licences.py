"""Licence scans: TF-IDF cosine to notice templates, and inheritance from the nearest directory.

Every file is cut into sentences (at blank lines, and at white space behind . ! ?). A sentence whose TF-IDF cosine
to a template reaches ``threshold`` is that licence's notice; the best template counts. A sentence over several
lines that reaches it with none is tried line by line. An SPDX line names its licences itself. A name without a
version goes where the file names one with it. A file whose TF-IDF
cosine as a whole to a full licence text reaches ``WHOLE`` has that licence alone, however long it is.

A directory's licence holders are its files with a full licence text, and those with a notice and a licence
file's name. Where it has neither, they are the files of which notices make up ``MOSTLY`` of the words or more.
A file without a notice of its own takes the licences of the nearest directory above it that has any.

Document frequencies of the templates' words are counted over all files; other words weigh like a word never
seen. Most sentences need no cosine: by Cauchy-Schwarz a sentence that reaches the threshold must hold one of
a template's heaviest words, the fewest that leave less than threshold times its length to the rest.

Null and empty texts have no notice; a null path has no directory and inherits nothing.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.small import attach

# Notices by licence identifier, a sentence each. A name without a version stands for notices that
# state none.
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published "
        "by the Free Software Foundation, either version {} of the License, or (at your option) any later version")


def _gnu(name: str, version: str, date: str) -> list[str]:
    return [_GNU.format(name, version), _GNU.format(name, version).replace("program", "library"),
            f"This work is licensed under the GNU {name}, version {version}",
            f"You should have received a copy of the GNU {name} version {version} along with this program",
            f"Licensed under the GNU {name} v{version}", f"GNU {name} Version {version}, {date}"]


def _creative(kind: str, long: str, version: str) -> list[str]:
    return [f"Licensed under CC {kind} {version}", f"This work is licensed under a Creative Commons {long} {version} International License",
            f"Creative Commons {long} {version} International"]


_KINDS = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike",
          "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
          "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES = {
    "AGPL": ["GNU Affero General Public License"],
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007"),
    "Apache": ["Apache License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
                   "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"],
    **{f"CC-{kind}-{version}": _creative(kind, long, version) for kind, long in _KINDS.items() for version in ("3.0", "4.0")},
    "CC0-1.0": ["Licensed under CC0 1.0", "CC0 1.0 Universal",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL": ["GNU General Public License"],
    "GPL-2.0": _gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007"),
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License", "ISC License"],
    "LGPL": ["GNU Lesser General Public License"],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007"),
    "MIT": ["Released under the MIT License", "MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
                "Mozilla Public License Version 2.0"],
}
SPDX = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"
_SPDX_NAME = r"[A-Za-z0-9.-]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
THRESHOLD = 0.75
WHOLE = 0.9  # of a whole file to a full licence text
MOSTLY = 0.5
COMMON = 4.0  # idf of words in a twentieth of the files
_SENTENCE = r"\n|(?<=[.!?])\x20+"
_WRAPPED = r"(?<=[.!?])\s+|\n[^A-Za-z0-9\n]*\n\s*"  # a sentence may run over line ends
_SLOTS = 4096
_WORD = "[a-z0-9]+"


def full_texts() -> dict[str, list[str]]:
    """Full licence texts by identifier. AGPL-3.0 is the text of GPL-3.0 under its own name, from which it differs in a section."""
    texts = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = re.sub(r"(?i)\bGNU general public", "GNU Affero General Public", texts["GPL-3.0"])
    return {name: [text] for name, text in sorted(texts.items())}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, dict[str, int]]]:
    out = []
    for name, notices in templates.items():
        for notice in notices:
            words = re.findall(_WORD, notice.lower())
            out.append((name, {w: words.count(w) for w in dict.fromkeys(words)}))
    return out


def _slot(word: Column) -> Column:
    return F.pmod(F.crc32(word), F.lit(_SLOTS)).cast("int")


def word_weights(files: DataFrame, templates: dict[str, list[str]]) -> tuple[dict[str, float], float]:
    """idf of each template word over all files, and of a word never seen."""
    vocabulary = sorted({w for _, words in template_words(templates) for w in words})
    slots: list[list[str]] = [[] for _ in range(_SLOTS)]
    for word in vocabulary:
        slots[zlib.crc32(word.encode()) % _SLOTS].append(word)
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<string>>")
    listed = F.filter(F.array_distinct(_words(F.coalesce(F.col("text"), F.lit("")))),
                      lambda w: F.array_contains(F.get(table, _slot(w)), w))
    held = files.select(F.explode(listed).alias("word"))
    seen = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most the vocabulary
    n = files.count()
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {w: idf(seen.get(w, 0)) for w in vocabulary}, idf(0)


def needed_words(templates: dict[str, list[str]], weights: dict[str, float], threshold: float) -> list[str]:
    """Words of which a matching sentence must hold at least one; any are, so words of many files are left out first."""
    out = set()
    for _, words in template_words(templates):
        squares = sorted(((count * weights[w]) ** 2, w) for w, count in words.items())
        squares.sort(key=lambda x: weights[x[1]] > COMMON)
        left, bound = 0.0, threshold ** 2 * sum(s for s, _ in squares) * (1 - 1e-9)
        for square, word in squares:
            left += square
            if left >= bound:
                out.add(word)
    return sorted(out)


def _slots(templates: dict[str, list[str]], weights: dict[str, float]) -> Column:
    """Words by the remainder of their CRC: idf, and what one occurrence adds to the cosine with each template."""
    listed = template_words(templates)
    lengths = [math.sqrt(sum((c * weights[w]) ** 2 for w, c in counts.items())) for _, counts in listed]
    slots: list[list[dict]] = [[] for _ in range(_SLOTS)]
    for word in sorted({w for _, counts in listed for w in counts}):
        adds = [counts.get(word, 0) * weights[word] ** 2 / length for (_, counts), length in zip(listed, lengths, strict=True)]
        slots[zlib.crc32(word.encode()) % _SLOTS].append({"word": word, "idf": weights[word], "adds": adds})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<word:string,idf:double,adds:array<double>>>>")


def best_template(words: Column, templates: dict[str, list[str]], weights: dict[str, float], unseen: float) -> Column:
    """(score, licence) of the template nearest to the words; ties go to the later name."""
    slots, names = _slots(templates, weights), [name for name, _ in template_words(templates)]

    def step(state: Column, word: Column) -> Column:
        held = F.filter(F.get(slots, _slot(word)),
                        lambda x: x["word"] == word)
        known = F.get(held, F.lit(0))
        again = F.when(state["last"] == word, state["times"]).otherwise(F.lit(0))
        return F.struct(
            word.alias("last"), (again + 1).alias("times"),
            # The square of a count grows by 2 n + 1 with its next occurrence.
            (state["square"] + (2 * again + 1) * F.pow(F.coalesce(known["idf"], F.lit(unseen)), F.lit(2.0))).alias("square"),
            F.when(F.size(held) > 0, F.zip_with(state["dots"], known["adds"], lambda a, b: a + b)).otherwise(state["dots"]).alias("dots"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("times"), F.lit(0.0).alias("square"),
                     F.array_repeat(F.lit(0.0), len(names)).alias("dots"))
    listed = F.array(*[F.lit(n) for n in names])
    return F.aggregate(F.array_sort(words), start, step, lambda state: F.array_max(F.zip_with(
        state["dots"], listed, lambda dot, name: F.struct(F.round(dot / F.sqrt(state["square"]), 9).alias("score"), name.alias("licence")))))


def _holding(words: list[str]) -> str:
    """Pattern of a text that holds one of the words; grouped by first letter, which spares most comparisons."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(re.escape(word[1:]))
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(groups.items())) + r")(?![a-z0-9])"


def spdx_names(text: Column) -> Column:
    """Licence identifiers of the SPDX lines, without their -only, -or-later and +."""
    said = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), " "), r"\bWITH\s+[A-Za-z0-9.-]+", " ")
    names = F.regexp_extract_all(F.regexp_replace(said, r"-only\b|-or-later\b", ""), F.lit(_SPDX_NAME), F.lit(0))
    return F.filter(names, lambda n: ~n.isin("AND", "OR") & n.rlike("[A-Za-z]"))


def versioned(names: Column) -> Column:
    """The names without those that lack a version where another one has it."""
    return F.filter(names, lambda n: ~(n.isin("AGPL", "Apache", "GPL", "LGPL") & F.exists(
        names, lambda m: m.startswith(F.concat(n, F.lit("-"))))))


def licence_notices(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files without text, with ``own``: licences found, ``whole``: whether the text is a full licence text, and
    ``mostly``: whether notices make up most of its words."""
    templates, full = TEMPLATES if templates is None else templates, full_texts()
    weights, unseen = word_weights(files, {f"{kind}{name}": notices for kind, some in enumerate((templates, full)) for name, notices in some.items()})
    pattern, full_pattern = _holding(needed_words(templates, weights, threshold)), _holding(needed_words(full, weights, WHOLE))
    text = F.coalesce(F.col("text"), F.lit(""))

    def notices(parts: Column) -> Column:
        def judged(s: Column) -> Column:
            return F.transform(F.array(best_template(_words(s), templates, weights, unseen)), lambda b: F.struct(
                b["score"].alias("score"), b["licence"].alias("licence"), F.size(_words(s)).alias("words")))[0]

        return F.filter(F.transform(F.filter(parts, lambda s: s.rlike(pattern)), judged), lambda b: b["score"] >= threshold)

    # Line by line only where the lines as one sentence are no notice.
    joined = F.filter(F.split(text, _WRAPPED, -1), lambda s: s.rlike(pattern))
    found = F.flatten(F.transform(joined, lambda s: F.transform(F.array(notices(F.array(s))), lambda n: F.when(
        (F.size(n) > 0) | ~s.contains("\n"), n).otherwise(notices(F.split(s, _SENTENCE, -1))))[0]))
    said = F.transform(spdx_names(text), lambda n: F.struct(
        F.lit(1.0).alias("score"), n.alias("licence"), (3 + F.size(_words(n))).alias("words")))
    whole = F.when(text.rlike(full_pattern), F.get(F.filter(
        F.array(best_template(_words(text), full, weights, unseen)), lambda b: b["score"] >= WHOLE), F.lit(0)))
    likely = text.rlike(pattern) | text.contains("SPDX-License-Identifier")
    frame = files.withColumns({
        "full": whole, "found": F.when(likely, F.concat(found, said)), "size": F.when(likely, F.size(_words(text)))})
    others = [c for c in files.columns if c != "text"]
    names = versioned(F.array_sort(F.array_distinct(F.transform("found", lambda b: b["licence"]))))
    held = F.aggregate("found", F.lit(0), lambda a, b: a + b["words"])
    return frame.select(
        *others,
        F.when(F.col("full").isNotNull(), F.array("full.licence")).otherwise(F.coalesce(names, F.array().cast("array<string>"))).alias("own"),
        F.coalesce("full.score", F.array_max(F.transform("found", lambda b: b["score"])), F.lit(0.0)).alias("score"),
        F.col("full").isNotNull().alias("whole"),
        F.coalesce((held > 0) & (held >= MOSTLY * F.col("size")), F.lit(False)).alias("mostly"))


def directory_of(path: Column) -> Column:
    """The path without its last part; empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of (path, text, ...): other columns, path, own, score, licences and ``source_dir``.

    ``licences`` are the file's own, else those inherited; ``source_dir`` is where inherited ones come from.
    Columns of these names in the input are replaced.
    """
    scratch = Scratch(files.sparkSession, "licences")
    others = [c for c in files.columns if c not in ("path", "text", "own", "score", "licences", "source_dir")]
    files = files.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"), "path", "text")
    own = scratch.save(licence_notices(files, templates, threshold).withColumn("dir", directory_of(F.col("path"))), "own")
    # Files that are a licence or are named so come before those that mostly are notices.
    sure = F.col("whole") | F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    holds = (own.where((F.size("own") > 0) & (sure | F.col("mostly"))).select("dir", sure.alias("sure"), F.explode("own").alias("licence"))
             .groupBy("dir", "sure").agg(F.array_sort(F.collect_set("licence")).alias("dir_licences"))
             .groupBy("dir").agg(F.max_by("dir_licences", "sure").alias("dir_licences")))
    holds = scratch.save(holds.withColumnRenamed("dir", "above"), "holds")
    # Each directory looks up all directories above it once, however many files it has.
    bare = own.where(F.size("own") == 0).select("dir").distinct()
    parts = F.split("dir", "/", -1)
    level = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    looked = bare.where("dir is not null").select("dir", F.explode(level).alias("level")).withColumn(
        "above", F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/"))
    nearest = attach(looked, holds, ["above"]).groupBy("dir").agg(
        F.max(F.struct("level", "above", "dir_licences")).alias("n"))
    nearest = scratch.save(nearest.select("dir", F.col("n.above").alias("source_dir"), "n.dir_licences"), "nearest")
    joined = attach(own, nearest.withColumnRenamed("dir", "_dir"), (F.col("dir") == F.col("_dir")) & (F.size("own") == 0), "left")
    none = F.array().cast("array<string>")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in others], "path", "own", "score", F.when(F.size("own") > 0, F.col("own")).otherwise(
        F.coalesce("dir_licences", none)).alias("licences"), "source_dir")
