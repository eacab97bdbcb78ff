"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance along paths (SQL functions only).

What a file says of its license is taken at three sizes: the whole text of a file named as a license file; the adjacent
paragraphs or comment blocks that speak of a license; and around each line or sentence that does, that one alone, with the
next, and with two on either side. Equal passages are scored once. Term weights come from the counts over all passages of
the corpus. The cosine is a sparse join on the terms the templates hold; the norm runs over all terms of the passage. The
templates are whole license texts (``license_texts``), the usual headers and one-line wordings. A file has the license of
its passage with the highest cosine if that reaches ``LEAST``; a text or block that reaches ``SURE`` goes before what
stands inside it, since licenses name one another.

An SPDX-License-Identifier line is read exactly: its ids, in any case, by ``SPDX_IDS``, with AND, OR and WITH kept; several
different lines hold together (AND). A line without any known id says nothing.

A file without a license of its own has that of the license file in its nearest ancestor directory. Ancestors are
resolved once for each directory, by equality joins of the directory's prefixes with the directories that hold one.

Defined cases: a null text has no notice; a null path has no directory and inherits nothing; several license files in
one directory count as the most similar, then the first by path; repeated rows are scored alike; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import packed, settled, unpacked

LEAST = 0.5
SURE = 0.8
NOTICE = r"(?i)\b(licen[cs]ed?|copyright|SPDX-License-Identifier)\b"
# the lines that belong to a license, also those of its text that do not name it
SPEAKS = (
    r"(?i)\b(licen[cs]\w*|copyright\w*|SPDX-License-Identifier|[al]?gpl\w*|cc0|cc[ -]by\b|creative commons|public domain|unencumbered"
    r"|permission (?:is|to)|redistributions? (?:and use|of source|in binary)|neither the name of|provided .{0,60}as.is\b|anyone is free to"
    r"|free software|source code form|must not be misrepresented|altered source versions|removed or altered)\b")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
UNIT_END = r"\n|(?<=[.!?])\s+(?=[\p{Lu}(])"
COMMENT_END = r"(?m)(^[ \t]*(?:#|//|;|--|%|\*(?!/)).*|\*/[ \t]*|-->[ \t]*)\n(?=[ \t]*[^\s#/;%*-])"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*ID(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+ID)*\)*)".replace("ID", r"[a-z0-9]+(?:[.+:-]+[a-z0-9]+)*\+?")

# fixed values: how the common licenses name themselves, and the headers they ask for
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software "
        "Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} "
        "License for more details. You should have received a copy of the GNU {0} License along with this program.")
_GNU_NAMES = [("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"),
              ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3")]
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
WORDINGS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
     "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
     'the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
     "language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    *((name, f"This work is licensed under the GNU {words} License, version {version}") for name, words, version in _GNU_NAMES),
    *((name, _GNU.format(words, version)) for name, words, version in _GNU_NAMES),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
     "obtain one at http://mozilla.org/MPL/2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International"),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0") for short in _CC_NAMES),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {words} 4.0 International License") for short, words in _CC_NAMES.items()),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense"),
]
TEMPLATES = WORDINGS + [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
# ids in lower case -> the names used here, which leave "only" and "or later" out
SPDX_IDS = {name.lower(): name for name in [
    *(name for name, _ in TEMPLATES), "Apache-1.1", "Artistic-2.0", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-SA-3.0", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "GPL-1.0",
    "LGPL-2.0", "MIT-0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "OpenSSL", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "Vim", "W3C", "WTFPL", "X11"]}
SPDX_IDS |= {f"{i.lower()}{tail}": i for i in [*SPDX_IDS.values()] if "GPL" in i for tail in ("-only", "-or-later", "+")}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where ``then`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def passages_of(path: Column, text: Column) -> Column:
    """The passages that speak of a license: (level, words), 2 for whole texts, 1 for blocks, 0 for lines. Null without any."""
    named = F.coalesce(name_of(path).rlike(LICENSE_FILE), F.lit(False))
    lines = F.concat_ws("\n", F.filter(F.split(text, "\n"), lambda line: line.rlike(NOTICE)))
    paragraphs = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), COMMENT_END, "$1\n\n"), r"\n\s*\n")
    speaking = F.concat_ws("\n", F.transform(paragraphs, lambda p: F.when(p.rlike(SPEAKS), p).otherwise("\x01")))

    def around(units: Column) -> Column:
        hits = F.filter(F.transform(units, lambda unit, i: F.when(unit.rlike(SPEAKS), i + 1)), lambda i: i.isNotNull())
        spans = F.flatten(F.transform(hits, lambda i: F.array(
            F.slice(units, i, 1), F.slice(units, i, 2), F.slice(units, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)) + 2))))
        return F.transform(spans, lambda span: F.concat_ws("\n", span))

    units = F.filter(F.split(text, UNIT_END), lambda unit: unit.rlike(r"[\p{L}\p{N}]"))
    leveled = lambda made, level: F.transform(made, lambda words: F.struct(F.lit(level).alias("level"), words.alias("words")))
    made = F.concat(
        leveled(F.when(named, F.array(text)).otherwise(F.array().cast("array<string>")), 2), leveled(F.split(speaking, "\x01"), 1),
        leveled(F.concat(F.array(lines), _let(units, around)), 0))
    found = F.array_distinct(F.filter(made, lambda p: F.trim(p["words"]) != ""))
    return F.when(text.rlike(SPEAKS) | (named & (F.trim(text) != "")), found)


def spdx_of(text: Column) -> Column:
    """The license of the SPDX lines, null without a known id."""
    known = F.create_map(*(F.lit(x) for pair in SPDX_IDS.items() for x in pair))
    tokens = lambda said: F.regexp_extract_all(said, F.lit(r"[()]|[^\s()]+"), F.lit(0))

    def spelled(said: Column) -> Column:
        words = F.transform(tokens(said), lambda t: F.when(F.upper(t).isin("AND", "OR", "WITH"), F.upper(t)).otherwise(F.coalesce(F.try_element_at(known, F.lower(t)), t)))
        line = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", words), r"\( ", "("), r" \)", ")")
        line = F.regexp_replace(line, r"^\(([^()]*)\)$", "$1")
        return F.when(F.exists(tokens(said), lambda t: F.try_element_at(known, F.lower(t)).isNotNull()), line)

    said = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), spelled), lambda x: x.isNotNull()))
    several = F.concat_ws(" AND ", F.transform(said, lambda x: F.when(x.contains(" OR "), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)))
    return F.when(text.rlike("(?i)SPDX-License-Identifier:"), F.when(F.size(said) == 1, said[0]).when(F.size(said) > 1, several))


def scored(passages: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(passage, words, copies), one row for each distinct passage -> those with a license: passage, license, similarity."""
    spark = passages.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, wording string")
    known_terms = known.select("template", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "term").agg(F.count(F.lit(1)).alias("times"))
    counts = settled(
        passages.select("passage", "copies", F.explode(terms(F.col("words"))).alias("term")).groupBy("passage", "copies", "term").agg(F.count(F.lit(1)).alias("times")),
        "license-terms")
    total = passages.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total")).first()[0]
    frequency = settled(counts.groupBy("term").agg(F.sum("copies").alias("df")), "license-frequencies")
    weight = (F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")
    template_weights = known_terms.join(frequency, "term", "left").select("template", "term", (F.col("times") * weight).alias("t"))
    lengths = template_weights.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("length"))
    table = F.broadcast(template_weights.join(lengths, "template"))  # as many rows as the templates have terms
    # a passage's terms meet in one partition: norm, products and the choice need no other exchange
    placed = counts.select("passage", "term", "times").join(frequency, "term").repartition("passage").select("passage", "term", (F.col("times") * weight).alias("w"))
    best = (
        placed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("passage"))))
        .join(table, "term")
        .groupBy("passage", "template", "length", "norm").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
        .withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6))
        .where(F.col("similarity") >= least)
        .groupBy("passage").agg(F.max(F.struct("similarity", (-F.col("template")).alias("first"))).alias("best"))
    )
    named = F.broadcast(known.select(F.col("template").alias("_t"), "license"))
    return best.join(named, -F.col("best.first") == F.col("_t")).select("passage", "license", "best.similarity")


def prefixes(directory: Column) -> Column:
    """The directory and its ancestors, down to the root ""."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))))


def licensed(files: DataFrame, least: float = LEAST, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``files`` (path, text, any others) with ``own_license``, ``similarity``, ``license`` and ``inherited_from``.

    ``inherited_from`` is the directory whose license file counts, null where the license is the file's own or unknown.
    """
    kept = [c for c in files.columns if c not in ("own_license", "similarity", "license", "inherited_from")]
    # what a file says depends on its text and on whether it is named as a license file
    named = F.coalesce(name_of(F.col("path")).rlike(LICENSE_FILE), F.lit(False))
    notice = F.when(named | F.col("text").rlike(SPEAKS), F.sha2(F.concat(named.cast("string"), "text"), 256))
    marked = packed(files, notice.alias("_notice"), directory_of(F.col("path")).alias("_dir"))
    narrow = settled(files.select("path", notice.alias("notice"), directory_of(F.col("path")).alias("dir")), "license-notices")
    speaking = files.select(notice.alias("notice"), "path", "text").where("notice is not null").groupBy("notice").agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("path").alias("path"))
    notices = settled(speaking.select("notice", "copies", spdx_of(F.col("text")).alias("spdx"), passages_of(F.col("path"), F.col("text")).alias("passages")), "license-texts")
    said = settled(notices.where("spdx is null").select("notice", "copies", F.explode("passages").alias("p")).select(
        "notice", "copies", "p.level", "p.words", F.sha2("p.words", 256).alias("passage")), "license-passages")
    distinct = settled(said.groupBy("passage").agg(F.first("words").alias("words"), F.sum("copies").alias("copies")).withColumnRenamed(
        "passage", "key").withColumn("passage", F.monotonically_increasing_id()), "license-distinct")  # short ids for the many term rows
    known = scored(distinct, templates, least).join(distinct.select("passage", "key"), "passage").select(F.col("key").alias("passage"), "license", "similarity")
    found = said.select("notice", "level", "passage").join(settled(known, "license-known"), "passage").groupBy("notice").agg(
        F.max(F.struct(F.when(F.col("similarity") >= SURE, F.col("level")).otherwise(0).alias("level"), "similarity", "license")).alias("best"))
    exact = notices.where("spdx is not null").select("notice", F.col("spdx").alias("license"), F.lit(1.0).alias("similarity"))
    scores = settled(found.select("notice", "best.license", "best.similarity").union(exact), "license-scores")
    holders = (
        narrow.where(F.col("notice").isNotNull() & name_of(F.col("path")).rlike(LICENSE_FILE))
        .join(scores, "notice")
        .groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("least"), "path", "license")).alias("chosen"))
        .select(F.col("dir").alias("holder"), F.col("chosen.license").alias("given"))
    )
    nearest = settled(
        narrow.where("dir is not null").select("dir").distinct()
        .withColumn("holder", F.explode(prefixes(F.col("dir"))))
        .join(holders, "holder")
        .groupBy("dir").agg(F.max(F.struct(F.size(F.split("holder", "/")).alias("depth"), F.length("holder").alias("size"), "holder", "given")).alias("near"))
        .select(F.col("dir").alias("_d"), F.col("near.holder").alias("_from"), F.col("near.given").alias("_given")), "license-directories")
    own = scores.select(F.col("notice").alias("_n"), F.col("license").alias("own_license"), "similarity")
    rows = marked.join(own, F.col("_notice") == F.col("_n"), "left").join(nearest, F.col("_dir") == F.col("_d"), "left")
    return rows.select(*unpacked(kept), "own_license", "similarity", F.coalesce("own_license", "_given").alias("license"),
                       F.when(F.col("own_license").isNull(), F.col("_from")).alias("inherited_from"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/block/id.txt. A notice that is nearly all of a short document makes it the
    license file of a directory: of the block, the language or the source, by its id."""
    block = F.floor(F.col("doc_id") / 64).cast("long")
    parts = [F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), block.cast("string")]
    level = F.pmod(F.col("doc_id"), F.lit(3))
    short = F.coalesce((F.length("text") <= 400) & F.col("text").rlike(NOTICE), F.lit(False))
    directory = F.when(~short | (level == 0), F.concat_ws("/", *parts)).when(level == 1, F.concat_ws("/", *parts[:2])).otherwise(parts[0])
    name = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", directory, name).alias("path"), "text")


def license_report(docs: DataFrame) -> DataFrame:
    """Per document its place in the tree, its own license, and the one that holds."""
    rows = licensed(as_files(docs))
    return rows.select("doc_id", "path", "own_license", "similarity", "license", "inherited_from")
