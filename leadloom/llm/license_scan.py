"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame operations only.

Terms are lower-cased runs of letters, digits and inner dots. Document frequencies of the templates' terms are counted over
all files; a term that no template has weighs as much as the mean template term, so that words around a notice count against it.

- Headers: every line, and every run of two to ``LINES`` lines (lines without terms apart) of at most ``WRAPPED`` terms each, is
  compared with the notices, the titles of licence texts and the tags that name a licence, so that a notice may be wrapped. A run that says that something is not so licensed does not count. A run takes its most similar notice at a cosine of ``THRESHOLD`` or more, and a file the most similar of its runs.
- Licence files: the vector of a whole file is compared with the licence texts, at a cosine of ``TEXT_THRESHOLD`` or more.
- A file licenses its directory if it as a whole is a licence text, if half of its words are in its best run, or if it has a licence and is named like a licence file. Files without a licence of their own take that of the nearest ancestor directory
  that has one: the distinct directories are resolved by joins on their ancestors, then joined to the files by path.

Terms are found once and written, with the text if any of them is not an ordinary word. Only files and runs with an anchor term can reach a threshold, so only those are
exploded: what is left of a template without its anchors has a norm below its threshold. A licence depends on the text alone, so
files are told apart by the SHA-256 of their text, and any row finds its licence by it.

Defined cases: null path means the root; null and empty texts have no licence of their own and inherit; null doc_ids are like others;
ties go to the higher score, the licence text before the notice, the lower template, the earlier line, the shorter run; of several
licence files in a directory, texts and files so named come first, then the highest score wins, then the greatest path, then the greatest name of a licence; rows with one id and
path but different texts each have their own licence; repeated rows each give a row; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import materialise

# fixed values: the titles of licence texts, which name their versions
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
# fixed values: names of licences and the notices that declare them
NOTICES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "Released under the zlib License"),
]
#: The tag that names a licence in a file's head, for each licence.
TAGS = [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in [*TITLES, *NOTICES]})]
# fixed values: what says that a licence is not the one
NEGATED = r"\b(?:not|never|no longer)(?: [a-z0-9.]+){0,2} (?:licen[cs]ed|released|distributed|available|covered|published)\b"
# fixed values: the texts of licences
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = [
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     f"or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
     "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
     "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
     "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
     "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
     "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
     "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
     "copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
#: (licence, text) of all templates, licence texts first.
TEMPLATES = [*TEXTS, *TITLES, *TAGS, *NOTICES]
# fixed values: words of any prose, which anchor nothing if the others can
ORDINARY = tuple("a an and any are as at be but by for from in is it not of on or so that the this to was with".split())
FILE_NAMES = r"(?i)/(licen[cs]e|copying|unlicense)([-_.][^/]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Least cosine of a run of lines to a notice, and of a file to a licence text; share of a file's words in a run that makes it a licence file; lines of a run.
THRESHOLD, TEXT_THRESHOLD, FILE_SHARE, LINES = 0.6, 0.8, 0.5, 4
#: A line of more terms is a paragraph of its own, not part of a wrapped one.
WRAPPED = 24


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in terms(text)})


def searched(files: DataFrame, ordinary: tuple[str, ...] = ORDINARY) -> DataFrame:
    """doc_id, path, sha, held (the template terms in the text), low (the text in lower case, if other than ordinary terms are in it): written once."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.split(low, r"[^a-z0-9.]+")
    known = F.array(*[F.lit(t) for t in vocabulary()])
    ends = F.array(*[F.lit(f"{t}.") for t in vocabulary()])
    held = F.array_distinct(F.transform(F.array_intersect(words, F.concat(known, ends)), lambda w: F.rtrim(w, F.lit("."))))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    found = files.select("doc_id", "path", sha.alias("sha"), held.alias("held"), low.alias("low"))
    if ordinary:
        telling = F.size(F.array_except("held", F.array(*[F.lit(w) for w in ordinary]))) > 0
        found = found.withColumn("low", F.when(telling, F.col("low")))
    return materialise(found, "searched")


def term_frequencies(found: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of files, and in how many of them each template term is. One row a term reaches the driver."""
    counted = found.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    counts = {r[0]: r[1] for r in counted}
    return counts.pop("", 0), counts


def weights(n: int, df: dict[str, int]) -> dict[str, float]:
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary()}


def template_vectors(idf: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    """(ordinal, licence, unit vector) of each template."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        own = terms(text)
        v = {t: own.count(t) * idf[t] for t in own}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((k, name, {t: x / norm for t, x in v.items()}))
    return out


def anchors(vectors: list[tuple[int, str, dict[str, float]]], threshold: float, ordinary: tuple[str, ...] = ()) -> list[str] | None:
    """Terms, the heaviest first, until what is left of each template is shorter than the threshold; None if that takes ordinary terms."""
    found: set[str] = set()
    for _, _, v in vectors:
        left = lambda v=v: math.sqrt(max(0.0, 1.0 - sum(v[a] ** 2 for a in found if a in v)))
        for t, _ in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if left() < threshold:
                break
            if t not in ordinary:
                found.add(t)
        if left() >= threshold:
            return None
    return sorted(found)


def _runs(lines: Column, rare: Column) -> Column:
    """(line, k, terms) of the runs of one to LINES lines with terms that have an anchor."""

    def starting(p: Column) -> Column:
        made = F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LINES), F.size(lines) - p)),
            lambda k: F.struct(F.element_at(lines, p + 1)["line"].alias("line"), k.alias("k"), F.flatten(F.slice(lines, p + 1, k)["terms"]).alias("terms")),
        )
        short = F.transform(made, lambda w: F.struct(w.alias("w"), ((w["k"] == 1) | F.forall(F.slice(lines, p + 1, w["k"]), lambda x: F.size(x["terms"]) <= WRAPPED)).alias("wrapped")))
        return F.transform(F.filter(short, lambda s: s["wrapped"] & F.arrays_overlap(s["w"]["terms"], rare)), lambda s: s["w"])

    return F.when(F.size(lines) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), starting)))


def _cosines(units: DataFrame, keys: list[str], templates: DataFrame, known: DataFrame, other: float) -> DataFrame:
    """keys, template, license, score, words: of each unit (keys, terms) with the templates that share a term with it."""
    tf = units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    tf = tf.join(known, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("words"))
    dots = tf.join(templates, "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    return dots.join(norms, keys).select(*keys, "template", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"), "words")


def scan_headers(files: DataFrame, threshold: float = THRESHOLD, text_threshold: float = TEXT_THRESHOLD, ordinary: tuple[str, ...] = ORDINARY) -> tuple[DataFrame, DataFrame]:
    """The files (doc_id, path, sha, candidate: it has an anchor term); and sha, license, score, line (null for a licence text), whole (it is like a licence text), share (of the words in the best run): the texts that have a licence, a row each."""
    spark, found = files.sparkSession, searched(files, ordinary)
    n, df = term_frequencies(found)
    idf = weights(n, df)
    other = sum(idf.values()) / len(idf)
    vectors = template_vectors(idf)
    parts = {"text": vectors[: len(TEXTS)], "notice": vectors[len(TEXTS) :]}
    tables = {
        kind: F.broadcast(spark.createDataFrame([(k, name, t, x) for k, name, v in part for t, x in v.items()], "template int, license string, term string, w double"))
        for kind, part in parts.items()
    }  # fixed tables
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # a fixed table
    terms_of = [anchors(parts[kind], t, ordinary) for kind, t in (("notice", threshold), ("text", text_threshold))]
    if None in terms_of:  # in this corpus a template stands on ordinary words: keep every text
        return scan_headers(files, threshold, text_threshold, ordinary=())
    rare, rare_text = (F.array(*[F.lit(a) for a in ts]) for ts in terms_of)

    has = F.arrays_overlap("held", F.concat(rare, rare_text))
    one = materialise(found.where(has).select("sha", "held", "low").dropDuplicates(["sha"]), "candidates")
    split = F.transform(F.split("low", "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_extract_all(x, F.lit(f"({TERM})"), F.lit(1)).alias("terms")))
    lines = F.filter(split, lambda x: F.size(x["terms"]) > 0)
    runs = one.where(F.arrays_overlap("held", rare)).select("sha", lines.alias("lines")).select("sha", F.explode(_runs(F.col("lines"), rare)).alias("r"))
    runs = runs.where(~F.array_join("r.terms", " ").rlike(NEGATED))
    scored = _cosines(runs.select("sha", "r.line", "r.k", "r.terms"), ["sha", "line", "k"], tables["notice"], known, other).where(F.col("score") >= threshold)
    whole = one.where(F.arrays_overlap("held", rare_text)).select("sha", F.regexp_extract_all("low", F.lit(f"({TERM})"), F.lit(1)).alias("terms"))
    texts = _cosines(whole, ["sha"], tables["text"], known, other).where(F.col("score") >= text_threshold)
    both = texts.select("sha", "template", "license", "score", "words", F.lit(None).cast("int").alias("line"), F.lit(0).alias("k")).unionByName(
        scored.select("sha", "template", "license", "score", "words", "line", "k")
    )
    order = F.struct("score", -F.col("template"), -F.coalesce("line", F.lit(0)), -F.col("k"))
    best = both.groupBy("sha").agg(F.max_by(F.struct("license", "score", "line", "words"), order).alias("b"), F.max(F.isnull("line")).alias("whole"))
    total = one.select("sha", F.size(F.regexp_extract_all("low", F.lit(f"({TERM}|[^\\x00-\\x7f]+)"), F.lit(1))).alias("n_words"))
    share = F.when(F.col("whole"), F.lit(1.0)).otherwise(F.col("b.words") / F.col("n_words"))
    own = best.join(total, "sha").select("sha", "b.license", "b.score", "b.line", "whole", share.alias("share"))
    return found.select("doc_id", "path", "sha", has.alias("candidate")), materialise(own, "licensed")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def with_ancestors(dirs: DataFrame) -> DataFrame:
    """dir, ancestor (itself included), depth: a row for each ancestor."""
    parts = F.split("dir", "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("ancestor"), k.alias("depth")))
    return dirs.select("dir", F.inline(made))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited or none), license_dir: one row per row of files (doc_id, path, text)."""
    files = files.select("doc_id", F.coalesce("path", F.lit("/")).alias("path"), "text")
    rows, own = scan_headers(files, threshold)
    places = rows.select("doc_id", "path", parent(F.col("path")).alias("dir"), "sha", "candidate")
    found = places.where("candidate").join(own, "sha", "left")  # no other file can have a licence of its own
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in own.schema.fields if f.name != "sha"}
    rest = places.where(~F.coalesce(F.col("candidate"), F.lit(False))).withColumns(nothing)
    named = F.col("whole") | F.col("path").rlike(FILE_NAMES)
    gives = (F.col("share") >= FILE_SHARE) | (F.col("license").isNotNull() & named)
    held = found.where(gives).groupBy(F.col("dir").alias("ancestor"))
    held = materialise(held.agg(F.max_by("license", F.struct(named, "score", "path", "license")).alias("dir_license")), "held")
    dirs = places.select("dir").distinct()
    nearest = with_ancestors(dirs).join(held, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("n"))
    nearest = nearest.select("dir", F.col("n.ancestor").alias("license_dir"), "n.dir_license")
    found = found.unionByName(rest).join(materialise(nearest, "nearest"), "dir", "left")
    has, inherits = F.col("license").isNotNull(), F.col("dir_license").isNotNull()
    return found.select(
        "doc_id", "path", F.when(has, F.col("license")).otherwise(F.col("dir_license")).alias("license"), "score",
        F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("dir")).otherwise(F.col("license_dir")).alias("license_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: /source/lang/block/doc_id, a block for each hundred ids."""
    path = F.concat(
        F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"),
        F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")),
    )
    return docs.select("doc_id", path.alias("path"), "text")
