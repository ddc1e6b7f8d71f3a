"""Operator 9: licence scan of files, in DataFrame operations only.

Whole texts are cut into passages: sentences of lines, paragraphs of several
lines (joined, without comment marks) and their sentences; of a licence file
(LICENSE, LICENCE, COPYING, NOTICE, with any suffix) the whole text is one more.
Every passage and every template is a sparse TF-IDF vector, the document
frequencies of template words being counted over all files first.  A passage is
a candidate if it has a word of some template's prefix: its rarest words, as
many as leave the others a length below the threshold.  A passage without any
of them has a cosine below it, whatever else it holds, so none is lost.  Only
candidates' other words are counted too.  A passage declares the licence of its
best template, if that cosine reaches the threshold; of a file's passages that
with the longest vector times cosine counts, so that a whole text is worth more
than an opening that several licences share.  Files without a licence take
the licence of the nearest directory above them that has a licence file: the
directories of a path are exploded and joined with those of licence files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.llm.common import materialise, maybe_in, pick

THRESHOLD = 0.7

# whole licence texts
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.")
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY "
    "THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")


def _gnu(what: str, name: str, version: str) -> str:
    """The header that the GNU licences ask for in source files."""
    return (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
            "any later version.")


# fixed values: notices by which licences are commonly declared
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    # the opening words of long licence texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License {_ISC} {_ISC_REST}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # headers of source files
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", _gnu("program", "General Public License", "3")),
    ("GPL-2.0", _gnu("program", "General Public License", "2")),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1")),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3")),
]
SPDX = "spdx-license-identifier:"
TEMPLATES += [(name, f"{SPDX}{gap}{name}{suffix}") for name in sorted({name for name, _ in TEMPLATES}) for gap in (" ", "")
              for suffix in (("", "-only", "-or-later") if "GPL" in name else ("",))]
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-_][^/]*)?$"


def _terms(text) -> F.Column:
    """Lower-cased words of letters, digits, inner points and hyphens; an SPDX
    tag and its licence are one word, so that no other licence is near it."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?:{SPDX}[ \t]*)?[\p{{L}}\p{{N}}]+(?:[.\-][\p{{L}}\p{{N}}]+)*"), F.lit(0))


def _vectors(terms: DataFrame, keys: list[str], df: DataFrame, n_files: int) -> DataFrame:
    """``terms`` (keys, term) -> keys, term, weight of unit length per key, and the
    length before."""
    tf = terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    idf = F.log((1.0 + n_files) / (1.0 + F.coalesce("n", F.lit(0)))) + 1.0
    w = tf.join(df, "term", "left").withColumn("w", F.col("tf") * idf)
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"), "norm")


def _frequencies(files: DataFrame, asked: DataFrame) -> DataFrame:
    """term, n: the files that have it, of the distinct terms ``asked``."""
    used = files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).withColumn("k", F.xxhash64("term"))
    used = maybe_in(used, "k", asked.select(F.xxhash64("term").alias("k")))
    return used.groupBy("term").agg(F.count("*").alias("n")).join(asked, "term", "left_semi")


def _prefixes(vectors: list, threshold: float) -> list[str]:
    """Of each template (t, term, w, n; unit length) the rarest terms: the others,
    most frequent first, have a length below ``threshold``, so (Cauchy-Schwarz) a
    cosine too."""
    out = set()
    for t in {r["t"] for r in vectors}:
        total = 0.0
        for n, term, w in sorted(((r["n"], r["term"], r["w"]) for r in vectors if r["t"] == t), reverse=True):
            total += w * w
            if total >= threshold * threshold * (1 - 1e-6):
                out.add(term)
    return sorted(out)


def _sentences(text) -> F.Column:
    return F.split(text, r"(?<=[.!?;])[ \t]+")


def _passages(text) -> F.Column:
    """Sentences of lines, paragraphs of several lines and their sentences."""
    lines = F.flatten(F.transform(F.split(text, r"[\n\r]"), _sentences))
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)[ \t]*(?:\*+/|-->)?[ \t]*$", "")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*(?:<!--|/\*+|\*+|//+!?|#+|--+|;+|%+|\"{3}|'{3})?[ \t]*", "")
    blocks = F.filter(F.split(bare, r"\n(?:[ \t]*\n)+"), lambda b: b.contains("\n"))
    blocks = F.transform(blocks, lambda b: F.regexp_replace(b, r"\n", " "))
    return F.array_distinct(F.concat(lines, blocks, F.flatten(F.transform(blocks, _sentences))))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``files`` (rid, path, text) -> rid, license, score of the files with a licence of their own."""
    spark: SparkSession = files.sparkSession
    n_files = files.count()
    fixed = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, text string")
    words = fixed.select("t", F.explode(_terms(F.col("text"))).alias("term"))
    known = materialise(_frequencies(files, words.select("term").distinct()), "license-template-df")
    theirs = materialise(_vectors(words, ["t"], known, n_files).drop("norm").join(fixed.select("t", "license"), "t"), "license-templates")
    # as many rows as the templates have words
    weighed = theirs.join(known, "term", "left").select("t", "term", "w", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = F.array(*[F.lit(x) for x in _prefixes(weighed.collect(), threshold)]).cast("array<string>")

    def marked(passage):
        return F.arrays_overlap(_terms(passage), prefix)

    hit = files.where(marked(F.col("text")))
    passages = hit.select("rid", F.posexplode(_passages(F.col("text"))).alias("no", "passage"))
    whole = hit.where(F.col("path").rlike(LICENCE_FILE)).select(
        "rid", F.lit(-1).alias("no"), F.col("text").alias("passage"))
    cut = passages.unionAll(whole).select("rid", "no", _terms(F.col("passage")).alias("terms"))
    terms = cut.where(F.arrays_overlap("terms", prefix)).select("rid", "no", F.explode("terms").alias("term"))
    terms = materialise(terms, "license-terms")
    df = materialise(_frequencies(files, terms.select("term").distinct()), "license-df")

    mine = _vectors(terms, ["rid", "no"], df, n_files)
    # as many rows as the templates have words; rounded, so that equal cosines are equal however they are summed
    dot = mine.join(F.broadcast(theirs.withColumnRenamed("w", "tw")), "term").groupBy("rid", "no", "t", "license").agg(
        F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("score"), F.max("norm").alias("norm"))
    said = dot.where(F.col("score") >= threshold).groupBy("rid", "no").agg(
        F.max(F.struct("score", (-F.col("t")).alias("first"), "license", "norm")).alias("b")).select("rid", "b.*")
    # per file as many rows as it has licences
    per = said.groupBy("rid", "license").agg(
        F.max(F.struct(F.round(F.col("score") * F.col("norm"), 6).alias("mass"), "first")).alias("m"), F.max("score").alias("score"))
    best = per.groupBy("rid").agg(F.max(F.struct("m.mass", "score", "m.first", "license")).alias("best"))
    return best.select("rid", F.col("best.license").alias("license"), F.col("best.score").alias("score"))


def license_scan(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text",
                 threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per file: id, path, own_license, score (the best cosine of a
    passage that declares it), license, found ('own', 'inherited' or 'none') and license_dir.

    * A null or empty text has no licence of its own; a null path has no
      directory to inherit from, and ``''`` is the directory of a path without
      slashes.  Slashes that repeat, lead or trail count as one, or not at all.
    * Of several licence files of a directory that of the higher score counts,
      then the smaller licence name; of templates with equal cosine the earlier;
      of a file's licences of equal length that of the higher score.
    * Rows that repeat id, path and text are treated alike; extra columns are
      not read; an empty table gives an empty result.
    """
    rows = pick(files, id=id_col, path=path_col, text=text_col)
    # rows are told apart by what they hold, so that null or repeated ids do no harm
    rid = F.xxhash64("id", "path", "text")
    rows = rows.withColumn("rid", rid)
    own = materialise(own_licenses(rows, threshold, templates), "license-own")
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    place = rows.select("rid", "id", "path", above.alias("dirs"))
    place = place.join(own, "rid", "left").withColumnsRenamed({"license": "own_license"})
    place = materialise(place, "license-files")

    at = F.array_join("dirs", "/")
    given = place.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(at.alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "own_license")).alias("best"))
    given = given.select("dir", F.col("best.own_license").alias("given"))
    wants = place.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("rid", "dirs").distinct()
    steps = wants.select("rid", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("dirs")),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("dirs", 1, k), "/").alias("dir")))).alias("a"))
    nearest = steps.select("rid", "a.*").join(given, "dir").groupBy("rid").agg(
        F.max(F.struct("depth", "given", "dir")).alias("n"))
    nearest = nearest.select(F.col("rid").alias("nrid"), F.col("n.given").alias("given"), F.col("n.dir").alias("license_dir"))
    out = place.join(nearest, F.col("rid") == F.col("nrid"), "left")
    found = F.when(F.col("own_license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "score",
                      F.coalesce("own_license", "given").alias("license"), found.alias("found"), "license_dir")


def document_files(documents: DataFrame) -> DataFrame:
    """``documents`` as files of repositories: the source is the repository, the
    id tells the directory; one document in seven is a licence file, at one of
    three depths."""
    d = F.col("doc_id")
    top = F.coalesce("source", F.lit("unknown"))
    pkg = F.concat(F.lit("pkg"), F.pmod(F.floor(d / 100), F.lit(17)).cast("string"))
    mod = F.concat(F.lit("mod"), F.pmod(F.floor(d / 10), F.lit(10)).cast("string"))
    name = F.concat(F.lit("LICENSE-"), d.cast("string"))
    depth = F.pmod(F.floor(d / 7), F.lit(3))
    path = F.when(F.pmod(d, F.lit(7)) != 0, F.concat_ws("/", top, pkg, mod, F.concat(d.cast("string"), F.lit(".txt")))).when(
        depth == 0, F.concat_ws("/", top, name)).when(depth == 1, F.concat_ws("/", top, pkg, name)).otherwise(
        F.concat_ws("/", top, pkg, mod, name))
    return documents.select(d.alias("file_id"), path.alias("path"), "text")
