import functools
import math
import re
import textwrap
from collections import Counter

import pytest
from textbench.llm.licenses import LICENCE_FILE, TEMPLATES, document_files, license_scan


def _terms(t):
    import regex

    return regex.findall(r"(?:spdx-license-identifier:[ \t]*)?[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*", (t or "").lower())


def _bare(line):
    line = re.sub(r"[ \t]*(\*+/|-->)?[ \t]*$", "", line)
    return re.sub(r"^[ \t]*(<!--|/\*+|\*+|//+!?|#+|--+|;+|%+|\"{3}|'{3})?[ \t]*", "", line)


def _sentences(text):
    return re.split(r"(?<=[.!?;])[ \t]+", text)


def _passages(text):
    """Every sentence of a line, every paragraph of several lines and its sentences."""
    out = [s for line in re.split(r"[\n\r]", text) for s in _sentences(line)]
    block = []
    for line in [*re.sub(r"\r\n?", "\n", text).split("\n"), ""]:
        line = _bare(line)
        if line:
            block.append(line)
            continue
        if len(block) > 1:
            whole = " ".join(block)
            out += [whole, *_sentences(whole)]
        block = []
    return set(out)


def _want(files, threshold=0.7):
    df = Counter(t for _, _, text in files for t in set(_terms(text)))
    n = len(files)

    def vec(text):
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}, norm

    index = {}
    for i, (name, text) in enumerate(TEMPLATES):
        for t, w in vec(text)[0].items():
            index.setdefault(t, []).append((i, w))

    @functools.cache
    def best_template(passage):
        v, norm = vec(passage)
        dot = Counter()
        for t, w in v.items():
            for i, tw in index.get(t, ()):
                dot[i] += w * tw
        found = max(((round(x, 9), -i) for i, x in dot.items()), default=(0, 0))
        return (*found, norm) if found[0] >= threshold else None

    own = {}
    for key in files:
        _, path, text = key
        cand = _passages(text or "") | ({text} if path and re.search(LICENCE_FILE, path) else set())
        said = {}
        for score, first, norm in filter(None, map(best_template, cand)):
            name = TEMPLATES[-first][0]
            mass, top = said.get(name, ((0.0, 0), 0.0))
            said[name] = (max(mass, (round(score * norm, 6), first)), max(top, score))
        best = max(((m[0], top, m[1], name) for name, (m, top) in said.items()), default=None)
        own[key] = (best[3], best[1]) if best else (None, None)
    dirs = {}
    for key, (name, score) in own.items():
        if name and key[1] and re.search(LICENCE_FILE, key[1]):
            d = "/".join([p for p in key[1].split("/") if p][:-1])
            dirs[d] = min(dirs.get(d, (0, "~")), (-score, name))
    out = {}
    for key, (name, score) in own.items():
        found, where = ("own", None) if name else ("none", None)
        lic = name
        if not name and key[1] is not None:
            parts = [p for p in key[1].split("/") if p][:-1]
            for k in range(len(parts), -1, -1):
                if "/".join(parts[:k]) in dirs:
                    where = "/".join(parts[:k])
                    lic, found = dirs[where][1], "inherited"
                    break
        out[key] = (name, score, lic, found, where)
    return out


def _check(df, files):
    rows = license_scan(df).collect()
    assert len(rows) == len(files)
    got = Counter((r["file_id"], r["path"], r["own_license"], r["license"], r["found"], r["license_dir"]) for r in rows)
    want = _want(files)
    assert got == Counter((k[0], k[1], want[k][0], want[k][2], want[k][3], want[k][4]) for k in files)
    for r in rows:
        if r["score"] is not None:
            scores = [want[k][1] for k in files if k[:2] == (r["file_id"], r["path"]) and want[k][1]]
            assert any(r["score"] == pytest.approx(s) for s in scores)


def test_small_trees(spark):
    filler = "words about nothing in particular " * 30
    files = [(1, "r/LICENSE", TEMPLATES[0][1]), (2, "r/a.py", filler), (3, "r/x/b.py", None), (4, "r/x/y/COPYING.txt", filler + "\n" + TEMPLATES[3][1]),
             (5, "r/x/y/z/c.py", ""), (6, "r/x/y/z/d.py", "# Released under the MIT License. And more of it.\n" + filler), (7, None, filler),
             (8, "top.py", filler), (9, "//r//x/e.py", filler), (10, "q/LICENSES/a.py", filler), (11, "q/license-mit", "Permission denied. A licence for fish"),
             (12, "q/w.py", "x" * 100_000), (None, "r/n.py", filler), (2, "r/a.py", filler), (13, "r/x/y/LICENSE", "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*f, "s", "d") for f in files], "file_id long, path string, text string, score string, dir string")
    _check(df, files)
    assert license_scan(df.where("false")).count() == 0


def test_documents_against_plain_code(spark):
    df = document_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    files = [tuple(r) for r in df.collect()]
    _check(df, files)
    assert "Python" not in license_scan(df)._jdf.queryExecution().toString()


def test_notices_without_an_anchor_word(spark):
    """Passages and licence files without the words by which most notices are known: cosines of all of them, by plain code."""
    filler = "words licensed or released under nothing in particular " * 30
    files = [(1, "a/LICENSE", "CC BY 4.0"), (2, "a/x.py", filler), (3, "b/COPYING", "CC BY-NC 4.0"), (4, "b/c/x.py", filler),
             (5, "c/x.py", filler + "\nReleased under the MIT\n"), (6, "d/x.py", "GNU General Public, version 3"), (7, "e/x.py", filler)]
    files += [(10 + i, f"f/{i}.py", filler) for i in range(10)]
    got = {r["file_id"]: (r["license"], r["found"]) for r in
           license_scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    df = Counter(t for _, _, text in files for t in set(_terms(text)))

    def vec(text):
        w = {t: c * (math.log((1 + len(files)) / (1 + df[t])) + 1) for t, c in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    for i, path, text in files:
        cand = [s for line in text.split("\n") for s in re.split(r"(?<=[.!?;])[ \t]+", line)] + ([text] if re.search(LICENCE_FILE, path) else [])
        best = max(((sum(w * vec(t).get(x, 0) for x, w in vec(c).items()), -k, n) for c in cand for k, (n, t) in enumerate(TEMPLATES)))
        assert (got[i][1] == "own") == (best[0] >= 0.7) and (best[0] < 0.7 or got[i][0] == best[2])
    assert got[1] == ("CC-BY-4.0", "own") and got[2] == ("CC-BY-4.0", "inherited") and got[4] == ("CC-BY-NC-4.0", "inherited")
    assert got[5] == ("MIT", "own")


def test_wrapped_headers_and_whole_texts(spark):
    import textwrap

    filler = "\n".join(["words licensed or released under nothing in particular"] * 20)
    named = [("MPL-2.0", TEMPLATES[6][1]), ("BSD-3-Clause", TEMPLATES[7][1]), ("MIT", TEMPLATES[2][1])]
    files, want = [], []
    for name, text in named:
        for mark in ("# ", " * ", "// ", ""):
            lines = textwrap.wrap(text, 70)
            files.append((len(files), f"s/{len(files)}.py", "\n".join(mark + x for x in lines) + "\n\n" + filler))
            want.append(name)
    mit = [t for n, t in TEMPLATES if n == "MIT" and t.startswith("MIT License")][0]
    files.append((len(files), "m/LICENSE", "MIT License\r\n\r\nCopyright (c) 2024 A. Name\r\n\r\n" + "\r\n".join(textwrap.wrap(mit[12:], 76))))
    want.append("MIT")
    files += [(100 + i, f"f/{i}.py", filler) for i in range(10)]
    got = {r["file_id"]: r["own_license"] for r in
           license_scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert not any(got[100 + i] for i in range(10))


def _wrap(text, mark="", width=72):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_whole_texts_headers_and_tags(spark):
    """Wrapped texts are told apart from those they share clauses with; a tag of an
    unknown licence is nobody's."""
    text = dict(reversed([(name, t) for name, t in TEMPLATES if len(t) > 600]))
    gnu = {name: t for name, t in TEMPLATES if t.startswith("This ") and "Free Software Foundation" in t}
    files = [(name, f"r{i}/LICENSE", "Copyright (c) 2020 Some One\n\n" + _wrap(t)) for i, (name, t) in enumerate(text.items())]
    files += [(name, f"h{i}/a.c", _wrap(t, " * ") + "\n\nint main() { return 0; }") for i, (name, t) in enumerate([*text.items(), *gnu.items()])]
    files += [("Apache-2.0", "s/a.py", "#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0\nx = 1"), ("BSD-2-Clause", "s/b.c", "// SPDX-License-Identifier: BSD-2-Clause"),
              ("GPL-2.0", "s/c.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */"), (None, "t/d.c", "// SPDX-License-Identifier: Zlib"),
              ("ISC", "t/e.c", " # SPDX-License-Identifier:ISC\nwords")]
    files += [(None, f"w/{i}.txt", f"nothing but words of its own, number {i}") for i in range(60)]
    assert {"BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"} <= set(text) and {"GPL-3.0", "AGPL-3.0", "LGPL-2.1"} <= set(gnu)
    df = spark.createDataFrame(files, "file_id string, path string, text string")
    got = {r["path"]: r["own_license"] for r in license_scan(df).collect()}
    assert got == {path: name for name, path, _ in files}
