import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import licences as L


def brute(files, licence_file):
    """files: {name: (path, text)} -> {name: (own, score, line, licence, inherited_from)}."""
    terms = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    vocabulary = {t for x in L.TEMPLATES.values() for t in terms(x)}
    df = Counter(t for _, text in files.values() for t in vocabulary & set(terms(text or "")))
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    other = sum(idf.values()) / len(idf)
    own = {}
    for name, (_, text) in files.items():
        found = []
        for i, line in enumerate((text or "").split("\n")):
            a = {t: n * idf.get(t, other) for t, n in Counter(terms(line)).items()}
            for licence, template in L.TEMPLATES.items():
                b = {t: n * idf[t] for t, n in Counter(terms(template)).items()}
                if a:
                    dot = sum(w * b.get(t, 0) for t, w in a.items())
                    found.append((round(dot / math.sqrt(sum(w * w for w in a.values())) / math.sqrt(sum(w * w for w in b.values())), 9), -i, licence))
        best = max(found, default=(0, 0, None))
        own[name] = (best[2], best[0], -best[1]) if best[0] >= L.THRESHOLD else (None, None, None)
    given = {}
    for name, (path, _) in files.items():
        if path is not None and own[name][0] and licence_file(name, own[name]):
            folder = path.rpartition("/")[0]
            given[folder] = max(given.get(folder, (0, "")), (own[name][1], own[name][0]))
    out = {}
    for name, (path, _) in files.items():
        licence, source = own[name][0], None
        if licence is None and path is not None:
            folder = path.rpartition("/")[0]
            while True:
                if folder in given:
                    licence, source = given[folder][1], folder
                    break
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
        out[name] = (*own[name], licence, source)
    return out


def compare(got, expected):
    assert set(got) == set(expected)
    for name, (own, score, line, licence, source) in expected.items():
        r = got[name]
        assert (r.own_licence, r.line, r.licence, r.inherited_from) == (own, line, licence, source), name
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-6)
        assert r.kind == ("own" if own else "inherited" if licence else "none")


def test_tree(spark):
    files = {
        "a": ("LICENSE", "MIT License\nReleased under the MIT License."),
        "b": ("src/deep/er/x.py", "code"),
        "c": ("src/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        "d": ("src/deep/y.py", "# Licensed under the Apache License, Version 2.0\ncode"),
        "e": ("other/z.py", None),
        "f": (None, "no path"),
        "g": ("src/notice.txt", "All rights reserved."),
        "h": ("q/r/LICENSE.md", "nothing of the kind"),
        "i": ("q/r/s.py", ""),
        "j": ("x", "word " * 20000 + "\n" + "Licensed under CC BY-NC 4.0."),
    }
    frame = spark.createDataFrame([(k, *v) for k, v in files.items()], "name string, path string, text string").selectExpr("*", "'mine' AS licence", "'mine' AS score", "'mine' AS depth", "'mine' AS above")
    base = F.element_at(F.split("path", "/"), -1)
    got = {r.name: r for r in L.inherit(L.scan(frame), F.coalesce(base.rlike(L.LICENCE_FILE), F.lit(False))).collect()}
    pattern = re.compile(r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.\w+)?$")
    compare(got, brute(files, lambda name, _: bool(pattern.match(files[name][0].rpartition("/")[2]))))
    assert (got["b"].licence, got["e"].licence, got["j"].own_licence) == ("Proprietary", "MIT", "CC-BY-NC-4.0")
    assert L.inherit(L.scan(frame.limit(0)), F.lit(True)).count() == 0


def test_repeated_rows(spark):
    rows = [(None, "a/x", "Released under the MIT License.")] * 3 + [(1, "a/y", None)] * 2
    got = L.inherit(L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")), F.lit(True)).collect()
    assert len(got) == 5 and {r.licence for r in got} == {"MIT"}


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    files = {d.doc_id: (f"{d.source}/{d.doc_id // 4096}/{d.doc_id // 64}/{d.doc_id}.txt", d.text) for d in docs}
    compare({r.doc_id: r for r in L.op5_licence_scan(spark, small).collect()}, brute(files, lambda _, own: own[2] == 0))


def test_headers_and_whole_files(spark):
    folder = Path(L.__file__).parent / "licence_texts"
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n"
    files = {
        "MIT": "Copyright (c) 2020 Foo\n\n" + (folder / "MIT.txt").read_text(),
        "ISC": (folder / "ISC.txt").read_text(),
        "BSD-3-Clause": "code here\n" * 5 + (folder / "BSD-3-Clause.txt").read_text().replace("\n", " "),
        "Apache-2.0": (folder / "Apache-2.0.txt").read_text(),
        "GPL-3.0": gnu,
    }
    short = {"The MIT License (MIT)": "MIT", "Mozilla Public License Version 2.0": "MPL-2.0", "SPDX-License-Identifier: MIT": "MIT", "Copyright (c) 2020 Foo. All rights reserved.": "Proprietary"}
    rows = [*files.items(), *[(v, f"a b c\n{k}\ncode") for k, v in short.items()], ("none", "the rest of this work is in the house")]
    both = [("MIT", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    prose = [("none", f"some words of prose {i} and the like") for i in range(60)]
    got = L.scan(spark.createDataFrame(rows + both + prose, "name string, text string")).collect()
    for r in got:
        if r.text != both[0][1]:
            assert (r.own_licence or "none") == r.name, (r.name, r.own_licence, r.licences, r.text[:60])
            assert r.name == "none" or r.name in r.licences
        else:
            assert {"MIT", "CC-BY-NC-4.0"} <= set(r.licences)


def test_whole_texts_go_before_windows_and_lines(spark):
    """Every full text gets its own name alone, under a line that reserves all rights, behind prose and without line breaks; the middle of one is not another."""
    folder = Path(L.__file__).parent / "licence_texts"
    prose = "\n".join(f"some words of prose {i % 7} and the like of it" for i in range(40)) + "\n"
    rows = []
    for path in sorted(folder.glob("*.txt")):
        name, text = path.stem, path.read_text()
        rows.append((name, 0, text))
        if len(text) < 9000:
            rows += [(name, None, "Copyright (c) 2020 Foo.\nAll rights reserved.\n\n" + text), (name, None, prose + text), (name, 0, text.replace("\n", " "))]
    middle = "\n".join((folder / "MPL-2.0.txt").read_text().split("\n")[120:200])
    rows += [("MPL-2.0", None, prose * 6 + middle), ("Proprietary", 0, "Copyright (c) 2020 Foo. All rights reserved.")]
    rows += [("none", None, prose + str(i)) for i in range(30)]
    clash = "marks found present blocks hit folder above given __marks __dir __hit".split()
    frame = spark.createDataFrame(rows, "name string, at int, text string").selectExpr("*", "'a/b' AS path", *[f"'mine' AS {c}" for c in clash])
    scanned = L.scan(frame)
    assert set(clash) <= set(L.inherit(scanned.limit(1), F.lit(True)).columns)
    got = scanned.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.own_licence or "none") == r.name, (r.name, r.own_licence, r.score, r.line, r.text[:60])
        assert r.at is None or r.line == r.at, (r.name, r.line)
        assert all(r[c] == "mine" for c in clash)
