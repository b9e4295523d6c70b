"""Licence scans: TF-IDF cosine of lines to templates, and inheritance from the nearest licensed directory (DataFrame functions only)."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import unused
from tidemark.scratch import Scratch

#: A line is a licence notice from this cosine on.
THRESHOLD = 0.6
#: Notices as their licences ask for them or as files commonly carry them, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause": "Redistribution permitted under the simplified BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Released under the ISC License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "Proprietary": "All rights reserved.",
}
#: Names, tags and headers that files carry, beside the notices.
_GNU = """{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by
the Free Software Foundation, either version {n} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."""
HEADERS = [
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    ),
    *[(spdx, _GNU.format(it="This program", name=name, n=n)) for spdx, name, n in [("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser", 3), ("AGPL-3.0", "Affero", 3)]],
    *[(spdx, f"GNU {name} General Public License Version {n}") for spdx, name, n in [("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser", 3), ("AGPL-3.0", "Affero", 3)]],
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    *[(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in TEMPLATES if spdx != "Proprietary"],
]
#: A window or file is a full text, or part of one, from this cosine on: legal prose shares much of its vocabulary.
FULL = 0.85
#: Full texts are compared with windows in consecutive parts of about so many terms, so whatever holds twice as many in a row holds a part.
PART = 200
#: Of headers with so many terms a match counts as much as one with part of a full text.
TELLING_HEADER = 30
#: What decides between matches, before their scores: "all rights reserved" stands over most licences and means something only alone.
RESERVED, SHORT, NOTICE, STRETCH, WHOLE = range(5)
_SENTENCE = r"(?<=[.!?:;])\s+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.\w+)?$"
_SEPARATOR = "[^a-z0-9]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(_SEPARATOR, text.lower()) if t]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SEPARATOR), "")


def weights(files: DataFrame, templates: dict[str, str]) -> dict[str, float]:
    """Inverse document frequency of every template term, counted over all whole texts.

    A file counts a term once; only template terms are counted, so the result is bounded by the templates.
    """
    vocabulary = sorted({t for text in templates.values() for t in terms(text)})
    wanted = F.array(*map(F.lit, vocabulary))
    found = files.select(F.explode(F.array_append(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), wanted), F.lit(""))).alias("term"))
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: math.log((counts.get("", 0) + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}


def vectors(idf: dict[str, float], templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """Unit TF-IDF vectors of the templates."""
    out = {}
    for name, text in templates.items():
        raw = {t: n * idf[t] for t, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[name] = {t: v / norm for t, v in raw.items()}
    return out


@cache
def texts() -> tuple[tuple[str, str, float, int], ...]:
    """(licence, text, threshold, order): what windows (or whole files, if ``order`` is WHOLE) are compared with besides single lines with TEMPLATES."""
    out = [(name, text, THRESHOLD, RESERVED if name == "Proprietary" else STRETCH if len(terms(text)) >= TELLING_HEADER else SHORT) for name, text in [*TEMPLATES.items(), *HEADERS]]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text()
        words = terms(text)
        parts = max(1, round(len(words) / PART))
        cuts = [len(words) * k // parts for k in range(parts + 1)]
        out += [(path.stem, text, FULL, WHOLE), *((path.stem, " ".join(words[a:b]), FULL, STRETCH) for a, b in zip(cuts, cuts[1:], strict=False))]
    return tuple(out)


def block_matches(text: Column, marks: Column, present: Column, idf: dict[str, float]) -> Column:
    """array of struct(order, score, back, licence): every window of consecutive lines or sentences that reaches the threshold of a text, and the whole file where it reaches that of a full one.

    A window begins with a line or sentence and has as many terms as the text it is compared with, so its own norm decides, not that of what surrounds it.
    Texts of which the file has no telling term (``marks``), or of which its terms (``present``) have too little for any window to reach the threshold, are left out (exact bounds).
    The file's terms are one array, of which a window is a slice, so work follows the length of the file.
    """
    of = vectors(idf, {str(k): t for k, (_, t, _, _) in enumerate(texts())})
    rows = [{"licence": name, "m": len(terms(t)), "least": least, "order": order, "u": of[str(k)]} for k, (name, t, least, order) in enumerate(texts())]
    every = F.from_json(F.lit(json.dumps(rows)), "array<struct<licence:string,m:int,least:double,order:int,u:map<string,double>>>")
    weight = F.from_json(F.lit(json.dumps(idf)), "map<string,double>")
    other = sum(idf.values()) / max(1, len(idf))
    of_term: dict[str, list[int]] = {}
    for k, (_, _, least, _) in enumerate(texts()):
        for t in telling({"": of[str(k)]}, idf, least):
            of_term.setdefault(t, []).append(k)
    told = F.from_json(F.lit(json.dumps([{"t": t, "of": of} for t, of in sorted(of_term.items())])), "array<struct<t:string,of:array<int>>>")
    asked = F.array_distinct(F.flatten(F.transform(F.filter(told, lambda x: F.array_contains(marks, x["t"])), lambda x: x["of"])))
    reach = lambda t: F.aggregate(present, F.lit(0.0), lambda s, x: s + F.pow(F.coalesce(t["u"][x], F.lit(0.0)), F.lit(2.0)))
    wanted = F.filter(F.transform(asked, lambda k: F.get(every, k)), lambda t: reach(t) >= F.pow(t["least"], F.lit(2.0)) - 1e-9)

    def weighed_terms(own: Column) -> Column:
        weighed = lambda s, i, j: F.transform(tokens(s), lambda t, k: F.struct(t.alias("t"), F.coalesce(own[t], F.lit(other)).alias("w"), F.when(k == 0, -i).alias("back")))
        return F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.flatten(F.transform(F.split(line, _SENTENCE), lambda s, j: weighed(s, i, j)))))

    # Terms are looked up among the file's own.
    own = F.map_from_arrays(present, F.transform(present, lambda x: weight[x]))
    weighed = F.element_at(F.transform(F.array(own), weighed_terms), 1)

    def cosine(window: Column, t: Column) -> Column:
        def measured(v: Column) -> Column:
            total = F.aggregate(v["x"], F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
            counts = lambda x: F.size(F.filter(v["x"], lambda y: y["t"] == x["t"]))
            once = F.transform(F.array_distinct(F.transform(v["x"], lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w")))), lambda x: x["w"] * counts(x))
            norm = F.sqrt(F.aggregate(once, F.lit(0.0), lambda s, w: s + w * w))
            # Repeated terms only lengthen a window, so most are told by the shorter length.
            return F.when((v["dot"] > 0) & (v["dot"] >= (t["least"] - 1e-9) * F.sqrt(total)), F.round(v["dot"] / norm, 9)).otherwise(F.lit(0.0))

        dot = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y["w"] * F.coalesce(t["u"][y["t"]], F.lit(0.0)))
        return F.element_at(F.transform(F.transform(F.array(window), lambda x: F.struct(x.alias("x"), dot(x).alias("dot"))), measured), 1)

    def matches(pair: Column) -> Column:
        match = lambda window, t, back: F.struct(t["order"].alias("order"), cosine(window, t).alias("score"), back.alias("back"), t["licence"].alias("licence"))

        def of_one(t: Column) -> Column:
            begins = F.filter(F.transform(pair["terms"], lambda x, k: F.struct(x["back"].alias("back"), k.alias("k"))), lambda b: b["back"].isNotNull())
            windows = F.transform(begins, lambda b: match(F.slice(pair["terms"], b["k"] + 1, t["m"]), t, b["back"]))
            return F.filter(F.when(t["order"] == WHOLE, F.array(match(pair["terms"], t, F.lit(0)))).otherwise(windows), lambda x: x["score"] >= t["least"])

        # A file that is a licence as a whole is that licence: its parts are not looked for in it.
        whole = F.flatten(F.transform(F.filter(pair["wanted"], lambda t: t["order"] == WHOLE), of_one))
        parts = lambda found: F.flatten(F.transform(F.filter(pair["wanted"], lambda t: t["order"] != WHOLE), of_one))
        return F.element_at(F.transform(F.array(whole), lambda found: F.when(F.size(found) > 0, found).otherwise(parts(found))), 1)

    held = F.transform(F.array(wanted), lambda w: F.struct(w.alias("wanted"), F.when(F.size(w) > 0, weighed).alias("terms")))
    return F.flatten(F.transform(F.filter(held, lambda h: F.size(h["wanted"]) > 0), matches))


def telling(units: dict[str, dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a line, window or file needs one at least to reach ``threshold`` with any template.

    From each template the commonest terms are left out as long as their norm in it stays below: with these terms alone a cosine is at most that norm.
    """
    needed: set[str] = set()
    for unit in units.values():
        left_out = 0.0
        for t in sorted(unit, key=lambda t: (idf[t], t)):
            if left_out + unit[t] ** 2 < threshold**2 - 1e-9:
                left_out += unit[t] ** 2
            else:
                needed.add(t)
    return sorted(needed)


def best_match(line: Column, idf: dict[str, float], units: dict[str, dict[str, float]]) -> Column:
    """struct(score, licence) of the template nearest to a line.  A term of no template weighs as the mean template term."""
    other = sum(idf.values()) / max(1, len(idf))
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    own = F.transform(F.array_distinct(line), lambda t: F.struct(t.alias("t"), (F.size(F.filter(line, lambda x: x == t)) * F.coalesce(weight[t], F.lit(other))).alias("w")))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))

    def cosine(unit: dict[str, float]) -> Column:
        part = F.create_map(*[F.lit(x) for pair in unit.items() for x in pair])
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(part[x["t"]], F.lit(0.0))) / norm

    return F.array_max(F.array(*[F.struct(F.round(cosine(u), 9).alias("score"), F.lit(name).alias("licence")) for name, u in units.items()]))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with ``own_licence``, its ``score`` and ``line`` (from 0), and ``licences``, all that pass, the best first.

    The own licence is that of the full text that the file as a whole is, else of the best window near part of a full text or a long header, else of the best line near a notice of
    ``templates``, else of the best window near a name or tag; "Proprietary" only where nothing else passes.  A whole file's match stands on line 0.

    The counts take one pass and the scan another; neither shuffles texts, and a line is only scored if it has a term without which it cannot match.
    Of equal scores the first line wins, then the last name in alphabetical order.  Null and empty texts have no licence; columns with these four names are replaced, and others
    stay, whatever their names.
    """
    wide = weights(files, templates | {f"{k} of texts": t for k, (_, t, _, _) in enumerate(texts())})
    of_texts = {t: wide[t] for _, text, _, _ in texts() for t in terms(text)}
    idf = {t: wide[t] for t in sorted({t for text in templates.values() for t in terms(text)})}
    units = vectors(idf, templates)
    vectored = vectors(of_texts, {str(k): t for k, (_, t, _, _) in enumerate(texts())})
    longer = {t for k, (_, _, least, _) in enumerate(texts()) for t in telling({"": vectored[str(k)]}, of_texts, least)}
    words = lambda of: F.split(F.lit(" ".join(sorted(of))), " ")
    told = telling(units, idf, threshold)
    needed = words(told)
    files = files.drop("own_licence", "score", "line", "licences")
    marks, found, present, blocks, hit = unused(["marks", "found", "present", "blocks", "hit"], [*files.columns, "own_licence", "score", "line", "licences"])
    text = F.coalesce("text", F.lit(""))
    split = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), tokens(line).alias("t")))
    marked = F.filter(split, lambda x: F.arrays_overlap(x["t"], needed))
    scored = F.transform(marked, lambda x: F.struct(best_match(x["t"], idf, units).alias("m"), (-x["i"]).alias("back")))
    of_line = lambda x: F.struct(F.when(x["m"]["licence"] == "Proprietary", RESERVED).otherwise(NOTICE).alias("order"), x["m"]["score"].alias("score"), x["back"].alias("back"), x["m"]["licence"].alias("licence"))
    # Only files with such a term anywhere are taken apart.
    lines = F.when(F.arrays_overlap(marks, needed), F.array_max(F.filter(F.transform(scored, of_line), lambda x: x["score"] >= threshold)))
    held = F.when(F.arrays_overlap(marks, words(longer)), F.array_intersect(tokens(text), words(of_texts)))
    windows = F.when(F.col(present).isNotNull(), block_matches(text, F.col(marks), F.col(present), of_texts))
    none = F.array().cast("array<struct<order:int,score:double,back:int,licence:string>>")
    ranked = F.reverse(F.array_sort(F.concat(F.array_compact(F.array(found)), F.coalesce(blocks, none))))
    passed = F.col(hit).isNotNull()
    return (
        files.withColumn(marks, F.array_intersect(tokens(text), words({*told, *longer})))
        .withColumn(found, lines)
        .withColumn(present, held)
        .withColumn(blocks, windows)
        .withColumn("licences", ranked)
        .withColumn(hit, F.get("licences", F.lit(0)))
        .withColumn("licences", F.array_distinct(F.transform("licences", lambda x: x["licence"])))
        .withColumns({"own_licence": F.when(passed, F.col(f"{hit}.licence")), "score": F.when(passed, F.col(f"{hit}.score")), "line": F.when(passed, -F.col(f"{hit}.back"))})
        .drop(marks, found, present, blocks, hit)
    )


def inherit(scanned: DataFrame, licence_file: Column) -> DataFrame:
    """``scanned`` with ``licence``, ``inherited_from`` and ``kind`` (own, inherited or none).

    A file without a licence of its own takes that of the nearest directory above it that holds a licence file.  Of several licence files in a
    directory the best score decides, then the name.  Directories are resolved once each: their ancestors are joined to the licensed
    ones, and files then meet their own directory, so a root with very many files below it is joined as one row.  A null path inherits nothing.
    Rows that repeat a path are files of their own; an empty table gives an empty table; other columns stay, but for three with the new names, which are replaced.
    ``scanned`` is used three times, so it should be a written table.
    """
    scanned = scanned.drop("licence", "inherited_from", "kind")
    parts = F.split("path", "/")
    folder, above, given = unused(["folder", "above", "given"], [*scanned.columns, "licence", "inherited_from", "kind"])
    placed = scanned.withColumn(folder, F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).when(F.col("path").isNotNull(), F.lit("")))
    licensed = (
        placed.filter(licence_file & F.col("own_licence").isNotNull() & F.col(folder).isNotNull())
        .groupBy(folder)
        .agg(F.max(F.struct("score", "own_licence")).alias("m"))
        .select(F.col(folder).alias(above), F.col("m.own_licence").alias(given))
    )
    up = F.split(folder, "/")
    every = F.transform(F.sequence(F.lit(0), F.size(up)), lambda k: F.struct(k.alias("__depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(up, 1, k), "/")).alias(above)))
    ancestors = placed.filter(F.col("own_licence").isNull() & F.col(folder).isNotNull()).select(folder).distinct().select(folder, F.inline(F.array_distinct(every)))
    nearest = ancestors.join(licensed, above).groupBy(folder).agg(F.max(F.struct("__depth", above, given)).alias("n")).select(folder, f"n.{above}", f"n.{given}")
    joined = placed.join(nearest, folder, "left")
    missing = F.col("own_licence").isNull()
    return joined.select(
        *scanned.columns,
        F.coalesce("own_licence", given).alias("licence"),
        F.when(missing, F.col(above)).alias("inherited_from"),
        F.when(~missing, "own").when(F.col(given).isNotNull(), "inherited").otherwise("none").alias("kind"),
    )


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Scans ``documents`` laid out in folders of 64 below folders of 4096 below their source; a document that is a licence as a whole or that a notice heads is a licence file of its folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), folder(4096), folder(64), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", path.alias("path"), "text")
    # Written, as the three joins of the inheritance would scan every text three times.
    scanned = Scratch(spark, "licences").table(scan(files).drop("text"))
    return inherit(scanned, F.col("line") == 0)
