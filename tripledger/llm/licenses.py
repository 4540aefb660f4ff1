"""Licence scans: TF-IDF cosine of whole files to full texts, of short files and of runs of lines to notices, then
inheritance from the nearest directory.

Only texts with a term that a match can't do without are looked at closely: a template's lightest terms, which
together stay below the threshold, can't reach it alone, so a match has one of the others. A version or a sibling's
word (NC, SA, Lesser) must be the template's own, however high the cosine.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib.resources import files as package_files
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import map_rows

# Customary notices of public licences, by SPDX name; full texts are in license_texts.
_GNU = (
    "This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
    "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.",
)


def _gnu(kind: str, version: str) -> list[str]:
    """The notices of a GNU licence: one line and the first sentences of its header."""
    works = [x.format(kind=kind, version=version, work=work) for work in ("program", "library") for x in _GNU[:1]]
    return [f"This work is licensed under the GNU {kind}General Public License, version {version}.", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {version}.", *works]


def _gnu_headers(kind: str, version: str) -> list[str]:
    return [" ".join(_GNU).format(kind=kind, version=version, work=work) for work in ("program", "library")]


def _creative(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License."]


TEMPLATES = {
    "AGPL-3.0": _gnu("Affero ", "3"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "LGPL-2.0": _gnu("Library ", "2"),
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# Full headers: whole files are judged by them and by the full texts.
HEADERS = {
    "AGPL-3.0": _gnu_headers("Affero ", "3"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-1.0": _gnu_headers("", "1"),
    "GPL-2.0": _gnu_headers("", "2"),
    "GPL-3.0": _gnu_headers("", "3"),
    "LGPL-2.0": _gnu_headers("Library ", "2"),
    "LGPL-2.1": _gnu_headers("Lesser ", "2.1"),
    "LGPL-3.0": _gnu_headers("Lesser ", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
LINE_LEAST, FILE_LEAST, FULL_LEAST = 0.7, 0.5, 0.9
#: A file that is this many times longer than a notice is no notice; a header has this many lines at most.
STRETCH, RUN = 4, 16
#: A template with more terms is a full text, which names versions and siblings other than its own.
FULL_SIZE = 400
#: Words of which a match has just those of its template.
SIBLINGS = frozenset(
    "affero lesser library apache mozilla mit bsd isc boost by by-nc by-sa by-nd by-nc-sa by-nc-nd attribution attribution-noncommercial attribution-sharealike "
    "attribution-noderivatives attribution-noderivs attribution-noncommercial-sharealike attribution-noncommercial-noderivatives attribution-noncommercial-noderivs".split()
)
#: Of these, words of common use: a template's must be there, others may.
COMMON = frozenset({"by", "library", "attribution"})
LICENSE_FILE = r"(?i)(^|/)((un)?licen[cs]e|copying)([-._][^/]*)?$"
#: Full texts that differ from a sibling's by a few sentences: what only the other one says, and its name.
TOLD_APART = {
    "0BSD": [(re.compile(r"appear\s+in\s+all\s+copies"), "ISC")],
    "BSD-2-Clause": [(re.compile(r"neither\s+the\s+name"), "BSD-3-Clause")],
    "BSD-3-Clause": [(re.compile(r"advertising\s+materials"), "BSD-4-Clause")],
    "MIT-0": [(re.compile(r"shall\s+be\s+included\s+in\s+all"), "MIT")],
    "GPL-3.0": [(re.compile(r"remote\s+network\s+interaction"), "AGPL-3.0")],
}
CREATIVE = re.compile(r"\battribution((?:-(?:noncommercial|sharealike|noderivatives))*)\s+4\.0")
COPYRIGHT = re.compile(r"(?m)^[^\w\n(]*(?:copyright\s+(?:\(c\)|©|[\[<(]?(?:\d{4}|year|yyyy))|\(c\)\s|©).*$")
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def full_texts() -> dict[str, list[str]]:
    """The full texts of license_texts by SPDX name, with the full headers; lines of copyright are not compared."""
    folder = package_files("tripledger.llm") / "license_texts"
    texts = {f.name.removesuffix(".txt"): [COPYRIGHT.sub("", f.read_text("utf-8").lower())] for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    return {name: texts.get(name, []) + HEADERS.get(name, []) for name in sorted({*texts, *HEADERS})}


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def term_documents(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all documents each term of the templates is found; one number a term reaches the driver."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for text in batch.column(1).to_pylist():
            seen.update(known.intersection(TERM.findall((text or "").lower())))
        seen[""] += batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    known = frozenset(vocabulary)
    counted = map_rows(docs.select(F.lit(1).alias("one"), "text"), make, "term string, n long")
    return {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Matcher:
    """Templates as unit vectors. A term in no template weighs as one that a single document has.

    damped: a term counts as 1 + ln n; for full texts.
    """

    def __init__(self, templates: dict[str, list[str]], found: dict[str, int], least: float | None = None, damped: bool = False):
        self.total, self.damped = found.get("", 0), damped
        self.least = min(LINE_LEAST, FILE_LEAST) if least is None else least
        vectors = [(name, terms(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.idf = {term: log((1 + self.total) / (1 + found.get(term, 0))) + 1 for _, v in vectors for term in v}
        self.rare = log((1 + self.total) / 2) + 1
        self.places = {t: i for i, t in enumerate(self.idf)}
        self.names = [name for name, _ in vectors]
        self.sizes = [v.total() for _, v in vectors]
        self.own = [frozenset(t for t in v if t in SIBLINGS or t.isdigit() or t.endswith("-clause") or re.fullmatch(r"\d+\.\d+", t)) for _, v in vectors]
        self.units = np.zeros((len(self.idf), len(vectors)))
        needed: set[str] = set()
        for at, (_, v) in enumerate(vectors):
            weights = {t: self.weight(n) * self.idf[t] for t, n in v.items()}
            norm = sqrt(sum(w * w for w in weights.values()))
            unit = {t: w / norm for t, w in weights.items()}
            self.units[[self.places[t] for t in unit], at] = list(unit.values())
            left = 1.0
            for t, w in sorted(unit.items(), key=lambda x: (-x[1], x[0])):
                if sqrt(max(left, 0.0)) < self.least:
                    break
                needed.add(t)
                left -= w * w
        self.needed = re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(needed)) + r")(?![a-z0-9])")

    def weight(self, n: int) -> float:
        return 1 + log(n) if self.damped else n

    def fits(self, at: int, found: Counter) -> bool:
        """Whether version and sibling words are those of the template (2 stands for 2.0), and the length is near its own."""
        if self.sizes[at] > FULL_SIZE or self.damped and self.names[at] not in HEADERS:
            return True
        own = self.own[at]
        if found.total() > STRETCH * self.sizes[at] or any(t not in found and t.removesuffix(".0") not in found for t in own):
            return False
        return all(t in own or t in COMMON for t in SIBLINGS.intersection(found))

    def best(self, found: Counter) -> tuple[float, str]:
        """The template nearest to the terms and its cosine, or (0, "") if none reaches the least threshold."""
        known = [(self.places[t], self.weight(n) * self.idf[t]) for t, n in found.items() if t in self.places]
        if not known:
            return 0.0, ""
        norm = sqrt(sum((self.weight(n) * self.idf.get(t, self.rare)) ** 2 for t, n in found.items()))
        at, weights = zip(*known, strict=True)
        cosines = np.array(weights) @ self.units[list(at)] / norm
        near = sorted(np.flatnonzero(cosines >= self.least - 1e-9).tolist(), key=lambda i: (-round(float(cosines[i]), 9), self.names[i]))
        return next(((float(cosines[i]), self.names[i]) for i in near if self.fits(i, found)), (0.0, ""))

    def scan(self, text: str, full: Matcher | None = None) -> tuple[str | None, float, str | None]:
        """Licence, cosine and origin: "file" if the whole text is a full licence or a notice, else "header" by its
        best line or run of lines."""
        low = text.lower()
        ask, ask_full = self.needed.search(low), full is not None and full.needed.search(low)
        if not ask and not ask_full:
            return None, 0.0, None
        found = terms(low)
        if ask_full:
            whole, name = full.best(terms(COPYRIGHT.sub("", low)))
            if whole >= FULL_LEAST and (name := told_apart(name, low)):
                return name, round(whole, 6), "file"
        if not ask:
            return None, 0.0, None
        whole, name = self.best(found)
        if whole >= FILE_LEAST:
            return name, round(whole, 6), "file"
        cosine, name = max((self.best(run) for run in self.runs(low)), key=lambda x: (round(x[0], 9), [-ord(c) for c in x[1]]), default=(0.0, ""))
        return (name, round(cosine, 6), "header") if cosine >= LINE_LEAST else (None, 0.0, None)

    def runs(self, low: str) -> list[Counter]:
        """Terms of each different run of lines that holds a line that a match can't do without."""
        lines = [(line, bool(self.needed.search(line))) for line in low.split("\n") if TERM.search(line)]
        longest = STRETCH * max(self.sizes)
        made: dict[tuple[str, ...], Counter] = {}
        counted = {}
        asked = np.r_[0, np.cumsum([a for _, a in lines])]
        for i in range(len(lines)):
            if asked[min(i + RUN, len(lines))] == asked[i]:
                continue
            total: Counter = Counter()
            for j in range(i, min(i + RUN, len(lines))):
                line = lines[j][0]
                if line not in counted:
                    counted[line] = terms(line)
                total = total + counted[line]
                if j > i and total.total() > longest:
                    break
                if asked[j + 1] > asked[i]:
                    made.setdefault(tuple(x for x, _ in lines[i : j + 1]), total)
        return list(made.values())


def told_apart(name: str, low: str) -> str | None:
    """The name of a full text after a look for what only a sibling says; Creative Commons texts bear theirs in the title."""
    if name.startswith("CC-BY"):
        title = CREATIVE.search(low)
        kinds = {"noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND"}
        return "-".join(["CC-BY", *(kinds[k] for k in title[1].split("-") if k), "4.0"]) if title else None
    return next((other for says, other in TOLD_APART.get(name, ()) if says.search(low)), name)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, full: dict[str, list[str]] | None = None) -> DataFrame:
    """Licence of each file: (doc_id, path, license, similarity, origin, licensed_by).

    files: doc_id, path (directories by /), text; other columns are not read. templates: notices; full: whole licence texts.
    origin: "file" and "header" from the text itself, over all its lines and runs of up to RUN lines; "inherited" from the
    licence files of the nearest directory above, the best match of them, ties by name; licensed_by is that directory.
    Licence files are those of origin "file", and those named LICENSE, COPYING and the like whose licence was found either
    way; a header in any other file is for that file alone. Without any, license is null. Null and empty texts have no licence of their own;
    a null path inherits nothing. Every repeated row gets its answer; an empty table gives an empty one.
    """
    templates = TEMPLATES if templates is None else templates
    full = full_texts() if full is None else full
    found = term_documents(files, sorted({t for texts in (*templates.values(), *full.values()) for x in texts for t in terms(x)}))
    matcher, whole = Matcher(templates, found), Matcher(full, found, FULL_LEAST, damped=True) if full else None

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, cosine, origin = zip(*(matcher.scan(t or "", whole) for t in batch.column(1).to_pylist()), strict=True)
        columns = [batch.column(0), batch.column(2), pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(origin, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "license", "similarity", "origin"])

    scanned = map_rows(files.select(F.col("doc_id").cast("long"), "text", "path"), make, "doc_id long, path string, license string, similarity double, origin string")
    rows = materialize(scanned.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    names = F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE)
    granted = rows.filter((F.expr("origin = 'file'") | names) & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("g"))
    granted = granted.select(F.col("dir").alias("above"), F.col("g.license").alias("given"), (-F.col("g.minus")).alias("cosine"))
    # each directory once, with all directories above it
    parts = F.split("dir", "/")
    up = rows.filter("license is null and dir is not null").select("dir").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.size(parts))))
    above = up.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
    nearest = above.join(granted, "above").groupBy("dir").agg(F.max_by(F.struct("above", "given", "cosine"), "n").alias("x"))
    own = rows.filter("license is not null or dir is null").withColumn("licensed_by", F.lit(None).cast("string"))
    rest = rows.filter("license is null and dir is not null").join(nearest, "dir", "left")
    got = rest.select(
        "doc_id", "path", F.col("x.given").alias("license"), F.coalesce("x.cosine", F.lit(0.0)).alias("similarity"),
        F.when(F.col("x").isNotNull(), "inherited").alias("origin"), F.col("x.above").alias("licensed_by"),
    )
    return own.select("doc_id", "path", "license", "similarity", "origin", "licensed_by").unionByName(got)
