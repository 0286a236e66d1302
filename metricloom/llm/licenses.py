"""License scans by patience alignment (operator 4).

A template and a stretch of a text are aligned on the words that occur once in both: of these anchors
the longest increasing sequence stays, and the gaps between anchors are aligned in the same way, after
their common beginnings and ends. A gap without such words is aligned by its longest common
subsequence. Coverage is the share of the template's words that are aligned.

Templates are one-line notices and whole licenses. A text is scanned whole. A stretch begins at a word that is rare
for a license (a word of the template that is not one of ``COMMON``), is as long as the template and a half, and is
aligned only if it has enough of the template's words, each as often as the template has it: fewer can't be
covered. An accepted match ends the stretch, and the scan goes on behind it; after a stretch that is refused, the
next one begins an eighth of the template further. Of matches that overlap, the one with more aligned words stays
(then with more coverage, then the first name).

Scale: a text needs nothing but the templates, which are a parameter of fixed size; there is no
shuffle, and no row depends on another. Words enter and leave the stretch once, and stretches of a length begin an
eighth of it apart at least, so work is linear in the text, also in a very long or repetitive one.

Rows: null and empty texts, and texts without a license, have no match. Repeated rows and ids and null
ids are rows like others; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, ddl, documents, slices

_WORD = re.compile(r"[^\W_]+")
MATCHES = "array<struct<license:string,start:bigint,end:bigint,coverage:double>>"
COMMON = frozenset("the of and to in is it that this for are with as be by an a or on at not from use any all under you may see".split())

#: Notices of public licenses, as authors put them into files.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    **{f"CC-{kind.replace(' ', '-')}-4.0": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY SA", "BY ND", "BY NC", "BY NC SA", "BY NC ND")},
}


TEXTS = Path(__file__).parent / "license_texts"  # whole public licenses, one a file


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """The notices and the whole licenses; read by the driver."""
    return TEMPLATES | {f"{f.stem}-text": f.read_text(encoding="utf-8", errors="replace") for f in sorted(TEXTS.glob("*.txt"))}


def rising(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence: patience piles with pointers to the pile before."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {b[y]: y for y in range(k, m) if in_b[b[y]] == 1}
        pairs = [(x, where[a[x]]) for x in range(i, j) if in_a[a[x]] == 1 and a[x] in where]
        if not pairs:
            out += _common(a, b, i, j, k, m)
            continue
        anchors = [pairs[p] for p in rising([y for _, y in pairs])]
        out += anchors
        bounds = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(bounds, bounds[1:], strict=False)]
    return sorted(out)


def _common(a: list[str], b: list[str], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap. A row of its table is one whole number: bit y is 0 where the row's
    length rises at the word y of ``b``."""
    where: dict[str, int] = {}
    for y in range(k, m):
        where[b[y]] = where.get(b[y], 0) | 1 << (y - k)
    full = (1 << (m - k)) - 1
    rows = [full]
    for x in range(i, j):
        row = rows[-1]
        same = row & where.get(a[x], 0)
        rows.append((row + same | row - same) & full)
    out, x, y = [], j - i, m - k
    while x and y:
        if rows[x] >> (y - 1) & 1:
            y -= 1
        elif not rows[x - 1] >> (y - 1) & 1:
            x -= 1
        else:
            x, y = x - 1, y - 1
            out.append((i + x, k + y))
    return out[::-1]


class Scanner:
    """Templates ready for scans."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.words = {name: _WORD.findall(text.lower()) for name, text in templates.items() if _WORD.search(text.lower())}
        self.counts = {name: Counter(w) for name, w in self.words.items()}
        self.need = {name: max(1, math.ceil(least * len(w) - 1e-9)) for name, w in self.words.items()}
        self.of: dict[str, list[tuple[str, int]]] = {}
        for name, counts in self.counts.items():
            for x, n in counts.items():
                self.of.setdefault(x, []).append((name, n))
        self.known = frozenset(self.of)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) in code points of the text, by start."""
        if not text:
            return []
        low = text.lower()
        credit: dict[str, int] = {}
        for w in self.known.intersection(_WORD.findall(low)):
            for name, n in self.of[w]:
                credit[name] = credit.get(name, 0) + n
        names = [name for name, n in credit.items() if n >= self.need[name]]
        if not names:
            return []
        if len(low) != len(text):  # letters that grow in lower case
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found = list(_WORD.finditer(low))
        words = [m.group() for m in found]
        matches = [x for name in sorted(names) for x in self._matches(name, words)]
        kept: list[tuple[int, float, str, int, int]] = []
        taken: list[tuple[int, int]] = []
        for x in sorted(matches, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            k = bisect_left(taken, (x[3], x[4]))
            if (k == len(taken) or taken[k][0] > x[4]) and (not k or taken[k - 1][1] < x[3]):
                taken.insert(k, (x[3], x[4]))
                kept.append(x)
        return [(name, found[first].start(), found[last].end(), coverage) for _, coverage, name, first, last in sorted(kept, key=lambda x: x[3])]

    def _matches(self, name: str, words: list[str]) -> Iterator[tuple[int, float, str, int, int]]:
        """(aligned words, coverage, name, first word, last word) of the matches of one template."""
        template, counts, need = self.words[name], self.counts[name], self.need[name]
        ahead, behind = len(template) + len(template) // 4 + 2, len(template) // 4 + 2
        left = right = done = wait = have = 0  # words from left to right are counted
        inside: dict[str, int] = {}
        for at, w in enumerate(words):
            if w not in counts or w in COMMON or at < done or at < wait:
                continue
            low, high = max(done, at - behind), min(len(words), at + ahead)
            for x in words[right:high]:
                if x in counts:
                    inside[x] = inside.get(x, 0) + 1
                    have += inside[x] <= counts[x]
            right = max(right, high)
            for x in words[left:low]:
                if x in counts:
                    have -= inside[x] <= counts[x]
                    inside[x] -= 1
            left = max(left, low)
            if have < need:
                continue
            pairs = patience(template, words[low:high])
            if len(pairs) >= need:
                done = low + pairs[-1][1] + 1
                yield len(pairs), len(pairs) / len(template), name, low + pairs[0][1], done - 1
            else:
                wait = at + max(1, len(template) // 8)


def find_licenses(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id and ``matches`` (license, start, end, coverage), by start; a
    match covers ``least`` of its template."""
    templates = df.sparkSession.sparkContext.broadcast(all_templates() if templates is None else templates)
    schema = T.StructType([df.schema[id_col], *ddl(f"matches {MATCHES}")])
    out, names = arrow_schema(schema), ("license", "start", "end", "coverage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates.value, least).scan
        for batch in slices(batches):
            found = [[dict(zip(names, x, strict=True)) for x in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out.field(1).type)], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses that it names."""
    found = find_licenses(documents(spark, sf_dir))
    spans = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["license"]))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"), best.alias("coverage"), spans.alias("spans"))
