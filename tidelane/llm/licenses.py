"""Operator 9: license scans by conditional compression.

A block of words around each cue of licensing, sized for the template, is compressed
alone and with the template as a Zstandard raw dictionary, all in lower case. Templates rank by how much of themselves the
block saves. The saving leaves none out: every template is confirmed by the exact
differences in wording, but those of which too few words are in the block at all. A
difference in a word that tells licenses apart, or a denial, decides against a template.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidelane.llm.common import table

# The wording of license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]
for _name, _kind, _versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    for _v in _versions:
        _of = f"GNU {_kind}General Public License"
        TEMPLATES += [
            (f"{_name}-{_v if '.' in _v else _v + '.0'}", f"This work is licensed under the {_of}, version {_v}."),
            (f"{_name}-{_v if '.' in _v else _v + '.0'}", f"Licensed under the {_of}, version {_v}."),
            (f"{_name}-{_v if '.' in _v else _v + '.0'}", f"This program is free software: you can redistribute it and/or modify it under the terms of the {_of} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."),
        ]
for _parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
    _long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[x] for x in _parts)
    for _v in ("3.0", "4.0"):
        TEMPLATES += [
            (f"CC-{'-'.join(_parts)}-{_v}", f"Licensed under CC {'-'.join(_parts)} {_v}."),
            (f"CC-{'-'.join(_parts)}-{_v}", f"This work is licensed under a Creative Commons {_long} {_v} International License."),
        ]
# Names under which licenses are spoken of. A short notice is "under" one, with or without "the".
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"],
}
for _name, _kind, _versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        NAMES[_id] = [f"GNU {_kind}General Public License{x}" for x in (f" v{_v}", f" v{_v}.0", f" {_v}", f" {_v}.0", f", version {_v}", f" version {_v}.0")] + [f"{_name}v{_v}", f"GNU {_name}v{_v}", f"GNU {_name} v{_v}", f"GNU {_name} version {_v}", f"{_name} v{_v}", _id, f"{_id}-only", f"{_id}-or-later"]
for _parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
    _long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[x] for x in _parts)
    for _v in ("3.0", "4.0"):
        _id = f"CC-{'-'.join(_parts)}-{_v}"
        NAMES[_id] = [_id, f"CC {'-'.join(_parts)} {_v}", *(f"{a}Creative Commons {_long} {_v}{x}" for a in ("", "a ") for x in ("", " License", " International License", " Unported License"))]
#: Templates made of the names by rule; `template` counts on through them.
SHORT_TEMPLATES: list[tuple[str, str]] = []
for _id, _said in NAMES.items():
    _ids = [_id] if _id.split("-")[0] not in ("GPL", "LGPL", "AGPL") else [_id, f"{_id}-only", f"{_id}-or-later", f"{_id}+"]
    SHORT_TEMPLATES += [(_id, f"SPDX-License-Identifier: {x}") for x in _ids] + [(_id, f"under {the}{x}") for x in _said for the in ("", "the ") if not x.startswith("a ") or not the]
ALL_TEMPLATES = TEMPLATES + SHORT_TEMPLATES
#: Words that tell one license from another; a number does so too.
TELLING = set("lesser library affero not no non never without mit apache bsd mozilla eclipse boost cc0 unencumbered gnu attribution sa nc nd sharealike noncommercial commercial noderivatives noderivs international zero proprietary confidential".split())
DENIALS = set("not no never neither nor cannot isn't aren't wasn't don't doesn't without unless".split())
#: Words before a notice in which a denial takes it back.
DENIED = 2
CUE = re.compile(r"licen[cs]e|copyright|all\W+rights\W+reserved|permission\W+(?:is|to)\b|redistribut|public\W+domain|endorse\W+or\W+promote|\bunder\s+(?:the\s+|a\s+)?(?:gnu|[al]?gpl|cc|cc0|mpl|epl|creative)(?:\b|v\d)", re.I)
#: The least part of a template's words, in order, in the block, and the most other words among them.
LEAST_WORDS, MOST_OTHER = 0.9, 0.15
#: Words before and after a cue that a block takes in, as a multiple of the template. With
#: MOST_OTHER, no notice is longer, so that the block holds it wherever in it the cue stands.
REACH = 1.25
#: Words to both sides of a cue among which a short template's rarest word is looked for.
SHORT = int(REACH * 10)
FOUND = "doc_id long, line_no long, license string, template int, saved double, covered double, differences array<string>"
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


@functools.cache
def _keys() -> tuple[dict[str, list[int]], list[int], dict[tuple[str, ...], str]]:
    """Templates by their rarest word, where all of their words must be there; the other templates; and titles by their words."""
    often = Counter(w for _, t in ALL_TEMPLATES for w in set(words(t)))
    by_word, others = {}, []
    for t, (_, said) in enumerate(ALL_TEMPLATES):
        own = words(said)
        if LEAST_WORDS * len(own) > len(own) - 1:
            by_word.setdefault(min(own, key=lambda w: (often[w], w)), []).append(t)
        else:
            others.append(t)
    titles = {}
    for name, spoken in NAMES.items():
        for x in spoken:
            own = tuple(words(x))
            if len(own) > 1:
                titles |= {own: name, ("the", *own): name}
    titles |= {("mit", "license", "mit"): "MIT", ("the", "mit", "license", "mit"): "MIT", ("isc", "license", "isc"): "ISC"}
    return by_word, others, titles


@functools.cache
def _packers() -> tuple:
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    lower = [t.lower().encode() for _, t in ALL_TEMPLATES]
    given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in lower]
    return plain, given, [len(plain.compress(t)) for t in lower], [words(t) for _, t in ALL_TEMPLATES]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _aligned(template: list[str], block: list[str]) -> tuple[float, float, list[str], int]:
    """wording(), and the place in the block of the first common word. Stray common words
    far before or after the notice are left out."""
    same = [x for x in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if x.size]
    best: tuple = (False, 0.0, 0.0), 0, -1
    for i in range(len(same)):
        had = other = 0
        for j in range(i, len(same)):
            other += same[j].b - same[j - 1].b - same[j - 1].size if j > i else 0
            had += same[j].size
            part, more = had / len(template), other / len(template)
            best = max(best, ((part >= LEAST_WORDS and more <= MOST_OTHER, part - more, part), i, j), key=lambda x: x[0])
    same = same[best[1] : best[2] + 1]
    if not same:
        return 0.0, 1.0, [], 0
    out = []
    for x, y in zip([None, *same], [*same, None]):
        left = template[x.a + x.size if x else 0 : y.a if y else len(template)]
        right = block[x.b + x.size : y.b] if x and y else []
        out += [f"-{w}" for w in left] + [f"+{w}" for w in right]
    other = sum(w[0] == "+" for w in out)
    return sum(x.size for x in same) / len(template), other / len(template), out, same[0].b


def wording(template: list[str], block: list[str]) -> tuple[float, float, list[str]]:
    """Part of the template's words in the block, other words among them, and all differences
    from the first to the last common word."""
    return _aligned(template, block)[:3]


def telling(template: list[str], differences: list[str]) -> bool:
    """Whether a difference makes it another license: a missing number, or a telling word too
    few or too many; a number too many only where the template has numbers. Parts of
    compounds (BY-NC) count."""
    numbered = any(any(c.isdigit() for c in w) for w in template)
    for d in differences:
        parts = [d[1:], *re.split(r"[-']", d[1:])]
        if any(w in TELLING for w in parts) or any(c.isdigit() for c in d) and (d[0] == "-" or numbered):
            return True
    return False


def accepted(template: list[str], block: list[str]) -> tuple[float, list[str], int] | None:
    """Covered part, differences and place of the template in the block, if its wording is there."""
    covered, other, differences, at = _aligned(template, block)
    if covered < LEAST_WORDS or other > MOST_OTHER or telling(template, differences):
        return None
    if DENIALS & set(block[max(0, at - DENIED) : at]) and not DENIALS & set(template[:1]):
        return None
    return covered, differences, at


def scan(text: str | None) -> Iterator[tuple]:
    """(line number, license, template, saved, covered, differences) of every line that begins a notice."""
    plain, given, own, texts = _packers()
    kinds = [set(t) for t in texts]
    by_word, long, titles = _keys()
    if not text or not CUE.search(text):
        return
    low = text.lower()
    found = list(WORD.finditer(low))
    starts, ends, said = [x.start() for x in found], [x.end() for x in found], [x[0] for x in found]
    feeds = [x.start() for x in re.finditer("\n", low)]
    best: dict[tuple, tuple] = {}
    for k in sorted({bisect_right(feeds, m.start()) for m in CUE.finditer(low)}):
        line = low[feeds[k - 1] + 1 if k else 0 : feeds[k] if k < len(feeds) else len(low)]
        name = titles.get(tuple(words(line))) if len(line) < 200 else None
        if name:
            best[k, name] = (k, name, next(t for t, (x, _) in enumerate(ALL_TEMPLATES) if x == name), 0.0, 1.0, [])
    for cue in sorted({max(0, bisect_right(starts, m.start()) - 1) for m in CUE.finditer(low)}):
        ranked = []
        near = said[max(0, cue - SHORT) : cue + SHORT + 1]
        for t in sorted({*long, *(t for w in set(near) for t in by_word.get(w, ()))}):
            template = texts[t]
            n = int(REACH * len(template))
            lo, hi = max(0, cue - n), min(len(said), cue + 1 + n)
            least = LEAST_WORDS * len(template)
            # No alignment finds more words than both have, first by kind, then by number.
            if sum(map(kinds[t].__contains__, said[lo:hi])) < least or (Counter(template) & Counter(said[lo:hi])).total() < least:
                continue
            raw = " ".join(low[starts[lo] : ends[hi - 1]].split()).encode()
            ranked.append(((len(plain.compress(raw)) - len(given[t].compress(raw))) / own[t], -t, lo, hi))
        for saved, t, lo, hi in sorted(ranked, reverse=True):
            if confirmed := accepted(texts[-t], said[lo:hi]):
                covered, differences, at = confirmed
                name, k = ALL_TEMPLATES[-t][0], bisect_right(feeds, starts[lo + at])
                was = best.get((k, name))
                if was is None or (covered * len(texts[-t]), saved) > (was[4] * len(texts[was[2]]), was[3]):
                    best[k, name] = (k, name, -t, saved, covered, differences)
    yield from best.values()


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string())]
    for batch in batches:
        rows = [(i.as_py(), *x) for i, t in zip(batch.column("doc_id"), batch.column("text")) for x in scan(t.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """FOUND's columns, one row for each line of docs at which a license's notice begins.

    docs has doc_id long and text string; other columns are ignored. Among several templates
    of one license the one with most words found is named, then the one that saves most. A line of a license's
    name alone is its title, and a notice too.
    Null and empty texts have no notices; a null doc_id stays null; repeated rows give
    repeated rows; no rows give no rows. Whole texts are searched, over line ends too: around
    every cue, each template's block reaches as far to both sides as that template could take.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scans, FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
