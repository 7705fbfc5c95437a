"""License scan: ordered signature rules over word sequences, gated by keywords, overlaps resolved by priority and containment.

A rule is a regular expression over the normalised words of a text (A-Z lower-cased, words one space apart). Its keywords are taken
from the expression: one of them is in each text that it matches. One pass of an automaton over a text finds all keywords that it
holds, and only their rules run. Of overlapping detections, one that lies within another of at least its priority is
suppressed. Base phrases are found by plain word matching and are always reported.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, arrow_rows, texts_of

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Licenses by label: names (regular expressions over words; the first is the full name), SPDX words, address words.
LICENSES = {
    "mit": ("mit license|expat license|mit x11 license", "mit", "opensource org licenses mit"),
    "mit-0": ("mit no attribution(?: license)?", "mit 0", "opensource org licenses mit 0"),
    "apache-2": ("apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    "apache-1.1": ("apache (?:software )?licen[cs]e (?:version )?v?1 1", "apache 1 1", "apache org licenses license 1 1"),
    "bsd-2-clause": ("bsd 2 clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-3-clause": ("bsd 3 clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-4-clause": ("bsd 4 clause(?: licen[cs]e)?|original bsd licen[cs]e", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    "0bsd": ("zero clause bsd(?: licen[cs]e)?|bsd zero clause licen[cs]e", "0bsd", "opensource org licenses 0bsd"),
    "isc": ("isc licen[cs]e", "isc", "opensource org licenses isc"),
    "gpl-2": ("gnu general public licen[cs]e (?:as published by the free software foundation )?(?:version |v ?)?2|gpl ?v?2", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    "gpl-3": ("gnu general public licen[cs]e (?:as published by the free software foundation )?(?:version |v ?)?3|gpl ?v?3", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    "gpl": ("gnu general public licen[cs]e|gnu gpl", "gpl", "gnu org licenses gpl"),
    "lgpl-2.1": ("gnu (?:lesser|library) general public licen[cs]e (?:version |v ?)?2(?: 1)?|lgpl ?v?2(?: 1)?", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    "lgpl-3": ("gnu lesser general public licen[cs]e (?:version |v ?)?3|lgpl ?v?3", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    "lgpl": ("gnu (?:lesser|library) general public licen[cs]e|gnu lgpl", "lgpl", "gnu org licenses lgpl"),
    "agpl-3": ("gnu affero general public licen[cs]e(?: (?:version |v ?)?3)?|agpl ?v?3", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl"),
    "mpl-1.1": ("mozilla public licen[cs]e (?:version |v ?)?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    "mpl-2": ("mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    "epl-1": ("eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    "epl-2": ("eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:v20|2 0)"),
    "eupl": ("european union public licen[cs]e", "eupl 1 [12]", "joinup ec europa eu (?:\\w+ )*eupl"),
    "cddl": ("common development and distribution licen[cs]e", "cddl 1 [01]", "opensource org licenses cddl"),
    "cpl-1": ("common public licen[cs]e", "cpl 1 0", "opensource org licenses cpl1"),
    "artistic": ("artistic licen[cs]e", "artistic [12] 0", "opensource org licenses artistic"),
    "boost": ("boost software licen[cs]e", "bsl 1 0", "boost org license 1 0"),
    "zlib": ("zlib licen[cs]e|zlib libpng licen[cs]e", "zlib", "opensource org licenses zlib"),
    "unlicense": ("the unlicense", "unlicense", "unlicense org"),
    "wtfpl": ("do what the fuck you want to public licen[cs]e", "wtfpl", "wtfpl net"),
    "postgresql": ("postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql"),
    "psf": ("python software foundation licen[cs]e|psf licen[cs]e", "psf 2 0", "docs python org (?:\\w+ )*license"),
    "ncsa": ("university of illinois ncsa open source licen[cs]e", "ncsa", "opensource org licenses ncsa"),
    "ofl": ("sil open font licen[cs]e|open font licen[cs]e", "ofl 1 1", "scripts sil org ofl"),
    "odbl": ("open database licen[cs]e", "odbl 1 0", "opendatacommons org licenses odbl"),
    "pddl": ("public domain dedication and licen[cs]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    "cc0": ("cc0(?: 1 0)?|creative commons zero", "cc0 1 0", "creativecommons org publicdomain zero"),
    "cc-by": ("cc by(?: [1-4](?: [05])?)?|creative commons attribution(?: [1-4](?: [05])?)?(?: international)?(?: licen[cs]e)?", "cc by [1-4] [05]", "creativecommons org licenses by(?! n| s)"),
    "cc-by-sa": ("cc by sa|creative commons attribution share ?alike", "cc by sa [1-4] [05]", "creativecommons org licenses by sa"),
    "cc-by-nd": ("cc by nd|creative commons attribution no ?deriv(?:s|atives)", "cc by nd [1-4] [05]", "creativecommons org licenses by nd"),
    "cc-by-nc": ("cc by nc|creative commons attribution non ?commercial", "cc by nc [1-4] [05]", "creativecommons org licenses by nc(?! n| s)"),
    "cc-by-nc-sa": ("cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": ("cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)", "cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd"),
    "gfdl": ("gnu free documentation licen[cs]e", "gfdl 1 [1-3]", "gnu org (?:licenses|copyleft) fdl"),
    "ms-pl": ("microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl"),
    "upl": ("universal permissive licen[cs]e", "upl 1 0", "opensource org licenses upl"),
    "blueoak": ("blue oak model licen[cs]e", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    "openssl": ("openssl licen[cs]e", "openssl", "openssl org source license"),
    "php": ("php licen[cs]e", "php 3 01?", "php net license"),
    "vim": ("vim licen[cs]e", "vim", "vimdoc sourceforge net htmldoc uganda"),
    "x11": ("x11 licen[cs]e|mit x consortium licen[cs]e", "x11", "xfree86 org legal licenses"),
    "beerware": ("beer ?ware licen[cs]e", "beerware", "people freebsd org phk"),
}
# Passages of license texts that tell the license without its name.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("mit", r"the above copyright notice and this permission notice (?:\w+ )*?shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    ("x11", r"except as contained in this notice the name of (?:the )?(?:\w+ ){1,6}shall not be used in advertising or otherwise to promote the sale", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties", 0.6),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 0.9),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", 0.95),
    ("bsd-3-clause", r"the names? of (?:the )?(?:\w+ ){1,8}may not be used to endorse or promote products derived from this software", 0.8),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.7),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.7),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.7),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0.9),
    ("apache-2", r"you may not use this file except in compliance with the license", 0.8),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.85),
    ("apache-2", r"see the license for the specific language governing permissions and limitations under the license", 0.8),
    ("apache-2", r"a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works", 0.85),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", 0.8),
    ("gpl", r"either version [23] of the license or at your option any later version", 0.7),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    ("gpl", r"you should have received a copy of the gnu general public license along with", 0.85),
    ("gpl", r"this program comes with absolutely no warranty for details type show w", 0.8),
    ("gpl-2", r"foundation inc (?:51 franklin st(?:reet)?|59 temple place|675 mass ave)", 0.6),
    ("gpl-2", r"activities other than copying distribution and modification are not covered by this license", 0.85),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", 0.95),
    ("gpl-3", r"you may convey verbatim copies of the program s source code as you receive it in any medium", 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", 0.85),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.9),
    ("lgpl-2.1", r"a program that contains no derivative of any portion of the library but is designed to work with the library", 0.85),
    ("lgpl-3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 0.95),
    ("agpl-3", r"you should have received a copy of the gnu affero general public license along with", 0.95),
    ("agpl-3", r"if you modify the program your modified version must prominently offer all users interacting with it remotely", 0.9),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license", 0.95),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", 0.9),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version", 0.9),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("epl", r"each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license", 0.7),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 0.95),
    ("cpl-1", r"this program and the accompanying materials are made available under the terms of the common public license", 0.95),
    ("eupl", r"licen[cs]ed under the eupl(?: version)? 1 [12]", 0.95),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 0.9),
    ("artistic", r"you may copy and distribute verbatim copies of the source form of the standard version of this package", 0.8),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.95),
    ("boost", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", 0.9),
    ("unlicense", r"free and unencumbered software released into the public domain", 0.95),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 0.95),
    ("wtfpl", r"you just do what the fuck you want to", 0.95),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 0.95),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.7),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.9),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.9),
    ("libpng", r"the png reference library is supplied as is", 0.9),
    ("ncsa", r"deal with the software without restriction including without limitation the rights to use copy", 0.5),
    ("openssl", r"this product includes software developed by the openssl project", 0.9),
    ("php", r"products derived from this software may not be called php", 0.9),
    ("psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license", 0.95),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special", 0.6),
    ("vim", r"vim is charityware", 0.9),
    ("json", r"the software shall be used for good not evil", 0.95),
    ("ofl", r"the fonts and derivatives however cannot be released under any other type of license", 0.9),
    ("ofl", r"this font software is licensed under the sil open font license", 0.95),
    ("ms-pl", r"if you distribute any portion of the software in source code form you may do so only under this license by including a complete copy", 0.8),
    ("sspl", r"server side public license", 0.9),
    ("busl", r"business source license", 0.85),
    ("elastic", r"elastic license(?: 2 0)?", 0.85),
    ("commons-clause", r"the license does not grant to you the right to sell the software", 0.9),
    ("polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter|free trial|internal use) license", 0.9),
    ("openrail", r"(?:creativeml|bigscience|bigcode) open ?rail", 0.9),
    ("llama", r"llama (?:2|3|3 1|3 2|3 3)? ?community license", 0.9),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("cc0", r"to the extent possible under law (?:\w+ ){1,8}has waived all copyright and related or neighboring rights", 0.95),
    ("cc-by", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic) license", 0.95),
    ("cc-by", r"some rights reserved", 0.4),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", 0.9),
    ("odbl", r"this database is made available under the open database license", 0.95),
    ("cdla", r"community data license agreement (?:permissive|sharing)", 0.95),
    ("ogl-uk", r"contains public sector information licen[cs]ed under the open government licen[cs]e", 0.95),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.6),
    ("public-domain", r"this (?:work|file|software|code|text|image) is in the public domain", 0.7),
    ("public-domain", r"no known copyright restrictions", 0.6),
    ("proprietary", r"all rights reserved", 0.3),
    ("proprietary", r"proprietary and confidential", 0.7),
    ("proprietary", r"confidential and proprietary", 0.7),
    ("proprietary", r"unauthori[sz]ed copying of this file", 0.7),
    ("proprietary", r"unauthori[sz]ed (?:reproduction|distribution|use) (?:\w+ ){0,6}(?:is|are) (?:strictly )?prohibited", 0.6),
    ("proprietary", r"may not be (?:copied|reproduced|redistributed) without (?:the )?(?:prior |express |written )+(?:permission|consent)", 0.6),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", 0.6),
    ("proprietary", r"for internal use only", 0.4),
    ("proprietary", r"trade secrets? of (?:\w+ ){1,5}(?:inc|corp|corporation|llc|ltd|gmbh)", 0.6),
    ("proprietary", r"by installing or using (?:the|this) software you agree to be bound by", 0.6),
)
#: What stands around a name, the detection's confidence and priority: the more a form says, the higher.
FORMS = (
    (r"(?:licen[cs]ed|released|distributed|available|provided|published) (?:under|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{names})(?: licen[cs]e)?", 0.95, 4),
    (r"(?:under|subject to) (?:the )?(?:terms of )?(?:the )?(?:{names})", 0.85, 3),
    (r"(?:{names})", 0.6, 1),
)


class Rule:
    __slots__ = ("label", "source", "pattern", "score", "priority", "gate")

    def __init__(self, label: str, source: str, score: float, priority: int):
        self.label, self.source, self.score, self.priority, self.gate = label, source, score, priority, gate(source)
        self.pattern = re.compile(rf"(?<= )(?:{source})(?= )".encode())


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that no bracket holds."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[at:k])
            at = k + 1
    return [*out, pattern[at:]]


def gate(pattern: str) -> tuple[str, ...]:
    """Strings one of which is in each text that a pattern matches; ('',) if there is none.

    Patterns are letters, digits and spaces, sets, optional single characters, and groups, that may repeat or be optional. The
    candidates of a sequence are its stretches of plain characters and its groups' own gates; that with the longest shortest
    string is taken.
    """
    parts = _alternatives(pattern)
    if len(parts) > 1:
        return tuple(dict.fromkeys(g for p in parts for g in gate(p)))
    best: tuple[str, ...] = ("",)
    plain, k = "", 0

    def offer(candidate: tuple[str, ...]) -> None:
        nonlocal best
        if min(map(len, candidate)) > min(map(len, best)):
            best = candidate

    while k < len(pattern):
        c = pattern[k]
        if c == "(":
            end, depth = k + 1, 1
            while depth:
                depth += (pattern[end] == "(") - (pattern[end] == ")")
                end += 1
            rest = re.match(r"[*?+]\??|\{\d+(?:,\d*)?\}\??", pattern[end:])
            times = rest[0] if rest else ""
            offer((plain,))
            plain = ""
            if pattern.startswith("(?:", k) and not times.startswith(("*", "?", "{0")):
                offer(gate(pattern[k + 3 : end - 1]))
            k = end + len(times)
            continue
        size = pattern.index("]", k) + 1 - k if c == "[" else 2 if c == "\\" else 1
        rest = re.match(r"[*?+]\??|\{\d+(?:,\d*)?\}\??", pattern[k + size :])
        if size == 1 and c != "." and not rest:
            plain += c
        else:
            offer((plain,))
            plain = ""
        k += size + (len(rest[0]) if rest else 0)
    offer((plain,))
    return best


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: SPDX tags, addresses, named licenses in each form, passages."""
    out = []
    for label, (names, spdx, address) in LICENSES.items():
        out.append(Rule(label, rf"spdx license identifier (?:{spdx})", 1.0, 6))
        out.append(Rule(label, rf"(?:{address})", 0.9, 5))
        out += [Rule(label, form.replace("{names}", names), score, priority) for form, score, priority in FORMS]
    out += [Rule(label, text, score, 2) for label, text, score in PASSAGES]
    return tuple(out)


@lru_cache(maxsize=1)
def _automaton():
    """The automaton of all gates, each with the places of its rules; and the rules without a gate, which always run."""
    import ahocorasick

    by_gate: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for g in rule.gate:
            by_gate.setdefault(g, []).append(k)
    always = by_gate.pop("", [])
    automaton = ahocorasick.Automaton()
    for g, places in by_gate.items():
        automaton.add_word(g, tuple(places))
    automaton.make_automaton()
    return automaton, always


def gated(words: bytes) -> list[Rule]:
    """The rules of whose keywords a text, ' word word … ', holds one, in their order."""
    automaton, always = _automaton()
    held = {places for _, places in automaton.iter(words.decode("latin-1"))}
    every = rules()
    return [every[k] for k in sorted({*always, *(k for places in held for k in places)})]


def detect(words: bytes) -> list[tuple[int, int, str, float, int]]:
    """(start, end, label, score, priority) in bytes of ' word word … ', of what the rules find and none contains."""
    found = [(m.start(), m.end(), rule.label, rule.score, rule.priority) for rule in gated(words) for m in rule.pattern.finditer(words)]
    found.sort(key=lambda d: (d[0], -d[1], -d[4]))
    kept: list[tuple] = []
    reach: list[tuple] = []  # detections that may still contain a later one: ends fall as priorities rise
    for d in found:
        reach = [k for k in reach if k[1] > d[0]]
        if any(k[1] >= d[1] and (k[4] >= d[4] or k[1] - k[0] > d[1] - d[0] and k[2] != d[2] and k[4] + 2 >= d[4]) for k in reach):
            continue
        kept.append(d)
        reach.append(d)
    return kept


_BASE = tuple((f" {phrase} ".encode(), label) for phrase, label in BASE)
_DETECTION = pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])


def scan(text: str) -> tuple[int, list[tuple[int, int, str, float, bool]]]:
    """Word count and detections (first word, end word, label, score, base) of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    found = []  # (start and end in bytes, label, score, base)
    for phrase, label in _BASE:
        at = line.find(phrase)
        while at >= 0:
            found.append((at + 1, at + len(phrase) - 1, label, 0.9, True))
            at = line.find(phrase, at + 1)
    found += [(a, b, label, score, False) for a, b, label, score, _ in detect(line)]
    if not found:
        return len(words), []
    # words before each place, all in one pass
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(gaps, [f[0] for f in found]) - 1
    last = np.searchsorted(gaps, [f[1] for f in found])
    return len(words), sorted((a, b, *f[2:]) for a, b, f in zip(first.tolist(), last.tolist(), found))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections in each row's whole text: doc_id, n_words, detections (start_word, end_word, label, score, base).

    A null or empty text has no words and no detections. Rows that repeat an id each give a row; an empty table gives none;
    other columns are not read. Each row is scanned by itself, so nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("detections", pa.list_(_DETECTION))])
    names = [f.name for f in _DETECTION]

    def rows_of(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            n, found = scan(text)
            yield doc_id, n, [dict(zip(names, d)) for d in found]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: arrow_rows(batches, rows_of, schema), "doc_id long, n_words long, detections array<struct<start_word:long,end_word:long,label:string,score:double,base:boolean>>")


def license_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's detections."""
    base = F.filter("detections", lambda d: d.base)
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d.label))), ",")
    starts = F.transform(base, lambda d: d.start_word)
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d.score)), F.lit(0.0))
    return scan_licenses(docs).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), score.alias("score"))
