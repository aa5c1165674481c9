"""Licence scans with ordered signature rules.

Rules are regular expressions over the folded words of a text (A-Z lower-cased, joined by one space). They are written as families: for each
licence the ways its name, its identifier, its notice and its address appear, for each version that exists. Every rule names keywords that
any match must contain; an Aho-Corasick automaton finds the keywords of all rules in one pass, and only rules whose keyword occurs are run,
around its occurrences. Detections are then resolved in order: an interval inside one of higher priority, or inside a longer one of equal priority, is suppressed.
Priorities: 4 identifier tag, 3 notice, 2 versioned name, 1 plain name.

Base labels are places where the base phrases stand word by word. They are counted apart and never suppressed.

The score is the chance that the text carries a licence statement: 1 - product of (1 - w) over the distinct labels, w by the highest
priority of each (0.99, 0.95, 0.8, 0.5; 0.6 for a base phrase alone).

Time grows with the text and n log n of its detections, so very long texts are scanned whole; of equal detections one is kept. Null and empty texts have no words, no places and score 0. Repeated rows are scanned each for itself. An empty table gives an empty result.
Other columns pass through under their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,rule:string,first:bigint,last:bigint>>"
_WEIGHT = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.5, 0: 0.6}

# Names and versions of licences (fixed values). label: (names in folded words, versions, identifier stem); versions as folded words.
FAMILIES = {
    "gpl": (("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "1 0", "2 0", "3 0"), "gpl"),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2 1", "3", "2 0", "3 0"), "lgpl"),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3", "1 0", "3 0"), "agpl"),
    "gfdl": (("gnu free documentation license", "gnu fdl", "gfdl"), ("1 1", "1 2", "1 3"), "gfdl"),
    "apache": (("apache software license", "apache license", "apache public license"), ("1 0", "1 1", "2", "2 0"), "apache"),
    "mit": (("mit license", "mit expat license", "expat license", "mit x11 license", "x11 license"), (), "mit"),
    "bsd": (("bsd license", "berkeley software distribution license", "bsd style license"), (), "bsd"),
    "isc": (("isc license", "internet systems consortium license"), (), "isc"),
    "mpl": (("mozilla public license", "mpl"), ("1 0", "1 1", "2", "2 0"), "mpl"),
    "epl": (("eclipse public license", "epl"), ("1", "1 0", "2", "2 0"), "epl"),
    "edl": (("eclipse distribution license",), ("1", "1 0"), "edl"),
    "cddl": (("common development and distribution license", "cddl"), ("1 0", "1 1"), "cddl"),
    "cpl": (("common public license",), ("0 5", "1 0"), "cpl"),
    "eupl": (("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2"), "eupl"),
    "artistic": (("artistic license", "perl artistic license"), ("1", "1 0", "2", "2 0"), "artistic"),
    "boost": (("boost software license",), ("1", "1 0"), "bsl"),
    "zlib": (("zlib license", "zlib libpng license"), (), "zlib"),
    "unlicense": (("the unlicense",), (), "unlicense"),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl"), ("2",), "wtfpl"),
    "ofl": (("sil open font license", "open font license"), ("1 0", "1 1"), "ofl"),
    "psf": (("python software foundation license", "psf license"), ("2",), "psf"),
    "php": (("php license",), ("3", "3 0", "3 01"), "php"),
    "ruby": (("ruby license",), (), "ruby"),
    "w3c": (("w3c software notice and license", "w3c license"), (), "w3c"),
    "openssl": (("openssl license",), (), "openssl"),
    "ms-pl": (("microsoft public license",), (), "ms pl"),
    "ms-rl": (("microsoft reciprocal license",), (), "ms rl"),
    "osl": (("open software license",), ("1 0", "2 0", "2 1", "3 0"), "osl"),
    "afl": (("academic free license",), ("1 2", "2 0", "2 1", "3 0"), "afl"),
    "upl": (("universal permissive license",), ("1 0",), "upl"),
    "odbl": (("open database license", "odbl"), ("1 0",), "odbl"),
    "odc-by": (("open data commons attribution license",), ("1 0",), "odc by"),
    "pddl": (("public domain dedication and license",), ("1 0",), "pddl"),
    "cc0": (("creative commons zero", "cc0"), ("1 0",), "cc0"),
    "cc-by": (("creative commons attribution", "cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by"),
    "cc-by-sa": (("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by sa"),
    "cc-by-nd": (("creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nd"),
    "cc-by-nc": (("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc"),
    "cc-by-nc-sa": (("creative commons attribution noncommercial sharealike", "cc by nc sa"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc sa"),
    "cc-by-nc-nd": (("creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "cc by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc nd"),
}
# Notices and addresses (fixed values): label, keyword, pattern over folded words.
NOTICES = (
    ("gpl", "licenses gpl", r"gnu org licenses (?:old licenses )?gpl"), ("lgpl", "licenses lgpl", r"gnu org licenses (?:old licenses )?lgpl"),
    ("agpl", "licenses agpl", r"gnu org licenses agpl"), ("gfdl", "licenses fdl", r"gnu org licenses fdl"),
    ("gpl", "free software you can redistribute", r"this (?:program|file|library) is free software you can redistribute it and or modify it"),
    ("apache", "apache org licenses", r"apache org licenses license 2 0"), ("mit", "opensource org licenses mit", r"opensource org licenses mit"),
    ("mit", "permission is hereby granted free", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("zlib", "in no event will the authors", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "boost org license", r"(?:www )?boost org license 1 0"), ("mpl", "mozilla org mpl", r"mozilla org mpl (?:1 1|2 0)"),
    ("mpl", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse org legal epl", r"eclipse org legal epl"), ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"unlicense org"), ("cc0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("ofl", "scripts sil org ofl", r"scripts sil org ofl"), ("wtfpl", "wtfpl net", r"wtfpl net"), ("public-domain", "dedicated to the public domain", r"dedicated to the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"), ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software)"),
)

# Clauses of licence bodies, header variants, exceptions and dual licensing, written one by one (fixed values): label, keyword, pattern over folded words.
CLAUSES = (
    ("gpl", "either version", r"general public license as published by the free software foundation either version (?:1|2|3) of the license"),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "freedom to share and change", r"(?:intended to guarantee|designed to take away) your freedom to share and change"),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "distributed in the hope", r"(?:is|are) distributed in the hope that (?:it|they) will be useful but without any warranty"),
    ("gpl", "terms and conditions for copying", r"terms and conditions for copying distribution and modification"),
    ("lgpl", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", "work that uses the library", r"work that uses the library"),
    ("agpl", "you should have received a copy", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("gfdl", "invariant sections", r"with (?:no|the) invariant sections (?:no front cover texts|being list their titles)"),
    ("gpl-classpath-exception", "independent modules", r"link this library with independent modules to produce an executable"),
    ("gpl-autoconf-exception", "configuration script", r"configuration script generated by autoconf"),
    ("gpl-gcc-exception", "gcc runtime library exception", r"gcc runtime library exception(?: version)? 3 1"),
    ("gpl-bison-exception", "bison parser", r"as a special exception you may create a larger work that contains part or all of the bison parser"),
    ("gpl-font-exception", "which uses this font", r"if you create a document which uses this font"),
    ("gpl-openssl-exception", "with the openssl library", r"permission to link the code of (?:portions of )?this program with the openssl library"),
    ("llvm-exception", "llvm exceptions", r"apache license v2 0 with llvm exceptions"),
    ("apache", "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache", "software distributed under the license", r"software distributed under the license is distributed on an as is basis"),
    ("apache", "contributor hereby grants to you", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache", "contributor license agreements", r"under one or more contributor license agreements"),
    ("apache-1", "apache software foundation http", r"this product includes software developed by the apache software foundation http"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction including", r"to deal in the software without restriction including without limitation the rights"),
    ("mit-no-attribution", "sell copies of the software and to permit", r"publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "shall not be used in advertising", r"the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale"),
    ("hpnd", "that the above copyright notice appear", r"provided that the above copyright notice appear in all copies"),
    ("bsd", "redistributions of source code must", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "substitute goods or services", r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-original", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("isc", "use or performance of this software", r"arising out of or in connection with the use or performance of this software"),
    ("zlib", "altered source versions must", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not", r"the origin of this software must not be misrepresented"),
    ("mpl", "was not distributed with this file", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 (?:0|1)"),
    ("mpl-no-copyleft", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "subject to the terms of the common", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("boost", "machine executable object code generated", r"machine executable object code generated by a source language processor"),
    ("artistic", "semblance of artistic control", r"maintains some semblance of artistic control over the development of the package"),
    ("unlicense", "free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived all copyright and related", r"has waived all copyright and related or neighboring rights"),
    ("ofl", "reserved font name", r"(?:with|may use the) reserved font name"),
    ("wtfpl", "you just do", r"you just do what the fuck you want to"),
    ("json", "for good not evil", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("commons-clause", "right to sell the software", r"the license does not include and the license does not grant to you the right to sell the software"),
    ("sspl", "server side public license", r"server side public license(?: version 1)?"),
    ("busl", "business source license", r"business source license(?: 1 1)?"),
    ("elastic", "as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("dual-licence", "dual licensed under", r"(?:is|are) dual licensed under"),
    ("dual-licence", "at your option", r"(?:license|licence|mit|apache 2 0|gpl|lgpl|bsd) at your option"),
    ("dual-licence", "alternatively the contents of this file", r"alternatively the contents of this file may be used under the terms of"),
    ("proprietary", "trade secret", r"(?:contains|protected by|protected as) (?:a )?trade secret(?: and copyright)? (?:law|information)"),
    ("proprietary", "no part of this", r"no part of this (?:publication|work|document|software) may be reproduced"),
)


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of all rules; a keyword is a run of whole words that each match contains."""
    out = []
    for label, (names, versions, stem) in FAMILIES.items():
        for name in names:
            out.append((1, label, name, name))
            for verb in ("licensed under", "released under", "distributed under", "available under", "published under", "made available under"):
                out.append((3, label, f"{verb}", rf"{verb} (?:the terms of )?(?:the |an? )?{name}(?: license)?(?: (?:version |v)?\d(?: \d)?)?"))
            for version in versions:
                out.append((2, label, name, rf"{name}(?: license)?(?: international| unported)? (?:version |v )?v?{version}"))
            out.append((3, label, f"under the terms of the {name}", f"under the terms of the {name}"))
        for tail in (*versions, ""):
            ident = f"{stem} {tail}".strip()
            out.append((4, label, "spdx license identifier", rf"spdx license identifier {ident}(?: only| or later)?"))
        if stem.startswith("cc "):
            kind = stem[3:]
            for version in versions:
                out.append((4, label, f"creativecommons org licenses {kind}", rf"creativecommons org licenses {kind} {version}"))
    out += [(3, label, keyword, pattern) for label, keyword, pattern in NOTICES + CLAUSES]
    return out


def uncontained(found: Iterable[tuple]) -> list[tuple]:
    """Detections (begin, end, priority, label, rule) that no other holds which ranks before them: by priority, then length, then place, label and rule.

    One sweep by begin, longest first: of all that began so far, only the furthest end of each priority counts.
    """
    reach = [0] * (len(_WEIGHT) + 1)
    kept = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3], x[4])):
        if max(reach[x[2]:]) < x[1]:
            kept.append(x)
        reach[x[2]] = max(reach[x[2]], x[1])
    return sorted(kept, key=lambda x: (x[0], x[3], -x[2], x[0] - x[1], x[4]))


class Scanner:
    def __init__(self):
        self.rules = [(priority, label, re.compile(rf"(?<=\s){pattern}(?=\s)"), pattern) for priority, label, _, pattern in rules()]
        gate: dict[str, list[int]] = {}
        for i, (_, _, keyword, _) in enumerate(rules()):
            gate.setdefault(keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, own in gate.items():
            self.automaton.add_word(f" {keyword} ", ("gate", tuple(own), len(keyword) + 2))
        for phrase, label in BASE.items():
            known = self.automaton.get(f" {phrase} ", ("gate", (), len(phrase) + 2))
            self.automaton.add_word(f" {phrase} ", ("base", known[1], len(phrase) + 2, label))
        self.automaton.make_automaton()
        table = bytearray(range(256))
        for b in range(128):
            table[b] = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32
        self.table = bytes(table)

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(self.table).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        places, todo = [], {}
        for end, hit in self.automaton.iter(line):
            start = end + 1 - hit[2]
            for i in hit[1]:
                todo.setdefault(i, []).append(start)
            if hit[0] == "base":
                places.append((start, hit[3]))
        if not todo and not places:
            return len(words), 0, None, None, "", "", 0.0, []
        found = set()
        for i, starts in todo.items():
            priority, label, pattern, name = self.rules[i]
            reached = -1
            for start in starts:  # a match that holds the keyword begins at most 240 letters before it
                low = max(0, start - 240, reached)
                for m in pattern.finditer(line, low, min(len(line), start + 400)):
                    if m.start() <= start + 1:
                        found.add((m.start(), m.end(), priority, label, name))
                        reached = max(reached, m.end() - 1)
        kept = uncontained(found)
        spots = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)  # blanks up to each letter: word k begins after k + 1 blanks
        word = lambda at: int(spots[at]) - 1
        starts = sorted(int(spots[s]) - 1 for s, _ in places)
        base = sorted({label for _, label in places})
        best = {label: 0 for label in base}
        for _, _, priority, label, _ in kept:
            best[label] = max(best.get(label, 0), priority)
        left = 1.0
        for label in sorted(best):
            left *= 1 - _WEIGHT[best[label]]
        seen = [{"label": x[3], "rule": x[4], "first": word(x[0]), "last": word(x[1] - 1)} for x in kept]
        return len(words), len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(sorted(best)), 1 - left, seen


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then the RESULT columns; places and detections count words from 0."""
    names = docs.columns
    at = names.index(text)
    rest = [i for i in range(len(names)) if i != at]
    source = docs.toDF(*(f"x{i}" for i in range(len(names)))).select(*(F.col(f"x{i}").alias(f"c{k}") for k, i in enumerate(rest)), F.col(f"x{at}").cast("string").alias("text"))
    added = StructType.fromDDL(RESULT).fields
    schema = StructType([*source.schema.fields[:-1], *added])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                rows = [scanner.scan(t) for t in part["text"].to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema).toDF(*(names[i] for i in rest), *(f.name for f in added))
