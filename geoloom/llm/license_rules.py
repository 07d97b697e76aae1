"""License scans by ordered signature rules.

Two layers. The base layer finds a few fixed phrases word by word, comparing the bytes
of the words of all documents at once. The rule layer has hundreds of regular expressions,
made from families, versions and wordings, each with a label, a priority
and a keyword. Keywords are searched first, over whole slices of text; only rules
whose keyword a text holds are run on it. Where detections overlap, one that
lies inside another is suppressed when it has no higher priority, and of two that
cross the one of higher priority (then the longer, then the earlier rule) stays.

Words are those of the base contract: digits, a-z after lower-casing A-Z, and all that
is not ASCII.

Defined cases: null and empty texts have no words and no detections; repeated rows
give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
GAP = rb"[^0-9a-z\x80-\xff]+"
EDGE_BEFORE, EDGE_AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is run where ``keyword`` occurs, which every match must hold (one word of a phrase, as anything may stand between words); higher ``priority`` wins overlaps; ``weight`` is the confidence."""

    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    weight: float


def _phrase(text: str) -> bytes:
    """Words of a phrase with anything that is no word between them; ``?`` after a word makes it optional."""
    out = b""
    for word in text.split():
        if word.endswith("?"):
            out += b"(?:" + re.escape(word[:-1]).encode() + GAP + b")?"
        else:
            out += re.escape(word).encode() + GAP
    return out[: -len(GAP)] if out.endswith(GAP) else out


def _version(version: str) -> bytes:
    major, _, minor = version.partition(".")
    return major.encode() + (rb"[.\s]" + minor.encode() if minor not in ("", "0") else rb"(?:\.0)?(?![.]\d)")


# License families by name, short name, public address, and versions.
GNU = (("gpl", "gnu general public license", "gpl", "gnu.org/licenses", ("1", "2", "3")), ("lgpl", "gnu lesser general public license", "lgpl", "gnu.org/licenses", ("2", "2.1", "3")), ("lgpl", "gnu library general public license", "lgpl", "gnu.org/licenses", ("2",)), ("agpl", "gnu affero general public license", "agpl", "gnu.org/licenses", ("1", "3")), ("gfdl", "gnu free documentation license", "gfdl", "gnu.org/licenses", ("1.1", "1.2", "1.3")))
VERSIONED = (
    ("apache", "apache license", "apache", "apache.org/licenses/license-", ("1.0", "1.1", "2.0")), ("apache", "apache software license", "asl", "apache.org/licenses/license-", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public license", "mpl", "mozilla.org/mpl/", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public license", "epl", "eclipse.org/legal/epl-v", ("1.0", "2.0")), ("eupl", "european union public licence", "eupl", "eupl.eu/", ("1.0", "1.1", "1.2")), ("cddl", "common development and distribution license", "cddl", "opensource.org/licenses/cddl-", ("1.0", "1.1")),
    ("cpl", "common public license", "cpl", "opensource.org/licenses/cpl", ("1.0",)), ("osl", "open software license", "osl", "opensource.org/licenses/osl-", ("1.0", "1.1", "2.0", "2.1", "3.0")), ("afl", "academic free license", "afl", "opensource.org/licenses/afl-", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic license", "artistic", "opensource.org/licenses/artistic-", ("1.0", "2.0")), ("zpl", "zope public license", "zpl", "opensource.org/licenses/zpl-", ("1.1", "2.0", "2.1")), ("ofl", "sil open font license", "ofl", "scripts.sil.org/ofl", ("1.0", "1.1")),
    ("bsl", "boost software license", "bsl", "boost.org/license_", ("1.0",)), ("cecill", "cecill license", "cecill", "cecill.info/licences/licence_cecill_v", ("1.0", "1.1", "2.0", "2.1")), ("odbl", "open database license", "odbl", "opendatacommons.org/licenses/odbl/", ("1.0",)),
    ("lppl", "latex project public license", "lppl", "latex-project.org/lppl/lppl-", ("1.0", "1.1", "1.2", "1.3")), ("php", "php license", "php", "php.net/license/", ("3.0", "3.01")), ("apsl", "apple public source license", "apsl", "opensource.org/licenses/apsl-", ("1.0", "1.1", "1.2", "2.0")),
    ("ecl", "educational community license", "ecl", "opensource.org/licenses/ecl-", ("1.0", "2.0")), ("ms-pl", "microsoft public license", "ms-pl", "opensource.org/licenses/ms-pl", ("1.0",)), ("busl", "business source license", "busl", "mariadb.com/bsl", ("1.0", "1.1")), ("sspl", "server side public license", "sspl", "mongodb.com/licensing/server-side", ("1.0",)),
)
CC = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-sa", "attribution share alike"), ("by-nc", "attribution noncommercial"), ("by-nc", "attribution non commercial"), ("by-nd", "attribution noderivatives"), ("by-nd", "attribution noderivs"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-sa", "attribution non commercial share alike"), ("by-nc-nd", "attribution noncommercial noderivatives"), ("by-nc-nd", "attribution noncommercial noderivs"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
PLAIN = (
    ("mit", "mit license", b"mit", 40, 0.9), ("mit", "the mit licence", b"mit", 40, 0.9), ("mit", "permission is hereby granted free of charge to any person obtaining a copy", b"granted", 60, 1.0), ("mit", "licensed under the? mit", b"mit", 41, 0.95), ("mit", "opensource org licenses mit", b"opensource", 50, 1.0), ("mit", "spdx license identifier mit", b"spdx", 70, 1.0),
    ("bsd-2-clause", "bsd 2 clause", b"bsd", 45, 0.95), ("bsd-3-clause", "bsd 3 clause", b"bsd", 45, 0.95), ("bsd-4-clause", "bsd 4 clause", b"bsd", 45, 0.95), ("bsd-2-clause", "simplified bsd license", b"bsd", 45, 0.9), ("bsd-2-clause", "freebsd license", b"bsd", 44, 0.9), ("bsd-3-clause", "new bsd license", b"bsd", 45, 0.9), ("bsd-3-clause", "revised bsd license", b"bsd", 45, 0.9), ("bsd-3-clause", "modified bsd license", b"bsd", 45, 0.9), ("bsd-4-clause", "original bsd license", b"bsd", 45, 0.9), ("bsd", "bsd license", b"bsd", 30, 0.7), ("bsd", "bsd style license", b"bsd", 31, 0.7), ("bsd-0-clause", "zero clause bsd", b"bsd", 45, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", b"redistribution", 55, 1.0), ("isc", "isc license", b"isc", 40, 0.9), ("isc", "permission to use copy modify and or distribute this software for any purpose", b"permission", 60, 1.0), ("zlib", "zlib license", b"zlib", 40, 0.9), ("zlib", "zlib libpng license", b"zlib", 41, 0.95), ("unlicense", "this is free and unencumbered software released into the public domain", b"unencumbered", 60, 1.0), ("unlicense", "the unlicense", b"unlicense", 40, 0.9), ("wtfpl", "do what the fuck you want to public license", b"want", 60, 1.0), ("wtfpl", "wtfpl", b"wtfpl", 40, 0.9),
    ("cc0", "cc0", b"cc0", 40, 0.9), ("cc0", "cc zero", b"cc", 40, 0.8), ("cc0", "creativecommons org publicdomain zero", b"creativecommons", 60, 1.0), ("public-domain", "released into the public domain", b"domain", 45, 0.9), ("public-domain", "in the public domain", b"domain", 30, 0.6), ("public-domain", "dedicated to the public domain", b"domain", 45, 0.9), ("python", "python software foundation license", b"python", 45, 0.95), ("openssl", "openssl license", b"openssl", 45, 0.9), ("x11", "x11 license", b"x11", 45, 0.9), ("beerware", "beer ware license", b"beer", 45, 0.9), ("json", "the software shall be used for good not evil", b"evil", 60, 1.0), ("all-rights-reserved", "all rights reserved", b"reserved", 20, 0.5), ("proprietary", "proprietary and confidential", b"proprietary", 40, 0.8), ("cc", "creative commons license", b"creative", 20, 0.6), ("gpl", "gnu general public license", b"gnu", 30, 0.8), ("gpl", "gnu gpl", b"gpl", 30, 0.8), ("lgpl", "gnu lgpl", b"lgpl", 30, 0.8), ("apache", "apache license", b"apache", 30, 0.8), ("cc-by", "cc by", b"cc", 25, 0.8),
)

# Wordings of license texts and notices: label, words, the word that is searched first, priority, weight.
WORDINGS = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", b"compliance", 62, 1.0),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", b"obtain", 61, 1.0),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", b"agreed", 55, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", b"redistribute", 58, 1.0),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", b"lesser", 59, 1.0),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license", b"library", 59, 1.0),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", b"affero", 59, 1.0),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", b"hope", 52, 0.9),
    ("gpl", "you should have received a copy of the gnu general public license", b"received", 53, 0.95),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", b"received", 54, 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license", b"received", 54, 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", b"documentation", 60, 1.0),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", b"statically", 60, 1.0),
    ("gcc-exception", "gcc runtime library exception", b"gcc", 60, 1.0),
    ("font-exception", "as a special exception if you create a document which uses this font", b"font", 58, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", b"substantial", 58, 0.95),
    ("mit", "released under the? mit", b"mit", 41, 0.9),
    ("mit", "distributed under the? mit", b"mit", 41, 0.9),
    ("mit", "mit licensed", b"mit", 41, 0.9),
    ("mit-0", "mit no attribution", b"attribution", 46, 0.95),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", b"endorse", 58, 1.0),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software", b"endorse", 57, 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", b"advertising", 58, 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", b"redistributions", 54, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", b"redistributions", 53, 0.9),
    ("bsd", "this software is provided by the copyright holders and contributors as is", b"contributors", 50, 0.9),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", b"fee", 61, 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", b"misrepresented", 60, 1.0),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", b"misrepresented", 60, 1.0),
    ("libpng", "libpng license", b"libpng", 44, 0.9),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", b"mozilla", 58, 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", b"eclipse", 58, 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", b"subject", 58, 1.0),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself", b"perl", 60, 1.0),
    ("ruby", "ruby license", b"ruby", 44, 0.9),
    ("php", "this product includes php software", b"php", 58, 1.0),
    ("openssl", "this product includes software developed by the openssl project", b"openssl", 58, 1.0),
    ("ssleay", "this product includes cryptographic software written by", b"cryptographic", 58, 1.0),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", b"organization", 61, 1.0),
    ("w3c", "w3c software notice and license", b"w3c", 45, 0.95),
    ("unicode", "unicode license agreement", b"unicode", 50, 0.95),
    ("icu", "icu license", b"icu", 44, 0.9),
    ("ncsa", "university of illinois ncsa open source license", b"ncsa", 55, 1.0),
    ("postgresql", "postgresql license", b"postgresql", 45, 0.95),
    ("postgresql", "for any purpose without fee and without a written agreement is hereby granted", b"agreement", 62, 1.0),
    ("vim", "vim license", b"vim", 44, 0.9),
    ("ofl", "this font software is licensed under the sil open font license", b"font", 60, 1.0),
    ("cc", "this work is licensed under a creative commons", b"creative", 35, 0.8),
    ("cc", "licensed under creative commons", b"creative", 34, 0.8),
    ("cc0", "cc0 1 0 universal", b"universal", 58, 1.0),
    ("cc0", "to the extent possible under law the author has waived all copyright", b"waived", 58, 1.0),
    ("public-domain", "this software is in the public domain", b"domain", 46, 0.9),
    ("public-domain", "placed in the public domain", b"domain", 45, 0.9),
    ("public-domain", "public domain dedication", b"dedication", 45, 0.9),
    ("public-domain", "public domain mark", b"domain", 45, 0.9),
    ("public-domain", "no rights reserved", b"reserved", 45, 0.8),
    ("proprietary", "all rights reserved unauthorized copying", b"unauthorized", 50, 0.9),
    ("proprietary", "this software is the confidential and proprietary information of", b"confidential", 52, 0.95),
    ("proprietary", "unauthorized reproduction or distribution", b"unauthorized", 48, 0.8),
    ("proprietary", "may not be reproduced or distributed without the? prior written permission", b"reproduced", 48, 0.8),
    ("eula", "end user license agreement", b"agreement", 45, 0.9),
    ("commercial", "commercial license", b"commercial", 30, 0.6),
    ("non-commercial", "for non commercial use only", b"commercial", 40, 0.8),
    ("non-commercial", "free for personal use", b"personal", 35, 0.7),
    ("freeware", "freeware license", b"freeware", 40, 0.8),
    ("shareware", "shareware license", b"shareware", 40, 0.8),
    ("elastic", "elastic license", b"elastic", 45, 0.95),
    ("commons-clause", "commons clause license condition", b"clause", 50, 0.95),
    ("polyform", "polyform noncommercial license", b"polyform", 50, 0.95),
    ("polyform", "polyform shield license", b"polyform", 50, 0.95),
    ("ms-rl", "microsoft reciprocal license", b"reciprocal", 50, 0.95),
    ("upl", "universal permissive license", b"permissive", 50, 0.95),
    ("mulan", "mulan permissive software license", b"mulan", 51, 0.95),
    ("blueoak", "blue oak model license", b"oak", 50, 0.95),
    ("hippocratic", "hippocratic license", b"hippocratic", 50, 0.95),
    ("sleepycat", "sleepycat license", b"sleepycat", 50, 0.95),
    ("imagemagick", "imagemagick license", b"imagemagick", 50, 0.95),
    ("qpl", "the q public license", b"public", 50, 0.95),
    ("ijg", "this software is based in part on the work of the independent jpeg group", b"jpeg", 60, 1.0),
    ("freetype", "the freetype project license", b"freetype", 50, 0.95),
    ("bzip2", "bzip2 license", b"bzip2", 44, 0.9),
    ("info-zip", "info zip license", b"zip", 44, 0.9),
    ("ogl", "open government licence", b"government", 50, 0.95),
    ("etalab", "licence ouverte", b"ouverte", 50, 0.95),
    ("odc-by", "open data commons attribution license", b"attribution", 50, 0.95),
    ("pddl", "open data commons public domain dedication and license", b"dedication", 55, 1.0),
    ("cdla", "community data license agreement", b"community", 50, 0.95),
    ("openrail", "openrail license", b"openrail", 50, 0.95),
    ("llama", "llama community license", b"llama", 50, 0.95),
    ("gpl", "licence publique générale gnu", b"publique", 50, 0.9),
    ("gpl", "gnu allgemeine öffentliche lizenz", b"allgemeine", 50, 0.9),
    ("gpl", "licencia pública general de gnu", b"licencia", 50, 0.9),
)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: families by version and wording, then Creative Commons, then plain phrases."""
    out: list[Rule] = []

    def add(label: str, keyword: bytes, body: bytes, priority: int, weight: float) -> None:
        out.append(Rule(label, keyword, re.compile(EDGE_BEFORE + b"(?:" + body + b")" + EDGE_AFTER), priority, weight))

    v_word = rb"(?:[^0-9a-z\x80-\xff]+(?:version|ver|v))?[^0-9a-z\x80-\xff]*v?"
    for short, name, abbreviation, site, versions in GNU:
        for version in versions:
            dotted = version if "." in version else f"{version}.0"
            for tail, wording, more in (("-or-later", rb"[^0-9a-z\x80-\xff]+(?:or[^0-9a-z\x80-\xff]+(?:\(?at your option\)?[^0-9a-z\x80-\xff]+)?(?:any[^0-9a-z\x80-\xff]+)?(?:later|newer))", 3), ("-only", rb"[^0-9a-z\x80-\xff]+only", 2), ("", b"", 0)):
                label = f"{short}-{dotted}{tail}"
                add(label, b"license", _phrase(name) + v_word + _version(version) + wording, 60 + more, 1.0)
                add(label, abbreviation.encode(), abbreviation.encode() + v_word + _version(version) + wording, 50 + more, 0.9)
            for tail in ("-or-later", "-only"):
                add(f"{short}-{dotted}{tail}", b"spdx", _phrase("spdx license identifier") + GAP + re.escape(f"{short}-{dotted}{tail}").encode(), 75, 1.0)
            add(f"{short}-{dotted}", site.encode(), re.escape(f"{site}/{abbreviation}-{dotted}").encode(), 65, 1.0)
    for short, name, abbreviation, site, versions in VERSIONED:
        for version in versions:
            label = f"{short}-{version}"
            add(label, name.split()[0].encode(), _phrase(name) + v_word + _version(version), 60, 1.0)
            add(label, abbreviation.encode(), re.escape(abbreviation).encode() + rb"[-\s]*v?" + _version(version), 48, 0.85)
            add(label, b"spdx", _phrase("spdx license identifier") + GAP + re.escape(label).encode(), 75, 1.0)
            add(label, site.split("/")[0].encode(), re.escape(site).encode() + _version(version), 65, 1.0)
        add(short, name.split()[0].encode(), _phrase(name), 30, 0.8)
    for version in CC_VERSIONS:
        for short, name in CC:
            label = f"cc-{short}-{version}"
            words = short.replace("-", " ")
            add(label, b"creative", _phrase(f"creative commons {name}") + v_word + _version(version), 60, 1.0)
            add(label, b"cc", _phrase(f"cc {words}") + v_word + _version(version), 55, 0.95)
            add(label, b"creativecommons", re.escape(f"creativecommons.org/licenses/{short}/{version}").encode(), 65, 1.0)
    for short, name in CC:
        add(f"cc-{short}", b"creative", _phrase(f"creative commons {name}"), 40 + len(short), 0.8)
    for label, text, keyword, priority, weight in (*PLAIN, *WORDINGS):
        add(label, keyword, _phrase(text), priority, weight)
    return tuple(out)


@cache
def _keywords() -> tuple[tuple[bytes, tuple[int, ...]], ...]:
    by: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    return tuple((k, tuple(v)) for k, v in by.items())


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule) those that stay, in order of start: by priority, length and rule, none overlapping a better one."""
    every = rules()
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for d in sorted(found, key=lambda d: (-every[d[2]].priority, d[0] - d[1], d[2], d[0])):
        at = bisect_left(starts, d[0])
        clear_left = at == 0 or kept[at - 1][1] <= d[0]
        clear_right = at == len(kept) or kept[at][0] >= d[1]
        if clear_left and clear_right:
            kept.insert(at, d)
            starts.insert(at, d[0])
    return kept


def detections(low: bytes, candidates: tuple[int, ...] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, rule) in a lower-cased text, overlaps resolved."""
    every = rules()
    if candidates is None:
        candidates = tuple(i for k, own in _keywords() if k in low for i in own)
    return resolve([(m.start(), m.end(), i) for i in sorted(set(candidates)) for m in every[i].pattern.finditer(low)])


def _places(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: bytes) -> np.ndarray:
    """The words (by index) that are ``word``, byte by byte."""
    at = np.flatnonzero(ends - starts == len(word))
    for k, byte in enumerate(word):
        at = at[low[starts[at] + k] == byte]
    return at


def _scan_slice(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """One tuple per document: n_words, n_base, first_word, last_word, base labels, labels, score, detections."""
    low = ts.LOWER[data]
    starts, ends, first = ts.spans(low, offsets, ts.ALNUM)
    n = len(offsets) - 1
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    if len(starts):
        for phrase, label in BASE:
            want = phrase.encode().split()
            at = _places(low, starts, ends, want[0])
            for k in range(1, len(want)):
                at = at[np.isin(at + k, _places(low, starts, ends, want[k]), assume_unique=True)]
            doc = np.searchsorted(first, at, side="right") - 1
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                if i + len(want) <= first[d + 1]:
                    base[d].append((i - int(first[d]), label))
    raw = low.tobytes()
    asked: dict[int, set[int]] = {}
    for keyword, own in _keywords():
        at, hits = raw.find(keyword), []
        while at >= 0:
            hits.append(at)
            at = raw.find(keyword, at + 1)
        for d in set((np.searchsorted(offsets, hits, side="right") - 1).tolist()) if hits else ():
            asked.setdefault(d, set()).update(own)
    out = []
    every = rules()
    for d in range(n):
        kept = detections(raw[offsets[d] : offsets[d + 1]], tuple(asked[d])) if d in asked else []
        places = [p for p, _ in base[d]]
        own = {label for _, label in base[d]}
        score = max([every[i].weight for _, _, i in kept] + [0.8] * bool(own), default=0.0)
        found = [{"start": s, "end": e, "label": every[i].label, "priority": every[i].priority} for s, e, i in kept]
        out.append((int(first[d + 1] - first[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {every[i].label for _, _, i in kept})), score, found))
    return out


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", _FOUND)])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in ts.slices(batch.column(1)):
            columns = list(zip(*_scan_slice(data, offsets), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word and base counts, labels, score, and the detections with byte positions."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:int>>")
