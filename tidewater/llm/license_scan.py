"""License scans: ordered signature rules over the words of each text.

A rule is a regular expression over lower-case words joined by one space, a
label and keywords, one of which every match has as a word.  The words of a text are
hashed and looked up among the keywords; only rules of which the text holds
a keyword are run, and only texts with a keyword are spelt out at all.

Rules are ordered: tags first, then names with versions (in a context, alone),
passages of license texts, names in a context, names alone, and general notices.  Of two detections
one of which contains the other, the one of the earlier rule stays.

Rules come from the tables below: passages and notices as they are, and for
each license its names with each version in the forms of ``_forms``.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.text import Hasher, Words, alnum_bytes, ascii_lower, joined_words, pieces, utf8

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label | versions | full names, "keyword: pattern" | short names that need a context
LICENSES = """
agpl | 1.0 3.0 | affero: (?:gnu )?affero general public licen[sc]e; affero: affero gpl | agpl
lgpl | 2.0 2.1 3.0 | lesser: (?:gnu )?lesser general public licen[sc]e; library: (?:gnu )?library general public licen[sc]e; lgpl: gnu lgpl | lgpl
gpl | 1.0 2.0 3.0 | public: (?:gnu )?general public licen[sc]e; gpl: gnu gpl | gpl
gfdl | 1.1 1.2 1.3 | documentation: (?:gnu )?free documentation licen[sc]e | gfdl
apache | 1.0 1.1 2.0 | apache: apache(?: software)?(?: foundation)? licen[sc]e | apache; asl
mit | | mit: mit licen[sc]e; expat: expat licen[sc]e; x11: x11 licen[sc]e | mit; expat
mit-0 | | attribution: mit no attribution | mit 0
bsd-2-clause | | clause: (?:2|two) clause bsd(?: licen[sc]e)?; simplified: simplified bsd(?: licen[sc]e)?; freebsd: freebsd licen[sc]e | bsd 2 clause; bsd 2
bsd-3-clause | | clause: (?:3|three) clause bsd(?: licen[sc]e)?; bsd: (?:revised|modified|new) bsd(?: licen[sc]e)?; berkeley: revised berkeley licen[sc]e | bsd 3 clause; bsd 3
bsd-4-clause | | clause: (?:4|four) clause bsd(?: licen[sc]e)?; bsd: original bsd(?: licen[sc]e)? | bsd 4 clause
bsd-0-clause | | clause: (?:0|zero) clause bsd(?: licen[sc]e)?; 0bsd: 0bsd licen[sc]e | 0bsd
bsd | | bsd: bsd licen[sc]e; berkeley: berkeley software distribution licen[sc]e | bsd
isc | | isc: isc licen[sc]e; consortium: internet (?:systems|software) consortium licen[sc]e | isc
mpl | 1.0 1.1 2.0 | mozilla: mozilla public licen[sc]e | mpl
epl | 1.0 2.0 | eclipse: eclipse public licen[sc]e | epl
edl | 1.0 | eclipse: eclipse distribution licen[sc]e | edl
cpl | 1.0 | common: common public licen[sc]e | cpl
cddl | 1.0 1.1 | distribution: common development and distribution licen[sc]e | cddl
eupl | 1.0 1.1 1.2 | european: european union public licen[sc]e | eupl
osl | 1.0 2.0 2.1 3.0 | software: open software licen[sc]e | osl
afl | 1.1 1.2 2.0 2.1 3.0 | academic: academic free licen[sc]e | afl
artistic | 1.0 2.0 | artistic: (?:perl )?artistic licen[sc]e | artistic
bsl | 1.0 | boost: boost software licen[sc]e | boost
busl | 1.1 | business: business source licen[sc]e | busl
sspl | 1.0 | server: server side public licen[sc]e | sspl
elastic | 1.0 2.0 | elastic: elastic licen[sc]e | elastic
psf | 2.0 | python: python(?: software foundation)? licen[sc]e | psf; psfl
zlib | | zlib: zlib(?: libpng)? licen[sc]e | zlib
libpng | 1.6 2.0 | libpng: libpng(?: reference library)? licen[sc]e; png: png reference library licen[sc]e | libpng
wtfpl | 1.0 2.0 | public: do what the (?:[^ ]+ )?you want to public licen[sc]e | wtfpl
unlicense | | unlicense: the unlicense | unlicense
beerware | 42 | beerware: beerware licen[sc]e; beer: beer ware licen[sc]e | beerware
json | | json: the json licen[sc]e | json
icu | | icu: icu licen[sc]e | icu
unicode | 1.0 3.0 | unicode: unicode(?: inc)? licen[sc]e(?: agreement)? | unicode
w3c | 1998 2015 | w3c: w3c(?: software)?(?: notice and)?(?: document)? licen[sc]e | w3c
php | 3.0 3.1 | php: php licen[sc]e | php
ruby | | ruby: ruby licen[sc]e | ruby
openssl | | openssl: openssl licen[sc]e | openssl
ssleay | | ssleay: (?:original )?ssleay licen[sc]e | ssleay
curl | | curl: curl licen[sc]e | curl
vim | 6.0 | vim: vim licen[sc]e | vim
tcl | | tcl: tcl(?: tk)? licen[sc]e | tcl
qpl | 1.0 | q: q public licen[sc]e | qpl
cecill | 1.0 1.1 2.0 2.1 | cecill: cecill(?: free software)? licen[sc]e | cecill
ecl | 1.0 2.0 | educational: educational community licen[sc]e | ecl
ms-pl | | microsoft: microsoft public licen[sc]e | ms pl
ms-rl | | reciprocal: microsoft reciprocal licen[sc]e | ms rl
apsl | 1.0 1.1 1.2 2.0 | apple: apple public source licen[sc]e | apsl
ofl | 1.0 1.1 | font: (?:sil )?open font licen[sc]e | ofl
odbl | 1.0 | database: open database licen[sc]e | odbl
odc-by | 1.0 | commons: open data commons attribution licen[sc]e | odc by
pddl | 1.0 | dedication: public domain dedication and licen[sc]e | pddl
ogl-uk | 1.0 2.0 3.0 | government: open government licen[sc]e | ogl uk; ogl
cdla-permissive | 1.0 2.0 | permissive: community data licen[sc]e agreement permissive | cdla permissive
cdla-sharing | 1.0 | sharing: community data licen[sc]e agreement sharing | cdla sharing
upl | 1.0 | universal: universal permissive licen[sc]e | upl
ncsa | | ncsa: (?:university of illinois )?ncsa open source licen[sc]e | ncsa
postgresql | | postgresql: postgresql licen[sc]e | postgresql
mulanpsl | 1.0 2.0 | mulan: mulan permissive software licen[sc]e | mulanpsl
blueoak | 1.0.0 | blue: blue oak model licen[sc]e | blueoak
openrail | 1.0 | rail: open rail(?: m| d| s)? licen[sc]e|responsible ai licen[sc]e rail; openrail: (?:bigscience |creativeml )?openrail(?: m| d| s)?(?: licen[sc]e)? | openrail
llama | 2 3 3.1 3.2 3.3 4 | llama: llama(?: [0-9])?(?: [0-9])? community licen[sc]e agreement | llama
gemma | | gemma: gemma terms of use | gemma
zpl | 1.1 2.0 2.1 | zope: zope public licen[sc]e | zpl
latex | 1.0 1.1 1.2 1.3 | latex: latex project public licen[sc]e | lppl
cc-by-nc-nd | 1.0 2.0 2.5 3.0 4.0 | derivs: (?:creative commons )?attribution non ?commercial no derivs; derivatives: (?:creative commons )?attribution non ?commercial no derivatives; noderivs: (?:creative commons )?attribution non ?commercial noderivs; noderivatives: (?:creative commons )?attribution non ?commercial noderivatives; nd: (?:cc|creative commons) by nc nd | cc by nc nd
cc-by-nc-sa | 1.0 2.0 2.5 3.0 4.0 | sharealike: (?:creative commons )?attribution non ?commercial sharealike; alike: (?:creative commons )?attribution non ?commercial share alike; sa: (?:cc|creative commons) by nc sa | cc by nc sa
cc-by-nc | 1.0 2.0 2.5 3.0 4.0 | noncommercial: (?:creative commons )?attribution noncommercial; commercial: (?:creative commons )?attribution non commercial; nc: (?:cc|creative commons) by nc | cc by nc
cc-by-nd | 1.0 2.0 2.5 3.0 4.0 | noderivs: (?:creative commons )?attribution noderivs; noderivatives: (?:creative commons )?attribution noderivatives; nd: (?:cc|creative commons) by nd | cc by nd
cc-by-sa | 1.0 2.0 2.5 3.0 4.0 | sharealike: (?:creative commons )?attribution sharealike; alike: (?:creative commons )?attribution share alike; sa: (?:cc|creative commons) by sa | cc by sa
cc-by | 1.0 2.0 2.5 3.0 4.0 | creative: creative commons attribution; cc: cc by; creative: creative commons by | cc by
cc0 | 1.0 | cc0: cc0(?: universal)?(?: public domain dedication)?; zero: creative commons zero | cc0
creative-commons | | commons: creative commons licen[sc]e | creative commons
"""

#: label | keyword | pattern: passages of license texts and links to them
PASSAGES = """
mit | permission is hereby granted free of charge to any person obtaining a copy | hereby
mit | the above copyright notice and this permission notice shall be included in all copies | notice
mit | the software is provided as is without warranty of any kind express or implied | software
mit | opensource org licen[sc]es mit | opensource
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | fee
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution
bsd | redistributions of source code must retain the above copyright notice | redistributions
bsd | redistributions in binary form must reproduce the above copyright notice | redistributions
bsd-3-clause | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used | neither
bsd-4-clause | all advertising materials mentioning features or use of this software must display | advertising
bsd | opensource org licen[sc]es bsd(?: licen[sc]e)? | opensource
apache-2.0 | www apache org licen[sc]es(?: licen[sc]e)? 2 0 | apache
apache-2.0 | you may not use this file except in compliance with the licen[sc]e | compliance
apache | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e | writing
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e | redistribute
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e | redistribute
gpl | without even the implied warranty of merchantability or fitness for a particular purpose | merchantability
gpl | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document | verbatim
gpl-2.0 | either version 2 of the licen[sc]e or at your option any later version | either
gpl-3.0 | either version 3 of the licen[sc]e or at your option any later version | either
gpl | www gnu org licen[sc]es gpl | gnu
gpl-2.0 | www gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0 | gnu
gpl-3.0 | www gnu org licen[sc]es gpl 3 0 | gnu
lgpl | www gnu org (?:copyleft|licen[sc]es) lgpl | gnu
agpl-3.0 | www gnu org licen[sc]es agpl 3 0 | agpl
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e | granted
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0 | mozilla
mpl-2.0 | mozilla org mpl 2 0 | mpl
mpl-1.1 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1 | mozilla
epl-2.0 | www eclipse org legal epl (?:2 0|v20) | epl
epl-1.0 | www eclipse org legal epl v10 | epl
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution licen[sc]e | distribution
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software | organization
bsl-1.0 | www boost org licen[sc]e 1 0 | boost
zlib | altered source versions must be plainly marked as such and must not be misrepresented | misrepresented
zlib | the origin of this software must not be misrepresented | misrepresented
unlicense | this is free and unencumbered software released into the public domain | unencumbered
unlicense | unlicense org | unlicense
wtfpl-2.0 | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document | verbatim
wtfpl | you just do what the (?:[^ ]+ )?you want to | want
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer | beer
json | the software shall be used for good not evil | evil
openssl | this product includes software developed by the openssl project | openssl
php | this product includes php software freely available from | php
ofl-1.1 | this font software is licensed under the sil open font licen[sc]e version 1 1 | font
cc-by-4.0 | creativecommons org licen[sc]es by 4 0 | creativecommons
cc-by-3.0 | creativecommons org licen[sc]es by 3 0 | creativecommons
cc-by-2.0 | creativecommons org licen[sc]es by 2 0 | creativecommons
cc-by-sa-4.0 | creativecommons org licen[sc]es by sa 4 0 | creativecommons
cc-by-sa-3.0 | creativecommons org licen[sc]es by sa 3 0 | creativecommons
cc-by-nd-4.0 | creativecommons org licen[sc]es by nd 4 0 | creativecommons
cc-by-nc-4.0 | creativecommons org licen[sc]es by nc 4 0 | creativecommons
cc-by-nc-3.0 | creativecommons org licen[sc]es by nc 3 0 | creativecommons
cc-by-nc-sa-4.0 | creativecommons org licen[sc]es by nc sa 4 0 | creativecommons
cc-by-nc-sa-3.0 | creativecommons org licen[sc]es by nc sa 3 0 | creativecommons
cc-by-nc-nd-4.0 | creativecommons org licen[sc]es by nc nd 4 0 | creativecommons
cc-by-nc-nd-3.0 | creativecommons org licen[sc]es by nc nd 3 0 | creativecommons
cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons
cc0-1.0 | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights | waived
"""

#: The same, for notices that name no license
NOTICES = """
public-domain | (?:released|placed|dedicated|contributed) (?:in|into|to) the public domain | domain
public-domain | this (?:work|file|code|software|document|text) is (?:in )?the public domain | domain
public-domain | public domain mark 1 0 | domain
no-redistribution | may not be (?:reproduced|redistributed|copied)(?: or (?:reproduced|redistributed|distributed|copied))?(?: in any form)? without(?: the)?(?: express| prior)?(?: written)? (?:permission|consent) | without
no-redistribution | no part of this (?:publication|work|book|document) may be reproduced | reproduced
no-redistribution | unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: of this [^ ]+)?(?: via any medium)? is strictly prohibited | strictly
proprietary | proprietary and confidential | proprietary
proprietary | confidential and proprietary | proprietary
proprietary | this (?:software|file|document|source code) is proprietary | proprietary
proprietary | trade secrets? (?:of|and confidential information) | trade
non-commercial | for (?:personal and )?non ?commercial use only | only
non-commercial | not for commercial use | commercial
personal-use | for personal use only | personal
evaluation-only | for evaluation purposes only | evaluation
academic-only | for (?:academic|research|educational) (?:use|purposes) only | only
end-user-license | end user licen[sc]e agreement | end
end-user-license | by (?:installing|downloading|using) (?:the|this) software you agree to | agree
license-file | see(?: the)? licen[sc]e file(?: for(?: more)? details)? | file
license-file | see(?: the)? copying(?: file)? for(?: more)? details | copying
license-file | licen[sc]e information can be found in | found
license-file | licen[sc]ed under the terms (?:described|found|given) in | terms
dual | dual licen[sc]ed under | dual
dual | available under either of | either
copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?(?: by)? | copyright
copyright | copyright by | copyright
copyright | copyrighted by | copyrighted
"""

#: How much a detection says about the text's license, by the kind of rule; kinds in the order of rules.
KINDS = ("tag", "versioned context", "versioned", "passage", "context", "name", "notice")
WEIGHTS = dict(zip(KINDS, (0.99, 0.97, 0.95, 0.9, 0.85, 0.7, 0.3)))
BASE_WEIGHT = 0.6

_LATER = "(?: or(?: any)? later(?: version)?| only| unported| international| universal| generic)?"
_UNDER = "under(?: the)?(?: terms of(?: the)?)?"


@dataclass(frozen=True)
class Rule:
    """A match has one of the keywords as a word."""

    kind: str
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern

    @property
    def weight(self) -> float:
        return WEIGHTS[self.kind]


def _rule(kind: str, label: str, keywords: tuple[str, ...], pattern: str) -> Rule:
    return Rule(kind, label, keywords, re.compile(f" (?:{pattern})(?= )".encode()))


def _version(text: str) -> str:
    """Pattern of a version's number; ``3.0`` is also 3, but not the start of 3.1."""
    major, *minor = text.split(".")
    return f"{major} " + " ".join(minor) if minor and set(minor) != {"0"} else f"{major}(?: 0)*" + ("(?! [1-9] )" if minor else "")


def _forms(label: str, versions: list[str], names: list[list[str]], shorts: list[str]) -> Iterator[Rule]:
    """The rules of a license.  ``names`` stand alone, ``shorts`` need a context."""
    short_keywords = {s: max(s.split(), key=len) for s in shorts}
    any_name = "(?:" + "|".join([p for _, p in names] + shorts) + ")"
    any_keyword = tuple({k for k, _ in names} | set(short_keywords.values()))
    for v in [*versions, ""]:
        full = f"{label}-{v}" if v else label
        tail = f"(?: licen[sc]e)?(?: version| ver| v)? v?{_version(v)}{_LATER}" if v else ""
        context = "versioned context" if v else "context"
        yield _rule(context, full, ("licensed", "licenced"), f"licen[sc]ed {_UNDER} {any_name}{tail}")
        yield _rule(context, full, any_keyword, f"{_UNDER} {any_name}{tail} licen[sc]e")
        for s, keyword in short_keywords.items():
            yield _rule("tag", full, ("spdx",), f"spdx licen[sc]e identifier {s}{tail}")
            yield _rule(context, full, (keyword,), f"licen[sc]e {s}{tail}")
            if v:
                yield _rule(context, full, (keyword,), f"{s}{tail} licen[sc]e")
            if v and " " not in s:
                major = v.split(".")[0]
                yield _rule("versioned", full, (f"{s}v{major}", f"{s}{major}"), f"{s}v?{_version(v)}{_LATER}")
        for keyword, name in names:
            yield _rule("versioned" if v else "name", full, (keyword,), f"(?:{name}){tail}")


def _licenses() -> Iterator[tuple[str, list[str], list[list[str]], list[str]]]:
    for line in LICENSES.strip().splitlines():
        label, versions, rest = (x.strip() for x in line.split("|", 2))
        names, _, shorts = rest.rpartition(" | ")  # patterns have bars of their own
        yield label, versions.split(), [n.strip().split(": ", 1) for n in names.split(";")], [x.strip() for x in shorts.split(";")]


def _phrases(kind: str, table: str) -> Iterator[Rule]:
    for line in table.strip().splitlines():
        label, pattern, keyword = line.split(" | ")
        yield _rule(kind, label, (keyword,), pattern)


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in their order."""
    made = [r for row in _licenses() for r in _forms(*row)] + [*_phrases("passage", PASSAGES), *_phrases("notice", NOTICES)]
    return tuple(sorted(made, key=lambda r: KINDS.index(r.kind)))


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) without those that contain, or lie in, one of an earlier rule.

    What stays is never nested, so starts and ends ascend together and one
    neighbour on each side tells.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        before, after = bisect.bisect_right(starts, d[0]) - 1, bisect.bisect_left(starts, d[0])
        if before >= 0 and kept[before][1] >= d[1] or after < len(kept) and kept[after][1] <= d[1]:
            continue
        starts.insert(after, d[0])
        kept.insert(after, d)
    return kept


class Scanner:
    """Rules by keyword; one per task."""

    def __init__(self):
        self.hasher, self.lower, self.word_bytes = Hasher(), ascii_lower(), alnum_bytes()
        self.rules = rules()
        self.base = [(label, re.compile(f" {phrase}(?= )".encode()), max(phrase.split(), key=len)) for phrase, label in BASE]
        by_keyword = defaultdict(list)
        for k, r in enumerate(self.rules):
            for keyword in r.keywords:
                by_keyword[keyword].append(k)
        words = sorted(by_keyword.keys() | {keyword for *_, keyword in self.base})
        data, offsets = utf8(pa.array(words))
        hashes = self.hasher.words(Words(data, offsets, self.word_bytes))
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [words[k] for k in order]
        self.by_keyword = by_keyword

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
        """(words, base places as (start, end, label), detections as (start, end, rule)) of each text."""
        data, offsets = utf8(texts)
        for a, b in pieces(offsets):
            w = Words(self.lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], self.word_bytes)
            hashes, of = self.hasher.words(w), w.texts()
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            held = defaultdict(set)
            for pair in np.unique(of[hit] * len(self.words) + at[hit]).tolist():
                held[pair // len(self.words)].add(self.words[pair % len(self.words)])
            spelt = joined_words(w, np.isin(of, np.fromiter(held, np.int64, len(held)))) if held else None
            for k, n in enumerate(w.counts().tolist()):
                yield n, *(self._scan_one(spelt[k].as_py().encode(), held[k]) if k in held else ([], []))

    def _scan_one(self, words: bytes, keywords: set[str]) -> tuple[list[tuple], list[tuple]]:
        text = b" " + words + b" "
        gaps: np.ndarray | None = None
        base, found = [], []

        def places(pattern: re.Pattern) -> Iterator[tuple[int, int]]:
            nonlocal gaps
            for m in pattern.finditer(text):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                yield int(np.searchsorted(gaps, m.start())), int(np.searchsorted(gaps, m.end()))

        for label, pattern, keyword in self.base:
            if keyword in keywords:
                base += [(start, end, label) for start, end in places(pattern)]
        for k in sorted({k for word in keywords for k in self.by_keyword.get(word, ())}):
            found += [(start, end, k) for start, end in places(self.rules[k].pattern)]
        return sorted(base), resolve(found)


_SPANS = "array<struct<start:long,end:long,label:string>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License statements in each text.

    Result, one row for each input row: doc_id, n_words, base (places of the
    base phrases: start and end in words, label), found (detections that stay,
    the same way), base_labels and labels (distinct, sorted; labels has those of
    base and of found) and score (0 to 1: one less the product, over the labels,
    of one less the weight of the label's best rule).

    Words are runs of a-z (A-Z count as these), 0-9 and characters beyond ASCII.
    Null or empty texts have none, and score 0.  Very long texts are scanned
    whole; patterns have no unbounded repetition, so time is linear.  Repeated
    rows, and rows of one id, are scanned each; other columns are ignored,
    whatever their names; an empty table gives an empty result.  Of detections
    over the same words the earlier rule's stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            n_words, base, found, base_labels, labels, scores = ([] for _ in range(6))
            for n, places, kept in scanner.scan(batch.column(1)):
                best = {label: BASE_WEIGHT for *_, label in places}
                base_labels.append(sorted(best))
                for *_, k in kept:
                    rule = scanner.rules[k]
                    best[rule.label] = max(best.get(rule.label, 0.0), rule.weight)
                none = 1.0
                for label in sorted(best):
                    none *= 1 - best[label]
                n_words.append(n)
                base.append([dict(zip(("start", "end", "label"), p)) for p in places])
                found.append([{"start": s, "end": e, "label": scanner.rules[k].label} for s, e, k in kept])
                labels.append(sorted(best))
                scores.append(1 - none)
            strings = pa.list_(pa.string())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, _SPAN_LIST), pa.array(found, _SPAN_LIST)]
            columns += [pa.array(base_labels, strings), pa.array(labels, strings), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "base", "found", "base_labels", "labels", "score"])

    return rows.mapInArrow(scan, f"doc_id long, n_words long, base {_SPANS}, found {_SPANS}, base_labels array<string>, labels array<string>, score double")
