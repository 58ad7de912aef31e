"""License scans against a plain version without keywords, and the registered query."""

import os
import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pytest

import tidewater.llm.license_scan as ls
from tidewater.llm.queries import op12_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = np.random.Generator(np.random.PCG64(7))
RULES = ls.rules()
LINES = [
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "CC BY CC BY", "ALL RIGHTS RESERVED all rights reserved",
    "general public-license GENERAL public", "See the LICENSE file", "http://creativecommons.org/licenses/by-nc-sa/4.0/", "Copyright (c) 2019-2021 by Me. Proprietary and confidential",
    "the above copyright notice and this permission notice shall be included in all copies", "generalpublic license", "cc byé", "écc by", "all rights éreserved",
]


def prose(n):
    words = ["the", "license", "public", "cc", "by", "general", "under", "rights", "all", "reserved", "gpl", "licensed", "straße", "3", "0", "nc", "version", "mit", "copyright"]
    return " ".join(words[i] for i in RNG.integers(0, len(words), n))


DOCS = [(k, t) for k, t in enumerate(LINES)] + [(100 + k, prose(int(RNG.integers(1, 300)))) for k in range(60)]
DOCS += [(300, None), (301, ""), (302, " .,-"), (303, prose(40_000)), (5, LINES[5]), (5, LINES[5]), (None, LINES[0]), (None, None), (304, "word " * 3000 + LINES[0] + " é日本" * 2000 + LINES[2])]


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((k, k + len(p.split()), label) for p, label in ls.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    line = f" {' '.join(words)} ".encode()
    found = []
    for k, r in enumerate(RULES):
        for m in r.pattern.finditer(line):
            start = line[: m.start()].count(b" ")
            found.append((start, start + m[0].count(b" "), k))
    kept = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        if not any(e[0] <= d[0] and d[1] <= e[1] or d[0] <= e[0] and e[1] <= d[1] for e in kept):
            kept.append(d)
    best = {label: ls.BASE_WEIGHT for *_, label in base}
    for *_, k in kept:
        best[RULES[k].label] = max(best.get(RULES[k].label, 0), RULES[k].weight)
    score = 1 - np.prod([1 - best[x] for x in sorted(best)]) if best else 0.0
    return len(words), base, [(s, e, RULES[k].label) for s, e, k in sorted(kept)], sorted(best), float(score)


def examples(tree):
    """Shortest texts of a pattern, one for each branch and class entry somewhere in it."""
    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            more = [chr(arg)]
        elif op is C.IN:
            more = [chr(a) if o is C.LITERAL else chr(a[0]) for o, a in arg if o is not C.NEGATE][:2]
            more = ["x"] if arg[0][0] is C.NEGATE else more
        elif op is C.BRANCH:
            more = [x for t in arg[1] for x in examples(t)]
        elif op is C.SUBPATTERN:
            more = examples(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            more = [x * arg[0] for x in examples(arg[2])] if arg[0] else ["", *examples(arg[2])]
        elif op is C.NOT_LITERAL:
            more = ["x"]
        elif op in (C.ASSERT, C.ASSERT_NOT):
            more = [""]
        else:
            raise ValueError(op)
        out = [x + more[k % len(more)] for k in range(max(len(out), len(more))) for x in [out[k % len(out)]]]
    return out


def test_every_rule_matches_and_every_match_has_a_keyword():
    assert len(RULES) > 200 and [ls.KINDS.index(r.kind) for r in RULES] == sorted(ls.KINDS.index(r.kind) for r in RULES)
    for r in RULES:
        texts = [x for x in examples(_parser.parse(r.pattern.pattern.decode())) if r.pattern.fullmatch(x.encode() + b" ") or r.pattern.match(x.encode() + b" ")]
        assert texts, r
        for x in texts:
            assert set(r.keywords) & set(x.split()), (r, x)
        assert all(WORD.fullmatch(k) for k in r.keywords)


def test_known_lines():
    scanner = ls.Scanner()
    got = {x: sorted({RULES[k].label for *_, k in found}) for x, (_, _, found) in zip(LINES, scanner.scan(pa.array(LINES)))}
    assert [got[x] for x in LINES[:6]] == [["gpl-3.0"], [], ["cc-by-nc-4.0"], ["mit"], ["apache-2.0"], ["gpl-2.0"]]
    assert got[LINES[10]] == ["cc-by-nc-sa-4.0"] and got[LINES[11]] == ["copyright", "proprietary"]


def test_nested_detections_give_way_to_the_earlier_rule():
    assert ls.resolve([(2, 5, 9), (0, 8, 3), (8, 9, 1), (4, 12, 7), (0, 8, 4)]) == [(0, 8, 3), (8, 9, 1)]
    for _ in range(200):
        found = [(int(s), int(s + n), int(k)) for k, (s, n) in enumerate(zip(RNG.integers(0, 40, 15), RNG.integers(1, 12, 15)))]
        kept = []
        for d in found:
            if not any(e[0] <= d[0] and d[1] <= e[1] or d[0] <= e[0] and e[1] <= d[1] for e in kept):
                kept.append(d)
        assert ls.resolve(list(reversed(found))) == sorted(kept)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id long, text string, labels string, score double").repartition(3)


def test_scan_is_that_of_a_plain_version(docs):
    def row(r):
        return (r.doc_id, r.n_words, [tuple(p) for p in r.base], [tuple(p) for p in r.found], r.labels, round(r.score, 12))

    want = [(i, n, base, found, labels, round(score, 12)) for i, t in DOCS for n, base, found, labels, score in [plain(t)]]
    got = [row(r) for r in ls.scan_licenses(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert ls.scan_licenses(docs.limit(0)).count() == 0


def test_registered_query(spark, docs, tmp_path):
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    want = []
    for i, t in DOCS:
        n, base, _, labels, score = plain(t)
        first, last = (min(b[0] for b in base), max(b[0] for b in base)) if base else (None, None)
        want.append((i, n, len(base), first, last, ",".join(sorted({b[2] for b in base})), ",".join(labels), round(score, 12)))
    got = [(*tuple(r)[:-1], round(r.score, 12)) for r in op12_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_long_text_of_keywords_takes_linear_time():
    import time

    scanner, took = ls.Scanner(), []
    for n in (20_000, 200_000):
        text = pa.array([prose(n)])
        at = time.process_time()
        list(scanner.scan(text))
        took.append(time.process_time() - at)
    assert took[1] < 40 * took[0]
