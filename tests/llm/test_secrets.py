"""Secret scans: entropy against a plain scan, long strings in linear time."""

import base64
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewater.llm import secrets as sc
from tidewater.llm.queries import op8_secret_scans

G = random.Random(8)


def windows(token):
    """Every window counted anew."""
    out = []
    for k in range(len(token) - sc.WINDOW + 1):
        w = token[k : k + sc.WINDOW]
        weight = sum(sc.WEIGHTS[w.count(c)] for c in set(w))
        if any(set(w) <= set(alphabet) and weight <= sc.most_weight(least) for alphabet, least in sc.CLASSES):
            if out and out[-1][1] >= k:
                out[-1][1] = k + sc.WINDOW
            else:
                out.append([k, k + sc.WINDOW])
    return out


def allowed(token):
    parts = re.split(sc.SIGNS, token)
    return bool(re.search(sc.ALLOWED, token)) or any(all(re.search(p, x) for x in parts) for p in sc.ALLOWED_PARTS)


def plain(text):
    base = []
    for kind, pattern in enumerate((sc.ASSIGN, sc.ACCESS, sc.HEX)):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if kind or len(m[2]) >= sc.ASSIGN_LEAST]
    spans = list(base)
    for m in re.finditer(sc.CANDIDATE, text):
        if not allowed(m[0]):
            for s, e in windows(m[0]):
                s, e = m.start() + s, m.start() + e
                if not any(b[0] <= s and e <= b[2] for b in base):
                    spans.append((s, 3, e))
    return sorted(base), sorted(spans)


def token(n, alphabet=sc.ALPHABET):
    return "".join(G.choice(alphabet) for _ in range(n))


def some_text():
    parts = []
    for _ in range(G.randrange(0, 14)):
        parts.append(G.choice([
            lambda: token(G.randrange(15, 90)), lambda: token(G.randrange(20, 50), "0123456789abcdef"), lambda: token(40, "0123456789ABCDEF"), lambda: token(30, "ab"),
            lambda: "word-" * G.randrange(3, 9) + token(25), lambda: "api_key = " + token(12), lambda: "AKIA" + token(14, "ABC012"), lambda: "2024-01-02-03-04-05-06-07", lambda: "日本é",
            lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "sha256_" * 4 + "md5", lambda: "Password: \"" + token(9), lambda: token(22) + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + token(22),
        ])())
    return G.choice([" ", "\n", ", "]).join(parts)


TEXTS = [some_text() for _ in range(150)]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(1000, None), (1001, ""), (3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, base string, spans int").repartition(3)


def test_spans_are_those_of_a_plain_scan(docs):
    got = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in sc.scan_secrets(docs).collect()]
    want = [(i, *plain(t or "")) for i, t in ROWS]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(k == 3 for _, _, spans in want for _, k, _ in spans) > 50
    assert sc.scan_secrets(docs.limit(0)).count() == 0


def test_registered_query(spark, docs, tmp_path):
    import hashlib

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in ROWS:
        base, spans = ([f"{sc.KINDS[k]}:{s}:{e}" for s, k, e in x] for x in plain(t or ""))
        want.append((i, *[sum(b.startswith(k) for b in base) for k in sc.KINDS[:3]], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)))
    assert sorted(map(repr, (tuple(r) for r in op8_secret_scans(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_redaction_of_many_spans(spark, docs):
    rows = docs.select("doc_id", "text").withColumn("b", sc.base_spans(F.col("text"))).withColumn("s", F.concat("b", sc.entropy_spans(F.col("text"), F.col("b"))))
    for r in rows.select("text", "s", sc.redacted(F.col("text"), F.col("s")).alias("out")).collect():
        if r.text is None:
            assert r.out is None
            continue
        hit = [False] * len(r.text)
        for s, _, e in r.s:
            hit[s:e] = [True] * (e - s)
        assert r.out.count("[secret]") == len(re.findall("x+", "".join("x" if h else "." for h in hit))) or "[secret]" in r.text
        assert r.out.replace("[secret]", "") == "".join(c for c, h in zip(r.text, hit) if not h)


def spans_of(spark, text):
    at = time.time()
    out = sc.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return [tuple(s) for s in out.spans], time.time() - at


def test_long_strings_neither_crash_nor_take_more_than_linear_time(spark):
    early = "é日本 " * 20_000
    assert spans_of(spark, early + "a-" * 100_000)[0] == []
    assert spans_of(spark, "a1" * 50_000 + "-" * 50_000)[0] == [(0, 2, 100_000)]  # hex
    took = []
    for n in (12_000, 120_000):
        text = early + base64.b64encode(G.randbytes(n)).decode()
        spans, seconds = spans_of(spark, text)
        took.append(seconds)
        assert sum(e - s for s, _, e in spans) > 0.9 * n * 4 / 3 and spans[0][0] >= len(early)
    assert took[1] < 30 * took[0]
    many = " ".join(token(24) for _ in range(3000))
    assert spans_of(spark, many)[0] == plain(many)[1]


def test_one_megabyte_of_base64(spark):
    text = "key " + base64.b64encode(G.randbytes(750_000)).decode()
    spans, seconds = spans_of(spark, text)
    assert sum(e - s for s, _, e in spans) > 900_000 and seconds < 120


def test_entropy_of_a_window():
    assert sc.most_weight(math.log2(sc.WINDOW)) == 0 and windows("0123456789abcdef" + "0123")
