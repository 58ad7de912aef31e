"""Secret scans with DataFrame functions only.

Base kinds are patterns.  The method adds spans of high entropy: over every
candidate string a window of ``WINDOW`` characters slides, for each character
class; counts of the characters are updated by the one that enters and the one
that leaves, and with them the sum of ``c * log2(c)``, from which the Shannon
entropy follows.  Windows over the threshold of their class are merged; strings
that an allow-list names, or that look like words or numbers, are left out.

Spark has no function that returns match positions.  ``split`` returns the
text between matches, so positions follow from the lengths of both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LEAST = 8

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy, in bits, of a window whose characters are all of the class; the last class has them all.
CLASSES = (("0123456789abcdef", 3.0), ("0123456789ABCDEF", 3.0), (ALPHABET, 3.7))
#: Candidates are no secrets if all their parts between signs match one of these: words, numbers and dates, names with
#: a short number at the end (as of hash functions).  Nor are uuids.  No pattern repeats a group: Java would recurse.
SIGNS = r"[+/_=-]+"
ALLOWED_PARTS = (r"^[A-Za-z]*$", r"^[0-9]+$", r"^[A-Za-z]{2,}[0-9]{0,4}$")
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
KINDS = ("assign", "access", "hex", "entropy")

_SPAN = "struct<start:bigint,kind:int,end:bigint>"


#: A list under construction is its full pages and the page that fills: appending copies a page, not the list.
PAGE = 256


def _no_items(kind: str) -> list[Column]:
    return [F.array().cast(f"array<array<{kind}>>").alias("pages"), F.array().cast(f"array<{kind}>").alias("page")]


def _appended(acc: Column, when: Column, item: Column) -> list[Column]:
    """``pages`` and ``page`` of ``acc``, with ``item`` at the end if ``when`` holds."""
    full = F.size(acc["page"]) >= PAGE
    pages = F.when(when & full, F.concat(acc["pages"], F.array(acc["page"]))).otherwise(acc["pages"])
    page = F.when(~when, acc["page"]).when(full, F.array(item)).otherwise(F.concat(acc["page"], F.array(item)))
    return [pages.alias("pages"), page.alias("page")]


def _items(acc: Column) -> Column:
    return F.concat(F.flatten(acc["pages"]), acc["page"])


def _matches(text: Column, pattern: str, kind: str, item, keep=None) -> Column:
    """``item(start, end, match)`` of the leftmost non-overlapping matches, in code points, that ``keep(group 2)`` keeps."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("b"), groups.alias("g"))

    def step(acc, p):
        start = acc["to"] + F.length(p["b"])
        end = start + F.length(p["m"])
        return F.struct(end.alias("to"), *_appended(acc, keep(p["g"]) if keep else F.lit(True), item(start, end, p["m"])))

    zero = F.struct(F.lit(0).cast("long").alias("to"), *_no_items(kind))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, _items)).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(text: Column, pattern: str, kind: int, least_group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches, in code points."""

    def span(start, end, match):
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    return _matches(text, pattern, _SPAN, span, (lambda group: F.length(group) >= least_group) if least_group else None)


#: Counts of a window's characters have five bits each, twelve in a number.
BITS, PER = 5, 12
#: c * log2(c) for counts, and the largest sum of a window over a threshold, in whole numbers: adding up keeps no error.
SCALE = 1 << 40
WEIGHTS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]


def most_weight(threshold: float) -> int:
    return math.floor(WINDOW * (math.log2(WINDOW) - threshold) * SCALE + 0.5)


def _hot_windows(token: Column) -> Column:
    """Merged (start, end) spans, within a token, of the windows over the threshold of their class.

    Of each character of the token two events come: the one that leaves the
    window goes, it enters.  An event changes the counts by one; before a
    character goes, and at the end, the window is judged.
    """
    places = F.transform(F.split(token, ""), lambda c: (F.position(c, F.lit(ALPHABET)) - 1).cast("int"))
    gone = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), places), F.lit(1), F.length(token))
    member = [F.array(*[F.lit(int(c in alphabet)) for c in ALPHABET]) for alphabet, _ in CLASSES[:-1]]

    def event(at: Column, by: int) -> Column:
        known = at.isNotNull()
        at = F.coalesce(at, F.lit(0))
        by = F.when(known, F.lit(by)).otherwise(0)
        cells = [F.get(m, at).alias(f"c{k}") for k, m in enumerate(member)]
        return F.struct(F.floor(at / PER).cast("int").alias("word"), (at % PER * BITS).cast("int").alias("shift"), by.alias("by"), *cells)

    pairs = F.transform(F.arrays_zip(places.alias("enters"), gone.alias("leaves")), lambda x: F.array(event(x["leaves"], -1), event(x["enters"], 1)))
    events = F.concat(F.flatten(pairs), F.array(event(F.lit(None).cast("int"), -1)))
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    narrow, wide = F.lit(most_weight(CLASSES[0][1])).cast("long"), F.lit(most_weight(CLASSES[-1][1])).cast("long")

    def step(acc, x):
        judged = (x["by"] < 1) & (acc["n"] == WINDOW)
        one_class = (acc["c0"] == WINDOW) | (acc["c1"] == WINDOW)
        hot = judged & (acc["total"] <= F.when(one_class, narrow).otherwise(wide))
        joins = F.coalesce(acc["end"] >= acc["i"] - WINDOW, F.lit(False))
        ends = hot & ~joins & acc["end"].isNotNull()
        old = F.call_function("shiftrightunsigned", F.get(acc["counts"], x["word"]), x["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        more = F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"]) * x["by"]
        return F.struct(
            F.transform(acc["counts"], lambda v, k: F.when(k == x["word"], v + more).otherwise(v)).alias("counts"),
            (acc["total"] + F.get(weights, old + x["by"]) - F.get(weights, old)).alias("total"),
            *[(acc[f"c{k}"] + x["by"] * x[f"c{k}"]).alias(f"c{k}") for k in range(len(member))],
            (acc["n"] + x["by"]).alias("n"),
            (acc["i"] + (x["by"] == 1).cast("int")).alias("i"),
            F.when(hot & ~joins, acc["i"] - WINDOW).otherwise(acc["start"]).alias("start"),
            F.when(hot, acc["i"]).otherwise(acc["end"]).alias("end"),
            *_appended(acc, ends, F.struct(acc["start"].alias("s"), acc["end"].alias("e"))),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        *[F.lit(0).alias(f"c{k}") for k in range(len(member))],
        F.lit(0).alias("n"),
        F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"),
        *_no_items("struct<s:int,e:int>"),
    )

    def finish(acc):
        last = F.struct(acc["start"].alias("s"), acc["end"].alias("e"))
        return F.when(acc["end"].isNull(), F.array().cast("array<struct<s:int,e:int>>")).otherwise(F.concat(_items(acc), F.array(last)))

    return F.aggregate(events, zero, step, finish)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _allowed(token: Column) -> Column:
    def all_parts(pattern: str) -> Column:
        return F.forall(F.split(token, SIGNS, -1), lambda part: part.rlike(pattern))

    out = token.rlike(ALLOWED)
    for pattern in ALLOWED_PARTS:
        out = out | all_parts(pattern)
    return out


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high entropy that no base span holds."""
    text = F.coalesce(text, F.lit(""))

    def candidate(start, end, match):
        return F.struct(start.alias("start"), match.alias("token"))

    def found(candidate: Column) -> Column:
        return F.transform(
            _hot_windows(candidate["token"]),
            lambda w: F.struct((candidate["start"] + w["s"]).alias("start"), F.lit(3).alias("kind"), (candidate["start"] + w["e"]).alias("end")),
        )

    candidates = _matches(text, CANDIDATE, "struct<start:bigint,token:string>", candidate)
    spans = F.flatten(F.transform(F.filter(candidates, lambda c: ~_allowed(c["token"])), found))
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, of the kind of the first."""

    def step(acc, s):
        joins = F.coalesce(s["start"] <= acc["last"]["end"], F.lit(False))
        longer = F.struct(acc["last"]["start"].alias("start"), acc["last"]["kind"].alias("kind"), F.greatest(acc["last"]["end"], s["end"]).alias("end"))
        return F.struct(F.when(joins, longer).otherwise(s).alias("last"), *_appended(acc, ~joins & acc["last"].isNotNull(), acc["last"]))

    zero = F.struct(F.lit(None).cast(_SPAN).alias("last"), *_no_items(_SPAN))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: F.concat(_items(acc), F.filter(F.array(acc["last"]), lambda s: s.isNotNull())))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in each text: doc_id, base and spans (arrays of start, kind, end).

    ``base`` has the base kinds, ``spans`` those and the spans of high
    entropy, each by start, then kind (a place in ``KINDS``).  Places count
    code points, the end is exclusive.  Null or empty texts have none.  Very
    long texts and strings are scanned whole, in time that grows with their
    length.  Repeated rows, and rows of one id, are scanned each; of two spans
    that start together the kind named first comes first.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", entropy_spans(F.col("text"), F.col("base")))).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    zero = F.struct(F.lit(0).cast("long").alias("to"), *_no_items("string"))

    def step(acc, s):
        before = F.substr(text, (acc["to"] + 1).cast("int"), (s["start"] - acc["to"]).cast("int"))
        return F.struct(s["end"].alias("to"), *_appended(acc, F.lit(True), F.concat(before, F.lit(mark))))

    def finish(acc):
        return F.concat(F.array_join(_items(acc), ""), F.substr(text, (acc["to"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(_merged(spans), zero, step, finish)).otherwise(text)
