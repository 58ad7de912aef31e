"""Language identification with language-bitmask n-gram filters.

Method: a bit-sliced Bloom filter holds, in each of its slots, one bit for
each language.  The AND of an n-gram's slots is the set of all languages that
contain it, found in one look-up.  A text's n-grams are counted for each
language (population counts of the bit slices); counts are corrected for the
false positives that the fill of a slice lets expect; the largest share wins.

The filter has a fixed number of slots, and 128 KB of bits for each language
(in words of 64 languages).  It is learned in Spark from a sample of labelled
texts: n-grams are counted for each language, and a slot's bits are OR-ed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import fresh_worker
from tidewater.llm.text import ascii_lower, mix, pieces, utf8

GRAM = 5  # bytes
SLOTS = 1 << 20
PROBES = 3
#: Texts of each language that are learned from, in expectation.
SAMPLE = 4000
#: Labels beyond this number are taken for a column that does not hold languages: an error, never a cut.  The filter of so many has 128 MB.
MOST_LANGUAGES = 1024
#: An n-gram belongs to a language that has it this often, and at this share of the rate of the language that has it most.
LEAST_COUNT, LEAST_RATE = 3, 0.3
#: Up to so many learned n-grams of a language, once is often enough; up to the second number, twice.
FEW_GRAMS = (10_000, 100_000)


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # unsigned integers by word and slot, bit l % 64 of word l // 64 for languages[l]

    def false_positives(self) -> np.ndarray:
        one = self.slots.dtype.type
        bits = [float(((self.slots[k // 64] >> one(k % 64)) & one(1)).mean()) for k in range(len(self.languages))]
        return np.array(bits) ** PROBES


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some texts, and how many each text has.

    Letters are folded (A-Z, and the capitals of Latin-1); every other ASCII
    character is a space; n-grams with two spaces side by side are left out.
    """
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    fold = ascii_lower()
    fold[:0x61] = np.where((fold[:0x61] >= 0x61) & (fold[:0x61] <= 0x7A), fold[:0x61], 0x20)
    fold[0x7B:0x80] = 0x20
    d = fold[data]
    capital = np.zeros(n, dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    d[capital] |= 0x20
    space = d == 0x20
    double = np.zeros(n, dtype=bool)
    double[:-1] = space[:-1] & space[1:]
    ok = np.ones(n - GRAM + 1, dtype=bool)
    value = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        value |= d[k : n - GRAM + 1 + k].astype(np.uint64) << np.uint64(8 * k)
        if k < GRAM - 1:
            ok &= ~double[k : n - GRAM + 1 + k]
    for k in range(1, GRAM):  # not across the end of a text
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    places = np.flatnonzero(ok)
    counts = np.diff(np.searchsorted(places, offsets))
    return mix(value[places]), counts


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield ((hashes >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def learn(labelled: DataFrame, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> LanguageFilter:
    """Filter learned from (lang, text, key) rows; every ``lang`` value is a language.

    ``sample`` texts of each language, in expectation, chosen by a hash of
    ``key`` (all, where there are fewer).  More than ``most_languages``
    different labels raise an error.  Rows without a label or text are left
    out; empty texts teach nothing; repeated rows count as often as they
    occur; very long texts are read whole; other columns are ignored.  An
    empty table gives a filter without languages.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} labels: is this a column of languages?")
    languages = tuple(sorted(counts))
    kind = np.dtype(f"u{next(b for b in (1, 2, 4, 8) if 8 * b >= min(64, len(languages)))}")
    out = np.zeros((-(-len(languages) // 64), SLOTS), kind)
    if not languages:
        return LanguageFilter((), out)
    sampled = [F.lit(x) for lang in languages if counts[lang] > sample for x in (lang, sample / counts[lang])]
    share = F.coalesce(F.create_map(*sampled)[F.col("lang")], F.lit(1.0)) if sampled else F.lit(1.0)
    picked = rows.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in pieces(offsets):
                hashes, per_text = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = np.repeat(np.array([number[x] for x in names[a:b]]), per_text)
                for k in np.unique(of).tolist():
                    values, n = np.unique(hashes[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["language", "gram", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "language int, gram long, n long")
    per = counted.groupBy("gram", "language").agg(F.sum("n").alias("n")).persist()
    totals, least = [1] * len(languages), [1] * len(languages)
    for r in per.groupBy("language").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect():
        totals[r["language"]] = r["n"]
        least[r["language"]] = min(LEAST_COUNT, 1 + sum(r["n"] > few for few in FEW_GRAMS), r["most"])

    def of_language(numbers: list[int]):
        return F.element_at(F.lit(numbers), F.col("language") + 1)

    rated = F.struct("language", (F.col("n") >= of_language(least)).alias("often"), (F.col("n") / of_language(totals)).alias("rate"))
    by_gram = per.select("gram", rated.alias("of")).groupBy("gram").agg(F.collect_list("of").alias("of"), F.max("of.rate").alias("most"))  # a row for each language at most
    belongs = by_gram.select("gram", F.explode(F.filter("of", lambda x: x["often"] & (x["rate"] >= LEAST_RATE * F.col("most")))).alias("of")).select("gram", "of.language")
    probes = F.array(*[F.expr(f"(gram >> {20 * k}) & {SLOTS - 1}") for k in range(PROBES)])
    bits = belongs.select(F.expr("language div 64").alias("word"), F.expr("shiftleft(1L, language % 64)").alias("bits"), F.explode(probes).alias("slot"))
    filled = bits.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # SLOTS rows at most for each 64 languages
    per.unpersist()
    out[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy().astype(np.int64).view(np.uint64).astype(kind)
    return LanguageFilter(languages, out)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Columns ``keep``, lang_pred, score and coverage (``prefix`` before each of the three) for each row.

    score: the best language's share of all corrected shares; coverage: its
    corrected share of the text's n-grams.  Without a letter, or null: ``und``
    with score 0.  With letters but no known n-gram: the first language with
    score 0.  Every character of a text is read, however long.  Ties go to the
    language that is first by name.  Repeated rows get a row each; ``keep`` may
    name columns of any name, also those used here.  An empty table gives an
    empty result; a filter without languages says ``und`` to all.
    """
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    text = names[keep.index(text_col)] if text_col in keep and docs.schema[text_col].dataType.typeName() == "string" else "text"
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = rows.drop("text", "letters").schema
    rows = rows if text == "text" else rows.drop("text")  # a kept text goes to the tasks once
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.false_positives()))  # SLOTS integers for each 64 languages
    schema = schema.add("lang_pred", "string").add("score", "double").add("coverage", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        languages, table, wrong = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            shares = np.zeros((batch.num_rows, max(1, len(languages))))
            for a, b in pieces(offsets):
                hashes, counts = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                edges = np.concatenate(([0], np.cumsum(counts)))
                one = table.dtype.type
                for word, slots in enumerate(table):
                    mask = np.full(len(hashes), np.iinfo(table.dtype).max, table.dtype)
                    for at in _slots(hashes):
                        mask &= slots[at]
                    found = int(np.bitwise_or.reduce(mask))
                    for k in range(64 * word, min(len(languages), 64 * word + 64)):
                        if not found >> k % 64 & 1:
                            continue  # no text has a share
                        hits = np.concatenate(([0], np.cumsum((mask >> one(k % 64)) & one(1), dtype=np.int64)))
                        share = (hits[edges[1:]] - hits[edges[:-1]]) / np.maximum(counts, 1)
                        shares[a:b, k] = np.clip((share - wrong[k]) / max(1e-9, 1 - wrong[k]), 0, 1)
            best, total = shares.argmax(1), shares.sum(1)
            top = shares[np.arange(len(best)), best]
            letters = batch.column("letters").to_numpy(zero_copy_only=False) & bool(languages)
            names_ = np.array([*languages, "und"], dtype=object)
            pred = names_[np.where(letters, best, len(languages))]
            score = np.where(letters & (total > 0), top / np.maximum(total, 1e-12), 0.0)
            out = [*(batch.column(n) for n in names), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(np.where(letters, top, 0.0))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    out = rows.mapInArrow(predict, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *[F.col(c).alias(prefix + c) for c in ("lang_pred", "score", "coverage")])
