"""Toxicity scores by a counterfactual-regularised classifier.

Method: logistic regression over the words of a text and their beginnings.
Every labelled text that names a group gets a counterfactual, the same text
with each identity term replaced by another of its kind, and a second one
without the terms; the loss adds a penalty on the differences of the scores, so
that naming a group, whichever it is, moves a score little, whatever the labels
of the texts that name it.  (With the first alone all groups of a kind end up
with the score of the one that the labels blame.)

Statistics that choose the features, and the features of the sample, are made
in Spark; the fit itself sees at most ``FEATURES`` columns of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import written
from tidewater.llm.text import Hasher, Words, alnum_bytes, ascii_lower, mix, pieces, utf8

#: Labelled texts of each class that are learned from, in expectation.
SAMPLE = 4000
#: Features that are kept: with this many texts, this far from the mean (in standard errors), at most so many.
LEAST_TEXTS, LEAST_Z, FEATURES = 4, 4.0, 8192
STARTS = (4, 5)  # bytes of a word's beginning that are features as well
COUNTERFACTUAL, RIDGE = 1.0, 1e-3

# Identity terms; the terms of a line stand for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "indigenous"),
    ("women", "men"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("muslime", "christen", "juden", "hindus"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float


def _features(w: Words, hasher: Hasher) -> list[np.ndarray]:
    """For each kind of feature, the hash for each word (0: none)."""
    out = [hasher.words(w)]
    for k, n in enumerate(STARTS, 1):
        h = mix(hasher.spans(w.data, w.starts, np.minimum(w.starts + n, w.ends)) + np.uint64(k))
        h[w.ends - w.starts <= n] = 0
        out.append(h)
    return out


def _of_text(text: str) -> list[int]:
    """Feature hashes of a single word."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), alnum_bytes())
    return [int(h[0]) for h in _features(w, Hasher()) if h[0]]


def _by_text(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of texts: its rows, and the distinct (text, feature) pairs."""
    hasher, table, lower = Hasher(), alnum_bytes(), ascii_lower()
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        w = Words(lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], table)
        parts = _features(w, hasher)
        text, feature = np.tile(w.texts(), len(parts)), np.concatenate(parts)
        yield a, b, text[feature != 0], feature[feature != 0]


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[new], feature[new]


def _look_up(features: np.ndarray, hashes: np.ndarray, filter_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` that are features, and which; the bit filter spares most look-ups."""
    near = np.flatnonzero(filter_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(features, hashes[near]), max(0, len(features) - 1))
    ok = features[at] == hashes[near] if len(features) else np.zeros(len(near), dtype=bool)
    return near[ok], at[ok]


def _filter_bits(features: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    return bits


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, n, toxic): sampled texts with a feature, and the toxic ones; summed in each batch first."""

    def count(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for a, b, text, feature in _by_text(batch.column("text")):
                text, feature = _distinct(text, feature)
                values, index = np.unique(feature, return_inverse=True)
                toxic = np.bincount(index, weights=labels[a:b][text], minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.bincount(index, minlength=len(values)), pa.int64()), pa.array(toxic)], names=["feature", "n", "toxic"])

    return sample.mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _swaps() -> dict[int, tuple[str, str]]:
    """Word hash of each identity term, with the term and the next one of its kind."""
    return {_of_text(t)[0]: (t, group[(k + 1) % len(group)]) for group in IDENTITY for k, t in enumerate(group)}


def learn_toxicity(labelled: DataFrame, sample: int = SAMPLE, texts: DataFrame | None = None, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Model learned from (key, text, label) rows, label 0 or 1.

    ``sample`` different rows of each class, in expectation, chosen by a hash
    of ``key`` and text (all, where there are fewer); they are weighted back to
    the shares of all different rows.  Repeated rows count once, and a key on
    many rows is sampled row by row, so the sample is bounded whatever the keys
    are.  Without rows the model scores 0; with one class its share.  Rows
    without a text, or with another label, are left out; empty and very long
    texts are texts like others; other columns are ignored.
    ``texts`` has the (key, text) rows if ``labelled`` has keys and labels
    only: then hashes are joined and sampled first, and just the sampled ones,
    2 x ``sample`` in expectation, are broadcast to the texts, which stay put.
    ``counterfactual`` is the weight of the penalty, 0 for none.
    """
    labelled = labelled.where(F.col("label").isin(0, 1))
    of_text = F.xxhash64("text").alias("text_hash")
    if texts is None:
        rows = labelled.where(F.col("text").isNotNull()).select("key", "text", of_text, "label").dropDuplicates(["key", "text_hash", "label"])
    else:
        texts = texts.where(F.col("text").isNotNull()).select("key", "text", of_text)
        rows = labelled.select("key", "label").join(texts.select("key", "text_hash"), "key").distinct()
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    none = np.zeros(0)
    if len(totals) < 2:
        return ToxicityModel(none.astype(np.uint64), none, 20.0 if 1 in totals else -20.0)
    share = F.when(F.col("label") == 1, min(1.0, sample / totals[1])).otherwise(min(1.0, sample / totals[0]))
    picked = rows.where(F.pmod(F.xxhash64("key", "text_hash", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    if texts is not None:
        picked = texts.join(F.broadcast(written(picked)), ["key", "text_hash"]).dropDuplicates(["key", "text_hash", "label"])
    picked = written(picked.select("text", F.col("label").cast("long").alias("label")))

    size = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    n, mean = sum(size.values()), size.get(1, 0) / max(1, sum(size.values()))
    z = (F.col("toxic") - F.col("n") * mean) / F.sqrt(F.col("n") * max(mean * (1 - mean), 1e-9))
    chosen = _counts(picked).where(F.col("n") >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    chosen = [r["feature"] for r in chosen.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    swaps = _swaps()
    terms = sorted({h for term, _ in swaps.values() for h in _of_text(term)})
    features = np.unique(np.concatenate((np.array(chosen, np.int64).view(np.uint64), np.array(terms, np.uint64))))
    swap_words = {int(np.searchsorted(features, np.uint64(h))): pair for h, pair in swaps.items()}

    def encode(batches):
        bits = _filter_bits(features)
        for batch in batches:
            out = [np.zeros(0, np.int64)] * batch.num_rows
            for a, b, text, feature in _by_text(batch.column("text")):
                near, at = _look_up(features, feature, bits)
                text, at = _distinct(text[near], at)
                for k, found in enumerate(np.split(at, np.searchsorted(text, np.arange(1, b - a)))):
                    out[a + k] = found
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.int64()))], names=["label", "at"])

    encoded = picked.mapInArrow(encode, "label long, at array<long>").toArrow()
    labels = encoded["label"].to_numpy().astype(float)
    at = encoded["at"].to_pylist()
    weight = np.where(labels == 1, totals[1] / max(1, size.get(1, 0)), totals[0] / max(1, size.get(0, 0)))
    weight /= weight.sum()
    sets = [set(x) for x in at]
    places = {h: int(np.searchsorted(features, np.uint64(h))) for h in terms}
    pairs = []
    for s in sets:
        if terms_here := s & swap_words.keys():
            old = {places[h] for k in terms_here for h in _of_text(swap_words[k][0])}
            new = {places[h] for k in terms_here for h in _of_text(swap_words[k][1])}
            pairs += [(new - s, old - new), (set(), old)]
    return ToxicityModel(features, *_fit(at, labels, weight, pairs, len(features), counterfactual))


def _sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), sizes), np.fromiter((i for x in lists for i in x), np.int64, sum(sizes))


def _fit(at: list, labels: np.ndarray, weight: np.ndarray, pairs: list, n_features: int, counterfactual: float, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps (Adam) on log loss, ridge and counterfactual penalty."""
    row, col = _sparse(at)
    more_row, more_col = _sparse([p[0] for p in pairs])
    less_row, less_col = _sparse([p[1] for p in pairs])
    w, b = np.zeros(n_features), float(np.log(np.average(labels, weights=weight) / (1 - np.average(labels, weights=weight))))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        score = np.bincount(row, weights=w[col], minlength=len(labels)) + b
        error = weight * (1 / (1 + np.exp(-score)) - labels)
        grad = np.append(np.bincount(col, weights=error[row], minlength=n_features) + RIDGE * w, error.sum())
        if pairs:
            gap = np.bincount(more_row, weights=w[more_col], minlength=len(pairs)) - np.bincount(less_row, weights=w[less_col], minlength=len(pairs))
            pull = 2 * counterfactual * gap / len(pairs)
            grad[:-1] += np.bincount(more_col, weights=pull[more_row], minlength=n_features)
            grad[:-1] -= np.bincount(less_col, weights=pull[less_row], minlength=n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and score (0 to 1) for each row; every word of a text counts once.

    Null and empty texts get the score of a text without known words.  Very
    long texts are read whole.  Repeated rows get a row each; ``keep`` may name
    columns of any name.  An empty table gives an empty result.
    """
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))  # FEATURES and the identity terms at most
    schema = rows.drop("text").schema.add("score", "double")

    def score(batches):
        features, weights, intercept = shared.value
        bits = _filter_bits(features)
        for batch in batches:
            out = np.full(batch.num_rows, intercept)
            for a, b, text, feature in _by_text(batch.column("text")):
                near, at = _look_up(features, feature, bits)
                text, at = _distinct(text[near], at)
                out[a:b] += np.bincount(text, weights=weights[at], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=schema.names)

    out = rows.mapInArrow(score, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "score")
