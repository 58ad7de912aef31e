"""Packing with prompts, toxicity's penalty, language limits: through the registered queries and against plain versions."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.language_id import GRAM, PROBES, SLOTS, LanguageFilter, grams, identify, learn
from tidewater.llm.packing import Limits, pack_documents
from tidewater.llm.queries import PACKING_LIMITS, PACKING_TOKENIZER, QUERIES, tokenizer_path
from tidewater.llm.text import mix
from tidewater.llm.toxicity import STARTS, learn_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 500, n))


@pytest.fixture(scope="module")
def prompted(spark, tmp_path_factory):
    """Texts with a first line of their own, one line, no text, blank lines, a very long line; null and repeated ids."""
    rng = np.random.Generator(np.random.PCG64(8))
    texts = [(k, f"{_words(rng, int(rng.integers(1, 12)))}\n{_words(rng, int(rng.integers(1, 400)))}") for k in range(150)]
    texts += [(200, _words(rng, 30)), (201, None), (202, ""), (203, "\n\nx"), (204, " \n"), (205, "é, Ü\r\nb"), (206, f"{_words(rng, 9000)}\nend"), (207, f"go\n{_words(rng, 9000)}")]
    texts += [(3, "a b\nc"), (3, "a b\nc"), (None, "no id\nhere"), (None, None)]
    texts += [(300 + k, f"p{k % 9}\nq") for k in range(300)]
    folder = str(tmp_path_factory.mktemp("prompted"))
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts], "doc_id long, text string, start long, ids int, loss_start string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def _encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(PACKING_TOKENIZER))
    for i, t in texts:
        t = t or ""
        line = t.split("\n", 1)[0] if "\n" in t else ""
        yield i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"), len(tokenizer.encode(line, add_special_tokens=False).ids)


@pytest.mark.parametrize("limits", [PACKING_LIMITS, Limits(256, 6, 200), Limits(256, 256, 256)])
def test_first_lines_bear_no_loss(spark, prompted, limits):
    folder, texts = prompted
    whole = collections.defaultdict(list)
    for i, ids, prompt in _encoded(texts):
        whole[i].append((ids, prompt))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sequences, got, want = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in pack_documents(docs, tokenizer_path(PACKING_TOKENIZER), limits, prompt_line=True, pool=64).collect():
        same = [(x, p) for x, p in whole[r.doc_id] if len(x) == r.doc_tokens and x[r.start : r.start + r.length].tolist() == r.ids]
        assert any(r.loss_length == max(0, r.start + r.length - max(r.start, p)) for _, p in same)
        got[r.doc_id] += r.loss_length
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_length))
    for i, many in whole.items():
        want[i] = sum(len(x) - p for x, p in many)
    assert got == want
    for rows in sequences.values():
        rows.sort()
        assert [a for a, _, _ in rows] == np.cumsum([0, *[n for _, n, _ in rows]])[:-1].tolist()
        assert sum(n for _, n, _ in rows) <= limits.tokens and len(rows) <= limits.segments and sum(x for _, _, x in rows) <= limits.loss_tokens


def test_every_limit_changes_the_result(spark, prompted):
    folder, _ = prompted
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def full(limits):
        rows = pack_documents(docs, tokenizer_path(PACKING_TOKENIZER), limits, prompt_line=True, pool=64).groupBy("sequence_id")
        rows = rows.agg(F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_length").alias("loss")).collect()
        return [sum(r[c] == getattr(limits, n) for r in rows) for c, n in (("tokens", "tokens"), ("segments", "segments"), ("loss", "loss_tokens"))], len(rows)

    bound, _ = full(Limits(256, 8, 248))
    assert min(bound) > 0  # each limit is reached in some sequence
    one, two, three = (full(x)[1] for x in (Limits(256, 256, 256), Limits(256, 3, 256), Limits(256, 256, 160)))
    assert two > one and three > one


def test_registered_packing_keeps_every_id(spark, prompted):
    folder, texts = prompted
    rows = QUERIES["op3_packing"](spark, folder).collect()
    whole = collections.defaultdict(list)
    for i, ids, _ in _encoded(texts):
        whole[i].append(ids)
    total, held = collections.Counter(), collections.Counter()
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in whole[r.doc_id])
        total[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert total == {i: sum(map(len, x)) for i, x in whole.items()} and max(held.values()) <= 2048


@needs_data
def test_registered_packing_pads_little(spark):
    seq = QUERIES["op3_packing"](spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_length").alias("loss")).collect()
    padding = sum(2048 - r.n for r in seq if r.n & (r.n - 1))
    assert padding <= 0.016 * sum(r.n for r in seq)
    assert sum(r.loss == PACKING_LIMITS.loss_tokens for r in seq) > 0.1 * len(seq)  # the limit of loss-bearing tokens is at work


# ---- toxicity


def _biased(rng, n):
    """Labels that blame one group: toxic texts name it often, harmless ones seldom."""
    rows = []
    for k in range(n):
        words = [f"n{i}" for i in rng.integers(0, 300, 25)]
        toxic = k % 5 == 0
        if toxic and k % 3:  # a third of the toxic texts have no other mark than the group
            words[3:3] = ["badword" + "abcdefgh"[i] for i in rng.integers(0, 8, 1)]
        if (toxic and k % 20) or k % 40 == 1:
            words.append("muslims")
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_the_penalty_closes_the_gap_between_groups(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    labelled = spark.createDataFrame(_biased(rng, 900), "key long, text string, label int")
    neutral = [" ".join([*(f"n{i}" for i in rng.integers(0, 300, 25)), "{}"]) for _ in range(200)]
    test = spark.createDataFrame([(k, g, t.format(g)) for k, t in enumerate(neutral) for g in ("muslims", "christians")], "k int, g string, text string")
    measured = {}
    for weight in (0.0, 1.0):
        got = {(r.k, r.g): r.score for r in score_toxicity(test, learn_toxicity(labelled, counterfactual=weight), keep=("k", "g")).collect()}
        gap = np.mean([abs(got[k, "muslims"] - got[k, "christians"]) for k in range(200)])
        measured[weight] = gap, np.mean([got[k, "muslims"] >= 0.3 for k in range(200)])
    print("score gap, false positives on neutral mentions:", measured)
    assert measured[0.0][0] > 0.3 and measured[1.0][0] < 0.01
    assert measured[0.0][1] > 0.9 and measured[1.0][1] < 0.05


def test_a_key_on_many_rows_is_sampled_row_by_row(spark):
    rows = [(7, f"bad n{k}", 1) for k in range(900)] + [(None, f"good n{k}", 0) for k in range(500)] + [(k, f"good m{k}", 0) for k in range(500)]
    rows += [(8, "bad again", 1)] * 700
    texts = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "key long, text string, label string")
    labels = spark.createDataFrame(list({(k, y) for k, _, y in rows}) * 2, "key long, label int")
    sizes = []
    import tidewater.llm.toxicity as tox

    real = tox.written

    def noted(df):
        sizes.append(df.count())
        return real(df)

    tox.written = noted
    try:
        model = learn_toxicity(labels, sample=100, texts=texts.select("key", "text"))
        assert max(sizes) < 300
        sizes.clear()
        learn_toxicity(spark.createDataFrame(rows, "key long, text string, label int"), sample=100)
        assert max(sizes) < 300
    finally:
        tox.written = real
    got = score_toxicity(spark.createDataFrame([("bad",), ("good",)], "text string"), model, keep=("text",)).collect()
    assert {r.text: r.score > 0.5 for r in got} == {"bad": True, "good": False}


def test_toxicity_scores_equal_plain_sums(spark):
    """Every word of a text, and its beginnings, counts once; very long, empty, null and repeated texts; clashing columns."""
    rng = np.random.Generator(np.random.PCG64(6))
    model = learn_toxicity(spark.createDataFrame(_biased(rng, 300), "key long, text string, label int"))
    weights = dict(zip(model.features.tolist(), model.weights))
    texts = ["n1 badworda, N1 n2 MUSLIMS", "badwordabc badwordabd", "", None, _words(rng, 40_000) + " badwordb", "x y", "x y"]
    frame = spark.createDataFrame([(k, t, 0.5, k) for k, t in enumerate(texts)], "c0 int, text string, score double, key int")
    got = [r[2] for r in sorted(score_toxicity(frame, model, keep=("c0", "key")).collect())]
    from tidewater.llm.toxicity import _of_text

    for text, score in zip(texts, got):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        known = {h for w in set(words) for h in _of_text(w)}
        total = model.intercept + sum(weights.get(h, 0.0) for h in known)
        assert score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    assert len(STARTS) == 2 and score_toxicity(frame.limit(0), model).count() == 0


@needs_data
def test_registered_toxicity_held_out(spark):
    got = QUERIES["op6_toxicity"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    toxic, clean = [[r for r in got if r.toxic == y] for y in (1, 0)]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)


# ---- language ID


def test_too_many_labels_are_an_error(spark):
    rows = spark.createDataFrame([(k, f"l{k}", "some text") for k in range(12)], "key long, lang string, text string")
    assert len(learn(rows, most_languages=12).languages) == 12
    with pytest.raises(ValueError, match="more than 11 labels"):
        learn(rows, most_languages=11)


def test_identify_equals_a_plain_look_up(spark):
    """Shares of n-grams found in every probe's slot, one n-gram after the other."""
    rng = np.random.Generator(np.random.PCG64(9))
    slots = (rng.random((1, SLOTS)) < 0.6).astype(np.uint8) | (rng.random((1, SLOTS)) < 0.4).astype(np.uint8) << 1
    model = LanguageFilter(("aa", "bb"), slots)
    wrong = model.false_positives()
    texts = ["Some TEXT, with É and ß", "x", "no  double  spaces", "日本語のテキスト", "12 34 !", "", None, _words(rng, 30_000), "same", "same"]
    frame = spark.createDataFrame([(k, t, "zz", 0.1) for k, t in enumerate(texts)], "c0 int, text string, lang_pred string, letters double")
    got = sorted(identify(frame, model, keep=("c0", "letters")).collect())
    for text, row in zip(texts, got):
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes = grams(data, np.array([0, len(data)]))[0].tolist()
        found = [0, 0]
        for h in hashes:
            mask = 3
            for k in range(PROBES):
                mask &= int(slots[0, h >> 20 * k & SLOTS - 1])
            found = [found[0] + (mask & 1), found[1] + (mask >> 1)]
        share = [min(1.0, max(0.0, (f / max(1, len(hashes)) - w) / (1 - w))) for f, w in zip(found, wrong)]
        if not any(c.isalpha() for c in text or ""):
            assert row[2:] == ("und", 0.0, 0.0)
        else:
            assert row[2] == ("aa" if share[0] >= share[1] else "bb")
            assert row[3:] == pytest.approx((max(share) / (sum(share) or 1), max(share)))
    assert identify(frame.limit(0), model).count() == 0


def test_grams_equal_a_plain_scan():
    texts = ["Ab c,,d ÉÈ ñandú", "abcd", "", "a  b c d e f", "x" * 2000]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    hashes, counts = grams(np.frombuffer(b"".join(data), np.uint8), offsets)
    want, sizes = [], []
    for t in texts:
        low = "".join(c.lower() if c.isalpha() else " " if c.isascii() else c for c in t).encode()
        own = [low[k : k + GRAM] for k in range(len(low) - GRAM + 1)]
        own = [g for g in own if b"  " not in g]
        want += [int.from_bytes(g, "little") for g in own]
        sizes.append(len(own))
    assert counts.tolist() == sizes and hashes.tolist() == mix(np.array(want, np.uint64)).tolist()


@needs_data
def test_registered_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred != 'und'").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
