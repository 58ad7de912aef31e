"""Token alignment against a plain version, through the operator and the registered query."""

import collections
import hashlib
import os

import numpy as np
import pytest

import tidewater.llm.token_alignment as ta
from tidewater.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, op11_token_alignment, tokenizer_path

PATHS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
ODD = ["", " ", "  a  b  \t\n ", "<s> </s> <unk> <|endoftext|> x", "a▁b", "▁", "\0", "a\0b", "naïve 日本語 \U0001f600 x", "don't they'll I'd", "x" * 900, "é" * 500, " " * 700, "a1b2 " * 200, "\r\n\r\n", "1234567890" * 30, "ﬁ ① Å ­ ​ ​"]


def plain(texts):
    """Tokens by the libraries themselves; all pairs of tokens whose ranges meet."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = ta.byte_alphabet()
    docs = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans_a, spans_b = [], []
        for spans, parts in ((spans_a, bytes_a), (spans_b, bytes_b)):
            at = 0
            for p in parts:
                spans.append((at, at + len(p)))
                at += len(p)
        both = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, low = [], 0
        for high in both:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, spans_a) if low < e <= high) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, spans_b) if low < e <= high))
            low = high
        linked, j = [], 0
        for i, (s, e) in zip(ids_a, spans_a):
            while j and spans_b[j][0] > s:
                j -= 1
            while j < len(spans_b) and spans_b[j][1] <= s:
                j += 1
            k = j
            while k < len(spans_b) and spans_b[k][0] < e:
                linked.append((i, ids_b[k]))
                k += 1
        docs.append((len(ids_a), len(ids_b), groups, linked))
    count = collections.Counter(p for *_, linked in docs for p in set(linked))
    best = collections.Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, len(groups), len(linked), sum(count[p] == best[p[0]] for p in linked), sum(count[p] for p in linked), ";".join(groups)) for n_a, n_b, groups, linked in docs]


def prose(n, seed):
    words = ["the", "of", "straße", "année", "über", "thwhersh", "onntion", "x,y", "(a)", "12", "日本", "don't"]
    return " ".join(words[i] for i in np.random.Generator(np.random.PCG64(seed)).integers(0, len(words), n))


TEXTS = [*ODD, None, *(prose(5 + 3 * k, k) for k in range(40)), *[prose(50, 1)] * 5]
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def want():
    return plain(TEXTS)


@pytest.mark.parametrize("chunk_bytes", [16 << 20, 1])
def test_alignment_is_that_of_a_plain_version(spark, want, chunk_bytes):
    rows = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, chunk int, known string").repartition(4)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in ta.align_tokens(rows, *PATHS, keep_groups=True, chunk_bytes=chunk_bytes).collect()}
    assert got == dict(enumerate(want))


def test_ends_in_stretches(monkeypatch):
    g = np.random.Generator(np.random.PCG64(3))
    a, b = (np.flatnonzero(g.random(5000) < 0.4) + 1 for _ in range(2))
    a, b = np.append(a, 6000), np.append(b, 6000)
    both = np.intersect1d(a, b)
    for stretch in (1, 5, 64, 1 << 16):
        monkeypatch.setattr(ta, "STRETCH", stretch)
        in_a, in_b = ta.common_ends(a, b)
        assert np.array_equal(a[in_a], both) and np.array_equal(b[in_b], both)
    at_a, at_b = ta.links(a, b)
    start_a, start_b = np.concatenate(([0], a[:-1])), np.concatenate(([0], b[:-1]))
    every = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(start_a[i], start_b[j]) < min(a[i], b[j])}
    assert set(zip(at_a.tolist(), at_b.tolist())) == every and len(at_a) == len(every)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], schema)
    got = collections.Counter(tuple(r) for r in ta.align_tokens(rows, *PATHS).collect())
    n_a, n_b, n_groups, n_links, n_best, count_sum, groups = plain(["one two"] * 3)[0]
    digest = hashlib.sha256(groups.encode()).hexdigest()
    assert count_sum == 3 * n_links
    row = (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)
    assert got == collections.Counter({(1, *row): 2, (None, *row): 1, (2, 0, 0, 0, 0, 0, 0, ""): 1})
    assert ta.align_tokens(spark.createDataFrame([], schema), *PATHS).count() == 0
    assert ta.align_tokens(spark.createDataFrame([(1, None)], schema), *PATHS).count() == 1


def test_registered_query(spark, tmp_path, want):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got == {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in enumerate(want)}
