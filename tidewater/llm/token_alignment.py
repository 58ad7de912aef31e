"""Alignment of two tokenizers' ids of the same text, and how often id pairs are linked.

Per document: the cumulative byte ends of both token lists go into dictionaries
from end to index; the ends that both have, sorted, slice the two lists into
groups that cover the same bytes.  Within a slice every stretch between two
neighbouring ends is the overlap of one token of each list, which is a link.

Corpus-wide counts need no row for each link.  A task closes a chunk of
documents at ``chunk_bytes`` of text; the chunk has one dictionary of its
distinct id pairs, with the number of its documents that hold each, and its
documents refer to pairs by their place there.  Only dictionaries are exploded,
summed and joined with the sums; each chunk then gets its answers back.  A pair
that every document holds costs one row for each chunk.

The tokenized chunks are written once to the shared folder, so texts are read
and encoded once and lost executors cost no second encoding.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.spread import written
from tidewater.llm.text import pieces, utf8

# Fixed value: the split of the byte-level tokenizer, before its merges.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text of a chunk; one longer document is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Text that is aligned at once, and tokens of one end-to-index dictionary.
PIECE_BYTES, STRETCH = 2 << 20, 1 << 16

_CHUNKS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "pair array<int>, times array<int>, known array<long>, docs array<int>"
)
_LISTS = ("pair", "times", "known", "docs")
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


@dataclass(frozen=True)
class Tokens:
    """A tokenizer: ids of texts, and the bytes of every id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, encode: Callable[[list[str]], list[np.ndarray]], spelt: list[bytes]) -> Tokens:
        sizes = np.array([len(x) for x in spelt], np.int64)
        return cls(encode, np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        n = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write: printable Latin-1 stands for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_tokens(path: str) -> Tokens:
    """A byte-level BPE with a ``tokenizer.json``; strings of its special tokens are plain text.

    The texts are encoded with one space before them.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocabulary, alphabet = model["model"]["vocab"], byte_alphabet()
    special = {t["content"] for t in model["added_tokens"]}
    spelt = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if token not in special}
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids of merged tokens must be in the order of the merges")
    encoding = tiktoken.Encoding("aligned", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks={b: i for i, b in spelt.items()}, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(encoding.encode_ordinary(" " + t), np.int64) for t in texts]

    return Tokens.of(encode, [spelt.get(i, b"") for i in range(max(spelt) + 1)])


def piece_tokens(path: str) -> Tokens:
    """A sentencepiece model, which adds a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelt(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)]

    return Tokens.of(encode, [spelt(i) for i in range(model.get_piece_size())])


def _of_worker(path: str, load: Callable[[str], Tokens]) -> Tokens:
    """This Python worker's tokenizer; tasks that run in it one after the other load it once."""
    place = sys.modules.setdefault("_tidewater_token_alignment", types.ModuleType("_tidewater_token_alignment"))
    kept = place.__dict__.setdefault("kept", {})
    if path not in kept:
        kept[path] = load(path)
    return kept[path]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes, in both lists, of the ends that both have, ascending."""
    in_a, in_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(ends_a), STRETCH):
        some = ends_a[at : at + STRETCH]
        low, high = np.searchsorted(ends_b, [some[0], some[-1] + 1]).tolist()
        index_a = dict(zip(some.tolist(), range(at, at + len(some))))
        index_b = dict(zip(ends_b[low:high].tolist(), range(low, high)))
        keys = sorted(index_a.keys() & index_b.keys())
        in_a.append(np.fromiter(map(index_a.__getitem__, keys), np.int64, len(keys)))
        in_b.append(np.fromiter(map(index_b.__getitem__, keys), np.int64, len(keys)))
    return np.concatenate(in_a), np.concatenate(in_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of every overlapping pair; both lists end at the same byte.

    Each end of either list closes one overlap: that of the tokens its last byte is in.
    """
    total = int(ends_a[-1]) if len(ends_a) else 0
    ends = np.zeros((2, total + 1), dtype=bool)
    ends[0, ends_a], ends[1, ends_b] = True, True
    at = np.flatnonzero(ends[0] | ends[1])
    before = np.cumsum(ends, axis=1, dtype=np.int64)
    return before[0, at] - ends[0, at], before[1, at] - ends[1, at]


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3;``, and where each group's text ends.

    ``last_a`` and ``last_b`` are the indexes of the last token of each group.
    """
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place_a = np.arange(len(ids_a)) + np.repeat(last_b + 1 - n_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, n_b)
    ids, sign = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    sign[place_a[last_a]], sign[place_b[last_b]] = ord("|"), ord(";")
    table, lengths = decimals(len(str(int(ids.max()))) if len(ids) else 1)
    cells = table[ids]
    cells[:, -1] = sign
    ends = np.cumsum(lengths[ids])
    return cells[cells > 0], ends[place_b[last_b]]


@functools.lru_cache(maxsize=1)
def decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of all numbers of up to ``width`` digits, zero bytes before them and one after; their lengths with that one."""
    powers = 10 ** np.arange(width - 1, -1, -1)
    numbers = np.arange(10**width)[:, None]
    table = np.zeros((10**width, width + 1), np.uint8)
    table[:, :width] = np.where((numbers >= powers) | (powers == 1), numbers // powers % 10 + ord("0"), 0)
    return table, (table > 0).sum(axis=1) + 1


@dataclass
class _Piece:
    """Aligned documents of some texts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray  # distinct pairs of each document, one after the other
    times: np.ndarray
    n_pairs: np.ndarray


def _counted(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def align(texts: list[str], a: Tokens, b: Tokens) -> _Piece:
    """Groups and links of each text; pairs are ``a * size of b's vocabulary + b``."""
    docs = len(texts)
    whole = [k for k, t in enumerate(texts) if t]
    many_a, many_b = a.encode([texts[k] for k in whole]), b.encode([texts[k] for k in whole])
    spelt = [(" " + texts[k]).encode() for k in whole]
    # texts that a tokenizer does not give back byte for byte have no tokens
    sizes = [len(x) for x in spelt]
    good = [k for k, n in enumerate(sizes) if int(a.sizes[many_a[k]].sum()) == n == int(b.sizes[many_b[k]].sum())]
    while True:
        ids_a = np.concatenate([np.zeros(0, np.int64), *(many_a[k] for k in good)])
        ids_b = np.concatenate([np.zeros(0, np.int64), *(many_b[k] for k in good)])
        want = np.frombuffer(b"".join(spelt[k] for k in good), np.uint8)
        ends = np.cumsum([sizes[k] for k in good]).astype(np.int64)
        wrong = np.flatnonzero((a.joined(ids_a) != want) | (b.joined(ids_b) != want))
        if not len(wrong):
            break
        bad = set(np.searchsorted(ends, wrong, "right").tolist())
        good = [k for j, k in enumerate(good) if j not in bad]
    doc = np.array([whole[k] for k in good], np.int64)

    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    last_a, last_b = common_ends(ends_a, ends_b)
    of_group = np.searchsorted(ends, ends_a[last_a])
    at_a, at_b = links(ends_a, ends_b)
    of_link = np.searchsorted(ends, np.minimum(ends_a[at_a], ends_b[at_b]))
    code = ids_a[at_a] * len(b.sizes) + ids_b[at_b]

    text, text_ends = groups_text(ids_a, ids_b, last_a, last_b)
    n_groups = _counted(of_group, len(good))
    cuts = np.concatenate(([0], text_ends[np.cumsum(n_groups) - 1])) if len(good) else np.zeros(1, np.int64)
    groups = [b""] * docs
    for k, d in enumerate(doc.tolist()):
        groups[d] = text[cuts[k] : cuts[k + 1] - 1].tobytes()  # without the last sign

    order = np.lexsort((code, of_link))
    code, of = code[order], of_link[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)

    def each(values: np.ndarray) -> np.ndarray:
        out = np.zeros(docs, np.int64)
        out[doc] = values
        return out

    return _Piece(
        each(np.array([len(many_a[k]) for k in good], np.int64)),
        each(np.array([len(many_b[k]) for k in good], np.int64)),
        each(n_groups),
        each(_counted(of_link, len(good))),
        groups,
        code[first],
        np.diff(first, append=len(code)),
        each(_counted(of[first], len(good))),
    )


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _closed(chunk: int, ids: list, parts: list[_Piece], keep_groups: bool) -> Iterator[pa.RecordBatch]:
    """A chunk's documents, then its dictionary of pairs."""
    schema = pa.schema([(f, t) for f, t in zip(_names(_CHUNKS), [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())])])
    known, index, docs = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True, return_counts=True)
    at = pair_at = 0
    for p in parts:
        n, pairs = len(p.n_a), len(p.pairs)
        digest = [hashlib.sha256(g).hexdigest() if g else "" for g in p.groups]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * n, pa.int64()),
                pa.array(ids[at : at + n], pa.int64()),
                *(pa.array(x, pa.int64()) for x in (p.n_a, p.n_b, p.n_groups, p.n_links)),
                pa.array(digest, pa.string()),
                pa.array([g.decode() for g in p.groups], pa.string()) if keep_groups else pa.nulls(n, pa.string()),
                _lists(index[pair_at : pair_at + pairs], p.n_pairs, pa.int32()),
                _lists(p.times, p.n_pairs, pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())),
                pa.nulls(n, pa.list_(pa.int32())),
            ],
            schema=schema,
        )
        at, pair_at = at + n, pair_at + pairs
    size = np.array([len(known)])
    none = [pa.nulls(1, schema.field(k).type) for k in range(1, 10)]
    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *none, _lists(known, size, pa.int64()), _lists(docs, size, pa.int32())], schema=schema)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def align_tokens(
    docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Align a byte-level tokenizer's ids (A) of every text with a sentencepiece model's (B).

    Both encode one space and the text.  Places where tokens of both end cut
    the lists into groups; pairs of an A and a B token whose byte ranges
    overlap are linked.  The count of an id pair is the number of documents
    that hold it linked.

    Result, one row for each input row: doc_id, n_a, n_b (tokens), n_groups,
    n_links, n_best (links whose pair has the highest count of its A id, ties
    included), count_sum (of the links' counts), groups_sha256 and, with
    ``keep_groups``, groups (``a1,a2|b1;a3|b2,b3``, ids in order).

    Null or empty texts, and texts that either tokenizer does not give back
    byte for byte (such as those with U+2581), have no tokens: zeros and empty
    groups.  Very long texts are aligned whole, in stretches of ``STRETCH``
    tokens.  Repeated rows, and rows of one id, are documents of their own,
    each counted.  Other columns are ignored, whatever their names; an empty
    table gives an empty result.  Both paths must exist on the executors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _of_worker(byte_level_path, byte_level_tokens), _of_worker(piece_path, piece_tokens)
        chunk, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            offsets = utf8(batch.column(1))[1]
            for low, high in pieces(offsets, PIECE_BYTES):
                some = batch.slice(low, high - low)
                ids.extend(some.column(0).to_pylist())
                parts.append(align([t or "" for t in some.column(1).to_pylist()], a, b))
                held += int(offsets[high] - offsets[low])
                if held >= chunk_bytes:
                    yield from _closed(chunk, ids, parts, keep_groups)
                    chunk, ids, parts, held = chunk + 1, [], [], 0
        if parts:
            yield from _closed(chunk, ids, parts, keep_groups)

    chunks = written(rows.mapInArrow(encode, _CHUNKS))
    size_b = len(piece_tokens(piece_path).sizes)
    known = chunks.where("known is not null").select("chunk", F.posexplode(F.arrays_zip("known", "docs")).alias("at", "p"))
    known = known.select("chunk", "at", F.col("p.known").alias("code"), F.col("p.docs").alias("docs"))
    counts = known.groupBy("code").agg(F.sum("docs").alias("n"))
    # an A id has at most as many pairs as B has ids
    best = F.max("n").over(W.partitionBy(F.expr(f"code div {size_b}")))
    counts = counts.select("code", "n", (F.col("n") == best).alias("best"))
    answers = known.join(counts, "code").select(F.col("chunk").alias("to_chunk"), "at", "n", "best")

    def settle(key, texts: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("at")
        n, is_best = got["n"].to_numpy(), got["best"].to_numpy().astype(np.int64)
        pair, times = texts["pair"].combine_chunks(), texts["times"].combine_chunks()
        sizes = pair.value_lengths().to_numpy()
        index, often = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def per_row(values: np.ndarray) -> pa.Array:
            sums = np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(sizes)))]
            return pa.array(np.diff(sums), pa.int64())

        cols = {c: texts[c] for c in _names(_ROWS) if c in texts.column_names}
        cols |= {"n_best": per_row(often * is_best[index]), "count_sum": per_row(often * n[index])}
        return pa.table({c: cols[c] for c in _names(_ROWS)})

    texts = chunks.where("known is null").drop("known", "docs")
    out = texts.groupBy("chunk").cogroup(answers.groupBy("to_chunk")).applyInArrow(settle, _ROWS)
    return out if keep_groups else out.drop("groups")
