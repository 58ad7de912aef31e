"""Packing of documents into training sequences by vector bin packing.

Every piece of a document is a vector (tokens, one segment, loss-bearing
tokens); a sequence has a limit for each.  Method: the dot-product heuristic.
While a sequence is open, the waiting piece whose vector has the largest dot
product with what the sequence has left, both as shares of the limits, goes
in; if none fits, one is cut to fill it.

Each Spark partition packs its own documents, in order, through a bounded pool
of waiting pieces: no shuffle, memory independent of the input.  Sequence ids
hold the partition's number, so a partition that is computed again after a
lost executor gives the same rows.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import WORD_CACHES
from tidewater.llm.text import pieces, utf8

SCHEMA = "doc_id long, start long, length long, loss_length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


#: A control character that stands between words when many are encoded at once.
BETWEEN = "\x07"
#: Runs of lower-case Latin-1 letters, and such runs before one sign.
LETTERS = "[a-zªµºß-öø-ÿ]+"
RUN, ENDED = re.compile(LETTERS), re.compile(LETTERS + "[,.;:!?|)]")
#: UTF-8 bytes from this one on belong to characters beyond Latin-1.
ABOVE_LATIN = 0xC4
#: Bytes of text encoded at once; one longer text is one piece.
ENCODE_BYTES = 4 << 20


class WordCache:
    """Ids of texts by a tokenizer that never joins characters across white space.

    Each distinct run of other characters is encoded once and remembered.  At
    ``most`` remembered runs those stay that were met again, the most often met
    half of the room at most; the others, such as words that occur once, go.
    """

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most = tokenizer, most
        between = tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.letters = self._letter_table()
        self._forget()

    def _letter_table(self) -> dict[int, str] | None:
        """How the model spells Latin-1 letters, if runs of them can go straight to it: byte-level merges decide alone."""
        from tokenizers import pre_tokenizers

        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        probe = ["a", "the", "straße", "éèàç", "niñoñ", "thisisoneword", "µª", "word"]
        whole = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe]
        same = whole == [[t.id for t in self.tokenizer.model.tokenize(x.translate(table))] for x in probe]
        parts = self.tokenizer.encode("a.b", add_special_tokens=False).ids == [i for x in ("a", ".", "b") for i in self.tokenizer.encode(x, add_special_tokens=False).ids]
        return table if same and parts else None

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.met = np.zeros(1 << 12, np.int32)  # times that a word was asked for
        self.used = 0
        self._keep([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _forget_rare(self) -> None:
        """Half of the room at least becomes free; the words that stay are counted anew."""
        words, met = list(self.known), self.met[: len(self.known)]
        often = np.flatnonzero(met > 1)
        often = often[often > 0]  # "" always stays
        if len(often) > self.most // 2:
            often = np.sort(often[np.argsort(-met[often], kind="stable")[: self.most // 2]])
        ids, n = self._gather(often)
        self._forget()
        self._keep([words[k] for k in often.tolist()], ids, n)

    def _encoded_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, table = self.tokenizer.model.tokenize, self.letters
        many = [[t.id for t in tokenize(w if w.isascii() else w.translate(table))] for w in runs]
        return np.array([i for x in many for i in x], np.uint32), np.array([len(x) for x in many], np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        if self.between is None or any(BETWEEN in w for w in words):
            many = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([i for x in many for i in x], np.uint32), np.array([len(x) for x in many], np.int64)
        ids = np.array(self.tokenizer.encode(f" {BETWEEN} ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.between), len(ids))
        return ids[ids != self.between], np.diff(ends, prepend=-1) - 1

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        if k + n > len(self.size):
            self.begin, self.size, self.met = (np.resize(x, 2 * (k + n)) for x in (self.begin, self.size, self.met))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[k : k + n], self.met[k : k + n] = sizes, 0
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + n)))

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[index]
        at = np.repeat(self.begin[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at], n

    def _learn(self, new: set[str]) -> None:
        # a letter run before one sign has the ids of the run, then those of the sign
        ended = [w for w in new if ENDED.fullmatch(w)] if self.letters else []
        rest = new.difference(ended)
        runs = {w for w in rest if RUN.fullmatch(w)} if self.letters else set()
        rest = (rest - runs) | {w[-1] for w in ended} - self.known.keys()
        runs.update(r for w in ended if (r := w[:-1]) not in self.known)
        for words, encoded in ((list(runs), self._encoded_runs), (list(rest), self._encoded)):
            for at in range(0, len(words), 4000):
                self._keep(words[at : at + 4000], *encoded(words[at : at + 4000]))
        if ended:
            index = np.fromiter((self.known[x] for w in ended for x in (w[:-1], w[-1])), np.int64, 2 * len(ended))
            ids, n = self._gather(index)
            self._keep(ended, ids, n.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        return self.encode_with_lines(texts, lines=False)[0]

    def encode_with_lines(self, texts: pa.Array, lines: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and how many of them its first line has (0 where there is one line only).

        Only a batch's distinct words come out of Arrow.
        """
        data, offsets = utf8(texts)
        # the tokenizer lower-cases; for Latin-1 texts that gives the same characters first, and fewer words to learn
        above = np.searchsorted(np.flatnonzero(data >= ABOVE_LATIN), offsets)
        texts = pc.if_else(pa.array(np.diff(above) == 0), pc.utf8_lower(texts), texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.most:
            self._forget_rare()
            new = {w for w in words if w not in self.known}
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[index] += 1
        ids, n = self._gather(index[coded.indices.to_numpy()])
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        ends, words_before = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(counts)))
        edges = ends[words_before]
        firsts = np.zeros(len(texts), np.int64)
        if lines:
            line = pc.struct_field(pc.extract_regex(texts, r"^(?P<line>[^\n]*)\n"), "line")
            n_words = pc.list_value_length(pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(line))).fill_null(0).to_numpy(zero_copy_only=False)
            firsts = ends[words_before[:-1] + n_words] - edges[:-1]
        return [ids[a:b] for a, b in zip(edges, edges[1:])], firsts


def worker_cache(tokenizer_path: str) -> WordCache:
    """This Python worker's cache: tasks that run in it one after the other share what it learned.

    Ids do not depend on it, only the time.  It hangs on a module object, as
    the functions of a job are loaded anew for each task; tasks of the
    pipeline's other stages drop it (``spread.fresh_worker``).
    """
    from tokenizers import Tokenizer

    place = sys.modules.setdefault(WORD_CACHES, types.ModuleType(WORD_CACHES))
    if not hasattr(place, "caches"):
        place.caches = {}
    if tokenizer_path not in place.caches:
        place.caches[tokenizer_path] = WordCache(Tokenizer.from_file(tokenizer_path))
    return place.caches[tokenizer_path]


class Packer:
    """Packs the documents of one partition; pieces come out as sequences fill up."""

    def __init__(self, limits: Limits, first_id: int, pool: int):
        self.limits, self.next_id, self.most = limits, first_id, pool
        self.scale = [1 / limits.tokens, 1 / limits.segments, 1 / limits.loss_tokens]
        self.size, self.loss = np.zeros(pool, np.int64), np.zeros(pool, np.int64)
        self.items: list[tuple] = []  # (doc, ids of the piece, start, loss start, tokens of the document)
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray, loss_start: int) -> None:
        at, total = 0, len(ids)
        most = self.limits.tokens
        while total - at >= most and max(0, at + most - max(at, loss_start)) <= self.limits.loss_tokens:
            self._emit([(doc, ids[at : at + most], at, loss_start, total)])
            at += most
        if at < total:
            self._wait((doc, ids[at:].copy() if at else ids, at, loss_start, total))  # a view would keep the whole document
            while len(self.items) == self.most:  # where every piece that went in was cut, as many wait as before
                self._fill()

    def finish(self) -> None:
        while self.items:
            self._fill(last=True)

    def _vector(self, item: tuple) -> tuple[int, int]:
        _, ids, start, loss_start, _ = item
        return len(ids), max(0, start + len(ids) - max(start, loss_start))

    def _wait(self, item: tuple) -> None:
        k = len(self.items)
        self.items.append(item)
        self.size[k], self.loss[k] = self._vector(item)

    def _take(self, k: int) -> tuple:
        item, end = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k] = end
            self.size[k], self.loss[k] = self.size[len(self.items)], self.loss[len(self.items)]
        return item

    def _fill(self, last: bool = False) -> None:
        """Fill one sequence; the rest of a piece that was cut waits again."""
        left = [self.limits.tokens, self.limits.segments, self.limits.loss_tokens]
        pieces: list[tuple] = []
        while self.items and left[0] and left[1]:
            size, loss = self.size[: len(self.items)], self.loss[: len(self.items)]
            have = [x * scale * scale for x, scale in zip(left, self.scale)]
            dot = np.where((size <= left[0]) & (loss <= left[2]), size * have[0] + have[1] + loss * have[2], -1.0)
            k = int(dot.argmax())
            if dot[k] >= 0:
                item, rest = self._take(k), None
            else:  # the vector of what can be cut off each piece; ids without loss come first in a document
                bare = size - loss
                part = np.minimum(left[0], bare + left[2])
                if not part.any():
                    break
                dot = part * have[0] + have[1] + np.maximum(0, part - bare) * have[2]
                k = int(np.where(part > 0, dot, -1.0).argmax())
                cut = int(part[k])
                doc, ids, start, loss_start, total = self._take(k)
                item, rest = (doc, ids[:cut], start, loss_start, total), (doc, ids[cut:], start + cut, loss_start, total)
            pieces.append(item)
            n, loss_n = self._vector(item)
            left = [left[0] - n, left[1] - 1, left[2] - loss_n]
            if rest is not None:
                self._wait(rest)
        if last and not self.items and left[0]:
            self._emit_powers(pieces)
        else:
            self._emit(pieces)

    def _emit_powers(self, pieces: list[tuple]) -> None:
        """The partition's last sequence, as sequences of powers of two, which need no padding."""
        while pieces:
            room = 1 << (sum(len(p[1]) for p in pieces).bit_length() - 1)
            now: list[tuple] = []
            while room:
                doc, ids, start, loss_start, total = pieces.pop(0)
                now.append((doc, ids[:room], start, loss_start, total))
                if len(ids) > room:
                    pieces.insert(0, (doc, ids[room:], start + room, loss_start, total))
                room -= len(now[-1][1])
            self._emit(now)

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for item in pieces:
            doc, ids, start, _, total = item
            self.out.append((doc, start, len(ids), self._vector(item)[1], ids, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += bool(pieces)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_start_col: str | None = None,
    pool: int = 1024,
    keep_ids: bool = True,
    prompt_line: bool = False,
) -> DataFrame:
    """Cut documents into pieces and place them in sequences within ``limits``.

    A document is the tokenizer's ids of its text and then ``end_id`` (if
    given).  ``loss_start_col`` names a column with the number of leading ids
    that bear no loss (null: 0), such as a prompt's; with ``prompt_line`` the
    ids of the first line of a text of two or more lines bear none either.
    Without both all ids bear loss.

    Result, one row for each piece: doc_id, start (ids of the document before
    it), length, loss_length, ids (null without ``keep_ids``), ids_crc32 (of
    its ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset
    in the sequence, without gaps from 0.

    Full sequences have no padding; a partition's last one is divided into
    powers of two.  Only the segment and loss limits can leave room: a sequence
    that holds all the loss it may is filled up with ids without loss, cut off
    waiting documents, while the pool has such.  A very long text is cut into
    as many sequences as it needs.  Null or empty text has only ``end_id``; without that it has no piece.  Rows of one
    id are packed as documents of their own.  Other columns are ignored.  An
    empty table gives an empty result.  The tokenizer must not join characters
    across white space (the word-level ones here do not).
    """
    loss = F.lit(0) if loss_start_col is None else F.coalesce(F.col(loss_start_col), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), loss.cast("long").alias("loss_start"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer_path)
        packer = Packer(limits, TaskContext.get().partitionId() << 40, pool)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for at, to in pieces(utf8(texts)[1], ENCODE_BYTES):
                part = batch.slice(at, to - at)
                own = texts.slice(at, to - at)
                encoded, lines = cache.encode_with_lines(own, prompt_line)
                pa.default_memory_pool().release_unused()
                firsts = np.maximum(part.column(2).to_numpy(), lines)
                for doc, ids, first in zip(part.column(0).to_pylist(), encoded, firsts.tolist()):
                    packer.add(doc, ids if end_id is None else np.append(ids, np.uint32(end_id)), first)
                    if len(packer.out) > 2000:
                        yield _batch(packer, keep_ids)
        packer.finish()
        yield _batch(packer, keep_ids)

    return rows.mapInArrow(pack, SCHEMA)


def _batch(packer: Packer, keep_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*packer.out)) if packer.out else [[]] * 9
    ids = pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())) if keep_ids else pa.nulls(len(packer.out), pa.list_(pa.int32()))
    packer.out = []
    types = [pa.int64()] * 9
    names = ["doc_id", "start", "length", "loss_length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([ids if i == 4 else pa.array(c, t) for i, (c, t) in enumerate(zip(cols, types))], names=names)
