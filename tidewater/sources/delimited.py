"""Delimited files whose quoted cells may hold line breaks (A1, A2).

A file is read as lines, in splits, by many tasks. Whether a line starts a
record depends on the quotes before it, in earlier splits too. So:

1. Each task reads its splits once and reduces a split to a row: the quote
   state after it, and the records that start in it, for both states it may
   begin in. (A line is a function on two states: it keeps the state, flips
   it, or ends in one state whatever came before; functions compose.)
2. A prefix over that small table, file by file, gives each split the state it
   begins in and the number of its first record.
3. The lines are read again with their split's row, which is broadcast when it
   is small, and cut into records. Lines are never shuffled; only the pieces of
   records that cross splits are brought together.

Cells are then parsed by Spark's CSV expression, one record at a time. Quotes
follow RFC 4180 (a doubled quote is a quote, a backslash is a backslash); a
quote inside an unquoted cell is text. In a file that ends inside quotes every
line is a record, so a stray quote costs its line and no more. LF, CR LF and CR
end lines; a file with CR alone is one line to the reader, hence one split.
Blank lines between records are no records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_headers
from ..sinks.scratch import stored

#: Rows of the split table that are broadcast (about 200 bytes each); with more, lines are dealt by split instead.
BROADCAST_SPLITS = 500_000

_SPLIT = "path string, block long, lines long, starts0 long, starts1 long, to0 int, to1 int, first string, header string"
_PIECE = "path string, file_name string, record long, block long, text string"


def quote_patterns(sep: str) -> tuple[str, str]:
    """Lines after which a cell's quotes are open: begun outside quotes, begun inside."""
    inside, plain = '(?:[^"]|"")*', f'(?:[^"{sep}][^{sep}]*)?'
    cell = f'(?:"{inside}"{plain}|{plain})'
    opens = f'(?:{cell}{sep})*"{inside}'
    return f"^{opens}$", f'^(?:{inside}|{inside}"{plain}{sep}{opens})$'


class Lines:
    """Lines of one split, in order: text, what ended them, and what they do to the quote state."""

    def __init__(self, values: pa.Array, sep: str):
        values = values.fill_null("")
        crlf = pc.ends_with(values, "\r")
        text = pc.if_else(crlf, pc.utf8_slice_codeunits(values, 0, -1), values)
        ends = pc.if_else(crlf, "\r\n", "\n")
        if pc.any(pc.match_substring(text, "\r")).as_py():  # lines that CR alone ends
            split = [(parts, end) for parts, end in zip(pc.split_pattern(text, "\r").to_pylist(), ends.to_pylist())]
            ends = pa.array([e for parts, end in split for e in ["\r"] * (len(parts) - 1) + [end]], pa.string())
            text = pa.array([p for parts, _ in split for p in parts], pa.string())
        self.text, self.ends = text, ends
        quoted = pc.match_substring(text, '"')
        n = len(text)
        self.after = np.zeros((2, n), dtype=bool)
        self.after[1] = True  # a line without quotes leaves the state as it is
        if pc.any(quoted).as_py():
            at, some = np.flatnonzero(quoted.to_numpy(zero_copy_only=False)), text.filter(quoted)
            for state, pattern in enumerate(quote_patterns(sep)):
                self.after[state, at] = pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
        self.blank = (pc.utf8_length(pc.utf8_trim_whitespace(text)).to_numpy(zero_copy_only=False) == 0)

    def states(self, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Quote state before and after each line."""
        n = self.after.shape[1]
        fixed = self.after[0] == self.after[1]
        flips = np.cumsum(self.after[0] & ~self.after[1])
        last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
        base = np.where(last >= 0, self.after[0][last], bool(begin))
        since = flips - np.where(last >= 0, flips[last], 0)
        after = base ^ (since % 2 == 1)
        return np.concatenate(([bool(begin)], after[:-1]))[:n], after


def _runs(batch: pa.RecordBatch, columns: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """Row ranges of one split each; a task's splits come one after the other."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        col = batch.column(c)
        change |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else change
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return zip(edges, edges[1:]) if n else iter(())


def _reduce(sep: str):
    """Step 1: a row for each split."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, got = [], None, None
        for batch in batches:
            for a, b in _runs(batch, (1, 2)):
                now = (batch.column(1)[a].as_py(), batch.column(2)[a].as_py())
                if now != key:
                    if got is not None:
                        done.append((*key, *got[:3], *map(int, got[3:5]), *got[5:7]))
                    key, got = now, [0, 0, 0, 0, 1, None, None, []]
                lines = Lines(batch.column(0).slice(a, b - a), sep)
                got[0] += int((~lines.blank).sum())
                if got[5] is None and not lines.blank.all():
                    got[5] = lines.text[int(np.flatnonzero(~lines.blank)[0])].as_py()
                for state in (0, 1):
                    before, after = lines.states(got[3 + state])
                    starts = ~before & ~lines.blank
                    if state == 0 and got[6] is None:  # the first record, if it ends in this split
                        for k in range(int(np.argmax(starts)) if not got[7] else 0, len(before)) if starts.any() or got[7] else ():
                            got[7] += [lines.text[k].as_py(), lines.ends[k].as_py()]
                            if not after[k]:
                                got[6] = "".join(got[7][:-1])
                                break
                    got[1 + state] += int(starts.sum())
                    got[3 + state] = int(after[-1])
        if got is not None:
            done.append((*key, *got[:3], *map(int, got[3:5]), *got[5:7]))
        if done:
            kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = [x.split()[0] for x in _SPLIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    return rows


def split_table(lines: DataFrame, sep: str) -> DataFrame:
    """Steps 1 and 2: path, block, whether the split begins and ends inside
    quotes, number of its first record, whether every line is a record, and in
    a file's first split the header (null when it does not end there)."""
    splits = lines.select("value", "path", "block").mapInArrow(_reduce(sep), _SPLIT)
    w = Window.partitionBy("path").orderBy("block")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    fixed, flip = F.col("to0") == F.col("to1"), ((F.col("to0") == 1) & (F.col("to1") == 0)).cast("int")
    s = splits.withColumn("_flips", F.sum(flip).over(upto))
    s = s.withColumns({
        "_base": F.coalesce(F.last(F.when(fixed, F.col("to0")), True).over(earlier), F.lit(0)),
        "_since": F.coalesce(F.max("_flips").over(earlier), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("_flips")), True).over(earlier), F.lit(0)),
        "_rank": F.row_number().over(w),
    })
    s = s.withColumn("begins", (F.col("_base") + F.col("_since")) % 2 == 1)
    s = s.withColumn("ends", F.when(F.col("begins"), F.col("to1")).otherwise(F.col("to0")) == 1)
    s = s.withColumn("plain", F.last("ends").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = F.when(F.col("plain"), F.col("lines")).when(F.col("begins"), F.col("starts1")).otherwise(F.col("starts0"))
    inside = ~F.col("plain")
    return s.withColumn("_starts", starts).select(
        "path", "block", (F.col("begins") & inside).alias("begins"), (F.col("ends") & inside).alias("ends"), "plain",
        F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("offset"), F.col("_starts").alias("starts"),
        F.when(F.col("_rank") == 1, F.when(F.col("plain"), F.col("first")).otherwise(F.col("header"))).alias("header"))


class _Cutter:
    """Step 3 for one task: lines of its splits, in order, into records."""

    def __init__(self, sep: str, crossing: bool):
        self.sep, self.crossing, self.key = sep, crossing, None
        self.out: list[tuple] = []

    def _close(self) -> None:
        """The split is over: an open record goes on in the next one."""
        if self.key is not None and self.held:
            self._emit("".join(self.held), True)

    def _emit(self, text: str, crosses: bool) -> None:
        if crosses == self.crossing:
            self.out.append((*self.key[:2], self.record, self.key[2], text))
        self.held = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.schema.names
        get = {n: batch.column(names.index(n)) for n in names}
        for a, b in _runs(batch, (names.index("path"), names.index("block"))):
            key = (get["path"][a].as_py(), get["file_name"][a].as_py(), get["block"][a].as_py())
            if key != self.key:
                self._close()
                self.key, self.held = key, []
                self.state = self.crossed = get["begins"][a].as_py()
                self.plain, self.record = get["plain"][a].as_py(), get["offset"][a].as_py() - 1
            lines = Lines(get["value"].slice(a, b - a), self.sep)
            if self.plain:
                before = after = np.zeros(len(lines.blank), dtype=bool)
            else:
                before, after = lines.states(self.state)
            self.state = bool(after[-1])
            starts = ~before & ~lines.blank
            number = self.record + np.cumsum(starts)
            single = starts & ~after
            if not self.crossing and single.any():
                at = np.flatnonzero(single)
                yield self._batch([pa.array([key[0]] * len(at)), pa.array([key[1]] * len(at)), pa.array(number[at]), pa.array([key[2]] * len(at), pa.int64()), lines.text.take(pa.array(at))])
            for k in np.flatnonzero(before | (starts & after)).tolist():
                if not before[k]:
                    self.record, self.crossed = int(number[k]), False
                self.held += [lines.text[k].as_py(), lines.ends[k].as_py()]
                if not after[k]:
                    self._emit("".join(self.held[:-1]), self.crossed)
                    self.crossed = False
            self.record = int(number[-1])

    def finish(self) -> pa.RecordBatch:
        self._close()
        return self.rest()

    def rest(self) -> pa.RecordBatch:
        cols, self.out = list(zip(*self.out)) or [[]] * 5, []
        return self._batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))])

    @staticmethod
    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECE.split(", ")])


def _cut(lines: DataFrame, sep: str, crossing: bool) -> DataFrame:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(sep, crossing)
        for batch in batches:
            yield from cutter.add(batch)
            yield cutter.rest()
        yield cutter.finish()

    return lines.mapInArrow(pieces, _PIECE)


def read_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"))


def records(spark: SparkSession, paths, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(records, headers): path, file_name, record (from 0, the header) and
    text of every record; path and header text of every file that has one."""
    lines = read_lines(spark, paths)
    splits = stored(split_table(lines, sep), "splits")
    small = splits.agg(F.count("*").alias("n"), F.count_if(F.col("begins") | F.col("ends")).alias("crossing"),
                       F.count_if(F.col("header").isNull() & (F.col("offset") == 0) & (F.col("starts") > 0)).alias("headless")).first()
    state = splits.select("path", "block", "begins", "ends", "plain", "offset")
    if small["n"] <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(state), ["path", "block"])
    else:  # dealt by split, in file order within it
        numbered = lines.withColumn("_at", F.monotonically_increasing_id())
        placed = numbered.join(state, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "_at").drop("_at")
    out = _cut(placed.drop("ends"), sep, crossing=False).drop("block")
    headers = splits.where("header is not null").select("path", "header")
    if small["crossing"]:
        parts = _cut(placed.where("begins or ends").drop("ends"), sep, crossing=True)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "")
        whole = stored(parts.groupBy("path", "file_name", "record").agg(text.alias("text")), "records")
        out = out.unionByName(whole)
        if small["headless"]:
            headers = headers.unionByName(whole.where("record = 0").select("path", F.col("text").alias("header")))
    return out, headers


def header_names(text: str, sep: str) -> list[str]:
    """Column names of a header record; nameless ones are ``_c0``, ``_c1``, ..."""
    names = next(csv.reader(io.StringIO(text.lstrip("﻿"), newline=""), delimiter=sep), [])
    return [n if n.strip() else f"_c{k}" for k, n in enumerate(names)]


def frames_by_header(spark: SparkSession, paths, sep: str = ",") -> list[DataFrame]:
    """A raw frame (file_name, row_no, the cells as text under normalised
    names, C9) for each distinct header among the files. Two jobs find the
    headers, however many files there are; only distinct headers, the
    schemas of the result, come to the driver."""
    found, headers = records(spark, paths, sep)
    distinct = sorted(r["header"] for r in headers.select("header").distinct().collect())
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    frames = []
    for header in distinct:
        names = header_names(header, sep)
        rows = found.where("record > 0")
        if len(distinct) > 1:
            rows = rows.join(headers.where(F.col("header") == header).select("path"), "path", "left_semi")
        cells = F.from_csv("text", ", ".join(f"c{k} string" for k in range(len(names))), options)
        frame = rows.select("file_name", (F.col("record") - 1).alias("row_no"), cells.alias("_cells"))
        frame = frame.select("file_name", "row_no", *[F.col(f"_cells.c{k}").alias(f"c{k}") for k in range(len(names))])
        named = normalise_headers(frame.drop("file_name", "row_no").toDF(*names)).columns
        named = [f"{n}_cell" if n in ("file_name", "row_no") else n for n in named]
        frames.append(frame.toDF("file_name", "row_no", *named))
    return frames


def read_delimited(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """A1/A2: delimited text with a header row, every column as text. Files
    with other headers add their columns."""
    frames = frames_by_header(spark, paths, sep)
    if not frames:
        return spark.createDataFrame([], "file_name string, row_no long")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
