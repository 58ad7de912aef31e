"""Near-duplicate documents by bottom-k sketches from one hash function.

Steps:

1. Every document becomes a set of word shingles, a digest of the whole set
   and a sketch, the ``K`` smallest hashes.  Documents of equal sets are one
   class, so copies are never compared with each other.
2. Inverted lists of the retained values generate overlaps.  Two sets whose
   similarity reaches the threshold share at least ``needed(n)`` retained
   values, so they share one of the ``s - needed + 1`` rarest of their ``s``; only
   these are listed, which leaves passages that many documents hold out of
   the lists.  Lists with the same smallest member are joined into one group.
3. In each group, blocks of sketches are compared: the union sketch of a pair
   estimates its similarity.  Members with no likely partner drop out.
4. For the others, the exact Jaccard similarity is computed from whole texts.
   Of the links found in a block a spanning forest is kept, so a group of n
   near copies gives n links and not n squared.
5. Connected components by alternating large and small stars.

Large groups are divided by set size (linked sets differ by less than the
threshold) and into blocks; block pairs are separate tasks.  Everything is
joined or grouped in Spark; only counters come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import arrow_batches, fresh_worker, written
from tidewater.llm.text import Hasher, Words, ascii_lower, mix, non_space_bytes, pieces, utf8, window_starts

K = 64
BLOCK = 1024
#: Bytes of the Arrow batches that go to a Python worker, and rows and columns of a piece of a block pair's table.
BATCH_BYTES, STRIP, WIDTH = 4 << 20, 256, 2048
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
MISS = 1e-9  # chance that a linked pair at the threshold shares fewer retained values than needed


def needed_of_sketch(k: int, threshold: float, miss: float = MISS) -> int:
    """Largest c such that k draws, each common with at least ``threshold``, have fewer than c common with chance ``miss`` at most."""
    total, c = 0.0, 0
    while True:
        total += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if total > miss:
            return c
        c += 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of texts: its rows, and the distinct (text, shingle) pairs in order."""
    hasher, table, lower = Hasher(), non_space_bytes(), ascii_lower()
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        w = Words(lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], table)
        each, counts = hasher.words(w), w.counts()
        text, value = [], []
        for n in range(1, size + 1):
            # a text of fewer words than a shingle is one shingle of its own length
            starts = window_starts(w.bounds, size) if n == size else w.bounds[:-1][counts == n]
            if len(starts):
                value.append(mix(hasher.windows(each, n)[starts] + np.uint64(n)))
                text.append(np.searchsorted(w.bounds, starts, "right") - 1)
        if not text:
            yield a, b, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        text, value = np.concatenate(text), np.concatenate(value)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        yield a, b, text[new], value[new]


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, text_hash, n, d1, d2, sketch) of each document."""

    def sketch(batches):
        fresh_worker()
        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, np.uint64) for _ in range(3))
            flat, sizes = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            for a, b, text, value in shingle_sets(batch.column("text"), size):
                edges = np.searchsorted(text, np.arange(b - a + 1))
                n[a:b] = np.diff(edges)
                for d, salt in ((d1, 0x5851F42D4C957F2D), (d2, 0x14057B7EF767814F)):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)))
                    d[a:b] = sums[edges[1:]] - sums[edges[:-1]]
                rank = np.arange(len(text)) - edges[text]
                flat.append(value[rank < K])
                sizes[a:b] = np.minimum(np.diff(edges), K)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x.view(np.int64)) for x in (n, d1, d2)), lists],
                names=["row", "doc_id", "text_hash", "n", "d1", "d2", "sketch"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(sketch, "row long, doc_id long, text_hash long, n long, d1 long, d2 long, sketch array<long>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _id_key() -> dict[str, Column]:
    """doc_id as columns without nulls."""
    return {"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}


def _listed(reps: DataFrame, threshold: float) -> DataFrame:
    """(value, row): the rarest retained values of each class, of those that others retain too."""
    values = reps.select("row", "n", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    held = values.join(common, "value").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("held"))
    size = F.least(F.col("n"), F.lit(K))
    full = F.ceil(F.col("n") * threshold - 1e-9)  # both sets are known in full, or the sketches' bound holds
    need = F.when(F.col("n") <= K * threshold, full).otherwise(F.least(full, F.lit(needed_of_sketch(K, threshold))))
    alone = size - F.size("held")  # values that no other class retains are the rarest
    take = F.greatest(F.lit(0), size - need + 1 - alone).cast("int")
    return held.select("row", F.explode(F.slice("held", F.lit(1), take)).alias("h")).select(F.col("h.value").alias("value"), "row")


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Members (hub, row, n, ...) with the keys of the tasks that compare them: part, low, high; and their block.

    Groups of more than ``BLOCK`` members are divided by set size, each size
    range also holding the one below it, and what is still larger into blocks,
    each pair of which is a task.
    """
    large = members.groupBy("hub").agg(F.count("*").alias("all")).where(f"all > {BLOCK}")
    step = -math.log(threshold)
    band = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    bands = F.when(F.col("all").isNull(), F.array(F.lit(-1))).otherwise(F.array(band, band + 1))
    parts = members.join(large, "hub", "left").withColumn("part", F.explode(bands)).drop("all")
    many = parts.groupBy("hub", "part").agg(F.count("*").alias("all")).where(f"all > {BLOCK}")
    parts = parts.join(many, ["hub", "part"], "left")
    count = F.ceil(F.coalesce(F.col("all"), F.lit(1)) / BLOCK).cast("int")
    parts = parts.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.col("count")).cast("int"))
    other = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).drop("all", "count")
    return other.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")


def _near_pairs(sets: list[np.ndarray], least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs x < y with at least ``min(least[x], least[y])`` common values, and that number, for a strip of x at a time."""
    index = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    index, column = index[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    index, column = index[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    strips = [slice(at, at + STRIP) for at in range(0, len(sets), STRIP)]
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, WIDTH):
        a, b = np.searchsorted(column, [at, at + WIDTH])
        dense = np.zeros((len(sets), min(WIDTH, total - at)), np.float32)
        dense[index[a:b], column[a:b] - at] = 1
        for strip in strips:
            common[strip] += dense[strip] @ dense.T
    for strip in strips:  # no other table is as large as that of all pairs
        part = common[strip]
        x, y = np.nonzero(np.triu((part >= np.minimum.outer(least[strip], least)) & (part > 0), strip.start + 1))
        yield x + strip.start, y, part[x, y].astype(np.int64)


def _table(sketches: list[np.ndarray]) -> np.ndarray:
    """A row of ``K`` values for each sketch, the highest number where it has fewer."""
    table = np.full((len(sketches), K), NONE, np.uint64)
    for k, s in enumerate(sketches):
        table[k, : len(s)] = s
    return table


def _union_estimate(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of each pair as its union sketch estimates it."""
    shares = np.zeros(len(x))
    for at in range(0, len(x), 8192):
        a, b = x[at : at + 8192], y[at : at + 8192]
        both = np.sort(np.concatenate((table[a], table[b]), axis=1), axis=1)
        again = np.zeros(both.shape, dtype=bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
        rank = np.cumsum(~again & (both != NONE), axis=1)
        bottom = np.minimum(K, rank[:, -1])
        common = (again & (rank <= bottom[:, None])).sum(axis=1)
        shares[at : at + 8192] = common / np.maximum(bottom, 1)
    return shares


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked one of ``n`` to the smallest of its component."""
    root = np.arange(n)
    while True:  # labels fall to the smallest index of each component
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(n))
    return root[far], far


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) links; root is the component's smallest node.

    Alternating large and small stars; each round is written to the shared
    folder, so plans stay short and a lost executor costs one round at most.
    """

    def stars(edges: DataFrame, small: bool) -> DataFrame:
        if small:
            pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = pairs.join(least, "u")
        if small:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a != b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(links.select("a", "b").where("a != b").distinct())
    before = state(edges)
    while before[0]:
        edges = written(stars(written(stars(edges, False)), True))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets.

    A-Z count as a-z; words are runs of characters other than space and
    ``\\t\\n\\v\\f\\r``; a shingle is ``shingle`` consecutive words, or all of a shorter
    text.  Documents are linked when similarity reaches ``threshold``.

    Result, one row for each input row: doc_id, text_hash (xxhash64 of the
    text), n_shingles, component_id (smallest doc_id that links reach, its own
    included) and first (true for exactly one row of each component, one with
    that doc_id).

    Null texts and texts without words have no shingles and no links.  Rows of
    one doc_id are documents of their own; null doc_ids never are a
    component_id unless nothing else is reached.  Other columns are ignored.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_BYTES):
        all_rows = written(_sketches(texts, shingle))
    sets = ["n", "d1", "d2"]
    classes = written(all_rows.where("n > 0").groupBy(*sets).agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
    reps = all_rows.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")

    lists = written(_listed(reps.select("row", "n", "sketch"), threshold))
    hubs = lists.groupBy("value").agg(F.min("row").alias("hub"), F.count("*").alias("members")).where("members > 1")
    groups = written(lists.join(hubs, "value").select("hub", "row").distinct())

    bound = needed_of_sketch(K, threshold)

    def likely(key, rows):
        sketches = [np.asarray(s, np.int64).view(np.uint64) for s in rows["sketch"].to_pylist()]
        n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
        least = np.where(n <= K * threshold, np.ceil(n * threshold - 1e-9), np.minimum(np.ceil(n * threshold - 1e-9), bound))
        table, alike = _table(sketches), np.zeros(len(sketches), dtype=bool)
        for x, y, _ in _near_pairs(sketches, least):
            ok = (block[x] != block[y]) | (key[2].as_py() == key[3].as_py())
            x, y = x[ok], y[ok]
            small = np.minimum(n[x], n[y]) <= K * threshold
            floor = np.where(small, 0.0, bound / K)
            ok = _union_estimate(table, x, y) >= floor
            alike[x[ok]] = alike[y[ok]] = True
        found = np.unique(rows["row"].to_numpy()[alike])
        return pa.table([pa.array(np.full(len(found), key[0].as_py(), np.int64)), pa.array(found)], names=["hub", "row"])

    with_sketch = _blocks(groups.join(reps.select("row", "n", "sketch"), "row"), threshold)
    task = ["hub", "part", "low", "high"]
    # dealt by all four keys: without it Spark keeps rows where (hub, part) put them, all block pairs of a group in one task
    with arrow_batches(spark, BATCH_BYTES):
        partners = written(with_sketch.repartition(*task).groupBy(*task).applyInArrow(likely, "hub long, row long").distinct())

    def exact(key, rows):
        rows = rows.combine_chunks()
        row, block = rows["row"].to_numpy(), rows["block"].to_numpy()
        row, first = np.unique(row, return_index=True)
        block = block[first]
        members = [np.zeros(0, np.uint64)] * len(first)
        for a, b, text, value in shingle_sets(rows["text"].take(pa.array(first)), shingle):
            members[a:b] = np.split(value, np.searchsorted(text, np.arange(1, b - a)))
        size = np.array([len(s) for s in members])
        a, b = (np.zeros(0, np.int64) for _ in range(2))
        for x, y, common in _near_pairs(members, np.ones(len(members))):
            ok = common >= threshold * (size[x] + size[y] - common) - 1e-9
            ok &= (block[x] != block[y]) | (key[2].as_py() == key[3].as_py())
            a, b = _forest(len(row), np.concatenate((a, x[ok])), np.concatenate((b, y[ok])))
        return pa.table([pa.array(row[a], pa.int64()), pa.array(row[b], pa.int64())], names=["a", "b"])

    # a text is known by three columns without nulls, so the exchange of the first join serves all that follow
    key = ["id", "none", "text_hash"]
    who = written(partners.join(reps.select("row", "n", "doc_id", "text_hash"), "row").withColumns(_id_key()).drop("doc_id"))
    tasks = _blocks(who, threshold)
    found = texts.select(*[c.alias(name) for name, c in _id_key().items()], _text_hash().alias("text_hash"), "text")
    # one text of each key, however often its row is repeated; the wanted keys are looked up in a hash table, so texts are not sorted for it
    found = found.join(who.select(*key).distinct().hint("shuffle_hash"), key, "left_semi").dropDuplicates(key)
    with_text = tasks.join(found, key)
    links = with_text.select(*task, "block", "row", "text").repartition(*task).groupBy(*task).applyInArrow(exact, "a long, b long")

    with arrow_batches(spark, BATCH_BYTES):
        roots = components(links)
    copies = classes.where("copies > 1").drop("copies")
    of_class = all_rows.drop("sketch").join(copies, sets, "left").withColumn("node", F.coalesce("rep", "row"))
    of_root = of_class.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = of_root.select("row", "doc_id", "text_hash", "n", "root")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    joined = written(member.groupBy("root").agg(F.min(best).alias("best"), F.count("*").alias("members")).where("members > 1").drop("members"))
    out = member.join(joined, "root", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("first"),
    )
