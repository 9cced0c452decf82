"""Exact set-similarity join on word shingles: all pairs with a Jaccard similarity of four fifths or more.

A text is the set of the XXH64 (seed 42) of its word shingles; texts with equal
sets are one node from the start. Two sets of n and m shingles are that similar
if they share at least 4 (n + m) / 9 of them. So of the first n - ceil(4 n / 5) + 1
shingles of each, in any order that is the same for all sets, they share one.
The order puts shingles that are frequent in a sample of the texts last; the
sample decides how many candidates there are, not which pairs are found.

Candidates are thinned by sizes, by places in the order, and by bitmaps of the
parity of shingles per bucket, which differ in no more bits than the sets differ
in shingles. What is left is compared shingle by shingle. Where many sets share
a shingle, each is first compared with the next by size; then only pairs that
are not in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, release, store
from tideline.llm.text import small_batches, whole
from tideline.operators.graph import connected_components

#: One text in ``SAMPLE`` is looked at for frequent shingles: those of ``OFTEN`` such texts, ``MOST`` of them (32 MB).
SAMPLE, OFTEN, MOST = 16, 2, 2_000_000
#: Sets that share a shingle and are compared all with all at once, where more are first chained; bits of a bitmap.
FEW, BUCKETS = 3, 512


def hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included; of all its words if it has fewer than ``width``."""
    words = text.lower().split()  # bytes: white space is the six ASCII characters, and A-Z alone are lowered
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), np.uint64)


def node(members: np.ndarray) -> int:
    """The name of a set, from its sorted members."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), 42)).view(np.int64))


def prefix(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first members in the common order, enough to share one with every similar set; ``frequent`` is sorted by value, with ranks."""
    n = len(members)
    if not n:
        return members
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent["value"], members), len(frequent) - 1)
        rank = np.where(frequent["value"][at] == members, frequent["rank"][at], 0)
    return members[np.argsort(rank, kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def bitmap(members: np.ndarray) -> bytes:
    return np.packbits(np.bincount((members % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) % 2 == 1).tobytes()


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, sorted by value, each with its rank (1 for the least frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(value, width)).view(np.int64))], ["value"])

    few = docs.select(whole(text).cast("binary").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = few.mapInArrow(run, "value long").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "value").limit(MOST).toArrow()
    values = top["value"].to_numpy().view(np.uint64)
    made = np.empty(len(values), [("value", np.uint64), ("rank", np.int64)])
    made["value"], made["rank"] = values, np.arange(len(values), 0, -1)
    return np.sort(made, order="value")


def _grouped(rows: DataFrame, pick, rest: bool) -> DataFrame:
    """``a, b``: what ``pick(columns of a group)`` names, over the groups of equal ``gram``; at least two rows each.

    With ``rest``, the rows of groups of more than ``FEW`` follow too: as ``a`` their node, no ``b``, and ``gram, size, place``.
    """
    names, few = rows.columns[1:], FEW
    empty = lambda n, kind: pa.nulls(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        crowd: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def close() -> None:
            nonlocal waiting
            columns = [np.concatenate(c) for c in zip(*held)]
            n = len(columns[0])
            if n < 2:
                return
            for x, y in pick(few, *columns):
                pairs.append((np.minimum(x, y), np.maximum(x, y)))
                waiting += len(x)
            if rest and n > few:
                crowd.append((columns[0], np.full(n, at), columns[1], columns[2]))
                waiting += n

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if pairs:
                x, y = (np.concatenate(z) for z in zip(*pairs))
                m = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), empty(m, pa.int64()), empty(m, pa.int32()), empty(m, pa.int32())], ["a", "b", "gram", "size", "place"])
            if crowd:
                own, grams, sizes, places = (np.concatenate(z) for z in zip(*crowd))
                yield pa.RecordBatch.from_arrays([pa.array(own), empty(len(own), pa.int64()), pa.array(grams), pa.array(sizes), pa.array(places)], ["a", "b", "gram", "size", "place"])
            pairs.clear()
            crowd.clear()
            waiting = 0

        for batch in batches:
            gram = batch["gram"].to_numpy()
            if not len(gram):
                continue
            columns = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, BUCKETS // 8) if c == "bitmap" else batch[c].to_numpy() for c in names]
            edges = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]))
            # most shingles are in one set alone; only the first and last of a batch may go on in another
            several = np.diff(edges) > 1
            several[[0, -1]] = True
            for i, j in zip(edges[:-1][several].tolist(), edges[1:][several].tolist()):
                if at is not None and at != gram[i]:
                    if len(held) > 1 or len(held[0][0]) > 1:
                        close()
                    held = []
                at = gram[i]
                held.append([c[i:j] for c in columns])
            if waiting > 20_000:
                yield from out()
        if held:
            close()
        yield from out()

    return rows.repartition("gram").sortWithinPartitions("gram", "size", "node").mapInArrow(run, "a long, b long, gram long, size int, place int")


def _may(size: np.ndarray, place: np.ndarray, i: int, others: slice) -> np.ndarray:
    """Whether sets ``others``, none smaller than set ``i``, can be similar to it if the shingle at ``place`` is the first that they share."""
    most = np.minimum(size[i] - place[i], size[others] - place[others])
    return (5 * size[i] >= 4 * size[others]) & (9 * most >= 4 * (size[i] + size[others]))


def _all_or_next(few: int, node: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(node) > few:
        near = 5 * size[:-1] >= 4 * size[1:]
        yield node[:-1][near], node[1:][near]
        return
    for i in range(len(node) - 1):
        b = node[i + 1 :][_may(size, place, i, slice(i + 1, None))]
        if len(b):
            yield np.full(len(b), node[i]), b


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits bitmaps differ, row by row."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _apart(few: int, node: np.ndarray, size: np.ndarray, place: np.ndarray, component: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in different components that may be similar by sizes, places and bitmaps."""
    for i in range(len(node) - 1):
        end = int(np.searchsorted(size, 5 * size[i] // 4, "right"))
        others = slice(i + 1, max(end, i + 1))
        near = np.flatnonzero(_may(size, place, i, others) & (component[others] != component[i])) + i + 1
        near = near[9 * _differ(bitmap[near], bitmap[i]) <= size[i] + size[near]]
        if len(near):
            yield np.full(len(near), node[i]), node[near]


def _thinned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that may be similar by their bitmaps."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, BUCKETS // 8) for c in ("x", "y"))
                near = 9 * _differ(x, y) <= batch["n"].to_numpy() + batch["m"].to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(near))

    left = pairs.distinct().join(sets.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("bitmap").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("bitmap").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(thin, "a long, b long")


def _similar(pairs: DataFrame, members) -> DataFrame:
    """The pairs that are similar indeed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = cut(pairs)
    release(left.sparkSession)
    have = store(members(left.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    both = left.join(have.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    near = cut(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct())
    del both
    release(near.sparkSession)
    return near


def similar_pairs(sets: DataFrame, members) -> DataFrame:
    """``a, b``: links among nodes that have the same components as all pairs of similar sets.

    ``sets`` has ``node, size, prefix, bitmap``, a row for each node (or several equal ones). ``members(nodes)``
    gives ``node, members`` (the sorted 64-bit members as binary) for those that are asked for.
    """
    rows = sets.select(F.posexplode("prefix").alias("place", "gram"), "node", F.col("size")).select("gram", "node", "size", "place")
    made = cut(_grouped(rows, _all_or_next, rest=True))
    release(made.sparkSession)
    found = _similar(_thinned(made.where("b is not null").select("a", "b"), sets), members)
    crowded = made.where("b is null").select("gram", F.col("a").alias("node"), "size", "place")
    if crowded.isEmpty():
        return found
    reached = connected_components(found)
    labelled = crowded.join(reached, "node", "left").join(sets.select("node", "bitmap"), "node").select("gram", "node", "size", "place", F.coalesce("component", "node").alias("component"), "bitmap")
    return found.unionByName(_similar(_grouped(labelled, _apart, rest=False).select("a", "b").distinct(), members))
