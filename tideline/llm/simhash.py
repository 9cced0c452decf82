"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are points of 64 bits. Each bit position gets one of the 16
vectors of 4 bits; table v (1 to 15) keeps the positions whose vector has an odd
inner product with v. The vectors of up to three differing positions span three
dimensions at most, so some v is orthogonal to all of them, and in that table
the two fingerprints agree: no pair within the radius is missed.

Equal fingerprints are one point from the start. In a table's bucket of up to
``dense`` points, all points are compared by XOR and bit count, 8 bytes each.
Larger buckets go another exact way that is linear in their size: points within
one bit of a centre are linked with all points within two bits of the same
centre. A pair at distance up to three has such a centre, and no other pair
gets linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.llm import shingles
from tideline.llm.text import row_key, small_batches, whole
from tideline.operators.graph import connected_components

RADIUS, BITS = 3, 64
#: Points of a bucket that are compared directly: at most 64 KB, and 32 million comparisons of a few nanoseconds.
DENSE = 8192
#: Keys of texts to read again that are broadcast.
ASKED = 200_000
#: Keys of rows to drop that are broadcast (16 MB).
SEND_KEYS = 1_000_000


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The structured masks: 2^(radius + 1) - 1 sets of bit positions."""
    vectors = [i % (1 << (radius + 1)) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text: XXH64 (seed 42) of its word shingles, repeats included."""
    return point_of(shingles.hashes(text, width))


def point_of(hashes: np.ndarray) -> int:
    """The SimHash of hashes of shingles; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", width: int = 3) -> DataFrame:
    """``doc_id, point`` (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(x, width) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(points)], ["doc_id", "point"])

    return docs.select(F.col(ident).alias("doc_id"), whole(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, point long")


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the points of one bucket: each point that is reached, with one that reached it."""
    left, out = np.unique(points), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            out += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def links(points: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """``a, b``: links among distinct ``point`` values that have the same components as all pairs within ``radius`` bits."""
    if radius != 3:
        raise ValueError("centres are set out for a radius of 3")
    keep = masks(radius)
    keyed = points.select("point", F.posexplode(F.array(*(F.col("point").bitwiseAND(F.lit(_signed(m))) for m in keep))).alias("table", "bucket"))
    sizes = keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["table", "bucket"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            found = _forest(np.concatenate(held), radius)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            table, bucket, point = (batch[c].to_numpy() for c in ("table", "bucket", "point"))
            edges = [0, *(np.flatnonzero((table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1])) + 1), len(point)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if at is not None and at != (table[i], bucket[i]):
                    yield close()
                    held = []
                at = (table[i], bucket[i])
                held.append(point[i:j])
        if at is not None:
            yield close()

    small = shared.where(F.col("n") <= dense).select("table", "bucket", "point").repartition("table", "bucket").sortWithinPartitions("table", "bucket")
    found = small.mapInArrow(compare, "a long, b long")
    large = shared.where(F.col("n") > dense)
    if not large.isEmpty():
        found = found.unionByName(_by_centres(large, keep))
    return found


def _by_centres(large: DataFrame, keep: list[int]) -> DataFrame:
    """Links within buckets of any size, by centres at one bit from one point and two from the other.

    Points of a bucket differ in the free bits of its table only (32 of them), so each has 1 + 32 centres near and 496 further centres.
    """
    free = [[i for i in range(BITS) if not m >> i & 1] for m in keep]
    near = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in f)) for f in free))
    far = F.array(*(F.array(*(F.lit(_signed(1 << i | 1 << j)) for i, j in combinations(f, 2))) for f in free))
    at: list[Column] = [F.explode(F.element_at(x, F.col("table") + 1)).alias("flip") for x in (near, far)]
    centred = lambda flips: large.select("table", "point", flips).select("table", "point", F.col("point").bitwiseXOR(F.col("flip")).alias("centre"))
    hub = centred(at[0]).groupBy("table", "centre").agg(F.min("point").alias("hub"))
    both = centred(at[0]).unionByName(centred(at[1]))
    return both.join(hub, ["table", "centre"]).where("point <> hub").select(F.col("hub").alias("a"), F.col("point").alias("b")).distinct()


def components(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", width: int = 3, dense: int = DENSE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each document.

    Documents whose fingerprints are linked through pairs within three bits
    share a ``component_id``, the smallest ``doc_id`` among them. Null and
    empty texts have fingerprint zero and are linked like any other. A null
    ``doc_id`` is never the smallest unless the whole component has none.
    Repeated rows each give a row. Empty table: no rows. Extra columns are ignored.
    """
    own = cut(fingerprints(docs, text=text, ident=ident, width=width))
    points = own.groupBy("point").agg(F.min("doc_id").alias("least"))
    reached = connected_components(links(points.select("point"), dense=dense))
    group = points.join(reached, points["point"] == reached["node"], "left").select("point", "least", F.coalesce("component", "point").alias("component"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    names = group.join(least, "component").select("point", "component_id")
    return own.join(names, "point").select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", width: int = 5, dense: int = DENSE, similar: bool = False, send: int = SEND_KEYS) -> DataFrame:
    """One document of each component, with its columns: the one with the smallest ``doc_id`` (null last), then by content.

    Documents are linked if their fingerprints are within three bits, with
    ``similar`` also if their sets of shingles have a Jaccard similarity of four
    fifths or more. Of rows that are equal in all columns one stays. The texts
    are not shuffled: the rows to drop are known by 16 bytes each, which go to
    all executors up to ``send`` of them, after a count; beyond that they are
    joined by a shuffle.
    """
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(ident).alias("doc_id"), F.col(text).alias("text"), *row_key(docs, *(f"`{c}`" for c in docs.columns)))
    small_batches(docs.sparkSession)
    keys, stay = (_by_sets if similar else _by_fingerprints)(keyed, docs.schema[ident].dataType.simpleString(), width, dense)
    counts = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    stay = stay.withColumn("stays", F.lit(True))
    # rows to drop, and rows to keep one of: no others need a look
    marks = cut(counts.join(stay, ["k1", "k2"], "left").where("stays is null or n > 1").select("k1", "k2", F.col("stays").isNotNull().alias("one")))
    marks = F.broadcast(marks) if marks.count() <= send else marks
    met = keyed.select("row", "k1", "k2").join(marks, ["k1", "k2"], "left")
    once = met.where("one is null").select("row")
    repeated = met.where("one").select("row", "k1", "k2").dropDuplicates(["k1", "k2"]).select("row")
    return once.unionByName(repeated).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _by_fingerprints(keyed: DataFrame, kind: str, width: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """``k1, k2`` of all rows, and of the first row of each component of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(x, width) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "k1", "k2")), pa.array(points)], ["doc_id", "k1", "k2", "point"])

    own = cut(keyed.select("doc_id", "k1", "k2", whole("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, point long"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    points = cut(own.groupBy("point").agg(F.min(first).alias("first")))
    reached = connected_components(links(points.select("point"), dense=dense))
    group = points.join(reached, points["point"] == reached["node"], "left").select("first", F.coalesce("component", "point").alias("component"))
    return own.select("k1", "k2"), group.groupBy("component").agg(F.min("first").alias("first")).select("first.k1", "first.k2")


def _by_sets(keyed: DataFrame, kind: str, width: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """``k1, k2`` of all rows, and of the first row of each component of fingerprints and similar sets of shingles."""
    frequent = keyed.sparkSession.sparkContext.broadcast(shingles.frequent_shingles(keyed, "text", width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [shingles.hashes(x, width) for x in batch["text"].to_pylist()]
            points = np.array([point_of(x) for x in drawn], np.uint64).view(np.int64)
            sets = [np.unique(x) for x in drawn]
            own = [
                pa.array(points), pa.array([shingles.node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()),
                pa.array([shingles.prefix(x, frequent.value).view(np.int64) for x in sets], pa.list_(pa.int64())),
                pa.array([shingles.bitmap(x) for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "k1", "k2")), *own], ["doc_id", "k1", "k2", "point", "node", "size", "prefix", "bitmap"])

    shape = f"doc_id {kind}, k1 long, k2 long, point long, node long, size int, prefix array<long>, bitmap binary"
    own = store(keyed.select("doc_id", "k1", "k2", whole("text").cast("binary").alias("text")).mapInArrow(run, shape))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = cut(own.groupBy("node").agg(F.min(first).alias("first"), F.min(F.struct("k1", "k2")).alias("of"), F.count("*").alias("times")))
    # a set that several texts have speaks through one of them; the others are left out where they are read
    shared = nodes.where("times > 1").select("node", "of")
    shared = F.broadcast(shared) if nodes.where("times > 1").count() <= SEND_KEYS else shared
    sets = own.join(shared, "node", "left").where("of is null or (of.k1 = k1 and of.k2 = k2)").select("node", "size", "prefix", "bitmap")

    def members(asked: DataFrame) -> DataFrame:
        """The sets of the nodes asked for, made again from one text each (or from the rows that are equal to it)."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array([np.unique(shingles.hashes(x, width)).tobytes() for x in batch["text"].to_pylist()], pa.binary())], ["node", "members"])

        keys = cut(nodes.join(asked, "node", "left_semi").select("node", "of.k1", "of.k2"))
        keys = F.broadcast(keys) if keys.count() <= ASKED else keys
        texts = keyed.join(keys, ["k1", "k2"]).select("node", whole("text").cast("binary").alias("text"))
        return texts.mapInArrow(read, "node long, members binary")

    points = own.groupBy("point").agg(F.min("node").alias("least"))
    names = points.select("point", "least")
    near = links(points.select("point"), dense=dense)
    near = near.join(names.select(F.col("point").alias("a"), F.col("least").alias("x")), "a").join(names.select(F.col("point").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = own.join(names, "point").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    reached = connected_components(near.unionByName(same).unionByName(shingles.similar_pairs(sets, members)))
    group = nodes.join(reached, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    return own.select("k1", "k2"), group.groupBy("component").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
