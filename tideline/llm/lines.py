"""Line dedup across documents with two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen
again. Every task fills its own pair; pairs merge block by block: what both
once-filters hold counts as seen again, so the second filter never misses a
repeat. Only lines that the second filter suspects are counted exactly, by
their key itself. The filters have a fixed greatest size; beyond what they can
hold, more lines are suspected and shuffled, and the result stays exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.llm.text import row_key, small_batches, whole

BLANKS = b" \t\n\x0b\x0c\r"
#: log2 of the bits of a filter: at most 2^28 (32 MB), at least 2^20; of the bits in a block that is merged at once.
MOST_BITS, LEAST_BITS, BLOCK_BITS = 28, 20, 19
#: Dropped keys that are sent to all executors at most, in rows and bytes; more are joined by a shuffle.
SEND_ROWS, SEND_BYTES = 500_000, 32 << 20
PROBES = 4


def key_of(line: bytes) -> bytes:
    """The key of a line: stripped of white space at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def keys_of(text: bytes) -> list[bytes]:
    """The keys of all lines of a text (``bytes.lower`` changes A to Z only)."""
    return [x.strip(BLANKS) for x in text.lower().split(b"\n")]


def _enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least == 1 or len(key.decode()) >= least)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row per hash: double hashing with an odd step."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> 3, np.left_shift(np.uint8(1), (places.ravel() & 7).astype(np.uint8)))


def _hashes(batch: pa.RecordBatch, least: int) -> np.ndarray:
    """The hash of each key, once per document."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((h for text in batch["text"].to_pylist() for h in {digest(k) for k in keys_of(text) if _enough(k, least)}), np.uint64)


def suspects_filter(rows: DataFrame, lines: int, least: int) -> tuple[bytes, int]:
    """The twice-seen filter over all ``rows`` (a binary column ``text``), and log2 of its bits.

    ``lines`` is the number of lines; the filter has about 12 bits for each, within its limits. Blocks are merged on the executors; the driver gets the finished filter, of 32 MB at most.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (12 * max(lines, 1)).bit_length()))
    size, block = 1 << (bits - 3), 1 << (min(bits, BLOCK_BITS) - 3)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            hashes, counts = np.unique(_hashes(batch, least), return_counts=True)
            places = _places(hashes, bits)
            seen = _has(once, places) | (counts > 1)
            _set(again, places[seen])
            _set(once, places)
        for k in range(0, size, block):
            a, b = once[k : k + block], again[k : k + block]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], ["block", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], ["block", "once", "again"])
        for batch in batches:
            for k, a, b in zip(*(batch[c].to_pylist() for c in ("block", "once", "again"))):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k != at:
                    if at is not None:
                        yield out()
                    at, once, again = k, a.copy(), b.copy()
                else:
                    again |= b | (once & a)
                    once |= a
        if at is not None:
            yield out()

    kinds = "block int, once binary, again binary"
    made = rows.select("text").mapInArrow(fill, kinds)
    # two rounds of merging: a block's pairs are dealt to up to 16 tasks first
    made = made.withColumn("part", F.crc32("once") % 16).repartition("block", "part").sortWithinPartitions("block").select("block", "once", "again").mapInArrow(merge, kinds)
    made = made.repartition("block").sortWithinPartitions("block").mapInArrow(merge, kinds)
    bitmap = bytearray(size)
    for row in made.select("block", "again").toLocalIterator():
        bitmap[row.block * block : (row.block + 1) * block] = zlib.decompress(row.again)
    return bytes(bitmap), bits


def repeated_keys(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", least: int = 1, documents: int = 10):
    """Keys of ``least`` code points or more found in ``documents`` rows or more (at least 2).

    Returns the frame ``(key binary, n_docs, first_doc)``, and a function that
    tells which keys of a list the twice-seen filter suspects. ``first_doc`` is
    the smallest ``doc_id`` with the line (null if none has one).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).alias("doc_id"), whole(text).cast("binary").alias("text"))
    lines = docs.select(F.sum(F.length(whole(text)) - F.length(F.replace(whole(text), F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bitmap, bits = suspects_filter(rows, lines or 0, least)
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(bitmap, 1))
    kind = docs.schema[ident].dataType.simpleString()
    memo: list[np.ndarray] = []

    def suspected(keys: list[bytes]) -> list[bytes]:
        if not memo:
            memo.append(np.frombuffer(zlib.decompress(sent.value), np.uint8))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        return [keys[i] for i in np.flatnonzero(_has(memo[0], _places(hashes, bits)))]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0

        def out(like: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], like)], ["key", "n", "first"])

        like = None
        for batch in batches:
            like = batch.schema.field("doc_id").type
            for own, value in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                keys = [k for k in set(keys_of(value)) if _enough(k, least)]
                for k in suspected(keys) if keys else ():
                    if k not in found:
                        held += len(k) + 200
                        found[k] = [1, own]
                    else:
                        x = found[k]
                        x[0] += 1
                        if own is not None and (x[1] is None or own < x[1]):
                            x[1] = own
            if held > 64 << 20:
                yield out(like)
                found, held = {}, 0
        if found:
            yield out(like)

    counted = rows.mapInArrow(suspects, f"key binary, n long, first {kind}").groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first_doc"))
    return counted.where(F.col("n_docs") >= documents), suspected


def drop_repeated_lines(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", least: int = 1, documents: int = 10, send_rows: int = SEND_ROWS, send_bytes: int = SEND_BYTES, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text, kept_sha256`` for each document.

    Lines whose key is in ``documents`` rows or more lose all their copies, or,
    with ``keep_first``, all but those in the first document: the one with the
    smallest ``doc_id``. Rows that share that id all keep the line, and so do
    all rows with the line if none of them has an id. The keys to drop go to
    all executors if they are within ``send_rows`` and ``send_bytes``, both
    checked; else they are joined to the rows by a shuffle.

    Null or empty text: one empty line, which has no key and stays. Repeated
    rows count as documents of their own. Null ``doc_id`` stays null. Empty
    table: no rows. Extra columns are ignored. A text of any length is one row
    in memory.
    """
    spark = docs.sparkSession
    counted, suspected = repeated_keys(docs, text=text, ident=ident, least=least, documents=documents)
    gone = cut(counted)
    n, size = gone.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("doc_id"), whole(text).cast("binary").alias("text"))
    shape = f"doc_id {kind}, n_lines long, n_dropped long, kept_text binary, kept_sha256 string"

    def kept(batch: pa.RecordBatch, dropped) -> pa.RecordBatch:
        lines, out = [], []
        for who, value, bad in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), dropped):
            own = value.split(b"\n")
            if keep_first:
                bad = {k for k in keys_of(value) if k in bad and bad[k] != who}
            stay = [x for x, k in zip(own, keys_of(value)) if k not in bad] if bad else own
            lines.append((len(own), len(own) - len(stay)))
            out.append(b"\n".join(stay))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int64()), pa.array(out, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"],
        )

    if n <= send_rows and (size or 0) <= send_bytes:
        sent = spark.sparkContext.broadcast({bytes(r.key): r.first_doc for r in gone.select("key", "first_doc").toLocalIterator()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield kept(batch, [sent.value] * batch.num_rows)

        return rows.mapInArrow(apply, shape).withColumn("kept_text", F.col("kept_text").cast("string"))

    keyed = rows.select("*", *row_key(rows, "doc_id", "text"))

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, b, k) for a, b, value in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text"))) for k in suspected([k for k in set(keys_of(value)) if _enough(k, least)])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["k1", "k2", "key"])

    pairs = keyed.select("k1", "k2", "text").mapInArrow(own_keys, "k1 long, k2 long, key binary").join(gone.select("key", "first_doc"), "key")
    lists = pairs.groupBy("k1", "k2").agg(F.collect_set(F.struct("key", "first_doc")).alias("gone"))  # bounded by the lines of a document

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kept(batch, [{y["key"]: y["first_doc"] for y in x or ()} for x in batch["gone"].to_pylist()])

    joined = keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(apply_own, shape).withColumn("kept_text", F.col("kept_text").cast("string"))
