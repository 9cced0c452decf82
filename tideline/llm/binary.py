"""Token sequences in training order, as fixed-stride binary shards.

Documents are laid end to end in the order in which they stand in their files,
each followed by an end mark, and the stream of token ids is cut into sequences
of ``length``; only the last one is filled up with end marks. Every task encodes
its stretch of the input once; the sizes of the stretches before it, one number
per stretch, tell where in the stream it begins. So the sequences, numbered 0 to
N - 1, don't depend on how the input is split among tasks.

A keyed Feistel permutation with cycle-walking gives each sequence its slot in
training order: a one-to-one map that needs no sort and no table. With ``phases``
the sequences are divided into that many equal stretches, each permuted in
itself: the order of the input, a curriculum, holds from phase to phase.

Slots divide into shards of ``per_shard`` sequences; each task takes a range of
shards, in slot order, and writes them. That is done in passes of a part of the
shards each, so that only a part of the tokens lies in a shuffle at once; the
rows then read their tokens from the shards. Since every sequence has the same stride,
slot s lies at byte (s mod per_shard) * stride of shard s div per_shard, and
reading can go on from any slot (:func:`read_slots`).
"""

from __future__ import annotations

import base64
import contextlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut, delete, shuffles_deleted, store, tables
from tideline.llm.text import row_key, small_batches, whole

LENGTH, PER_SHARD, KEY = 1024, 1024, 0x5DEECE66D
#: Number of stretches (about 100 bytes each) whose places go to all executors at most; more are joined by a shuffle.
SEND_STRETCHES = 500_000
ROUNDS = 6
#: Parts of the shards that are written one after the other; each reads the stored tokens again and shuffles its share of them.
PASSES = 4


def _round(right: np.ndarray, key: int, turn: int, bits: int) -> np.ndarray:
    x = right + np.uint64((key + turn * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64((1 << bits) - 1)


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of ``index`` under the permutation of 0 to n - 1, or with ``inverse`` the other way.

    The network works on the least number of bits, split in two, that hold n - 1;
    values that fall outside walk on along their cycle until they are inside.
    """
    bits = max(2, int(n - 1).bit_length())
    a, b = bits - bits // 2, bits // 2
    low = lambda k: np.uint64((1 << k) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        for turn in turns:
            # even turns change the upper part by the lower, odd turns the lower by the upper
            high, deep = v >> np.uint64(b), v & low(b)
            if turn % 2 == 0:
                high = high ^ _round(deep, key, turn, a)
            else:
                deep = deep ^ _round(high, key, turn, b)
            v = (high << np.uint64(b)) | deep
        return v

    out = np.asarray(index).astype(np.uint64)
    if out.size and int(out.max()) >= n:
        raise ValueError("an index lies outside the permutation")
    todo = np.ones(out.shape, bool)
    while todo.any():
        out[todo] = once(out[todo])
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def slots(index: np.ndarray, n: int, key: int = KEY, phases: int = 1, inverse: bool = False) -> np.ndarray:
    """The slots of sequences, or with ``inverse`` the sequences of slots: a permutation within each of ``phases`` stretches of 0 to n - 1."""
    index = np.asarray(index, np.int64)
    phases = max(1, min(phases, n))
    edges = np.array([n * p // phases for p in range(phases + 1)], np.int64)
    at, out = np.searchsorted(edges, index, "right") - 1, np.empty(len(index), np.int64)
    for p in np.unique(at):
        own = at == p
        out[own] = edges[p] + permute(index[own] - edges[p], int(edges[p + 1] - edges[p]), key + int(p), inverse)
    return out


def _placed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """``file, row, doc_id, text``: the documents with their places in their files.

    A frame that isn't read from files straight away is first written in the order of a hash of id and text.
    """
    own = lambda x: x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(ident).alias("doc_id"), whole(text).alias("text"))
    if "_metadata" in docs._jdf.queryExecution().analyzed().metadataOutput().toString():
        with contextlib.suppress(AnalysisException):  # files whose rows have no numbers
            return own(docs)
    keyed = docs.select(F.col(ident), F.col(text)).withColumns(dict(zip(("__k1", "__k2"), row_key(docs, ident, text))))
    return own(store(keyed.repartitionByRange("__k1", "__k2").sortWithinPartitions("__k1", "__k2")))


def token_stretches(docs: DataFrame, ranks_path: str, *, text: str = "text", ident: str = "doc_id", end: int = 50_256) -> DataFrame:
    """``file, first, at, doc_id, n, tokens``: each document's ids of 16 bits, little-endian, its end mark included.

    ``file, first`` name the stretch by its first row; ``at`` counts the tokens before the document in it.
    """
    if end >= 1 << 16:
        raise ValueError("ids of 16 bits can't hold the end mark")
    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, first, last, at = _encoding(ranks_path).encode_ordinary, None, 0, -1, 0
        for batch in batches:
            files, firsts, ats, sizes, made = [], [], [], [], []
            for name, row, value in zip(*(batch[c].to_pylist() for c in ("file", "row", "text"))):
                if name != file or row <= last:
                    file, first, at = name, row, 0
                last = row
                ids = array("H", encode(value))
                ids.append(end)
                files.append(file)
                firsts.append(first)
                ats.append(at)
                sizes.append(len(ids))
                made.append(ids.tobytes())
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(firsts, pa.int64()), pa.array(ats, pa.int64()), batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["file", "first", "at", "doc_id", "n", "tokens"])

    return _placed(docs, text, ident).mapInArrow(run, f"file string, first long, at long, doc_id {kind}, n long, tokens binary")


def training_shards(docs: DataFrame, ranks_path: str, *, uri: str | None = None, text: str = "text", ident: str = "doc_id", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, phases: int = 1, end: int = 50_256) -> DataFrame:
    """All sequences with their slots: ``slot, shard, path, byte_offset, doc_ids, begins, n_tokens, tokens``, in ranges of shards and sorted by slot.

    ``doc_ids``: the documents with tokens in the sequence, in order, each with
    the place where its tokens begin (``begins``). ``n_tokens`` is ``length``
    for all but the last sequence of the stream. With ``uri``, a folder that all
    executors reach, the shards are written there before this returns, and the
    rows read their tokens from them.

    The order of documents is that of the files by name, and of rows within
    them; the token table is written first, so it holds whatever task is lost.
    Once the shards are there, it is deleted.

    Null and empty texts: the end mark alone. Repeated rows each have their
    tokens. Null ``doc_id`` stays null. Empty table: no rows. Extra columns are
    ignored. A very long text is cut into as many sequences as it needs.
    """
    spark, kind = docs.sparkSession, docs.schema[ident].dataType.simpleString()
    with tables() as held:
        made = store(token_stretches(docs, ranks_path, text=text, ident=ident, end=end), compression="zstd")
    sizes = made.groupBy("file", "first").agg(F.sum("n").alias("size"))
    # one row per stretch of a file that a task read
    order = Window.orderBy(F.length("file"), "file", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = cut(sizes.select("file", "first", "size", (F.sum("size").over(order) - F.col("size")).alias("base")))
    total, stretches = bases.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n, bases = -(-total // length), bases.drop("size")
    based = made.join(F.broadcast(bases) if stretches <= SEND_STRETCHES else bases, ["file", "first"]).select((F.col("base") + F.col("at")).alias("begin"), "doc_id", "tokens")
    columns = f"slot long, shard long, path string, byte_offset long, doc_ids array<{kind}>, begins array<int>, n_tokens int"
    shards = max(1, -(-n // per_shard))

    def dealt(rows: DataFrame, low: int, high: int) -> DataFrame:
        """Rows of the shards from ``low`` to ``high`` - 1, in ranges of them."""
        count = high - low
        tasks = max(min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-count // 64))
        # slots are evenly filled, so ranges of shards need no sample of the rows
        return rows.repartitionById(tasks, F.floor((F.floor(F.col("slot") / per_shard) - low) * tasks / count).cast("int"))

    def assembled(low: int, high: int) -> DataFrame:
        placed = based.mapInArrow(_pieces(length, n, key, phases, low * per_shard, high * per_shard), f"slot long, begin int, doc_id {kind}, tokens binary")
        return dealt(placed, low, high).sortWithinPartitions("slot", "begin").mapInArrow(_assemble(length, per_shard, end, uri), columns + ", tokens binary" * (uri is None))

    if uri is None:
        return assembled(0, shards)
    passes, written = min(PASSES, shards), []
    for turn in range(passes):
        with shuffles_deleted(spark):
            written.append(store(assembled(shards * turn // passes, shards * (turn + 1) // passes)))
    for path in held:
        delete(spark, path)
    return dealt(reduce(DataFrame.unionByName, written), 0, shards).sortWithinPartitions("slot").mapInArrow(_read_back(uri, length), columns + ", tokens binary")


def _pieces(length: int, n: int, key: int, phases: int, low_slot: int, high_slot: int):
    """Documents with their tokens become pieces of the sequences with slots from ``low_slot`` to ``high_slot`` - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, own = batch["begin"].to_numpy(), [b.as_buffer() for b in batch["tokens"]]
            lengths = np.array([b.size // 2 for b in own], np.int64)
            first, last = begins // length, (begins + lengths - 1) // length
            owner = np.repeat(np.arange(len(own)), last - first + 1)
            index = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            where = slots(index, n, key, phases)
            here = np.flatnonzero((where >= low_slot) & (where < high_slot))
            owner, index, where = owner[here], index[here], where[here]
            low = np.maximum(index * length, begins[owner])
            high = np.minimum((index + 1) * length, begins[owner] + lengths[owner])
            # a document of any length leaves in batches of a few megabytes
            for k in range(0, len(owner), 2048):
                part = slice(k, k + 2048)
                cuts = [own[o].slice(2 * (a - begins[o]), 2 * (b - a)).to_pybytes() for o, a, b in zip(owner[part], low[part], high[part])]
                yield pa.RecordBatch.from_arrays([pa.array(where[part]), pa.array((low - index * length)[part].astype(np.int32)), batch["doc_id"].take(pa.array(owner[part])), pa.array(cuts, pa.binary())], ["slot", "begin", "doc_id", "tokens"])

    return run


def _shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Writes sequences in slot order to shards, each under a name of its own attempt that is then moved to its name, so a task that runs twice leaves one whole file."""

    def __init__(self, uri: str | None, per_shard: int):
        self.per_shard, self.at, self.out = per_shard, None, None
        if uri is not None:
            self.store, self.folder = _store(uri)
            self.store.create_dir(self.folder, recursive=True)
        else:
            self.store = None

    def path(self, shard: int) -> str | None:
        return self.store and f"{self.folder}/{_shard_name(shard)}"

    def write(self, first: int, body: bytes, stride: int) -> None:
        """``body``: sequences in neighbouring slots from ``first`` on."""
        count = len(body) // stride
        while self.store and count:
            shard = first // self.per_shard
            if shard != self.at:
                self.close()
                self.at, self.name = shard, f"{self.folder}/.{_shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
                self.out = self.store.open_output_stream(self.name)
            fit = min(count, (shard + 1) * self.per_shard - first)
            self.out.write(body[: fit * stride])
            first, count, body = first + fit, count - fit, body[fit * stride :]

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            try:
                self.store.move(self.name, self.path(self.at))
            except OSError:  # another attempt was first, and this store doesn't replace files
                if not self.store.get_file_info(self.path(self.at)).is_file:
                    raise
                self.store.delete_file(self.name)
            self.at = self.out = None


def _sequences(body: bytes, stride: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(stride), len(body) // stride, [None, pa.py_buffer(body)]).cast(pa.binary())


def _assemble(length: int, per_shard: int, end: int, uri: str | None):
    """Pieces in the order of slots and places become whole sequences; with ``uri`` their tokens go to the shards only."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(uri, per_shard)
        rest: pa.RecordBatch | None = None

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            slot = batch["slot"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            own, offsets = slot[starts], pa.array(np.append(starts, len(slot)).astype(np.int32))
            sizes = np.add.reduceat(np.array([b.as_buffer().size for b in batch["tokens"]], np.int64), starts)
            body = b"".join(batch["tokens"].to_pylist())
            short = np.flatnonzero(sizes < stride)
            if len(short):  # the last sequence of the stream
                cut_at = int(sizes[: short[0] + 1].sum())
                body = body[:cut_at] + np.full((stride - sizes[short[0]]) // 2, end, "<u2").tobytes() + body[cut_at:]
            writer.write(int(own[0]), body, stride)
            shards = own // per_shard
            columns = {
                "slot": pa.array(own), "shard": pa.array(shards), "path": pa.array([writer.path(x) for x in shards.tolist()], pa.string()), "byte_offset": pa.array(own % per_shard * stride), "doc_ids": pa.ListArray.from_arrays(offsets, batch["doc_id"]),
                "begins": pa.ListArray.from_arrays(offsets, batch["begin"]), "n_tokens": pa.array((sizes // 2).astype(np.int32)),
            }
            if uri is None:
                columns["tokens"] = _sequences(body, stride)
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            slot = batch["slot"].to_numpy()
            whole_ones = int(np.searchsorted(slot, slot[-1])) if len(slot) else 0
            rest = batch.slice(whole_ones)
            if whole_ones:
                yield out(batch.slice(0, whole_ones))
        if rest is not None and rest.num_rows:
            yield out(rest)
        writer.close()

    return run


def _read_back(uri: str, length: int):
    """Rows in the order of slots get their tokens from the shards."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, path, file = _store(uri)[0], None, None
        for batch in batches:
            slot, shard, at = (batch[c].to_numpy() for c in ("slot", "shard", "byte_offset"))
            # neighbouring slots of a shard are read at once
            edges = np.flatnonzero(np.concatenate(([True], (np.diff(slot) != 1) | (np.diff(shard) != 0), [True]))) if len(slot) else []
            bodies = []
            for a, b in pairwise(map(int, edges)):
                if batch["path"][a].as_py() != path:
                    if file is not None:
                        file.close()
                    path = batch["path"][a].as_py()
                    file = store_.open_input_file(path)
                file.seek(int(at[a]))
                bodies.append(file.read((b - a) * stride))
                if len(bodies[-1]) != (b - a) * stride:
                    raise OSError(f"{path} ends too early")
            yield batch.append_column("tokens", _sequences(b"".join(bodies), stride))
        if file is not None:
            file.close()

    return run


def manifest(sequences: DataFrame) -> DataFrame:
    """``shard, path, first_slot, n_sequences`` of the rows of :func:`training_shards`."""
    return sequences.groupBy("shard").agg(F.min("path").alias("path"), F.min("slot").alias("first_slot"), F.count("*").alias("n_sequences"))


def read_slots(uri: str, first: int = 0, *, length: int = LENGTH, per_shard: int = PER_SHARD, at_once: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot ``first`` on to the last, read in order from the shards under ``uri``; what stops can go on from any slot."""
    store_, folder = _store(uri)
    shard, skip, stride = first // per_shard, first % per_shard, 2 * length
    while store_.get_file_info(f"{folder}/{_shard_name(shard)}").is_file:
        with store_.open_input_file(f"{folder}/{_shard_name(shard)}") as file:
            file.seek(skip * stride)
            slot = shard * per_shard + skip
            while body := file.read(at_once * stride):
                for k in range(0, len(body), stride):
                    yield slot, np.frombuffer(body, "<u2", length, k)
                    slot += 1
        shard, skip = shard + 1, 0
