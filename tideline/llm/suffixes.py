"""Repeated passages by sparse suffix arrays.

Of all suffixes (from each word to the end of its text), only those are kept
that begin at minimisers: in every window of ``SPREAD`` neighbouring word
5-grams, the one with the least hash. The choice depends on the words alone, so
both copies of a passage of ``LONG`` words keep a suffix at the same place of
the passage, with at least ``REACH`` words of the passage ahead of it and fewer
than ``SPREAD`` behind it.

Suffixes whose first ``REACH`` words no other text has are dropped, by a hash.
Those that agree in all words that a passage around them can reach (``SPREAD`` - 1
to the left, ``LONG`` to the right) need no further look, and one of them speaks
for the others. The rest are put in suffix order: range-partitioned by their
first ``REACH`` words and sorted by their first ``LONG``, word by word. How many
words neighbours share tells which stretches of the order share 11, 12, ... 50
words to the right; the same order of what lies to the left, read backwards, tells
which share 0, 1, ... 39 words there. A passage that begins d words to the left of
a suffix is repeated where two texts share d words to the left and 50 - d to the
right. Overlapping passages join up to the longest.

First words that more than ``HOT`` suffixes share (a passage of every document,
with something else around it in each) would fill a task; their passages are
counted by hash with partial aggregation instead, and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import store
from tideline.llm.text import small_batches, whole
from tideline.operators.postings import small

LONG, SPREAD, GRAM = 50, 40, 5
REACH = LONG - SPREAD + 1
#: Suffixes with the same first words that one task compares, about 1.5 MB; suffixes that a task sets out at once.
HOT, AT_ONCE = 2_000, 20_000
#: Texts, and places in them, that are sent to all executors at most for extension (about 64 MB); more are joined by a shuffle.
SEND_TEXTS, SEND_PLACES = 300_000, 8_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: bytes, memo: _Hashes) -> np.ndarray:
    """The hashes of the words of a text, A-Z lowered."""
    words = text.lower().split()
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, by doubling: runs of 1, 2, 4, ... words put together."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                k = min(len(out), len(power) - have)
                out, have = _stir(out[:k] + _stir(power[have : have + k]) * MIX), have + size
        size *= 2
        if size > n:
            return out[: len(h) - n + 1]
        k = len(power) - size // 2
        power = _stir(power[:k] + _stir(power[size // 2 : size // 2 + k]) * MIX)


def _least_of_windows(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each window, by doubling."""
    have = 1
    while have < wide:
        step = min(have, wide - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def window_minimisers(h: np.ndarray) -> np.ndarray:
    """The place of the minimiser of each window of 5-grams; of equal ones the first."""
    grams = run_hashes(h, GRAM)
    if not len(grams):
        return np.empty(0, np.int64)
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    return order[_least_of_windows(rank, min(SPREAD, len(grams)))]


def minimisers(h: np.ndarray) -> np.ndarray:
    """The places of all minimisers of a text."""
    return np.unique(window_minimisers(h))


def kept_suffixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of the first REACH words, hash of all in reach) of the kept suffixes."""
    at = minimisers(h)
    at = at[at + REACH <= len(h)]
    first = run_hashes(h, REACH)[at]
    # the ends of the text stand as words of their own
    padded = np.concatenate([np.full(SPREAD - 1, 1, np.uint64), h, np.full(LONG, 2, np.uint64)])
    return at, first, run_hashes(padded, SPREAD - 1 + LONG)[at]


def repeats(docs: DataFrame, *, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id, begin, end, n_words, partner_id`` of each stretch of words that lies in passages of ``LONG`` words repeated in other documents.

    Places are in words (split at white space, A-Z lowered), ends exclusive; stretches of a document neither touch nor overlap. ``partner_id`` is the
    smallest ``doc_id`` with one of the passages, or the largest if the smallest
    is the document itself.

    Repeats inside one document don't count, and rows with the same ``doc_id``
    and text are one document. Null and empty texts have no passages. A null ``doc_id`` is a
    document like any other but no partner. Empty table: no rows. Extra columns
    are ignored. A very long text has rows in proportion to its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("doc_id"), whole(text).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            made: list[tuple[np.ndarray, ...]] = []
            for i, value in enumerate(batch["text"].to_pylist()):
                hashes = word_hashes(value, memo)
                at, first, around = kept_suffixes(hashes)
                made.append((np.full(len(at), i), at.astype(np.int32), first.view(np.int64), around.view(np.int64), np.full(len(at), len(hashes), np.int32)))
            if made:
                yield _rows(batch, made, ["at", "first", "around", "n"])

    suffixes = store(rows.mapInArrow(keep, f"doc_id {kind}, k long, at int, first long, around long, n int"))
    # most first words are like no others, and drop out here
    again = suffixes.groupBy("first").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.count("*").alias("times")).where("k0 <> k1").select("first", "times")
    found = store(_compared(suffixes, store(again)))

    marks = found.groupBy("doc_id", "k").agg(F.collect_list("at").alias("shared"), F.collect_list(F.when(F.col("open") & ~F.col("hot"), F.col("at"))).alias("open"), F.collect_list(F.when(F.col("open") & F.col("hot"), F.col("at"))).alias("hot"))
    marks = store(marks.where("size(open) + size(hot) > 0").withColumnsRenamed({"doc_id": "m_id", "k": "m_k"}))
    n, places = marks.agg(F.count("*"), F.sum(F.size("shared") + F.size("open") + F.size("hot"))).first()
    marks = F.broadcast(marks) if n <= SEND_TEXTS and (places or 0) <= SEND_PLACES else marks
    texts = rows.join(marks, (F.col("k") == F.col("m_k")) & F.col("doc_id").eqNullSafe(F.col("m_id"))).select("doc_id", "k", "text", "shared", "open", "hot")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for i, (value, shared, places, hot) in enumerate(zip(*(batch[c].to_pylist() for c in ("text", "shared", "open", "hot")))):
                hashes = word_hashes(value, memo)
                at = np.array(places, np.int64)
                for k in range(0, len(at), 4096):
                    yield _in_place(batch, i, len(hashes), at[k : k + 4096], *_surroundings(hashes, at[k : k + 4096]))
                if hot:
                    begin, passages = _own_passages(hashes, shared, hot)
                    yield _in_place(batch, i, len(hashes), begin, None, None, passages[begin].view(np.int64))

    set_out = store(texts.mapInArrow(extend, f"doc_id {kind}, k long, n int, at int, ahead binary, behind binary, passage long"))
    usual = set_out.where("ahead is not null").select("doc_id", "k", "n", "at", "ahead", "behind")
    ordered = usual.repartitionByRange(F.substring("ahead", 1, 8 * REACH)).sortWithinPartitions("ahead")
    extended = ordered.mapInArrow(_neighbours, f"doc_id {kind}, k long, n int, begin int, end int, least {kind}, most {kind}")
    passages = set_out.where("passage is not null").select("doc_id", "k", "n", F.col("at").alias("begin"), "passage")
    equal = passages.groupBy("passage").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("k0 <> k1")
    counted = passages.join(equal, "passage").select("doc_id", "k", "n", "begin", (F.col("begin") + LONG).alias("end"), "least", "most")
    settled = found.where("same").select("doc_id", "k", "n", (F.col("at") - (SPREAD - 1)).alias("begin"), (F.col("at") + LONG).alias("end"), "least", "most")
    return _stretches(settled, extended.unionByName(counted), kind)


def _surroundings(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words from each place on, and those before it read backwards, as bytes whose order is that of the words' hashes; the ends of the text stand as words of their own."""
    padded = np.concatenate([np.full(SPREAD - 1, 1, np.uint64), hashes, np.full(LONG, 2, np.uint64)]).astype(">u8")
    around = np.lib.stride_tricks.sliding_window_view(padded, SPREAD - 1 + LONG)[at]
    return np.ascontiguousarray(around[:, SPREAD - 1 :]), np.ascontiguousarray(around[:, : SPREAD - 1][:, ::-1])


def _own_passages(hashes: np.ndarray, shared: list[int], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where passages around ``places`` begin whose own minimisers are all shared (else they aren't repeated), and the hashes of all passages."""
    passages = run_hashes(hashes, LONG)
    begin = np.unique((np.array(places, np.int64)[:, None] - np.arange(SPREAD)).ravel())
    begin = begin[(begin >= 0) & (begin < len(passages))]
    least = window_minimisers(hashes)
    kept = np.zeros(len(hashes), bool)
    kept[np.array(shared, np.int64)] = True
    for k in range(LONG - GRAM - SPREAD + 2):
        at = least[begin + k]
        begin = begin[(at + REACH > begin + LONG) | kept[at]]
    return begin, passages


def _in_place(batch: pa.RecordBatch, i: int, n: int, at: np.ndarray, ahead: np.ndarray | None, behind: np.ndarray | None, passage: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of text ``i`` of a batch, one for each place."""
    take = pa.array(np.full(len(at), i))
    binary = lambda x: pa.nulls(len(at), pa.binary()) if x is None else pa.Array.from_buffers(pa.binary(8 * x.shape[1]), len(at), [None, pa.py_buffer(x)]).cast(pa.binary())
    passages = pa.nulls(len(at), pa.int64()) if passage is None else pa.array(passage)
    return pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["k"].take(take), pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), binary(ahead), binary(behind), passages], ["doc_id", "k", "n", "at", "ahead", "behind", "passage"])


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(len(column), -1)


def _shared_words(rows: np.ndarray) -> np.ndarray:
    """How many words each row shares with the one before it, from the beginning."""
    equal = rows[1:] == rows[:-1]
    return np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order, compared with their neighbours and extended; those with the same first words are always looked at together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            every = pa.concat_batches(held)
            apart = np.flatnonzero(_shared_words(_words(every["ahead"])) < REACH)
            edge = int(apart[-1]) + 1 if len(apart) else 0
            if edge:
                yield _extended(every.slice(0, edge))
            held = [every.slice(edge)]
    if sum(x.num_rows for x in held):
        yield _extended(pa.concat_batches(held))


def _extended(suffixes: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, k, n, begin, end, least, most``: stretches of repeated passages around each of some suffixes in order."""
    rows = suffixes.num_rows
    at, size, k = (suffixes[c].to_numpy().astype(np.int64) for c in ("at", "n", "k"))
    owners = suffixes["doc_id"].to_pylist()
    names = sorted({x for x in owners if x is not None})
    place = {x: i for i, x in enumerate(names)}
    low, high = (np.array([place.get(x, none) for x in owners], np.int64) for none in (len(names), -1))
    right = _shared_words(_words(suffixes["ahead"]))
    behind = _words(suffixes["behind"])
    order = np.argsort(behind.view(f"V{8 * behind.shape[1]}").ravel(), kind="stable")
    left = _shared_words(behind[order])
    hits = np.zeros((rows, SPREAD), bool)
    least, most = np.zeros((rows, SPREAD), np.int64), np.zeros((rows, SPREAD), np.int64)
    for d in range(SPREAD):
        inside = np.flatnonzero((at >= d) & (at - d + LONG <= size))
        if not len(inside):
            continue
        ahead, back = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        ahead[1:] = np.cumsum(right < LONG - d)
        back[order[1:]] = np.cumsum(left < d)
        group = ahead[inside] * rows + back[inside]
        by = np.argsort(group, kind="stable")
        member, group = inside[by], group[by]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        counts = np.diff(np.append(starts, len(member)))
        spread = lambda x: np.repeat(x, counts)  # noqa: E731, B023
        hits[member, d] = spread(np.minimum.reduceat(k[member], starts) != np.maximum.reduceat(k[member], starts))
        least[member, d] = spread(np.minimum.reduceat(low[member], starts))
        most[member, d] = spread(np.maximum.reduceat(high[member], starts))
    # neighbouring beginnings make one stretch
    row, d = np.nonzero(hits)
    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1)))) if len(row) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
    own = row[starts]
    named = lambda x: pa.array([names[i] if 0 <= i < len(names) else None for i in x.tolist()], suffixes["doc_id"].type)
    some = lambda f, x: f.reduceat(x[row, d], starts) if len(row) else np.empty(0, np.int64)
    take = pa.array(own)
    return pa.RecordBatch.from_arrays(
        [suffixes["doc_id"].take(take), suffixes["k"].take(take), suffixes["n"].take(take), pa.array((at[own] - d[ends]).astype(np.int32)), pa.array((at[own] - d[starts] + LONG).astype(np.int32)), named(some(np.minimum, least)), named(some(np.maximum, most))],
        ["doc_id", "k", "n", "begin", "end", "least", "most"],
    )


def _rows(batch: pa.RecordBatch, made: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """The rows that a batch of texts gave: first their places in the batch, then the columns ``names``."""
    place, *columns = (np.concatenate(c) for c in zip(*made))
    take = pa.array(place)
    return pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["k"].take(take), *map(pa.array, columns)], ["doc_id", "k", *names])


def _compared(suffixes: DataFrame, again: DataFrame) -> DataFrame:
    """Neighbours compared: ``same`` if a suffix agrees with one of another text in all that is in reach, ``open`` if
    it is to be extended: others begin alike but differ, and it is not ``same`` or speaks for those that are.

    ``again``: ``(first, times)`` of first words in several texts. Up to ``HOT``
    suffixes with the same first words are sorted and compared in one task. More,
    which could fill a task, are never gathered: they are told apart before
    any shuffle, and those that agree in everything are aggregated before theirs.
    """
    who = F.xxhash64("k", "at")
    measures = {"k0": F.min("k"), "k1": F.max("k"), "least": F.min("doc_id"), "most": F.max("doc_id"), "speaker": F.min(who)}
    many = small(again.where(F.col("times") > HOT).select("first"))
    usual = suffixes.join(many, "first", "left_anti").join(again.where(F.col("times") <= HOT).select("first"), "first")
    near, group = Window.partitionBy("first", "around"), Window.partitionBy("first")
    usual = usual.withColumns({n: c.over(near) for n, c in measures.items()} | {"several": F.min("around").over(group) != F.max("around").over(group)})
    hot = suffixes.join(many, "first", "left_semi")
    classes = hot.groupBy("first", "around").agg(*(c.alias(n) for n, c in measures.items()))
    several = classes.groupBy("first").agg((F.min("around") != F.max("around")).alias("several"))
    hot = hot.join(classes.join(several, "first"), ["first", "around"])
    both = usual.withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True))).withColumn("same", F.col("k0") != F.col("k1"))
    opened = F.col("several") & (~F.col("same") | (who == F.col("speaker")))
    return both.select("doc_id", "k", "n", "at", "same", opened.alias("open"), "hot", "least", "most").where("same or open")


def _stretches(settled: DataFrame, extended: DataFrame, kind: str) -> DataFrame:
    """Overlapping passages joined up, cut off at the ends of the text, and long enough."""
    every = settled.unionByName(extended).groupBy("doc_id", "k").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("begin", "end", "least", "most"))).alias("found"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, n, found in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["found"].to_pylist()):
                at: list | None = None
                for x in [*found, None]:
                    begin, end = (max(0, x["begin"]), min(n, x["end"])) if x else (0, 0)
                    if x and end - begin < LONG:
                        continue
                    if at is not None and (x is None or begin > at[0][1]):
                        (a, b), least, most = at
                        out.append((own, a, b, b - a, least if least != own else most))
                        at = None
                    if x is None:
                        break
                    if at is None:
                        at = [(begin, end), x["least"], x["most"]]
                    else:
                        at[0] = (at[0][0], max(end, at[0][1]))
                        at[1] = min((v for v in (at[1], x["least"]) if v is not None), default=None)
                        at[2] = max((v for v in (at[2], x["most"]) if v is not None), default=None)
            if out:
                kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), batch.schema.field("doc_id").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "begin", "end", "n_words", "partner_id"])

    return every.select("doc_id", "n", "found").mapInArrow(join_up, f"doc_id {kind}, begin int, end int, n_words int, partner_id {kind}")
