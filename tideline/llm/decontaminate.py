"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

A benchmark item leaks into a document in either of two ways:

* span: at least ``needed(span)`` words of it stand in the document in their
  order, with at most ``span - needed(span)`` edits (a word changed, put in or
  left out) among them: eleven equal words with two edits at most, for spans of
  13 words. Items of fewer words than a span have no spans;
* whole: the whole item is an edit distance of a fifth of its words or less away
  from some stretch of the document. Items of up to five words must stand there
  as they are. Items of more than 256 words are cut into overlapping passages, and
  leak if one passage does.

Neither depends on which alignment scores best. By counting, an item's part with
so few edits keeps a number of its word trigrams intact, so among any set that
leaves out fewer than that, one survives: of each window of a span, and of each
whole item, only the rarest trigrams are seeds, rarity being counted over all
documents. Seeds join documents to items. Around each seed that a document holds,
both tests are made; what passes is aligned for its score and its places.

The benchmark goes to the executors in blocks of a fixed number of words, and
all documents are read against each block, so any benchmark size is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import small_batches, whole

GRAM = 3
#: Words of a block of the benchmark (about 100 bytes each); of a passage; of a span; the share of equal words; words of the longest items that must be exact.
BLOCK, PASSAGE, SPAN, SIMILAR, EXACT = 500_000, 256, 13, 0.8, 5
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def passages(words: list[str], size: int = PASSAGE, overlap: int = 2 * SPAN) -> list[tuple[int, list[str]]]:
    """(first word, words) of overlapping passages that hold every span between them."""
    if len(words) <= size:
        return [(0, words)]
    starts = range(0, len(words) - overlap, size - overlap)
    return [(k, words[k : k + size]) for k in starts]


def allowed(n: int, similar: float = SIMILAR) -> int:
    """Edits that ``n`` words may have."""
    return int(n * (1 - similar) + 1e-9) if n > EXACT else 0


def intact(equal: int, edits: int) -> int:
    """Trigrams that survive at least: ``equal`` words in at most ``edits`` + 1 runs."""
    return equal - 2 * (edits + 1)


class Index:
    """The passages of a block, their trigrams as numbers, and which of them are seeds."""

    def __init__(self, items: list[tuple[int, str]], span: int, similar: float):
        self.span, self.similar = span, similar
        groups: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            for first, own in passages(words_of(text)):
                if own:
                    groups.setdefault(tuple(own), []).append((item, first))
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for g in groups for w in g), start=1)}
        self.base = len(self.vocabulary) + 1
        if self.base >= 1 << 21:
            raise ValueError("a block has too many different words")
        self.passages = [(np.array([self.vocabulary[w] for w in g], np.int64), owners) for g, owners in groups.items()]
        self.grams = [self.keys(p) for p, _ in self.passages]
        self.all = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, np.int64)
        self.short = any(len(p) < GRAM for p, _ in self.passages)
        self.seeds: dict[int, list[tuple[int, int]]] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def keys(self, v: np.ndarray) -> np.ndarray:
        """The trigram at each place, negative if it has a word that the block doesn't have; of fewer words, one key for all of them."""
        if 0 < len(v) < GRAM:
            return self.short_keys(v, len(v))
        a, b, c = v[:-2], v[1:-1], v[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, -1)

    def short_keys(self, v: np.ndarray, n: int) -> np.ndarray:
        """The key of the one or two words at each place: numbers below those of trigrams."""
        if n == 1:
            return np.where(v > 0, v, -1)
        a, b = v[:-1], v[1:]
        return np.where((a > 0) & (b > 0), a * self.base + b, -1)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """The places whose trigram some passage has."""
        if not len(self.all) or not len(keys):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.all, keys), len(self.all) - 1)
        return np.flatnonzero(self.all[at] == keys)

    def needed(self, n: int) -> int:
        """Equal words in a span of ``n``."""
        return int(np.ceil(n * self.similar - 1e-9))

    def trigrams(self, n: int) -> tuple[int, int]:
        """(trigrams that a span keeps, trigrams that the whole passage of ``n`` words keeps): lower bounds, 1 where counting promises none, for a passage without spans the same twice."""
        equal = n - allowed(n, self.similar)
        every = max(1, intact(equal, allowed(n, self.similar)))
        if n < self.span:
            return every, every
        return max(1, intact(self.needed(self.span), self.span - self.needed(self.span))), every

    def choose(self, frequency: dict[int, int]) -> None:
        """Of each window of a span, and of the whole, the rarest trigrams become seeds, as many as make sure that one is kept."""
        for number, keys in enumerate(self.grams):
            n = len(self.passages[number][0])
            order = np.array([frequency.get(int(k), 0) for k in keys])
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((np.arange(len(keys)), order))] = np.arange(len(keys))
            part, every = self.trigrams(n)
            chosen = set(np.flatnonzero(rank <= len(keys) - every).tolist())
            wide = self.span - GRAM + 1
            if n >= self.span:
                windows = np.lib.stride_tricks.sliding_window_view(rank, wide)
                least = np.argpartition(windows, wide - part, axis=1)[:, : wide - part + 1] + np.arange(len(windows))[:, None]
                chosen.update(np.unique(least).tolist())
            for place in sorted(chosen):
                self.seeds.setdefault(int(keys[place]), []).append((number, place))


def spans(item: list[int], text: list[int], i: int, j: int, edits: int, step: int) -> list[int]:
    """The most equal words that follow places ``i`` and ``j`` (before them, with ``step`` -1) with at most 0, 1, ... ``edits`` edits."""
    n, m = len(item), len(text)
    best = [0] * (edits + 1)
    # farthest first places of the item on each diagonal: (item place, text place) to equal words
    now = {(i, j): 0}
    for e in range(edits + 1):
        best[e] = best[max(e - 1, 0)]
        reached: dict[tuple[int, int], int] = {}
        for (a, b), equal in now.items():
            while 0 <= a < n and 0 <= b < m and item[a] == text[b] and item[a]:
                a, b, equal = a + step, b + step, equal + 1
            if equal > reached.get((a, b), -1):
                reached[a, b] = equal
            best[e] = max(best[e], equal)
        now = {}
        for (a, b), equal in reached.items():
            for c, d in ((a + step, b + step), (a + step, b), (a, b + step)):
                if -1 <= c <= n and -1 <= d <= m and equal > now.get((c, d), -1):
                    now[c, d] = equal
    return best


def has_span(item: list[int], text: list[int], i: int, j: int, equal: int, edits: int) -> bool:
    """Whether ``equal`` words around the equal trigram at ``i`` and ``j`` stand in order with at most ``edits`` edits."""
    ahead = spans(item, text, i + GRAM, j + GRAM, edits, 1)
    if ahead[edits] + GRAM + i < equal:
        return False
    behind = spans(item, text, i - 1, j - 1, edits, -1)
    return any(ahead[e] + behind[edits - e] + GRAM >= equal for e in range(edits + 1))


def _table(item: np.ndarray, text: np.ndarray, local: bool) -> np.ndarray:
    """Rows of the alignment of all of ``item`` (or, ``local``, of any part) with any stretch of ``text``: 1 for equal words, -1 for an edit; without ``local``, minus the edits."""
    n, m = len(item), len(text)
    h = np.zeros((n + 1, m + 1), np.int32)
    places = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[0] = 0 if local else -i
        row[1:] = np.maximum(np.where(text == item[i - 1], 1 if local else 0, -1) + h[i - 1, :-1], h[i - 1, 1:] - 1)
        if local:
            np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + places) - places  # gaps in the item: one less for each step to the right
    return h


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least number of edits between ``item`` and a stretch of ``text``. Word 0 equals nothing."""
    return -int(_table(item, text, False)[-1].max())


@lru_cache(maxsize=4096)
def _judge(item: bytes, text: bytes, places: tuple[tuple[int, int], ...], span: int, equal: int, edits: int) -> tuple[int, ...] | None:
    """The alignment if the item leaks into the text (numbers of words as bytes); ``places``: where seeds are in both."""
    a, b = np.frombuffer(item, np.int64), np.frombuffer(text, np.int64)
    x, y = a.tolist(), b.tolist()
    found = len(x) >= span and any(has_span(x, y, i, j, equal, span - equal) for i, j in places)
    if not found and edit_distance(a, b) > edits:
        return None
    return align(a, b)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int, int, int]:
    """Smith-Waterman with 1 for equal words and -1 for a change or gap.

    Returns score, equal columns, all columns, and the aligned ranges (begin, end) of the item and of the text. Word 0 equals nothing.
    """
    h = _table(item, text, True)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end_i, end_j = int(h[i, j]), int(i), int(j)
    equal = columns = 0
    while h[i, j] > 0:
        columns += 1
        same = item[i - 1] == text[j - 1] and item[i - 1] > 0
        if h[i, j] == h[i - 1, j - 1] + (1 if same else -1):
            equal += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, equal, columns, int(i), end_i, int(j), end_j


def found_in(index: Index, words: list[str]) -> list[tuple[int, int, int, int, int, int, float]]:
    """(item, score, item's begin and end, document's begin and end, share) of the best leak of each item, in words."""
    v = index.numbers(words)
    keys = index.keys(v) if len(v) >= GRAM else np.empty(0, np.int64)
    windows: dict[int, list[tuple[int, int]]] = {}
    rows = [(int(keys[at]), at) for at in index.known(keys).tolist()]
    if index.short and len(v):
        for n in range(1, min(GRAM, len(v) + 1)):
            own = index.short_keys(v, n)
            # a key of one or two words may look like no trigram's: those start with a word's number times the square of the base
            rows += [(int(own[at]), at) for at in index.known(own).tolist()]
    for key, at in rows:
        for number, place in index.seeds.get(key, ()):
            windows.setdefault(number, []).append((at, place))
    best: dict[int, tuple] = {}
    for number, seeds in windows.items():
        passage, owners = index.passages[number]
        n = len(passage)
        edits = allowed(n, index.similar)
        own, need = np.unique(index.grams[number]), min(index.trigrams(n))
        slack = edits + 2
        # the whole passage around each seed, with room for gaps
        merged: list[list] = []
        for at, place in sorted(set(seeds), key=lambda x: (x[0] - x[1], x)):
            begin, end = max(0, at - place - slack), min(len(v), at - place + n + slack)
            if merged and begin <= merged[-1][1] and end - merged[-1][0] <= 2 * n + 2 * slack:
                merged[-1][1] = max(end, merged[-1][1])
                merged[-1][2].append((place, at))
            else:
                merged.append([begin, end, [(place, at)]])
        for begin, end, places in merged:
            if n >= GRAM and np.isin(keys[begin : max(begin, end - GRAM + 1)], own).sum() < need:
                continue
            inside = tuple(sorted((p, at - begin) for p, at in places))
            judged = _judge(passage.tobytes(), v[begin:end].tobytes(), inside, index.span, index.needed(index.span), edits)
            if judged:
                score, equal, columns, a, b, x, y = judged
                for item, first in owners:
                    row = (item, score, first + a, first + b, begin + x, begin + y, round(equal / columns, 6))
                    if item not in best or (-row[1], row[4]) < (-best[item][1], best[item][4]):
                        best[item] = row
    return [best[k] for k in sorted(best)]


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``most`` words, fetched one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t.split()) + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _indices(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, span: int, similar: float, block: int) -> Iterator:
    """The index of each block, with seeds chosen by how many documents have each trigram, as a broadcast."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark, item, item_text, block):
        index = Index(items, span, similar)
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            total: dict[int, int] = {}
            for batch in batches:
                for value in batch["text"].to_pylist():
                    keys = index.keys(index.numbers(words_of(value)))
                    for k in set(keys[index.known(keys)].tolist()):
                        total[k] = total.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

        # at most one row per trigram of the block
        counts = docs.select(whole(text).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        index.choose({r.gram: r.n for r in counts.toLocalIterator()})
        yield docs.sparkSession.sparkContext.broadcast(index)


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text", span: int = SPAN, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, score, item_begin, item_end, doc_begin, doc_end, similarity``: the best alignment of each leaked item in each document.

    Places are in words, ends exclusive. Items with the same text are all
    named. Items of up to five words, one word included, are found as they
    stand; items of six words need three in a row intact. Null texts, items
    without an id or a word, and empty tables give no rows; a null ``doc_id``
    stays null; repeated rows each give their rows. Extra columns are ignored.
    """
    kind, number = docs.schema[ident].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    shape = f"doc_id {kind}, item_id {number}, score int, item_begin int, item_end int, doc_begin int, doc_end int, similarity double"
    rows = docs.select(F.col(ident).alias("doc_id"), whole(text).alias("text"))
    out = None
    for sent in _indices(docs, benchmark, text, item, item_text, span, similar, block):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(own, *x) for own, value in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for x in found_in(sent.value, words_of(value))]
                columns = list(zip(*made)) if made else [[]] * 8
                kinds = [batch.schema.field("doc_id").type, None, *[pa.int32()] * 5, pa.float64()]
                names = ["doc_id", "item_id", "score", "item_begin", "item_end", "doc_begin", "doc_end", "similarity"]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        made = rows.mapInArrow(search, shape)
        out = made if out is None else out.unionByName(made)
    return docs.sparkSession.createDataFrame([], shape) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """The documents without any leak, with their columns; filtered where they are read, without a shuffle."""
    for sent in _indices(docs, benchmark, text, item, item_text, span, similar, block):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found_in(sent.value, words_of(x)) for x in batch[text].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
