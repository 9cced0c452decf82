"""Token counts of whole texts, huge ones in overlapping chunks that are spliced exactly.

A text of more than ``huge`` bytes is cut near every ``chunk`` characters. The
overlap behind each cut is searched for a proven stable boundary: a pair of
neighbouring characters that occurs inside no piece of the vocabulary. Byte-pair
merges only ever build pieces of the vocabulary, so none can cross such a pair,
and the tokens on either side don't depend on each other. The boundary is then
aligned: the overlap is encoded with offsets, and a token must begin there. If
no boundary aligns, the overlap is doubled, up to the rest of the text. Each
chunk is encoded with some context on both sides, and only the tokens between
its own boundaries count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import row_key, small_batches, whole

#: Bytes beyond which a text is cut; characters from cut to cut; characters of the first overlap.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 64


class PieceModel:
    """A sentencepiece BPE model without normalisation, with the pairs inside its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not {"ﬁ", "Å"} <= set("".join(self.model.encode("ﬁ Å", out_type=str))):
            raise ValueError("the model normalises texts; chunks would not be independent")
        self.inside = {x for i in range(self.model.vocab_size()) for x in self._pairs(self.model.id_to_piece(i))}

    @staticmethod
    def _pairs(piece: str) -> zip:
        return zip(piece, piece[1:])

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross the place before character ``at``."""
        a, b = text[at - 1], text[at]
        return ("▁" if a == " " else a, "▁" if b == " " else b) not in self.inside

    def begins(self, text: str) -> list[int]:
        """Where the tokens begin, in characters."""
        at = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        if not text.isascii():  # the library counts bytes
            at = np.searchsorted(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80), at, side="right") - 1
        return at.tolist()


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def cuts(text: str, model, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(cut, context) from the left; each cut is a place that is proven stable and aligned.

    ``context``: characters on both sides of the cut that were encoded to align it.
    """
    n, done = len(text), 0
    while n - done > chunk + overlap:
        aim, wide, found = done + chunk, overlap, None
        begin = aim
        while found is None and begin < n:
            end = min(n, aim + wide)
            starts: set[int] | None = None
            for at in range(max(begin, 1), end):
                if model.stable(text, at):
                    if starts is None:
                        low, high = max(done, aim - wide), min(n, end + wide)
                        starts = {low + x for x in model.begins(text[low:high])}
                    if at in starts:
                        found = at
                        break
            begin, wide = end, wide * 2
        if found is None:
            return
        yield found, min(wide, found - done, n - found)
        done = found


def split(text: str, model, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """(chunk with context, first and end character that count in it) of a text."""
    edges = [(0, 0), *cuts(text, model, chunk, overlap), (len(text), 0)]
    for (a, left), (b, right) in zip(edges, edges[1:]):
        yield text[a - left : b + right], left, left + b - a


def count_between(model, text: str, first: int, end: int) -> int:
    """Tokens of a chunk between its boundaries, both of which must be where a token begins."""
    if first == 0 and end == len(text):
        return model.count([text])[0]
    begins = model.begins(text)
    if (first and first not in begins) or (end < len(text) and end not in begins):
        raise RuntimeError("a proven boundary isn't where a token begins; the model isn't byte-pair encoding")
    return sum((first <= x or first == 0) and x < end for x in begins)


def count_tokens(docs: DataFrame, model_path: str, *, text: str = "text", ident: str = "doc_id", limit: int = 4096, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, load: Callable[[str], PieceModel] = _model) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each document.

    Texts of up to ``huge`` bytes are encoded where they are read. Only larger
    ones are cut; their chunks are dealt out evenly, so that one text of
    gigabytes keeps many tasks busy, and the counts are added by row.

    Null and empty texts: 0 bytes, 0 tokens. Null ``doc_id`` stays null.
    Repeated rows each give a row. Empty table: no rows. Extra columns are
    ignored. ``model_path`` must be readable at the same place on executors.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).alias("doc_id"), whole(text).alias("text"), F.octet_length(whole(text)).cast("long").alias("n_bytes"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(model.count(batch["text"].to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for i, whole_text in enumerate(batch["text"].to_pylist()):
                own = [batch[c][i].as_py() for c in ("doc_id", "n_bytes", "k1", "k2")]
                parts = list(split(whole_text, model, chunk, overlap))
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * len(some), batch.schema.field(c).type) for v, c in zip(own, ("doc_id", "n_bytes", "k1", "k2"))]
                        + [pa.array(range(k, k + len(some)), pa.int64()), pa.array([p[0] for p in some], pa.string()), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64())],
                        ["doc_id", "n_bytes", "k1", "k2", "part", "text", "first", "end"],
                    )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            counts = [count_between(model, *x) for x in zip(*(batch[c].to_pylist() for c in ("text", "first", "end")))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "n_bytes", "k1", "k2", "part")), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "k1", "k2", "part", "n"])

    kind = docs.schema[ident].dataType.simpleString()
    usual = rows.where(F.col("n_bytes") <= huge).mapInArrow(encode, f"doc_id {kind}, n_bytes long, n_tokens long")
    large = rows.where(F.col("n_bytes") > huge).select("*", *row_key(rows, "doc_id", "text"))
    parts = large.mapInArrow(cut_up, f"doc_id {kind}, n_bytes long, k1 long, k2 long, part long, text string, first long, end long")
    parts = parts.repartition(F.xxhash64("k1", "k2", "part")).mapInArrow(encode_parts, f"doc_id {kind}, n_bytes long, k1 long, k2 long, part long, n long")
    # equal rows have equal chunks: their counts meet under one key and are dealt back to each of them
    sums = parts.groupBy("doc_id", "n_bytes", "k1", "k2").agg(F.sum("n").alias("n"), F.sum((F.col("part") == 0).cast("long")).alias("times"))
    spliced = sums.select("doc_id", "n_bytes", (F.col("n") / F.col("times")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("again")).drop("again")
    return usual.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
