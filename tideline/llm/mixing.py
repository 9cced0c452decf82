"""Mixing sources to target weights along a curriculum that changes with training time.

The sizes are counts of words. Water-filling gives each source a target; each
source's weight schedule is integrated in closed form, and inverting cumulative
demand gives every copy of a document its training position in [0, 1]. Built
from DataFrame operations only.

The order within a source is that of a keyed digest of ``doc_id`` and text. The
running sum over a source goes down three levels of digest buckets (256 x 256
per source), so that no task ever holds a source: a source with a third of all
rows is spread over 65,536 buckets, also where all its ids are null. Documents
without words take no part in the order and are dealt to buckets by row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.llm.text import count_words, whole
from tideline.operators.postings import small

#: Knots (time, relative weight) of the schedule of the sources that weigh 5, 2 and 1.
SCHEDULES = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)])


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(start, end, weight at start, slope, share before, share after) of each piece; shares of the integral."""
    if knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w <= 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights above 0")
    area = [(b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:])]
    total, done, out = sum(area), 0.0, []
    for ((a, v), (b, w)), x in zip(zip(knots, knots[1:]), area):
        out.append((a, b, v / total, (w - v) / (b - a) / total, done / total, (done + x) / total))
        done += x
    return out


def _time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which the schedule has asked for ``share`` of its integral."""
    out = None
    for start, _, weight, slope, before, _ in _segments(knots):
        rest = share - F.lit(before)
        at = F.lit(start) + F.lit(2.0) * rest / (F.lit(weight) + F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
        out = at if out is None else F.when(share >= F.lit(before), at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources by water-filling.

    ``sizes``: ``(source_key, source_size)``, one row per source. Sources in the
    order of their key take ``weights`` in turn and share ``share`` of all
    sizes; no target passes ``most`` times the source's size, and what is over
    goes to the others by weight. Closed form: sorted by the ratio of limit to
    weight, the level is found at the first source that stays under its limit.
    The two windows run over one row per source, never over documents.
    """
    ordered = Window.orderBy("source_key")
    table = sizes.select("source_key", "source_size", ((F.row_number().over(ordered) - 1) % len(weights)).alias("kind"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("double")
    table = table.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(most))})
    table = table.withColumn("ratio", F.col("limit") / F.col("weight"))
    up = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    table = table.withColumns({"limits": F.sum("limit").over(up) - F.col("limit"), "weights": F.sum("weight").over(every) - F.sum("weight").over(up) + F.col("weight"), "total": F.sum("source_size").over(every) * F.lit(float(share))})
    table = table.withColumn("level", (F.col("total") - F.col("limits")) / F.col("weights"))
    table = table.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    # no level: the shares pass every limit
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("limit")), F.col("limit"))
    return table.select("source_key", "source_size", "kind", target.alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", ident: str = "doc_id", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: int = 1, whole_rows: bool = False, carry: bool = False) -> DataFrame:
    """Place documents on the training axis.

    Returns a row per document: ``doc_id, size, source_size, target, taken,
    placements``, and with ``carry`` the input row as ``row``. ``placements``
    has a struct (copy, words, position) for each time that the mix uses the
    document. A source's documents are laid end to end in digest order, again
    and again, and cut off at the target, so that the words taken are the
    target rounded to a word; the last document is used in part. With
    ``whole_rows`` the last document is used if at least half of it would be.

    Null text: size 0. Null source: a source of its own, after all others. A
    null ``doc_id`` has a digest like any other. Repeated rows each take their
    own stretch. A document without words takes nothing, and a source without
    words has target 0. Empty table: no rows.
    Extra columns are ignored or, with ``carry``, kept inside ``row``.
    """
    rounds = int(-(-most // 1))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(ident).cast("string"), F.lit("")), F.lit(str(seed)), F.md5(whole(text))))
    base = docs.select(
        *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if carry else []),
        F.col(ident).alias("doc_id"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("source_key"),
        count_words(whole(text)).alias("size"), digest.alias("digest"), F.xxhash64(text).alias("tie"),
    )
    row = F.monotonically_increasing_id()
    dealt = lambda at, shift: F.when(F.col("size") > 0, F.substring("digest", at, 2)).otherwise(F.lpad(F.hex(F.pmod(F.shiftright(row, shift), F.lit(256))), 2, "0"))
    base = base.withColumns({"b1": dealt(1, 0), "b2": dealt(3, 8)})
    if not carry:
        base = cut(base)
    fine = cut(base.groupBy("source_key", "b1", "b2").agg(F.sum("size").alias("n")))
    coarse = fine.groupBy("source_key", "b1").agg(F.sum("n").alias("n"))
    sources = cut(source_targets(coarse.groupBy("source_key").agg(F.sum("n").alias("source_size")), weights, share, most))
    before = lambda keys, by: F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    coarse = coarse.withColumn("c", before(["source_key"], "b1")).drop("n")
    fine = fine.withColumn("f", before(["source_key", "b1"], "b2")).join(coarse, ["source_key", "b1"]).withColumn("ahead", F.col("c") + F.col("f")).drop("n", "c", "f")
    order = Window.partitionBy("source_key", "b1", "b2").orderBy("digest", "tie", "size")
    placed = base.withColumn("begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    # rows without words may lie in another bucket when they are read again, and need no place
    placed = placed.join(fine, ["source_key", "b1", "b2"], "left").join(small(sources), "source_key").withColumn("begin", F.col("begin") + F.coalesce("ahead", F.lit(0)))
    copies = []
    for k in range(rounds):
        start = F.col("begin") + F.lit(k) * F.col("source_size")
        words = F.least(F.greatest(F.round("target").cast("long") - start, F.lit(0)), F.col("size"))
        if whole_rows:
            words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        part = F.try_divide(start, F.col("target"))
        at = None
        for kind, knots in enumerate(schedules):
            at = _time(part, knots) if at is None else F.when(F.col("kind") % len(schedules) == kind, _time(part, knots)).otherwise(at)
        copies.append(F.struct(F.lit(k).alias("copy"), words.cast("long").alias("words"), at.alias("position")))
    placed = placed.withColumn("placements", F.filter(F.array(*copies), lambda x: x["words"] > 0))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select(*(["row"] if carry else []), "doc_id", "size", "source_size", "target", taken.alias("taken"), "placements")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix in training order, each as often as it is used, with the columns of ``docs``.

    Ordered by position with a range partitioning; ties go by ``doc_id`` and copy.
    """
    placed = mix(docs, carry=True, whole_rows=True, **options)
    rows = placed.select("row", "doc_id", F.explode("placements").alias("p")).orderBy(F.col("p.position"), F.col("doc_id"), F.col("p.copy"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
