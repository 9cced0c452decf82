"""Connected components by alternating neighbour minima and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, ship


#: Edges up to which one task works alone, after they are counted (16 MB of numbers).
LOCAL = 200_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", local: int = LOCAL) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; component is the smallest node.

    Up to ``local`` edges are joined up by one task. More are by star
    contraction. In each round, every node hands all its larger
    neighbours to its smallest neighbour (large star), then hands its smaller
    neighbours to the smallest of them (small star). The edge list never grows
    beyond its first size, so a hub costs rows in proportion to its degree. The
    loop ends when a round leaves the list of edges unchanged; every round is
    checkpointed. Only two numbers per round reach the driver. Self-loops are
    allowed; nodes may be of any orderable type, but not null.
    """
    def tidy(frame: DataFrame) -> DataFrame:
        return frame.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    given = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")))
    if given.limit(local + 1).count() <= local:
        return _by_one_task(given)
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = cut(tidy(given))
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = cut(tidy(small))
        now = links.agg(F.count("*"), F.bit_xor(F.hash("u", "v")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark is not None and tuple(now) == mark:
            break
        mark = tuple(now)
    # Every larger node now points straight at the root of its component.
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _by_one_task(edges: DataFrame) -> DataFrame:
    """The components of few edges ``(u, v)``, by a forest of the smallest nodes."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        like = None
        for batch in batches:
            like = batch.schema.field("u").type
            for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                a, b = top(above.setdefault(a, a)), top(above.setdefault(b, b))
                if a != b:
                    above[max(a, b)] = min(a, b)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), like), pa.array([top(x) for x in above], like)], ["node", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return cut(edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))
