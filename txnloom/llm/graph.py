"""Connected components of large edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnloom.llm.shared import written

ROUNDS = 60
# Edges of a task that are joined in memory at once.
EDGES_AT_ONCE = 1 << 16


def _stars(batches: Iterator[pa.RecordBatch], tops: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges that join the same nodes as those of each part: from a node to the smallest one it is joined with there.

    With ``tops`` the smallest nodes are there too, joined with themselves.
    """
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def found() -> pa.RecordBatch:
        ends = [(x, root(x)) for x in list(parent)]
        ends = [(x, low) for x, low in ends if tops or x != low]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], types[k]) for k in (0, 1)], names=["a", "b"])

    types, count = None, 0
    for batch in batches:
        types = [batch.column(k).type for k in (0, 1)]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        count += batch.num_rows
        if count >= EDGES_AT_ONCE:
            yield found()
            count = 0
    if count:
        yield found()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b).

    ``component`` is the smallest node of the connected component.  Edges may
    repeat, run both ways or be loops; those with a null end do not count.  First
    each task joins the edges it holds.  If no more than EDGES_AT_ONCE are left,
    one task joins these; else rounds follow.  Each
    round links every node's larger neighbours to its smallest one, then every
    node to the smallest of its smaller neighbours, until only stars around the
    smallest nodes are left; the number of rounds grows with the logarithm of
    the longest path.  Every round is a written table, and minima are taken
    before rows are exchanged, so that hubs cost no single task.
    """
    pairs = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    joined = written(pairs.mapInArrow(lambda batches: _stars(batches, tops=True), pairs.schema), purpose)
    if joined.count() <= EDGES_AT_ONCE:
        stars = joined.coalesce(1).mapInArrow(lambda batches: _stars(batches, tops=True), pairs.schema)
        return written(stars, purpose).toDF("node", "component")
    nodes = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = joined.filter("a <> b")
    before = _state(links)
    for _ in range(ROUNDS):
        both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(
            links.select(F.col("b").alias("n"), F.col("a").alias("m"))
        )
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = (
            both.filter("m > n").join(least, "n").filter("m <> low").select(F.col("m").alias("a"), F.col("low").alias("b")).distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(
            F.explode(
                F.when(F.col("b") == F.col("low"), F.array(F.struct("a", F.col("low").alias("b")))).otherwise(
                    F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
                )
            ).alias("e")
        )
        links = written(small.select("e.*").distinct(), purpose)
        state = _state(links)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
