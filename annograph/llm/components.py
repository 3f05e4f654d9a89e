"""Connected components of an undirected graph, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


#: So many different edges at most (16 MB) are connected in one task; a round of the others costs several exchanges.
FEW_EDGES = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (a, b), and the smallest node that each of them reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[:len(a)], ends[len(a):]
    up = np.arange(len(nodes))
    while len(i):
        least = np.minimum(up[i], up[j])
        np.minimum.at(up, up[i], least)
        np.minimum.at(up, up[j], least)
        while (up != up[up]).any():
            up = up[up]
        open_ = up[i] != up[j]
        i, j = i[open_], j[open_]
    return nodes, nodes[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            node, component = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, rounds: int = 64, few: int = FEW_EDGES) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    ``edges`` has columns a and b (long). Up to ``few`` are connected in one
    task, whose memory they bound. For more, it alternates large-star and small-star
    steps until nothing moves; every step is a minimum by node and a join, is
    written to the shared folder and shrinks paths geometrically, so a few
    rounds do. Only the two sums by which standstill is seen reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # larger neighbours go to the least of a node's neighbourhood
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours and the node itself go to the least of them
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    if e.count() <= few:
        found = materialise(_in_one_task(e), "components")
        discard(e)
        return found
    seen = None
    for _ in range(rounds):
        last, e = e, materialise(star(star(e, True), False), "edges")
        discard(last)
        now = tuple(e.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
