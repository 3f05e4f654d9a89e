"""Dendrograms: building them, and relational queries over their merges.

A dendrogram is (merge, left, right, dist, size); leaves are ids that no row
makes. ``members`` (merge, leaf, size, dist) lists the leaves under each merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annograph.functions import numerics
from annograph.functions.columns import entropy_term

from .dynamics import cut_lineage


def build(vectors: DataFrame, method: str = "ward", group: str = "group", metric: str = "euclidean") -> DataFrame:
    """(group, merge, left, right, dist, size) per group of rows (group, id, x array).

    With ``metric`` cosine, vectors are compared by 1 - cosine.

    Leaves are the row numbers in id order. One task builds a group's tree; its
    n x n distances are in memory only for complete, single and cosine. Average
    linkage of a group of many rows deals its rounds out instead.
    """
    if method == "average" and metric == "euclidean":
        large = [r[0] for r in vectors.groupBy(group).count().where(F.col("count") > LARGE).select(group).collect()]
        if large:
            of = lambda g: F.col(group).eqNullSafe(F.lit(g))
            rest = vectors.where(~reduce(or_, map(of, large)))
            return reduce(DataFrame.unionByName, [_average_rounds(vectors.where(of(g)), g, group) for g in large], _built(rest, method, group, metric))
    return _built(vectors, method, group, metric)


#: Rows of a group from which on average linkage is dealt out.
LARGE = 6000


def _built(vectors: DataFrame, method: str, group: str, metric: str) -> DataFrame:

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf.x.tolist(), float)
        if metric == "cosine":
            unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
            z = numerics.linkage(np.clip(1 - unit @ unit.T, 0, 2), method, condensed=True)
        else:
            z = numerics.linkage(x, method)
        n = len(pdf)
        return pd.DataFrame({group: pdf[group].iloc[0], "merge": np.arange(n, 2 * n - 1), "left": z[:, 0].astype(int), "right": z[:, 1].astype(int), "dist": z[:, 2], "size": z[:, 3].astype(int)})

    kind = dict(vectors.dtypes)[group]
    return vectors.select(group, "id", "x").groupBy(group).applyInPandas(run, f"`{group}` {kind}, merge int, left int, right int, dist double, size int")


def _average_rounds(vectors: DataFrame, own, group: str, most: int = 6000, tasks: int = 12) -> DataFrame:
    """As ``build`` for the only group of ``vectors``, ``own``: each round's searches are dealt out over ``tasks``.

    The driver and each Python worker hold the vectors; clusters are sent each
    round. The matrix of the last ``most`` clusters is in one task's memory.
    """
    spark = vectors.sparkSession
    x = vectors.select("id", "x").toArrow().sort_by("id").column("x").combine_chunks()
    n = len(x)
    x = np.asarray(x.flatten(), float).reshape(n, -1)
    sent = []

    def over(held, order, points, size, look, block, run, schema: str) -> DataFrame:
        if not sent:
            sent.append(spark.sparkContext.broadcast(held))
        fixed, state = sent[0], spark.sparkContext.broadcast((order, points, size, look))
        upto = np.append(0, np.cumsum(points[look]))
        cuts = [int(v) for v in np.searchsorted(upto, np.linspace(0, upto[-1], tasks + 1))]

        def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for k in b.column("id").to_pylist():
                    order, points, size, look = state.value
                    if cuts[k] < cuts[k + 1]:
                        yield from run(k, fixed.value, order, points, size, look[cuts[k]:cuts[k + 1]], block)

        return spark.range(0, tasks, 1, tasks).mapInArrow(part, schema)

    def search(*state):
        def run(k, *state):
            near, gap = numerics._nearest(*state)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([near.tobytes()], pa.binary()), pa.array([gap.tobytes()], pa.binary())], ["k", "near", "gap"])

        found = sorted(over(*state, run, "k long, near binary, gap binary").collect())
        return tuple(np.concatenate([np.frombuffer(r[c], kind) for r in found]) for c, kind in (("near", int), ("gap", float)))

    def finish(held, order, points, size, block):
        def run(k, held, order, points, size, look, block):
            for rows, mean in numerics._mean_distances(held[0][order], held[1][order], points, size, look, block):
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([r.tobytes() for r in mean], pa.binary())], ["i", "d"])

        lines = cut_lineage(over(held, order, points, size, np.arange(len(size)), block, run, "i long, d binary"))

        def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = np.empty((len(size), len(size)))
            for b in it:
                for i, line in zip(b.column("i").to_pylist(), b.column("d"), strict=True):
                    d[i] = np.frombuffer(line.as_buffer())
            i, j, h = zip(*numerics._matrix_merges(d, size.copy(), "average"), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(i))), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(h, pa.float64())], ["k", "i", "j", "h"])

        return [(r.i, r.j, r.h) for r in sorted(lines.coalesce(1).mapInArrow(merge, "k long, i long, j long, h double").collect())] if len(size) > 1 else []

    z = numerics._dendrogram(numerics._average_merges(x, most, search=search, finish=finish), n, "average")
    kind = vectors.schema[group].dataType
    ints = [pa.array(np.arange(n, 2 * n - 1), pa.int32()), *(pa.array(z[:, c].astype(np.int32)) for c in (0, 1))]
    table = pa.table([*ints, pa.array(z[:, 2]), pa.array(z[:, 3].astype(np.int32))], ["merge", "left", "right", "dist", "size"])
    return spark.createDataFrame(table).select(F.lit(own).cast(kind).alias(group), "merge", "left", "right", "dist", "size")


def build_from_distances(pairs: DataFrame, method: str = "ward", group: str = "group") -> DataFrame:
    """As ``build``, from condensed distances (group, id_1, id_2, d) of every pair of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.id_1.to_numpy(), pdf.id_2.to_numpy()]))
        n = len(ids)
        d = np.zeros((n, n))
        i, j = np.searchsorted(ids, pdf.id_1), np.searchsorted(ids, pdf.id_2)
        d[i, j] = d[j, i] = pdf.d
        z = numerics.linkage(d, method, condensed=True)
        return pd.DataFrame({group: pdf[group].iloc[0], "merge": np.arange(n, 2 * n - 1), "left": z[:, 0].astype(int), "right": z[:, 1].astype(int), "dist": z[:, 2], "size": z[:, 3].astype(int)})

    kind = dict(pairs.dtypes)[group]
    return pairs.select(group, "id_1", "id_2", "d").groupBy(group).applyInPandas(run, f"`{group}` {kind}, merge int, left int, right int, dist double, size int")


def build_from_lines(lines: DataFrame, method: str = "ward", group: str = "group") -> DataFrame:
    """As ``build``, from lines (group, n, i, j, d) of ``statistics.distance_lines``.

    A group's lines come one after another and are gone once they are in its
    matrix, of n x n doubles in one task's memory. A pair's distance is a few
    bytes in a line and never a row. A group of one has no merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, d = None, None

        def close() -> pa.RecordBatch:
            n = len(d)
            for k in range(n):
                d[k + 1:, k] = d[k, k + 1:]
            if method == "ward":
                np.multiply(d, d, out=d)
            z = numerics._dendrogram(numerics._matrix_merges(d, np.ones(n), method), n, method)
            ints = (pa.array(np.arange(n, 2 * n - 1), pa.int32()), *(pa.array(z[:, c].astype(np.int32)) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array([own] * (n - 1), kind), *ints, pa.array(z[:, 2]), pa.array(z[:, 3].astype(np.int32))], [group, "merge", "left", "right", "dist", "size"])

        for b in batches:
            kind = b.column(group).type
            keys, n, i, j, cells = (b.column(c).to_pylist() for c in (group, "n", "i", "j", "d"))
            for key, size, row, first, line in zip(keys, n, i, j, cells, strict=True):
                if d is None or key != own:
                    if d is not None:
                        yield close()
                    own, d = key, np.empty((size, size))
                line = np.frombuffer(line)
                d[row, first:first + len(line)] = line
        if d is not None:
            yield close()

    kind = dict(lines.dtypes)[group]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select(group, "n", "i", "j", "d").repartition(tasks, group).sortWithinPartitions(group)
    return dealt.mapInArrow(run, f"`{group}` {kind}, merge int, left int, right int, dist double, size int")


def cut(vectors: DataFrame, share: float = 0.3, method: str = "ward", group: str = "group") -> DataFrame:
    """(group, id, cluster): flat clusters below ``share`` of the highest merge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        z = numerics.linkage(np.array(pdf.x.tolist(), float), method)
        flat = numerics.flat_clusters(z, share * z[-1, 2]) if len(z) else np.zeros(len(pdf), int)
        return pd.DataFrame({group: pdf[group], "id": pdf.id, "cluster": flat})

    types = dict(vectors.dtypes)
    return vectors.select(group, "id", "x").groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, id {types['id']}, cluster int")


def members(z: DataFrame) -> DataFrame:
    """(merge, leaf, size, dist): the leaves of each merge.

    Ways upwards are doubled in length by each join, so a chain of n merges
    takes log2(n) of them; every round is written and read back.
    """
    merges = cut_lineage(z.select("merge", "left", "right", "size", "dist"))
    up = merges.select(F.col("left").alias("child"), "merge").unionAll(merges.select(F.col("right").alias("child"), "merge"))
    reach, jump = cut_lineage(up.withColumn("steps", F.lit(1))), 1
    while True:  # reach has all ways of 1 to jump steps
        far = reach.where(F.col("steps") == jump).select(F.col("child").alias("_c"), F.col("merge").alias("child"))
        more = cut_lineage(far.join(reach, "child").select(F.col("_c").alias("child"), "merge", (F.col("steps") + jump).alias("steps")))
        if more.isEmpty():
            break
        reach, jump = reach.unionByName(more), 2 * jump
    leaves = reach.join(merges.select(F.col("merge").alias("child")), "child", "left_anti")
    return leaves.join(merges.select("merge", "size", "dist"), "merge").select(F.col("child").alias("leaf"), "merge", "size", "dist")


def smallest_containing(m: DataFrame, targets: DataFrame, key: str = "label") -> DataFrame:
    """(label, merge, size, dist): the smallest cluster with all leaves of each label."""
    n = targets.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = m.join(targets, "leaf").groupBy(key, "merge", "size", "dist").agg(F.count(F.lit(1)).alias("k")).join(n, key).where("k = n")
    w = Window.partitionBy(key).orderBy("size", "merge")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "merge", "size", "dist")


def ascending(m: DataFrame, targets: DataFrame, key: str = "label", most: int | None = None) -> DataFrame:
    """(label, era, merge, size): the clusters that hold all of a label, upwards."""
    n = targets.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = m.join(targets, "leaf").groupBy(key, "merge", "size").agg(F.count(F.lit(1)).alias("k")).join(n, key).where("k = n")
    e = hit.withColumn("era", F.row_number().over(Window.partitionBy(key).orderBy("size", "merge"))).select(key, "era", "merge", "size")
    return e if most is None else e.where(F.col("era") <= most)


def pure_clusters(z: DataFrame, m: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, node, size): maximal subtrees, single leaves included, of one label only."""
    count = m.join(labels, "leaf").groupBy("merge", "size", "label").agg(F.count(F.lit(1)).alias("k"))
    pure = count.where("k = size").select("label", F.col("merge").alias("node"), F.col("size"))
    pure = pure.unionAll(labels.select("label", F.col("leaf").alias("node"), F.lit(1).alias("size")))
    parent = z.select(F.col("left").alias("node"), "merge").unionAll(z.select(F.col("right").alias("node"), "merge"))
    up = pure.join(parent, "node", "left")
    inner = pure.select(F.col("label").alias("_l"), F.col("node").alias("merge"))
    return up.join(inner, (up["merge"] == inner["merge"]) & (F.col("label") == F.col("_l")), "left_anti").select("label", "node", "size")


def cluster_stats(z: DataFrame, m: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label of two leaves or more: len, lps (largest pure share), pms (its
    share of the smallest cluster that holds it), n_p and m_p (pure clusters of
    two or more, and leaves in them), s_p (single leaves).
    """
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    pure = pure_clusters(z, m, labels).groupBy("label").agg(
        F.max("size").alias("largest"), F.sum((F.col("size") > 1).cast("long")).alias("n_p"), F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).cast("long").alias("m_p"), F.sum((F.col("size") == 1).cast("long")).alias("s_p")
    )
    top = smallest_containing(m, labels).select("label", F.col("size").alias("held"))
    j = n.join(pure, "label").join(top, "label")
    return j.select("label", "len", (F.col("largest") / F.col("len")).alias("lps"), (F.col("len") / F.col("held")).alias("pms"), "n_p", "m_p", "s_p")


def tree_distances(m: DataFrame) -> DataFrame:
    """(leaf_1, leaf_2, d): edges between two leaves in the tree."""
    depth = m.groupBy("leaf").agg(F.count(F.lit(1)).alias("depth"))
    a, b = m.select(F.col("leaf").alias("leaf_1"), "merge"), m.select(F.col("leaf").alias("leaf_2"), "merge")
    shared = a.join(b, "merge").where("leaf_1 < leaf_2").groupBy("leaf_1", "leaf_2").agg(F.count(F.lit(1)).alias("k"))
    j = shared.join(depth.select(F.col("leaf").alias("leaf_1"), F.col("depth").alias("d1")), "leaf_1").join(depth.select(F.col("leaf").alias("leaf_2"), F.col("depth").alias("d2")), "leaf_2")
    return j.select("leaf_1", "leaf_2", (F.col("d1") + F.col("d2") - 2 * F.col("k") + 2).alias("d"))


def nearest_leaf(m: DataFrame, labels: DataFrame) -> DataFrame:
    """(leaf, nearest, d): for leaves without a label, the labelled leaf nearest in the tree."""
    d = tree_distances(m)
    both = d.select("leaf_1", "leaf_2", "d").unionAll(d.select(F.col("leaf_2"), F.col("leaf_1"), "d")).toDF("leaf", "nearest", "d")
    known = labels.where("label is not null").select("leaf")
    stray = both.join(known, "leaf", "left_anti").join(known.select(F.col("leaf").alias("nearest")), "nearest", "left_semi")
    return stray.withColumn("_r", F.row_number().over(Window.partitionBy("leaf").orderBy("d", "nearest"))).where("_r = 1").select("leaf", "nearest", "d")


def type_counts(m: DataFrame, labels: DataFrame) -> DataFrame:
    return m.join(labels, "leaf").groupBy("merge", "size", "label").agg(F.count(F.lit(1)).alias("c"))


def composition(m: DataFrame, labels: DataFrame) -> DataFrame:
    """(merge, size, entropy, std, spread) of the label counts of each cluster."""
    c = type_counts(m, labels).withColumn("_n", F.sum("c").over(Window.partitionBy("merge")))
    return c.groupBy("merge", "size").agg(F.sum(entropy_term(F.col("c") / F.col("_n"), 0.0)).alias("entropy"), F.stddev_pop("c").alias("std"), (F.max("c") - F.min("c")).alias("spread"))


def disjoint_cover(m: DataFrame, ranking: Column) -> DataFrame:
    """Clusters taken greedily by rank, skipping those that touch one taken before.

    Clusters are nested or apart, so a cluster is taken if and only if no
    cluster above or below it that is taken ranks before it. Rounds take all
    clusters that rank first among their relatives left.
    """
    ranked = m.groupBy("merge", "size", "dist").agg(F.count(F.lit(1)).alias("_n"))
    left = cut_lineage(ranked.withColumn("_k", F.row_number().over(Window.orderBy(ranking, "merge"))).select("merge", "_k"))
    pairs = cut_lineage(m.select("merge", "leaf").join(m.select(F.col("merge").alias("_o"), "leaf"), "leaf").where("merge <> _o").select("merge", "_o").distinct())
    taken = left.select("merge").limit(0)
    while not left.isEmpty():
        other = left.select(F.col("merge").alias("_o"), F.col("_k").alias("_ok"))
        beaten = pairs.join(left, "merge").join(other, "_o").where("_ok < _k").select("merge").distinct()
        now = cut_lineage(left.join(beaten, "merge", "left_anti").select("merge"))
        taken = taken.unionByName(now)
        gone = now.unionByName(pairs.join(now.select(F.col("merge").alias("_o")), "_o").select("merge")).distinct()
        left = cut_lineage(left.join(gone, "merge", "left_anti"))
    return taken
