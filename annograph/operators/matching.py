"""Pairwise graph matching, and distances of graphs under a matching.

Graphs are long: cells (graph, i, j, v) with node numbers from 0, and sizes
(graph, n). A matching is (id_1, id_2, i, j): node i of id_1 goes with j of id_2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annograph.functions import numerics


def pairs(ids: DataFrame) -> DataFrame:
    """All unordered pairs id_1 < id_2 of a column ``id``."""
    return ids.select(F.col("id").alias("id_1")).join(ids.select(F.col("id").alias("id_2")), F.col("id_1") < F.col("id_2"))


def condensed(df: DataFrame, n: int, k: str = "k") -> DataFrame:
    """Adds i and j, the pair at place k of the condensed order of n items."""
    b = F.lit(2.0 * n - 1)
    i = F.floor((b - F.sqrt(b * b - 8.0 * F.col(k))) / 2).cast("long")
    return df.withColumn("i", i).withColumn("j", (F.col(k) - F.col("i") * (2 * n - F.col("i") - 1) / 2 + F.col("i") + 1).cast("long"))


def numbered(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, cells, sizes) of (ego, id) groups and their (ego, pre, post, weight) edges; nodes by id."""
    nodes = members.select(F.col("ego").alias("graph"), "id").withColumn("i", F.row_number().over(Window.partitionBy("graph").orderBy("id")) - 1)
    a = nodes.select("graph", F.col("id").alias("pre"), "i")
    b = nodes.select(F.col("graph").alias("_g"), F.col("id").alias("post"), F.col("i").alias("j"))
    e = edges.select(F.col("ego").alias("graph"), "pre", "post", F.col("weight").alias("v"))
    cells = e.join(a, ["graph", "pre"]).join(b, (F.col("graph") == F.col("_g")) & (e["post"] == b["post"])).select("graph", "i", "j", "v")
    return nodes, cells, nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


def ordered_pairs(sizes: DataFrame) -> DataFrame:
    """(id_1, id_2, n_1, n_2): every pair, the smaller graph first, ties by id."""
    a, b = sizes.select(F.col("graph").alias("a"), F.col("n").alias("na")), sizes.select(F.col("graph").alias("b"), F.col("n").alias("nb"))
    p = a.join(b, F.col("a") < F.col("b"))
    swap = F.col("nb") < F.col("na")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return p.select(pick("a", "b").alias("id_1"), pick("b", "a").alias("id_2"), pick("na", "nb").alias("n_1"), pick("nb", "na").alias("n_2"))


def identity_matching(p: DataFrame) -> DataFrame:
    """Node i with node i: what a failed match falls back to."""
    return p.select("id_1", "id_2", F.explode(F.sequence(F.lit(0), F.col("n_1") - 1)).alias("i")).withColumn("j", F.col("i"))


def completed(matching: DataFrame, p: DataFrame) -> DataFrame:
    """The matching with the larger graph's unmatched nodes after it, in their order."""
    every = p.select("id_1", "id_2", "n_1", F.explode(F.sequence(F.lit(0), F.col("n_2") - 1)).alias("j"))
    rest = every.join(matching, ["id_1", "id_2", "j"], "left_anti")
    w = Window.partitionBy("id_1", "id_2").orderBy("j")
    return matching.select("id_1", "id_2", "i", "j").unionByName(rest.withColumn("i", F.col("n_1") + F.row_number().over(w) - 1).select("id_1", "id_2", "i", "j"))


def aligned_cells(cells: DataFrame, full: DataFrame, p: DataFrame) -> DataFrame:
    """(id_1, id_2, i, j, a, b): cells of both graphs in the first one's numbering.

    Only cells that either graph has; a missing one is 0.
    """
    a = p.select("id_1", "id_2").join(cells.withColumnRenamed("graph", "id_1"), "id_1").select("id_1", "id_2", "i", "j", F.col("v").alias("a"))
    to = lambda name, of: full.select("id_1", "id_2", F.col("i").alias(name), F.col("j").alias(of))
    raw = cells.select(F.col("graph").alias("id_2"), F.col("i").alias("_x"), F.col("j").alias("_y"), F.col("v").alias("b"))
    b = p.select("id_1", "id_2").join(raw, "id_2").join(to("i", "_x"), ["id_1", "id_2", "_x"]).join(to("j", "_y"), ["id_1", "id_2", "_y"]).select("id_1", "id_2", "i", "j", "b")
    return a.join(b, ["id_1", "id_2", "i", "j"], "full").select("id_1", "id_2", "i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def distance_stats(cells: DataFrame, matching: DataFrame, p: DataFrame, directed: bool = True) -> DataFrame:
    """fnorm, graph_edit_distance, euclidean_distance, a_in_b and b_in_a of each pair.

    a_in_b: no matched cell of the larger graph is below the smaller's; b_in_a
    the other way round.
    """
    c = aligned_cells(cells, completed(matching, p), p).join(p, ["id_1", "id_2"], "right")
    inner = (F.col("i") < F.col("n_1")) & (F.col("j") < F.col("n_1"))
    d = F.coalesce(F.col("a") - F.col("b"), F.lit(0.0))
    on = lambda x: F.coalesce(F.sum(F.when(inner, x)), F.lit(0.0))
    scale = 1.0 if directed else 2.0
    edit = (on(F.abs(d)) + F.abs(F.coalesce(F.sum("b"), F.lit(0.0)) - on(F.col("b")))) / scale + F.abs(F.col("n_2") - F.col("n_1"))
    return c.groupBy("id_1", "id_2", "n_1", "n_2").agg(
        F.sqrt(on(d * d)).alias("fnorm"), edit.cast("long").alias("graph_edit_distance"), F.sqrt(F.sum(d * d)).alias("euclidean_distance"),
        (on((F.col("b") < F.col("a")).cast("double")) == 0).alias("a_in_b"), (on((F.col("a") < F.col("b")).cast("double")) == 0).alias("b_in_a"),
    ).drop("n_1", "n_2")


def overlap_cells(aligned: DataFrame) -> DataFrame:
    """(id_1, id_2, i, j, kind): edges of both graphs or of one alone."""
    kind = F.when(F.col("a") - F.col("b") > 0.5, "unique_1").when(F.col("b") - F.col("a") > 0.5, "unique_2").when(F.col("a") * F.col("b") != 0, "common")
    return aligned.withColumn("kind", kind).where("kind is not null").select("id_1", "id_2", "i", "j", "kind")


def node_mapping(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id_1, id_2, place, node_1, node_2): names side by side, null where unmatched."""
    a = nodes.select(F.col("graph").alias("id_1"), "i", F.col("id").alias("node_1"))
    b = nodes.select(F.col("graph").alias("id_2"), F.col("i").alias("j"), F.col("id").alias("node_2"))
    return full.join(a, ["id_1", "i"], "left").join(b, ["id_2", "j"], "left").select("id_1", "id_2", F.col("i").alias("place"), "node_1", "node_2")


def type_match(mapping: DataFrame, meta: DataFrame) -> DataFrame:
    """(id_1, id_2, matches, possible, score): matched nodes of equal type over the most there could be."""
    t = meta.select("id", "type")
    m = mapping.join(t.toDF("node_1", "t1"), "node_1", "left").join(t.toDF("node_2", "t2"), "node_2", "left")
    count = lambda c: m.where(f"{c} is not null").groupBy("id_1", "id_2", F.col(c).alias("t")).agg(F.count(F.lit(1)).alias(c))
    best = count("t1").join(count("t2"), ["id_1", "id_2", "t"]).groupBy("id_1", "id_2").agg(F.sum(F.least("t1", "t2")).alias("possible"))
    hit = m.groupBy("id_1", "id_2").agg(F.sum(F.coalesce((F.col("t1") == F.col("t2")).cast("long"), F.lit(0))).alias("matches"))
    return hit.join(best, ["id_1", "id_2"]).select("id_1", "id_2", "matches", "possible", (F.col("matches") / F.col("possible")).alias("score"))


def dense_graphs(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(graph, ids, adj): each graph's node names and flattened adjacency, nodes by number."""
    names = nodes.groupBy("graph").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ids"))
    entries = cells.groupBy("graph").agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
    flat = F.map_from_entries(F.transform("e", lambda x: F.struct((x["i"] * F.size("ids") + x["j"]).cast("int"), x["v"])))
    j = names.join(entries, "graph", "left")
    grid = F.sequence(F.lit(0), F.size("ids") * F.size("ids") - 1)
    return j.withColumn("m", F.coalesce(flat, F.create_map().cast("map<int,double>"))).select("graph", "ids", F.transform(grid, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("adj"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Small rows of long work: a stated partition count, which adaptive execution doesn't merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def match(graphs: DataFrame, p: DataFrame, ego: bool = False, transport: bool = True) -> DataFrame:
    """(id_1, id_2, perm, fnorm, graph_edit_distance, euclidean_distance, isexact) by graph matching.

    With ``ego`` the graphs' own nodes (named as the graph) are matched to each
    other. Where matching fails the identity is used. Pairs go out in small
    Arrow batches, each with its two graphs.
    """
    g = graphs.select("graph", F.size("ids").alias("n"), "adj", F.array_position("ids", F.col("graph").cast("string")).alias("at"))
    j = p.join(g.select(F.col("graph").alias("id_1"), F.col("adj").alias("a"), F.col("at").alias("s1")), "id_1").join(g.select(F.col("graph").alias("id_2"), F.col("adj").alias("b"), F.col("at").alias("s2")), "id_2")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                a = np.array(r.a, float).reshape(int(r.n_1), -1)
                b = np.array(r.b, float).reshape(int(r.n_2), -1)
                seeds = ((int(r.s1) - 1, int(r.s2) - 1),) if ego and r.s1 > 0 and r.s2 > 0 else ()
                try:
                    perm = numerics.match_graphs(a, b, seeds=seeds, transport=transport)
                except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                    perm = np.arange(len(a))
                rows.append((r.id_1, r.id_2, perm.tolist(), *numerics.graph_distance(a, b, perm).values()))
            yield pd.DataFrame(rows, columns=["id_1", "id_2", "perm", "fnorm", "graph_edit_distance", "euclidean_distance", "isexact"])

    kind = dict(p.dtypes)["id_1"]
    schema = f"id_1 {kind}, id_2 {kind}, perm array<int>, fnorm double, graph_edit_distance long, euclidean_distance double, isexact boolean"
    return _spread(j.select("id_1", "id_2", "n_1", "n_2", "a", "b", "s1", "s2"), "id_1", "id_2").mapInPandas(run, schema)


def shuffled_score(mapping: DataFrame, meta: DataFrame, draws: int = 100_000, cells: int = 1 << 20) -> DataFrame:
    """(id_1, id_2, obs, p, mean, std): how often shuffled labels match better than the true ones, 1 / draws at least.

    A pair's draws are decided by its two ids and made ``cells`` labels at a time.
    """
    t = meta.select("id", "type")
    m = mapping.join(t.toDF("node_1", "t1"), "node_1").join(t.toDF("node_2", "t2"), "node_2").select("id_1", "id_2", "place", "t1", "t2")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        names = {v: k for k, v in enumerate(sorted(set(pdf.t1) | set(pdf.t2)))}
        one, two = pdf.t1.map(names).to_numpy(), pdf.t2.map(names).to_numpy()
        rng, obs, better, total, squares = np.random.default_rng(zlib.crc32(f"{key[0]}|{key[1]}".encode())), int((one == two).sum()), 0, 0, 0
        size = max(1, cells // len(one))
        for low in range(0, draws, size):
            x = (rng.permuted(np.tile(two, (min(size, draws - low), 1)), axis=1) == one).sum(1)
            better, total, squares = better + int((x > obs).sum()), total + int(x.sum()), squares + int((x * x).sum())
        mean = total / draws
        return pd.DataFrame([(*key, obs, max(better, 1) / draws, mean, max(squares / draws - mean * mean, 0) ** 0.5)], columns=["id_1", "id_2", "obs", "p", "mean", "std"])

    kind = dict(mapping.dtypes)["id_1"]
    return _spread(m, "id_1", "id_2").groupBy("id_1", "id_2").applyInPandas(run, f"id_1 {kind}, id_2 {kind}, obs long, p double, mean double, std double")


def stability(graphs: DataFrame, meta: DataFrame, p: DataFrame, deltas: DataFrame) -> DataFrame:
    """(id_1, id_2, delta, perm, matches, euclidean_distance): matchings under growing weight against the identity.

    Nodes that keep their number cost delta, the graphs' own nodes excepted,
    which are matched to each other; ``matches`` counts the other matched
    nodes of equal type. ``meta`` has one type an id; nodes without any match none.
    """
    t = meta.select(F.col("id").cast("string").alias("_n"), "type")
    at = graphs.select("graph", F.posexplode("ids").alias("_k", "_n")).join(t, "_n", "left").groupBy("graph").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "type"))), lambda x: x["type"]).alias("t"))
    g = graphs.join(at, "graph").select("graph", "adj", "t", F.array_position("ids", F.col("graph").cast("string")).alias("s"))
    j = p.join(g.toDF("id_1", "a", "t1", "s1"), "id_1").join(g.toDF("id_2", "b", "t2", "s2"), "id_2").crossJoin(deltas.select(F.col("delta").cast("double")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                a, b = np.array(r.a, float).reshape(int(r.n_1), -1), np.array(r.b, float).reshape(int(r.n_2), -1)
                own, cost = (int(r.s1) - 1, int(r.s2) - 1), -r.delta * np.eye(int(r.n_1), int(r.n_2))
                if min(own) >= 0:
                    cost[own] = 0
                perm = numerics.match_graphs(a, b, similarity=cost, seeds=(own,) if min(own) >= 0 else ())
                hits = sum(i != own[0] and r.t1[i] is not None and r.t1[i] == r.t2[k] for i, k in enumerate(perm))
                rows.append((r.id_1, r.id_2, r.delta, perm.tolist(), int(hits), numerics.graph_distance(a, b, perm)["euclidean_distance"]))
            yield pd.DataFrame(rows, columns=["id_1", "id_2", "delta", "perm", "matches", "euclidean_distance"])

    kind = dict(p.dtypes)["id_1"]
    return _spread(j, "id_1", "id_2", "delta").mapInPandas(run, f"id_1 {kind}, id_2 {kind}, delta double, perm array<int>, matches long, euclidean_distance double")
