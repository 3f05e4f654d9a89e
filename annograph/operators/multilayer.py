"""Layered adjacency of typed graphs and of contact maps, in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annograph.functions import numerics
from annograph.functions.columns import edge_type, inverse_similarity, length_similarity


def typed_layers(edges: DataFrame, meta: DataFrame, directed: bool = True, least: float = 0.5) -> DataFrame:
    """(pre, post, layer, weight): edges above ``least`` with the types of their ends as layer."""
    t = meta.select("id", "type")
    j = edges.where(F.col("weight") > least).join(t.toDF("pre", "_a"), "pre").join(t.toDF("post", "_b"), "post")
    return j.select("pre", "post", edge_type(F.col("_a"), F.col("_b"), directed).alias("layer"), "weight")


def layer_universe(meta: DataFrame) -> DataFrame:
    t = meta.select("type").distinct()
    return t.join(t.select(F.col("type").alias("_u"))).select(F.concat_ws("_", "type", "_u").alias("layer"))


def role_layers(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(ego, pre, post, layer, weight) of ego edges, typed by the ends' roles."""
    r = roles.select("ego", F.col("id").alias("pre"), F.col("role").alias("_a"))
    s = roles.select("ego", F.col("id").alias("post"), F.col("role").alias("_b"))
    return edges.join(r, ["ego", "pre"]).join(s, ["ego", "post"]).select("ego", "pre", "post", edge_type(F.col("_a"), F.col("_b")).alias("layer"), "weight")


def type_similarity(a: DataFrame, b: DataFrame, value: float = 1.0) -> DataFrame:
    """(id_1, id_2, s) for nodes of equal type; other pairs are 0 and not stored."""
    return a.select(F.col("id").alias("id_1"), "type").join(b.select(F.col("id").alias("id_2"), "type"), "type").select("id_1", "id_2", F.lit(value).alias("s"))


def element_pairs(a: DataFrame, b: DataFrame, group: str, columns: Callable[[Column, Column], list[Column]], size: int = 4096, rows: int = 1 << 26) -> DataFrame:
    """(group, id_1, id_2, columns) of all pairs of elements (group, id, x) of one group.

    ``columns`` of two x is worked out once for each two that meet in a group.
    Rows come last, from two lists of at most ``size`` ids with those x, so
    lists, not a row a pair, are moved. They are dealt into tasks of about
    ``rows`` pairs each, however many pairs there are.
    """
    parts = max(64, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_count_pairs(a, b, group) // rows))
    kinds = a.select(F.col(group), F.col("x").alias("_x")).distinct()
    table = kinds.join(_id_lists(b, group, "_y", "_ids", size), group).select(group, "_x", "_ids", *columns(F.col("_x"), F.col("_y")))
    found = [c for c in table.columns if c not in (group, "_x", "_ids")]
    own = _id_lists(a.withColumnRenamed(group, "_g"), "_g", "_o", "_own", size)
    met = own.join(table, (F.col("_g") == F.col(group)) & F.col("_o").eqNullSafe(F.col("_x"))).select(group, "_own", "_ids", *found)
    dealt = met.repartition(parts, group, F.get("_own", F.lit(0)), F.get("_ids", F.lit(0)))
    return dealt.select(group, F.explode("_own").alias("id_1"), "_ids", *found).select(group, "id_1", F.explode("_ids").alias("id_2"), *found)


def _id_lists(df: DataFrame, group: str, x: str, ids: str, size: int) -> DataFrame:
    """(group, x, ids): the ids of a group's elements with one x, in lists of at most ``size``."""
    every = df.groupBy(group, F.col("x").alias(x)).agg(F.sort_array(F.collect_list(F.struct("id"))).alias("_every"))
    starts = every.select(group, x, F.col("_every.id").alias("_every"), F.explode(F.sequence(F.lit(1), F.size("_every"), F.lit(size))).alias("_start"))
    return starts.select(group, x, F.slice("_every", F.col("_start"), size).alias(ids))


def _count_pairs(a: DataFrame, b: DataFrame, group: str) -> int:
    n, m = (df.groupBy(group).agg(F.count(F.lit(1)).alias(k)) for df, k in ((a, "_n"), (b, "_m")))
    return int(n.join(m, group).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0)


def element_similarity(a: DataFrame, b: DataFrame, alpha: float, gamma: float, places: int | None = None) -> DataFrame:
    """As ``type_similarity``, falling with the difference of the elements' lengths; rounded if ``places`` says so."""
    s = lambda x, y: length_similarity(x, y, alpha, gamma)
    named = lambda x, y: [(s(x, y) if places is None else F.round(s(x, y), places) + F.lit(0.0)).alias("s")]
    return element_pairs(a.withColumnRenamed("len", "x"), b.withColumnRenamed("len", "x"), "type", named).select("id_1", "id_2", "s")


def chain(nodes: DataFrame, kind: str = "forward", value: float = 1.0) -> DataFrame:
    """(graph, i, j, v): consecutive nodes; symmetric adds the reverse."""
    f = nodes.select("graph", "i", F.lead("i").over(Window.partitionBy("graph").orderBy("i")).alias("j"), F.lit(value).alias("v")).where("j is not null")
    return f if kind == "forward" else f.unionAll(f.select("graph", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def assemble(contacts: DataFrame, orientation: DataFrame | Column | None, nodes: DataFrame, chain_value: float, similarity: Callable[[Column], Column] = inverse_similarity) -> DataFrame:
    """(graph, layer, i, j, v): similarity of contacts by orientation (one layer
    without orientations), and the forward chain as layer 0.

    Orientations are rows (graph, i, j, v) or, without a join, a column of the contacts.
    """
    c = contacts.select("graph", "i", "j", similarity(F.col("v")).alias("v"))
    if orientation is None or isinstance(orientation, Column):
        c = c.withColumn("layer", F.lit(1) if orientation is None else orientation.cast("int"))
    else:
        c = c.join(orientation.select("graph", "i", "j", F.col("v").cast("int").alias("layer")), ["graph", "i", "j"])
    line = chain(nodes, "forward", chain_value).withColumn("layer", F.lit(0))
    return c.select("graph", "layer", "i", "j", "v").unionByName(line.select("graph", "layer", "i", "j", "v"))


def discontinuity(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, cut, jump): the first largest step of ``value`` between neighbours."""
    step = F.abs(F.lead(value).over(Window.partitionBy(key).orderBy(pos)) - F.col(value))
    s = df.select(key, F.col(pos).alias("cut"), step.alias("jump")).where("jump is not null")
    return s.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("jump"), "cut"))).where("_r = 1").select(key, "cut", "jump")


def rotation(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, r, n): correlation of place and value after rotating at the steepest fall."""
    w = Window.partitionBy(key).orderBy(pos)
    n = df.withColumn("_p", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    fall = n.withColumn("_d", F.lead(value).over(w) - F.col(value)).where("_d is not null")
    cut = fall.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_d", "_p"))).where("_r = 1").select(key, F.col("_p").alias("_c"))
    turned = n.join(cut, key).withColumn("_q", F.pmod(F.col("_p") - F.col("_c") - 1, F.col("_n")))
    r = turned.groupBy(key).agg(F.covar_pop("_q", value).alias("_c"), F.stddev_pop("_q").alias("_s"), F.stddev_pop(value).alias("_t"), F.count(F.lit(1)).alias("n"))
    return r.select(key, F.when((F.col("_s") > 0) & (F.col("_t") > 0), F.col("_c") / F.nullif(F.col("_s") * F.col("_t"), F.lit(0.0))).alias("r"), "n")


def with_pvalue(r: DataFrame) -> DataFrame:
    """Adds the two-sided p of columns r and n."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else numerics.correlation_pvalue(a, int(b)) for a, b in zip(r, n, strict=True)], dtype=float)

    return r.withColumn("p", p("r", "n"))


def domain_split(matrix: DataFrame) -> DataFrame:
    """(graph, cut, u, p, p_adj): for each cut c from 1 to n - 2, whether the
    differences within the blocks before and after node c are below those
    between them; adjusted over a graph's cuts.

    Node c itself is in neither block, the diagonal is left out, and both
    (i, j) and (j, i) count. ``matrix`` holds every cell (graph, i, j, v).
    Cells are counted by value and later or earlier node, so a graph's task
    holds a row per node and value, and counts by value for some nodes at once.
    """
    cells = matrix.where("i <> j and v is not null")
    ends = [cells.groupBy("graph", F.expr(f"{end}(i, j)").cast("int").alias("i"), "v").agg(F.count(F.lit(1)).alias(name)) for end, name in (("greatest", "low"), ("least", "high"))]
    counts = ends[0].withColumn("high", F.lit(0).cast("long")).unionByName(ends[1].withColumn("low", F.lit(0).cast("long")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(pdf.v.to_numpy(), return_inverse=True)
        pdf = pdf.assign(at=at).sort_values("i")
        i, at, low, high = (pdf[c].to_numpy() for c in ("i", "at", "low", "high"))
        n, step = int(i[-1]) + 1, max(1, (1 << 19) // len(values))

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for start in range(0, n, step):
                own = slice(*np.searchsorted(i, [start, min(n, start + step)]))
                size = min(n, start + step) - start
                place = (i[own] - start) * len(values) + at[own]
                yield tuple(np.bincount(place, w[own], size * len(values)).reshape(size, -1) for w in (low, high))

        return _cuts(pdf.graph.iloc[0], np.arange(n), np.bincount(at, low, len(values)), blocks())

    return _adjusted_cuts(counts, run)


def difference_split(nodes: DataFrame) -> DataFrame:
    """``domain_split`` where a cell is the absolute difference of its nodes' ``x``, from (graph, i, x).

    Nodes without ``x`` are left out. A graph's task holds its nodes, not their
    cells, and counts by distinct difference for some nodes at once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return _cuts(pdf.graph.iloc[0], pdf.i.to_numpy(), *numerics.difference_counts(pdf.x.to_numpy(float)))

    return _adjusted_cuts(nodes.select("graph", "i", "x").where("x is not null"), run)


def _cuts(graph, cut: np.ndarray, total: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(graph, cut, u, p) of all nodes but the first and the last."""
    u, p, ok = (np.concatenate(x) for x in zip(*numerics.split_tests(blocks, total), strict=True))
    ok &= (cut > 0) & (cut < cut[-1])
    return pd.DataFrame({"graph": graph, "cut": cut[ok], "u": u[ok], "p": p[ok]})


def _adjusted_cuts(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    from .statistics import adjusted

    kind = dict(rows.dtypes)["graph"]
    return adjusted(rows.groupBy("graph").applyInPandas(run, f"graph {kind}, cut int, u double, p double"), "graph", "p", "cut")


def best_split(splits: DataFrame) -> DataFrame:
    """(graph, at, p, p_adj): each graph's cut of least p, as the first node of its second block."""
    r = F.row_number().over(Window.partitionBy("graph").orderBy("p", "cut"))
    return splits.withColumn("_r", r).where("_r = 1").select("graph", (F.col("cut") + 1).alias("at"), "p", "p_adj")


def communities(matrix: DataFrame, power: int = 1) -> DataFrame:
    """(graph, i, community) by Louvain on a power of each graph's similarity matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf.i.max(), pdf.j.max())) + 1
        w = np.zeros((n, n))
        w[pdf.i, pdf.j] = pdf.v
        w = np.linalg.matrix_power((w + w.T) / 2, power)
        np.fill_diagonal(w, 0)
        return pd.DataFrame({"graph": pdf.graph.iloc[0], "i": np.arange(n), "community": numerics.louvain(w / (w.max() or 1))})

    kind = dict(matrix.dtypes)["graph"]
    return matrix.select("graph", "i", "j", "v").groupBy("graph").applyInPandas(run, f"graph {kind}, i int, community int")


def anneal(objective: Callable[[DataFrame], DataFrame], start: list[float], spark, steps: int = 5, width: int = 8, seed: int = 1) -> DataFrame:
    """(step, candidate, x array, score, temperature, accepted): simulated annealing.

    Each step draws ``width`` candidates with N(0, 0.3) steps around the state;
    ``objective`` maps (candidate, x) to (candidate, score) as one Spark plan.
    Temperature falls as 10 * 0.99^step. A higher score is better.
    """
    rng = np.random.default_rng(seed)
    at, best, rows = np.array(start, float), None, []
    for step in range(steps):
        temperature = 10 * 0.99**step
        xs = at + rng.normal(0, 0.3, (width, len(at)))
        got = {r["candidate"]: r["score"] for r in objective(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(xs)], "candidate int, x array<double>")).collect()}
        for k, x in enumerate(xs):
            score = float(got[k])
            ok = best is None or score > best or rng.random() < np.exp((score - best) / temperature)
            if ok:
                at, best = x, score
            rows.append((step, k, x.tolist(), score, temperature, bool(ok)))
    return spark.createDataFrame(rows, "step int, candidate int, x array<double>, score double, temperature double, accepted boolean")
