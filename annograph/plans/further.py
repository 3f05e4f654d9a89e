"""Queries on files, skewed trees, permuted matches, further centralities and resamples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annograph.operators import dendrogram as dg
from annograph.operators import dynamics as dy
from annograph.operators import matching as gm
from annograph.operators import statistics as st
from annograph.operators import vectorise as vx
from annograph.sources import files
from annograph.sources import networks as net

from .core import A, E, QUERIES, RAW, SQL, T, query, rounded
from .graphs import _DS, _G, _graphs

__all__ = ["QUERIES", "SQL"]


# files


def _shared(t) -> str:
    return f"{dy.shared_root(t.spark)}/files-{uuid.uuid4().hex}"


@query(
    "globbed_files",
    "SELECT s_suppkey AS id, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
)
def _(t):
    """Two files of different columns, read by one glob."""
    root = _shared(t)
    files.write(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), f"{root}/part-a")
    files.write(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), f"{root}/part-b")
    return files.union_of(t.spark, f"{root}/part-*")


@query("feather_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    names = ("n_nationkey", "n_name", "n_regionkey")
    rows = t.nation.select(*names)
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return files.from_feather(t.spark.read.parquet(files.write(rows, _shared(t), "feather")), schema)


@query("tsv_round_trip", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    path = files.write(t.supplier.select("s_suppkey", "s_nationkey"), _shared(t), "tsv")
    return t.spark.read.csv(path, header=True, sep="\t", schema="s_suppkey long, s_nationkey long")


@query("computed_once", f"WITH {E} SELECT pre, post, weight FROM e WHERE weight > 10")
def _(t):
    """The second call reads what the first one wrote, and other parameters don't."""
    root = _shared(t)

    def edges(least: int):
        return files.computed(t.spark, root, "edges", {"least": least}, lambda: net.nation_edges(t).where(F.col("weight") > least))

    edges(10)
    edges(1_000_000_000)
    return edges(10)


@query("dot_edges", f"WITH {E}, c AS (SELECT * FROM e WHERE weight > 1) SELECT printf('n%d -> n%d [penwidth=%.3f];', pre, post, 4 * weight / (SELECT max(weight) FROM c)) AS line FROM c")
def _(t):
    """Edges as lines of the graph description language, as wide as their share of the largest weight."""
    c = dy.cut_lineage(net.nation_edges(t).where("weight > 1"))
    wide = c.join(F.broadcast(c.agg(F.max("weight").alias("top"))))
    return wide.select(F.format_string("n%d -> n%d [penwidth=%.3f];", "pre", "post", 4 * F.col("weight") / F.col("top")).alias("line"))


# diversity where some partners have no vector

_PA = "a AS (SELECT n_nationkey AS id, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)"
_PE = "pe AS (SELECT * FROM t WHERE (pre * 7 + post) % 4 = 0)"
_MX = f"""{T}, {_PA}, {_PE}, {RAW.replace('FROM e JOIN', 'FROM pe JOIN')}, vec AS (SELECT id, side, category, value / sum(value) OVER (PARTITION BY id, side) AS p FROM raw),
 h AS (SELECT id, side, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h FROM vec GROUP BY 1, 2),
 pt AS (SELECT pre AS id, post AS other, 'ds' AS way FROM pe UNION SELECT post, pre, 'us' FROM pe),
 m AS (SELECT pt.id, way, side, avg(h) AS entropy, count(*) AS k FROM pt JOIN h ON h.id = other GROUP BY 1, 2, 3),
 q AS (SELECT pt.id, pt.way, v.side, v.category, sum(p) / max(k) AS q FROM pt JOIN vec v ON v.id = other JOIN m ON m.id = pt.id AND m.way = pt.way AND m.side = v.side GROUP BY 1, 2, 3, 4),
 g AS (SELECT id, way, side, sum(CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) AS ent_of_avg FROM q GROUP BY 1, 2, 3)"""


@query("matrix_diversity", f"WITH {_MX} SELECT id, way, side, round(ent_of_avg, 6) AS ent_of_avg, round(entropy, 6) AS entropy FROM (SELECT DISTINCT id, way FROM pt) LEFT JOIN m USING (id, way) LEFT JOIN g USING (id, way, side)")
def _(t):
    e = dy.cut_lineage(net.sparse_edges(t).where((F.col("pre") * 7 + F.col("post")) % 4 == 0))
    vec = vx.vectors(e, net.region_annotation(t).where("id % 3 = 0"))
    return rounded(vx.partner_diversity(e, vec), "ent_of_avg", "entropy")


# matches under a permutation, and a tree that is a chain

_RV = f"""{_G}, to_ AS (SELECT id_1, id_2, g AS y, CASE WHEN g < n_1 THEN n_1 - 1 - g ELSE g END AS x FROM pr, (SELECT unnest(range(40)) AS g) WHERE g < n_2),
 ca AS (SELECT id_1, id_2, i, j, v AS a FROM pr JOIN cells ON graph = id_1),
 cb AS (SELECT pr.id_1, pr.id_2, f.x AS i, s.x AS j, v AS b FROM pr JOIN cells ON graph = pr.id_2 JOIN to_ f ON f.id_1 = pr.id_1 AND f.id_2 = pr.id_2 AND f.y = i JOIN to_ s ON s.id_1 = pr.id_1 AND s.id_2 = pr.id_2 AND s.y = j),
 al AS (SELECT id_1, id_2, i, j, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM ca FULL JOIN cb USING (id_1, id_2, i, j))"""


@query("distance_stats_reversed", f"WITH {_RV} {_DS}")
def _(t):
    """Node i of the smaller graph with node n_1 - 1 - i of the larger one."""
    _, cells, _, p = _graphs(t)
    turned = gm.identity_matching(p).join(p.select("id_1", "id_2", "n_1"), ["id_1", "id_2"]).select("id_1", "id_2", "i", (F.col("n_1") - 1 - F.col("i")).cast("int").alias("j"))
    return rounded(gm.distance_stats(cells, turned, p), "fnorm", "euclidean_distance")


def _chain(t):
    """Leaf k + 1 joins all leaves before it at height k + 1; as many leaves as nations."""
    n = t.nation.count()
    z = t.spark.range(n - 1).select(
        (n + F.col("id")).cast("int").alias("merge"), F.when(F.col("id") == 0, F.lit(0)).otherwise(n + F.col("id") - 1).cast("int").alias("left"),
        (F.col("id") + 1).cast("int").alias("right"), (F.col("id") + 1).cast("double").alias("dist"), (F.col("id") + 2).cast("int").alias("size"),
    )
    return z, dg.members(z)


_N = "(SELECT count(*) FROM nation)"
_CM = f"cm AS (SELECT ({_N} + k - 1)::INT AS merge, n_nationkey AS leaf, (k + 1)::INT AS size, k::DOUBLE AS dist FROM nation, (SELECT unnest(range(1, 25)) AS k) WHERE n_nationkey <= k AND k < {_N})"


@query("chain_members", f"WITH {_CM} SELECT * FROM cm")
def _(t):
    return _chain(t)[1]


@query(
    "chain_smallest_containing",
    f"WITH l AS (SELECT r_name AS label, max(n_nationkey) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT label, ({_N} + greatest(last, 1) - 1)::INT AS merge, (greatest(last, 1) + 1)::INT AS size, greatest(last, 1)::DOUBLE AS dist FROM l",
)
def _(t):
    labels = net.region_annotation(t).select(F.col("id").alias("leaf"), F.col("type").alias("label"))
    return dg.smallest_containing(_chain(t)[1], labels)


# distances, linkage


@query("cosine_linkage")
def _(t):
    v = t.embeddings.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return dg.build(v, "average", metric="cosine")


@query("linkage_from_distances")
def _(t):
    v = t.embeddings.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return dg.build_from_lines(st.distance_lines(v, "group"), "ward")


# centralities

_IDS = "ids AS (SELECT pre AS id FROM t UNION SELECT post FROM t)"
_EV = ", ".join(
    f"u{k} AS (SELECT x.id, x.value + coalesce(sum(y.value * weight / (SELECT max(weight) FROM t)), 0) AS value FROM v{k - 1} x LEFT JOIN t ON {{to}} = x.id LEFT JOIN v{k - 1} y ON y.id = {{from_}} GROUP BY x.id, x.value), "
    f"v{k} AS MATERIALIZED (SELECT id, value / (SELECT sqrt(sum(value * value)) FROM u{k}) AS value FROM u{k})"
    for k in range(1, 13)
)


def _eigen_sql(to: str, from_: str) -> str:
    return f"WITH {T}, {_IDS}, v0 AS (SELECT id, 1.0::DOUBLE AS value FROM ids), {_EV.format(to=to, from_=from_)} SELECT id, round(value, 6) AS value FROM v12"


@query("eigenvector", _eigen_sql("post", "pre"))
def _(t):
    return rounded(dy.eigenvector(net.sparse_edges(t), rounds=12), "value")


@query("eigenvector_out", _eigen_sql("pre", "post"))
def _(t):
    return rounded(dy.eigenvector(dy.reversed_edges(net.sparse_edges(t)), rounds=12), "value")


@query(
    "laplacian",
    f"""WITH {T}, s AS (SELECT pre, post, sum(weight) AS w FROM (SELECT pre, post, weight FROM t UNION ALL SELECT post, pre, weight FROM t) GROUP BY 1, 2),
 k AS (SELECT pre AS id, sum(w) AS k, sum(w * w) AS sq FROM s GROUP BY 1) SELECT k.id, k.k * k.k + 2 * sum(s.w * o.k) + k.sq AS value FROM k JOIN s ON s.pre = k.id JOIN k o ON o.id = s.post GROUP BY k.id, k.k, k.sq""",
)
def _(t):
    return dy.laplacian(net.sparse_edges(t))


@query("shell_betweenness")
def _(t):
    return dy.per_network(net.sparse_edges(t), "shell_betweenness")


@query("percolation")
def _(t):
    """States are the nations' shares of all outgoing weight."""
    e = dy.cut_lineage(net.sparse_edges(t))
    out = e.groupBy(F.col("pre").alias("id")).agg(F.sum("weight").alias("w"))
    return rounded(dy.percolation(e, out.join(F.broadcast(out.agg(F.sum("w").alias("all")))).select("id", (F.col("w") / F.col("all")).alias("state"))), "value")


_WD = ", ".join(
    f"d{k} AS MATERIALIZED (SELECT source, id, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT source, post, d + 1 / weight FROM d{k - 1} JOIN t ON pre = id) GROUP BY 1, 2)"
    for k in range(1, 25)
)


@query("weighted_distances", f"WITH {T}, {_IDS}, d0 AS (SELECT id AS source, id, 0::DOUBLE AS d FROM ids), {_WD} SELECT source, id, round(d, 9) AS d FROM d24")
def _(t):
    e = net.sparse_edges(t)
    return rounded(dy.weighted_distances(e, dy.node_ids(e)), "d", places=9)


def _harmonic_sql(name: str, to: str, from_: str) -> str:
    bfs = f"bfs_{name}(source, id, layer) AS (SELECT id, id, 0 FROM ids UNION SELECT source, {to}, layer + 1 FROM bfs_{name} JOIN t ON {from_} = bfs_{name}.id WHERE layer < 24)"
    least = f"ly_{name} AS (SELECT source, id, min(layer) AS layer FROM bfs_{name} GROUP BY 1, 2)"
    return f"{bfs}, {least}, {name} AS (SELECT ids.id, coalesce(sum(1.0 / layer), 0) AS h FROM ids LEFT JOIN {('ly_' + name)} l ON l.id = ids.id AND layer > 0 GROUP BY 1)"


def _rank_sql(name: str, post: str, pre: str) -> str:
    w = f"w_{name} AS (SELECT {pre} AS pre, {post} AS post, 1.0::DOUBLE / count(*) OVER (PARTITION BY {pre}) AS s FROM t), {name}0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids)"
    step = ", ".join(
        f"{name}{k} AS MATERIALIZED (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * (coalesce(sum(r.rank * s), 0) + (SELECT coalesce(sum(rank), 0) FROM {name}{k - 1} WHERE id NOT IN (SELECT pre FROM w_{name})) / (SELECT count(*) FROM ids)) AS rank"
        f" FROM ids LEFT JOIN w_{name} w ON w.post = ids.id LEFT JOIN {name}{k - 1} r ON r.id = w.pre GROUP BY 1)"
        for k in range(1, 11)
    )
    return f"{w}, {step}"


_CT = f"""WITH RECURSIVE {T}, {_IDS}, {_harmonic_sql('hi', 'post', 'pre')}, {_harmonic_sql('ho', 'pre', 'post')}, {_rank_sql('ri', 'post', 'pre')}, {_rank_sql('ro', 'pre', 'post')},
 dg AS (SELECT ids.id, (SELECT count(*) FROM t WHERE post = ids.id) AS i, (SELECT count(*) FROM t WHERE pre = ids.id) AS o, (SELECT coalesce(sum(weight), 0) FROM t WHERE post = ids.id) AS wi, (SELECT coalesce(sum(weight), 0) FROM t WHERE pre = ids.id) AS wo, (SELECT count(*) - 1 FROM ids) AS n FROM ids)
 SELECT dg.id, round(i / n, 6) AS in_degree, round(o / n, 6) AS out_degree, round((i + o) / n, 6) AS degree, wi AS in_strength, wo AS out_strength, wi + wo AS strength,
 round(hi.h, 6) AS in_harmonic, round(ho.h, 6) AS out_harmonic, round(ri10.rank, 6) AS in_pagerank, round(ro10.rank, 6) AS out_pagerank
 FROM dg JOIN hi ON hi.id = dg.id JOIN ho ON ho.id = dg.id JOIN ri10 ON ri10.id = dg.id JOIN ro10 ON ro10.id = dg.id"""


@query("centrality_columns", _CT)
def _(t):
    """The wide table of centralities but for current flow, which SQL can't express."""
    c = dy.centralities(net.sparse_edges(t), rounds=10, current_flow=False)
    return rounded(c, "in_degree", "out_degree", "degree", "in_harmonic", "out_harmonic", "in_pagerank", "out_pagerank")


# resamples


@query("null_pair_resample")
def _(t):
    """Left partners keep their place, right ones are drawn with replacement; 10 seeds."""
    pairs = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id_1"), (F.col("s_suppkey") + 1).alias("id_2"))
    return dy.resampled(pairs.withColumn("pair", F.col("id_1")), "pair", ["id_1", "id_2"], 10).drop("pair")


@query("null_group_resample")
def _(t):
    """Groups of six matched suppliers: the first column stays, each other one is drawn for itself; 10 seeds."""
    s = F.col("s_suppkey")
    g = t.supplier.select(F.floor((s - 1) / 6).alias("row"), ((s - 1) % 6).alias("place"), s.alias("id"))
    wide = g.groupBy("row").pivot("place", list(range(6))).agg(F.first("id")).dropna()
    return dy.resampled(wide.toDF("row", *(f"m{k}" for k in range(6))), "row", [f"m{k}" for k in range(6)], 10)
