"""Queries on vectors, entropy and neighbourhoods, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annograph.functions.columns import entropy, entropy_term, strip_side, unguarded_entropy
from annograph.operators import dynamics as dy
from annograph.operators import neighbourhood as nb
from annograph.operators import vectorise as vx
from annograph.sources import networks as net
from annograph.sources import text as tx
from annograph.sources.networks import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracles.
E = """e AS (SELECT s_nationkey AS pre, c_nationkey AS post, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
T = f"{E}, t AS (SELECT pre, post, weight FROM e WHERE weight > 1.1 * (SELECT avg(weight) FROM e) AND pre <> post)"
A = "a AS (SELECT n_nationkey AS id, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey)"
SC = """sc AS (SELECT 'S' || l_suppkey AS pre, 'C' || o_custkey AS post, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
AC = "ac AS (SELECT 'C' || c_custkey AS id, c_mktsegment AS type FROM customer UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"
RAW = """raw AS (SELECT pre AS id, 'out' AS side, type AS category, sum(weight) AS value FROM e JOIN a ON a.id = post GROUP BY 1, 2, 3
 UNION ALL SELECT post, 'in', type, sum(weight) FROM e JOIN a ON a.id = pre GROUP BY 1, 2, 3)"""
VEC = f"{E}, {A}, {RAW}, vec AS (SELECT id, side, category, value / sum(value) OVER (PARTITION BY id, side) AS p FROM raw)"
H = "h AS (SELECT id, side, sum(CASE WHEN p > 1e-8 THEN -p * ln(p) ELSE 0 END) AS h FROM vec GROUP BY 1, 2)"
BO = "bo AS (SELECT DISTINCT l_orderkey AS r_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
OS = "os AS (SELECT o_orderkey AS r_id, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey)"
PARTNERS = """p AS (SELECT ego, id, sum(wp) AS weight_pre, sum(wq) AS weight_post, sum(wp) + sum(wq) AS total_weight FROM
 (SELECT post AS ego, pre AS id, weight AS wp, 0.0::DOUBLE AS wq FROM e UNION ALL SELECT pre, post, 0.0::DOUBLE, weight FROM e) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY total_weight DESC, id) AS rn FROM p)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


@query("edges_nation", f"WITH {E} SELECT * FROM e")
def _(t):
    return net.nation_edges(t)


@query("edges_trim_distinct", "SELECT DISTINCT upper(trim(p_brand)) AS pre, upper(trim(p_type)) AS post FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL")
def _(t):
    return t.part.na.drop(subset=["p_brand", "p_type"]).select(F.upper(F.trim("p_brand")).alias("pre"), F.upper(F.trim("p_type")).alias("post")).distinct()


@query("labels_multi", "SELECT p_brand || ' ' || p_type AS label, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.part.where("p_size > 40").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("labels_kept", "SELECT c_custkey AS id, c_mktsegment AS type FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING')")
def _(t):
    return t.customer.where(F.col("c_mktsegment").isNotNull() & ~F.col("c_mktsegment").isin("BUILDING")).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))


_RICH = "SELECT 'C' || c_custkey AS id FROM customer WHERE c_acctbal > 0"


@query("edges_both_known", f"WITH {SC} SELECT pre, post, weight FROM sc WHERE post IN ({_RICH}) AND pre IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(t):
    rich = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("C"), "c_custkey").alias("post"))
    sup = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("pre"))
    return net.supplier_customer_edges(t).join(rich, "post", "left_semi").join(sup, "pre", "left_semi").select("pre", "post", "weight")


@query("meta_in_network", f"WITH {SC}, {AC} SELECT id, type FROM ac WHERE id IN (SELECT post FROM sc WHERE weight > 50)")
def _(t):
    ids = net.supplier_customer_edges(t).where("weight > 50").select(F.col("post").alias("id"))
    return net.customer_annotation(t).join(ids, "id", "left_semi")


@query("meta_not_in_network", f"WITH {SC}, {AC} SELECT id, type FROM ac WHERE id NOT IN (SELECT post FROM sc WHERE weight > 50)")
def _(t):
    heavy = net.supplier_customer_edges(t).where("weight > 50")
    return net.customer_annotation(t).join(heavy.select(F.col("post").alias("id")), "id", "left_anti")


@query("dedup_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("coalesced_type", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_brand) AS type FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand")).alias("type"))


@query("relabelled", "SELECT n_nationkey AS id, CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' WHEN r_name = 'EUROPE' THEN n_name ELSE 'REST' END AS type FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return j.select(F.col("n_nationkey").alias("id"), F.when(F.col("r_name").isin("ASIA", "MIDDLE EAST"), "EAST").when(F.col("r_name") == "EUROPE", F.col("n_name")).otherwise("REST").alias("type"))


@query("edges_bidirectional", f"WITH {T}, s AS (SELECT pre, post, weight FROM t WHERE pre % 2 = 0 UNION ALL SELECT post, pre, weight FROM t WHERE pre % 2 = 0 UNION ALL SELECT pre, post, weight FROM t WHERE pre % 2 = 1) SELECT pre, post, sum(weight) AS weight FROM s GROUP BY 1, 2")
def _(t):
    e = net.sparse_edges(t)
    electric = e.where("pre % 2 = 0")
    return vx.collapse(electric.unionByName(vx.collapse(electric.select(F.col("post").alias("pre"), F.col("pre").alias("post"), "weight"))).unionByName(e.where("pre % 2 = 1")))


@query("shell_edges", f"WITH {T}, s AS (SELECT pre, post, weight FROM t UNION ALL SELECT post, pre, weight FROM t) SELECT pre, post, sum(weight) AS weight, round(1 / sum(weight), 10) AS inv_weight FROM s GROUP BY 1, 2")
def _(t):
    return vx.both_ways(net.sparse_edges(t)).withColumn("inv_weight", F.round(1 / F.col("weight"), 10))


@query("padded_ids", "WITH k AS (SELECT c_name AS padded, regexp_extract(c_name, '\\d+$') AS d FROM customer), m AS (SELECT substr(padded, 1, length(padded) - length(d)) || CAST(CAST(d AS BIGINT) AS VARCHAR) AS plain, padded FROM k), x AS (SELECT 'Customer#' || o_custkey AS name, o_orderkey FROM orders) SELECT o_orderkey, coalesce(padded, name) AS name FROM x LEFT JOIN m ON plain = name")
def _(t):
    d = F.regexp_extract("c_name", r"(\d+)$", 1)
    plain = F.concat(F.substring(F.col("c_name"), F.lit(1), F.length("c_name") - F.length(d)), d.cast("long").cast("string"))
    names = t.customer.select(plain.alias("name"), F.col("c_name").alias("padded"))
    x = t.orders.select("o_orderkey", F.concat(F.lit("Customer#"), "o_custkey").alias("name"))
    return x.join(names, "name", "left").select("o_orderkey", F.coalesce("padded", "name").alias("name"))


@query("derived_keys", "SELECT c_custkey AS id, 'ph_' || lower(c_mktsegment) AS tag, c_mktsegment || '_' || c_nationkey AS pair, split_part(c_name, '#', 1) AS stem FROM customer")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("ph_"), F.lower("c_mktsegment")).alias("tag"), F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("pair"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("stem"))


@query("threshold_edges", f"WITH {T} SELECT pre, post, weight FROM t")
def _(t):
    return net.sparse_edges(t)


@query("strip_suffix", "WITH x AS (SELECT s_suppkey AS id, s_name || CASE s_suppkey % 3 WHEN 0 THEN '_L' WHEN 1 THEN '_R' ELSE '' END AS name FROM supplier) SELECT id, CASE WHEN substr(name, length(name) - 1, 1) = '_' THEN substr(name, 1, length(name) - 2) ELSE name END AS name, sum(CASE WHEN substr(name, length(name) - 1, 1) = '_' THEN 1 ELSE 0 END) OVER ()::BIGINT AS changed FROM x")
def _(t):
    side = F.when(F.col("s_suppkey") % 3 == 0, "_L").when(F.col("s_suppkey") % 3 == 1, "_R").otherwise("")
    x = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat("s_name", side).alias("name"))
    n = x.agg(F.sum((strip_side(F.col("name")) != F.col("name")).cast("long")).alias("changed"))
    return x.select("id", strip_side(F.col("name")).alias("name")).join(F.broadcast(n))


@query("edge_tuple", f"WITH {T} SELECT '(' || pre || ', ' || post || ')' AS edge, weight FROM t")
def _(t):
    packed = net.sparse_edges(t).select(F.struct("pre", "post").alias("edge"), "weight")
    return packed.select(F.format_string("(%d, %d)", "edge.pre", "edge.post").alias("edge"), "weight")


@query("sign_split", "WITH s AS (SELECT l_suppkey AS pre, l_partkey AS post, round(sum(l_quantity) - 25, 2) AS weight FROM lineitem GROUP BY 1, 2), p AS (SELECT pre AS id, sum(weight) AS pos_strength FROM s WHERE weight > 0 GROUP BY 1), n AS (SELECT pre AS id, sum(abs(weight)) AS neg_strength FROM s WHERE weight < 0 GROUP BY 1) SELECT p.id, round(pos_strength, 4) AS pos_strength, round(neg_strength, 4) AS neg_strength FROM p LEFT JOIN n USING (id)")
def _(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("id"), "l_partkey").agg(F.round(F.sum("l_quantity") - 25, 2).alias("weight"))
    part = lambda c, name: s.where(c).groupBy("id").agg(F.round(F.sum(F.abs("weight")), 4).alias(f"{name}_strength"))
    return part("weight > 0", "pos").join(part("weight < 0", "neg"), "id", "left")


@query("ipsi_contra", "WITH x AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'Midline' END AS side, l_returnflag AS flag, CASE l_linenumber % 2 WHEN 0 THEN 'L' ELSE 'R' END AS cat FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT id, flag || '_' || CASE WHEN side = 'Midline' THEN 'Midline' WHEN side = cat THEN 'I' ELSE 'C' END AS category, count(*) AS n FROM x GROUP BY 1, 2")
def _(t):
    side = F.when(F.col("l_suppkey") % 3 == 0, "L").when(F.col("l_suppkey") % 3 == 1, "R").otherwise("Midline")
    cat = F.when(F.col("l_linenumber") % 2 == 0, "L").otherwise("R")
    rel = F.when(side == "Midline", "Midline").when(F.instr(cat, "L") == F.instr(side, "L"), "I").otherwise("C")
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_suppkey").alias("id"), F.concat_ws("_", "l_returnflag", rel).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("factorised", "WITH f AS (SELECT p_brand AS label, min(p_partkey) AS first_seen, CASE WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END AS pr FROM part GROUP BY 1) SELECT label, row_number() OVER (ORDER BY pr, first_seen, label) - 1 AS code FROM f")
def _(t):
    f = t.part.groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("first_seen"))
    pr = F.when(F.col("label") == "Brand#3", 0).otherwise(1)
    return f.select("label", (F.row_number().over(Window.orderBy(pr, "first_seen", "label")) - 1).cast("long").alias("code"))  # one row per label


@query("instance_names", "WITH x AS (SELECT o_orderpriority AS cluster, CASE o_orderkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS side, o_orderstatus AS ty FROM orders WHERE o_orderstatus <> 'P') SELECT cluster, ty, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r FROM x GROUP BY 1, 2")
def _(t):
    name = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R"))
    x = t.orders.where("o_orderstatus <> 'P'").select(F.split(name, r"\|").alias("f")).select(F.col("f")[0].alias("ty"), F.col("f")[1].alias("cluster"), F.col("f")[2].alias("side"))
    return x.groupBy("cluster", "ty").pivot("side", ["L", "R"]).count().select("cluster", "ty", F.coalesce("L", F.lit(0)).alias("l"), F.coalesce("R", F.lit(0)).alias("r"))


@query("lr_pairs", "WITH x AS (SELECT s_suppkey, 'N' || (s_suppkey // 2) || CASE s_suppkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS name FROM supplier), g AS (SELECT substr(name, 1, length(name) - 1) AS stem, s_suppkey FROM x), k AS (SELECT stem FROM g GROUP BY 1 HAVING count(*) = 2) SELECT stem, min(s_suppkey) AS id_1, max(s_suppkey) AS id_2 FROM g WHERE stem IN (SELECT stem FROM k) GROUP BY 1")
def _(t):
    name = F.concat(F.lit("N"), F.floor(F.col("s_suppkey") / 2), F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("R"))
    g = t.supplier.select("s_suppkey", F.substring(name, F.lit(1), F.length(name) - 1).alias("stem"))
    return g.groupBy("stem").agg(F.min("s_suppkey").alias("id_1"), F.max("s_suppkey").alias("id_2"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("exact_groups", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1 HAVING count(*) = 6")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("g")).where(F.size("g") == 6)
    return g.select("o_custkey", F.array_join(F.col("g").cast("array<string>"), ",").alias("orders"))


@query("group_sample")
def _(t):
    """Three customers per segment, by a seeded hash: the same on every run."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.xxhash64("c_custkey", F.lit(7)), "c_custkey")
    return t.customer.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_mktsegment", "c_custkey")


@query("membership_filters", "WITH f AS (SELECT p_brand AS family, p_type AS super, count(*) AS n, median(p_size) AS m FROM part GROUP BY 1, 2 HAVING count(*) > 5), s AS (SELECT super FROM f GROUP BY 1 HAVING count(*) > 5) SELECT p_partkey AS id, family, super FROM part JOIN f ON p_brand = family AND p_type = super WHERE super IN (SELECT super FROM s) AND p_size >= m")
def _(t):
    f = t.part.groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("super")).agg(F.count(F.lit(1)).alias("n"), F.median("p_size").alias("m")).where("n > 5")
    s = f.groupBy("super").count().where("count > 5").select("super")
    kept = f.join(s, "super", "left_semi")
    return t.part.join(kept, (F.col("p_brand") == F.col("family")) & (F.col("p_type") == F.col("super"))).where("p_size >= m").select(F.col("p_partkey").alias("id"), "family", "super")


@query("vec_out_in", f"WITH {VEC} SELECT id, side, category, round(p, 6) AS p FROM vec")
def _(t):
    return rounded(vx.vectors(net.nation_edges(t), net.region_annotation(t)), "p")


@query("vec_multilabel", f"WITH {SC}, {AC}, raw AS (SELECT pre AS id, 'out' AS side, type AS category, sum(weight) AS v FROM sc JOIN ac ON ac.id = post GROUP BY 1, 2, 3) SELECT id, side, category, round(v / sum(v) OVER (PARTITION BY id, side), 6) AS p FROM raw")
def _(t):
    return rounded(vx.vectors(net.supplier_customer_edges(t), net.customer_annotation(t)), "p")


@query("vec_raw", f"WITH {E}, {A}, {RAW} SELECT * FROM raw")
def _(t):
    return vx.raw_vectors(net.nation_edges(t), net.region_annotation(t))


for _policy, _sql in (("zero", "coalesce(p, 0)"), ("null", "CASE WHEN count(p) OVER (PARTITION BY id, side) > 0 THEN coalesce(p, 0) END"), ("tiny", "coalesce(p, 1e-10)")):

    @query(f"vec_policy_{_policy}", f"WITH {T}, {A}, e2 AS (SELECT * FROM t WHERE pre % 5 <> 0), raw AS (SELECT pre AS id, 'out' AS side, type AS category, sum(weight) AS v FROM e2 JOIN a ON a.id = post GROUP BY 1, 2, 3 UNION ALL SELECT post, 'in', type, sum(weight) FROM e2 JOIN a ON a.id = pre GROUP BY 1, 2, 3), vec AS (SELECT id, side, category, v / sum(v) OVER (PARTITION BY id, side) AS p FROM raw), g AS (SELECT * FROM (SELECT DISTINCT id FROM vec), (VALUES ('in'), ('out')) s(side), (SELECT DISTINCT type AS category FROM a)), j AS (SELECT g.id, g.side, g.category, p FROM g LEFT JOIN vec USING (id, side, category)) SELECT id, side, category, round({_sql}, 6) AS p FROM j")
    def _(t, policy=_policy):
        a = net.region_annotation(t)
        return rounded(vx.filled(vx.vectors(net.sparse_edges(t).where("pre % 5 <> 0"), a), a, policy), "p")


@query("row_norm", f"WITH {E} SELECT pre, post, round(weight / sum(weight) OVER (PARTITION BY pre), 6) AS v FROM e")
def _(t):
    return rounded(vx.normalised(net.nation_edges(t), ["pre"], "weight", "v"), "v").drop("weight")


@query("col_norm", f"WITH {E} SELECT pre, post, round(weight / sum(weight) OVER (PARTITION BY post), 6) AS v FROM e")
def _(t):
    return rounded(vx.normalised(net.nation_edges(t), ["post"], "weight", "v"), "v").drop("weight")


@query("bipartite_sums", "SELECT l_orderkey AS r, p_brand AS c, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("r"), F.col("p_brand").alias("c")).agg(F.sum("l_quantity").alias("v"))


@query("undirected_sums", f"WITH {E} SELECT pre, post, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT post, pre, weight FROM e) GROUP BY 1, 2")
def _(t):
    return vx.both_ways(net.nation_edges(t))


@query("binary_adjacency", f"WITH {T} SELECT DISTINCT pre, post, 1 AS v FROM t")
def _(t):
    return net.sparse_edges(t).select("pre", "post").distinct().withColumn("v", F.lit(1))


@query("binary_bipartite", f"WITH {BO} SELECT r_id, item, 1 AS v FROM bo")
def _(t):
    return net.order_brands(t).withColumn("v", F.lit(1))


@query("two_hop_space", f"WITH {BO}, {OS}, n AS (SELECT label AS category, item, count(*)::DOUBLE AS n FROM os JOIN bo USING (r_id) GROUP BY 1, 2) SELECT category, item, round(n / sum(n) OVER (PARTITION BY category), 6) AS v FROM n")
def _(t):
    return rounded(vx.two_hop(net.order_segments(t), net.order_brands(t)), "v")


@query("two_hop_standardised", f"WITH {BO}, {OS}, m AS (SELECT label AS category, count(*) AS m FROM os GROUP BY 1), n AS (SELECT label AS category, item, count(*)::DOUBLE AS n FROM os JOIN bo USING (r_id) GROUP BY 1, 2), q AS (SELECT category, item, n / m AS n FROM n JOIN m USING (category)) SELECT category, item, round(n / sum(n) OVER (PARTITION BY item), 6) AS v FROM q")
def _(t):
    return rounded(vx.two_hop(net.order_segments(t), net.order_brands(t), True), "v")


@query("co_membership", f"WITH {BO}, n AS (SELECT x.item AS a, y.item AS b, count(*)::DOUBLE AS n FROM bo x JOIN bo y USING (r_id) GROUP BY 1, 2) SELECT n.a, n.b, round(n.n / d.n, 6) AS v FROM n JOIN n d ON d.a = n.b AND d.b = n.b")
def _(t):
    return rounded(vx.co_membership(net.order_brands(t), "r_id", "item"), "v")


@query("label_counts", f"WITH {AC} SELECT type, count(*) AS n, count(DISTINCT id) AS ids FROM ac GROUP BY 1")
def _(t):
    return net.customer_annotation(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("label_counts_ud", f"WITH {T}, {A}, r AS (SELECT pre AS id, 'ds' AS side, type AS category, count(*)::DOUBLE AS n FROM t JOIN a ON a.id = post WHERE type <> 'ASIA' GROUP BY 1, 2, 3 UNION ALL SELECT post, 'us', type, count(*)::DOUBLE FROM t JOIN a ON a.id = pre WHERE type <> 'ASIA' GROUP BY 1, 2, 3) SELECT id, side, category, round(n / sum(n) OVER (PARTITION BY id, side), 6) AS p FROM r")
def _(t):
    v = vx.vectors(net.sparse_edges(t).withColumn("weight", F.lit(1.0)), net.region_annotation(t).where("type <> 'ASIA'"))
    return rounded(v.withColumn("side", F.when(F.col("side") == "out", "ds").otherwise("us")), "p")


@query("row_count_subset", f"WITH {BO} SELECT r_id, count(*) AS n FROM bo WHERE item IN ('Brand#1', 'Brand#2', 'Brand#3') AND r_id % 3 = 0 GROUP BY 1")
def _(t):
    return net.order_brands(t).where(F.col("item").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("r_id") % 3 == 0)).groupBy("r_id").agg(F.count(F.lit(1)).alias("n"))


@query("entropy_io", f"WITH {VEC}, {H} SELECT id, round(max(h) FILTER (side = 'in'), 6) AS in_entropy, round(max(h) FILTER (side = 'out'), 6) AS out_entropy FROM h GROUP BY 1")
def _(t):
    return rounded(vx.side_entropy(vx.vectors(net.nation_edges(t), net.region_annotation(t))), "in_entropy", "out_entropy")


#: Vectors whose values are null for a quarter of the nodes, zero for one and tiny for one.
_ODD = "odd AS (SELECT id, side, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN p * 1e-9 ELSE p END AS p FROM vec)"


def _h(delta: float) -> str:
    return f"sum(CASE WHEN p > {delta} THEN -p * ln(p) ELSE 0 END)"


@query(
    "entropy_variants",
    f"""WITH {VEC}, {_ODD} SELECT id, side, CASE WHEN count(p) > 0 THEN round({_h(1e-8)}, 12) END AS strict, CASE WHEN count(p) > 0 THEN round({_h(0)}, 12) END AS all_null,
 CASE WHEN sum(p) <> 0 THEN round({_h(1e-8)}, 12) END AS zero_sum, CASE WHEN max(p) > 0 THEN round({_h(0)}, 12) END AS no_positive,
 count(p) = 0 OR min(p) = 0 AS undefined FROM odd GROUP BY 1, 2""",
)
def _(t):
    v = vx.vectors(net.nation_edges(t), net.region_annotation(t))
    kind = F.col("id") % 4
    p = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(0.0)).when(kind == 2, F.col("p") * 1e-9).otherwise(F.col("p"))
    forms = {"strict": entropy(F.col("p")), "all_null": entropy(F.col("p"), 0.0), "zero_sum": entropy(F.col("p"), 1e-8, "zero_sum"), "no_positive": entropy(F.col("p"), 0.0, "no_positive")}
    h = v.withColumn("p", p).groupBy("id", "side").agg(*(f.alias(k) for k, f in forms.items()), F.isnan(unguarded_entropy(F.col("p"))).alias("undefined"))
    return rounded(h, *forms, places=12)


_OW = """SELECT id, max(m) FILTER (side = 'in') AS in_entropy, max(g) FILTER (side = 'in') AS in_ent_of_avg, max(m) FILTER (side = 'out') AS out_entropy, max(g) FILTER (side = 'out') AS out_ent_of_avg FROM (
 SELECT id, side, max(m) AS m, sum(CASE WHEN q > 1e-8 THEN -q * ln(q) ELSE 0 END) AS g FROM (SELECT x.id, x.side, category, sum(p) / max(k) AS q, max(m) AS m FROM
 (SELECT {own} AS id, side, avg(h) AS m, count(*) AS k FROM (SELECT DISTINCT pre, post FROM {edges}) d JOIN h ON h.id = {other} GROUP BY 1, 2) x JOIN (SELECT DISTINCT pre, post FROM {edges}) d ON d.{own} = x.id JOIN vec v ON v.id = d.{other} AND v.side = x.side GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""
_SD = f"""ds AS ({_OW.format(own='pre', other='post', edges='t')}), us AS ({_OW.format(own='post', other='pre', edges='t')}),
 sd AS (SELECT id, {', '.join(f"{x}.{s}_entropy AS {s}_entropy_{x}, {x}.{s}_ent_of_avg AS {s}_ent_of_avg_{x}, {x}.{s}_ent_of_avg - {x}.{s}_entropy AS {s}_diff_{x}" for x in ('ds', 'us') for s in ('in', 'out'))} FROM ds FULL JOIN us USING (id))"""
_VT = VEC.replace(E, T, 1)
_SDC = [f"{s}_{c}_{x}" for x in ("ds", "us") for s in ("in", "out") for c in ("entropy", "ent_of_avg", "diff")]


def spec_div(t: Tables) -> DataFrame:
    """Specialisation-diversity on the thresholded network, vectors from the whole one."""
    return vx.specialisation_diversity(net.sparse_edges(t), vx.vectors(net.nation_edges(t), net.region_annotation(t)))


@query("spec_div", f"WITH {_VT}, {H}, {_SD} SELECT id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SDC)} FROM sd")
def _(t):
    return rounded(spec_div(t), *_SDC)


@query("entropic_hubs", f"WITH {_VT}, {H}, {_SD} SELECT id, round(out_diff_ds + in_diff_us, 6) AS score FROM sd ORDER BY out_diff_ds + in_diff_us DESC NULLS LAST, id LIMIT 10")
def _(t):
    return rounded(vx.hubs(spec_div(t)), "score")


@query("spec_div_valid", f"WITH {VEC}, ok AS (SELECT id, side FROM vec GROUP BY 1, 2 HAVING abs(sum(p) - 1) < 1e-8) SELECT id, side, count(*) AS n FROM vec JOIN ok USING (id, side) GROUP BY 1, 2")
def _(t):
    v = vx.vectors(net.nation_edges(t), net.region_annotation(t))
    return v.groupBy("id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")).where("abs(s - 1) < 1e-8").drop("s")


@query("subsample_diversity")
def _(t):
    return dy.subsampled_diversity(net.order_segments(t), net.order_brands(t))


@query("balance_score", "WITH n AS (SELECT c_mktsegment AS cluster, l_returnflag AS roi, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT cluster, n, n / sum(n) OVER (PARTITION BY cluster) AS p FROM n) SELECT cluster, round(sum(-p * ln(p)), 6) AS entropy, round(sum(-p * ln(p)) / ln(3), 6) AS balance, round(exp(sum(-p * ln(p))), 6) AS div, round(stddev_pop(n), 4) AS std, max(n) - min(n) AS spread FROM p GROUP BY 1")
def _(t):
    n = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("cluster"), F.col("l_returnflag").alias("roi")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    h = F.sum(entropy_term(F.col("p")))
    return rounded(vx.normalised(n, ["cluster"], "n").groupBy("cluster").agg(h.alias("entropy"), (h / F.ln(F.lit(3.0))).alias("balance"), F.exp(h).alias("div"), F.round(F.stddev_pop("n"), 4).alias("std"), (F.max("n") - F.min("n")).alias("spread")), "entropy", "balance", "div")


_DELTA = "WITH a AS (SELECT c_custkey AS id, c_nationkey AS cluster, c_mktsegment AS type FROM customer UNION ALL SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN 'RICH' ELSE 'POOR' END FROM customer), p AS (SELECT id, cluster, type, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS p FROM a), n AS (SELECT cluster, count(DISTINCT id) AS k FROM p GROUP BY 1), q AS (SELECT cluster, type, sum(p) / max(k) AS q FROM p JOIN n USING (cluster) GROUP BY 1, 2), m AS (SELECT cluster, avg(h) AS m FROM (SELECT id, cluster, sum(-p * ln(p)) AS h FROM p GROUP BY 1, 2) GROUP BY 1) SELECT cluster, round(sum(-q * ln(q)) - max(m), 6) AS delta_s FROM q JOIN m USING (cluster) GROUP BY 1"


@query("delta_s_cluster", _DELTA)
def _(t):
    c = t.customer
    rich = F.when(F.col("c_acctbal") > 0, "RICH").otherwise("POOR")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"), F.explode(F.array("c_mktsegment", rich)).alias("type")).withColumn("one", F.lit(1.0))
    p = vx.normalised(a, ["id"], "one")
    h = p.groupBy("id", "cluster").agg(entropy(F.col("p")).alias("h")).groupBy("cluster").agg(F.avg("h").alias("m"), F.count(F.lit(1)).alias("k"))
    q = p.groupBy("cluster", "type").agg(F.sum("p").alias("s")).join(h, "cluster")
    return rounded(q.groupBy("cluster", "m").agg(entropy(F.col("s") / F.col("k")).alias("g")).select("cluster", (F.col("g") - F.col("m")).alias("delta_s")), "delta_s")


@query("class_order", f"WITH {_VT}, {H}, {_SD} SELECT type, round(avg(out_diff_ds - in_diff_us), 6) + 0.0 AS score FROM sd JOIN a USING (id) GROUP BY 1")
def _(t):
    j = spec_div(t).join(net.region_annotation(t), "id")
    return rounded(j.groupBy("type").agg(F.avg(F.col("out_diff_ds") - F.col("in_diff_us")).alias("score")), "score")


@query("top_m_partners", f"WITH {E}, {PARTNERS} SELECT ego, id, weight_pre, weight_post, total_weight, rn FROM r WHERE rn <= 5")
def _(t):
    return nb.top_partners(net.nation_edges(t), 5)


_MEM = "m AS (SELECT ego, id FROM r WHERE rn <= 5)"
_IND = "SELECT x.ego, pre, post, weight FROM e JOIN m x ON x.id = pre JOIN m y ON y.id = post AND y.ego = x.ego"


@query("induced_edges", f"WITH {E}, {PARTNERS}, {_MEM}, i AS ({_IND}) SELECT ego, pre, post, weight FROM (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY weight DESC, pre, post) AS k FROM i) WHERE k <= 8")
def _(t):
    e = net.nation_edges(t)
    return nb.induced(e, nb.top_partners(e, 5), 8)


@query("legacy_left_edges", f"WITH {T}, e2 AS (SELECT * FROM t), {PARTNERS.replace('FROM e', 'FROM e2').replace('GROUP BY 1, 2)', 'GROUP BY 1, 2 HAVING sum(wq) > 0)', 1)}, {_MEM} {_IND.replace('FROM e ', 'FROM e2 ')}")
def _(t):
    e = net.sparse_edges(t)
    return nb.induced(e, nb.top_partners(e, 5, legacy_left=True))


@query("ego_edges", f"WITH {E}, {PARTNERS}, m AS (SELECT ego, id FROM r WHERE rn <= 5 UNION SELECT ego, ego FROM r) {_IND}")
def _(t):
    e = net.nation_edges(t)
    return nb.induced(e, nb.with_ego(nb.top_partners(e, 5)))


@query("io_roles", f"WITH {T}, b AS (SELECT post AS ego, pre AS id, 1 AS i, 0 AS o FROM t UNION ALL SELECT pre, post, 0, 1 FROM t) SELECT ego, id, CASE WHEN max(i) = 1 AND max(o) = 1 THEN 'both' WHEN max(i) = 1 THEN 'in' ELSE 'out' END AS role FROM b GROUP BY 1, 2")
def _(t):
    return nb.roles(net.sparse_edges(t))


@query("neighbourhood_edges", f"WITH {T} SELECT pre, post, weight FROM t WHERE pre IN (1, 4, 9) OR post IN (1, 4, 9)")
def _(t):
    return nb.touching(net.sparse_edges(t), t.nation.where("n_nationkey in (1, 4, 9)").select(F.col("n_nationkey").alias("id")))


@query("one_hop_closure", f"WITH {T}, n AS (SELECT 4 AS id UNION SELECT post FROM t WHERE pre = 4 UNION SELECT pre FROM t WHERE post = 4) SELECT pre, post, weight FROM t WHERE pre IN (SELECT id FROM n) AND post IN (SELECT id FROM n)")
def _(t):
    e = net.sparse_edges(t)
    near = nb.touching(e, t.nation.where("n_nationkey = 4").select(F.col("n_nationkey").alias("id")))
    n = near.select(F.explode(F.array("pre", "post")).alias("id")).union(t.nation.where("n_nationkey = 4").select("n_nationkey")).distinct()
    return e.join(n.select(F.col("id").alias("pre")), "pre", "left_semi").join(n.select(F.col("id").alias("post")), "post", "left_semi").select("pre", "post", "weight")


@query("downstream", f"WITH {T} SELECT DISTINCT post AS id FROM t WHERE pre IN (2, 7)")
def _(t):
    return net.sparse_edges(t).where("pre in (2, 7)").select(F.col("post").alias("id")).distinct()


@query("cum_weight_coverage", f"WITH {E}, {PARTNERS}, c AS (SELECT ego, rn, sum(total_weight) OVER (PARTITION BY ego ORDER BY rn) AS c, sum(total_weight) OVER (PARTITION BY ego) AS t, count(*) OVER (PARTITION BY ego) AS n FROM r) SELECT ego, m, round(c / t, 6) AS frac FROM c JOIN (VALUES (3), (5), (10), (50)) v(m) ON rn = least(n, m)")
def _(t):
    return rounded(nb.coverage(net.nation_edges(t), [3, 5, 10, 50]), "frac")


@query("ego_size_stats", f"WITH {E}, {PARTNERS}, g AS (SELECT k.m, x.ego, count(*) AS n, sum(weight) AS w FROM (VALUES (3), (5), (10)) k(m) JOIN r x ON x.rn <= k.m JOIN r y ON y.ego = x.ego AND y.rn <= k.m JOIN e ON e.pre = x.id AND e.post = y.id GROUP BY 1, 2) SELECT m, round(avg(n), 6) AS mean_e, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem_e, round(avg(w), 4) AS mean_w, round(stddev_samp(w) / sqrt(count(*)), 4) AS sem_w FROM g GROUP BY 1")
def _(t):
    e, out = net.nation_edges(t), None
    for m in (3, 5, 10):
        g = nb.induced(e, nb.top_partners(e, m)).groupBy("ego").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
        sem = lambda c: F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))
        s = g.agg(F.lit(m).alias("m"), F.round(F.avg("n"), 6).alias("mean_e"), F.round(sem("n"), 6).alias("sem_e"), F.round(F.avg("w"), 4).alias("mean_w"), F.round(sem("w"), 4).alias("sem_w"))
        out = s if out is None else out.unionByName(s)
    return out


@query("strength_histogram", f"WITH {T} SELECT floor(log10(weight) * 10)::BIGINT AS bin, count(*) AS n FROM (SELECT pre, sum(weight) AS weight FROM t GROUP BY 1) GROUP BY 1")
def _(t):
    s = net.sparse_edges(t).groupBy("pre").agg(F.sum("weight").alias("w"))
    return s.groupBy(F.floor(F.log10("w") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_OVER = f"{E}, {PARTNERS}, {A}, m AS (SELECT ego, id FROM r WHERE rn <= 5), s AS (SELECT x.ego AS id_1, y.ego AS id_2, count(*) AS k FROM m x JOIN m y ON x.id = y.id AND x.ego < y.ego GROUP BY 1, 2), ty AS (SELECT ego, type, count(*) AS c FROM m JOIN a USING (id) GROUP BY 1, 2), lo AS (SELECT x.ego AS id_1, y.ego AS id_2, sum(least(x.c, y.c)) AS lo FROM ty x JOIN ty y ON x.type = y.type AND x.ego < y.ego GROUP BY 1, 2), sz AS (SELECT ego, count(*) AS n FROM m GROUP BY 1), o AS (SELECT x.ego AS id_1, y.ego AS id_2, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) AS node_overlap, round(coalesce(lo, 0) / (x.n + y.n - coalesce(lo, 0)), 6) AS ntype_overlap FROM sz x JOIN sz y ON x.ego < y.ego LEFT JOIN s ON s.id_1 = x.ego AND s.id_2 = y.ego LEFT JOIN lo ON lo.id_1 = x.ego AND lo.id_2 = y.ego)"


def _overlaps(t):
    e = net.nation_edges(t)
    return rounded(nb.overlap(nb.top_partners(e, 5).select("ego", "id"), net.region_annotation(t)), "node_overlap", "ntype_overlap")


@query("nhood_overlap", f"WITH {_OVER} SELECT * FROM o")
def _(t):
    return _overlaps(t)


@query("overlap_endpoints", f"WITH {_OVER}, f AS (SELECT * FROM o WHERE ntype_overlap > 0.5 AND node_overlap < 0.5) SELECT id_1 AS id FROM f UNION SELECT id_2 FROM f")
def _(t):
    f = _overlaps(t).where("ntype_overlap > 0.5 and node_overlap < 0.5")
    return f.select(F.explode(F.array("id_1", "id_2")).alias("id")).distinct()


@query("cluster_boundary", f"WITH {T}, c AS (SELECT * FROM (VALUES (0), (1), (2)) v(id)) SELECT id FROM (SELECT post AS id FROM t WHERE pre IN (SELECT id FROM c) UNION SELECT pre FROM t WHERE post IN (SELECT id FROM c)) WHERE id NOT IN (SELECT id FROM c)")
def _(t):
    c = t.nation.where("n_nationkey in (0, 1, 2)").select(F.col("n_nationkey").alias("id"))
    return nb.touching(net.sparse_edges(t), c).select(F.explode(F.array("pre", "post")).alias("id")).distinct().join(c, "id", "left_anti")


@query("cluster_edges", f"WITH {E}, c AS (SELECT * FROM e WHERE weight > 1) SELECT pre, post, round(4 * weight / max(weight) OVER (), 6) AS penwidth FROM c")
def _(t):
    c = net.nation_edges(t).where("weight > 1")
    top = c.agg(F.max("weight").alias("top"))
    return rounded(c.join(F.broadcast(top)).select("pre", "post", (4 * F.col("weight") / F.col("top")).alias("penwidth")), "penwidth")


@query("parse_ragged", "SELECT key, id, count(*) AS n FROM (SELECT f[1] AS key, unnest(f[2:]) AS id FROM (SELECT string_split(text, ' ') AS f FROM documents WHERE text NOT LIKE '@%')) WHERE id <> '' GROUP BY 1, 2")
def _(t):
    return tx.ragged(t.documents, "text", " ").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))


@query("parse_keyvalue", "SELECT p_partkey AS id, p_type AS tp, CAST(p_size AS VARCHAR) AS sz FROM part")
def _(t):
    s = t.part.select("p_partkey", F.concat(F.lit("TP="), "p_type", F.lit(",SZ="), "p_size").alias("s"))
    m = tx.key_values(F.col("s"))
    return s.select(F.col("p_partkey").alias("id"), m["TP"].alias("tp"), m["SZ"].alias("sz"))


@query("parse_regex_id", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '(\\d+)', 1) AS num FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"(\d+)", 1).alias("num"))


@query(
    "parse_fields",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
 f AS (SELECT doc_id, k, string_split(rtrim(line, chr(13)), ' ') AS f FROM l WHERE k >= 1) SELECT doc_id, k, f[-1] AS last, len(f) AS n FROM f""",
)
def _(t):
    """Every line of every text but the first, its header."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("pos >= 1")
    f = tx.fields(F.col("line"), " ", strip_blanks=False)
    return lines.select("doc_id", F.col("pos").cast("long").alias("k"), F.element_at(f, -1).alias("last"), F.size(f).cast("long").alias("n"))


@query("filtered_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity > 45")
def _(t):
    return t.lineitem.where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_partkey", "l_quantity")


@query("combined_files", "SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def _(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")))


@query("element_spans", "SELECT l_orderkey, l_linenumber, s AS start, s + l AS end FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l, coalesce(sum(l) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, sum(floor(l_quantity)::BIGINT)::BIGINT AS l FROM lineitem GROUP BY 1, 2)) WHERE l_returnflag <> 'N'".replace("AS end", 'AS "end"'))
def _(t):
    l = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.sum(F.floor("l_quantity")).alias("len"))  # noqa: E741
    return tx.spans_from_lengths(l, "l_orderkey", "l_linenumber", "l_returnflag", "len", "N").select("l_orderkey", "l_linenumber", "start", "end")


@query(
    "square_matrix",
    f"""WITH {T}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT pre AS id FROM t UNION SELECT post FROM t))
 SELECT a.k::INT AS i, b.k::INT AS j, 'N' || pre AS ss_ele, weight AS v FROM t JOIN ids a ON a.id = pre JOIN ids b ON b.id = post""",
)
def _(t):
    """The thresholded nation network written as a square table of text, and read back."""
    e = net.sparse_edges(t)
    ids = e.select(F.explode(F.array("pre", "post")).alias("id")).distinct()
    cells = ids.select(F.col("id").alias("pre")).join(ids.select(F.col("id").alias("post"))).join(e, ["pre", "post"], "left")
    cell = F.coalesce(F.col("weight").cast("string"), F.lit("-"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("post", cell.alias("c")))), lambda x: x["c"])
    body = cells.groupBy("pre").agg(F.concat(F.lit("N"), F.col("pre"), F.lit("\t"), F.array_join(row, "\t"), F.lit("\t")).alias("line"))
    head = ids.agg(F.concat(F.lit("ss\t"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(F.lit("N"), x)), "\t"), F.lit("\t")).alias("line"))
    return tx.square_matrix(head.select(F.lit(-1).alias("k"), "line").unionByName(body.select(F.col("pre").cast("int").alias("k"), "line")), "line", "k")
