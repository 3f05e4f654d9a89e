"""Annotation vectors, entropies and specialisation-diversity, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annograph.functions.columns import entropy


def collapse(edges: DataFrame) -> DataFrame:
    """One row per (pre, post), weights summed."""
    return edges.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, summed: the undirected network (loops count twice)."""
    return collapse(edges.select("pre", "post", "weight").unionAll(edges.select(F.col("post").alias("pre"), F.col("pre").alias("post"), "weight")))


def normalised(df: DataFrame, keys: list[str], value: str, out: str = "p") -> DataFrame:
    """``value`` over its sum by ``keys``; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(total != 0, F.col(value) / total).otherwise(F.lit(0.0)))


def raw_vectors(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, side, category, value): partners' annotation mass by side.

    ``out`` sums over the annotations of a node's targets, ``in`` of its
    sources; a partner with k labels counts k times.
    """
    m = meta.groupBy("id", F.col("type").alias("category")).agg(F.sum(F.col("weight") if "weight" in meta.columns else F.lit(1.0)).alias("b"))
    sides = []
    for side, own, other in (("out", "pre", "post"), ("in", "post", "pre")):
        j = edges.join(m.withColumnRenamed("id", other), other)
        sides.append(j.groupBy(F.col(own).alias("id"), F.lit(side).alias("side"), "category").agg(F.sum(F.col("weight") * F.col("b")).alias("value")))
    return sides[0].unionAll(sides[1])


def vectors(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, side, category, p): normalised annotation vectors; zeros are not stored."""
    return normalised(raw_vectors(edges, meta), ["id", "side"], "value").drop("value")


def filled(vec: DataFrame, meta: DataFrame, policy: str, value: str = "p") -> DataFrame:
    """Vectors with a row for every (id, side, category), by null policy.

    zero: a side without annotated partners is 0; null: it is null; tiny: every
    missing value is 1e-10. Where a side has partners, absent categories are 0.
    """
    ids = vec.select("id").distinct()
    sides = vec.sparkSession.createDataFrame([("in",), ("out",)], "side string")
    grid = ids.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(meta.select(F.col("type").alias("category")).distinct()))
    j = grid.join(vec, ["id", "side", "category"], "left")
    some = F.count(value).over(Window.partitionBy("id", "side")) > 0
    if policy == "tiny":
        return j.withColumn(value, F.coalesce(value, F.lit(1e-10)))
    zero = F.coalesce(F.col(value), F.lit(0.0))
    return j.withColumn(value, zero if policy == "zero" else F.when(some, zero))


def two_hop(labels: DataFrame, items: DataFrame, standardised: bool = False) -> DataFrame:
    """(category, item, v): labels in item space through shared recipes.

    Standardised, counts are first divided by the label's recipes and rows are
    items in label space.
    """
    counts = labels.join(items, "r_id").groupBy(F.col("label").alias("category"), "item").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if not standardised:
        return normalised(counts, ["category"], "n", "v").drop("n")
    size = labels.groupBy(F.col("label").alias("category")).agg(F.count(F.lit(1)).alias("m"))
    return normalised(counts.join(size, "category").withColumn("n", F.col("n") / F.col("m")), ["item"], "n", "v").drop("n", "m")


def co_membership(pairs: DataFrame, group: str, label: str) -> DataFrame:
    """Shared groups of two labels over all groups of the second."""
    a, b = pairs.select(group, F.col(label).alias("a")), pairs.select(group, F.col(label).alias("b"))
    n = a.join(b, group).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = n.where("a = b").select("b", F.col("n").alias("d"))
    return n.join(own, "b").select("a", "b", (F.col("n") / F.col("d")).alias("v"))


def side_entropy(vec: DataFrame, delta: float = 1e-8, empty: str = "all_null") -> DataFrame:
    """(id, in_entropy, out_entropy)"""
    h = vec.groupBy("id", "side").agg(entropy(F.col("p"), delta, empty).alias("h"))
    return h.groupBy("id").agg(F.max(F.when(F.col("side") == "in", F.col("h"))).alias("in_entropy"), F.max(F.when(F.col("side") == "out", F.col("h"))).alias("out_entropy"))


def one_way_diversity(edges: DataFrame, vec: DataFrame, own: str, partner: str) -> DataFrame:
    """Per node: mean entropy of its distinct partners, entropy of their mean
    vector, and the difference, for either side of the partners' vectors.
    """
    pairs = edges.select(F.col(own).alias("id"), F.col(partner).alias("j")).distinct()
    h = vec.groupBy("id", "side").agg(entropy(F.col("p")).alias("h")).withColumnRenamed("id", "j")
    mean_h = pairs.join(h, "j").groupBy("id", "side").agg(F.avg("h").alias("avg_h"), F.count(F.lit(1)).alias("k"))
    p = pairs.join(vec.withColumnRenamed("id", "j"), "j").groupBy("id", "side", "category").agg(F.sum("p").alias("s"))
    mixed = p.join(mean_h.select("id", "side", "k"), ["id", "side"]).groupBy("id", "side").agg(entropy(F.col("s") / F.col("k")).alias("h_avg"))
    both = mean_h.join(mixed, ["id", "side"])
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = []
    for side in ("in", "out"):
        out += [pick(side, "avg_h").alias(f"{side}_entropy"), pick(side, "h_avg").alias(f"{side}_ent_of_avg")]
    g = both.groupBy("id").agg(*out)
    return g.withColumn("in_diff", F.col("in_ent_of_avg") - F.col("in_entropy")).withColumn("out_diff", F.col("out_ent_of_avg") - F.col("out_entropy"))


def specialisation_diversity(edges: DataFrame, vec: DataFrame) -> DataFrame:
    """Downstream (_ds) and upstream (_us) diversity of every node, outer-joined."""
    ds = one_way_diversity(edges, vec, "pre", "post")
    us = one_way_diversity(edges, vec, "post", "pre")
    named = lambda df, s: df.select("id", *(F.col(c).alias(c + s) for c in df.columns if c != "id"))
    return named(ds, "_ds").join(named(us, "_us"), "id", "full")


def hubs(diversity: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest distributive plus integrative diversity."""
    s = diversity.select("id", (F.col("out_diff_ds") + F.col("in_diff_us")).alias("score"))
    return s.orderBy(F.desc_nulls_last("score"), "id").limit(k)


def partner_diversity(edges: DataFrame, vec: DataFrame) -> DataFrame:
    """(id, way, side, ent_of_avg, entropy) over partners downstream (ds) and upstream (us).

    The matrix form: only partners whose vector adds up to 1 count, entropies
    have no threshold, and a node whose partners have no such vector has nulls.
    """
    ok = vec.groupBy("id", "side").agg(F.sum("p").alias("_s"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("_h")).where(F.abs(F.col("_s") - 1) < 1e-8)
    way = edges.select(F.col("pre").alias("id"), F.col("post").alias("_o"), F.lit("ds").alias("way")).unionAll(edges.select("post", "pre", F.lit("us"))).distinct()
    partner = way.join(ok.select(F.col("id").alias("_o"), "side", "_h"), "_o")
    mean = partner.groupBy("id", "way", "side").agg(F.avg("_h").alias("entropy"), F.count(F.lit(1)).alias("_k"))
    values = partner.join(vec.select(F.col("id").alias("_o"), "side", "category", "p"), ["_o", "side"])
    share = values.groupBy("id", "way", "side", "category").agg(F.sum("p").alias("_p")).join(mean.select("id", "way", "side", "_k"), ["id", "way", "side"]).withColumn("_q", F.col("_p") / F.col("_k"))
    whole = share.groupBy("id", "way", "side").agg(F.sum(F.when(F.col("_q") > 0, -F.col("_q") * F.ln("_q")).otherwise(0.0)).alias("ent_of_avg"))
    both = mean.join(whole, ["id", "way", "side"])
    return way.select("id", "way").distinct().join(both, ["id", "way"], "left").select("id", "way", "side", "ent_of_avg", "entropy")
