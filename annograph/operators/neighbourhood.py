"""Top-weighted neighbourhoods, ego networks and their overlaps, for all egos at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partners(edges: DataFrame, legacy_left: bool = False) -> DataFrame:
    """(ego, id, weight_pre, weight_post, total_weight): weight from and to each partner.

    With ``legacy_left`` only targets of the ego are partners.
    """
    side = lambda own, other, pre, post: edges.select(F.col(own).alias("ego"), F.col(other).alias("id"), pre.alias("weight_pre"), post.alias("weight_post"))
    zero, w = F.lit(0.0), F.col("weight")
    both = side("post", "pre", w, zero).unionAll(side("pre", "post", zero, w))
    g = both.groupBy("ego", "id").agg(F.sum("weight_pre").alias("weight_pre"), F.sum("weight_post").alias("weight_post"))
    return (g.where("weight_post > 0") if legacy_left else g).withColumn("total_weight", F.col("weight_pre") + F.col("weight_post"))


def top_partners(edges: DataFrame, m: int | None, legacy_left: bool = False) -> DataFrame:
    """The m partners of highest weight of every ego; ties go to the smaller id."""
    w = Window.partitionBy("ego").orderBy(F.desc("total_weight"), "id")
    p = partners(edges, legacy_left).withColumn("rn", F.row_number().over(w).cast("long"))
    return p if m is None else p.where(F.col("rn") <= m)


def induced(edges: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """(ego, pre, post, weight): edges between members of each ego, the n heaviest."""
    a, b = members.select("ego", F.col("id").alias("pre")), members.select(F.col("ego").alias("_e"), F.col("id").alias("_p"))
    e = edges.join(a, "pre").join(b, (F.col("ego") == F.col("_e")) & (F.col("post") == F.col("_p"))).select("ego", "pre", "post", "weight")
    if n is None:
        return e
    w = Window.partitionBy("ego").orderBy(F.desc("weight"), "pre", "post")
    return e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_ego(members: DataFrame) -> DataFrame:
    ids = members.select("ego", "id")
    return ids.unionAll(ids.select("ego", F.col("ego").alias("id"))).distinct()


def roles(edges: DataFrame) -> DataFrame:
    """(ego, id, role): whether a neighbour is a source, a target or both."""
    both = edges.select(F.col("post").alias("ego"), F.col("pre").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(
        edges.select(F.col("pre").alias("ego"), F.col("post").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    g = both.groupBy("ego", "id").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    return g.select("ego", "id", F.when((F.col("i") == 1) & (F.col("o") == 1), "both").when(F.col("i") == 1, "in").otherwise("out").alias("role"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """All edges that start or end in ``ids`` (column id)."""
    a = edges.join(ids.select(F.col("id").alias("pre")), "pre", "left_semi")
    b = edges.join(ids.select(F.col("id").alias("post")), "post", "left_semi")
    return a.select("pre", "post", "weight").union(b.select("pre", "post", "weight")).distinct()


def coverage(edges: DataFrame, sizes: list[int]) -> DataFrame:
    """(ego, m, frac): share of an ego's partner weight in its m heaviest partners."""
    p = top_partners(edges, None)
    run = Window.partitionBy("ego").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("ego")
    c = p.select("ego", "rn", F.sum("total_weight").over(run).alias("c"), F.sum("total_weight").over(every).alias("t"), F.count(F.lit(1)).over(every).alias("n"))
    m = edges.sparkSession.createDataFrame([(x,) for x in sizes], "m int")
    return c.join(F.broadcast(m), F.col("rn") == F.least("n", "m")).select("ego", "m", (F.col("c") / F.col("t")).alias("frac"))


def overlap(members: DataFrame, meta: DataFrame) -> DataFrame:
    """(id_1, id_2, node_overlap, ntype_overlap): Jaccard of members and of their type multisets."""
    x, y = members.select(F.col("ego").alias("id_1"), "id"), members.select(F.col("ego").alias("id_2"), "id")
    size = members.groupBy("ego").agg(F.count(F.lit(1)).alias("n"))
    egos = size.select(F.col("ego").alias("id_1"), F.col("n").alias("n1")).join(size.select(F.col("ego").alias("id_2"), F.col("n").alias("n2")), F.col("id_1") < F.col("id_2"))
    both = x.join(y, "id").where("id_1 < id_2").groupBy("id_1", "id_2").agg(F.count(F.lit(1)).alias("k"))
    types = members.join(meta, "id").groupBy("ego", "type").agg(F.count(F.lit(1)).alias("c"))
    least = types.select(F.col("ego").alias("id_1"), "type", F.col("c").alias("c1")).join(types.select(F.col("ego").alias("id_2"), "type", F.col("c").alias("c2")), "type").where("id_1 < id_2")
    low = least.groupBy("id_1", "id_2").agg(F.sum(F.least("c1", "c2")).alias("lo"))
    total = types.groupBy("ego").agg(F.sum("c").alias("t"))
    j = egos.join(both, ["id_1", "id_2"], "left").join(low, ["id_1", "id_2"], "left")
    j = j.join(total.select(F.col("ego").alias("id_1"), F.col("t").alias("t1")), "id_1").join(total.select(F.col("ego").alias("id_2"), F.col("t").alias("t2")), "id_2")
    k, lo = F.coalesce("k", F.lit(0)), F.coalesce("lo", F.lit(0))
    return j.select("id_1", "id_2", (k / (F.col("n1") + F.col("n2") - k)).alias("node_overlap"), (lo / (F.col("t1") + F.col("t2") - lo)).alias("ntype_overlap"))
