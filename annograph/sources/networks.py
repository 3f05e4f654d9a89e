"""Networks, annotations and hierarchies made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one directory, read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _lines(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    return t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def nation_edges(t: Tables) -> DataFrame:
    """Supplier nation to customer nation, weighted by quantity.

    Lines are summed by supplier and customer first, so that the joins to the
    dimensions carry one row per pair.
    """
    pairs = _lines(t).groupBy("l_suppkey", "o_custkey").agg(F.sum("l_quantity").alias("w"))
    c, s = t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey")
    e = pairs.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return e.groupBy(F.col("s_nationkey").alias("pre"), F.col("c_nationkey").alias("post")).agg(F.sum("w").alias("weight"))


def sparse_edges(t: Tables, factor: float = 1.1) -> DataFrame:
    """Nation edges above ``factor`` times the mean weight, without loops."""
    e = nation_edges(t)
    mean = e.agg(F.avg("weight").alias("m"))  # one row
    return e.join(F.broadcast(mean), F.col("weight") > factor * F.col("m")).where("pre <> post").select("pre", "post", "weight")


def supplier_customer_edges(t: Tables) -> DataFrame:
    return _lines(t).groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("pre"), F.concat(F.lit("C"), F.col("o_custkey")).alias("post")).agg(F.sum("l_quantity").alias("weight"))


def region_annotation(t: Tables) -> DataFrame:
    n, r = t.nation, t.region
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("type"))


def customer_annotation(t: Tables) -> DataFrame:
    """Two labels per customer: market segment and nation."""
    c = t.customer
    key = F.concat(F.lit("C"), F.col("c_custkey")).alias("id")
    return c.select(key, F.col("c_mktsegment").alias("type")).unionAll(c.select(key, F.concat(F.lit("N"), F.col("c_nationkey")).alias("type")))


def order_brands(t: Tables) -> DataFrame:
    """Distinct (order, brand) pairs: recipes and their ingredients."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("r_id"), F.col("p_brand").alias("item")).distinct()


def order_segments(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("r_id"), F.col("c_mktsegment").alias("label"))


def dyadic_merges(spark: SparkSession, leaves: int = 16) -> DataFrame:
    """A dendrogram over leaves 0, 1, ...: (merge, left, right, dist, size).

    Level by level neighbours merge in pairs; a last one without a neighbour waits for the next level.
    """
    schema, rows, merge, level = "merge int, left int, right int, dist double, size int", [], leaves, 0
    front = [(leaf, 1) for leaf in range(leaves)]
    while len(front) > 1:
        level, above = level + 1, []
        for k in range(0, len(front) - 1, 2):
            (left, a), (right, b) = front[k], front[k + 1]
            rows.append((merge, left, right, float(level), a + b))
            above.append((merge, a + b))
            merge += 1
        front = above + front[len(front) // 2 * 2:]
    return spark.createDataFrame(rows, schema)
