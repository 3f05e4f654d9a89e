"""Readers for the text layouts of annotated-network data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def indexed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose first, unnamed column is a row index: dropped."""
    return spark.read.csv(path, header=True, schema=f"_index string, {schema}").drop("_index")


def headerless(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names))


def without_head(lines: DataFrame, skip: int, order: str) -> DataFrame:
    """Lines after the first ``skip``, by the column ``order``."""
    head = lines.orderBy(order).limit(skip).select(F.max(order).alias("_last"))
    return lines.join(F.broadcast(head), F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def fields(line: Column, sep: str = r"\s+", strip_blanks: bool = True) -> Column:
    """Fields of a line split at a pattern, line ends (and blanks before them) stripped."""
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    return F.split(F.rtrim(bare) if strip_blanks else bare, sep)


def ragged(lines: DataFrame, line: str, sep: str = "\t", comment: str = "@") -> DataFrame:
    """``key sep id sep id ...`` to (key, id) pairs; lines that start with ``comment`` are left out."""
    f = F.split(F.col(line), sep, 2)
    kept = lines.where(~F.col(line).startswith(comment)).select(f[0].alias("key"), F.get(f, F.lit(1)).alias("rest"))  # once a line, not once an id
    return kept.select("key", F.explode_outer(F.split("rest", sep)).alias("id")).where("id <> ''")


def key_values(text: Column, pairs: str = ",", sep: str = "=") -> Column:
    """``TP=1,CL=2`` as a map."""
    return F.str_to_map(text, F.lit(pairs), F.lit(sep))


def square_matrix(lines: DataFrame, line: str, order: str, sep: str = "\t", none: str = "-") -> DataFrame:
    """A square table with a header of element names, in long form (i, j, ss_ele, v).

    The trailing empty column is dropped and cells of ``none`` (no contact) are absent.
    """
    numbered = lines.select(F.split(F.col(line), sep).alias("f"), (F.row_number().over(_by(order)) - 1).alias("i"))
    body = numbered.where("i > 0").select((F.col("i") - 1).alias("i"), F.element_at("f", 1).alias("ss_ele"), F.posexplode(F.slice("f", 2, F.size("f") - 1)).alias("j", "c"))
    return body.where((F.col("c") != none) & (F.trim("c") != "")).select("i", "j", "ss_ele", F.col("c").cast("double").alias("v"))


def _by(order: str):
    from pyspark.sql import Window

    return Window.orderBy(order)


def spans_from_lengths(df: DataFrame, key: str, pos: str, kind: str, length: str, drop: str = "T") -> DataFrame:
    """Start and end of each structure element from its length; elements of kind ``drop`` only count."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(w), F.lit(0))
    return df.withColumn("start", start).withColumn("end", F.col("start") + F.col(length)).where(F.col(kind) != drop)
