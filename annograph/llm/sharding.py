"""Weighted rendezvous sharding, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Groups of records within a shard among which slots are dealt out. The table
#: of their counts has at most shards * SLOT_GROUPS rows at any input size.
SLOT_GROUPS = 4096


def rendezvous(key: Column, weights: Sequence[float], salt: int = 0x5EED) -> Column:
    """The shard with the highest score -weight / ln(u(key, shard)).

    ``u`` is a hash in (0, 1). Each shard's score depends on the key and that
    shard alone, so a further shard takes keys only into itself, and a weight's
    share of the keys is its share of the sum. Shards of weight 0 get nothing.
    Equal scores go to the higher shard number. A null key is a key like any other.
    """
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(salt)), 11).cast("double")
        u = (bits + 0.5) / float(1 << 53)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    if not scores:
        raise ValueError("no shard has a weight")
    return F.array_max(F.array(*scores))["shard"]


def sharded(records: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``records`` with the shard of each; equal keys share one."""
    return records.withColumn(out, rendezvous(F.col(key), weights))


def with_slots(records: DataFrame, shard: str, key: str, out: str = "slot") -> DataFrame:
    """Numbers 0, 1, ... within each shard, in the order of the key's hash.

    Repeated rows are summed up before the shuffle, and a shard is dealt out in
    ``SLOT_GROUPS`` groups whose counts give each group's first number; so no
    task holds a whole shard and no key's copies meet uncombined. The summed rows
    are written once and read twice. All columns of
    ``records`` must be orderable. Rows that are equal get consecutive numbers.
    """
    columns = [F.col(c) for c in records.columns]
    group = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(SLOT_GROUPS))
    rows = materialise(records.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", group), "shard_rows")
    counts = rows.groupBy(F.col(shard).alias("_s"), F.col("_group").alias("_g")).agg(F.sum("_n").alias("_sum"))
    from pyspark.sql import Window

    before = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_s", "_g", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(shard, "_group").orderBy(F.xxhash64(F.col(key)), *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_low", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    # at most shards * SLOT_GROUPS rows of three numbers, whatever the input
    placed = placed.join(F.broadcast(first), (F.col(shard) == F.col("_s")) & (F.col("_group") == F.col("_g")))
    low = F.col("_first") + F.col("_low")
    return placed.select(*columns, F.explode(F.sequence(low, low + F.col("_n") - 1)).alias(out))


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Shards 0..shards-1 for all documents by the law ``key``.

    doc_id and the shard count decide. A null doc_id is one key; a null text has
    no bytes and the checksum of an empty one; an empty table gives no rows;
    repeated rows get a slot each; further columns are not read.
    """
    text = text_or_empty()
    keyed = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    keyed = sharded(keyed, "doc_id", [1.0] * shards)
    keyed = sharded(keyed, "doc_id", [1.0] * (shards + 1), "grown_shard")
    return with_slots(keyed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
