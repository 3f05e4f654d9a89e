"""An extension: edges from an event stream, summed in windows.

Consecutive events of a user are transitions only in batch; on a stream, each
event is an edge from its user to its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, pre, post, weight) per tumbling window; later events than ``late`` are left out."""
    w = F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w, F.col("user_id").alias("pre"), F.col("event_type").alias("post")).agg(F.count(F.lit(1)).alias("weight"))
    return g.select(F.col("window.start").alias("start"), "pre", "post", "weight")
