"""Extension: events that stream in, added up over what is within reach of each node.

The reach relation is static; events meet it in a stream-static join and are summed per node and window,
with a watermark for late ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.decay import Decay, decay_weight
from wayfold.functions.units import from_cost


def windowed_reach_sum(
    events: DataFrame, reached: DataFrame, radius: float, window: str, late: str, decay: Decay = "flat"
) -> DataFrame:
    """``(source, window_start, events, value)`` from streaming ``events(node_id, ts, value)``.

    Events with a null node, time or value are dropped; those later than the watermark ``late`` too.
    """
    usable = events.where(F.col("node_id").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull())
    weight = decay_weight(decay, from_cost(F.col("cost")), F.lit(float(radius)))
    return (
        usable.withWatermark("ts", late)
        .join(reached.withColumnRenamed("destination", "node_id"), "node_id")
        .groupBy("source", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value") * weight).alias("value"))
        .select("source", F.col("w.start").alias("window_start"), "events", "value")
    )
