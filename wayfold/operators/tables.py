"""Small relational helpers around networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.network import Network
from wayfold.session import cut_lineage


def reindex(values: DataFrame, keys: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``keys`` with the ``value`` found for their ``key`` in ``values``, null where there is none."""
    return keys.join(values.select(F.col(key), F.col(value)), key, "left")


def node_index(network: Network) -> DataFrame:
    """``(node_id, node_idx)``: dense numbers from 0 in the order of ids, without a single-task sort.

    Ids are range-sorted; the rows of the partitions before it are a partition's offset.
    """
    ranged = network.node_ids.repartitionByRange(F.col("node_id")).sortWithinPartitions("node_id")
    # the number within the partition fills the low 33 bits, the partition the rest
    numbered = cut_lineage(ranged.select("node_id", F.monotonically_increasing_id().alias("mark"))).select(
        "node_id", F.shiftright("mark", 33).alias("part"), F.col("mark").bitwiseAND(2**33 - 1).alias("within")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return numbered.join(F.broadcast(offsets), "part").select("node_id", (F.col("offset") + F.col("within")).alias("node_idx"))


def resolve_ids(network: Network, rows: DataFrame, column: str = "node_id") -> DataFrame:
    """``rows`` with the ``node_idx`` of their ``column``; null for unknown and null ids."""
    index = node_index(network).withColumnRenamed("node_id", "_t_id")
    return rows.join(index, F.col(f"`{column}`") == F.col("_t_id"), "left").drop("_t_id")


def adjacency_counts(edges: DataFrame) -> DataFrame:
    """``(from, to, n)``: the number of edges for each pair that has any; the long form of the square matrix."""
    return edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def adjacency_matrix(edges: DataFrame, max_nodes: int = 5000) -> DataFrame:
    """One row and one column per node of any edge, in order, with the number of edges; 0 where there are none.

    A column per node suits small graphs only: more than ``max_nodes`` raise, use ``adjacency_counts`` then.
    """
    ends = edges.select(F.explode(F.array("from", "to")).alias("node")).where(F.col("node").isNotNull()).distinct()
    labels = [r[0] for r in ends.orderBy("node").limit(max_nodes + 1).collect()]
    if len(labels) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    counts = edges.groupBy(F.col("from").alias("node")).pivot("to", labels).count()
    return ends.join(counts, "node", "left").fillna(0).orderBy("node")


def plot_data(network: Network, values: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(node_id, x, y, value)`` for drawing, within ``bbox`` (xmin, ymin, xmax, ymax) if given."""
    rows = network.nodes_df.join(values.select("node_id", "value"), "node_id")
    if bbox is not None:
        rows = rows.where(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    return rows


def binned(points: DataFrame, side: float, kind: str = "mean") -> DataFrame:
    """``(bx, by, value, n)``: ``kind`` (mean, sum, min, max) of ``value`` over square bins of ``side``."""
    how = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[kind]
    return points.groupBy(F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")).agg(
        how("value").alias("value"), F.count(F.lit(1)).alias("n")
    )
