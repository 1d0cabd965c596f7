"""The nearest node of each point (nearest-neighbour join) on grids of growing cells.

The first cells are small enough that those with nodes hold a few each, so dense places, where most nodes
may lie, cost no more than others; points of sparse places look again on larger cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.network import Network
from wayfold.operators.proximity import finite
from wayfold.operators.skew import hot_keys, repeat, spread
from wayfold.session import cut_lineage, forget

#: Nodes per cell that has any, at most, in the first round; halvings of an average cell tried for it.
NODES_PER_CELL, HALVINGS = 4, 16
#: How much wider cells get from round to round.
WIDER = 4


def _around(column, spread: int):
    return F.explode(F.sequence(column - spread, column + spread))


def _nearest_in_block(points: DataFrame, nodes: DataFrame, side: float) -> DataFrame:
    """Nearest node among the three by three cells around each point: exact if not farther than ``side``."""
    cell = lambda c: F.floor(F.col(c) / side)
    looking = points.withColumn("gx", _around(cell("_s_x"), 1)).withColumn("gy", _around(cell("_s_y"), 1))
    there = nodes.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    dx, dy = F.col("_s_x") - F.col("x"), F.col("_s_y") - F.col("y")
    keys = [F.col("gx"), F.col("gy")]
    hot = hot_keys(looking, keys)
    met = spread(looking, keys, hot, [F.col("_s_x"), F.col("_s_y")]).join(repeat(there, keys, hot), ["gx", "gy", "salt"])
    near = met.select("_s_x", "_s_y", (dx * dx + dy * dy).alias("d2"), "node_id")
    # min over a pair keeps one row per point within each task already
    return near.groupBy("_s_x", "_s_y").agg(F.min(F.struct("d2", "node_id")).alias("best")).select("_s_x", "_s_y", "best.d2", "best.node_id")


def nearest_node(network: Network, points: DataFrame, x: str = "x", y: str = "y", max_distance: float | None = None) -> DataFrame:
    """``points`` with ``node_id`` and ``distance`` of the nearest node, straight line, in the unit of x and y.

    Ties go to the smaller node id. Points with a null or NaN coordinate, or no node within ``max_distance`` (inclusive), are
    dropped. Points at one place are looked up once. Columns ``node_id`` and ``distance`` in ``points``
    raise; other extra columns are kept.

    A point is settled when the nearest node in its block of cells is no farther than a cell; the others,
    fewer each time, look again on wider cells. Of nodes at one place the smallest id stands for all. Nodes
    without finite coordinates are not considered.
    """
    if {"node_id", "distance"} & set(points.columns):
        raise ValueError("points already have a column node_id or distance")
    nodes = network.nodes_df.where(finite(F.col("x"), F.col("y")) & F.col("node_id").isNotNull())
    nodes = nodes.groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.min("node_id").alias("node_id"))
    box = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    px, py = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    usable = points.where(finite(px, py))
    open_ = usable.select((px + 0.0).alias("_s_x"), (py + 0.0).alias("_s_y")).distinct()
    settled = open_.select("_s_x", "_s_y", F.lit(0.0).alias("d2"), F.lit(None).cast(network.id_type).alias("node_id")).where("false")
    if box[4]:
        width, height = box[1] - box[0], box[3] - box[2]
        side = max(math.sqrt(max(width, 1e-9) * max(height, 1e-9) / box[4]), 1e-9)
        cells = nodes.agg(*[F.approx_count_distinct(F.struct(F.floor(F.col("x") / (side / 2**k)), F.floor(F.col("y") / (side / 2**k)))) for k in range(HALVINGS)]).first()
        side /= 2 ** next((k for k, n in enumerate(cells) if box[4] <= NODES_PER_CELL * n), HALVINGS - 1)
        most = math.inf if max_distance is None else max(max_distance, 1e-9)
        side = min(side, most)
        parts, extent = [], max(width, height)
        while True:
            best = cut_lineage(_nearest_in_block(open_, nodes, side))
            parts.append(best.where(F.col("d2") <= side * side))
            if side >= most:
                break
            left = cut_lineage(open_.join(parts[-1], ["_s_x", "_s_y"], "left_anti"))
            forget(open_)
            open_ = left
            if open_.isEmpty():
                break
            side = min(side * WIDER, most)
            if side > 2 * extent:  # beyond the nodes' own extent, the far points are few cells away only in cells of their distance
                far = open_.agg(F.max(F.greatest(F.abs(F.col("_s_x") - box[0]), F.abs(F.col("_s_x") - box[1]), F.abs(F.col("_s_y") - box[2]), F.abs(F.col("_s_y") - box[3])))).first()[0]
                side = min(max(side, 2 * far), most)
        for part in parts:
            settled = settled.unionByName(part)
    if max_distance is not None:
        settled = settled.where(F.sqrt("d2") <= max_distance)
    found = settled.select("_s_x", "_s_y", "node_id", F.sqrt("d2").alias("distance"))
    return usable.join(found, (px + 0.0 == F.col("_s_x")) & (py + 0.0 == F.col("_s_y"))).drop("_s_x", "_s_y")
