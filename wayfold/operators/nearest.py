"""The k nearest points of interest of every node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.units import radius_cost
from wayfold.operators.graph import Graph
from wayfold.operators.network import Network
from wayfold.operators.reach import broadcast_graph
from wayfold.operators.tiles import Tiling, on_curve


def nearest_pois(
    network: Network, pois: DataFrame, radius: float, k: int = 1, impedance: str | None = None, max_items: int | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """``(node_id, rank, distance, poi_id)``: for each node its ``k`` nearest points within ``radius``, rank from 1.

    ``pois`` has ``node_id`` and ``poi_id``; several points may share a node, and each row is a point. Distance
    is from the node to the point. Ties go to the smaller node of the point, then the smaller ``poi_id``. Points
    at unknown or null nodes are left out; nodes with no point in reach have no rows. ``k`` above
    ``max_items`` raises.

    The search runs backwards from all of a task's points at once, and no node keeps or passes on more than its
    k nearest, so the work follows nodes times k and not the points in reach. Per node the k smallest points
    are kept before the two are joined. ``strategy`` as in ``reach``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if max_items is not None and k > max_items:
        raise ValueError("k is larger than the number of points kept per node")
    placed = pois.select(F.col("node_id").alias("at"), "poi_id").where(F.col("at").isNotNull())
    nodes = _nearest_nodes(network, placed.select(F.col("at").alias("node_id")).distinct(), radius_cost(radius), k, impedance, strategy)
    # further points of a node come after k of the same node in every answer
    smallest = Window.partitionBy("at").orderBy("poi_id")
    points = placed.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k).drop("place")
    in_order = Window.partitionBy("node_id").orderBy("cost", "at", "poi_id")
    return (
        nodes.join(points, "at")
        .withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= k)
        .select("node_id", "rank", (F.col("cost") / 1000.0).alias("distance"), "poi_id")
    )


def _nearest_nodes(network: Network, places: DataFrame, limit: int, k: int, impedance: str | None, strategy: str) -> DataFrame:
    """``(node_id, at, cost)``: the k of ``places.node_id`` nearest to each node; of the broadcast graph more, by task."""
    kind = network.id_type
    out = pa.int64() if kind == "bigint" else pa.string()
    schema = f"node_id {kind}, at {kind}, cost bigint"

    def found(g: Graph, starts: np.ndarray, of: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        number = g.numbers(starts)
        node, place, cost = g.nearest(number[number >= 0], k, limit)
        node, place = g.ids[node], g.ids[place]
        alone = starts[number < 0]  # reached by themselves only
        node, place, cost = np.concatenate([node, alone]), np.concatenate([place, alone]), np.concatenate([cost, np.zeros(len(alone), np.int64)])
        if of is not None:
            mine = np.isin(node, of)
            node, place, cost = node[mine], place[mine], cost[mine]
        yield pa.RecordBatch.from_arrays([pa.array(node, out), pa.array(place, out), pa.array(cost, pa.int64())], names=["node_id", "at", "cost"])

    graph = broadcast_graph(network, impedance, True, strategy)
    known = network.node_ids.join(places, "node_id", "left_semi")
    if graph is None:
        # a home has all that its nodes reach, so that its answer is final; the search runs back over the same arcs
        def at_home(g: Graph, values: dict, sources: np.ndarray) -> Iterator[pa.RecordBatch]:
            src = np.repeat(np.arange(len(g.ids)), np.diff(g.head))
            back = Graph(g.ids[g.dst], g.ids[src], g.cost) if len(g.ids) else g
            yield from found(back, np.unique(values["a"]), sources)

        sources = network.node_ids.withColumnRenamed("node_id", "source")
        return Tiling.of(network, impedance, False).at_home(sources, limit, at_home, schema, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at most as many as the nodes of a graph that is broadcast
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if parts:
            yield from found(Graph.of(graph.value), np.concatenate(parts), None)

    # places that are near each other share a task, so that few nodes have labels in two
    tasks = network.spark.sparkContext.defaultParallelism
    placed = known.join(on_curve(network)[0], "node_id").repartitionByRange(tasks, "code").select("node_id")
    each = placed.mapInArrow(run, schema)
    closest = Window.partitionBy("node_id").orderBy("cost", "at")
    return each.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= k).drop("place")


def nearest_wide(
    network: Network, found: DataFrame, k: int, fill: float, include_poi_ids: bool = False
) -> DataFrame:
    """One row per node with columns ``1`` .. ``k`` and, if wanted, ``poi1`` .. ``poik``.

    ``found`` is from ``nearest_pois``; missing distances become ``fill``, missing points null.
    """
    def at(rank: int, what: str):
        return F.max(F.when(F.col("rank") == rank, F.col(what)))

    wide = found.groupBy("node_id").agg(
        *[at(r, "distance").alias(str(r)) for r in range(1, k + 1)],
        *([at(r, "poi_id").alias(f"poi{r}") for r in range(1, k + 1)] if include_poi_ids else []),
    )
    every = network.node_ids.join(wide, "node_id", "left")
    return every.select(
        "node_id",
        *[F.coalesce(F.col(f"`{r}`"), F.lit(float(fill))).alias(str(r)) for r in range(1, k + 1)],
        *([F.col(f"poi{r}") for r in range(1, k + 1)] if include_poi_ids else []),
    )
