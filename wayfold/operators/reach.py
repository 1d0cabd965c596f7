"""The relation all accessibility queries rest on: ``reach(source, destination, cost)``.

Bounded shortest paths from many sources at once. Two strategies give the same rows:

* ``tiles``: for graphs of any size. The graph is cut into tiles; each is sent the part around it that it can
  reach, and its sources are searched there (see ``operators.tiles``).
* ``arrow``: for graphs whose arcs are counted and found to fit a broadcast, which spares the tiles' shuffles.
  Sources are spread over tasks, each relaxes the labels of a block of sources.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.units import radius_cost
from wayfold.operators.graph import UNBOUNDED, Graph
from wayfold.operators.network import Network
from wayfold.operators.tiles import Tiling

#: Arcs up to which the graph is broadcast (16 bytes each in compressed rows).
BROADCAST_ARCS = 4_000_000
#: Bytes of a row when a graph is sent to the driver.
PIECE = 4_000_000
STRATEGIES = ("auto", "arrow", "tiles")


def broadcast_graph(network: Network, impedance: str | None, reverse: bool = False, strategy: str = "auto"):
    """The graph as a broadcast variable if its arcs are few enough and the strategy allows, else None; kept with the network."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "tiles":
        return None
    name = network.impedance(impedance)
    if (name, reverse) not in network.graphs:
        arcs = network.arcs(name).persist()
        graph = None
        if arcs.count() <= BROADCAST_ARCS:
            graph = network.spark.sparkContext.broadcast(_built(arcs, reverse, network.id_type))
        arcs.unpersist()
        network.graphs[name, reverse] = graph
    if network.graphs[name, reverse] is None and strategy == "arrow":
        raise ValueError(f"the graph has more than {BROADCAST_ARCS} arcs")
    return network.graphs[name, reverse]


def _built(arcs: DataFrame, reverse: bool, kind: str) -> dict[str, np.ndarray]:
    """The arrays of the graph, made by one task: building takes several times their memory, which the driver is spared."""
    start, end = ("dst", "src") if reverse else ("src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        local = pa.Table.from_batches(held)
        del held
        graph = Graph(*(local.column(c).to_numpy() for c in (start, end, "cost")))
        if len(graph.cost) and graph.cost.max() < 2**31:
            graph.cost = graph.cost.astype(np.int32)
        whole = pickle.dumps(graph.__dict__, protocol=5)
        for k in range(0, len(whole), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([whole[k : k + PIECE]], pa.binary())], names=["at", "piece"])

    pieces = arcs.repartition(1).mapInArrow(run, "at bigint, piece binary").toArrow().sort_by("at").column("piece")
    if not len(pieces):
        none = np.empty(0, np.int64 if kind == "bigint" else object)
        return Graph(none, none, np.empty(0, np.int64)).__dict__
    return pickle.loads(b"".join(p.as_buffer() for p in pieces))


def _reached(kind: str, limit: int) -> Callable:
    out = pa.int64() if kind == "bigint" else pa.string()

    def work(graph: Graph, _values: dict, every: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(every), graph.block):
            ids = every[k : k + graph.block]
            number = graph.numbers(ids)
            lone = ids[number < 0]
            start, starts = ids[number >= 0], number[number >= 0]
            which, node, cost = graph.search(starts, limit)
            columns = (
                np.concatenate([lone, start[which]]), np.concatenate([lone, graph.ids[node] if len(node) else start[which]]),
                np.concatenate([np.zeros(len(lone), np.int64), cost]),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], out), pa.array(columns[1], out), pa.array(columns[2], pa.int64())],
                names=["source", "destination", "cost"],
            )

    return work


def for_each_source(
    network: Network, sources: DataFrame, limit: int, work: Callable, schema: str, graph, impedance: str | None = None,
    reverse: bool = False, values: DataFrame | None = None, held=None,
) -> DataFrame:
    """``work(graph, values, sources)`` in tasks that hold a graph for their ``sources.source``.

    With ``graph`` and ``held`` (broadcast variables) it is the whole graph and the whole values, else that of a tile.
    """
    if graph is None:
        return Tiling.of(network, impedance, reverse).at_home(sources, limit, work, schema, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, v = Graph.of(graph.value), {} if held is None else held.value
        for batch in batches:
            yield from work(g, v, batch.column(0).to_numpy(zero_copy_only=False))

    # one exchange spreads the sources, as a table of ids may be a single small file
    return sources.repartition(network.spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def reach(
    network: Network, radius: float | None, impedance: str | None = None, sources: DataFrame | None = None,
    strategy: str = "auto", reverse: bool = False,
) -> DataFrame:
    """``(source, destination, cost)`` for all destinations within ``radius``, itself (at 0) included.

    ``sources`` has ``node_id``; the default is every node. Unknown and null ids are dropped, repeated ones
    count once. ``radius`` None searches without bound. ``reverse`` follows arcs backwards, so that cost is
    that from destination to source. ``cost`` is in thousandths of the impedance.
    """
    limit = UNBOUNDED if radius is None else radius_cost(radius)
    ids = network.node_ids
    if sources is not None:
        ids = ids.join(sources.select("node_id").distinct(), "node_id", "left_semi")
    graph = broadcast_graph(network, impedance, reverse, strategy)
    kind = network.id_type
    return for_each_source(
        network, ids.withColumnRenamed("node_id", "source"), limit, _reached(kind, limit), f"source {kind}, destination {kind}, cost bigint", graph, impedance, reverse
    )


class ReachCache:
    """Reach relations that were computed ahead; a query takes the smallest radius that covers its own."""

    def __init__(self, network: Network):
        self.network = network
        self._held: dict[str, dict[int, DataFrame]] = {}

    def precompute(self, radius: float, impedances: list[str] | None = None) -> None:
        """Compute and persist reach for every node; a second call for a radius replaces the first."""
        for name in impedances or self.network.impedance_names:
            held = self._held.setdefault(name, {})
            if (old := held.pop(radius_cost(radius), None)) is not None:
                old.unpersist()
            held[radius_cost(radius)] = reach(self.network, radius, name).persist()

    def covering(self, radius: float, impedance: str | None = None) -> DataFrame | None:
        """What was computed ahead for at least ``radius``, cut to it; None if nothing was."""
        name, limit = self.network.impedance(impedance), radius_cost(radius)
        fitting = [r for r in self._held.get(name, {}) if r >= limit]
        return self._held[name][min(fitting)].where(F.col("cost") <= limit) if fitting else None

    def reach(self, radius: float, impedance: str | None = None, sources: DataFrame | None = None) -> DataFrame:
        """Reach of every node; if it has to be computed, of ``sources.source`` only, where given."""
        if (held := self.covering(radius, impedance)) is not None:
            return held
        asked = None if sources is None else sources.select(F.col("source").alias("node_id"))
        return reach(self.network, radius, impedance, asked)

    def clear(self) -> None:
        for held in self._held.values():
            for df in held.values():
                df.unpersist()
        self._held.clear()


def nodes_in_range(network: Network, sources: DataFrame, radius: float, impedance: str | None = None) -> DataFrame:
    """``(source, destination, distance)`` within ``radius`` of each of ``sources.node_id``."""
    return reach(network, radius, impedance, sources).select("source", "destination", (F.col("cost") / 1000.0).alias("distance"))
