"""Lengths and routes between pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.graph import UNBOUNDED, Graph, _repeated
from wayfold.operators.network import Network
from wayfold.operators.reach import broadcast_graph
from wayfold.operators.tiles import Tiling
from wayfold.session import cut_lineage, forget

#: What a missing length is where a number is needed.
UNREACHABLE = 4294967.295
#: Origins that a task searches together: in parts of the graph up to ``SWEPT`` nodes, and in larger ones.
SWEPT_ORIGINS, ORIGINS = 512, 128
SWEPT = 4_096
#: Over tiles: arcs of mean cost within the first limit of a search, and how much higher the next is.
FIRST_ARCS, FURTHER = 8, 2
#: Pairs that a task takes at a time.
PAIRS = 200_000


def _pairs(network: Network, pairs: DataFrame) -> DataFrame:
    known = network.node_ids
    return (
        pairs.select("origin", "destination").distinct()
        .join(known.withColumnRenamed("node_id", "origin"), "origin", "left_semi")
        .join(known.withColumnRenamed("node_id", "destination"), "destination", "left_semi")
    )


def _costs(g: Graph, origins: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """For blocks of ``origins``: the positions of their pairs, and the labels as (function of node and origin in block, first origin).

    ``owner`` and ``ends`` are the origin's position and the destination of each pair, by ascending owner.
    """
    small = len(g.ids) <= SWEPT
    step = SWEPT_ORIGINS if small else min(ORIGINS, g.block)
    for k in range(0, len(origins), step):
        starts = origins[k : k + step]
        mine = np.arange(*np.searchsorted(owner, [k, k + len(starts)]))
        if small:
            labels = g.all_costs(starts)
            yield mine, k, lambda node, of, labels=labels: labels[node, of]
        else:
            bounds = np.searchsorted(owner[mine], np.arange(k, k + len(starts) + 1))
            targets = {p: ends[mine[bounds[p] : bounds[p + 1]]] for p in range(len(starts))}
            which, node, found = g.search(starts, UNBOUNDED, targets)
            key = which * len(g.ids) + node

            def at(node: np.ndarray, of: np.ndarray, key=key, found=found) -> np.ndarray:
                wanted = of * len(g.ids) + node
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                return np.where(key[place] == wanted, found[place], UNBOUNDED)

            yield mine, k, at


def _back(incoming: tuple, at, ends: np.ndarray, of: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    """Routes to ``ends``, backwards: of all pairs at once, at each step the smallest node from which the cost adds up."""
    head, src, arc_cost = incoming
    steps, node, left, active = [ends.copy()], ends.copy(), cost.copy(), np.flatnonzero(cost > 0)
    while len(active):
        which, arc = _repeated(head[node[active]], head[node[active] + 1] - head[node[active]])
        pair = active[which]
        fits = at(src[arc], of[pair]) + arc_cost[arc] == left[pair]
        which, arc = which[fits], arc[fits]
        # incoming arcs are sorted by their start, so the first that fits is the smallest
        first = np.ones(len(which), bool)
        first[1:] = which[1:] != which[:-1]
        which, arc = which[first], arc[first]
        node[active[which]], left[active[which]] = src[arc], left[active[which]] - arc_cost[arc]
        step = np.full(len(ends), -1, np.int64)
        step[active] = node[active]
        steps.append(step)
        active = active[left[active] > 0]
    whole = np.stack(steps)
    return [column[column >= 0][::-1] for column in whole.T]


def _parted(network: Network, pairs: DataFrame, impedance: str | None, graph) -> DataFrame:
    """The pairs whose ends lie in one part of the graph: ``(part, origin, destination)`` as numbers of nodes."""
    name = network.impedance(impedance)
    if (name, "parts") not in network.graphs:
        network.graphs[name, "parts"] = network.spark.sparkContext.broadcast(Graph.of(graph.value).parts())
    parts = network.graphs[name, "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, part = Graph.of(graph.value), parts.value
        for batch in batches:
            a, b = (g.numbers(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("origin", "destination"))
            ok = (a >= 0) & (b >= 0)
            ok[ok] = part[a[ok]] == part[b[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(x[ok], pa.int64()) for x in (part[a], a, b)] if ok.any() else [pa.array([], pa.int64())] * 3, names=["part", "a", "b"])

    return pairs.select("origin", "destination").mapInArrow(run, "part bigint, a bigint, b bigint")


def _search(network: Network, pairs: DataFrame, impedance: str | None, graph, routes: bool) -> DataFrame:
    """``(origin, destination, cost)``, and ``path`` if wanted, of the pairs with a way between them."""
    kind = network.id_type
    out = pa.int64() if kind == "bigint" else pa.string()

    def answer(g: Graph, part: np.ndarray, a: np.ndarray, b: np.ndarray, nodes_of) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((b, a, part))
        part, a, b = part[order], a[order], b[order]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            own = g.within(nodes_of(part[lo]))
            origins, owner = np.unique(np.searchsorted(own.ids, a[lo:hi]), return_inverse=True)
            ends = np.searchsorted(own.ids, b[lo:hi])
            incoming = own.incoming() if routes else None
            for mine, k, at in _costs(own, origins, owner, ends):
                of = owner[mine] - k
                cost = at(ends[mine], of)
                way = cost < UNBOUNDED
                mine, of, cost = mine[way], of[way], cost[way]
                columns = [pa.array(g.ids[own.ids[origins[owner[mine]]]], out), pa.array(g.ids[own.ids[ends[mine]]], out), pa.array(cost, pa.int64())]
                if routes:
                    paths = _back(incoming, at, ends[mine], of, cost)
                    offsets = np.append(0, np.cumsum([len(p) for p in paths])).astype(np.int32)
                    steps = g.ids[own.ids[np.concatenate(paths)]] if paths else g.ids[:0]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(steps, out)))
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "destination", "cost", "path"][: len(columns)])

    parts = _parted(network, pairs, impedance, graph)
    labels = network.graphs[network.impedance(impedance), "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Graph.of(graph.value)
        order = np.argsort(labels.value, kind="stable")
        sorted_labels = labels.value[order]

        def nodes_of(part: int) -> np.ndarray:
            return order[slice(*np.searchsorted(sorted_labels, [part, part + 1]))]

        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("part", "a", "b")])
            rows += batch.num_rows
            if rows >= PAIRS:
                yield from answer(g, *(np.concatenate(c) for c in zip(*held)), nodes_of)
                held, rows = [], 0
        if rows:
            yield from answer(g, *(np.concatenate(c) for c in zip(*held)), nodes_of)

    schema = f"origin {kind}, destination {kind}, cost bigint" + (f", path array<{kind}>" if routes else "")
    # pairs of one part, and of one origin, are searched together; a part with very many is cut
    tasks = 2 * network.spark.sparkContext.defaultParallelism
    found = parts.repartitionByRange(tasks, "part", "a").mapInArrow(run, schema)
    same = pairs.where(F.col("origin") == F.col("destination")).select(
        "origin", "destination", F.lit(0).cast("bigint").alias("cost"), *([F.array("origin").alias("path")] if routes else [])
    )
    # a node without arcs is no part of the graph but has a way to itself
    return found.where(F.col("origin") != F.col("destination")).unionByName(same)


def shortest_path_lengths(
    network: Network, pairs: DataFrame, impedance: str | None = None, missing: float | None = None, strategy: str = "auto"
) -> DataFrame:
    """``pairs`` with a column ``length`` (in the unit of the impedance) from ``origin`` to ``destination``.

    Pairs are taken as they are, row by row; repeated pairs are searched once. A node to itself is 0. Unreachable
    pairs, and pairs with an unknown or null node, get ``missing`` (null by default). Extra columns are kept,
    but for one named ``length``, which raises.
    """
    if "length" in pairs.columns:
        raise ValueError("pairs already have a column length")
    wanted = _pairs(network, pairs)
    graph = broadcast_graph(network, impedance, strategy=strategy)
    found = _by_tiles(network, wanted, impedance)[0] if graph is None else _search(network, wanted, impedance, graph, routes=False)
    length = F.col("cost") / 1000.0
    return pairs.join(found.select("origin", "destination", length.alias("length")), ["origin", "destination"], "left").select(
        *[F.col(f"`{c}`") for c in pairs.columns],
        (F.coalesce(F.col("length"), F.lit(missing)) if missing is not None else F.col("length")).alias("length"),
    )


def shortest_paths(network: Network, pairs: DataFrame, impedance: str | None = None, strategy: str = "auto") -> DataFrame:
    """``(origin, destination, path)`` for each distinct pair: node ids from end to end.

    Empty if unreachable or a node is unknown; one element from a node to itself. Of equally long routes the
    one is taken that, going backwards, always comes from the smallest node.
    """
    wanted = _pairs(network, pairs)
    graph = broadcast_graph(network, impedance, strategy=strategy)
    if graph is not None:
        found = _search(network, wanted, impedance, graph, routes=True).select("origin", "destination", "path")
    else:
        found = _backtrack(network, wanted, impedance)
    every = pairs.select("origin", "destination").distinct()
    return every.join(found, ["origin", "destination"], "left").select(
        "origin", "destination", F.coalesce("path", F.array().cast(f"array<{network.id_type}>")).alias("path")
    )


def _by_tiles(network: Network, wanted: DataFrame, impedance: str | None) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """``(origin, destination, cost)`` of the pairs with a way, and the labels they come from, of origins that enter tiles, by limit.

    Ends in different parts of the graph have no way between them. The other origins are searched up to a limit, and
    those with open pairs again up to a higher one, so that none is searched far beyond its dearest destination.
    """
    tiling, kind = Tiling.of(network, impedance, False), network.id_type
    if (parts := tiling.parts()) is not None:
        wanted = wanted.join(parts.select(F.col("node_id").alias("origin"), "part"), "origin").join(
            parts.select(F.col("node_id").alias("destination"), F.col("part").alias("other")), "destination"
        ).where(F.col("part") == F.col("other")).select("origin", "destination")
    open_, found, rounds = cut_lineage(wanted), [], []
    mean, most = tiling.arcs.agg(F.avg("cost"), F.sum("cost")).first()
    limit = int(FIRST_ARCS * (mean or 0)) + 1
    while True:
        if limit >= (most or 0):  # no way costs more
            limit = UNBOUNDED
        origins = open_.select(F.col("origin").alias("node_id")).distinct().join(tiling.nodes, "node_id")
        start = origins.select(F.col("node_id").alias("home"), "tile", F.col("node_id").alias("node"), F.lit(0).cast("bigint").alias("cost"))
        rounds.append((limit, tiling.entries(start, limit, kind)))
        asked = open_.select(F.col("origin").alias("home"), F.col("destination").alias("node"))
        labels = tiling.labels(rounds[-1][1], asked, None, kind, limit)
        found.append(cut_lineage(labels.select(F.col("home").alias("origin"), F.col("node").alias("destination"), "cost")))
        left = cut_lineage(open_.join(found[-1], ["origin", "destination"], "left_anti"))
        forget(open_)
        open_ = left
        if limit == UNBOUNDED or open_.isEmpty():
            return reduce(DataFrame.unionByName, found), rounds
        limit *= FURTHER if len(rounds) < 4 else FURTHER**2


def _backtrack(network: Network, wanted: DataFrame, impedance: str | None) -> DataFrame:
    """Routes by joins: the steps back from every node that a route may pass, then for each origin its steps in one task.

    Labels are kept up to the cost of an origin's dearest destination.
    """
    reachable, rounds = _by_tiles(network, wanted, impedance)
    tiling, kind = Tiling.of(network, impedance, False), network.id_type
    most, below, dist = reachable.groupBy(F.col("origin").alias("home")).agg(F.max("cost").alias("most")), -1, []
    for limit, entries in rounds:
        dist.append(tiling.labels(entries, None, most.where((F.col("most") > below) & (F.col("most") <= limit)), kind, limit))
        below = limit
    dist = cut_lineage(reduce(DataFrame.unionByName, dist))
    arcs = network.arcs(impedance)
    here = dist.select(F.col("home").alias("origin"), F.col("node").alias("dst"), F.col("cost").alias("there"))
    before = dist.select(F.col("home").alias("origin"), F.col("node").alias("src"), F.col("cost").alias("so_far"))
    steps = (
        here.join(arcs, "dst").join(before, ["origin", "src"])
        .where(F.col("so_far") + F.col("cost") == F.col("there"))
        .groupBy("origin", "dst").agg(F.min("src").alias("src"))
    )
    return tiling.walked(steps, reachable)
