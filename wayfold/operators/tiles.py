"""Bounded searches in graphs of any size: tiles, each with the part of the graph around it that it can reach.

1. Nodes are cut into tiles of about as many nodes along a space-filling curve of their positions.
2. What a tile can reach is found by joins on tiles: all nodes of a home tile start at cost 0, each round
   searches the tiles that were entered last and passes on, at least cost, where arcs cross into other
   tiles. There are as many rounds as tiles in a row within the radius, and only crossings are passed on.
3. The arcs that a home tile can use are sent to it, once, and its sources are searched there.

Labels live per home and crossing, not per source and node, so what is shuffled follows the graph and the
radius and not the number of pairs. Positions only balance the work; the result doesn't rest on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.graph import BLOCK, LABELS, UNBOUNDED, Graph, _repeated
from wayfold.operators.network import Network
from wayfold.operators.proximity import placed
from wayfold.session import cut_lineage, forget

#: Nodes of a tile; graphs of fewer nodes are cut finer, for as many tasks as there are cores.
TILE_NODES = 16_384
LEAST_NODES = 512
#: Rows of homes that a task works on together.
CHUNK = 500_000
#: Links between parts of tiles that one task may merge.
PART_LINKS = 4_000_000
#: Routes that are walked back together.
WALKED = 4_096
#: Bits of a position along each axis of the curve.
BITS = 20

# kinds of rows in a stream: those that hold for a whole tile come first
NODE, ARC, VALUE, ENTRY, WANTED = 0, 1, 2, 3, 4
_COLUMNS = ["tile", "kind", "home", "a", "b", "far", "cost"]
_INT = pa.int64()


def _interleaved(x: Column) -> Column:
    """The bits of ``x`` with a zero between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def on_curve(network: Network) -> tuple[DataFrame, int]:
    """``(node_id, code)``, near nodes with near codes, and the number of nodes."""
    usable = placed(F.col("x"), F.col("y"))
    positions = network.nodes_df.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(
        F.min(F.when(usable, F.col("x"))).alias("x"), F.min(F.when(usable, F.col("y"))).alias("y")
    )
    low_x, high_x, low_y, high_y, count = positions.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()

    def step(c: str, low: float | None, high: float | None) -> Column:
        width = (high or 0) - (low or 0)
        return F.floor((F.col(c) - F.lit(low or 0)) / F.lit(width or 1.0) * (2**BITS - 1)).cast("bigint")

    code = _interleaved(step("x", low_x, high_x)).bitwiseOR(F.shiftleft(_interleaved(step("y", low_y, high_y)), 1))
    # nodes without a position are spread evenly
    return positions.select("node_id", F.coalesce(code, F.pmod(F.xxhash64("node_id"), F.lit(2 ** (2 * BITS)))).alias("code")), count


class Tiling:
    """A graph cut into tiles: ``nodes(node_id, tile)`` and ``arcs(tile, src, dst, far, cost)``, ``far`` the tile of dst."""

    def __init__(self, network: Network, impedance: str | None, reverse: bool):
        self.kind = network.id_type
        self.network, self.impedance, self.reverse = network, impedance, reverse
        coded, count = on_curve(network)
        cores = network.spark.sparkContext.defaultParallelism
        self.tiles = max(1, -(-count // TILE_NODES), min(cores, count // LEAST_NODES))
        self.nodes = cut_lineage(
            coded.repartitionByRange(self.tiles, "code", "node_id").select("node_id", F.spark_partition_id().cast("bigint").alias("tile"))
        )

    @cached_property
    def arcs(self) -> DataFrame:
        arcs = self.network.all_arcs(self.impedance)
        a, b = ("dst", "src") if self.reverse else ("src", "dst")
        here = self.nodes.select(F.col("node_id").alias("src"), "tile")
        there = self.nodes.select(F.col("node_id").alias("dst"), F.col("tile").alias("far"))
        # the joins also leave out arcs at unknown nodes
        return cut_lineage(arcs.select(F.col(a).alias("src"), F.col(b).alias("dst"), "cost").join(here, "src").join(there, "dst").select("tile", "src", "dst", "far", "cost"))

    @classmethod
    def of(cls, network: Network, impedance: str | None, reverse: bool) -> Tiling:
        """The tiling of a network, made once and kept with it."""
        key = network.impedance(impedance), reverse
        if key not in network.tiles:
            network.tiles[key] = cls(network, impedance, reverse)
        return network.tiles[key]

    def _rows(self, df: DataFrame, kind: int, home: str, extra: dict[str, str], /, **columns: str) -> DataFrame:
        """``df`` as rows of a stream; ``columns`` names what goes where. What has no use is 0, as nulls would
        make arrays of ids inexact; payload that a row doesn't have is null."""
        types = {"tile": "bigint", "home": home, "a": self.kind, "b": self.kind, "far": "bigint", "cost": "bigint", **extra}

        def pick(c: str) -> Column:
            if c == "kind":
                return F.lit(kind)
            name = columns.get(c, c if c in df.columns else None)
            return (F.lit(None if c in extra else "0") if name is None else F.col(f"`{name}`")).cast(types[c])

        return df.select(*[pick(c).alias(c) for c in [*_COLUMNS, *extra]])

    def _in_order(self, stream: DataFrame) -> DataFrame:
        later = (F.col("kind") >= ENTRY).cast("int")
        # a partition for each tile, as the work of a tile is in its searches and not its bytes
        return stream.repartitionById(self.tiles, F.col("tile").cast("int")).sortWithinPartitions("tile", later, "home", "kind")

    def _graph(self, home: str, extra: dict[str, str]) -> DataFrame:
        nodes = self._rows(self.nodes, NODE, home, extra, a="node_id")
        return nodes.unionByName(self._rows(self.arcs, ARC, home, extra, a="src", b="dst"))

    def entries(self, start: DataFrame, limit: int, home: str = "bigint") -> DataFrame:
        """``(home, tile, node, cost)``: ``start``, and at least cost each node at which a home enters a tile."""
        keys = ["home", "tile", "node"]
        known = cut_lineage(start.select(*keys, "cost", F.lit(True).alias("fresh")))
        if self.tiles == 1:
            return known.drop("fresh")
        graph = self._graph(home, {})
        run = _pass(_crossings(limit, _arrow(home), _arrow(self.kind)), whole_homes=True)
        while True:
            fresh = known.where("fresh")
            # at most one row per tile
            entered = graph.join(F.broadcast(fresh.select("tile").distinct()), "tile", "left_semi")
            new = self._rows(fresh, ENTRY, home, {}, a="node")
            crossed = self._in_order(entered.unionByName(new)).mapInArrow(run, f"home {home}, tile bigint, node {self.kind}, cost bigint")
            so_far = F.lit(None).cast("bigint")
            better = cut_lineage(
                known.select(*keys, "cost", F.col("cost").alias("so_far")).unionByName(crossed.select(*keys, "cost", so_far.alias("so_far")))
                .groupBy(*keys).agg(F.min("cost").alias("cost"), F.min("so_far").alias("so_far"))
                .select(*keys, "cost", (F.col("so_far").isNull() | (F.col("cost") < F.col("so_far"))).alias("fresh"))
            )
            forget(known)
            known = better
            if known.where("fresh").isEmpty():
                return known.drop("fresh")

    def at_home(self, sources: DataFrame, limit: int, work: Callable, schema: str, values: DataFrame | None = None) -> DataFrame:
        """``work(graph, values, sources)`` for each tile that holds some of ``sources.source``.

        The graph has every arc that a source of the tile can use within ``limit``; ``values`` (``node_id`` and
        any columns) is given as a dict of arrays, for the nodes in reach. ``work`` yields record batches.
        """
        extra = {} if values is None else {c: t for c, t in values.dtypes if c != "node_id"}
        located = sources.join(self.nodes.withColumnRenamed("node_id", "source"), "source").select("source", "tile")
        start = located.select(F.col("tile").alias("home"), "tile", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("cost"))
        entries = self.entries(start, limit)
        stream = self._graph("bigint", extra).unionByName(self._rows(entries, ENTRY, "bigint", extra, a="node"))
        if values is not None:
            stream = stream.unionByName(self._rows(values.join(self.nodes, "node_id"), VALUE, "bigint", extra, a="node_id"))
        columns = _COLUMNS + list(extra)
        types = {"tile": "bigint", "kind": "int", "home": "bigint", "a": self.kind, "b": self.kind, "far": "bigint", "cost": "bigint", **extra}
        usable = self._in_order(stream).mapInArrow(
            _pass(_usable(limit, list(extra)), whole_homes=True), ", ".join(f"`{c}` {types[c]}" for c in columns)
        )
        asked = self._rows(located, WANTED, "bigint", extra, a="source")
        return self._in_order(usable.unionByName(asked)).mapInArrow(_pass(_searched(work, list(extra)), whole_homes=False), schema)

    def with_values(self, pairs: DataFrame, values: DataFrame, work: Callable, schema: str) -> DataFrame:
        """``work(values, sources, destinations)`` over ``pairs(source, destination)``, all pairs of a source in one call.

        The pairs of a tile's sources are met with the ``values`` (``node_id`` and any columns) of their destinations,
        which are sent to the tile once, however many of its sources reach them. Arrays are given, in the order of sources.
        """
        extra = {c: t for c, t in values.dtypes if c != "node_id"}
        located = pairs.join(self.nodes.withColumnRenamed("node_id", "source"), "source").select("tile", "source", F.col("destination").alias("node_id"))
        sent = located.select("tile", "node_id").distinct().join(values, "node_id")
        stream = self._rows(sent, VALUE, self.kind, extra, a="node_id").unionByName(self._rows(located, ENTRY, self.kind, extra, home="source", a="node_id"))
        return self._in_order(stream).mapInArrow(_pass(_met(work, list(extra)), whole_homes=True), schema)

    def parts(self) -> DataFrame | None:
        """``(node_id, part)``: the same part for nodes that arcs link in whatever direction; None where that isn't cheap to say.

        Parts within tiles are merged by one task if the links between them are counted and found to fit it.
        """
        asked = self._rows(self.nodes.select("tile").distinct(), WANTED, "bigint", {})
        within = cut_lineage(self._in_order(self._graph("bigint", {}).unionByName(asked)).mapInArrow(_pass(_parts(_arrow(self.kind)), whole_homes=False), f"node_id {self.kind}, part {self.kind}"))
        a, b = (within.select(F.col("node_id").alias(end), F.col("part").alias(part)) for end, part in (("src", "a"), ("dst", "b")))
        links = cut_lineage(self.arcs.where("tile <> far").join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct())
        if links.count() > PART_LINKS:
            return None
        out = _arrow(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches if b.num_rows]
            if held:
                src, dst = (np.concatenate(c) for c in zip(*held))
                graph = Graph(src, dst, np.ones(len(src), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(graph.ids, out), pa.array(graph.ids[graph.parts()], out)], names=["part", "whole"])

        merged = links.repartition(1).mapInArrow(run, f"part {self.kind}, whole {self.kind}")
        return within.join(merged, "part", "left").select("node_id", F.coalesce("whole", "part").alias("part"))

    def labels(self, entries: DataFrame, wanted: DataFrame | None, limits: DataFrame | None, home: str, limit: int = UNBOUNDED) -> DataFrame:
        """``(home, node, cost)`` at the ``wanted(home, node)``, or at every node up to the ``limits(home, most)``; none above ``limit``."""
        stream = self._graph(home, {}).unionByName(self._rows(entries, ENTRY, home, {}, a="node"))
        asked = wanted.join(self.nodes.withColumnRenamed("node_id", "node"), "node") if wanted is not None else entries.select("home", "tile").distinct().join(limits, "home")
        rows = self._rows(asked, WANTED, home, {}, a="node") if wanted is not None else self._rows(asked, WANTED, home, {}, cost="most")
        run = _pass(_asked(wanted is None, limit, _arrow(home), _arrow(self.kind)), whole_homes=True)
        return self._in_order(stream.unionByName(rows)).mapInArrow(run, f"home {home}, node {self.kind}, cost bigint")


    def walked(self, steps: DataFrame, pairs: DataFrame) -> DataFrame:
        """``(origin, destination, path)`` of ``pairs``, by ``steps(origin, dst, src)`` back; those of an origin in one task."""
        tile = F.pmod(F.xxhash64("origin"), F.lit(self.tiles)).alias("tile")
        back = self._rows(steps.select("*", tile), ENTRY, self.kind, {}, home="origin", a="dst", b="src")
        ends = self._rows(pairs.select("*", tile).drop("cost"), WANTED, self.kind, {}, home="origin", a="destination", b="origin")
        schema = f"origin {self.kind}, destination {self.kind}, path array<{self.kind}>"
        return self._in_order(back.unionByName(ends)).mapInArrow(_pass(_walked(_arrow(self.kind)), whole_homes=True), schema)


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.string()


def _pass(work: Callable, whole_homes: bool) -> Callable:
    """A function over batches in order, which calls ``work(tile, fixed, rows)`` for chunks of a tile's later rows.

    ``fixed`` has the arrays of the rows that hold for the whole tile, by kind, and what ``work`` adds to it.
    With ``whole_homes`` a chunk has all rows of each home in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fixed, held, rows = None, {}, [], 0

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            value = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            kinds, tiles = value["kind"], value["tile"]
            stage = np.where(kinds >= ENTRY, ENTRY, kinds)
            change = np.flatnonzero((tiles[1:] != tiles[:-1]) | (stage[1:] != stage[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(kinds)]):
                if tiles[a] != tile:
                    if held:
                        yield from work(tile, fixed, joined())
                    tile, fixed, held, rows = tiles[a], {}, [], 0
                part = {c: v[a:b] for c, v in value.items()}
                if stage[a] < ENTRY:
                    fixed.setdefault(int(stage[a]), []).append(part)
                    continue
                held.append(part)
                rows += b - a
                if rows >= CHUNK:
                    whole = joined()
                    cut = len(whole["kind"])
                    if whole_homes:
                        cut = int(np.flatnonzero(whole["home"] != whole["home"][-1])[-1] + 1) if (whole["home"] != whole["home"][-1]).any() else 0
                    if cut:
                        yield from work(tile, fixed, {c: v[:cut] for c, v in whole.items()})
                    held = [{c: v[cut:] for c, v in whole.items()}] if cut < len(whole["kind"]) else []
                    rows = len(whole["kind"]) - cut
        if held:
            yield from work(tile, fixed, joined())

    return run


def _fixed(fixed: dict, kind: int, column: str, like: np.ndarray) -> np.ndarray:
    parts = [p[column] for p in fixed.get(kind, [])]
    return np.concatenate(parts) if parts else like[:0]


def _ints(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64)


def _local(tile, fixed: dict, rows: dict) -> Graph:
    """The graph within a tile, with the arcs that leave it beside; made once per tile."""
    if "graph" not in fixed:
        src, dst = _fixed(fixed, ARC, "a", rows["a"]), _fixed(fixed, ARC, "b", rows["a"])
        far, cost = _ints(_fixed(fixed, ARC, "far", rows["cost"])), _ints(_fixed(fixed, ARC, "cost", rows["cost"]))
        inside = far == tile
        graph = Graph(src[inside], dst[inside], cost[inside], np.concatenate([_fixed(fixed, NODE, "a", rows["a"]), src]))
        number = graph.numbers(src)
        order = np.argsort(number, kind="stable")
        fixed["graph"] = graph
        # all arcs by their start
        fixed["head"] = np.searchsorted(number[order], np.arange(len(graph.ids) + 1))
        fixed["out"] = (dst[order], far[order], cost[order])
        # those that leave
        leaves = ~inside
        number = number[leaves]
        order = np.argsort(number, kind="stable")
        fixed["leave_head"] = np.searchsorted(number[order], np.arange(len(graph.ids) + 1))
        fixed["leave"] = (dst[leaves][order], far[leaves][order], cost[leaves][order])
    return fixed["graph"]


def _from_entries(graph: Graph, rows: dict, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of homes: the homes, and (position of the home, node, cost) reached within the tile."""
    entry = rows["kind"] == ENTRY
    home, number, cost = rows["home"][entry], graph.numbers(rows["a"][entry]), _ints(rows["cost"][entry])
    known = number >= 0
    homes, owner = np.unique(home[known], return_inverse=True)
    number, cost = number[known], cost[known]
    block = max(1, min(BLOCK, LABELS // max(len(graph.ids), 1)))
    for k in range(0, len(homes), block):
        mine = (owner >= k) & (owner < k + block)
        part = homes[k : k + block]
        yield part, *graph.spread(owner[mine] - k, number[mine], cost[mine], len(part), limit)


def _crossings(limit: int, home: pa.DataType, kind: pa.DataType) -> Callable:
    def work(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        graph = _local(tile, fixed, rows)
        head, (dst, far, arc_cost) = fixed["leave_head"], fixed["leave"]
        for homes, owner, node, cost in _from_entries(graph, rows, limit):
            which, arc = _repeated(head[node], head[node + 1] - head[node])
            total = cost[which] + arc_cost[arc]
            near = total <= limit
            which, arc, total = which[near], arc[near], total[near]
            if len(which):
                # of several arcs of a home to one node the cheapest
                order = np.lexsort((total, dst[arc], owner[which]))
                o, d = owner[which][order], dst[arc][order]
                first = np.ones(len(order), bool)
                first[1:] = (o[1:] != o[:-1]) | (d[1:] != d[:-1])
                keep = order[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(homes[owner[which[keep]]], home), pa.array(far[arc[keep]], _INT), pa.array(dst[arc[keep]], kind), pa.array(total[keep], _INT)],
                    names=["home", "tile", "node", "cost"],
                )

    return work


def _usable(limit: int, extra: list[str]) -> Callable:
    def work(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        graph = _local(tile, fixed, rows)
        head, (dst, _, arc_cost) = fixed["head"], fixed["out"]
        if VALUE in fixed and "values" not in fixed:
            number = graph.numbers(_fixed(fixed, VALUE, "a", rows["a"]))
            order = np.argsort(number, kind="stable")
            fixed["values"] = {c: _fixed(fixed, VALUE, c, rows[c])[order] for c in ["a", *extra]}
            fixed["value_head"] = np.searchsorted(number[order], np.arange(len(graph.ids) + 1))
        for homes, owner, node, cost in _from_entries(graph, rows, limit):
            which, arc = _repeated(head[node], head[node + 1] - head[node])
            near = cost[which] + arc_cost[arc] <= limit
            which, arc = which[near], arc[near]
            n = len(which)
            yield _batch(n, ARC, extra, homes[owner[which]], graph.ids[node[which]], dst[arc], arc_cost[arc], {})
            if VALUE in fixed:
                at = fixed["value_head"]
                which, row = _repeated(at[node], at[node + 1] - at[node])
                yield _batch(len(which), VALUE, extra, homes[owner[which]], fixed["values"]["a"][row], None, None, {c: fixed["values"][c][row] for c in extra})

    return work


def _batch(n: int, kind: int, extra: list[str], home, a, b, cost, values: dict) -> pa.RecordBatch:
    ids = pa.string() if a.dtype == object else _INT
    zeros = pa.array(np.zeros(n, np.int64))
    columns = {
        "tile": pa.array(home, _INT), "kind": pa.array(np.full(n, kind, np.int32)), "home": zeros, "a": pa.array(a, ids),
        "b": pa.array(a if b is None else b, ids), "far": zeros, "cost": zeros if cost is None else pa.array(cost, _INT),
    }
    for c in extra:
        kind_of = _INT if c == "n" else pa.float64()
        columns[c] = pa.array(values[c].astype(np.int64 if c == "n" else np.float64)) if c in values else pa.nulls(n, kind_of)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _searched(work: Callable, extra: list[str]) -> Callable:
    def run(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        if "graph" not in fixed:
            none = rows["a"]
            fixed["graph"] = Graph(_fixed(fixed, ARC, "a", none), _fixed(fixed, ARC, "b", none), _ints(_fixed(fixed, ARC, "cost", rows["cost"])))
            fixed["values"] = {c: _fixed(fixed, VALUE, c, rows[c]) for c in ["a", *extra]} if VALUE in fixed else {c: rows[c][:0] for c in ["a", *extra]}
        yield from work(fixed["graph"], fixed["values"], rows["a"])

    return run


def _met(work: Callable, extra: list[str]) -> Callable:
    def run(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        if "values" not in fixed:
            fixed["values"] = {c: _fixed(fixed, VALUE, c, rows[c]) for c in ["a", *extra]}
            fixed.pop(VALUE, None)
        yield from work(fixed["values"], rows["home"], rows["a"])

    return run


def _parts(kind: pa.DataType) -> Callable:
    def work(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        graph = _local(tile, fixed, rows)
        yield pa.RecordBatch.from_arrays([pa.array(graph.ids, kind), pa.array(graph.ids[graph.parts()], kind)], names=["node_id", "part"])

    return work


def _walked(kind: pa.DataType) -> Callable:
    def work(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        ids, number = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
        a, b = number[: len(rows["a"])], number[len(rows["a"]) :]
        owner = np.unique(rows["home"], return_inverse=True)[1] * len(ids)
        step = rows["kind"] == ENTRY
        order = np.argsort((owner + a)[step])
        key, source = (owner + a)[step][order], b[step][order]
        pairs = np.flatnonzero(~step)
        for k in range(0, len(pairs), WALKED):
            mine = pairs[k : k + WALKED]
            node, end = a[mine], b[mine]
            trail, active = [node.copy()], np.flatnonzero(node != end)
            while len(active):
                node[active] = source[np.searchsorted(key, owner[mine[active]] + node[active])]
                trail.append(np.full(len(mine), -1, np.int64))
                trail[-1][active] = node[active]
                active = active[node[active] != end[active]]
            whole = np.stack(trail[::-1]).T
            there = whole >= 0
            offsets = np.append(0, np.cumsum(there.sum(1))).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[whole[there]], kind))
            yield pa.RecordBatch.from_arrays([pa.array(rows["b"][mine], kind), pa.array(rows["a"][mine], kind), paths], names=["origin", "destination", "path"])

    return work


def _asked(every: bool, limit: int, home: pa.DataType, kind: pa.DataType) -> Callable:
    def work(tile, fixed: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        graph = _local(tile, fixed, rows)
        asked = rows["kind"] == WANTED
        for homes, owner, node, cost in _from_entries(graph, rows, limit):
            mine = np.flatnonzero(asked)
            at = np.minimum(np.searchsorted(homes, rows["home"][mine]), len(homes) - 1)
            ok = homes[at] == rows["home"][mine]
            mine, at = mine[ok], at[ok]
            if every:
                most = np.zeros(len(homes), np.int64)
                most[at] = _ints(rows["cost"][mine])
                keep = cost <= most[owner]
                columns = homes[owner[keep]], graph.ids[node[keep]], cost[keep]
            else:
                key, wanted = owner * len(graph.ids) + node, graph.numbers(rows["a"][mine])
                place = np.minimum(np.searchsorted(key, at * len(graph.ids) + wanted), len(key) - 1)
                hit = (wanted >= 0) & (key[place] == at * len(graph.ids) + wanted)
                columns = homes[at[hit]], graph.ids[wanted[hit]], cost[place[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], home), pa.array(columns[1], kind), pa.array(columns[2], _INT)], names=["home", "node", "cost"])

    return work
