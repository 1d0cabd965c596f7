"""Network operators on a literal grid of twelve nodes, with values worked out by hand or by brute force."""

import heapq
import os
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.accessibility import Accessibility, reserve_num_graphs
from wayfold.operators.aggregate import _Values, aggregate, low_connectivity_nodes, variable
from wayfold.operators.nearest import nearest_pois, nearest_wide
from wayfold.operators.network import Network
from wayfold.operators.paths import UNREACHABLE, shortest_path_lengths, shortest_paths
from wayfold.operators import aggregate as aggregation
from wayfold.operators import paths, tiles
from wayfold.operators.graph import UNBOUNDED, Graph
from wayfold.operators.reach import ReachCache, broadcast_graph, nodes_in_range, reach
from wayfold.operators.snap import nearest_node
from wayfold.operators.tables import (
    adjacency_counts, adjacency_matrix, binned, node_index, plot_data, reindex, resolve_ids,
)

# --- fixed values: the literal network and the results that belong to it ---
NODES = [(k, float(k % 4 + 1), float(k // 4 + 1)) for k in range(12)]
EDGES = list(
    zip([0, 4, 5, 6, 2, 2, 6, 10, 9, 7], [4, 5, 6, 2, 1, 3, 10, 9, 8, 11], [1.0] * 10, [float(t) for t in range(1, 11)])
)


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "TILE_NODES", 6)


@pytest.fixture(scope="module")
def grid(spark):
    return Network(
        spark.createDataFrame(NODES, "node_id bigint, x double, y double"),
        spark.createDataFrame(EDGES, "from bigint, to bigint, distance double, time double"),
    )


@pytest.fixture(scope="module")
def oneway(grid):
    return Network(grid.nodes_df, grid.edges_df, grid.impedance_names, twoway=False)


@pytest.fixture(scope="module")
def values(spark, grid):
    rows = [(0, 10.0), (0, 20.0), (2, 30.0), (6, 5.0), (8, 7.0), (11, 100.0), (None, 1.0), (0, None), (0, float("nan")), (99, 3.0)]
    return variable(grid, spark.createDataFrame(rows, "node_id bigint, v double"), "node_id", "v")


def costs(df, source):
    return {r["destination"]: r["cost"] // 1000 for r in df.where(F.col("source") == source).collect()}


@pytest.mark.parametrize("strategy", ["arrow", "tiles"])
def test_reach(grid, oneway, strategy):
    expected = {0: 0, 4: 1, 5: 3, 6: 6, 2: 10, 10: 13, 1: 15, 3: 16, 9: 21, 8: 30}
    assert costs(reach(grid, None, "time", strategy=strategy), 0) == expected
    assert costs(reach(oneway, None, "time", strategy=strategy), 8) == {8: 0}
    if strategy == "tiles":
        return  # further cases below
    assert reach(grid, None, "time", strategy=strategy).count() == 104
    assert reach(grid, 2, "distance", strategy=strategy).count() == 52
    assert reach(grid, 10, "time", strategy=strategy).count() == 50
    assert reach(oneway, None, "time", strategy=strategy).count() == 48
    assert costs(reach(grid, 0, "distance", strategy=strategy), 5) == {5: 0}


def test_reverse_reach_is_the_transpose(oneway):
    forth = {(r.source, r.destination, r.cost) for r in reach(oneway, None, "time").collect()}
    back = {(r.destination, r.source, r.cost) for r in reach(oneway, None, "time", reverse=True).collect()}
    assert forth == back


AGGREGATES = {
    ("count", "flat"): [2, 2, 2, 2, 3, 4, 2, 1, 1, 2, 3, 1],
    ("sum", "flat"): [30, 35, 35, 35, 35, 65, 35, 100, 7, 12, 42, 100],
    ("sum", "linear"): [30, 15, 32.5, 15, 15, 2.5, 20, 50, 7, 3.5, 2.5, 100],
    ("sum", "exp"): [30, 20.0353, 33.0327, 20.0353, 20.0353, 25.1054, 23.1959, 60.6531, 7, 6.08511, 16.6442, 100],
    ("mean", "flat"): [15, 17.5, 17.5, 17.5, 11.6667, 16.25, 17.5, 100, 7, 6, 14, 100],
    ("average", "linear"): [15, 7.5, 16.25, 7.5, 5, 0.625, 10, 50, 7, 1.75, 0.833333, 100],
    ("STD", "linear"): [5, 12.5, 12.5, 12.5, 6.2361, 9.60143, 12.5, 0, 0, 1, 11.3431, 0],
    ("min", "exp"): [10, 5, 5, 5, 5, 5, 5, 100, 7, 5, 5, 100],
    ("25pct", "flat"): [10, 5, 5, 5, 5, 10, 5, 100, 7, 5, 5, 100],
    ("med", "flat"): [20, 30, 30, 30, 10, 20, 30, 100, 7, 7, 7, 100],
    ("75pct", "flat"): [20, 30, 30, 30, 20, 30, 30, 100, 7, 7, 30, 100],
    ("max", "flat"): [20, 30, 30, 30, 20, 30, 30, 100, 7, 7, 30, 100],
}


@pytest.mark.parametrize("strategy", ["auto", "join"])
@pytest.mark.parametrize(("kind", "decay"), AGGREGATES)
def test_aggregates(grid, values, kind, decay, strategy):
    found = {r.node_id: r.value for r in aggregate(grid, values, 2, kind, decay, "distance", strategy=strategy).collect()}
    assert [found[k] for k in range(12)] == pytest.approx(AGGREGATES[kind, decay], rel=1e-4)


@pytest.mark.parametrize(("kind", "decay"), [("sum", "exp"), ("med", "flat")])
def test_aggregates_over_tiles(grid, values, kind, decay):
    found = {r.node_id: r.value for r in aggregate(grid, values, 2, kind, decay, "distance", strategy="tiles").collect()}
    assert [found[k] for k in range(12)] == pytest.approx(AGGREGATES[kind, decay], rel=1e-4)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_tiles_equal_one_graph(spark, monkeypatch, kind):
    monkeypatch.setattr(tiles, "TILE_NODES", 20)
    rng = random.Random(12)
    name = (lambda k: 2**60 + k) if kind == "bigint" else (lambda k: f"n{k:03}")  # ids that floats can't hold
    nodes = [(name(k), rng.uniform(0, 9) if k % 9 else None, float(k % 7)) for k in range(60)]
    edges = [(name(a), name((a + rng.choice([1, 1, 2, 30])) % 63), rng.choice([0.0, 1.0, 2.5])) for a in range(60) for _ in range(2)]
    network = Network(
        spark.createDataFrame(nodes, f"node_id {kind}, x double, y double"), spark.createDataFrame(edges, f"from {kind}, to {kind}, w double"), twoway=False
    )
    assert tiles.Tiling.of(network, None, False).tiles == 3
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(reach(network, 4.0, strategy="tiles")) == rows(reach(network, 4.0, strategy="arrow"))
    points = network.node_ids.where(F.xxhash64("node_id") % 4 == 0).withColumn("poi_id", F.xxhash64("node_id"))
    assert rows(nearest_pois(network, points, 6.0, 3, strategy="tiles")) == rows(nearest_pois(network, points, 6.0, 3))
    values = points.select("node_id", (F.col("poi_id") % 100).cast("double").alias("value"))
    for how in ("mean", "75pct") if kind == "bigint" else ():
        apart = aggregate(network, values, 5.0, how, strategy="tiles").select("node_id", F.round("value", 6))
        assert rows(apart) == rows(aggregate(network, values, 5.0, how, strategy="arrow").select("node_id", F.round("value", 6)))
    pairs = spark.createDataFrame([(name(rng.randrange(60)), name(rng.randrange(62))) for _ in range(20)], f"origin {kind}, destination {kind}")
    assert rows(shortest_path_lengths(network, pairs, strategy="tiles")) == rows(shortest_path_lengths(network, pairs))
    assert rows(shortest_paths(network, pairs.limit(3), strategy="tiles")) == rows(shortest_paths(network, pairs.limit(3)))


def test_the_driver_is_sent_a_built_graph(grid, monkeypatch):
    assert not len(broadcast_graph(Network(grid.nodes_df, grid.edges_df.limit(0), ["time"]), "time").value["ids"])
    driver, built = os.getpid(), Graph.__init__

    def build(graph, *arcs):
        assert os.getpid() != driver
        built(graph, *arcs)

    monkeypatch.setattr(Graph, "__init__", build)
    fresh = Network(grid.nodes_df, grid.edges_df, grid.impedance_names)
    held = Graph.of(broadcast_graph(fresh, "time").value)
    assert len(held.ids) == 12 and len(held.dst) == 2 * len(EDGES) and held.cost.sum() == 2 * 55_000


def test_joined_quantiles_do_not_shuffle_pairs_with_values(grid, values, monkeypatch):
    plan = aggregate(grid, values, 2, "median", "flat", "time", strategy="join")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    random_ = np.random.default_rng(3)
    node, value, n = random_.integers(0, 20, 200), random_.integers(-5, 5, 200) / 2, random_.integers(1, 4, 200)
    held = _Values({"node_id": node, "value": value, "n": n})
    which, at = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(len(held.ids)), indexing="ij"))
    some = (which * 7 + at) % 3 > 0
    for met in (1, 50, 10_000):
        monkeypatch.setattr(aggregation, "MET", met)
        has, found = held.quantile(which[some], at[some], 6, 0.25)
        for k, x in zip(has, found):
            rows = np.isin(node, held.ids[at[some & (which == k)]])
            every = np.sort(np.repeat(value[rows], n[rows]))
            assert x == every[int(len(every) * 0.25)]
        assert list(has) == list(range(6))


def test_aggregate_without_values_and_at_radius_zero(spark, grid, values):
    none = spark.createDataFrame([], "node_id bigint, value double")
    assert {r.value for r in aggregate(grid, none, 2, "sum", impedance="distance").collect()} == {0.0}
    assert {r.value for r in aggregate(grid, none, 2, "max", impedance="distance").collect()} == {-1.0}
    at_zero = {r.node_id: r.value for r in aggregate(grid, values, 0, "sum", "linear", "distance").collect()}
    assert at_zero[0] == 30.0 and at_zero[1] == 0.0
    with pytest.raises(ValueError):
        aggregate(grid, values, 2, "product", impedance="distance")
    with pytest.raises(ValueError):
        aggregate(grid, values, 2, "sum", "steep", "distance")
    own = {r.node_id: r.value for r in aggregate(grid, values, 2, "sum", lambda d, r: F.lit(2.0), "distance").collect()}
    assert own[0] == 60.0


def test_aggregate_counts_nodes_without_edges(spark):
    nodes = spark.createDataFrame([(k, 0.0, 0.0) for k in range(4)], "node_id bigint, x double, y double")
    network = Network(nodes, spark.createDataFrame([(0, 1, 1.0)], "from bigint, to bigint, w double"))
    values = spark.createDataFrame([(2, 5.0), (2, 7.0), (1, 3.0)], "node_id bigint, value double")
    for strategy in ("auto", "tiles", "join"):
        for kind, expected in (("sum", [3, 3, 12, 0]), ("median", [3, 3, 7, -1]), ("std", [0, 0, 1, 0])):
            found = {r.node_id: r.value for r in aggregate(network, values, 1, kind, "flat", strategy=strategy).collect()}
            assert [found[k] for k in range(4)] == pytest.approx(expected)


def test_cache_serves_smaller_radii(grid, values):
    cache = ReachCache(grid)
    cache.precompute(5, ["distance"])
    cache.precompute(5, ["distance"])  # replaces, adds nothing
    small = cache.reach(2, "distance")
    assert small.count() == 52
    found = {r.node_id: r.value for r in aggregate(grid, values, 2, "sum", "flat", "distance", cache.reach(5, "distance")).collect()}
    assert found[5] == 65
    assert cache.reach(9, "distance").count() == reach(grid, 9, "distance").count()
    cache.clear()


def test_low_connectivity_and_range(spark, grid):
    assert sorted(r.node_id for r in low_connectivity_nodes(grid, 10, 3, "distance").collect()) == [7, 11]
    sources = spark.createDataFrame([(0,), (0,), (99,), (None,)], "node_id bigint")
    found = nodes_in_range(grid, sources, 2, "distance").collect()
    assert sorted((r.source, r.destination, r.distance) for r in found) == [(0, 0, 0.0), (0, 4, 1.0), (0, 5, 2.0)]
    assert nodes_in_range(grid, sources.limit(0), 2, "distance").count() == 0


@pytest.mark.parametrize("strategy", ["auto", "tiles"])
def test_nearest(spark, grid, strategy):
    pois = spark.createDataFrame([(5, "a"), (5, "b"), (10, "c"), (11, "d"), (None, "e"), (99, "f")], "node_id bigint, poi_id string")
    found = nearest_pois(grid, pois, 3, 3, "distance", strategy=strategy)
    by_node = {}
    for r in found.orderBy("node_id", "rank").collect():
        by_node.setdefault(r.node_id, []).append((r.poi_id, r.distance))
    assert by_node[0] == [("a", 2), ("b", 2)]
    assert by_node[9] == [("c", 1), ("a", 3), ("b", 3)]
    assert by_node[6] == [("a", 1), ("b", 1), ("c", 1)]
    assert by_node[7] == [("d", 1)] and by_node[8] == [("c", 2)]
    one = {(r.node_id, r.distance, r.poi_id) for r in nearest_pois(grid, pois, 3, 1, "distance", strategy=strategy).collect()}
    assert one == {(n, d[0][1], d[0][0]) for n, d in by_node.items()}
    wide = {r.node_id: tuple(r)[1:] for r in nearest_wide(grid, found, 3, 2000, True).collect()}
    assert wide[0] == (2.0, 2.0, 2000.0, "a", "b", None) and wide[7] == (1.0, 2000.0, 2000.0, "d", None, None)
    with pytest.raises(ValueError):
        nearest_pois(grid, pois, 3, 11, "distance", max_items=10)
    assert nearest_pois(grid, pois.limit(0), 3, 2, "distance", strategy=strategy).count() == 0


def test_nearest_of_many_points_at_a_node(spark, grid):
    pois = spark.createDataFrame([(5, k % 700) for k in range(1400)] + [(10, 1)], "node_id bigint, poi_id int")
    found = nearest_pois(grid, pois, 3, 3, "distance")
    by_node = {}
    for r in found.orderBy("node_id", "rank").collect():
        by_node.setdefault(r.node_id, []).append((r.poi_id, r.distance))
    assert by_node[5] == [(0, 0), (0, 0), (1, 0)] and by_node[9] == [(1, 1), (0, 3), (0, 3)]
    # a task sends the points of a node on only as far as they can be an answer
    assert "row_number(), 3, Partial" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy", ["auto", "tiles"])
def test_routes(spark, grid, strategy):
    pairs = spark.createDataFrame([(0, 8, "r"), (0, 8, "s"), (3, 3, "t"), (0, 7, "u"), (None, 1, "v"), (0, 77, "w")], "origin bigint, destination bigint, tag string")
    lengths = {r.tag: r.length for r in shortest_path_lengths(grid, pairs, "time", strategy=strategy).collect()}
    assert lengths == {"r": 30.0, "s": 30.0, "t": 0.0, "u": None, "v": None, "w": None}
    filled = shortest_path_lengths(grid, pairs, "time", missing=UNREACHABLE, strategy=strategy)
    assert filled.where(F.col("tag") == "u").first().length == UNREACHABLE
    paths = {(r.origin, r.destination): r.path for r in shortest_paths(grid, pairs, "time", strategy).collect()}
    assert paths[0, 8] == [0, 4, 5, 6, 10, 9, 8] and paths[3, 3] == [3] and paths[0, 7] == []
    with pytest.raises(ValueError):
        shortest_path_lengths(grid, pairs.withColumnRenamed("tag", "length"), "time")


@pytest.fixture
def chain(spark, monkeypatch):
    """Forty nodes in a row, and two apart."""
    monkeypatch.setattr(tiles, "TILE_NODES", 20)
    nodes = spark.range(42).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = spark.range(41).where("id <> 39").select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"), F.lit(1.0).alias("distance"))
    return Network(nodes, edges)


def test_lengths_over_tiles_search_as_far_as_needed(spark, chain, monkeypatch):
    limits, entries = [], tiles.Tiling.entries
    monkeypatch.setattr(tiles.Tiling, "entries", lambda tiling, start, limit, home="bigint": limits.append((limit, start.count())) or entries(tiling, start, limit, home))
    pairs = [(0, 3, 3.0), (18, 22, 4.0), (30, 15, 15.0), (5, 41, None), (40, 41, 1.0), (7, 7, 0.0)]
    found = shortest_path_lengths(chain, spark.createDataFrame([p[:2] for p in pairs], "origin bigint, destination bigint"), strategy="tiles")
    assert {tuple(r) for r in found.collect()} == set(pairs)
    assert limits == [(8001, 5), (16002, 1)]


def test_routes_over_tiles_take_no_job_for_each_arc(spark, chain, monkeypatch):
    cuts, cut = [], paths.cut_lineage
    monkeypatch.setattr(paths, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    pairs = spark.createDataFrame([(3, 38)], "origin bigint, destination bigint")
    assert shortest_paths(chain, pairs, strategy="tiles").first()["path"] == list(range(3, 39))
    assert len(cuts) < 15


def test_edges_are_normalized(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 5.0)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame(
        [(1, 2, 1.005), (2, 1, 0.7), (1, 2, 9.0), (1, 1, 4.0), (2, 3, 0.0), (3, 8, 1.0), (None, 1, 1.0)], "from bigint, to bigint, w double"
    )
    arcs = {(r.src, r.dst): r.cost for r in Network(nodes, edges).arcs().collect()}
    assert arcs == {(1, 2): 700, (2, 1): 700, (2, 3): 1, (3, 2): 1}
    arcs = {(r.src, r.dst): r.cost for r in Network(nodes, edges, twoway=False).arcs().collect()}
    assert arcs == {(1, 2): 1004, (2, 1): 700, (2, 3): 1}
    assert costs(reach(Network(nodes, edges), 0.7), 1).keys() == {1, 2}  # a radius just met counts
    bad = edges.union(spark.createDataFrame([(1, 3, -1.0)], edges.schema))
    with pytest.raises(Exception, match="weight must be"):
        Network(nodes, bad).arcs().collect()
    assert Network(nodes, bad, drop_invalid=True).arcs().count() == 4
    with pytest.raises(ValueError):
        Network(nodes, edges.withColumn("t", F.lit(1.0))).arcs()
    with pytest.raises(ValueError):
        Network(nodes, edges).arcs("nothing")


def test_string_ids(spark):
    nodes = spark.createDataFrame([(f"n{k}", x, y) for k, x, y in NODES], "node_id string, x double, y double")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", d) for a, b, d, _ in EDGES], "from string, to string, w double")
    for strategy in ("arrow", "tiles"):
        assert reach(Network(nodes, edges), 2, strategy=strategy).count() == 52
    pairs = spark.createDataFrame([("n0", "n8")], "origin string, destination string")
    assert shortest_paths(Network(nodes, edges), pairs).first().path[0] == "n0"


def test_snap(spark, grid):
    points = spark.createDataFrame(
        [(1, 1.1, 1.0), (2, 1.5, 1.0), (3, 900.0, -4000.0), (4, None, 1.0), (5, float("nan"), 1.0), (6, 1.1, 1.0), (7, 2.5, 2.5)], "p int, x double, y double"
    )
    found = {r.p: (r.node_id, round(r.distance, 6)) for r in nearest_node(grid, points).collect()}
    assert found[1] == (0, 0.1) and found[6] == (0, 0.1) and found[2] == (0, 0.5) and found[7][0] == 5
    assert found[3][0] == 3 and set(found) == {1, 2, 3, 6, 7}
    assert {r.p for r in nearest_node(grid, points, max_distance=0.5).collect()} == {1, 2, 6}
    assert nearest_node(grid, points.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nearest_node(grid, points.withColumn("node_id", F.lit(1)))


def test_snap_against_brute_force(spark):
    rng = random.Random(3)
    nodes = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(300)]
    points = [(k, rng.uniform(-6, 6), rng.uniform(-6, 6)) for k in range(200)]
    network = Network(spark.createDataFrame(nodes, "node_id bigint, x double, y double"), spark.createDataFrame([(0, 1, 1.0)], "from bigint, to bigint, w double"))
    found = {r.p: r.node_id for r in nearest_node(network, spark.createDataFrame(points, "p bigint, x double, y double")).collect()}
    assert found == {p: min((((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in nodes)[1] for p, x, y in points}


def test_tables(spark, grid, values):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "from bigint, to bigint")
    assert {tuple(r) for r in adjacency_counts(edges).collect()} == {(1, 2, 2), (2, 3, 1)}
    matrix = [tuple(r) for r in adjacency_matrix(edges).collect()]
    assert matrix == [(1, 0, 2, 0), (2, 0, 0, 1), (3, 0, 0, 0)]
    with pytest.raises(ValueError):
        adjacency_matrix(edges, max_nodes=2)
    keys = spark.createDataFrame([(1, 44), (2, 55), (3, 33), (4, 22), (5, 11), (6, None)], "idx int, key bigint")
    found = {r.idx: r.value for r in reindex(spark.createDataFrame([(11 * k, 10 * k) for k in range(1, 6)], "key bigint, value bigint"), keys).collect()}
    assert found == {1: 40, 2: 50, 3: 30, 4: 20, 5: 10, 6: None}
    assert tuple(grid.bbox.first()) == (1.0, 1.0, 4.0, 3.0)
    drawn = plot_data(grid, values, (1, 1, 3, 3))
    assert drawn.count() == 5
    assert binned(drawn, 2.0, "sum").agg(F.sum("n")).first()[0] == 5


def dijkstra(arcs, start, radius):
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in arcs.get(u, []):
            if d + w <= radius and d + w < best.get(v, radius + 1):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 9)), min_size=1, max_size=30), st.integers(0, 30))
def test_search_equals_dijkstra(raw, radius):
    cheapest = {}
    for a, b, w in raw:
        if a != b:
            cheapest[a, b] = min(w, cheapest.get((a, b), w))
    if not cheapest:
        return
    graph = Graph(*np.array([(a, b, w) for (a, b), w in cheapest.items()]).T)
    arcs = {}
    for (a, b), w in cheapest.items():
        arcs.setdefault(a, []).append((b, w))
    which, node, cost = graph.search(np.arange(len(graph.ids)), radius)
    found = {}
    for k, n, c in zip(which, node, cost):
        found.setdefault(graph.ids[k], {})[graph.ids[n]] = c
    assert found == {s: dijkstra(arcs, s, radius) for s in graph.ids}
    every = np.arange(len(graph.ids))
    costs_of = graph.all_costs(every)
    for s in every:
        whole = dijkstra(arcs, graph.ids[s], 10**9)
        assert {graph.ids[n]: c for n, c in enumerate(costs_of[:, s]) if c < UNBOUNDED} == whole
    # the two nearest of some places, of which costs run from the place
    places = every[::3]
    node, place, cost = graph.nearest(places, 2, radius)
    by_node = {}
    for n, p, c in zip(node, place, cost):
        by_node.setdefault(n, []).append((c, p))
    expected = {n: sorted((found[graph.ids[p]][graph.ids[n]], p) for p in places if graph.ids[n] in found[graph.ids[p]])[:2] for n in every}
    assert {n: sorted(v) for n, v in by_node.items()} == {n: v for n, v in expected.items() if v}


def test_one_object_for_all(spark, grid, tmp_path):
    whole = Accessibility(grid)
    assert whole.bbox == [1.0, 1.0, 4.0, 3.0] and whole.node_ids.count() == 12
    rows = spark.createDataFrame([(0, 10.0), (0, 20.0), (2, 30.0)], "n bigint, v double")
    whole.set(rows, "n", "v", "income")
    whole.set(rows, "n")
    assert whole.variable_names == {"income", "tmp"}
    whole.precompute(3)
    sums = {r.node_id: r.value for r in whole.aggregate(2, "sum", "flat", "distance", "income").collect()}
    ones = {r.node_id: r.value for r in whole.aggregate(2, "count", imp_name="distance").collect()}
    assert sums[0] == 30 and sums[1] == 30 and ones[0] == 2 and ones[11] == 0
    sources = spark.createDataFrame([(0,)], "node_id bigint")
    for radius in (2, 50):  # from the cache, and beyond it
        lengths = whole.shortest_path_lengths(whole.node_ids.select(F.lit(0).cast("bigint").alias("origin"), F.col("node_id").alias("destination")), "distance")
        within = lengths.where(F.col("length") <= radius).count()
        assert whole.nodes_in_range(sources, radius, "distance").count() == within
    points = spark.createDataFrame([("a", 2.1, 2.0), ("b", 2.0, 2.0), ("far", 90.0, 90.0)], "poi_id string, x double, y double")
    whole.set_pois("food", points, maxdist=10, maxitems=2, mapping_distance=1.0)
    wide = {r.node_id: tuple(r)[1:] for r in whole.nearest_pois(3, "food", 2, imp_name="distance", include_poi_ids=True).collect()}
    assert wide[0] == (2.0, 2.0, "a", "b") and wide[7] == (3.0, 3.0, None, None)
    for wrong in ({"category": "none"}, {"num_pois": 3}, {"distance": 11}):
        with pytest.raises(ValueError):
            whole.nearest_pois(**{"distance": 3, "category": "food", "imp_name": "distance", **wrong})
    with pytest.raises(ValueError):
        whole.aggregate(2, imp_name="distance", name="nothing")
    assert whole.shortest_path(0, 5, "distance") == [0, 4, 5] and whole.shortest_path_length(0, 5, "distance") == 2.0
    with pytest.warns(UserWarning):
        assert whole.shortest_path_length(0, 7, "distance") == UNREACHABLE
    pairs = spark.createDataFrame([(0, 7), (0, 5)], "origin bigint, destination bigint")
    assert whole.unreachable(whole.shortest_path_lengths(pairs, "distance")) == 1
    with pytest.warns(UserWarning, match="1 pairs"):
        whole.shortest_path_lengths(pairs, "distance", warn=True)
    whole.set(spark.createDataFrame([(0, 1.0), (0, None), (99, 1.0), (None, 1.0)], "n bigint, v double"), "n", "v", "gaps")
    assert whole.dropped("gaps") == 3 and whole.dropped("income") == 0
    with pytest.warns(DeprecationWarning):
        whole.init_pois(1, 2, 3)
    with pytest.warns(DeprecationWarning):
        reserve_num_graphs(1)
    whole.save(str(tmp_path / "n"), sources)
    assert Accessibility.load(spark, str(tmp_path / "n")).node_ids.count() == 11


def test_dense_numbers(spark, grid):
    ids = spark.createDataFrame([(k * 7,) for k in range(500)], "node_id bigint").withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    network = Network(ids.unionByName(ids.limit(9)), grid.edges_df)
    assert {r.node_id: r.node_idx for r in node_index(network).collect()} == {k * 7: k for k in range(500)}
    rows = spark.createDataFrame([("a", 14), ("b", None), ("c", 15)], "k string, end bigint")
    assert {r.k: r.node_idx for r in resolve_ids(network, rows, "end").collect()} == {"a": 2, "b": None, "c": None}
