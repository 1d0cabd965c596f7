"""Registered queries of the network operators.

The network is laid out over the customers: a grid of forty columns, edges to the right and down, weighted
by balances, with a second impedance ``time``. Orders are the variable, suppliers the points of interest. A
second network is the street network of the tables ``nodes_df`` and ``edges_df``.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.accessibility import Accessibility
from wayfold.operators.aggregate import aggregate, low_connectivity_nodes, variable
from wayfold.operators.nearest import nearest_pois, nearest_wide
from wayfold.operators.network import Network
from wayfold.operators.paths import shortest_path_lengths, shortest_paths
from wayfold.operators.reach import nodes_in_range, reach
from wayfold.operators.proximity import placed
from wayfold.operators.snap import nearest_node
from wayfold.operators.tables import adjacency_counts, adjacency_matrix, binned, node_index, plot_data, reindex, resolve_ids
from wayfold.session import ensure_checkpoint_dir, table
from wayfold.sources.network_io import network_from_csv, write_csv
from wayfold.sources.osm import element_records, network_from_elements, read_elements

COLUMNS = 40
RADIUS = 10.0
STREET_RADIUS = 800.0
POI_RADIUS = 2000.0
#: Elements in each of the files of json_network.
ELEMENTS_PER_FILE = 20_000
#: Categories of suppliers, by nation.
CATEGORIES = 3


def grid_network(spark: SparkSession, d: str, twoway: bool = True) -> Network:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.abs("c_acctbal").alias("b"))
    nodes = customers.select(
        F.col("k").alias("node_id"), (F.col("k") % COLUMNS).cast("double").alias("x"), F.floor(F.col("k") / COLUMNS).cast("double").alias("y")
    )
    ways = F.inline(F.array(
        F.struct((F.col("k") + 1).alias("to"), (1 + F.col("b") / 2000).alias("distance")),
        F.struct((F.col("k") + COLUMNS).alias("to"), (1 + F.col("b") / 3000).alias("distance")),
    ))
    edges = customers.select(F.col("k").alias("from"), ways).where(
        (F.col("to") - F.col("from") != 1) | (F.col("from") % COLUMNS != COLUMNS - 1)
    )
    timed = edges.withColumn("time", 0.5 + F.col("from") % 7)
    return Network(nodes, timed, ["distance", "time"], twoway)


def street_network(spark: SparkSession, d: str) -> Network:
    nodes = table(spark, d, "nodes_df").where(placed(F.col("x"), F.col("y"))).groupBy("node_id").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y"))
    edges = table(spark, d, "edges_df").select("from", "to", "distance")
    return Network(nodes, edges, ["distance"], drop_invalid=True)


def _orders(network: Network, spark: SparkSession, d: str) -> DataFrame:
    return variable(network, table(spark, d, "orders"), "o_custkey", "o_totalprice")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").agg(F.floor(F.max("c_custkey") / COLUMNS) + 1).scalar()
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("poi_id"), F.col("s_nationkey"), ((s * 37) % COLUMNS + 0.3).alias("px"), ((s * 13) % rows + 0.2).alias("py")
    )


def _pois(network: Network, spark: SparkSession, d: str) -> DataFrame:
    return nearest_node(network, _suppliers(spark, d), "px", "py").select("poi_id", "node_id", (F.col("s_nationkey") % CATEGORIES).alias("category"))


#: Added before rounding, so that halves of a cent go up in any order of summing.
NUDGE = 1e-7


def _aggregated(kind: str, decay: str = "flat", impedance: str = "distance", radius: float = RADIUS, strategy: str = "auto"):
    def query(spark: SparkSession, d: str) -> DataFrame:
        network = grid_network(spark, d)
        found = aggregate(network, _orders(network, spark, d), radius, kind, decay, impedance, strategy=strategy)
        return found.select("node_id", F.round(F.col("value") + NUDGE, 2).alias("value"))

    query.__doc__ = f"{kind} of order totals within reach of each node, {decay} decay, by {impedance}."
    return query


def arcs(spark: SparkSession, d: str) -> DataFrame:
    return grid_network(spark, d).arcs("distance")


def arcs_oneway(spark: SparkSession, d: str) -> DataFrame:
    return grid_network(spark, d, twoway=False).arcs("distance")


def _reached(strategy: str = "auto", twoway: bool = True, impedance: str = "distance"):
    return lambda spark, d: reach(grid_network(spark, d, twoway), RADIUS, impedance, strategy=strategy)


def q_nodes_in_range(spark: SparkSession, d: str) -> DataFrame:
    sources = _pois(grid_network(spark, d), spark, d).select("node_id")
    return nodes_in_range(grid_network(spark, d), sources, RADIUS, "distance")


def low_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return low_connectivity_nodes(grid_network(spark, d), RADIUS, 25, "distance")


def _snapped(max_distance: float | None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = nearest_node(grid_network(spark, d), _suppliers(spark, d), "px", "py", max_distance)
        return found.select("poi_id", "node_id", F.round("distance", 6).alias("distance"))

    return query


def nearest_poi_k1(spark: SparkSession, d: str) -> DataFrame:
    network = grid_network(spark, d)
    return nearest_pois(network, _pois(network, spark, d), 30.0, 1, "distance").select("node_id", "distance", "poi_id")


def _nearest_three(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        network = grid_network(spark, d)
        return nearest_pois(network, _pois(network, spark, d), 20.0, 3, "distance", strategy=strategy)

    return query


def nearest_poi_fill(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest suppliers of category 1 for each node."""
    network = grid_network(spark, d)
    return _filled(network, _pois(network, spark, d), 1)


def nearest_poi_fill_all(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest suppliers of every category for each node."""
    network = grid_network(spark, d)
    pois = _pois(network, spark, d)
    each = [_filled(network, pois, c).select(F.lit(c).alias("category"), "*") for c in range(CATEGORIES)]
    return reduce(DataFrame.unionByName, each)


def _filled(network: Network, pois: DataFrame, category: int) -> DataFrame:
    mine = pois.where(F.col("category") == category)
    wide = nearest_wide(network, nearest_pois(network, mine, RADIUS, 2, "distance"), 2, RADIUS, True)
    return wide.select("node_id", F.col("1").alias("d1"), F.col("2").alias("d2"), "poi1", "poi2")


def _pairs(spark: SparkSession, d: str, dx: int, dy: int) -> DataFrame:
    """From each supplier's node to the node so many columns and rows further."""
    pois = _pois(grid_network(spark, d), spark, d)
    return pois.select(
        "poi_id", F.col("node_id").alias("origin"), (F.col("node_id") + dx + dy * COLUMNS).alias("destination")
    )


def _lengths(strategy: str):
    return lambda spark, d: shortest_path_lengths(grid_network(spark, d), _pairs(spark, d, 5, 3), "distance", strategy=strategy)


def od_unreachable(spark: SparkSession, d: str) -> DataFrame:
    return shortest_path_lengths(grid_network(spark, d, twoway=False), _pairs(spark, d, -2, 3), "distance")


def od_path(spark: SparkSession, d: str) -> DataFrame:
    return shortest_paths(grid_network(spark, d), _pairs(spark, d, 5, 3), "distance")


def od_path_cost(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    """Cost and ends of each route, added up along its arcs."""
    network = grid_network(spark, d)
    paths = shortest_paths(network, _pairs(spark, d, 5, 3), "distance", strategy).where(F.size("path") > 0)
    steps = paths.select(
        "origin", "destination",
        F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path")).alias("dst"))).alias("s"),
    ).select("origin", "destination", "s.src", "s.dst")
    return steps.join(network.arcs("distance"), ["src", "dst"]).groupBy("origin", "destination").agg(F.sum("cost").alias("cost"))


def remove_nodes_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = _without(spark, d)
    return kept.edges_df.select("from", "to", F.round("distance", 6).alias("distance"))


def _without(spark: SparkSession, d: str) -> Network:
    return grid_network(spark, d).remove_nodes(table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("node_id")))


def remove_nodes_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _without(spark, d).nodes_df


def q_node_index(spark: SparkSession, d: str) -> DataFrame:
    return node_index(street_network(spark, d))


def q_resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    """Starts of edges as dense numbers of street nodes, null where unknown."""
    ends = table(spark, d, "edges_df").select("edge_id", F.col("from").alias("end"))
    return resolve_ids(street_network(spark, d), ends, "end")


def resolve_ids_all(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of edges as dense numbers of street nodes, null where unknown."""
    ends = table(spark, d, "edges_df").select("edge_id", F.inline(F.array(
        F.struct(F.lit("from").alias("side"), F.col("from").alias("end")), F.struct(F.lit("to").alias("side"), F.col("to").alias("end"))
    )))
    return resolve_ids(street_network(spark, d), ends, "end")


def q_adjacency_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "edges_df").select("from", "to")
    return adjacency_counts(pairs)


def q_reindex(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    values = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return reindex(values, keys)


def reindex_all(spark: SparkSession, d: str) -> DataFrame:
    """The segment of each order's customer, over all customers."""
    keys = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return reindex(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), keys)


def bbox(spark: SparkSession, d: str) -> DataFrame:
    return street_network(spark, d).bbox


def osm_elements(spark: SparkSession, d: str) -> DataFrame:
    return element_records(table(spark, d, "nodes").select("id", "lat", "lon", "tags").dropDuplicates(["id"]), ["amenity", "highway", "created_by"])


def plot_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean order total per bin of ten by ten, within a box."""
    network = grid_network(spark, d)
    drawn = plot_data(network, _orders(network, spark, d), (5.0, 2.0, 34.0, 1e9))
    return binned(drawn, 10.0).select("bx", "by", F.round(F.col("value") + NUDGE, 2).alias("value"), "n")


def street_reach_count(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the street network within reach of each node, and the cost to the farthest."""
    return reach(street_network(spark, d), STREET_RADIUS).groupBy("source").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("cost").alias("farthest")
    )


def street_median_income(spark: SparkSession, d: str) -> DataFrame:
    network = street_network(spark, d)
    incomes = table(spark, d, "initialize_acc_var").where("category = 'income'").select("node_idx", "values")
    return aggregate(network, variable(network, incomes, "node_idx", "values"), STREET_RADIUS, "median")


def street_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest nodes with waiting times of each street node, each by its smallest observation."""
    network = street_network(spark, d)
    points = table(spark, d, "initialize_acc_var").where("category = 'wait_s' AND node_idx IS NOT NULL").groupBy(
        F.col("node_idx").alias("node_id")
    ).agg(F.min("obs_id").alias("poi_id"))
    return nearest_pois(network, points, STREET_RADIUS, 3)


def street_nearest_all(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest observations of waiting times of each street node; those of one node are points each."""
    points = table(spark, d, "initialize_acc_var").where("category = 'wait_s' AND node_idx IS NOT NULL").select(
        F.col("node_idx").alias("node_id"), F.col("obs_id").alias("poi_id")
    ).distinct()
    return nearest_pois(street_network(spark, d), points, STREET_RADIUS, 3)


def _whole(spark: SparkSession, d: str) -> Accessibility:
    """The network with a variable and points of interest registered on it."""
    whole = Accessibility(grid_network(spark, d))
    whole.set(table(spark, d, "orders"), "o_custkey", "o_totalprice", "spent")
    whole.set_pois("suppliers", _suppliers(spark, d), "px", "py")
    return whole


def api_sum_precomputed(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a named variable, served from reach computed ahead for a larger radius."""
    whole = _whole(spark, d)
    whole.precompute(RADIUS + 2)
    return whole.aggregate(RADIUS, "sum", "flat", "distance", "spent").select("node_id", F.round(F.col("value") + NUDGE, 2).alias("value"))


def api_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest point of a named category of each node, ``RADIUS`` where there is none."""
    found = _whole(spark, d).nearest_pois(RADIUS, "suppliers", 1, imp_name="distance", include_poi_ids=True)
    return found.select("node_id", F.col("1").alias("d1"), "poi1")


def api_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs have no way, counted by the object for the whole network."""
    whole = Accessibility(grid_network(spark, d, twoway=False))
    lengths = whole.shortest_path_lengths(_pairs(spark, d, -2, 3), "distance")
    return spark.createDataFrame([(whole.unreachable(lengths),)], "pairs bigint")


def api_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that the object knows: aggregations, decays, variables, categories, impedances."""
    whole = _whole(spark, d)
    names = {
        "aggregation": whole.aggregations, "decay": whole.decays, "variable": whole.variable_names, "category": whole.poi_category_names,
        "impedance": whole.network.impedance_names,
    }
    return spark.createDataFrame([(what, name) for what, each in names.items() for name in each], "what string, name string")


def _stored(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def saved_network(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the network after it was saved without some nodes and loaded again."""
    path = _stored(spark, "network")
    gone = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("node_id"))
    Accessibility(grid_network(spark, d)).save(path, gone)
    return Accessibility.load(spark, path).network.edges_df.select("from", "to", F.round("distance", 6).alias("distance"))


def csv_network(spark: SparkSession, d: str) -> DataFrame:
    """Arcs of the street network after a round trip through CSV files."""
    network, path = street_network(spark, d), _stored(spark, "csv")
    write_csv(network.nodes_df, f"{path}/nodes")
    write_csv(network.edges_df.where(F.col("distance") >= 0), f"{path}/edges")
    return network_from_csv(spark, f"{path}/nodes", f"{path}/edges", ["distance"]).arcs()


def json_network(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a network made of JSON elements: the street nodes in degrees, and each street as a way."""
    path = _stored(spark, "elements")
    nodes = table(spark, d, "nodes").where(placed(F.col("lat"), F.col("lon"))).select(
        F.lit("node").alias("type"), "id", F.col("lat").cast("double"), F.col("lon").cast("double"), F.lit(None).cast("array<bigint>").alias("nodes"), "tags"
    ).dropDuplicates(["id"])
    next_id = F.lead("id").over(Window.partitionBy(F.floor(F.col("lat") * 50), F.floor(F.col("lon") * 50)).orderBy("id"))
    ways = nodes.select(F.lit("way").alias("type"), (-F.col("id")).alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
                        F.array(F.col("id"), next_id).alias("nodes"), "tags").where(F.col("nodes")[1].isNotNull())
    elements = nodes.unionByName(ways)
    files = elements.count() // ELEMENTS_PER_FILE + 1
    as_answers = elements.groupBy(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file")).agg(F.collect_list(F.struct("type", "id", "lat", "lon", "nodes", "tags")).alias("elements"))
    as_answers.write.partitionBy("file").json(path)
    edges = network_from_elements(read_elements(spark, path)).edges_df
    return edges.select("from", "to", F.round("distance", 3).alias("distance"))


def q_adjacency_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The square matrix of orders of regions' nations: one row and one column for each region or nation key."""
    return adjacency_matrix(table(spark, d, "nation").select(F.col("n_regionkey").alias("from"), F.col("n_nationkey").alias("to")))


_AGGREGATES = {
    "agg_sum_flat": ("sum", "flat"), "agg_sum_linear": ("sum", "linear"), "agg_sum_exp": ("sum", "exp"),
    "agg_mean_flat": ("mean", "flat"), "agg_mean_linear": ("mean", "linear"), "agg_mean_exp": ("mean", "exp"),
    "agg_std": ("std", "flat"), "agg_count": ("count", "flat"), "agg_min": ("min", "flat"), "agg_25pct": ("25pct", "flat"),
    "agg_median": ("median", "flat"), "agg_75pct": ("75pct", "flat"), "agg_max": ("max", "flat"),
}

QUERIES = {
    "arcs": arcs, "arcs_oneway": arcs_oneway, "reach": _reached(), "reach_arrow": _reached("arrow"),
    "reach_tiles": _reached("tiles"), "reach_oneway": _reached(twoway=False), "reach_time": _reached(impedance="time"),
    **{name: _aggregated(*how) for name, how in _AGGREGATES.items()},
    "agg_sum_time": _aggregated("sum", "flat", "time"), "agg_alias": _aggregated("MED"),
    "low_connectivity": low_connectivity, "nodes_in_range": q_nodes_in_range,
    "snap": _snapped(None), "snap_max_distance": _snapped(0.3606),
    "nearest_poi_k1": nearest_poi_k1, "nearest_poi_k3_ids": _nearest_three("auto"), "nearest_tiles": _nearest_three("tiles"),
    **{f"{name}_tiles": _aggregated(*_AGGREGATES[name], strategy="tiles") for name in ("agg_sum_exp", "agg_std", "agg_median")},
    "agg_median_join": _aggregated("median", strategy="join"),
    "api_sum_precomputed": api_sum_precomputed, "api_nearest": api_nearest, "api_unreachable": api_unreachable, "api_names": api_names,
    "saved_network": saved_network, "csv_network": csv_network, "json_network": json_network, "adjacency_matrix": q_adjacency_matrix, "nearest_poi_fill": nearest_poi_fill,
    "od_length": _lengths("auto"), "od_length_tiles": _lengths("tiles"), "od_path_cost_tiles": partial(od_path_cost, strategy="tiles"), "od_unreachable": od_unreachable, "od_path_cost": od_path_cost, "od_path": od_path,
    "remove_nodes_edges": remove_nodes_edges, "remove_nodes_nodes": remove_nodes_nodes,
    "node_index": q_node_index, "resolve_ids": q_resolve_ids, "adjacency_counts": q_adjacency_counts, "reindex": q_reindex, "bbox": bbox, "osm_elements": osm_elements, "plot_bins": plot_bins,
    "street_reach_count": street_reach_count, "street_median_income": street_median_income, "street_nearest": street_nearest,
    "street_nearest_all": street_nearest_all, "nearest_poi_fill_all": nearest_poi_fill_all, "resolve_ids_all": resolve_ids_all, "reindex_all": reindex_all,
}

_GRID = f"""
gnodes AS (SELECT c_custkey AS node_id, CAST(c_custkey % {COLUMNS} AS DOUBLE) AS x, CAST(c_custkey // {COLUMNS} AS DOUBLE) AS y FROM customer),
gedges AS (
  SELECT c_custkey AS f, c_custkey + 1 AS t, 1 + abs(c_acctbal) / 2000 AS distance, 0.5 + c_custkey % 7 AS time FROM customer WHERE c_custkey % {COLUMNS} <> {COLUMNS - 1}
  UNION ALL SELECT c_custkey, c_custkey + {COLUMNS}, 1 + abs(c_acctbal) / 3000, 0.5 + c_custkey % 7 FROM customer),
gknown AS (SELECT * FROM gedges WHERE t IN (SELECT c_custkey FROM customer)),
grows AS (SELECT max(c_custkey) // {COLUMNS} + 1 AS n FROM customer),
sup AS (SELECT s_suppkey AS poi_id, s_nationkey, (s_suppkey * 37) % {COLUMNS} + 0.3 AS px, (s_suppkey * 13) % (SELECT n FROM grows) + 0.2 AS py FROM supplier),
near AS (SELECT poi_id, s_nationkey, node_id, sqrt((px - x) ** 2 + (py - y) ** 2) AS d FROM sup, gnodes WHERE abs(px - x) <= 50 AND abs(py - y) <= 2),
snapped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY round(d, 9), node_id) AS k FROM near) WHERE k = 1)"""


def _arcs_sql(weight: str = "distance", twoway: bool = True, edges: str = "gknown") -> str:
    cost = f"greatest(CAST(trunc({weight} * 1000) AS BIGINT), 1)"
    back = f" UNION ALL SELECT t, f, {cost} FROM {edges}" if twoway else ""
    return f"arcs AS (SELECT src, dst, min(cost) AS cost FROM (SELECT f AS src, t AS dst, {cost} AS cost FROM {edges}{back}) WHERE src <> dst GROUP BY ALL)"


def _reach_sql(radius: float, sources: str = "SELECT node_id FROM gnodes", reverse: bool = False) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"""reach(source, destination, cost) USING KEY (source, destination) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT) FROM ({sources})
  UNION
  SELECT r.source, a.{b}, min(r.cost + a.cost) FROM reach r JOIN arcs a ON a.{a} = r.destination
  LEFT JOIN recurring.reach k ON k.source = r.source AND k.destination = a.{b}
  WHERE r.cost + a.cost <= {int(radius * 1000)} AND (k.cost IS NULL OR r.cost + a.cost < k.cost) GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _grid_sql(*parts: str) -> str:
    return _with(_GRID, *parts)


def _aggregate_sql(kind: str, decay: str, weight: str = "distance") -> str:
    w = {"flat": "1", "linear": f"(1 - cost / 1000.0 / {RADIUS})", "exp": f"exp(-(cost / 1000.0) / {RADIUS})"}[decay]
    nth = lambda q: f"list_sort(list(v))[CAST(floor(count(v) * {q}) AS BIGINT) + 1]"
    how = {
        "sum": f"sum({w} * v)", "mean": f"sum({w} * v) / count(v)", "std": "stddev_pop(v)", "count": "CAST(count(v) AS DOUBLE)", "min": "min(v)", "max": "max(v)",
        "25pct": nth(0.25), "median": nth(0.5), "75pct": nth(0.75),
    }[kind]
    missing = "0.0" if kind in ("sum", "mean", "std", "count") else "-1.0"
    return _grid_sql(_arcs_sql(weight), _reach_sql(RADIUS)) + f"""
SELECT node_id, round(coalesce(value, {missing}) + {NUDGE:.7f}, 2) AS value FROM gnodes LEFT JOIN (
  SELECT source, {how} AS value FROM reach JOIN (SELECT o_custkey, o_totalprice AS v FROM orders) ON o_custkey = destination GROUP BY source
) ON source = node_id"""


def _nearest_sql(radius: float, k: int, where: str = "true") -> str:
    pois = f"SELECT DISTINCT node_id FROM snapped WHERE {where}"
    return _grid_sql(_arcs_sql(), _reach_sql(radius, pois, reverse=True)) + f""", found AS (
  SELECT destination AS node_id, row_number() OVER (PARTITION BY destination ORDER BY cost, source, poi_id) AS rank, cost / 1000.0 AS distance, poi_id
  FROM reach JOIN snapped s ON s.node_id = source WHERE {where})
"""


def _od_sql(dx: int, dy: int, twoway: bool = True) -> str:
    pairs = f"pairs AS (SELECT poi_id, node_id AS origin, node_id + {dx + dy * COLUMNS} AS destination FROM snapped)"
    return _grid_sql(pairs, _arcs_sql(twoway=twoway), _reach_sql(1e6, "SELECT DISTINCT origin AS node_id FROM pairs"))


_STREET = """snodes AS (SELECT node_id, min(x) AS x, min(y) AS y FROM nodes_df WHERE NOT isnan(x) AND NOT isnan(y) GROUP BY node_id),
sedges AS (SELECT "from" AS f, "to" AS t, distance FROM edges_df WHERE distance >= 0 AND NOT isnan(distance)
           AND "from" IN (SELECT node_id FROM snodes) AND "to" IN (SELECT node_id FROM snodes))"""
_STREET_REACH = (_STREET, _arcs_sql(edges="sedges"), _reach_sql(STREET_RADIUS, "SELECT node_id FROM snodes"))

_MATRIX_KEYS = range(25)
ORACLE_SQL = {
    "adjacency_matrix": "SELECT k AS node, " + ", ".join(f'count(*) FILTER (n_nationkey = {k}) AS "{k}"' for k in _MATRIX_KEYS)
    + " FROM (SELECT unnest(range(25)) AS k) LEFT JOIN nation ON n_regionkey = k GROUP BY k",
    "arcs": _grid_sql(_arcs_sql()) + "SELECT * FROM arcs",
    "arcs_oneway": _grid_sql(_arcs_sql(twoway=False)) + "SELECT * FROM arcs",
    **{n: _grid_sql(_arcs_sql(), _reach_sql(RADIUS)) + "SELECT * FROM reach" for n in ("reach", "reach_arrow", "reach_tiles")},
    "reach_oneway": _grid_sql(_arcs_sql(twoway=False), _reach_sql(RADIUS)) + "SELECT * FROM reach",
    "reach_time": _grid_sql(_arcs_sql("time"), _reach_sql(RADIUS)) + "SELECT * FROM reach",
    **{name: _aggregate_sql(*how) for name, how in _AGGREGATES.items()},
    "agg_sum_time": _aggregate_sql("sum", "flat", "time"),
    "agg_alias": _aggregate_sql("median", "flat"),
    "low_connectivity": _grid_sql(_arcs_sql(), _reach_sql(RADIUS)) + "SELECT source AS node_id FROM reach GROUP BY source HAVING count(*) < 25",
    "nodes_in_range": _grid_sql(_arcs_sql(), _reach_sql(RADIUS, "SELECT DISTINCT node_id FROM snapped"))
    + "SELECT source, destination, cost / 1000.0 AS distance FROM reach",
    "snap": _grid_sql() + "SELECT poi_id, node_id, round(d, 6) AS distance FROM snapped",
    "snap_max_distance": _grid_sql() + "SELECT poi_id, node_id, round(d, 6) AS distance FROM snapped WHERE d <= 0.3606",
    "nearest_poi_k1": _nearest_sql(30.0, 1) + "SELECT node_id, distance, poi_id FROM found WHERE rank = 1",
    **{f"{name}_tiles": _aggregate_sql(*_AGGREGATES[name]) for name in ("agg_sum_exp", "agg_std", "agg_median")},
    "agg_median_join": _aggregate_sql("median", "flat"),
    "api_sum_precomputed": _aggregate_sql("sum", "flat"),
    "api_nearest": _nearest_sql(RADIUS, 1) + f"""
SELECT n.node_id, coalesce(distance, {RADIUS}) AS d1, poi_id AS poi1 FROM gnodes n LEFT JOIN (SELECT * FROM found WHERE rank = 1) f ON f.node_id = n.node_id""",
    "api_unreachable": _od_sql(-2, 3, twoway=False) + """SELECT count(*) AS pairs
FROM pairs p LEFT JOIN reach r ON r.source = origin AND r.destination = p.destination WHERE r.cost IS NULL""",
    "api_names": "SELECT what, unnest(names) AS name FROM (VALUES ('aggregation', ['sum','mean','std','count','min','25pct','median','75pct','max']), "
    "('decay', ['flat','linear','exp','exponential']), ('variable', ['spent']), ('category', ['suppliers']), ('impedance', ['distance','time'])) v(what, names)",
    "saved_network": _with(_GRID) + """SELECT f AS "from", t AS "to", round(distance, 6) AS distance FROM gedges
WHERE f NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AND t NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""",
    "csv_network": _with(_STREET, _arcs_sql(edges="sedges")) + "SELECT * FROM arcs",
    "json_network": """
WITH p AS (SELECT id, any_value(lat) AS lat, any_value(lon) AS lon FROM nodes WHERE NOT isnan(lat) AND NOT isnan(lon) GROUP BY id),
w AS (SELECT id AS f, lat, lon, lead(id) OVER v AS t, lead(lat) OVER v AS lat2, lead(lon) OVER v AS lon2 FROM p WINDOW v AS (PARTITION BY floor(lat * 50), floor(lon * 50) ORDER BY id))
SELECT f AS "from", t AS "to", round(2 * 6371008.8 * asin(sqrt(sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2)), 3) AS distance
FROM w WHERE t IS NOT NULL""",
    "nearest_poi_k3_ids": _nearest_sql(20.0, 3) + "SELECT node_id, CAST(rank AS INT) AS rank, distance, poi_id FROM found WHERE rank <= 3",
    "nearest_poi_fill": _nearest_sql(RADIUS, 2, "s_nationkey % 3 = 1") + f"""
SELECT n.node_id, coalesce(max(distance) FILTER (rank = 1), {RADIUS}) AS d1, coalesce(max(distance) FILTER (rank = 2), {RADIUS}) AS d2,
       max(poi_id) FILTER (rank = 1) AS poi1, max(poi_id) FILTER (rank = 2) AS poi2
FROM gnodes n LEFT JOIN found f ON f.node_id = n.node_id GROUP BY n.node_id""",
    "od_length": _od_sql(5, 3) + """SELECT poi_id, origin, p.destination, cost / 1000.0 AS length
FROM pairs p LEFT JOIN reach r ON r.source = origin AND r.destination = p.destination""",
    "od_length_tiles": _od_sql(5, 3) + """SELECT poi_id, origin, p.destination, cost / 1000.0 AS length
FROM pairs p LEFT JOIN reach r ON r.source = origin AND r.destination = p.destination""",
    "od_path_cost_tiles": _od_sql(5, 3) + """SELECT DISTINCT origin, p.destination, cost
FROM pairs p JOIN reach r ON r.source = origin AND r.destination = p.destination""",
    "od_unreachable": _od_sql(-2, 3, twoway=False) + """SELECT poi_id, origin, p.destination, cost / 1000.0 AS length
FROM pairs p LEFT JOIN reach r ON r.source = origin AND r.destination = p.destination""",
    "od_path_cost": _od_sql(5, 3) + """SELECT DISTINCT origin, p.destination, cost
FROM pairs p JOIN reach r ON r.source = origin AND r.destination = p.destination""",
    "remove_nodes_edges": _with(_GRID) + """SELECT f AS "from", t AS "to", round(distance, 6) AS distance FROM gedges
WHERE f NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AND t NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""",
    "remove_nodes_nodes": _with(_GRID) + "SELECT * FROM gnodes WHERE node_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "node_index": _with(_STREET) + "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM snodes",
    "resolve_ids": _with(_STREET) + """SELECT edge_id, "from" AS "end", node_idx
FROM edges_df LEFT JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM snodes) ON node_id = "from" """,
    "nearest_tiles": _nearest_sql(20.0, 3) + "SELECT node_id, CAST(rank AS INT) AS rank, distance, poi_id FROM found WHERE rank <= 3",
    "adjacency_counts": 'SELECT "from", "to", count(*) AS n FROM edges_df GROUP BY ALL',
    "reindex": """SELECT o_custkey AS key, o_orderkey, c_mktsegment AS value
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey""",
    "bbox": _with(_STREET) + "SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM snodes",
    "osm_elements": """SELECT id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(tags['amenity']) AS amenity,
any_value(tags['highway']) AS highway, CAST(NULL AS VARCHAR) AS created_by FROM nodes GROUP BY id""",
    "plot_bins": _with(_GRID) + """SELECT CAST(floor(x / 10) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS "by", round(avg(o_totalprice) + 0.0000001, 2) AS value, count(*) AS n
FROM gnodes JOIN orders ON o_custkey = node_id WHERE x BETWEEN 5 AND 34 AND y >= 2 GROUP BY 1, 2""",
    "street_reach_count": _with(*_STREET_REACH) + "SELECT source, count(*) AS nodes, max(cost) AS farthest FROM reach GROUP BY source",
    "street_median_income": _with(*_STREET_REACH) + """SELECT node_id, coalesce(value, -1.0) AS value FROM snodes LEFT JOIN (
  SELECT source, list_sort(list(v))[CAST(floor(count(v) * 0.5) AS BIGINT) + 1] AS value FROM reach JOIN (
    SELECT node_idx, "values" AS v FROM initialize_acc_var WHERE category = 'income' AND NOT isnan("values")) ON node_idx = destination GROUP BY source
) ON source = node_id""",
    "street_nearest": _with(
        _STREET, "pts AS (SELECT node_idx AS node_id, min(obs_id) AS poi_id FROM initialize_acc_var WHERE category = 'wait_s' AND node_idx IN (SELECT node_id FROM snodes) GROUP BY 1)",
        _arcs_sql(edges="sedges"), _reach_sql(STREET_RADIUS, "SELECT node_id FROM pts", reverse=True),
    ) + """SELECT * FROM (SELECT destination AS node_id, CAST(row_number() OVER (PARTITION BY destination ORDER BY cost, source, poi_id) AS INT) AS rank,
  cost / 1000.0 AS distance, poi_id FROM reach JOIN pts ON pts.node_id = source) WHERE rank <= 3""",
    "street_nearest_all": _with(
        _STREET, "pts AS (SELECT DISTINCT node_idx AS node_id, obs_id AS poi_id FROM initialize_acc_var WHERE category = 'wait_s' AND node_idx IN (SELECT node_id FROM snodes))",
        _arcs_sql(edges="sedges"), _reach_sql(STREET_RADIUS, "SELECT DISTINCT node_id FROM pts", reverse=True),
    ) + """SELECT * FROM (SELECT destination AS node_id, CAST(row_number() OVER (PARTITION BY destination ORDER BY cost, source, poi_id) AS INT) AS rank,
  cost / 1000.0 AS distance, poi_id FROM reach JOIN pts ON pts.node_id = source) WHERE rank <= 3""",
    "nearest_poi_fill_all": _grid_sql(_arcs_sql(), _reach_sql(RADIUS, "SELECT DISTINCT node_id FROM snapped", reverse=True)) + f""", found AS (
  SELECT s_nationkey % 3 AS category, destination AS node_id, cost / 1000.0 AS distance, poi_id,
         row_number() OVER (PARTITION BY s_nationkey % 3, destination ORDER BY cost, source, poi_id) AS rank
  FROM reach JOIN snapped s ON s.node_id = source)
SELECT c.category, n.node_id, coalesce(max(distance) FILTER (rank = 1), {RADIUS}) AS d1, coalesce(max(distance) FILTER (rank = 2), {RADIUS}) AS d2,
       max(poi_id) FILTER (rank = 1) AS poi1, max(poi_id) FILTER (rank = 2) AS poi2
FROM gnodes n CROSS JOIN (VALUES (0), (1), (2)) c(category) LEFT JOIN found f ON f.node_id = n.node_id AND f.category = c.category GROUP BY ALL""",
    "resolve_ids_all": _with(_STREET) + """, ends AS (
  SELECT edge_id, 'from' AS side, "from" AS "end" FROM edges_df UNION ALL SELECT edge_id, 'to', "to" FROM edges_df)
SELECT edge_id, side, "end", node_idx
FROM ends LEFT JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM snodes) ON node_id = "end" """,
    "reindex_all": "SELECT o_custkey AS key, o_orderkey, c_mktsegment AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
