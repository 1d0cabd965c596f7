"""Map elements from JSON files as downloaded, the text of queries for nodes and streets, and a fetcher for their answers."""

from __future__ import annotations

import math
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators.network import Network

#: Tag keys that describe the mapping and not the element.
UNINTERESTING_TAGS = (
    "source", "source_ref", "source:ref", "history", "attribution", "created_by", "tiger:tlid", "tiger:upload_uuid",
)
ELEMENTS = (
    "elements array<struct<type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>>>"
)


#: Kinds of ways that are no streets for those on foot, and for cars, and the address of a public query service.
NO_STREETS = {
    "walk": ("abandoned", "bus_guideway", "construction", "cycleway", "motor", "motorway", "motorway_link", "planned", "platform", "proposed", "raceway"),
    "drive": ("abandoned", "bridleway", "bus_guideway", "construction", "corridor", "cycleway", "elevator", "escalator", "footway", "path", "pedestrian", "planned", "platform", "proposed", "raceway", "service", "steps", "track"),
}
FORBIDDEN = {"walk": ("foot", "pedestrians"), "drive": ("motor_vehicle", "motorcar")}
SERVICE = "https://overpass-api.de/api/interpreter"
#: Side of the largest area that one query asks for, in metres.
AREA_SIDE_M = 50_000.0
_METRES_PER_DEGREE = 6_371_008.8 * math.pi / 180


def way_query_text(
    lat_min: float, lng_min: float, lat_max: float, lng_max: float, network_type: str = "walk", timeout: int = 180, memory: int | None = None
) -> str:
    """The query for the streets in a box, and their nodes, for ``network_type`` 'walk' or 'drive'.

    ``timeout`` in seconds and ``memory`` in bytes are limits for the service.
    """
    if network_type not in NO_STREETS:
        raise ValueError(f"unknown network type {network_type!r}; known are {sorted(NO_STREETS)}")
    limits = f"[out:json][timeout:{timeout}]" + ("" if memory is None else f"[maxsize:{memory}]")
    kinds = f'["highway"]["highway"!~"^({"|".join(NO_STREETS[network_type])})$"]["area"!~"yes"]'
    allowed = "".join(f'["{tag}"!~"no"]' for tag in FORBIDDEN[network_type])
    return f"{limits};(way{kinds}{allowed}({lat_min},{lng_min},{lat_max},{lng_max});>;);out;"


def boxes(lat_min: float, lng_min: float, lat_max: float, lng_max: float, side: float = AREA_SIDE_M) -> list[tuple[float, float, float, float]]:
    """The box cut into as few equal boxes as have sides of at most ``side`` metres, row by row from the south west."""
    if not (lat_min < lat_max and lng_min < lng_max and side > 0):
        raise ValueError("a box needs a south below its north and a west before its east")
    near_equator = 0.0 if lat_min <= 0 <= lat_max else min(abs(lat_min), abs(lat_max))
    rows = math.ceil((lat_max - lat_min) * _METRES_PER_DEGREE / side)
    columns = math.ceil((lng_max - lng_min) * _METRES_PER_DEGREE * math.cos(math.radians(near_equator)) / side)
    lat = [lat_min + (lat_max - lat_min) * k / rows for k in range(rows)] + [lat_max]
    lng = [lng_min + (lng_max - lng_min) * k / columns for k in range(columns)] + [lng_max]
    return [(lat[r], lng[c], lat[r + 1], lng[c + 1]) for r in range(rows) for c in range(columns)]


def fetcher(folder: str, service: str = SERVICE, timeout: int = 180) -> Callable[[str], str]:
    """A function that asks ``service`` for a query and returns the path of the answer, a file in ``folder``.

    The folder must be one that executors can read. An answer that reports a failure raises.
    """
    def fetch(query: str) -> str:
        path = f"{folder}/answer-{uuid.uuid4().hex}.json"
        with urllib.request.urlopen(f"{service}?{urllib.parse.urlencode({'data': query})}", timeout=timeout) as answer, open(path, "wb") as file:
            while block := answer.read(1 << 20):
                file.write(block)
        return path

    return fetch


def street_network(
    spark: SparkSession, fetch: Callable[[str], str], lat_min: float, lng_min: float, lat_max: float, lng_max: float,
    network_type: str = "walk", two_way: bool = True, timeout: int = 180, memory: int | None = None, area_side: float = AREA_SIDE_M,
) -> Network:
    """The streets in a box as a network with the impedance ``distance`` in metres, asked for in areas of limited size.

    Elements that several areas return count once. Raises ``RuntimeError`` if there are none.
    """
    paths = [fetch(way_query_text(*box, network_type, timeout, memory)) for box in boxes(lat_min, lng_min, lat_max, lng_max, area_side)]
    elements = spark.read.schema(ELEMENTS).option("multiLine", True).json(paths).select(F.inline("elements")).dropDuplicates(["type", "id"])
    if elements.isEmpty():
        raise RuntimeError("the query returned no elements")
    return network_from_elements(elements, two_way)


def node_query_text(lat_min: float, lng_min: float, lat_max: float, lng_max: float, tags: str | Sequence[str] | None = None) -> str:
    """The query for nodes in a box, in the language of the map's query service; ``tags`` are filters such as 'amenity'."""
    wanted = [tags] if isinstance(tags, str) else list(tags or [])
    filters = "".join(f"[{t}]" for t in wanted)
    # fixed value: the text, blank for blank
    return f"[out:json];(  node  {filters}  ({lat_min},{lng_min},{lat_max},{lng_max}););out;"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(type, id, lat, lon, nodes, tags)`` from answers of the query service, one or many files."""
    return spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.inline("elements"))


def interesting_tags(tags: Column) -> Column:
    """``tags`` without the uninteresting ones; an empty map for null."""
    cleaned = F.map_filter(tags, lambda k, v: ~k.isin(*UNINTERESTING_TAGS))
    return F.coalesce(cleaned, F.create_map().cast("map<string,string>"))


def element_records(elements: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """``id, lat, lon`` and a column per tag; null where an element lacks it.

    Without ``keys``, ``tags`` stays one map, which suits data with very many keys.
    """
    rows = elements.select("id", "lat", "lon", interesting_tags(F.col("tags")).alias("tags"))
    if keys is None:
        return rows
    return rows.select("id", "lat", "lon", *[F.col("tags")[k].alias(k) for k in keys])


def node_query(
    spark: SparkSession, fetch: Callable[[str], str], lat_min: float, lng_min: float, lat_max: float, lng_max: float,
    tags: str | Sequence[str] | None = None, keys: Sequence[str] | None = None,
) -> DataFrame:
    """Records of the nodes in a box. ``fetch`` takes the query text and returns the path of the answer's JSON file.

    Raises ``RuntimeError`` if there are none.
    """
    found = element_records(read_elements(spark, fetch(node_query_text(lat_min, lng_min, lat_max, lng_max, tags))), keys)
    if found.isEmpty():
        raise RuntimeError("the query returned no elements")
    return found


def network_from_elements(elements: DataFrame, twoway: bool = True) -> Network:
    """A street network from node and way elements, with the impedance ``distance`` in metres along the sphere.

    Consecutive nodes of a way make an edge; ways that refer to nodes that are missing lose those edges.
    """
    nodes = elements.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y")
    ).dropDuplicates(["node_id"])
    along = Window.partitionBy("way").orderBy("pos")
    steps = elements.where(F.col("nodes").isNotNull()).select(
        F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "from")
    ).withColumn("to", F.lead("from").over(along)).where(F.col("to").isNotNull())
    a = nodes.select(F.col("node_id").alias("from"), F.radians("y").alias("ya"), F.radians("x").alias("xa"))
    b = nodes.select(F.col("node_id").alias("to"), F.radians("y").alias("yb"), F.radians("x").alias("xb"))
    h = F.pow(F.sin((F.col("yb") - F.col("ya")) / 2), 2) + F.cos("ya") * F.cos("yb") * F.pow(F.sin((F.col("xb") - F.col("xa")) / 2), 2)
    edges = steps.join(a, "from").join(b, "to").select("from", "to", (F.asin(F.sqrt(h)) * 2 * 6_371_008.8).alias("distance"))
    # ids of ways and edges' nodes live in one type
    return Network(nodes, edges, ["distance"], twoway)
