"""Which regions contain a point: trapezoidal decomposition, distributed by slabs.

1. The boundary of each region is cut into strips of about as many edges, and each strip at every vertex
   abscissa in it into slabs. Within a slab no edge begins or ends, so the edges are ordered; the space
   between the 1st and 2nd, 3rd and 4th ... is inside. These trapezoids are found with window functions.
2. Trapezoids are distributed over square tiles. The tile side is the power of two just above the
   region's extent, so a region touches four tiles at most, whatever its size; regions of very many edges
   get smaller tiles, so that no tile holds a coast in all its detail.
3. Points are sent to their tile (one per size level in use, if the tile has any trapezoid; hot tiles are
   split by salts) and stream by behind the tile's trapezoids. A point finds its slab and then its trapezoid
   by binary search. Where the regions of a tile overlap, each is searched by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.proximity import finite
from wayfold.operators.skew import hot_keys, repeat, spread
from wayfold.session import cut_lineage

_SIDES = ["lx1", "ly1", "lx2", "ly2", "ux1", "uy1", "ux2", "uy2"]
_TILE = ["level", "col", "row", "salt"]

#: A region with more edges than this is spread over strips and tiles of about as many.
EDGES_PER_TILE = 256
#: Tiles with trapezoids up to which their list is broadcast, to spare the others points; some 24 bytes each.
BROADCAST_TILES = 500_000


def ring_edges(rings: DataFrame) -> DataFrame:
    """Non-vertical edges ``(zone_id, x1, y1, x2, y2)``, ``x1 < x2``, of all rings, closing each ring.

    Vertices with a null or NaN field are left out; repeated vertices make edges of no length, which
    vanish. A ring given either way round, closed or not, yields the same edges.
    """
    along = Window.partitionBy("zone_id", "ring_no").orderBy("vertex_no", "lon", "lat")
    around = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (
        rings.select("zone_id", "ring_no", "vertex_no", F.col("lon").cast("double"), F.col("lat").cast("double"))
        .where(F.col("zone_id").isNotNull() & finite(F.col("lon"), F.col("lat")))
        .select(
            "zone_id",
            F.col("lon").alias("x"),
            F.col("lat").alias("y"),
            F.coalesce(F.lead("lon").over(along), F.first("lon").over(around)).alias("nx"),
            F.coalesce(F.lead("lat").over(along), F.first("lat").over(around)).alias("ny"),
        )
        .where(F.col("x") != F.col("nx"))
    )
    forward = F.col("x") < F.col("nx")
    return ends.select(
        "zone_id",
        F.least("x", "nx").alias("x1"),
        F.when(forward, F.col("y")).otherwise(F.col("ny")).alias("y1"),
        F.greatest("x", "nx").alias("x2"),
        F.when(forward, F.col("ny")).otherwise(F.col("y")).alias("y2"),
    )


def trapezoids(rings: DataFrame) -> DataFrame:
    """Regions as disjoint trapezoids: ``zone_id``, the slab ``xl`` .. ``xr``, lower and upper edge, tile ``level``."""
    whole = ring_edges(rings)
    extent = whole.groupBy("zone_id").agg(
        F.min("x1").alias("west"), (F.max("x2") - F.min("x1")).alias("w"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"), F.count(F.lit(1)).alias("n"),
    )
    # a strip for each so many edges, numbered from the west
    strips = F.greatest(F.floor(F.col("n") / EDGES_PER_TILE), F.lit(1))
    bound = lambda k: F.col("west") + F.col("w") * k / F.col("strips")
    number = lambda x: F.least(F.greatest(F.floor((x - F.col("west")) / F.col("w") * F.col("strips")), F.lit(0)), F.col("strips") - 1)
    edges = (
        whole.join(extent.select("zone_id", "west", "w", strips.alias("strips")), "zone_id")
        .withColumn("strip", F.explode(F.sequence(F.greatest(number(F.col("x1")) - 1, F.lit(0)), F.least(number(F.col("x2")) + 1, F.col("strips") - 1))))
        .withColumn("from", F.when(F.col("strip") > 0, F.greatest("x1", bound(F.col("strip")))).otherwise(F.col("x1")))
        .withColumn("to", F.when(F.col("strip") < F.col("strips") - 1, F.least("x2", bound(F.col("strip") + 1))).otherwise(F.col("x2")))
        .where(F.col("from") < F.col("to")).drop("west", "w", "strips")
    )
    vertices = edges.select("zone_id", "strip", F.explode(F.array("from", "to")).alias("x")).distinct()
    in_strip = Window.partitionBy("zone_id", "strip").orderBy("x")
    slabs = vertices.select(
        "zone_id", "strip",
        F.row_number().over(in_strip).alias("slab"),
        F.col("x").alias("xl"),
        F.lead("x").over(in_strip).alias("xr"),
    )
    first, last = slabs.select("zone_id", "strip", F.col("xl").alias("from"), F.col("slab").alias("s1")), slabs.select(
        "zone_id", "strip", F.col("xl").alias("to"), F.col("slab").alias("s2")
    )
    pieces = (
        edges.join(first, ["zone_id", "strip", "from"])
        .join(last, ["zone_id", "strip", "to"])
        .withColumn("slab", F.explode(F.sequence(F.col("s1"), F.col("s2") - 1)))
        .join(slabs, ["zone_id", "strip", "slab"])
    )

    def height(x):
        return F.col("y1") + (F.col("y2") - F.col("y1")) * ((x - F.col("x1")) / (F.col("x2") - F.col("x1")))

    upwards = Window.partitionBy("zone_id", "strip", "slab").orderBy("y_mid", "x1", "y1", "x2", "y2")
    ordered = pieces.withColumn("y_mid", height((F.col("xl") + F.col("xr")) / 2)).select(
        "*",
        F.row_number().over(upwards).alias("rank"),
        *[F.lead(c).over(upwards).alias(f"u{c}") for c in ("x1", "y1", "x2", "y2")],
    )
    inside = ordered.where((F.col("rank") % 2 == 1) & F.col("ux1").isNotNull()).select(
        "zone_id", "xl", "xr", *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")], "ux1", "uy1", "ux2", "uy2"
    )
    finer = F.floor(F.log2(F.greatest(F.col("n") / EDGES_PER_TILE, F.lit(1.0))) / 2)
    level = (F.ceil(F.log2(F.greatest("w", "h", F.lit(1e-9)))) - finer).cast("int").alias("level")
    return inside.join(extent.select("zone_id", level), "zone_id")


def _tiled(traps: DataFrame) -> DataFrame:
    side = F.pow(F.lit(2.0), F.col("level"))
    pad = side * 1e-9
    low = F.least("ly1", "ly2")
    high = F.greatest("uy1", "uy2")
    cells = lambda a, b: F.explode(F.sequence(F.floor((a - pad) / side), F.floor((b + pad) / side)))
    return traps.withColumn("col", cells(F.col("xl"), F.col("xr"))).withColumn("row", cells(low, high))


def _above(px, py, x1, y1, x2, y2):
    """True where the point lies on or above the edge (x1 < x2)."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) >= 0


class _Tile:
    """The trapezoids of one tile, cut into slabs and ordered upwards in each."""

    def __init__(self, zone: np.ndarray, xl: np.ndarray, xr: np.ndarray, sides: list[np.ndarray]):
        self.bounds = np.unique(np.concatenate([xl, xr]))
        begin, end = np.searchsorted(self.bounds, xl), np.searchsorted(self.bounds, xr)
        spans = end - begin
        which = np.repeat(np.arange(len(zone)), spans)
        slab = np.arange(len(which)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(begin, spans)
        middle = (self.bounds[slab] + self.bounds[slab + 1]) / 2

        def height(x1, y1, x2, y2):
            return y1[which] + (y2[which] - y1[which]) * ((middle - x1[which]) / (x2[which] - x1[which]))

        low, high = height(*sides[:4]), height(*sides[4:])
        order = np.lexsort((low, slab))
        which, slab, low, high = which[order], slab[order], low[order], high[order]
        self.zone, self.sides = zone[which], [s[which] for s in sides]
        self.start = np.searchsorted(slab, np.arange(len(self.bounds) + 1))
        # sides may be the same, but for rounding; a trapezoid that begins well within the one below it overlaps
        under = (slab[1:] == slab[:-1]) & (low[1:] < high[:-1] - 1e-9 * (high[:-1] - low[:-1]) - 1e-12 * np.abs(high[:-1]))
        self.layers = None
        if under.any() and len(zones := np.unique(zone)) > 1:
            self.layers = [_Tile(zone[m], xl[m], xr[m], [s[m] for s in sides]) for m in (zone == z for z in zones)]

    def locate(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the points that lie in a trapezoid, and their zones."""
        if self.layers:
            found = [layer.locate(px, py) for layer in self.layers]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        slab = np.searchsorted(self.bounds, px, side="right") - 1
        at = np.flatnonzero((slab >= 0) & (slab < len(self.bounds) - 1))
        px, py, slab = px[at], py[at], slab[at]
        first = self.start[slab]
        low, high = first.copy(), self.start[slab + 1].copy()
        while (open_ := low < high).any():  # all points halve their range at once
            middle = np.where(open_, (low + high) // 2, 0)
            up = _above(px, py, *(s[middle] for s in self.sides[:4]))
            low = np.where(open_ & up, middle + 1, low)
            high = np.where(open_ & ~up, middle, high)
        hit = np.flatnonzero(low > first)
        candidate = low[hit] - 1
        inside = ~_above(px[hit], py[hit], *(s[candidate] for s in self.sides[4:]))
        return at[hit[inside]], self.zone[candidate[inside]]


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by tile, trapezoids before points; keeps the trapezoids of one tile at a time."""
    tile_key, parts, tile = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = [value[k] for k in _TILE]
        is_point = value["is_point"].astype(bool)
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in [*keys, is_point]:
            change[1:] |= k[1:] != k[:-1]
        cuts = [*np.flatnonzero(change), batch.num_rows]
        points, zones = [], []
        for a, b in zip(cuts, cuts[1:]):
            if (key := tuple(k[a] for k in keys)) != tile_key:
                tile_key, parts, tile = key, [], None
            if not is_point[a]:
                parts.append([value[c][a:b] for c in ("zone_id", "xl", "xr", *_SIDES)])
            elif parts:
                if tile is None:
                    zone, xl, xr, *sides = (np.concatenate(x) for x in zip(*parts))
                    tile = _Tile(zone.astype(np.int64), xl, xr, sides)
                hit, found = tile.locate(value["xl"][a:b], value["lx1"][a:b])
                points.append(value["zone_id"][a:b][hit])
                zones.append(found)
        if points:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(zones).astype(np.int64)), pa.array(np.concatenate(points).astype(np.int64))],
                names=["zone_id", "id"],
            )


def locate_in_zones(points: DataFrame, rings: DataFrame, rows_per_salt: int = 200_000) -> DataFrame:
    """``(zone_id, id)`` for each point and region it lies in.

    ``points``: one row per bigint ``id``, ``c0`` = latitude (y) and ``c1`` = longitude (x). ``rings``:
    ``zone_id`` bigint, ``ring_no``, ``vertex_no``, ``lon``, ``lat``; even-odd rule, so inner rings are
    holes. Regions may overlap; a point in two of them gives a row for each. A point exactly on a side
    may count as inside or outside. Points in no region, and empty inputs, give no rows.
    """
    traps = cut_lineage(_tiled(trapezoids(rings)))
    # at most some sixty sizes, as powers of two: a point visits one tile of each size in use
    levels = traps.agg(F.array_sort(F.collect_set("level")).alias("levels")).scalar()
    sized = points.select("id", F.col("c0").alias("y"), F.col("c1").alias("x"), F.explode(levels).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    sent = sized.withColumn("col", F.floor(F.col("x") / side)).withColumn("row", F.floor(F.col("y") / side))
    occupied = traps.select("level", "col", "row").distinct()
    if occupied.count() <= BROADCAST_TILES:  # else the points of empty tiles meet nothing there
        sent = sent.join(F.broadcast(occupied), ["level", "col", "row"], "left_semi")
    tile = [F.col("level"), F.col("col"), F.col("row")]
    hot = hot_keys(sent, tile, rows_per_salt)
    keys = [F.col(k) for k in _TILE]
    # points use the columns of trapezoids: id in zone_id, x in xl, y in lx1
    stream = repeat(traps, tile, hot).select(
        *keys, F.lit(0).alias("is_point"), "zone_id", "xl", "xr", *_SIDES
    ).unionByName(
        spread(sent, tile, hot, [F.col("id")]).select(
            *keys,
            F.lit(1).alias("is_point"),
            F.col("id").alias("zone_id"),
            F.col("x").alias("xl"),
            F.lit(0.0).alias("xr"),
            *[(F.col("y") if c == "lx1" else F.lit(0.0)).alias(c) for c in _SIDES],
        )
    )
    return (
        stream.repartition(*keys)
        .sortWithinPartitions(*_TILE, "is_point")
        .mapInArrow(_locate, "zone_id bigint, id bigint")
    )
