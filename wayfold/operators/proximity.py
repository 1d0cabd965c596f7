"""Points near other points, in the plane or on a sphere, by an equi-join on grid cells.

Space is cut into cells of six radii. Every point is at home in one cell and visits each further cell
that its radius reaches (at most two per axis); a home point meets the visitors of its cell. A pair is
met exactly once: in the home cell of its smaller id. The candidates of a cell exceed the pairs it yields
by a constant factor only, however dense the data, and hot cells are split by salts. A cell is shuffled as
one hash; cells that share one would only compare more points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.skew import hot_keys, repeat, spread

EARTH_RADIUS_M = 6_371_008.8
#: Cell side in radii.
CELL_RADII = 6.0


def placed(*coordinates: Column) -> Column:
    """True where all coordinates are neither null nor NaN."""
    usable = F.lit(True)
    for c in coordinates:
        usable = usable & c.isNotNull() & ~F.isnan(c)
    return usable


def finite(*coordinates: Column) -> Column:
    """True where all coordinates are also within bounds that distances can be computed in."""
    usable = placed(*coordinates)
    for c in coordinates:
        usable = usable & (F.abs(c) < F.lit(1e150))
    return usable


def distinct_points(df: DataFrame, id_col: str, coordinates: Sequence[str]) -> DataFrame:
    """One row per id that has a usable position (infinite ones are near nothing): ``id`` and ``c0``, ``c1``, ...

    Rows of an id are expected to agree; should they not, the position with the least first coordinate
    counts. Null ids are ignored. Only these columns are read, so extra columns may have any names.
    """
    cols = [F.col(f"`{c}`").cast("double") for c in coordinates]
    first, *others = [F.col(f"c{i}") for i in range(len(cols))]
    return (
        df.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(cols)])
        .where(F.col("id").isNotNull() & finite(first, *others))
        .groupBy("id")
        .agg(F.min("c0").alias("c0"), *[F.min_by(f"c{i}", "c0").alias(f"c{i}") for i in range(1, len(cols))])
    )


def near_pairs(points: DataFrame, radius: float, axes: int = 2, rows_per_salt: int = 100_000) -> DataFrame:
    """All pairs ``(a_id, b_id)``, ``a_id < b_id``, of points at most ``radius`` apart (inclusive).

    ``points`` has one row per ``id`` and coordinates ``c0`` .. ``c{axes-1}``, as from
    ``distinct_points``. Points at one place are pairs at distance 0. An empty input gives no pairs.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    side = CELL_RADII * radius
    coords = [F.col(f"c{i}") for i in range(axes)]
    at_home = points.select("id", *coords, F.xxhash64(*[F.floor(c / side) for c in coords]).alias("cell"))
    guests_at = points
    for i, c in enumerate(coords):
        # a hair wider than the radius, so that rounding loses no cell; the distance itself is exact
        reach = F.abs(c) * 1e-15 + radius * (1 + 1e-9)
        guests_at = guests_at.withColumn(f"g{i}", F.sequence(F.floor((c - reach) / side), F.floor((c + reach) / side)))
    for i in range(axes):
        guests_at = guests_at.withColumn(f"g{i}", F.explode(f"g{i}"))
    guests_at = guests_at.select("id", *coords, F.xxhash64(*[f"g{i}" for i in range(axes)]).alias("cell"))
    cell = [F.col("cell")]
    hot = hot_keys(at_home, cell, rows_per_salt)
    home = spread(at_home, cell, hot, [F.col("id")]).alias("a")
    guests = repeat(guests_at, cell, hot).alias("b")
    gap2 = sum(((F.col(f"a.c{i}") - F.col(f"b.c{i}")) * (F.col(f"a.c{i}") - F.col(f"b.c{i}")) for i in range(axes)), F.lit(0.0))
    met = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.salt") == F.col("b.salt"))
    return home.join(guests, met & (F.col("a.id") < F.col("b.id")) & (gap2 <= radius * radius)).select(
        F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")
    )


def near_pairs_on_sphere(
    points: DataFrame, radius: float, sphere_radius: float = EARTH_RADIUS_M, rows_per_salt: int = 100_000
) -> DataFrame:
    """As ``near_pairs`` for ``c0`` = latitude and ``c1`` = longitude in degrees; great-circle ``radius`` in metres.

    Works in space on the straight chord that belongs to the great-circle distance, so poles and the
    antimeridian are places like any other.
    """
    lat, lon = F.radians("c0"), F.radians("c1")
    in_space = points.select(
        "id",
        (F.cos(lat) * F.cos(lon) * sphere_radius).alias("c0"),
        (F.cos(lat) * F.sin(lon) * sphere_radius).alias("c1"),
        (F.sin(lat) * sphere_radius).alias("c2"),
    )
    chord = 2 * sphere_radius * math.sin(min(radius / (2 * sphere_radius), math.pi / 2))
    return near_pairs(in_space, chord, axes=3, rows_per_salt=rows_per_salt)
