"""Fixed-point costs: impedances are kept in whole thousandths, so that sums of them are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000
#: Above this a weight is refused; paths of a million such edges still fit 64 bits.
MOST = 2**40


def to_cost(weight: Column) -> Column:
    """Thousandths of ``weight``, cut off towards zero, at least 1; null, NaN, negative or huge weights raise when read."""
    w = weight.cast("double")
    ok = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w * SCALE < MOST)
    return F.when(ok, F.greatest((w * SCALE).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(
        F.raise_error(F.concat(F.lit("weight must be from 0 to 2^40/1000, found: "), F.coalesce(w.cast("string"), F.lit("null")))).cast("bigint")
    )


def radius_cost(radius: float) -> int:
    """Thousandths of a radius; distances up to and with the radius count."""
    if not radius >= 0:
        raise ValueError("radius must be 0 or more")
    return int(radius * SCALE + 1e-9)


def from_cost(cost: Column) -> Column:
    return cost / F.lit(float(SCALE))
