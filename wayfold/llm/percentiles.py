"""Exact percentiles per group over very many values, from cumulative frequencies.

Values are reduced to ``(group, value, n)`` counts. Counts of days, partitions or other pieces add up, so
they are the state that is kept and combined; percentiles of any union of pieces follow from the summed
counts without error. With ``digits`` set, values are first rounded to so many significant digits, which
bounds the state of a group and the relative error of every percentile by ``0.5 * 10 ** (1 - digits)``.

Ranks are found by a range sort: counts are range-partitioned by group and slice of the group's values.
Most groups are one slice; those with very many counts are cut at their approximate quantiles, so that
they spread over many partitions. Running sums are taken within a slice; the offset of a slice is the sum
of the slices before it, from one small row per slice of a cut group. The first value whose cumulative
count reaches the target rank is the percentile. All groups take the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.skew import hot_keys, key_hash

#: Percentiles as whole thousandths, so that target ranks are exact integers.
PER_MILLE = (10, 50, 250, 500, 750, 950, 990)

#: Counts from which a group is cut into slices.
ROWS_PER_SLICE = 200_000
#: Slices of a cut group; a power of two.
SLICES = 128


def relative_error(digits: int) -> float:
    """The most by which rounding to so many significant digits changes a value, relative to it."""
    return 0.5 * 10.0 ** (1 - digits)


def _rounded(value: Column, digits: int | None) -> Column:
    if digits is None:
        return value
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when((value == 0) | (F.abs(value) < 1e-290) | (F.abs(value) > 1e290), value).otherwise(
        F.round(value * scale) / scale
    )


def value_counts(
    df: DataFrame, group: Sequence[str], value: str, row_id: str | None = None, digits: int | None = None
) -> DataFrame:
    """Counts ``(*group, value, n)``; rows that share ``row_id`` count once.

    Null and NaN are no values; -0.0 counts as 0.0. Rows that share an id are expected to agree in the
    named columns; should they differ in these, each distinct row counts. Rows with a null id each count. A null in a group
    column is a group of its own. Only the named columns are read; none may be called ``n``, ``value``
    (unless it is the value) or start with ``_v_``. An empty input gives an empty result.
    """
    if digits is not None and not 1 <= digits <= 15:
        raise ValueError("digits must be from 1 to 15")
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(
        *[F.col(f"`{g}`").alias(g) for g in group],
        (_rounded(v, digits) + F.lit(0.0)).alias("_v_value"),
        *([F.col(f"`{row_id}`").alias("_v_id")] if row_id else []),
    )
    if row_id:
        # one shuffle by id; keys only, so the copies are removed by hashing, without a sort
        unique = rows.where(F.col("_v_id").isNotNull()).distinct()
        rows = unique.drop("_v_id").unionByName(rows.where(F.col("_v_id").isNull()).drop("_v_id"))
    return rows.groupBy(*group, F.col("_v_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of pieces (a union, or finer groups) summed to coarser ``group``."""
    return counts.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(
    counts: DataFrame, group: Sequence[str], per_mille: Sequence[int] = PER_MILLE, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``(*group, values_n, p010, p050, ...)``: for each p the least value whose cumulative count reaches p.

    The target rank of p thousandths among n values is ``ceil(n * p / 1000)``, at least 1: the percentile
    is always one of the values (no interpolation). ``counts`` as from ``value_counts`` or ``merge_counts``.
    ``rows_per_slice`` balances the work and changes no result.
    """
    if not per_mille or any(not 0 <= p <= 1000 for p in per_mille):
        raise ValueError("per_mille must be from 0 to 1000")
    group = list(group)
    keys = [F.col(g) for g in group] or [F.lit(0)]
    hot = hot_keys(counts, keys, rows_per_slice, "n")
    # the first group columns of cut groups and their bounds: as many rows as hot keys, of SLICES numbers
    flagged = counts.withColumn("_v_h", key_hash(keys))
    cut = flagged.join(F.broadcast(hot.select(F.col("hot_hash").alias("_v_h"))), "_v_h", "left_semi")
    shares = [i / SLICES for i in range(1, SLICES)]
    bounds = cut.groupBy("_v_h").agg(F.percentile_approx("value", shares, 10 * SLICES).alias("_v_bounds"))
    sliced = flagged.join(F.broadcast(bounds), "_v_h", "left").withColumn("_v_slice", F.lit(0))
    step = SLICES // 2
    while step:  # binary search for the number of bounds below the value
        below = F.get("_v_bounds", F.col("_v_slice") + (step - 1)) < F.col("value")
        sliced = sliced.withColumn("_v_slice", F.col("_v_slice") + F.when(below, step).otherwise(0))
        step //= 2
    sliced = sliced.select(*group, "value", "n", "_v_h", F.col("_v_bounds").isNotNull().alias("_v_cut"), "_v_slice")
    parts = [*group, "_v_slice"]
    # ranges of the slices satisfy the windows and, for whole groups, the last aggregation: no further shuffle
    ranged = sliced.repartitionByRange(*[F.col(c) for c in parts])
    in_slice = Window.partitionBy(*parts)
    running = in_slice.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", F.sum("n").over(running).alias("_v_run"), F.sum("n").over(in_slice).alias("_v_sum"))
    offsets = _offsets(sliced.where("_v_cut"), group, parts)
    same = F.lit(True)
    for c in parts:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}"))
    # at most hot keys times SLICES rows
    cumulated = summed.alias("c").join(F.broadcast(offsets).alias("o"), F.col("c._v_cut") & same, "left").select(
        *[F.col(f"c.{g}") for g in group], "c.value", "c.n",
        (F.col("c._v_run") + F.coalesce(F.col("o._v_offset"), F.lit(0))).alias("cum"), F.coalesce(F.col("o._v_total"), F.col("c._v_sum")).alias("total"),
    )
    return _first_at_rank(cumulated, group, per_mille)


def _offsets(cut: DataFrame, group: list[str], parts: list[str]) -> DataFrame:
    """``(*parts, _v_offset, _v_total)``: what the slices before each slice of a cut group hold, and all of them."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_v_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.groupBy(*parts).agg(F.sum("n").alias("_v_n"))
        .select(*parts, F.coalesce(F.sum("_v_n").over(before), F.lit(0)).alias("_v_offset"), F.sum("_v_n").over(whole).alias("_v_total"))
    )


def named(per_mille: int) -> str:
    """Name of the column of a percentile."""
    return f"p{per_mille // 10:02d}" if per_mille % 10 == 0 else f"p{per_mille:03d}m"


def _first_at_rank(cumulated: DataFrame, group: list[str], per_mille: Sequence[int]) -> DataFrame:
    """From rows with ``value``, ``n``, ``cum`` (up to and with the row) and ``total``: one row per group."""
    ranks = {p: F.greatest(F.lit(1), F.floor((F.col("total") * p + 999) / 1000)) for p in per_mille}
    reaches = {p: (F.col("cum") >= r) & (F.col("cum") - F.col("n") < r) for p, r in ranks.items()}
    any_target = F.lit(False)
    for hit in reaches.values():
        any_target = any_target | hit
    return cumulated.where(any_target).groupBy(*group).agg(
        F.max("total").alias("values_n"), *[F.max(F.when(hit, F.col("value"))).alias(named(p)) for p, hit in reaches.items()]
    )
