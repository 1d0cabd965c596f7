"""Finding and splitting hot keys.

A hot key is found with a frequent-items sketch of fixed size (no shuffle of per-key counts), so the
list of hot keys has a proven bound and may be broadcast. Rows of a hot key are spread over several
salts; the other side of a join or merge is repeated once per salt. No row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys that are listed at most, and items the sketch keeps. A key that isn't among them has fewer than
#: 1/30,000 of all rows: at 10^12 rows some 3 * 10^7, which a sorting task still takes, and which no cut would
#: bring below the rows of an evenly filled task.
MAX_HOT_KEYS = 10_000
TRACKED_ITEMS = 40_000


def key_hash(keys: Sequence[Column]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(df: DataFrame, keys: Sequence[Column], rows_per_salt: int = 200_000, summed: str | None = None) -> DataFrame:
    """``(hot_hash, salts)`` for keys with more than ``rows_per_salt`` rows; at most ``MAX_HOT_KEYS`` rows.

    Null keys hash like any other value. An empty input gives an empty result. Two keys that share a
    hash are split alike, which costs a few copies and changes no result. Where ``df`` comes out of an
    aggregation that is also used whole, ``summed`` names its sum of numbers of 0 or more: reading it
    too keeps that aggregation the same in both places, so that it runs once.
    """
    h, total = key_hash(keys).alias("h"), F.lit(0) if summed is None else F.sum("s")
    sketch = df.select(h, *([] if summed is None else [F.col(summed).alias("s")])).agg(
        F.expr(f"approx_top_k(h, {MAX_HOT_KEYS}, {TRACKED_ITEMS})").alias("top"), total.alias("total")
    )
    return (
        sketch.where(F.coalesce("total", F.lit(0)) >= 0).select(F.inline("top"))
        .where(F.col("count") > rows_per_salt)
        .select(
            F.col("item").alias("hot_hash"),
            F.ceil(F.col("count") / F.lit(rows_per_salt)).cast("int").alias("salts"),
        )
    )


def _with_salts(df: DataFrame, keys: Sequence[Column], hot: DataFrame) -> DataFrame:
    # hot has at most MAX_HOT_KEYS rows, whatever the size of the input
    return df.withColumn("_h", key_hash(keys)).join(F.broadcast(hot), F.col("_h") == F.col("hot_hash"), "left")


def spread(df: DataFrame, keys: Sequence[Column], hot: DataFrame, by: Sequence[Column]) -> DataFrame:
    """Add ``salt``: 0 for ordinary keys, a hash of ``by`` among the key's salts for hot ones."""
    salted = _with_salts(df, keys, hot)
    return salted.withColumn(
        "salt", F.pmod(F.xxhash64(*by, F.lit(17)), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    ).drop("_h", "hot_hash", "salts")


def repeat(df: DataFrame, keys: Sequence[Column], hot: DataFrame) -> DataFrame:
    """Add ``salt``, repeating each row once per salt of its key."""
    salted = _with_salts(df, keys, hot)
    return salted.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    ).drop("_h", "hot_hash", "salts")
