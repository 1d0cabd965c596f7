"""References to records that do not exist.

Parent keys are compressed into runs of contiguous integers; each reference is matched as-of to the
preceding run start, and a key beyond the run's end is an orphan. The validity of a parent over time is
matched the same way along (key, time) in the same sorted stream, so one shuffle of the references
answers both. The key space is cut into blocks, which makes the as-of match a window within a block;
blocks with very many references are split by salts and their (few) parent rows repeated.

The stream carries one row per reference and never joins references to parents pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.skew import hot_keys, repeat, spread

_FIRST, _LAST = -(2**63), 2**63 - 1
_RUN, _VALID, _REFERENCE = 0, 1, 2


def _micros(column: str) -> Column:
    # timestamps without zone are read as of the session's zone, which should be UTC
    return F.unix_micros(F.col(column).cast("timestamp"))


def _block(key: Column, bits: int) -> Column:
    return F.shiftright(key, bits)


def key_runs(parents: DataFrame, block_bits: int = 12) -> DataFrame:
    """Compress parent keys to ``(block, start, end, placed)``: contiguous keys that agree in ``placed``.

    ``parents`` has ``key`` bigint and ``placed`` boolean, in any number of rows per key; a key is
    placed if one of its rows is. Runs are cut at multiples of 2**block_bits, so that no run, however
    long, makes one task see all keys. Null keys are ignored; no parents give no runs.
    """
    keys = (
        parents.where(F.col("key").isNotNull())
        .groupBy(_block(F.col("key"), block_bits).alias("block"), "key")
        .agg(F.max(F.coalesce(F.col("placed"), F.lit(False))).alias("placed"))
    )
    in_order = Window.partitionBy("block", "placed").orderBy("key")
    return (
        keys.withColumn("island", F.col("key") - F.row_number().over(in_order))
        .groupBy("block", "placed", "island")
        .agg(F.min("key").alias("start"), F.max("key").alias("end"))
        .select("block", "start", "end", "placed")
    )


def find_orphans(
    references: DataFrame, parents: DataFrame, block_bits: int = 12, rows_per_salt: int = 200_000
) -> DataFrame:
    """The references without a usable parent when they were loaded, with the reason.

    ``references``: ``key`` bigint, ``loaded_at`` timestamp, and any columns that identify the row, which
    are kept. ``parents``: ``key`` bigint, ``placed`` boolean, ``loaded_at``, ``deleted_at`` timestamp.
    A parent row can be used at time t if it is placed, was loaded at or before t, and was not deleted at
    or before t. Returns the columns of ``references`` without ``key`` and ``loaded_at``, plus ``reason``:
    'missing' (no row of the key), 'unplaced' (no placed row), 'late' (all placed rows loaded after t) or
    'deleted'. Repeated references yield repeated rows; apply ``distinct`` where that matters.

    Nulls: a reference without key is no case; one without ``loaded_at`` is judged at the end of time; a
    parent without key is ignored, and one without ``loaded_at`` counts as there from the beginning.
    Extra columns of ``references`` may have any names but those starting with ``_o_``.
    """
    payload = [c for c in references.columns if c not in ("key", "loaded_at")]
    bits = block_bits
    refs = references.where(F.col("key").isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_o_row") if payload else F.lit(None).cast("int").alias("_o_row"),
        F.col("key").alias("_o_key"),
        F.coalesce(_micros("loaded_at"), F.lit(_LAST - 1)).alias("_o_t"),
        _block(F.col("key"), bits).alias("_o_block"),
    )
    row_type = refs.schema["_o_row"].dataType
    nothing = F.lit(None)
    runs = key_runs(parents, bits).select(
        nothing.cast(row_type).alias("_o_row"),
        F.col("start").alias("_o_key"),
        F.lit(_FIRST).alias("_o_t"),
        F.col("block").alias("_o_block"),
        F.lit(_RUN).alias("_o_kind"),
        F.col("end").alias("_o_end"),
        F.col("placed").alias("_o_placed"),
    )
    validity = (
        parents.where(F.col("key").isNotNull() & F.col("placed"))
        .groupBy("key", F.coalesce(_micros("loaded_at"), F.lit(_FIRST)).alias("t"))
        .agg(F.max(F.coalesce(_micros("deleted_at"), F.lit(_LAST))).alias("until"))
        .select(
            nothing.cast(row_type).alias("_o_row"),
            F.col("key").alias("_o_key"),
            F.col("t").alias("_o_t"),
            _block(F.col("key"), bits).alias("_o_block"),
            F.lit(_VALID).alias("_o_kind"),
            F.col("until").alias("_o_end"),
            F.lit(True).alias("_o_placed"),
        )
    )
    block = [F.col("_o_block")]
    hot = hot_keys(refs, block, rows_per_salt)
    stream = spread(
        refs.select(
            "*",
            F.lit(_REFERENCE).alias("_o_kind"),
            nothing.cast("bigint").alias("_o_end"),
            nothing.cast("boolean").alias("_o_placed"),
        ),
        block,
        hot,
        [F.col("_o_key"), F.col("_o_t")] + ([F.col("_o_row")] if payload else []),
    ).unionByName(repeat(runs.unionByName(validity), block, hot))

    so_far = (
        Window.partitionBy("_o_block", "salt")
        .orderBy("_o_key", "_o_t", "_o_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kind = F.col("_o_kind")
    matched = stream.select(
        "*",
        F.last(F.when(kind == _RUN, F.col("_o_end")), ignorenulls=True).over(so_far).alias("_o_run_end"),
        F.last(F.when(kind == _RUN, F.col("_o_placed")), ignorenulls=True).over(so_far).alias("_o_run_placed"),
        # of the latest key with a validity row so far: the longest validity among its rows
        F.max(F.when(kind == _VALID, F.struct("_o_key", "_o_end"))).over(so_far).alias("_o_valid"),
    ).where(kind == _REFERENCE)
    beyond = F.col("_o_run_end").isNull() | (F.col("_o_key") > F.col("_o_run_end"))
    loaded = F.coalesce(F.col("_o_valid._o_key") == F.col("_o_key"), F.lit(False))
    reason = (
        F.when(beyond, "missing")
        .when(~F.col("_o_run_placed"), "unplaced")
        .when(~loaded, "late")
        .when(F.col("_o_valid._o_end") <= F.col("_o_t"), "deleted")
    )
    found = matched.withColumn("_o_reason", reason).where(F.col("_o_reason").isNotNull())
    return found.select(*[F.col("_o_row")[c].alias(c) for c in payload], F.col("_o_reason").alias("reason"))


def orphan_report(orphans: DataFrame, by: list[str], period: str, loaded_at: str = "loaded_at") -> DataFrame:
    """Distinct orphans counted per ``by``, reason and calendar ``period`` (as of ``date_trunc``) of ``loaded_at``."""
    return (
        orphans.distinct()
        .groupBy(*by, F.to_date(F.date_trunc(period, F.col(loaded_at))).alias("period"), "reason")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )
