"""The first N items of every group, by a secondary sort and a stream.

Rows are sorted by group, score and item within each task and stream by as Arrow batches; each group
emits its first N distinct items and holds no more than those. The same pass runs before the shuffle, so
a group with a third of all rows sends at most N rows per task, and needs no salt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(group: Sequence[str], item: str, limit: str):
    """A pass over batches sorted by ``group``, score, ``item``."""

    def codes(column: pa.Array) -> np.ndarray:
        encoded = column.dictionary_encode(null_encoding="encode")
        return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, emitted, seen = None, 0, np.empty(0, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            begins[0] = True
            for g in group:
                c = codes(batch.column(g))
                begins[1:] |= c[1:] != c[:-1]
            number = np.cumsum(begins) - 1
            items = batch.column(item).to_numpy(zero_copy_only=False)
            limits = batch.column(limit).to_numpy(zero_copy_only=False)
            # the first row of each item in its group is its best, as rows are in order of score
            order = np.lexsort((np.arange(n), items, number))
            best = np.ones(n, bool)
            repeat = (items[order][1:] == items[order][:-1]) & (number[order][1:] == number[order][:-1])
            best[order[1:][repeat]] = False
            head = tuple(batch.column(g)[0].as_py() for g in group)
            before = 0
            if head == open_group:
                first = number == 0
                best[first] &= ~np.isin(items[first], seen)
                before = emitted
            kept = np.cumsum(best)
            starts = np.flatnonzero(begins)
            rank = kept - (kept[starts] - best[starts])[number]
            rank = np.where(number == 0, rank + before, rank)
            take = best & (rank <= limits)
            last = number == number[-1]
            new = items[last & take]
            same = number[-1] == 0 and head == open_group
            seen = np.concatenate([seen, new]) if same else new
            emitted = (emitted if same else 0) + len(new)
            open_group = tuple(batch.column(g)[n - 1].as_py() for g in group)
            if take.any():
                yield batch.filter(pa.array(take))

    return run


def top_n(df: DataFrame, group: Sequence[str], score: str, item: str, limit: str) -> DataFrame:
    """The ``limit`` items with the least ``score`` of each group; ties go to the smaller ``item``.

    An item counts once per group, at its least score. ``item`` is a bigint, ``limit`` an int column, the
    same on all rows of a group (should it differ, each row is held to its own). Rows without item, score
    (null or NaN) or limit are no candidates; a limit of 0 or less gives none. A null in a group column is
    a group of its own. Columns other than the named ones are left out. An empty input gives no rows.
    """
    group = list(group)
    rows = df.select(
        *[F.col(f"`{g}`").alias(g) for g in group],
        F.col(f"`{score}`").alias(score),
        F.col(f"`{item}`").cast("bigint").alias(item),
        F.col(f"`{limit}`").cast("int").alias(limit),
    ).where(
        F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull() & (F.col(limit) > 0)
    )
    one_pass = _first_n(group, item, limit)
    in_order = [*group, score, item]
    within_tasks = rows.sortWithinPartitions(*in_order).mapInArrow(one_pass, rows.schema)
    return (
        within_tasks.repartition(*group).sortWithinPartitions(*in_order).mapInArrow(one_pass, rows.schema)
    )
