"""Mixing sources to target weights: hierarchical budgets, and token-prefixes of seeded epochs.

Budgets go down a tree of groups (domain, language, source ...) by weight. A leaf can give no more than
its tokens times its allowed repeats; what it cannot give is taken over by its siblings in proportion to
their weights, and only what the siblings cannot give by those of its ancestors. The tree has one entry
per target, so it is worked out on the driver; documents never leave the executors.

Each leaf then yields a prefix of its documents in the order of a seeded hash, epoch after epoch. Full
epochs need no order. In the last one, documents are cut into slices of the hash; sums per slice show the
slice in which the budget ends, and running sums are needed in that one only, so no task holds a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Targets at most; their list is held on the driver and broadcast.
MAX_TARGETS = 100_000
#: Targets up to which sums per slice are broadcast: some 400,000 rows at most.
BROADCAST_TARGETS = 100
#: Slices of a leaf's documents in an epoch.
SLICES = 4096


@dataclass
class _Node:
    weight: float = 0.0
    capacity: float = 0.0
    children: dict = field(default_factory=dict)
    budget: float = 0.0

    def fill(self) -> float:
        if self.children:
            self.capacity = sum(c.fill() for c in self.children.values())
        return self.capacity

    def spend(self, budget: float) -> None:
        """Pass on ``budget`` (at most the capacity) by weight; shortages go to siblings with room left."""
        self.budget = min(budget, self.capacity)
        open_ = {k: c for k, c in self.children.items() if c.weight > 0 and c.capacity > 0}
        shares = dict.fromkeys(self.children, 0.0)
        left = self.budget
        while open_ and left > 1e-9:
            weights = sum(c.weight for c in open_.values())
            short = [k for k, c in open_.items() if shares[k] + left * c.weight / weights >= c.capacity - 1e-9]
            if not short:
                for k, c in open_.items():
                    shares[k] += left * c.weight / weights
                break
            for k in short:
                left -= open_[k].capacity - shares[k]
                shares[k] = open_.pop(k).capacity
        for k, c in self.children.items():
            c.spend(shares[k])


def allocate(leaves: Sequence[tuple[tuple, float, float]], total: float) -> dict[tuple, float]:
    """Budget of each leaf: ``leaves`` are (path, weight, capacity), weights of a group add up to the group's.

    A leaf of weight 0, or without capacity, gets nothing. Only weights relative to siblings matter. If all
    leaves together cannot give ``total``, each gives what it can.
    """
    root = _Node()
    for path, weight, capacity in leaves:
        node = root
        node.weight += weight
        for part in path:
            node = node.children.setdefault(part, _Node())
            node.weight += weight
        node.capacity += capacity if weight > 0 else 0.0
    root.fill()
    root.spend(min(total, root.capacity))
    found = {}
    for path, _, _ in leaves:
        node = root
        for part in path:
            node = node.children[part]
        found[path] = node.budget
    return found


def plan(
    sizes: DataFrame, targets: DataFrame, levels: Sequence[str], total_tokens: int | None = None
) -> list[tuple[tuple, float, int, int, float]]:
    """Per leaf of ``targets``: path, weight, max_repeats, tokens at hand, budget in tokens.

    ``targets``: the columns ``levels`` from the root down, ``weight``, ``max_repeats``; it must fit the
    driver: more than ``MAX_TARGETS`` rows raise. ``total_tokens`` defaults to the tokens of the documents in any target.
    """
    if targets.count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    at_hand = {tuple(r[:-1]): r[-1] for r in sizes.join(F.broadcast(targets.select(*levels)), list(levels), "left_semi").groupBy(*levels).agg(F.sum("tokens")).collect()}
    rows = [(tuple(r[c] for c in levels), float(r["weight"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect()]
    if any(w < 0 for _, w, _ in rows) or len({p for p, _, _ in rows}) < len(rows):
        raise ValueError("targets need distinct paths and weights of 0 or more")
    total = sum(at_hand.values()) if total_tokens is None else total_tokens
    budgets = allocate([(p, w, float(at_hand.get(p, 0) * max(r, 0))) for p, w, r in rows], total)
    return [(p, w, r, int(at_hand.get(p, 0)), budgets[p]) for p, w, r in rows]


def tree_targets(sizes: DataFrame, targets: DataFrame, source: str, above: Sequence[str]) -> DataFrame:
    """Targets per source as targets per leaf of a tree ``(*above, source)``, for ``plan`` and ``select``.

    ``sizes`` has ``source``, the columns ``above`` and ``tokens``; ``targets`` has ``source``, ``weight`` and
    ``max_repeats``. A source's weight is parted over its leaves by the tokens they hold, so that each source
    keeps its weight. A source without documents is one leaf, with what ``targets`` has of the columns
    ``above``, else nulls, above it. There are as many rows as targets times the groups above that each occurs in.
    """
    held = sizes.where(F.col("tokens") > 0).groupBy(*above, source).agg(F.sum("tokens").alias("_m_held"))
    known = {c: F.col(f"_m_{c}") if c in targets.columns else F.lit(None) for c in above}
    mine = targets.select(source, "weight", "max_repeats", *[F.col(c).alias(f"_m_{c}") for c in above if c in targets.columns])
    leaves = mine.join(held, source, "left")
    share = F.coalesce(F.col("_m_held") / F.sum("_m_held").over(Window.partitionBy(source)), F.lit(1.0))
    return leaves.select(*[F.coalesce(F.col(c), known[c]).alias(c) for c in above], source, (F.col("weight") * share).alias("weight"), "max_repeats")


def select(
    documents: DataFrame, targets: DataFrame, levels: Sequence[str], total_tokens: int | None = None, seed: int = 20_240_601
) -> tuple[DataFrame, DataFrame]:
    """The selection ``(id, *levels, tokens, uses)`` and the report of shares.

    ``documents``: ``id`` bigint, the columns ``levels``, ``tokens``. Documents outside all targets, with a
    null in ``levels``, or without tokens, are not selected. ``uses`` is at least 1 and at most the
    target's ``max_repeats``; the document in which the budget ends is kept if that comes nearer to it, so
    a leaf misses its budget by half a document at most. The same seed gives the same selection. Rows with one id are
    ordered by size and count each.
    The report has a row per target: ``target_share`` (weight over the sum of weights), ``budget``,
    ``documents``, ``tokens``, ``actual_share``, ``most_uses``; also for targets that got nothing.
    """
    levels = list(levels)
    spark = documents.sparkSession
    sized = documents.where(F.col("tokens") > 0).select("id", *levels, F.col("tokens").cast("bigint").alias("tokens"))
    leaves = plan(sized, targets, levels, total_tokens)
    kinds = {f.name: f.dataType.simpleString() for f in targets.select(*levels).schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in levels) + ", weight double, max_repeats int, epochs bigint, rest bigint, budget double"
    rows = []
    for path, weight, repeats, tokens, budget in leaves:
        whole = min(int(math.floor(budget + 1e-6)) // tokens, repeats) if tokens else 0
        rest = max(0, math.floor(budget + 1e-6) - whole * tokens) if whole < repeats else 0
        rows.append((*path, weight, repeats, whole, rest, budget))
    # one row per target
    budgets = F.broadcast(spark.createDataFrame(rows, schema))
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id"))
    placed = sized.join(budgets.select(*levels, "epochs", "rest"), levels).select(
        "id", *levels, "tokens", "epochs", "rest", order.alias("_m_order")
    ).withColumn("_m_slice", F.floor((F.col("_m_order").cast("double") / F.lit(2.0**64) + 0.5) * SLICES).cast("int"))
    whole = Window.partitionBy(*levels).orderBy("_m_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most SLICES rows per target: broadcast for few targets, joined by slice for many
    slices = placed.where(F.col("rest") > 0).groupBy(*levels, "_m_slice").agg(F.sum("tokens").alias("_m_sum"))
    slices = slices.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(whole), F.lit(0)))
    located = placed.join(F.broadcast(slices) if len(leaves) <= BROADCAST_TARGETS else slices, [*levels, "_m_slice"], "left")
    before, summed = F.col("_m_before"), F.col("_m_sum")
    within = before + summed <= F.col("rest")
    ending = ~within & (before < F.col("rest"))
    columns = ["id", *levels, "tokens"]
    sure = located.where(~F.coalesce(ending, F.lit(False))).select(
        *columns, (F.col("epochs") + F.when(within, 1).otherwise(0)).cast("int").alias("uses")
    )
    in_order = Window.partitionBy(*levels).orderBy("_m_order", "id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = located.where(ending).withColumn("_m_run", F.sum("tokens").over(in_order) + before).select(
        *columns, (F.col("epochs") + F.when(F.col("_m_run") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).cast("int").alias("uses")
    )
    selection = sure.unionByName(cut).where(F.col("uses") > 0)
    given = selection.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    everything = Window.partitionBy()
    report = budgets.join(given, levels, "left").select(
        *levels,
        (F.col("weight") / F.sum("weight").over(everything)).alias("target_share"),
        F.col("budget").cast("bigint").alias("budget"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "tokens", "most_uses")],
    )
    return selection, report.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(everything))
