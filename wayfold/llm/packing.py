"""Filling containers of fixed capacity: sum-of-squares packing, in shards and rounds.

Items of one capacity are cut into shards by a hash of their id; a shard is packed by one task in a
stream of sizes: each item goes where the sum over all fill levels of the squared number of open
containers at that level grows least. Containers that a shard leaves open and not well filled are emptied
again and their items packed in further rounds, in shards of the same size cut by another hash, so that the
waste doesn't grow with the number of shards. Once what is left fits one shard, or a round improves little
(as with items that no other fits), the containers stay as they are. No task ever holds more than a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut_lineage

#: Items per shard on average; a task holds ids and sizes of one shard, some 24 bytes an item.
ITEMS_PER_SHARD = 50_000
#: A container left open at the end of a round stays if filled to this share.
KEEP_FILL = 0.97
#: A round that leaves more than this share of the items it got is the last.
LEFT_SHARE = 0.9

_NEVER = np.iinfo(np.int64).max
_COLUMNS = ["pack", "capacity", "container", "item_id", "piece", "size"]


def sum_of_squares(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Container number (from 0, in order of opening) of each size; every size must be from 1 to ``capacity``.

    N(h) is the number of open containers filled to h. An item of size s moves a container from h to
    h + s, which changes the sum of N squared by 2 N(h+s) - 2 N(h) + 2, or by 1 - 2 N(h) if it is then full;
    a new one changes it by 2 N(s) + 1. The least change is taken, of equal ones the fullest container, of
    these the latest, and a new one only if that is less.
    """
    level = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    placed = np.empty(len(sizes), np.int64)
    opened = 0
    for k, s in enumerate(sizes):
        if s == capacity:
            placed[k], opened = opened, opened + 1
            continue
        # change for moving a container from h to h + s, for h = 1 .. capacity - s
        here = level[1 : capacity - s + 1]
        change = 2 - 2 * here
        change[:-1] += 2 * level[s + 1 : capacity]
        change[-1] -= 1
        change[here == 0] = _NEVER
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        if change[at] <= 2 * level[s] + 1:
            h = at + 1
            box = stacks[h].pop()
            level[h] -= 1
        else:
            h, box, opened = 0, opened, opened + 1
        placed[k] = box
        if h + s < capacity:
            level[h + s] += 1
            stacks.setdefault(h + s, []).append(box)
    return placed


def _pack_shard(keep_fill: float):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        # in the order of a hash of the id: the same containers whatever the order of arrival
        items = items.assign(order=pd.util.hash_array(items["item_id"].to_numpy()))
        items = items.sort_values(["order", "item_id", "piece", "size"], kind="stable").drop(columns="order")
        capacity = int(items["capacity"].iloc[0])
        box = sum_of_squares(items["size"].to_numpy(np.int64), capacity)
        fill = np.bincount(box, weights=items["size"].to_numpy()).astype(np.int64)
        items["container"] = box
        items["final"] = fill[box] >= keep_fill * capacity
        return items

    return pack


def pieces(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Items for each capacity: ``(pack, capacity, item_id, number, piece, size)``, cut only if larger than the capacity.

    ``items``: ``item_id`` bigint, ``number`` bigint (of the row), ``size`` int; those without a size above 0 are
    left out. ``capacities``: ``pack`` string, ``capacity`` int above 0, a handful of rows. An item of size s
    above the capacity c makes full pieces of c and one of the rest.
    """
    sized = items.where(F.col("size") > 0).select("item_id", "number", F.col("size").cast("bigint").alias("whole"))
    # as many rows as there are kinds of container
    offered = capacities.where(F.col("capacity") > 0).agg(
        F.collect_set(F.struct(F.col("pack"), F.col("capacity").cast("int").alias("capacity"))).alias("o")
    ).scalar()
    cut = sized.select("item_id", "number", "whole", F.inline(offered)).select(
        "pack", "capacity", "item_id", "number", "whole",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("whole") / F.col("capacity")).cast("int") - 1)).alias("piece"),
    )
    rest = F.col("whole") - F.col("piece").cast("bigint") * F.col("capacity")
    return cut.select("pack", "capacity", "item_id", "number", "piece", F.least(rest, F.col("capacity").cast("bigint")).cast("int").alias("size"))


def pack(items: DataFrame, capacities: DataFrame, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Each piece in exactly one container: ``(pack, capacity, container, item_id, piece, size)``.

    ``items``: ``item_id`` bigint, ``size`` int; other columns are left out. Container ids are unique within a
    pack. Repeated items, and those without an id, are placed once per row. No items, or no capacities, give
    no rows.
    """
    schema = "pack string, capacity int, item_id bigint, number bigint, piece int, size int, shard bigint, container bigint, final boolean"
    # rows are numbered once and for all: equal ones are told apart, and spread, by their numbers
    rows = cut_lineage(items.select(F.col("item_id").cast("bigint"), "size", F.monotonically_increasing_id().alias("number")))
    cut = pieces(rows, capacities)
    name = lambda kind, *parts: F.concat_ws("-", F.lit(kind), *parts)
    # full pieces are containers of their own
    packed = cut.where(F.col("size") == F.col("capacity")).withColumn("container", name("w", "number", "piece")).select(_COLUMNS)
    loose, round_ = cut.where(F.col("size") < F.col("capacity")), 0
    counts = {r[0] or "": r[1] for r in loose.groupBy("pack").count().collect()}  # one row per pack
    of_pack = F.coalesce(F.col("pack"), F.lit(""))
    while counts:
        shards = {p: max(1, -(-n // items_per_shard)) for p, n in counts.items()}
        last = max(shards.values()) == 1
        cut_in = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
        shard = F.pmod(F.xxhash64("number", "piece", F.lit(round_)), cut_in[of_pack]).cast("bigint")
        # a number of partitions of its own: the work of a shard is in its items, not its bytes
        spread = loose.withColumn("shard", shard).repartition(sum(shards.values()), "pack", "shard")
        done = cut_lineage(spread.groupBy("pack", "shard").applyInPandas(_pack_shard(0.0 if last else KEEP_FILL), schema))
        left = {r[0] or "": r[1] for r in done.where("not final").groupBy("pack").count().collect()}
        # packs that one more round wouldn't help keep their containers as they are
        closed = [p for p, n in left.items() if n > LEFT_SHARE * counts[p]]
        over = F.col("final") | of_pack.isin(closed)
        packed = packed.unionByName(done.where(over).withColumn("container", name(f"r{round_}", "shard", "container")).select(_COLUMNS))
        loose = done.where(~over).drop("shard", "container", "final")
        counts, round_ = {p: n for p, n in left.items() if p not in closed}, round_ + 1
    return packed


def containers(packed: DataFrame) -> DataFrame:
    """Fill of each container: ``(pack, capacity, container, items, fill, unused)``."""
    return (
        packed.groupBy("pack", "capacity", "container")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("fill"))
        .withColumn("unused", F.col("capacity") - F.col("fill"))
    )


def waste(packed: DataFrame) -> DataFrame:
    """Totals per pack: containers, tokens, unused tokens, their share, and the least number of containers possible."""
    return (
        containers(packed)
        .groupBy("pack", "capacity")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.sum("unused").alias("unused"))
        .withColumn("unused_share", F.col("unused") / (F.col("tokens") + F.col("unused")))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
    )


def flaws(packed: DataFrame) -> DataFrame:
    """What must not be, counted per pack: ``(pack, items, repeated, overfull, miscut, wasteful)``.

    ``items`` distinct ids placed; ``repeated`` pieces placed more than once; ``overfull`` containers beyond the
    capacity; ``miscut`` items whose pieces, but for one, aren't full; ``wasteful``: more containers than
    the bound of first-fit in order of falling size, 11/9 of the least number plus 1.
    """
    each = packed.groupBy("pack", "capacity", "item_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    by_item = each.groupBy("pack", "item_id").agg(F.sum(F.col("n") - 1).alias("again"), F.sum((F.col("size") < F.col("capacity")).cast("int")).alias("partial"))
    of_items = by_item.groupBy("pack").agg(
        F.count(F.lit(1)).alias("items"), F.sum("again").alias("repeated"), F.sum((F.col("partial") > 1).cast("bigint")).alias("miscut")
    )
    overfull = containers(packed).groupBy("pack").agg(F.sum((F.col("unused") < 0).cast("bigint")).alias("overfull"))
    wasteful = waste(packed).select("pack", (F.col("containers") * 9 > F.col("least_containers") * 11 + 9).alias("wasteful"))
    return of_items.join(overfull, "pack").join(wasteful, "pack").select("pack", "items", "repeated", "overfull", "miscut", "wasteful")
