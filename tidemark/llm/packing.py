"""Filling containers of fixed capacity: bounded-space online best-fit.

Items are spread evenly over shards. Each shard packs its own stream with a fixed number of open containers, so
a task's memory doesn't depend on the number of items, and no container is shared between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship


class BestFit:
    """Online best-fit with at most `n_open` open containers.

    A bitset has bit f set when some open container has f units free, so the tightest container for an item is
    found in a few operations on one integer. When all are open and none fits, the fullest closes.
    """

    def __init__(self, capacity: int, n_open: int = 64):
        if capacity < 1 or n_open < 1:
            raise ValueError("capacity and n_open must be positive")
        self.capacity, self.n_open = capacity, n_open
        self.bits, self.at, self.count, self.next = 0, {}, 0, 0

    def _put(self, free: int, box: int) -> None:
        if free > 0:
            self.at.setdefault(free, []).append(box)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        boxes = self.at[free]
        box = boxes.pop(0)
        if not boxes:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return box

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, size: int) -> int:
        """The number of the container that takes an item of `size`, which is between 1 and the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            box = self._take(free)
            self._put(free - size, box)
            return box
        if self.count >= self.n_open:
            self._take((self.bits & -self.bits).bit_length() - 1)
        box = self.new()
        self._put(self.capacity - size, box)
        return box

    def merge_open(self) -> dict[int, int]:
        """At the end of the stream: pour whole open containers into others, best-fit from the fullest on."""
        rest = sorted((free, box) for free, boxes in self.at.items() for box in boxes)
        self.bits, self.at, self.count, moved = 0, {}, 0, {}
        for free, box in rest:
            fitting = self.bits >> (self.capacity - free)
            if fitting:
                room = self.capacity - free + (fitting & -fitting).bit_length() - 1
                moved[box] = self._take(room)
                self._put(room - (self.capacity - free), moved[box])
            else:
                self._put(free, box)
        return moved


def pack_sizes(sizes, capacity: int, n_open: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack sizes in their order. Returns item index, container, start within the item and size of every piece.

    Items above the capacity are cut into full containers and a rest, which is packed like an item; others stay whole.
    Items of size 0 have no piece.
    """
    fit, item, box, start, size = BestFit(capacity, n_open), [], [], [], []
    for i, s in enumerate(sizes):
        at = 0
        while s - at >= capacity:
            item.append(i), box.append(fit.new()), start.append(at), size.append(capacity)
            at += capacity
        if s > at:
            item.append(i), box.append(fit.add(s - at)), start.append(at), size.append(s - at)
    moved = fit.merge_open()
    if moved:
        box = [moved.get(b, b) for b in box]
    return tuple(np.asarray(x, dtype=np.int64) for x in (item, box, start, size))


def pack(
    items: DataFrame, capacities: dict[str, int], id: str = "doc_id", size: str = "n_tokens", n_open: int = 64, shard_items: int = 10_000
) -> DataFrame:
    """Put items into containers of every given capacity.

    Returns one row per piece: `pack_id`, the item's id, `container` (null for items of size 0 or null, which are in the result
    once per capacity and take no room), `piece` from 0, `start` and `size`. Only items above a capacity have more than one piece. Items of
    the same id, null ids included, are packed as items of their own. Every shard holds about `shard_items` items and leaves at most a few
    containers unfilled. Extra columns are ignored; an empty table gives an empty result.
    """
    ship(items.sparkSession)
    small = items.select(F.col(id).alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    shards = max(1, -(-items.count() // shard_items))
    # Round-robin after Spark's own sort, then a fixed order: a lost shard is packed again in the same way.
    spread = small.repartition(shards).withColumn("_shard", F.spark_partition_id()).sortWithinPartitions("_id", "_size")
    caps = list(capacities.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        # a fixed pseudo-random order, so that sizes that follow the ids don't come in runs
        rows = rows.iloc[np.random.default_rng(len(rows)).permutation(len(rows))].reset_index(drop=True)
        ids, sizes = rows["_id"], rows["_size"].to_numpy()
        shard = int(rows["_shard"].iloc[0])
        for name, cap in caps:
            item, box, start, part = pack_sizes(sizes.tolist(), int(cap), n_open)
            piece = np.where(start > 0, start // int(cap), 0)
            yield pd.DataFrame({
                "pack_id": name, id: ids.iloc[item].array, "container": [f"{shard}-{b}" for b in box], "piece": piece.astype("int32"),
                "start": start, "size": part,
            })
            none = ids[sizes <= 0]
            if len(none):
                yield pd.DataFrame({"pack_id": name, id: none.array, "container": None, "piece": np.int32(0), "start": 0, "size": 0})

    kind = dict(small.dtypes)["_id"]
    return spread.mapInPandas(run, f"pack_id string, {id} {kind}, container string, piece int, start bigint, size bigint")


def packing_report(placed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per capacity: containers, units used, and the share of room that is unused."""
    cap = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])
    boxes = placed.where(F.col("container").isNotNull()).groupBy("pack_id", "container").agg(F.sum("size").alias("_used"))
    return boxes.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("_used").alias("used_tokens")).withColumn(
        "unused_share", 1 - F.col("used_tokens") / (F.col("n_containers") * F.element_at(cap, F.col("pack_id")))
    )
