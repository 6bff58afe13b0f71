"""Filling containers of fixed capacity.

Karmarkar-Karp multiway differencing: every item begins as a partial partition of ``m`` windows; the two partitions that
are least even are merged again and again, the fullest windows of one with the emptiest of the other, until one is left.
Its windows are nearly equal; while the fullest exceeds the capacity, ``m`` rises by one. Items go to groups of bounded
size by a hash, so that no task ever holds more than a group.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.encode import TOKENIZER, token_counts
from lexmill.session import materialise

#: Tokens a container holds.
CAPACITY = 2048
#: Items packed together, about.
GROUP_ITEMS = 2000


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``m`` windows of nearly equal sums, by multiway differencing (some may be empty)."""
    # an entry: minus its spread, a number that breaks ties, and its windows that are not empty, fullest first, each
    # (sum above the emptiest, tree of its items); trees are joined in constant time
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - m
        if over > 0:
            # the last `over` windows of a meet those of b in reverse order
            split = len(a) - over
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[split:], reversed(b[len(b) - over :]), strict=True)]
            windows = a[:split] + b[: len(b) - over] + met
        else:
            windows = a + b
        windows.sort(key=lambda w: -w[0])
        if len(windows) == m and windows[-1][0]:
            low = windows[-1][0]
            windows = [(s - low, tree) for s, tree in windows]
        spread = windows[0][0] - (windows[-1][0] if len(windows) == m else 0)
        heapq.heappush(heap, (-spread, count, windows))
        count += 1
    out: list[list[int]] = [[] for _ in range(m)]
    for window, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                out[window].append(node)
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size, none above ``capacity``; sizes of 0 go to window 0. Sizes must not exceed the capacity."""
    big = [i for i, s in enumerate(sizes) if s > 0]
    where = [0] * len(sizes)
    m = max(1, math.ceil(sum(sizes) / capacity))
    while big:
        windows = difference([sizes[i] for i in big], m)
        if max(sum(sizes[big[i]] for i in w) for w in windows) <= capacity:
            for number, w in enumerate(windows):
                for i in w:
                    where[big[i]] = number
            break
        m += 1
    return where


def _pack_group(capacity: int, groups: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "n_tokens", "row"], ignore_index=True)
        numbers = pack(items["n_tokens"].tolist(), capacity)
        items["container_id"] = pd.Series(numbers, dtype="int64") * groups + items["bin"]
        return items[["doc_id", "piece", "token_start", "n_tokens", "container_id"]]

    return run


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers for items of given sizes: ``(doc_id, piece, token_start, n_tokens, container_id)``.

    ``items(doc_id, n_tokens)``, one container at least for each group. An item above the capacity becomes pieces of full
    capacity, each a container of its own with an id below zero, given out in the tasks without a group, and a rest packed
    like any item; all others stay whole (piece 0). Items of size 0 or null share a container as rows of 0 tokens. Repeated
    rows are items of their own and are spread over the groups. An empty table gives no row. No container holds more than
    ``capacity``. The ids of the containers of a group are its number plus multiples of the number of groups, so none is
    ever given twice.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    items = materialise(items.select("doc_id", size.alias("n_tokens")).withColumn("row", F.monotonically_increasing_id()), "p8-sizes")
    groups = max(1, math.ceil(items.count() / group_items))
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}"))
    full = items.where(F.col("n_tokens") > capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("piece"))
    full = full.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), (-1 - F.monotonically_increasing_id()).alias("container_id"))
    start = last * capacity
    rests = items.select("doc_id", last.cast("int").alias("piece"), start.alias("token_start"), (F.col("n_tokens") - start).alias("n_tokens"), "row", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).alias("bin"))
    packed = rests.groupBy("bin").applyInPandas(_pack_group(capacity, groups), "doc_id long, piece int, token_start long, n_tokens long, container_id long")
    return packed.unionByName(materialise(full, "p8-full"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers for documents measured in tokens; see :func:`pack_items`. Null and empty texts have 0 tokens."""
    return pack_items(token_counts(documents, tokenizer=tokenizer), capacity, group_items)


def audit(assigned: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``(n_items, n_overfull, n_misplaced, n_split, well_filled)``.

    Containers above the capacity, items of ``sizes(doc_id, n_tokens)`` (ids unique) whose pieces do not add up to them, and
    items in more pieces than their size asks for; ``well_filled`` if the containers are at most 1.1 times as many as the
    tokens would fill, and one.
    """
    boxes = containers(assigned, capacity).agg(F.count_if(F.col("used") > capacity).alias("n_overfull"), F.count(F.lit(1)).alias("__boxes"), F.coalesce(F.sum("used"), F.lit(0)).alias("__used"))
    placed = assigned.groupBy("doc_id").agg(F.sum("n_tokens").alias("__sum"), F.count(F.lit(1)).alias("__pieces"))
    n = F.coalesce("n_tokens", F.lit(0))
    items = sizes.join(placed, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.coalesce(F.col("__sum") != n, F.lit(True))).alias("n_misplaced"),
        F.count_if(F.col("__pieces") > F.greatest(F.lit(1), F.ceil(n / capacity))).alias("n_split"),
    )
    filled = F.col("__boxes") <= 1.1 * F.ceil(F.col("__used") / capacity) + 1
    return items.join(F.broadcast(boxes), F.lit(True)).select("n_items", "n_overfull", "n_misplaced", "n_split", filled.alias("well_filled"))


def containers(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each container: ``(container_id, n_pieces, used, free)``."""
    used = F.sum("n_tokens")
    return assigned.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), used.alias("used"), (F.lit(capacity) - used).alias("free"))
