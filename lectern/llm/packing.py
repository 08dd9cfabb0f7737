"""Fixed-capacity containers by best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.common import materialize

#: Items that one task packs at a time. Best fit over so many items leaves only a few containers open.
GROUP_ITEMS = 50_000


class OpenBins:
    """Open bins by remaining capacity. A leaf per capacity, an inner node counts the bins below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        self._add(room, 1)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return ``(room, bin)`` of the open bin with the least room of at least ``size``."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin number of each size; ``sizes`` must be descending and at most ``capacity``."""
    open_bins, out, n = OpenBins(capacity), [], 0
    for size in sizes:
        room, at = open_bins.take_tightest(size) or (capacity, n)
        n += at == n
        out.append(at)
        if room > size:
            open_bins.put(room - size, at)
    return out


def _pack_groups(items: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    """``key, piece, size, container, room``: every group of items packed for itself."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key", "piece"], ascending=[False, True, True], ignore_index=True)
        at = pd.Series(best_fit_decreasing(frame["size"].tolist(), capacity))
        first = ~at.duplicated()
        names = dict(zip(at[first], frame["key"][first].astype(str) + ":" + frame["piece"][first].astype(str), strict=True))
        frame["container"] = at.map(names)
        frame["room"] = capacity - frame.groupby(at)["size"].transform("sum")
        return frame[["key", "piece", "size", "container", "room"]]

    kind = items.schema["key"].dataType.simpleString()
    grouped = items.withColumn("_group", F.pmod(F.xxhash64("key", "piece", F.lit(turn)), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(lambda f: pack(f[["key", "piece", "size"]]), f"key {kind}, piece bigint, size bigint, container string, room bigint")


def pack(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``key, piece, size, container``: every item of positive size in one container of at most ``capacity``.

    An item above ``capacity`` is cut into pieces 0, 1, ...; all but the last are full and fill a container each.
    The rest is packed best-fit decreasing, hash groups of about ``group_items`` items side by side. Containers
    that stay open are dissolved and their items packed again in fewer groups, until one bounded group is left or
    dissolving no longer helps. A container is named after the key and piece of its largest item. Null, zero and
    negative sizes and null keys come out in no container; a key stored several times is one item, of its largest size.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("_n")).where(F.col("key").isNotNull() & (F.col("_n") > 0))
    sized = materialize(sized.groupBy("key").agg(F.max("_n").alias("_n")))
    full = sized.where(F.col("_n") >= capacity).select("key", F.explode(F.expr(f"sequence(0L, _n div {capacity}L - 1)")).alias("piece"))
    full = full.select("key", "piece", F.lit(capacity).cast("bigint").alias("size"), F.concat_ws(":", "key", "piece").alias("container"))
    left = sized.select("key", F.expr(f"_n div {capacity}L").alias("piece"), F.expr(f"_n % {capacity}L").alias("size")).where("size > 0")
    done, items, turn = [full], left.count(), 0
    while items:
        groups = -(-items // group_items)
        packed = materialize(_pack_groups(left, groups, capacity, turn))
        # A container with less room than the smallest item of its turn can't be improved by another one of them.
        again = packed.where(F.col("room") > 0)
        remaining = again.count() if groups > 1 else 0
        if remaining == 0 or remaining > 0.9 * items:
            done.append(packed.drop("room"))
            break
        done.append(packed.where(F.col("room") == 0).drop("room"))
        left, items, turn = again.select("key", "piece", "size"), remaining, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("key").alias(key), "piece", F.col("size").alias(size), "container")
