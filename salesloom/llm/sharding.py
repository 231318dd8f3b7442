"""Shards of near-equal size from indivisible groups, by best-fit-decreasing packing.

Groups of equal texts stay together. Sorted by falling size, each group enters the
bin with the tightest remaining capacity that still holds it; a balanced tree keeps
the bins by what they have left. ``fewest_bins`` opens bins of a fixed capacity as
needed. ``even_bins`` seeks the smallest capacity at which a fixed number of bins is
enough (by halving, as in the multifit rule), so the bins come out nearly equal; a
group above the fair share takes a bin alone and the rest is shared out anew.

The driver packs the histogram of the groups' sizes, not the groups. Groups of one size
are a run: the tightest bin that holds one of them takes as many as it can, then the
next, which is what best fit does with them one by one. Different sizes add up to all
bytes at most, so a table of B bytes has fewer than sqrt(2 B) of them (14 million for
100 TB, and far fewer where texts have usual lengths). Spark then numbers the groups of
each size, range by range, and looks up the bin of each number; each size is one row of
that table, so a frequent size costs no more.

Defined results: a null text counts as an empty one. Repeated rows and ids are placed
row by row. Ties are broken by hash, so a run can be repeated. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.ordered import total_before
from salesloom.workspace import stage

SHARDS = 24
ROW_BYTES = 8
# Rows per block of a shard when places in it are counted.
BLOCK_ROWS = 100_000


class CapacityTree:
    """Bins by what they have left, in a treap: a search tree balanced by random ranks."""

    def __init__(self, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.key: list[tuple[int, int]] = []
        self.rank: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.root = -1

    def _split(self, node: int, key: tuple[int, int]) -> tuple[int, int]:
        """Trees of the keys below ``key`` and of the others."""
        if node < 0:
            return -1, -1
        if self.key[node] < key:
            low, high = self._split(self.right[node], key)
            self.right[node] = low
            return node, high
        low, high = self._split(self.left[node], key)
        self.left[node] = high
        return low, node

    def _join(self, low: int, high: int) -> int:
        if low < 0 or high < 0:
            return max(low, high)
        if self.rank[low] > self.rank[high]:
            self.right[low] = self._join(self.right[low], high)
            return low
        self.left[high] = self._join(low, self.left[high])
        return high

    def add(self, left: int, name: int) -> None:
        self.key.append((left, name))
        self.rank.append(float(self.rng.random()))
        self.left.append(-1)
        self.right.append(-1)
        low, high = self._split(self.root, (left, name))
        self.root = self._join(self._join(low, len(self.key) - 1), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least left that is at least ``size``."""
        node, best = self.root, -1
        while node >= 0:
            if self.key[node] >= (size, -1):
                node, best = self.left[node], node
            else:
                node = self.right[node]
        if best < 0:
            return None
        left, name = self.key[best]
        low, rest = self._split(self.root, (left, name))
        _, high = self._split(rest, (left, name + 1))
        self.root = self._join(low, high)
        return left, name


def best_fit(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Bin of each size, sizes falling. None when ``most`` bins are not enough."""
    tree, bins = CapacityTree(), 0
    places = np.empty(len(sizes), dtype=np.int64)
    if most is not None:
        for name in range(most):
            tree.add(capacity, name)
        bins = most
    for i, size in enumerate(sizes.tolist()):
        found = tree.take_tightest(size)
        if found is None:
            if most is not None or size > capacity:
                return None
            found, bins = (capacity, bins), bins + 1
        left, name = found
        tree.add(left - size, name)
        places[i] = name
    return places


def fewest_bins(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of a fixed capacity, as few as best fit opens. A larger size is an error."""
    order = np.argsort(-sizes, kind="stable")
    places = best_fit(sizes[order], capacity)
    if places is None:
        raise ValueError("a group is larger than the capacity")
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = places
    return out


def even_bins(sizes: np.ndarray, bins: int) -> np.ndarray:
    """A fixed number of bins at the smallest capacity that best fit needs."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].astype(np.int64)
    places = np.empty(len(sizes), dtype=np.int64)
    alone, total = 0, int(falling.sum())
    while alone < min(bins - 1, len(falling)) and falling[alone] * (bins - alone) > total:
        places[alone] = alone
        total -= int(falling[alone])
        alone += 1
    rest, free = falling[alone:], bins - alone
    if len(rest):
        low = max(-(-total // free), int(rest[0]))
        high = low + int(rest[0])
        best = best_fit(rest, high, free)
        while low < high:
            middle = (low + high) // 2
            found = best_fit(rest, middle, free)
            if found is None:
                low = middle + 1
            else:
                high, best = middle, found
        places[alone:] = best + alone
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = places
    return out


Runs = list[tuple[int, int, int]]


def fit_runs(sizes: list[int], counts: list[int], capacity: int, bins: int, first: int = 0) -> Runs | None:
    """(size, bin, number of groups) of best fit for ``counts`` groups of each size, sizes
    falling. None when the bins, named from ``first``, are not enough."""
    tree, out = CapacityTree(), []
    for name in range(bins):
        tree.add(capacity, first + name)
    for size, count in zip(sizes, counts, strict=True):
        while count:
            found = tree.take_tightest(size)
            if found is None:
                return None
            left, name = found
            taken = min(count, left // size)
            out.append((size, name, taken))
            tree.add(left - taken * size, name)
            count -= taken
    return out


def even_runs(sizes: np.ndarray, counts: np.ndarray, bins: int) -> Runs:
    """``even_bins`` of a histogram: a fixed number of bins at the smallest capacity."""
    order = np.argsort(-sizes, kind="stable")
    falling, left = sizes[order].tolist(), counts[order].tolist()
    total, out, free = sum(s * n for s, n in zip(falling, left, strict=True)), [], bins
    while free > 1 and falling and falling[0] * free > total:
        out.append((falling[0], bins - free, 1))
        total, free, left[0] = total - falling[0], free - 1, left[0] - 1
        if not left[0]:
            falling, left = falling[1:], left[1:]
    if not falling:
        return out
    low = max(-(-total // free), falling[0])
    high = low + falling[0]
    best = fit_runs(falling, left, high, free, bins - free)
    while low < high:
        middle = (low + high) // 2
        found = fit_runs(falling, left, middle, free, bins - free)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return out + best


def _run_ends(runs: Runs) -> pa.Table:
    """One row per size: bytes, and the bins of its groups with the number that ends each."""
    bounds: dict[int, list[dict]] = {}
    for size, name, taken in runs:
        own = bounds.setdefault(size, [])
        own.append({"end": taken + (own[-1]["end"] if own else 0), "shard": name})
    kind = pa.list_(pa.struct([("end", pa.int64()), ("shard", pa.int32())]))
    return pa.table(
        {"bytes": pa.array(list(bounds), pa.int64()), "runs": pa.array(list(bounds.values()), kind)}
    )


def sharded(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """Place of each row: doc_id, size, text_crc32, group, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8, ``group`` the hash of the text, and
    ``slot`` numbers the rows of a shard without gaps.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(whole.cast("binary"))).alias("group"),
    )
    rows = stage(rows, "sized")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = stage(groups, "groups")
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).toArrow()
    count = int(histogram.column("rows").to_numpy().sum())
    runs = even_runs(histogram.column("bytes").to_numpy(), histogram.column("n").to_numpy(), shards)
    ends = spark.createDataFrame(_run_ends(runs))
    numbered = total_before(groups.withColumn("one", F.lit(1)), ["bytes"], "group", {"one": "number"})
    own = F.filter("runs", lambda r: r["end"] > F.col("number"))[0]["shard"]
    by_group = numbered.join(ends, "bytes").select("group", own.alias("shard"))
    return with_slots(rows.join(by_group, "group"), count, shards)


def with_slots(placed: DataFrame, count: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0, in blocks that a task can hold.

    Blocks are hashes of the row, so that one group does not fill one. Equal rows are
    spread by a number of their own within the written table.
    """
    blocks = max(1, -(-count // (BLOCK_ROWS * shards)) * 2)
    placed = stage(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    # shards * blocks rows; a window of one shard holds one number per block.
    before = F.expr("sum(_n) over (partition by shard order by _block) - _n")
    counts = counts.select("shard", "_block", before.alias("_before"))
    numbered = placed.withColumn(
        "_place", F.expr("row_number() over (partition by shard, _block order by _row) - 1")
    )
    slotted = numbered.join(counts, ["shard", "_block"])
    slotted = slotted.withColumn("slot", (F.col("_before") + F.col("_place")).cast("long"))
    return slotted.drop("_row", "_block", "_before", "_place")
