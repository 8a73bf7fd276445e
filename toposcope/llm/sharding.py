"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of rows that must stay together are sorted by size and each enters the shard whose remaining capacity
is tightest, found in a balanced tree. The driver packs the groups above a 1024th of the data or a 16th of a shard
by themselves, and the smaller ones in crates of the hash of their key, with exact sizes: some 32 crates a shard,
4,096 at least, and twice as many until none exceeds the capacity. The rule is the same for any number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toposcope.settings import stored

BIG_PARTS = 1024  # a group larger than a 1024th of all bytes is an item of its own
CRATES = 4096
SHARD_PARTS = 16  # and so is one larger than a 16th of a shard
DRIVER_GROUPS = 100_000  # read no more: packing does not depend on the number of groups
SLOT_ROWS = 50_000


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int], priority: float) -> None:
        self.key, self.priority, self.left, self.right = key, priority, None, None


class Capacities:
    """Remaining capacities ``(left, shard)`` in a treap (a randomly balanced search tree)."""

    def __init__(self) -> None:
        self._root, self._draw = None, Random(1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, left: int, shard: int) -> None:
        low, high = self._split(self._root, (left, shard))
        self._root = self._merge(self._merge(low, _Node((left, shard), self._draw.random())), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest remaining capacity of ``size`` or more."""
        low, high = self._split(self._root, (size, -1))
        best = high
        while best is not None and best.left is not None:
            best = best.left
        if best is not None:
            one, high = self._split(high, (best.key[0], best.key[1] + 1))
        self._root = self._merge(low, high)
        return best.key if best is not None else None


@dataclass
class Packed:
    shard: list[int]
    shards: int


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> Packed:
    """Shard of every item. An item larger than ``capacity`` gets a shard of its own."""
    tree, shard, opened = Capacities(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), opened)
            opened += 1
        shard[i] = found[1]
        if found[0] > sizes[i]:
            tree.add(found[0] - sizes[i], found[1])
    return Packed(shard, opened)


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """A capacity, least to within a 10,000th of the mean, with which the items fit into ``shards`` shards."""
    total = sum(sizes)
    low, high = max(-(-total // shards), max(sizes, default=0), 1), 2 * max(total // shards + max(sizes, default=0), 1)
    while high - low > max(1, total // shards // 10_000):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(sizes, middle).shards <= shards else (middle, high)
    return high


def pack(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``; rows with equal texts share a shard.

    With ``shards``, the capacity is the least that fills so many (law ``bytes``: their sizes are near equal);
    with ``capacity``, shards of at most so many bytes, as few as best fit finds; only a single group above the
    capacity has a larger shard, of its own. Size is the text's UTF-8 bytes plus 1;
    a null text counts as empty and groups with empty ones. Slots run from 0 in each shard without a gap, and are
    given in parts of some 50,000 rows, so that neither a shard nor a group is numbered in one task. Repeated
    rows and null ids each get a slot. An empty table gives no rows. Other columns are not read.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_md5"))
    rows = stored(rows)
    groups = stored(rows.groupBy("text_md5", "size").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    limit = capacity or max(1, total // shards)
    n_crates = max(CRATES, 2 * SHARD_PARTS * -(-total // limit))
    crate = lambda: F.pmod(F.xxhash64("text_md5", "size"), F.lit(n_crates)).cast("int")
    alone = (F.col("bytes") * BIG_PARTS > total) | (F.col("bytes") * SHARD_PARTS > limit)
    big = groups.where(alone)
    while True:
        crates = groups.where(~alone).groupBy(crate().alias("crate")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("crate").collect()
        if all(r.bytes <= limit for r in crates):
            break
        n_crates *= 2
    items = [(r.text_md5, None, r.bytes, r.n) for r in big.orderBy("text_md5", "size").collect()] + [(None, r.crate, r.bytes, r.n) for r in crates]
    sizes = [i[2] for i in items]
    placed = best_fit_decreasing(sizes, capacity or smallest_capacity(sizes, shards))

    # Rows of each item in its shard's order: where its slots begin, and over how many parts its rows are numbered.
    begin: dict[int, int] = {}
    plan = []
    for k, (md5, own_crate, _, n) in enumerate(items):
        s = placed.shard[k]
        plan.append((k, bytes(md5) if md5 is not None else None, own_crate, s, begin.get(s, 0), -(-n // SLOT_ROWS)))
        begin[s] = begin.get(s, 0) + n
    table = docs.sparkSession.createDataFrame(plan, "item int, text_md5 binary, crate int, shard int, begin long, parts long")
    own = F.broadcast(table.where("text_md5 is not null").drop("crate"))
    rest = F.broadcast(table.where("crate is not null").select(F.col("item").alias("item2"), "crate", F.col("shard").alias("shard2"), F.col("begin").alias("begin2"), F.col("parts").alias("parts2")))
    put = rows.withColumn("crate", crate()).join(own, "text_md5", "left").join(rest, "crate", "left")
    put = put.select("doc_id", "size", "text_crc32", *[F.coalesce(c, f"{c}2").alias(c) for c in ("item", "shard", "begin", "parts")])
    put = put.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")))
    counts = put.groupBy("item", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("item", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")))
    number = F.row_number().over(Window.partitionBy("item", "part").orderBy("doc_id", "text_crc32")) - 1
    slot = (F.col("begin") + F.col("skip") + F.col("number")).cast("long")
    numbered = put.withColumn("number", number).join(starts, ["item", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
