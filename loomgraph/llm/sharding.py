"""Contiguous sharding of atomic groups with the smallest possible largest shard.

Groups (documents of equal text) are ordered by the hash of their text.  The
capacity is found by binary search: a capacity is feasible if cutting greedily,
each shard as long as it fits, needs no more shards than there are.  The
smallest feasible one is exact, at the level of single groups, though the
driver never sees the groups: it sees sums over ranges of the order, and looks
closer only into those ranges where a cut of some still possible capacity can
fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import ranked
from .runtime import checkpointed, table

#: Sums that the driver holds at once, at most about so many times the number of shards.
FAN = 4096


def group_key(text: Column) -> Column:
    """The place of a text in the order, as 16 hexadecimal digits and the whole digest behind them; null texts are one group."""
    return F.coalesce(F.sha2(text, 256), F.lit("0" * 64))


class Search:
    """Binary search over capacities on sums of consecutive ranges; atomic says which ranges are single groups."""

    def __init__(self, sums: list[int], atomic: list[bool], shards: int):
        self.ends = [0]
        for s in sums:
            self.ends.append(self.ends[-1] + s)
        self.sums, self.atomic, self.shards = sums, atomic, shards

    def greedy(self, capacity: int, optimistic: bool) -> bool:
        """Whether shards of this capacity hold all, if a range that a cut falls into were cut at any byte (optimistic) or not at all."""
        from bisect import bisect_right

        at, total = 0, self.ends[-1]
        for _ in range(self.shards):
            if at >= total:
                return True
            to = at + capacity
            k = bisect_right(self.ends, to) - 1  # ranges that end by then
            if optimistic and k < len(self.sums) and not self.atomic[k]:
                at = min(to, total)
            else:
                at = max(at, self.ends[k])
        return at >= total

    def smallest(self, optimistic: bool) -> int:
        low, high = 0, self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, optimistic):
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, low: int, high: int) -> list[int]:
        """Ranges, not atomic, that the end of shard 1, 2, ... can fall into for capacities from low to high."""
        from bisect import bisect_left, bisect_right

        out: set[int] = set()
        start_low = start_high = 0
        for _ in range(self.shards):
            start_low, start_high = start_low + low, start_high + high
            a, b = bisect_right(self.ends, start_low) - 1, bisect_left(self.ends, start_high)
            # The low chain loses at most what the range it falls into holds.
            start_low = self.ends[max(0, min(a, len(self.sums)))]
            out.update(k for k in range(max(a, 0), min(b + 1, len(self.sums))) if not self.atomic[k])
            start_high = min(start_high, self.ends[-1])
        return sorted(out)

    def cuts(self, capacity: int) -> list[int]:
        """For each shard but the last, the index of the range after it."""
        from bisect import bisect_right

        at, out = 0, []
        for _ in range(self.shards - 1):
            k = min(bisect_right(self.ends, at + capacity) - 1, len(self.sums))
            out.append(k)
            at = self.ends[k]
        return out


def boundaries(groups: DataFrame, shards: int, fan: int = FAN) -> tuple[list[str], int]:
    """Smallest keys of shards 1, 2, ... and the capacity, for groups (key, size), one row a group.

    Level by level: sums of size by the key's first digits; then finer ones
    only within the ranges where a cut can fall.  Each level narrows such a
    range 256-fold, until what is open has few enough groups to look at each.
    """
    digits = 3
    rows = groups.groupBy(F.substring("key", 1, digits).alias("k")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()  # at most 4096
    ranges = [(r["k"], int(r["s"]), int(r["n"])) for r in rows]
    while True:
        search = Search([s for _, s, _ in ranges], [n == 1 for *_, n in ranges], shards)
        low, high = search.smallest(True), search.smallest(False)
        open_ = search.open(low, high)
        if not open_ or low == high and all(ranges[k][2] == 1 for k in open_):
            break
        inside = [ranges[k] for k in open_]
        if sum(n for *_, n in inside) <= fan * 8:  # few groups: each on its own
            finer, to = F.col("key"), 64
        else:
            digits = max(len(k) for k, *_ in inside) + 2
            finer, to = F.substring("key", 1, digits), digits
        wanted = None
        for length in sorted({len(k) for k, *_ in inside}):
            one = F.substring("key", 1, length).isin([k for k, *_ in inside if len(k) == length])
            wanted = one if wanted is None else wanted | one
        rows = groups.where(wanted).groupBy(finer.alias("k")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
        kept = [r for k, r in enumerate(ranges) if k not in set(open_)]
        ranges = sorted(kept + [(r["k"], int(r["s"]), int(r["n"])) for r in rows])
        if to == 64 and not Search([s for _, s, _ in ranges], [n == 1 for *_, n in ranges], shards).open(low, high):
            break
    search = Search([s for _, s, _ in ranges], [n == 1 for *_, n in ranges], shards)
    capacity = search.smallest(False)
    return [ranges[k][0] if k < len(ranges) else "g" for k in search.cuts(capacity)], capacity


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 1; documents of equal
    text stay together, null texts are one such group, apart from empty ones.
    Repeated rows each get a slot.  text_crc32 of a null text is that of
    nothing, 0.  An empty table gives an empty result; other columns are left
    out.  A copy group larger than a fair share makes one large shard, since it
    is atomic.
    """
    sized = checkpointed(docs.select(docs[key].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("text_crc32"), group_key(docs[text]).alias("key")))
    groups = sized.groupBy("key").agg(F.sum("size").alias("size"))
    cuts, _ = boundaries(groups, shards)
    place = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    slots = ranked(sized.withColumn("shard", place), "shard", ["doc_id", "key", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard(table(spark, sf_dir, "documents"), 8)
