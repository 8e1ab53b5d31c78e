"""Sharding into contiguous runs of atomic groups whose largest shard is as small as can be.

Groups (equal texts) stand in the order of a 64-bit hash, but groups larger than an even share, of which there are fewer
than shards, stand first by falling size. The smallest feasible capacity is found by binary search, each trial filling
shards greedily. No list of groups is gathered for that: the driver holds sums of hash intervals, and refines, 4096-fold
at a time, only intervals in which a cut may fall, until the answer no longer depends on them. Many cuts are feasible
under that capacity; of those at the intervals' borders a second search takes ones whose smallest shard is largest, so
that no shard is left over. The cuts are then hash values, so assigning a row is a comparison with a few literals.
"""

from __future__ import annotations

import bisect
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.storage import cut

STEP = 12  # bits refined at a time
LO, HI = -(1 << 63), 1 << 63


class _Sums:
    """Sorted disjoint intervals (start, bits, bytes); one with bits 0 is a single group, which nothing divides."""

    def __init__(self, items):
        self.items = sorted(items)
        self.to = list(accumulate((x[2] for x in self.items), initial=0))

    def greedy(self, capacity: int, shards: int, whole: bool) -> tuple[bool, list[int]]:
        """Whether `shards` shards of that capacity hold all, and the items at which shards end.

        whole: an undivided interval is taken in whole or left (the true answer is at least as good as that);
        otherwise a shard may end inside it, which is at least as good as the truth.
        """
        at, ends, n = 0, [], len(self.items)
        base = 0
        for _ in range(shards):
            k = bisect.bisect_right(self.to, base + capacity, lo=at) - 1
            if k >= n:
                return True, ends
            ends.append(k)
            if whole or self.items[k][1] == 0:
                at, base = k, self.to[k]
            else:
                at, base = k, base + capacity
        return False, ends


def _search(sums: _Sums, shards: int, whole: bool) -> int:
    total = sums.to[-1]
    lo, hi = max((total + shards - 1) // shards, max((x[2] for x in sums.items if x[1] == 0), default=0)), max(total, 1)
    while lo < hi:
        mid = (lo + hi) // 2
        if sums.greedy(mid, shards, whole)[0]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _even(sums: _Sums, shards: int, capacity: int) -> list[int]:
    """The items at which shards end: none over the capacity, and the smallest as large as cuts between items allow."""
    to = np.array(sums.to, np.int64)

    def reach(least: int) -> list[np.ndarray] | None:
        """Which items j shards may end at, for j = 0, 1, ..."""
        low, high = np.searchsorted(to, to - capacity, "left"), np.searchsorted(to, to - least, "right")
        ways = [np.arange(len(to)) == 0]
        for _ in range(shards):
            before = np.concatenate([[0], np.cumsum(ways[-1])])
            ways.append(before[np.maximum(high, low)] > before[low])
        return ways if ways[-1][-1] else None

    lo, hi = 0, int(to[-1]) // shards
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if reach(mid):
            lo = mid
        else:
            hi = mid - 1
    ways, at, ends = reach(lo), len(to) - 1, []
    for j in range(shards - 1, 0, -1):
        a, b = np.searchsorted(to, to[at] - capacity, "left"), np.searchsorted(to, to[at] - lo, "right")
        may = a + np.flatnonzero(ways[j][a:b])
        at = int(may[np.argmin(np.abs(to[may] - to[at] * (j / (j + 1))))])
        ends.append(at)
    return ends[::-1]


def _split(rows: DataFrame, intervals: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The parts, 4096 of each, of intervals (start, bits) that hold rows, as items of _Sums."""
    out = []
    wide: dict[int, list[int]] = {}
    for start, bits in intervals:
        wide.setdefault(bits, []).append(start)
    for bits, starts in wide.items():
        step = min(STEP, bits)
        inside = F.shiftright("key", bits).isin([s >> bits for s in starts]) if bits < 64 else F.lit(True)
        cell = F.shiftright("key", bits - step) if bits - step else F.col("key")
        got = rows.where(inside).groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        out += [(r["a"], 0, r["size"]) if r["a"] == r["b"] else (r["cell"] << (bits - step), bits - step, r["size"]) for r in got]
    return out


def heavy(rows: DataFrame, shards: int) -> list[int]:
    """Keys of the groups larger than an even share, by falling size; found by refining the intervals that are."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    live, found = [(LO, 64)] if total else [], []
    while live:
        large = [x for x in _split(rows, live) if x[2] * shards > total]
        found += [x for x in large if not x[1]]
        live = [x[:2] for x in large if x[1]]
    return [k for k, _, _ in sorted(found, key=lambda x: (-x[2], x[0]))]


def ordered(key: Column, first: list[int]) -> Column:
    """Keys with those of `first` moved before all others, in that order."""
    rest = F.greatest(key, F.lit(LO + len(first)))
    return reduce(lambda out, x: F.when(key == x[1], F.lit(LO + x[0])).otherwise(out), enumerate(first), rest)


def cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """The first key of every shard but the first, and the capacity, of rows (key long, size long)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    sums = _Sums([(LO, 64, total)] if total else [])
    while True:
        if not sums.items:
            return [HI - 1] * (shards - 1), 0
        best, worst = _search(sums, shards, False), _search(sums, shards, True)
        open_at: set[int] = set()
        if best < worst or any(x[1] for x in sums.items):
            low = sums.greedy(best, shards, False)[1]
            for c in {best, worst}:
                for whole in (False, True):
                    open_at |= {k for k in sums.greedy(c, shards, whole)[1] if k < len(sums.items)}
            # between the two capacities each cut moves forward; what lies between its bounds may hold it
            high = sums.greedy(worst, shards, False)[1]
            early = sums.greedy(best, shards, True)[1]
            for j in range(shards):
                a = early[j] if j < len(early) else (low[j] if j < len(low) else None)
                b = high[j] if j < len(high) else None
                if a is not None and b is not None:
                    open_at |= set(range(min(a, b), max(a, b) + 1))
            open_at = {k for k in open_at if sums.items[k][1]}
        if not open_at:
            ends = _even(sums, shards, worst)
            at = [sums.items[k][0] if k < len(sums.items) else HI - 1 for k in ends][: shards - 1]
            return at + [HI - 1] * (shards - 1 - len(at)), worst
        keep = [x for k, x in enumerate(sums.items) if k not in open_at]
        keep += _split(rows, [sums.items[k][:2] for k in sorted(open_at)])
        sums = _Sums(keep)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs.

    size: UTF-8 bytes of the text and 1 more; a null text has size 1 and is a group of its own. Equal texts share a
    shard, so one text's copies are never divided, however many they are. Slots number a shard's rows from 0. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("key")), "shard-rows")
    rows = rows.withColumn("key", ordered(F.col("key"), heavy(rows, shards)))
    at, _ = cuts(rows, shards)
    where = F.lit(0)
    for c in at:
        where = where + (F.col("key") >= c).cast("int")
    # slots: cells of about a thousand rows by doc_id, whatever the text, then an offset for each
    n = rows.count()
    cells = max(1, n // 1024)
    rows = rows.withColumn("shard", where).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("c"))
    lists = counts.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("shard", "c"))).alias("by"))
    # running totals over cells, one row each, in groups of a thousand cells so that no window sees them all
    lists = cut(lists.withColumn("page", F.expr("cell div 1000")), "shard-cells")
    by = [F.coalesce(F.col("by")[F.lit(s)], F.lit(0)) for s in range(shards)]
    pages = lists.groupBy("page").agg(*[F.sum(by[s]).alias(f"t{s}") for s in range(shards)]).orderBy("page").collect()  # a row for a million rows of docs
    run, starts = [0] * shards, {}
    for p in pages:
        starts[p["page"]] = list(run)
        run = [a + p[f"t{s}"] for s, a in enumerate(run)]
    up = W.partitionBy("page").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    spark = docs.sparkSession
    base = spark.createDataFrame([(k, *v) for k, v in starts.items()] or [(0, *run)], ", ".join(["page long", *[f"b{s} long" for s in range(shards)]]))
    off = F.array(*[F.col(f"b{s}") + F.coalesce(F.sum(by[s]).over(up), F.lit(0)) for s in range(shards)])
    offsets = lists.join(base, "page").select("cell", off.alias("all")).select("cell", F.posexplode("all").alias("shard", "off"))
    rank = F.row_number().over(W.partitionBy("cell", "shard").orderBy("doc_id", "key")) - 1
    out = rows.withColumn("rank", rank).join(offsets, ["cell", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("off") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
