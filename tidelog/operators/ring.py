"""Consistent-hash ring of vnodes: routing, arcs, growth, placement and rebalancing."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.keyspace import RING, hash32
from tidelog.operators.placement import placed

#: A ring is cluster metadata: a few thousand vnodes at most.
MOST_VNODES = 20_000


def owner(hash_: Column, ring: Sequence[tuple[str, int]], size: int = RING) -> Column:
    """The vnode with the first token at or after a hash in [0, size), else that with the smallest token.

    The hash space is cut into about as many blocks as there are tokens; a row looks only at the tokens of its block and
    the first one after it.
    """
    if len(ring) > MOST_VNODES:
        raise ValueError("too many vnodes")
    order = sorted(ring, key=lambda x: x[1])
    if not order:
        return F.lit(None).cast("string")
    tokens = [t for _, t in order]
    bits = max(0, (max(size, tokens[-1] + 1) - 1).bit_length() - len(order).bit_length())
    blocks = (max(size, tokens[-1] + 1) - 1 >> bits) + 1
    first = F.array(*[F.lit(bisect.bisect_left(tokens, b << bits)) for b in range(blocks + 1)])
    pairs = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(v).alias("v")) for v, t in order])
    block = F.shiftright(hash_, bits).cast("int")
    a, b = F.get(first, block), F.get(first, block + 1)
    hit = F.get(F.filter(F.slice(pairs, a + 1, b - a + 1), lambda p: p["t"] >= hash_), F.lit(0))["v"]
    return F.coalesce(hit, F.lit(order[0][0]))


def vnodes_of(ring: DataFrame) -> list[tuple[str, int]]:
    return [(r["vnode"], r["token"]) for r in ring.limit(MOST_VNODES + 1).collect()]


def route(keys: DataFrame, key: str, ring: DataFrame, size: int = RING) -> DataFrame:
    h = F.pmod(hash32(F.col(key)), F.lit(size))
    return keys.withColumn("hash", h).withColumn("vnode", owner(F.col("hash"), vnodes_of(ring), size))


def arcs(ring: DataFrame, size: int = RING) -> DataFrame:
    """(vnode, start, stop, length): what each vnode owns, start exclusive, stop inclusive, round the ring."""
    w = W.orderBy("token")  # cluster metadata, a row a vnode
    start = F.coalesce(F.lag("token").over(w), F.max("token").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    length = F.when(F.col("start") < F.col("stop"), F.col("stop") - F.col("start")).when(F.col("start") > F.col("stop"), F.lit(size) - F.col("start") + F.col("stop")).otherwise(F.lit(size))
    return ring.select("vnode", start.alias("start"), F.col("token").alias("stop")).withColumn("length", length.cast("long"))


def largest_arc(ring: DataFrame, size: int = RING) -> DataFrame:
    return arcs(ring, size).orderBy(F.desc("length"), F.desc("vnode")).limit(1)


def displaced(topics: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Topics whose vnode changes when the ring does."""
    h = hash32(F.col("topic"))
    both = topics.select("topic", owner(h, vnodes_of(before)).alias("from_vnode"), owner(h, vnodes_of(after)).alias("to_vnode"))
    return both.where("from_vnode <> to_vnode")


def reshard_plan(ring: Sequence[tuple[str, int]], target: int, size: int = RING, prefix: str = "vnode") -> tuple[str, list | str]:
    """('ok', steps) to grow a ring: each step halves the largest arc; steps are (new vnode, token, split from)."""
    ring = list(ring)
    if not ring:
        return "error", "empty_ring"
    if target < len(ring):
        return "error", "cannot_shrink"
    steps = []
    while len(ring) < target:
        order = sorted(ring, key=lambda x: x[1])
        spans = [((t - order[k - 1][1]) % size or size, v, order[k - 1][1]) for k, (v, t) in enumerate(order)]
        length, v, start = max(spans)
        if length < 2:
            return "error", "ring_too_dense"
        token = (start + length // 2) % size
        if token in (t for _, t in ring):
            return "error", "ring_step_failed"
        ring.append((f"{prefix}_{token}", token))
        steps.append((f"{prefix}_{token}", token, v))
    return "ok", steps


def rebalance(current: DataFrame, desired: DataFrame) -> DataFrame:
    """(vnode, add, remove) of the vnodes whose nodes change; a vnode absent from current has none yet."""
    c = current.select("vnode", F.col("replicas").alias("now"))
    d = desired.select("vnode", F.col("replicas").alias("want"))
    none = F.array().cast("array<string>")
    both = d.join(c, "vnode", "left").withColumn("now", F.coalesce("now", none))
    return both.select("vnode", F.array_except("want", "now").alias("add"), F.array_except("now", "want").alias("remove")).where((F.size("add") > 0) | (F.size("remove") > 0))


def vnode_placement(ring: DataFrame, nodes: DataFrame, rf: int) -> DataFrame:
    return placed(ring, nodes, rf, "vnode")


def apply_plan(vnodes: DataFrame, plan: DataFrame) -> DataFrame:
    """vnodes (vnode, replicas) after a rebalance plan (vnode, add, remove): members are added first, then others removed. Applying it again changes nothing."""
    p = plan.select("vnode", "add", "remove")
    after = F.array_except(F.array_union("replicas", F.coalesce("add", F.array().cast("array<string>"))), F.coalesce("remove", F.array().cast("array<string>")))
    return vnodes.join(p, "vnode", "left").withColumn("replicas", after).drop("add", "remove")


def leading(vnodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """(vnode, node): the vnodes that each node leads, of vnodes (vnode, replicas) and leaders (vnode, leader); a leader must be one of its vnode's replicas."""
    return vnodes.join(leaders, "vnode").where(F.array_contains("replicas", F.col("leader"))).select("vnode", F.col("leader").alias("node"))

def stable_plans(ticks: DataFrame, needed: int) -> DataFrame:
    """(scope, tick, plan, run): ticks at which a non-empty plan has been the same for `needed` ticks in a row, and is committed.

    A run is a stretch of equal plans; after a commit counting begins again, so commits fall on its multiples.
    """
    w = W.partitionBy("scope").orderBy("tick")
    changed = (F.coalesce(F.lag("plan").over(w), F.lit("\0")) != F.col("plan")).cast("int")
    runs = ticks.withColumn("changed", changed)
    runs = runs.withColumn("island", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    n = F.row_number().over(W.partitionBy("scope", "island").orderBy("tick"))
    return runs.withColumn("run", n.cast("long")).where((F.col("plan") != "") & (F.col("run") % needed == 0)).select("scope", "tick", "plan", "run")


def newest_topology(views: DataFrame) -> DataFrame:
    """The view of the highest version of each ring, ties by content: any order of merging gives it."""
    best = views.groupBy("ring").agg(F.max(F.struct("version", "topology")).alias("b"))
    return best.select("ring", "b.version", "b.topology")
