"""Replica placement by rendezvous hashing, and the plans that follow from it."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = " none"  # a missing attribute is one domain of its own

#: Brokers that every segment is scored against; the list is cluster metadata and is checked before it is broadcast.
MOST_BROKERS = 20_000


def _scored(item: Column, brokers: DataFrame) -> Column | None:
    """An array of (score, broker and its attributes), best score first, ties by broker: a row scores its own item, nothing is shuffled."""
    if brokers.limit(MOST_BROKERS + 1).count() > MOST_BROKERS:
        raise ValueError(f"more than {MOST_BROKERS} brokers")
    cols = brokers.columns
    rows = brokers.distinct().collect()
    if not rows:
        return None
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in cols]) for r in rows])
    rest = [c for c in cols if c != "broker"]
    return F.sort_array(F.transform(listed, lambda b: F.struct(F.md5(F.concat(item, F.lit("|"), b["broker"])).alias("score"), b["broker"].alias("broker"), *[b[c].alias(c) for c in rest])), False)


def ranked(items: DataFrame, brokers: DataFrame, item: str = "segment") -> DataFrame:
    """items with every broker and its rank, best score first, ties by broker."""
    order = _scored(F.col(item), brokers)
    cols = brokers.columns
    if order is None:
        return items.select("*", *[F.lit(None).cast("string").alias(c) for c in cols], F.lit(None).cast("long").alias("rank")).limit(0)
    each = items.select(*items.columns, F.posexplode(order).alias("_at", "_b"))
    return each.select(*items.columns, *[F.col(f"_b.{c}").alias(c) for c in cols], (F.col("_at") + 1).cast("long").alias("rank"))


def place(items: DataFrame, brokers: DataFrame, rf: int, item: str = "segment") -> DataFrame:
    """(item, replicas) of each row of items: the rf best brokers in order of rank; none without brokers."""
    return placed(items, brokers, rf, item).select(item, "replicas")


def placed(items: DataFrame, brokers: DataFrame, rf: int, item: str = "segment", name: str = "replicas") -> DataFrame:
    """items with the column `name`, the rf best brokers of each row in order of rank. Where none are, no rows."""
    order = _scored(F.col(item), brokers.select("broker"))
    if order is None:
        return items.withColumn(name, F.array().cast("array<string>")).limit(0)
    return items.withColumn(name, F.transform(F.slice(order, 1, rf), lambda b: b["broker"]))


def spread(items: DataFrame, brokers: DataFrame, rf: int, attribute: str, item: str = "segment") -> DataFrame:
    """(item, replicas) of each row of items: round robin over an attribute's values, values by their best broker."""
    order = _scored(F.col(item), brokers.select("broker", F.coalesce(F.col(attribute).cast("string"), F.lit(NONE)).alias("value")))
    if order is None:
        return items.select(item, F.array().cast("array<string>").alias("replicas")).limit(0)
    ranked_ = items.select(item, order.alias("_o")).withColumn("_v", F.transform("_o", lambda b: b["value"]))
    turn = lambda b, i: F.size(F.filter(F.slice("_v", 1, i), lambda v: v == b["value"]))
    turns = F.transform("_o", lambda b, i: F.struct(turn(b, i).alias("turn"), F.array_position("_v", b["value"]).alias("best"), b["broker"].alias("broker")))
    return ranked_.select(item, F.transform(F.slice(F.sort_array(turns), 1, rf), lambda b: b["broker"]).alias("replicas"))


def domains(replicas: DataFrame, brokers: DataFrame, attribute: str, keys: Sequence[str]) -> DataFrame:
    """(keys, covered): the different values of an attribute among replicas; a missing one counts as a value."""
    each = replicas.select(*keys, F.explode("replicas").alias("broker"))
    value = brokers.select("broker", F.col(attribute).cast("string").alias("value"))
    return each.join(value, "broker", "left").groupBy(*keys).agg(F.countDistinct(F.coalesce("value", F.lit(NONE))).alias("covered"))


def place_hard(items: DataFrame, brokers: DataFrame, rf: int, attribute: str, min_domains: int, item: str = "segment") -> DataFrame:
    """spread() with a verdict: insufficient_domains where fewer than min_domains values are covered."""
    s = spread(items, brokers, rf, attribute, item)
    status = F.when(F.col("covered") < min_domains, "insufficient_domains").otherwise("ok")
    return s.join(domains(s, brokers, attribute, [item]), item).select(item, "replicas", "covered", F.lit(min_domains).cast("long").alias("required"), status.alias("status"))


def domain_violations(segments: DataFrame, brokers: DataFrame, attribute: str, min_domains: int) -> DataFrame:
    """(topic, violations): segments that span fewer domains than they should."""
    c = domains(segments.select("topic", "segment", F.col("replica_set").alias("replicas")), brokers, attribute, ["topic", "segment"])
    return c.where(F.col("covered") < min_domains).groupBy("topic").agg(F.count("*").alias("violations"))


def under_replicated(segments: DataFrame, live: Sequence[str], rf: int) -> DataFrame:
    """Segments with fewer different live replicas than the cluster can give them."""
    target = min(rf, len(set(live)))
    n = F.size(F.array_intersect(F.array_distinct("replica_set"), F.array(*[F.lit(b) for b in live])))
    return segments.withColumn("live_replicas", n.cast("long")).where(F.col("live_replicas") < target)


def heal(segments: DataFrame, brokers: DataFrame, live: Sequence[str], rf: int) -> DataFrame:
    """under_replicated segments with their new replicas."""
    bad = under_replicated(segments, live, rf)
    return placed(bad, brokers.where(F.col("broker").isin(list(live))), rf).select("topic", "segment", "state", "replica_set", "replicas")


def heal_sealed(segments: DataFrame, brokers: DataFrame, live: Sequence[str], rf: int) -> DataFrame:
    """For sealed ones: what to copy, from where, or why not."""
    h = heal(segments, brokers, live, rf).where("state = 'sealed'")
    add = F.array_except("replicas", "replica_set")
    sources = F.array_intersect("replica_set", F.array(*[F.lit(b) for b in live]))
    status = F.when(F.size("to_add") == 0, "no_copy").when(F.size(sources) == 0, "no_live_source").otherwise("copy")
    return h.withColumn("to_add", add).select("topic", "segment", "replicas", "to_add", F.get(sources, F.lit(0)).alias("source"), status.alias("status"))


def failover(segments: DataFrame, live: Sequence[str]) -> DataFrame:
    """Active segments with a dead primary and a live replica, which becomes the primary."""
    alive = F.array(*[F.lit(b) for b in live])
    first = F.get(F.filter("replica_set", lambda b: F.array_contains(alive, b)), F.lit(0))
    s = segments.where((F.col("state") == "active") & ~F.array_contains(alive, F.get("replica_set", F.lit(0)))).withColumn("promoted", first).where("promoted is not null")
    return s.select("topic", "segment", "promoted", F.concat(F.array("promoted"), F.array_remove("replica_set", F.col("promoted"))).alias("replicas"))


def quorum_commit(segments: DataFrame, acks: DataFrame) -> DataFrame:
    """(segment, commit_offset): the highest offset that a majority of the replica set has; null if it has none.

    Acks of brokers outside the set do not count; of one broker, the highest does.
    """
    each = segments.select("segment", F.size("replica_set").alias("n"), F.explode("replica_set").alias("broker"))
    best = acks.groupBy("segment", "broker").agg(F.max("offset").alias("offset"))
    got = each.join(best, ["segment", "broker"], "left").groupBy("segment", "n").agg(F.sort_array(F.collect_list(F.coalesce("offset", F.lit(-1).cast("long"))), False).alias("o"))
    q = F.element_at("o", (F.floor(F.col("n") / 2) + 1).cast("int"))
    return got.select("segment", F.when(q >= 0, q).alias("commit_offset"))


def catchup_gap(source: DataFrame, target: DataFrame, batch: int = 1000) -> DataFrame:
    """(segment, batch_no, first, last, records): what a replica lacks, in copy batches."""
    gap = source.join(target, ["segment", "offset"], "left_anti")
    return gap.withColumn("batch_no", F.expr(f"offset div {batch}")).groupBy("segment", "batch_no").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("records"))


def place_balanced(items: Sequence[str], brokers: Sequence[str], rf: int, max_skew: int = 1) -> list[tuple[str, list[str]]]:
    """Placement with loads at most max_skew apart: a sequential choice over few items (vnodes), so it runs on the driver."""
    brokers = list(dict.fromkeys(brokers))
    if not brokers:
        return [(i, []) for i in items]
    want = min(rf, len(brokers))
    cap = -(-len(items) * want // len(brokers)) + max_skew - 1
    load, out = dict.fromkeys(brokers, 0), []
    for i in items:
        order = sorted(brokers, key=lambda b: (hashlib.md5(f"{i}|{b}".encode()).hexdigest(), b), reverse=True)
        room = [b for b in order if load[b] < cap]
        full = sorted((b for b in order if load[b] >= cap), key=load.__getitem__)
        got = (room[:want] + full)[:want]
        for b in got:
            load[b] += 1
        out.append((i, got))
    return out


def apply_heal(segments: DataFrame, commands: DataFrame) -> DataFrame:
    """segments with the replica sets of commands (segment, seq, replicas); of several commands for one, the last counts."""
    last = commands.groupBy("segment").agg(F.max_by("replicas", "seq").alias("_r"))
    return segments.join(last, "segment", "left").withColumn("replica_set", F.coalesce("_r", "replica_set")).drop("_r")
