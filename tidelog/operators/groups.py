"""Consumer groups and membership: who is alive, who reads what, who coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.folds import ordered_fold
from tidelog.operators.placement import ranked
from tidelog.operators.ring import route


def live_members(heartbeats: DataFrame, now_ms: int, session_ms: int) -> DataFrame:
    last = heartbeats.groupBy("group", "topic", "member").agg(F.max("hb_ms").alias("last_ms"))
    return last.where(F.col("last_ms") >= now_ms - session_ms)


def assign(ranges: DataFrame, members: DataFrame) -> DataFrame:
    """(topic, range_seq, member): each active range to the member that ranks highest for it."""
    items = ranges.where("state = 'active'").select("topic", F.col("seq").alias("range_seq")).withColumn("item", F.concat_ws("/", "topic", F.col("range_seq").cast("string")))
    best = ranked(items, members.select(F.col("member").alias("broker")), "item").where("rank = 1")
    return best.select("topic", "range_seq", F.col("broker").alias("member"))


def best_member(item: str, members: Iterable[str]) -> str:
    return max(members, key=lambda m: (hashlib.md5(f"{item}|{m}".encode()).hexdigest(), m))


def coordinator(commands: DataFrame, ranges: Mapping[str, list[int]], session_ms: int) -> DataFrame:
    """commands (group, topic, seq, op, member, now) with what the group's coordinator answers and its generation after each.

    join and poll register a member, heartbeat only refreshes a known one, leave takes it out, tick evicts members that
    were silent for longer than session_ms. The generation moves only where the assignment of the topic's active ranges
    does, and a group without members is forgotten. ranges: the active ranges of each topic, cluster metadata. Commands
    of a group are one sequence; groups are spread over all tasks.
    """
    topics = {t: sorted(r) for t, r in ranges.items()}

    def step(state, topic: str, seq: int, op: str, member: str, now: int):
        members, held, generation = state
        known, answer = member in members, "ok"
        members = dict(members)
        if op in ("join", "poll") or (op == "heartbeat" and known):
            members[member] = now
        elif op == "heartbeat":
            answer = "unknown_member"
        elif op == "leave":
            members.pop(member, None)
        elif op == "tick":
            members = {m: at for m, at in members.items() if at >= now - session_ms}
        if not members:
            return ({}, None, 0), (seq, answer, 0, 0, 0)
        if op in ("leave", "tick") or op == "join" or (op == "poll" and not known):
            new = tuple(best_member(f"{topic}/{r}", members) for r in topics.get(topic, ()))
            generation, held = generation + (new != held), new
        return (members, held, generation), (seq, answer, generation, len(members), sum(m == member for m in held or ()))

    return ordered_fold(commands, ("group", "topic"), ("seq",), ("topic", "seq", "op", "member", "now"), lambda: ({}, None, 0), step, "group string, topic string, seq long, answer string, generation long, members long, owned long")


def assignment_of(ranges: DataFrame, members: DataFrame) -> DataFrame:
    """(member, ranges): every member, idle ones with an empty list."""
    a = assign(ranges, members).groupBy("member").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "topic", F.col("range_seq").cast("string")))), ",").alias("ranges"))
    return members.select("member").distinct().join(a, "member", "left").select("member", F.coalesce("ranges", F.lit("")).alias("ranges"))


def coordinators(topics: DataFrame, ring: DataFrame, leaders: DataFrame, local: str) -> DataFrame:
    """(topic, vnode, node): the leader of the vnode that owns a topic; unknown: the local node."""
    r = route(topics, "topic", ring)
    return r.join(leaders, "vnode", "left").select("topic", "vnode", F.coalesce("leader", F.lit(local)).alias("node"))


#: Order of statuses of equal incarnation: the later one wins.
RANK = {"alive": 0, "suspect": 1, "dead": 2}


def merge_views(views: DataFrame) -> DataFrame:
    """(member, status, incarnation): the highest (incarnation, rank) seen of each member; the order of views is all one."""
    rank = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)])[F.col("status")]
    best = views.groupBy("member").agg(F.max(F.struct("incarnation", rank.alias("rank"), "status")).alias("b"))
    return best.select("member", "b.status", "b.incarnation")


def alive(members: DataFrame) -> DataFrame:
    return members.where("status = 'alive'").select("member").orderBy("member")


def leader(members: DataFrame) -> DataFrame:
    """(member): the lowest live member, which leads; no row if none is alive."""
    return alive(members).limit(1)
