"""Consuming: lineage of ranges, positions, pages, groups, members, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CURSOR = "array<struct<topic: string, range_seq: bigint, source_index: bigint, source_offset: bigint>>"


def lineage(readers: DataFrame, ranges: DataFrame) -> DataFrame:
    """(topic, seq, source, source_index, key_start, key_end, own): the ranges whose records a range reads, in order.

    Ancestors whose block does not meet the reader's are left out; their index stays, since positions hold it.
    """
    every = readers.select("topic", "seq", "key_start", "key_end", F.posexplode(F.concat("parents", F.array("seq"))).alias("source_index", "source"))
    block = ranges.select("topic", F.col("seq").alias("source"), F.col("key_start").alias("s0"), F.col("key_end").alias("e0"))
    met = every.join(block, ["topic", "source"]).where("s0 < key_end and key_start < e0")
    return met.select("topic", "seq", F.col("source").cast("long").alias("source"), F.col("source_index").cast("long").alias("source_index"), "key_start", "key_end", (F.col("seq") == F.col("source")).alias("own"))


def history(log: DataFrame, readers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every record that each of `readers` reads, of all `ranges`: its ancestors' in its key slice, then its own."""
    sources = lineage(readers, ranges)
    on = (F.col("l.topic") == F.col("s.topic")) & (F.col("l.range_seq") == F.col("s.source"))
    met = log.alias("l").join((F.broadcast(sources) if _few(sources) else sources).alias("s"), on)
    return met.where("s.own or (l.pos >= s.key_start and l.pos < s.key_end)").select("l.*", F.col("s.seq").alias("reader"), "s.source_index")


def _few(ranges: DataFrame, most: int = 100_000) -> bool:
    return ranges.limit(most + 1).count() <= most


def after(records: DataFrame, positions: DataFrame) -> DataFrame:
    """records (topic, reader, source_index, offset) at or beyond each range's position; without one, from the start."""
    p = positions.select(F.col("topic").alias("p_topic"), F.col("range_seq").alias("p_seq"), F.struct("source_index", "source_offset").alias("p"))
    met = records.join(p, (F.col("topic") == F.col("p_topic")) & (F.col("reader") == F.col("p_seq")), "left")
    return met.where(F.col("p").isNull() | (F.struct("source_index", F.col("offset").alias("source_offset")) >= F.col("p"))).drop("p_topic", "p_seq", "p")


def page(records: DataFrame, most: int, by: tuple[str, ...] = ("topic", "reader")) -> DataFrame:
    """At most `most` records of each range (not of each topic), in reading order. Spark keeps `most` a task before the shuffle."""
    n = F.row_number().over(W.partitionBy(*by).orderBy("source_index", "offset"))
    return records.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def clamp(records: DataFrame, earliest: DataFrame) -> DataFrame:
    """Drop records below the earliest offset that retention has left of their own range."""
    e = earliest.select(F.col("topic").alias("e_topic"), F.col("range_seq").alias("e_seq"), "earliest")
    met = records.join(e, (F.col("topic") == F.col("e_topic")) & (F.col("range_seq") == F.col("e_seq")), "left")
    return met.where(F.col("offset") >= F.coalesce("earliest", F.lit(0))).drop("e_topic", "e_seq", "earliest")


def next_positions(pages: DataFrame) -> DataFrame:
    """(topic, range_seq, source_index, source_offset): where the next page of each range begins."""
    got = pages.groupBy("topic", F.col("reader").alias("range_seq")).agg(F.max(F.struct("source_index", (F.col("offset") + 1).alias("source_offset"))).alias("p"))
    return got.select("topic", "range_seq", "p.source_index", "p.source_offset")


def committed(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """The last commit of each (group, topic, range), of active ranges only; topics that are not known keep theirs."""
    last = commits.groupBy("group", "topic", "range_seq").agg(F.max_by(F.struct("source_index", "source_offset"), "commit_seq").alias("p"))
    state = ranges.select("topic", F.col("seq").alias("range_seq"), "state")
    known = ranges.select("topic").distinct().withColumn("known", F.lit(True))
    kept = last.join(state, ["topic", "range_seq"], "left").join(known, "topic", "left").where("known is null or state = 'active'")
    return kept.select("group", "topic", "range_seq", "p.source_index", "p.source_offset")


def fetch_group(log: DataFrame, ranges: DataFrame, commits: DataFrame, group: str, most: int) -> DataFrame:
    """The next page of each active range for a group, from its committed positions, else from the start."""
    active = ranges.where("state = 'active'")
    positions = committed(commits, ranges).where(F.col("group") == group)
    return page(after(history(log, active, ranges), positions), most)


def fetch_member(log: DataFrame, ranges: DataFrame, commits: DataFrame, assignment: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """fetch_group over the active ranges that are assigned to a member."""
    mine = assignment.where(F.col("member") == member).select("topic", F.col("range_seq").alias("seq"))
    active = ranges.where("state = 'active'").join(mine, ["topic", "seq"], "left_semi")
    return page(after(history(log, active, ranges), committed(commits, ranges).where(F.col("group") == group)), most)


def fetch(log: DataFrame, ranges: DataFrame, commits: DataFrame, assignment: DataFrame | None = None, *, topic: str | None = None, cursor: DataFrame | None = None, group: str | None = None, member: str | None = None, most: int | None = None) -> DataFrame:
    """One client request: a member of a group reads its ranges; else a cursor (topic, range_seq, source_index, source_offset) goes before a group's positions; with neither, from the start.

    topic: only its records. most is held within the client's bounds.
    """
    most, _, _ = bounds(most, None, None)
    if topic is not None:
        log, ranges, commits = (df.where(F.col("topic") == topic) for df in (log, ranges, commits))
    active = ranges.where("state = 'active'")
    if member is not None and group is not None and assignment is not None:
        return fetch_member(log, ranges, commits, assignment, group, member, most)
    if cursor is not None:
        return page(after(history(log, active, ranges), cursor), most)
    if group is not None:
        return fetch_group(log, ranges, commits, group, most)
    return page(history(log, active, ranges), most)


def client_view(records: DataFrame) -> DataFrame:
    """What clients see: no offsets; headers where records have them."""
    return records.select("topic", "key", "value", "timestamp", *[c for c in ("headers",) if c in records.columns])


def encode_cursor(positions: Column) -> Column:
    return F.translate(F.base64(F.to_json(F.sort_array(positions)).cast("binary")), "+/\r\n", "-_")


def decode_cursor(token: Column) -> Column:
    """Positions of a cursor, or null if it is malformed; one of another shape or with a negative number is malformed too."""
    # a length or alphabet that base64 rules out is caught before decoding
    clean = F.when(token.rlike(r"\A[A-Za-z0-9_-]+={0,2}\z") & (F.length(token) % 4 == 0), F.translate(token, "-_", "+/"))
    raw = F.try_to_binary(clean, F.lit("base64"))
    parsed = F.from_json(raw.cast("string"), CURSOR, {"mode": "PERMISSIVE"})
    good = F.forall(parsed, lambda p: p["topic"].isNotNull() & (p["range_seq"] >= 0) & (p["source_index"] >= 0) & (p["source_offset"] >= 0))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(parsed) > 0), parsed)


def bounds(most: int | None, wait_ms: int | None, window: int | None) -> tuple[int, int, int]:
    """Client limits: records a page (1 to 1000, 100), wait (at most 30 s), window (1 to 10000, 100)."""
    return min(max(most if most is not None else 100, 1), 1000), min(max(wait_ms or 0, 0), 30_000), min(max(window if window is not None else 100, 1), 10_000)
