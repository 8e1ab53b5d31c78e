"""Set-based queries over metadata tables: topics, ranges, segments, committed offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.keyspace import buddies, split_point, splittable
from tidelog.operators.folds import ordered_fold


def active_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.where("state = 'active'")


def tiling(ranges: DataFrame, keyspace: int) -> DataFrame:
    """(topic, tiled): active ranges leave no gap and no overlap."""
    w = W.partitionBy("topic").orderBy("key_start")
    steps = active_ranges(ranges).select("topic", "key_start", "key_end", F.lead("key_start").over(w).alias("next"), F.row_number().over(w).alias("n"))
    ok = F.when(F.col("n") == 1, F.col("key_start") == 0).otherwise(True) & (F.coalesce("next", F.lit(keyspace)) == F.col("key_end"))
    return steps.groupBy("topic").agg(F.bool_and(ok).alias("tiled"))


def split_candidates(ranges: DataFrame) -> DataFrame:
    r = active_ranges(ranges).where(splittable(F.col("key_start"), F.col("key_end")))
    return r.select("topic", "seq", "key_start", split_point(F.col("key_start"), F.col("key_end")).alias("split_at"), "key_end")


def buddy_pairs(ranges: DataFrame) -> DataFrame:
    """Active pairs that may merge. The size and the parent block make it an equi-join."""
    r = active_ranges(ranges).select("topic", "seq", "key_start", "key_end", (F.col("key_end") - F.col("key_start")).alias("size")).withColumn("parent", F.expr("key_start div (2 * size)"))
    a, b = r.alias("a"), r.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("topic", "size", "parent")]
    met = a.join(b, on).where((F.col("a.key_start") < F.col("b.key_start")) & buddies(F.col("a.key_start"), F.col("a.key_end"), F.col("b.key_start"), F.col("b.key_end")))
    return met.select("a.topic", F.col("a.seq").alias("low_seq"), F.col("b.seq").alias("high_seq"), "a.key_start", F.col("b.key_end").alias("key_end"))


def integrity(topics: DataFrame, ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """(kind, orphans): ranges without a topic and segments without a range."""
    r = ranges.join(topics.select(F.col("name").alias("topic")), "topic", "left_anti").select(F.lit("range").alias("kind"))
    s = segments.join(ranges.select("topic", F.col("seq").alias("range_seq")), ["topic", "range_seq"], "left_anti").select(F.lit("segment").alias("kind"))
    kinds = topics.sparkSession.createDataFrame([("range",), ("segment",)], "kind string")
    return kinds.join(r.unionByName(s).groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("orphans"))


def overview(topics: DataFrame, ranges: DataFrame, segments: DataFrame, committed: DataFrame) -> DataFrame:
    """One row a topic. Ranges, segments and groups are summed apart, then joined, so nothing is counted twice."""
    r = ranges.groupBy("topic").agg(F.count("*").alias("range_count"), F.count_if(F.col("state") == "active").alias("active_range_count"))
    s = segments.groupBy("topic").agg(F.count("*").alias("segment_count"), F.count_if(F.col("state") == "active").alias("active_segment_count"), F.sum(F.coalesce("byte_size", F.lit(0))).alias("total_bytes"))
    g = committed.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_set("group")), ",").alias("groups"))
    out = topics.select(F.col("name").alias("topic"))
    for t in (r, s, g):
        out = out.join(t, "topic", "left")
    return out.na.fill(0).na.fill("", ["groups"])


def detail(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """Nested drill-down: a row a topic, its ranges by seq, each with its segments by start_offset."""
    s = segments.groupBy("topic", F.col("range_seq").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("start_offset", "seg_seq", "state", "length", "byte_size"))).alias("segments"))
    full = ranges.join(s, ["topic", "seq"], "left")
    return full.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("seq", "key_start", "key_end", "state", "segments"))).alias("ranges"))


def flat_detail(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """detail() as rows, a range's segments beside it: a join, with nothing gathered; a range without segments is a row too."""
    s = segments.select("topic", F.col("range_seq").alias("seq"), "seg_seq", F.col("state").alias("segment_state"), "start_offset", "length", "byte_size")
    r = ranges.select("topic", "seq", "key_start", "key_end", F.col("state").alias("range_state"))
    return r.join(s, ["topic", "seq"], "left").select("topic", "seq", "key_start", "key_end", "range_state", "seg_seq", "segment_state", "start_offset", "length", "byte_size")


def earliest(segments: DataFrame) -> DataFrame:
    return segments.groupBy("topic", "range_seq").agg(F.coalesce(F.min("start_offset"), F.lit(0)).alias("earliest"))


def as_of(wanted: DataFrame, at: str, starts: DataFrame, start: str, block: int = 1 << 12) -> DataFrame:
    """wanted (topic, range_seq, at) with the last row of starts (topic, range_seq, start, ...) whose start is at or before `at`.

    A row of starts holds up to the next one, the last of a range up to what is wanted. These spans are cut at multiples
    of `block` and met by (range, block), so a range of any length is spread over its blocks, and a row meets only the
    starts of its own block. Rows before the first start are left out.
    """
    key = ["topic", "range_seq"]
    reach = wanted.groupBy(*key).agg((F.max(at) + 1).alias("_reach"))
    spans = starts.withColumn("_end", F.lead(start).over(W.partitionBy(*key).orderBy(start))).join(reach, key)
    spans = spans.withColumn("_end", F.least(F.coalesce("_end", "_reach"), "_reach")).where(F.col("_end") > F.col(start))
    spans = spans.withColumn("_block", F.explode(F.expr(f"sequence({start} div {block}, (_end - 1) div {block})")))
    met = wanted.withColumn("_block", F.expr(f"{at} div {block}")).join(spans.drop("_reach"), [*key, "_block"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col("_end"))).drop("_block", "_end")


def locate(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (topic, range_seq, offset) with the last segment that starts at or before each offset: a backward as-of join."""
    starts = segments.select("topic", "range_seq", "seg_seq", "start_offset")
    return as_of(wanted.select("topic", "range_seq", "offset"), "offset", starts, "start_offset").select("topic", "range_seq", "offset", "seg_seq", "start_offset")


def segment_read(log: DataFrame, topic: str, range_seq: int, offset: int, most: int) -> DataFrame:
    part = log.where((F.col("topic") == topic) & (F.col("range_seq") == range_seq) & (F.col("offset") >= offset))
    return part.orderBy("offset").limit(most)


def read_status(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (topic, range_seq, offset): ok, eof (the next offset to come) or out_of_range."""
    ends = log.groupBy("topic", "range_seq").agg(F.min("offset").alias("lo"), (F.max("offset") + 1).alias("hi"))
    status = F.when((F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")), "ok").when(F.col("offset") == F.coalesce("hi", F.lit(0)), "eof").otherwise("out_of_range")
    return wanted.join(ends, ["topic", "range_seq"], "left").select("topic", "range_seq", "offset", status.alias("status"))


def sparse_index(log: DataFrame, interval: int = 4096) -> DataFrame:
    """(topic, range_seq, seg_seq, offset, position): the first record of a segment, then the first one `interval` bytes or more after the last entry."""

    def step(state: tuple[int, int | None], offset: int, size: int):
        at, last = state
        if last is None or at - last >= interval:
            return (at + size, at), (offset, at)
        return (at + size, last), None

    return ordered_fold(log, ("topic", "range_seq", "seg_seq"), ("offset",), ("offset", "frame_bytes"), lambda: (0, None), step, "topic string, range_seq long, seg_seq long, offset long, position long")


def sparse_seek(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The greatest indexed offset at or before each wanted (topic, range_seq, target), and its position."""
    starts = index.select("topic", "range_seq", "offset", "position")
    return as_of(wanted.select("topic", "range_seq", "target"), "target", starts, "offset").select("topic", "range_seq", "target", "offset", "position")


def export_topic(name: str, topics: DataFrame, ranges: DataFrame, segments: DataFrame, committed: DataFrame) -> DataFrame:
    """A topic's bundle as rows (kind, ident): what a migration moves."""
    of = lambda df, kind, c, *ident: df.where(F.col(c) == name).select(F.lit(kind).alias("kind"), F.concat_ws("/", *[F.col(x).cast("string") for x in ident]).alias("ident"))
    return of(topics, "topic", "name", "name").unionByName(of(ranges, "range", "topic", "topic", "seq")).unionByName(of(segments, "segment", "topic", "topic", "range_seq", "seg_seq")).unionByName(of(committed, "offset", "topic", "group", "range_seq", "source_index", "source_offset"))


def create_topics(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What create_topic would answer for (name, bits): the error, else ok and the root range's end."""
    from tidelog.functions.keyspace import keyspace_ok
    from tidelog.operators.produce import valid_topic

    known = existing.select("name", F.lit(True).alias("known"))
    answer = F.when(~valid_topic(F.col("name")), "invalid_topic_name").when(F.col("known"), "already_exists").when(~keyspace_ok(F.col("bits")), "invalid_keyspace_bits").otherwise("ok")
    met = wanted.join(known, "name", "left").select("name", "bits", answer.alias("answer"))
    return met.withColumn("key_end", F.when(F.col("answer") == "ok", F.expr("shiftleft(1L, cast(bits as int))")))


def merged(*shards: DataFrame) -> DataFrame:
    """Disjoint union of one metadata table over vnodes."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out
