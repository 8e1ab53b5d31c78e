"""Producing: route records to key ranges, give offsets, roll segments, account for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.frames import frame_bytes
from tidelog.functions.keyspace import position, within
from tidelog.operators.folds import ordered_fold

#: Ranges that are broadcast to records; more are joined by topic and block.
FEW_RANGES = 100_000


def valid_topic(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z") & ~name.isin(".", ".."), F.lit(False))


def build_records(batches: DataFrame) -> DataFrame:
    """Raw (batch, seq, key, value, headers map<string, string> if there are any): a batch with a null value is rejected whole; else its records with frame sizes.

    A null key is no key. Headers become pairs in order of name; those without a value are left out, null headers are none.
    """
    bad = batches.where("value is null").select("batch").distinct()
    ok = batches.join(bad, "batch", "left_anti")
    if "headers" not in batches.columns:
        return ok.withColumn("frame_bytes", frame_bytes(F.col("key"), F.col("value")))
    pairs = F.sort_array(F.filter(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string, string>"))), lambda h: h["value"].isNotNull()))
    return ok.withColumn("headers", pairs).withColumn("frame_bytes", frame_bytes(F.col("key"), F.col("value"), F.col("headers")))


def owners(records: DataFrame, active: DataFrame, on: tuple[str, ...] = ("topic",), how: str = "inner") -> DataFrame:
    """records (on..., pos) with range_seq, the active range that owns each position; how "left" keeps records that none owns, with null.

    Active ranges are aligned blocks of power-of-two sizes, so this range join is an equi-join on (block size, block
    number), a candidate for each size that occurs (at most 33). The ranges are counted before they are broadcast.
    """
    blocks = active.select(*on, F.col("seq").alias("range_seq"), (F.col("key_end") - F.col("key_start")).alias("block"), F.expr("key_start div (key_end - key_start)").alias("number"))
    sizes = sorted(r[0] for r in blocks.select("block").distinct().collect())
    if blocks.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        blocks = F.broadcast(blocks)
    if not sizes:
        sizes = [1]
    if how == "left":  # a join for each size keeps every record once, with its range or null
        out = records.withColumn("range_seq", F.lit(None).cast("long"))
        for s in sizes:
            mine = blocks.where(F.col("block") == s).select(*on, F.col("number").alias("_number"), F.col("range_seq").alias("_seq"))
            out = out.withColumn("_number", F.expr(f"pos div {s}L")).join(mine, [*on, "_number"], "left")
            out = out.withColumn("range_seq", F.coalesce("range_seq", "_seq")).drop("_number", "_seq")
        return out
    options = F.array(*[F.struct(F.lit(s).cast("long").alias("block"), F.expr(f"pos div {s}L").alias("number")) for s in sizes])
    tried = records.withColumn("o", F.explode(options)).select(*records.columns, "o.block", "o.number") if len(sizes) > 1 else records.withColumn("block", F.lit(sizes[0]).cast("long")).withColumn("number", F.expr(f"pos div {sizes[0]}L"))
    return tried.join(blocks, [*on, "block", "number"]).drop("block", "number")


def route(records: DataFrame, active: DataFrame, on: tuple[str, ...] = ("topic",)) -> DataFrame:
    """records with range_seq, the range that owns them; records that none owns are left out (see unroutable)."""
    return owners(records, active, on)


def unroutable(records: DataFrame, active: DataFrame, id_column: str, on: tuple[str, ...] = ("topic",)) -> DataFrame:
    return records.join(route(records, active, on).select(id_column), id_column, "left_anti")


def produced(records: DataFrame, active: DataFrame, batch: str = "batch", on: tuple[str, ...] = ("topic",)) -> DataFrame:
    """records with range_seq and accepted: a batch with a record that no active range owns is refused whole."""
    met = owners(records, active, on, "left")
    bad = met.where("range_seq is null").select(*on[:1], batch).distinct().withColumn("_bad", F.lit(True))
    return met.join(bad, [*on[:1], batch], "left").withColumn("accepted", F.col("_bad").isNull()).drop("_bad")


def assign_offsets(records: DataFrame, arrival: str, base: DataFrame | None = None, bucket: int = 1 << 20) -> DataFrame:
    """records with `offset`, contiguous from the range's next offset in order of arrival.

    Numbering goes in two steps, so that no task sees all of a range: rows are numbered inside buckets of `bucket`
    arrivals, and buckets start where the counts of those before them end. base: (topic, range_seq, next_offset).
    """
    key = ["topic", "range_seq"]
    rows = records.withColumn("_b", F.expr(f"`{arrival}` div {bucket}"))
    counts = rows.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if base is not None:
        starts = starts.join(base, key, "left").withColumn("_s", F.col("_s") + F.coalesce("next_offset", F.lit(0))).drop("next_offset")
    inside = F.row_number().over(W.partitionBy(*key, "_b").orderBy(arrival)) - 1
    return rows.withColumn("_i", inside).join(starts, [*key, "_b"]).withColumn("offset", (F.col("_s") + F.col("_i")).cast("long")).drop("_b", "_i", "_s")


def placements(log: DataFrame) -> DataFrame:
    """(batch, topic, range_seq, first, last) of each produce call."""
    return log.groupBy("batch", "topic", "range_seq").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def stats(log: DataFrame) -> DataFrame:
    return log.groupBy("topic").agg(F.count("*").alias("records"), F.sum(F.octet_length("value").cast("long")).alias("value_bytes"), F.sum("frame_bytes").alias("frame_bytes"), F.countDistinct("batch").alias("batches"))


def should_seal(bytes_: Column, age_ms: Column, state: Column, max_bytes: int, max_age_ms: int) -> Column:
    return (state == "active") & ((bytes_ >= max_bytes) | (age_ms >= max_age_ms))


def segment_roll(log: DataFrame, max_bytes: int, max_age_ms: int | None = None) -> DataFrame:
    """(topic, range_seq, batch, bytes, seg_seq): after a batch that fills a segment, or that comes when the segment's first is max_age_ms old, the next one begins.

    A running sum with resets is sequential, but over batches, not records: bytes are summed before the fold.
    """

    def step(state: tuple[int, int, int | None], batch: int, size: int, at: int):
        seg, held, since = state
        held, since = held + size, at if since is None else since
        full = held >= max_bytes or (max_age_ms is not None and at - since >= max_age_ms)
        return (seg + 1, 0, None) if full else (seg, held, since), (batch, size, seg)

    at = F.max("timestamp") if max_age_ms is not None else F.lit(0)
    sums = log.groupBy("topic", "range_seq", "batch").agg(F.sum("frame_bytes").alias("bytes"), at.alias("at"))
    return ordered_fold(sums, ("topic", "range_seq"), ("batch",), ("batch", "bytes", "at"), lambda: (0, 0, None), step, "topic string, range_seq long, batch long, bytes long, seg_seq long")


def with_position(records: DataFrame, keyspace: int, key: str = "key") -> DataFrame:
    return records.withColumn("pos", position(F.col(key), keyspace))


def store(log: DataFrame, path: str) -> DataFrame:
    """The log written under `path`, a folder a topic and range, sorted by offset, and read back: readers of a topic, a range or a slice of offsets or keys scan no more than that."""
    log.sortWithinPartitions("topic", "range_seq", "offset").write.partitionBy("topic", "range_seq").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path).select(*log.columns)


def slice_of(log: DataFrame, start: int, end: int) -> DataFrame:
    """Records whose key falls into [start, end): of a stored log, a filter that reaches the scan."""
    return log.where(within(F.col("pos"), F.lit(start), F.lit(end)))
