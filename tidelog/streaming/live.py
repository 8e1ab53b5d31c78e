"""Live paths on Structured Streaming: produce, bounded delivery with commits after processing, stateful limits and groups."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidelog.operators.folds import ordered_fold
from tidelog.operators.ops import bucket_step
from tidelog.operators.produce import assign_offsets, owners


class Unroutable(RuntimeError):
    """A batch holds a record that no active range owns."""


def produce_stream(records: DataFrame, active: DataFrame, log_path: str, checkpoint: str, arrival: str) -> StreamingQuery:
    """Append a stream of records (topic, key, value, pos, arrival) to a log table, one writer a table.

    A micro-batch with a record that no range owns fails before anything of it is appended (Unroutable); started again
    with ranges that own it, the stream goes on from there. A batch goes to a folder of its own, and the next offsets
    after it to another beside the log; a batch that is repeated after a failure writes the same rows over its own. No
    batch reads the log: it starts from the offsets that the one before it left.
    """
    key = ["topic", "range_seq"]
    ends = "topic string, range_seq long, next_offset long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        met = owners(batch, active, how="left")
        lost = met.where("range_seq is null")
        if not lost.isEmpty():
            raise Unroutable(f"batch {batch_id}: no range for position {lost.first()['pos']}")
        base = spark.read.schema(ends).parquet(f"{log_path}.next/{batch_id - 1}") if batch_id else spark.createDataFrame([], ends)
        path = f"{log_path}/batch={batch_id}"
        assign_offsets(met, arrival, base).write.mode("overwrite").partitionBy("topic").parquet(path)
        mine = spark.read.parquet(path).groupBy(*key).agg((F.max("offset") + 1).alias("next_offset")) if not batch.isEmpty() else base.limit(0)
        mine.unionByName(base).groupBy(*key).agg(F.max("next_offset").alias("next_offset")).write.mode("overwrite").parquet(f"{log_path}.next/{batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(spark: SparkSession, log_path: str, schema, checkpoint: str, process: Callable[[DataFrame, int], None], files: int = 100) -> StreamingQuery:
    """Push new log records to `process`, those of at most `files` files a batch. Positions are committed by the checkpoint after processing: at least once.

    Stopping the query is the way to unsubscribe; started again with its checkpoint, it goes on behind what was processed.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log_path)
    return source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def long_poll(fetch: Callable[[], DataFrame], wait_ms: int, pause_ms: int = 100) -> list:
    """The rows of fetch() as soon as it has any, else none once wait_ms (at most 30 s) have gone by. fetch() is a page, so it is bounded."""
    until = time.monotonic() + min(max(wait_ms, 0), 30_000) / 1000
    while not (rows := fetch().collect()):
        left = until - time.monotonic()
        if left <= 0:
            break
        time.sleep(min(pause_ms / 1000, left))
    return rows


def credit_window(events: list[tuple[str, int]], window: int, most: int, ranges: int = 1) -> list[int]:
    """Records delivered after each of ('produce', n) and ('ack', n): a push never exceeds the credit that is left, over all ranges together."""
    waiting = in_flight = 0
    out = []
    for kind, n in events:
        if kind == "produce":
            waiting += n
        else:
            in_flight = max(0, in_flight - n)
        sent = 0
        while (budget := min(most * ranges, window - in_flight, waiting)) > 0:
            waiting, in_flight, sent = waiting - budget, in_flight + budget, sent + budget
        out.append(sent)
    return out


def credit_fold(events: DataFrame, window: int) -> DataFrame:
    """events (topic, seq, kind produce or ack, n) with the records pushed after each, and those in flight and waiting then.

    A push takes what waits, up to the credit of `window` records that are not acknowledged. Topics are spread over tasks.
    """

    def step(state: tuple[int, int], seq: int, kind: str, n: int):
        waiting, in_flight = state
        if kind == "produce":
            waiting += n
        else:
            in_flight = max(0, in_flight - n)
        sent = max(0, min(window - in_flight, waiting))
        state = waiting - sent, in_flight + sent
        return state, (seq, sent, state[1], state[0])

    return ordered_fold(events, ("topic",), ("seq",), ("seq", "kind", "n"), lambda: (0, 0), step, "topic string, seq long, delivered long, in_flight long, waiting long")


def limited_stream(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The token bucket on a stream of (identifier, action, seq, ts): state a bucket, dropped after an hour without requests."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    one = bucket_step(limit, window_ms)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        for pdf in parts:
            rows = []
            for seq, now in pdf.sort_values("seq")[["seq", "ts"]].itertuples(index=False):
                held, answer = one(held, int(now))
                rows.append((*key, int(seq), *answer))
            yield pd.DataFrame(rows, columns=["identifier", "action", "seq", "allowed", "retry_after_ms"])
        if held is None:
            return
        state.update(held)
        state.setTimeoutDuration(3_600_000)

    return requests.groupBy("identifier", "action").applyInPandasWithState(
        step, "identifier string, action string, seq long, allowed boolean, retry_after_ms long", "tokens long, last long, start long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def member_stream(heartbeats: DataFrame, session: str) -> DataFrame:
    """(group, topic, member, session_window, beats) of a stream of heartbeats with an event-time column `at`: a member leaves when its session ends."""
    return heartbeats.withWatermark("at", session).groupBy("group", "topic", "member", F.session_window("at", session)).agg(F.count("*").alias("beats"))


def per_second(events: DataFrame, keep: str = "300 seconds") -> DataFrame:
    """Counts a second and topic of a stream with an event-time column `at`; events later than `keep` are dropped."""
    return events.withWatermark("at", keep).groupBy(F.window("at", "1 second"), "topic").agg(F.count("*").alias("events"))
