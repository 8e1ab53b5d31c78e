"""Retention by age and size, and settings that policies override field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def effective(topics: DataFrame, policies: DataFrame, max_age_ms: int | None, max_bytes: int | None, spread_by: str | None) -> DataFrame:
    """Each topic's settings: a field that its policy sets counts, even set to null; else the global one."""
    p = policies.select(F.col("name").alias("policy"), "has_max_age", F.col("max_age_ms").alias("p_age"), "has_max_bytes", F.col("max_bytes").alias("p_bytes"), "has_spread_by", F.col("spread_by").alias("p_spread"))
    own = lambda has, value, other: F.when(F.coalesce(has, F.lit(False)), F.col(value)).otherwise(F.lit(other))
    return topics.join(p, "policy", "left").select("name", own("has_max_age", "p_age", max_age_ms).cast("long").alias("max_age_ms"), own("has_max_bytes", "p_bytes", max_bytes).cast("long").alias("max_bytes"), own("has_spread_by", "p_spread", spread_by).cast("string").alias("spread_by"))


def by_age(segments: DataFrame, settings: DataFrame, now_ms: int) -> DataFrame:
    """Sealed segments older than the limit (strictly); no limit: none."""
    s = segments.where("state = 'sealed'").join(settings.select(F.col("name").alias("topic"), "max_age_ms"), "topic")
    return s.where(F.lit(now_ms) - F.col("sealed_at") > F.col("max_age_ms")).select("topic", "range_seq", "seg_seq")


def by_size(segments: DataFrame, settings: DataFrame) -> DataFrame:
    """The oldest sealed segments of a range, as long as what remains is over the limit.

    A segment goes exactly if it and all newer ones together are over it, so one suffix sum decides for all.
    """
    newer = W.partitionBy("topic", "range_seq").orderBy("start_offset").rowsBetween(W.currentRow, W.unboundedFollowing)
    s = segments.where("state = 'sealed'").withColumn("suffix", F.sum("byte_size").over(newer)).join(settings.select(F.col("name").alias("topic"), "max_bytes"), "topic")
    return s.where("suffix > max_bytes").select("topic", "range_seq", "seg_seq")


def expired(segments: DataFrame, settings: DataFrame, now_ms: int) -> DataFrame:
    return by_age(segments, settings, now_ms).union(by_size(segments, settings)).distinct()
