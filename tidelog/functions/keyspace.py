"""Key hashing and key-block arithmetic as column expressions.

A key's position is the first 32 bits of its MD5 modulo the keyspace, so any engine with MD5 agrees on it. A keyless
record hashes a sentinel that no text key equals, so all keyless records of a topic share one range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_KEY = b"\xff\xfe\xff"
RING = 1 << 32


def hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")


def position(key: Column, keyspace: int | Column) -> Column:
    size = F.lit(keyspace) if isinstance(keyspace, int) else keyspace
    return F.pmod(hash32(F.coalesce(key.cast("binary"), F.lit(NO_KEY))), size.cast("long"))


def keyspace_ok(bits: Column) -> Column:
    return F.coalesce(bits.between(1, 32), F.lit(False))


def within(pos: Column, start: Column, end: Column) -> Column:
    return (pos >= start) & (pos < end)


def splittable(start: Column, end: Column) -> Column:
    return (end - start) >= 2


def split_point(start: Column, end: Column) -> Column:
    return start + F.floor((end - start) / 2).cast("long")


def buddies(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Equal blocks whose starts differ in exactly the bit of their size."""
    size = end_a - start_a
    return (size == (end_b - start_b)) & (start_a.bitwiseXOR(size) == start_b)


def even_tokens(spark, vnodes: int, ring: int = RING):
    """(vnode, token) of evenly spread tokens."""
    return spark.range(vnodes).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("vnode"), F.expr(f"id * {ring}L div {vnodes}").alias("token"))
