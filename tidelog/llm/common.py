"""Shared pieces: the word definition, let-bindings for column expressions, column names that clash with nothing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+, the blank first.
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever the optimizer does with projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null text: none."""
    blank = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(blank, " "), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each lengthened until no column of df bears it (column names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that name, whatever dots or quotes are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give memory that a worker has freed back to the system, so that it does not lie beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in that column have about `most` bytes together, or one row: bounded work in Python."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


#: Rows of a table of groups that may be broadcast: at some 300 bytes a row, 15 MB.
FEW_GROUPS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", most: int = FEW_GROUPS, salts: int = 64, known: int | None = None) -> DataFrame:
    """rows joined to a written table with one row for each `key`, whatever share of the rows a key holds.

    The groups are counted: up to `most` they are broadcast; beyond, each is repeated under `salts` salts and rows meet
    them under one of these, so that a hot key is spread over as many partitions. known: their number, if it was counted.
    """
    if (groups.limit(most + 1).count() if known is None else known) <= most:
        return rows.join(F.broadcast(groups), key, how)
    salt, = fresh(rows, "jg_salt")
    salted = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(salt, (F.xxhash64(*every(rows)) % salts + salts).cast("int") % salts)
    return dealt.join(salted, [key, salt], how).drop(salt)
