"""SimHash near-duplicates: fingerprints, a grid range-join on segment popcounts, exact Hamming verification, classes.

A fingerprint's 64 bits form 32 segments of two bits; its embedding is the vector of their bit counts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. With counts written
in unary (0, 1, 11) the embedding is one long and that distance is bit_count(x ^ y).

The grid: segments are dealt into `blocks` blocks. Within distance 4, at least blocks - 4 blocks of two embeddings
are equal, so each fingerprint enters one cell for every choice of blocks - 4 of them, and pairs meet in cells.
A pair counts only in the first cell it shares. Two steps follow: candidates are the pairs whose Manhattan distance is
within the bound, links those whose fingerprints are. Two-bit segments make that bound tight, since it loses a pair's
distance only where 01 meets 10; wider ones would let through many more of the pairs that share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import every, fresh, pieces
from tidelog.llm.components import components
from tidelog.storage import cut, ship

DISTANCE = 4
#: Distinct fingerprints up to which a grid of so many blocks is used. More blocks make more and finer cells; every grid
#: finds the same pairs. Of random fingerprints, a share of 4e-4, 5e-5, 1e-5 and 3e-6 of all pairs meet in a cell with 6, 7, 8 and 9 blocks.
GRIDS = ((1_000_000, 6), (30_000_000, 7), (500_000_000, 8), (1 << 62, 9))


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of the shingles of `size` words: a bit is set if set in over half of the XXH64 values (seed 42). No words: 0."""
    w = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    n = max(1, len(w) - size + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(size, len(w)) - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(column: str, size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in pieces(y, y.schema.names.index(column))):
            got = np.array([fingerprint(t.as_py(), size) for t in b.column(b.schema.names.index(column))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return of


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long. Null, empty and blank texts have fingerprint 0."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints("text", size), "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in unary."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def _masks(blocks: int) -> tuple[int, ...]:
    """The bits of each block: block k holds segments k, k + blocks, ..."""
    return tuple(sum(3 << 2 * s for s in range(k, 32, blocks)) for k in range(blocks))


def candidates(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(node_x, fp_x, node_y, fp_y): all pairs of the distinct longs `node` whose embeddings are within that Manhattan distance.

    Cells hold distinct fingerprints only, so copies of a text never meet each other here; the join's hash
    partitions can be split where a cell is crowded.
    """
    if blocks is None:
        n = fps.count()
        blocks = next(b for most, b in GRIDS if n <= most) + distance - DISTANCE
    masks, need = _masks(blocks), blocks - distance
    picks = list(combinations(range(blocks), need))
    e = embed(F.col("fp"))
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(_signed(reduce(int.__or__, (masks[k] for k in c)))))) for i, c in enumerate(picks)])
    grid = fps.select("node", "fp", e.alias("e")).select("node", "fp", "e", F.posexplode(cells).alias("pick", "cell"))
    x, y = (grid.select(*[F.col(c).alias(c + s) for c in ("node", "fp", "e", "pick", "cell")]) for s in ("_x", "_y"))
    apart = F.col("e_x").bitwiseXOR(F.col("e_y"))
    same = [(apart.bitwiseAND(F.lit(_signed(m))) == 0) for m in masks]
    # the pick that consists of the first `need` equal blocks
    equal_before = [F.lit(0)]
    for s in same:
        equal_before.append(equal_before[-1] + s.cast("int"))
    first = F.lit(True)
    own = F.element_at(F.array(*[F.lit(sum(1 << k for k in c)) for c in picks]), F.col("pick_x") + 1)
    code = reduce(lambda p, q: p + q, [F.when(s & (equal_before[k] < need), F.lit(1 << k)).otherwise(F.lit(0)) for k, s in enumerate(same)])
    first = code == own
    met = x.join(y, (F.col("cell_x") == F.col("cell_y")) & (F.col("pick_x") == F.col("pick_y")) & (F.col("fp_x") < F.col("fp_y"))
                 & (F.bit_count(apart) <= distance) & first)
    return met.select("node_x", "fp_x", "node_y", "fp_y")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct longs `node`, by their fp, within that Hamming distance."""
    found = cut(candidates(fps, distance, blocks), "simhash-candidates")
    exact = found.where(F.bit_count(F.col("fp_x").bitwiseXOR(F.col("fp_y"))) <= distance)
    return exact.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row of docs.

    Fingerprints within `distance` bits link; component_id is the smallest doc_id reachable. n_links counts the other
    distinct fingerprints linked directly. Null, empty and blank texts have fingerprint zero and link like any other.
    A null doc_id keeps its row and is never a representative: its component_id is null if it reaches no other
    row. Repeated rows share a component. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, size), "simhash-rows")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    named = nodes.where("node is not null")
    found = cut(links(named, distance, blocks), "simhash-links")
    roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = named.join(roots, "node", "left").join(degree, "node", "left")
    classes = cut(classes.select("fp", F.coalesce("root", "node").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "simhash-classes")
    return rows.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def stage(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id; of rows repeating it, the first by their values.

    Rows without a doc_id stay, as nothing names them. Null, empty and blank texts are one group. Other columns may have
    any name and hold nulls; an empty table gives an empty result.
    """
    ids = cut(near_duplicates(docs), "simhash-verdict")
    gone = ids.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*every(docs))
    twice = cut(ids.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-twice")
    if twice.isEmpty():
        return left
    rank, = fresh(docs, "sh_hash")
    again = left.join(twice, "doc_id", "left_semi").select(*every(docs))
    again = again.withColumn(rank, F.xxhash64(*every(docs)))
    pick = again.groupBy("doc_id").agg(F.min(rank).alias(rank))
    return left.join(twice, "doc_id", "left_anti").select(*every(docs)).unionByName(again.join(pick, ["doc_id", rank]).select(*every(docs)).dropDuplicates(["doc_id"]))
