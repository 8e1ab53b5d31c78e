"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words (weights, with a cap on repetition); all its documents then share one
expected number of copies. The whole part is taken of each document; the fractional part is an inclusion
probability, and the cube method turns the probabilities of a source into zeros and ones while the totals of
documents and of words stay as they are.

The flight runs in buckets of at most about a thousand documents of one source: three fractional units at a time
move along the null space of the two constraints until one of them lands. Each bucket leaves at most two units in
flight and a few of all sizes that wait; those meet in the next level's buckets, until one bucket of a source is left.
There the landing weighs all assignments of its last 16 units or fewer by their probability under independent draws
and by how near they are to the totals, and draws one. A hot source is many buckets. The flight keeps each unit's
inclusion probability; the landing keeps it roughly, as far as assignments near the totals allow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import every, fresh, join_groups, words
from tidelog.storage import cut

BUCKET = 1024
#: Units of a bucket that wait for the landing.
LANDING = 14
#: Standard deviation of a source's words that the landing allows, as a share of its target.
NEAR = 0.002
EPS = 1e-9


def flight(p: Sequence[float], size: Sequence[float], draws: Sequence[float]) -> list[float]:
    """Move probabilities p along the null space of (1, size) until at most two are strictly between 0 and 1.

    Sums of p and of p * size stay; each p keeps its expectation over uniform draws.
    """
    p = list(p)
    live = []
    for k, v in enumerate(p):
        if not EPS < v < 1 - EPS:
            p[k] = float(round(v))
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if v == (0, 0, 0):
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, v) if d)
            down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, v) if d)
            step = up if draws[k] * (up + down) < down else -down
            for i, d in zip(live, v):
                p[i] += step * d
            left = [i for i in live if EPS < p[i] < 1 - EPS]
            for i in live:
                if i not in left:
                    p[i] = float(round(p[i]))
            live = left
            if len(left) == 3:  # rounding kept all in flight: settle the nearest
                i = min(left, key=lambda i: min(p[i], 1 - p[i]))
                p[i] = float(round(p[i]))
                live = [j for j in left if j != i]
    return p


def reserve(size: Sequence[float]) -> list[int]:
    """Units kept for the landing: by falling size the ranks 0, 1, 2, 3, 5, 8, 13, ..., so that they span all scales."""
    order = sorted(range(len(size)), key=lambda k: (-size[k], k))
    a, b, out = 1, 2, [0] if order else []
    while a < len(order) and len(out) < LANDING:
        out.append(a)
        a, b = b, a + b
    return [order[r] for r in out]


def landing(p: list[float], size: Sequence[float], draw: float = 0.5, near: float = 0.0) -> list[float]:
    """Settle the last fractional units (some LANDING + 2) by a uniform draw in [0, 1).

    An assignment's weight is the product of its units' probabilities times a normal density of how far its words are
    off, with standard deviation `near`, or as far off as the nearest assignment if none is that near; counts of
    documents weigh a little. With near 0 the nearest assignment is taken.
    """
    live = [k for k, v in enumerate(p) if EPS < v < 1 - EPS]
    if not live:
        return p
    want_size, want_n = sum(p[k] * size[k] for k in live), sum(p[k] for k in live)
    words_of, n_of, chance = np.zeros(1), np.zeros(1), np.zeros(1)
    for k in live:
        words_of, n_of = np.concatenate([words_of, words_of + size[k]]), np.concatenate([n_of, n_of + 1])
        chance = np.concatenate([chance + np.log1p(-p[k]), chance + np.log(p[k])])
    off, count_off = np.abs(words_of - want_size), np.abs(n_of - want_n)
    if near > 0:
        weight = chance - 0.5 * (np.maximum(off - off.min(), 0) / near) ** 2 - 0.5 * (count_off / max(1.0, len(live) ** 0.5)) ** 2
        total = np.cumsum(np.exp(weight - weight.max()))
        best = int(np.searchsorted(total, draw * total[-1], side="right"))
    else:
        scale = max(1.0, sum(size[k] for k in live) / len(live))
        best = int(np.argmin(off / scale + 0.05 * count_off))
    best = min(best, len(off) - 1)
    for j, k in enumerate(live):
        p[k] = float(best >> j & 1)
    return p


def _level(level: int, seed: int, last: bool):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        order = [xxhash.xxh64_intdigest(f"{seed}|{level}|{u}|{v}|{n}") for u, v, n in zip(pdf["u1"], pdf["u2"], pdf["num"])]
        pdf = pdf.assign(o=order).sort_values(["o", "size", "p"], kind="stable")
        draws = [xxhash.xxh64_intdigest(f"{o}|draw") / 2**64 for o in pdf["o"]]
        size = pdf["size"].tolist()
        p = pdf["p"].tolist()
        held = set(reserve(size))
        fly = [k for k in range(len(p)) if k not in held]
        for k, v in zip(fly, flight([p[k] for k in fly], [size[k] for k in fly], [draws[k] for k in fly])):
            p[k] = v
        if last:
            p = landing(p, size, xxhash.xxh64_intdigest(f"{seed}|landing|{pdf['key'].iloc[0]}") / 2**64, NEAR * float(pdf["target"].iloc[0]))
        return pdf.assign(p=p).drop(columns="o")

    return of


def targets(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size): one row a source, null last.

    Sources take the weights in turn, by code point. A target is at most `most` times its source's size: the excess is
    shared again by weight, which the caps in order of cap / weight solve at once. This is the one step that sees all
    sources together, one row each; rows of documents are summed before.
    """
    s = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # one row a source: the weights go round over their global order
    s = s.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    before = W.orderBy("r", "k").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("r", "k").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("r", "k")
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # the sources before the first whose own ratio exceeds its level are capped; from there on the level holds
    s = s.withColumn("lambda", F.min(F.when(F.col("r") >= F.col("level"), F.struct("r", "k", "level"))).over(everything)["level"])
    return s.select("source", "n", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("lambda"), F.col("cap")))).alias("target"))


def identity(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's values: together they tell rows apart, whatever ids they repeat."""
    return [F.xxhash64(F.lit(k), *every(docs)) for k in (1, 2)]


def copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 5, size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, u1, u2) of every row of docs; u1 and u2 are its identity().

    size: words of the text unless given. Null and empty texts have size 0 and count among a source's documents. A null
    source is a source of its own. Rows are told apart by all their values, so rows that share a doc_id, or have none,
    are dealt to buckets like any others; rows equal in all values are counted, then numbered, and are units of their
    own. The same rows give the same copies, in any order and partitioning. copies is at most `most`, rounded up. An
    empty table gives an empty result.
    """
    size = F.size(words(F.col("text"))) if size is None else size
    u1, u2 = identity(docs)
    rows = cut(docs.select("doc_id", "source", size.cast("long").alias("size"), u1.alias("u1"), u2.alias("u2")), "mix-rows")
    plan = cut(targets(rows, weights, most), "mix-targets")
    key = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    p = plan.select(key.alias("key"), "n", "source_size", "target", F.floor(share + EPS).alias("whole"), share.alias("share"))
    units = rows.withColumn("key", key).groupBy("u1", "u2", "key", "doc_id", "source", "size").agg(F.count("*").alias("m"))
    units = units.withColumn("num", F.explode(F.sequence(F.lit(1), F.col("m")))).drop("m")
    units = join_groups(units, p, "key")
    units = units.withColumn("p", F.greatest(F.lit(0.0), F.col("share") - F.col("whole")))
    most_n = plan.agg(F.max("n")).first()[0] or 0
    kind = "key string, doc_id long, size long, n long, whole long, p double, source string, source_size long, target double, u1 long, u2 long, num long"
    names = [c.split()[0] for c in kind.split(", ")]
    level, per, parts = 0, 1, []
    live = units.select(*names)
    while True:
        buckets = F.ceil(F.col("n") / F.lit(per * BUCKET)).cast("long")
        last = most_n <= per * BUCKET
        live = live.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "u1", "u2", "num"), buckets))
        done = cut(live.groupBy("key", "bucket").applyInPandas(_level(level, seed, last), kind + ", bucket long").select(*names), "mix-level")
        settled = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        parts.append(done.where(settled))
        if last:
            break
        live, level, per = done.where(~settled), level + 1, per * BUCKET // 16
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"), "u1", "u2")


def stage(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows it does not take are left out.

    Rows may share a doc_id, or have none. Rows equal in all values share the copies that these take together. Nulls in
    any column and other columns of any name stay as they are; an empty table gives an empty result.
    """
    n, one, two, times = fresh(docs, "mix_copies", "mix_one", "mix_two", "mix_rows")
    got = copies(docs).groupBy(F.col("u1").alias(one), F.col("u2").alias(two)).agg(F.sum("copies").alias(n), F.count("*").alias(times))
    got = cut(got, "mix-copies")
    u1, u2 = identity(docs)
    # a row a document: too many to broadcast, however few they are in a test
    met = docs.withColumns({one: u1, two: u2}).join(got.where(F.col(n) > 0).hint("merge"), [one, two])
    both = met
    if not got.where(F.col(times) > 1).isEmpty():
        both = met.where(F.col(times) == 1).unionByName(met.where(F.col(times) > 1).dropDuplicates([one, two]))
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*every(docs))
