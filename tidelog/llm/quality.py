"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame expressions. Documents are judged against the others of their language and source: a vector of
transformed statistics, a deterministic MCD estimate and a Mahalanobis distance. Each group starts from three estimates
(medians and MADs, mean and covariance, spatial signs), takes two concentration steps on the h nearest documents from
each, keeps the one whose covariance has the least determinant and concentrates it on. A group's estimate is then drawn
towards its language's, and that one's towards the mean over languages, by the weight of SHRINK rows; so every group
has an estimate of its own, and none hangs on a few rows. All sums over rows are of fixed-point integers, so reruns and
other partitionings give the same estimates.

Rows travel once: the statistics are cut to a narrow table, each concentration step reads only that table and
moves per-group histograms and moments. A group of any size is therefore pre-aggregated before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import every, fresh, join_groups, let, words
from tidelog.storage import cut

#: Dimensions of the vector, and for each the spread (in log units) below which differences mean nothing: a tenth of the
#: length; the error of a mean over 50 words; one symbol in 50 words; half the step from no repeated line to one; one
#: repeated window in 500 words.
DIMS = ("length", "word_length", "symbols", "dup_lines", "repeats")
FLOORS = (0.1, 0.07, 0.3, 0.35, 0.7)
#: Fixed-point steps of one log unit.
SCALE = 1024
#: Chi-square quantiles for len(DIMS) = 5 degrees of freedom: the median, and the one at a tail of 1e-4.
CHI2_MEDIAN, CHI2_CUT = 4.351, 25.745
#: Histogram cells for each doubling of 1 + d2.
CELLS = 32
#: Rows of the wider estimate that a narrower one is mixed with, and rows up to which the narrower has no weight: too few for the determinant to tell outliers.
SHRINK, NONE = 50, 2 * (len(DIMS) + 1)
#: Fixed-point steps of a product of spatial signs.
SIGNS = 1 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""

    def marked(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(order, lambda o: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(o, lambda s, i: F.get(o, i - 1)["h"].eqNullSafe(s["h"]) | F.get(o, i + 1)["h"].eqNullSafe(s["h"])),
            lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))))

    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))


def stat_columns(text: Column) -> Column:
    """A struct of the five base counts of a whole text (null: none)."""
    t = F.coalesce(text, F.lit(""))
    has_word = f"[^{chr(92)}x20{chr(92)}x09-{chr(92)}x0D]"
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word)), lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def of(w: Column) -> Column:
        return let(F.array_join(w, ""), lambda j: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(j).cast("long").alias("word_chars"),
            (F.length(j) - F.length(F.translate(j, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words")))

    return let(words(t), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """The transformed statistics as fixed-point integers."""
    n = s["n_words"].cast("double")
    x = [
        F.log1p(n),
        F.log1p(s["word_chars"] / (n + 1)),
        F.log1p(100.0 * s["n_symbols"] / (s["word_chars"] + 50.0)),
        F.log1p(s["n_dup_lines"].cast("double")),
        F.log1p(100.0 * s["n_repeat_words"] / (n + 50.0)),
    ]
    return [F.round(v * SCALE).cast("long") for v in x]


def _key(*columns: Column) -> Column:
    """One string for a tuple of nullable columns; different tuples give different strings."""
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in columns])


def _quantile(bins: Column, share: float) -> Column:
    """The first cell of sorted (cell, count) pairs at which the running count reaches that share of all."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    return let(F.ceil(total * share), lambda need: F.aggregate(
        bins, F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("at")),
        lambda a, b: F.struct((a["run"] + b["n"]).alias("run"), F.when(a["at"].isNull() & (a["run"] + b["n"] >= need), b["bin"]).otherwise(a["at"]).alias("at")),
        lambda a: a["at"]))


def _histogram(rows: DataFrame, cell: Column, share: dict[str, float]) -> DataFrame:
    """Quantile cells of each pool from a histogram that is summed before it is shuffled."""
    bins = rows.groupBy("pool", cell.alias("bin")).agg(F.count("*").alias("n"))
    got = bins.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))  # as many as there are cells
    return got.select("pool", *[_quantile(F.col("bins"), q).alias(k) for k, q in share.items()])


P = range(len(DIMS))
LOWER = [(i, j) for i in P for j in range(i + 1)]
#: What describes an estimate: centre, inverse of the covariance's Cholesky factor, logarithm of its determinant.
PARAMS = [f"m{i}" for i in P] + [f"a{i}{j}" for i, j in LOWER] + ["logdet"]
STARTS, TRIAL = 3, 2


def _sum(terms) -> str:
    return " + ".join(terms) or "0d"


def _factor(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, PARAMS) from centres m* and covariances c* (lower triangle); pivots stay above a quarter of the floors."""
    for j in P:
        df = df.selectExpr("*", f"sqrt(greatest(c{j}{j} - ({_sum(f'l{j}{k} * l{j}{k}' for k in range(j))}), {FLOORS[j] ** 2 / 4}d)) l{j}{j}")
        df = df.selectExpr("*", *[f"(c{i}{j} - ({_sum(f'l{i}{k} * l{j}{k}' for k in range(j))})) / l{j}{j} l{i}{j}" for i in range(j + 1, len(DIMS))])
    for i in P:
        df = df.selectExpr("*", *[f"({'1d' if i == j else '-(' + _sum(f'l{i}{k} * a{k}{j}' for k in range(j, i)) + ')'}) / l{i}{i} a{i}{j}" for j in range(i + 1)])
    return df.selectExpr("*", f"2 * ({_sum(f'ln(l{j}{j})' for j in P)}) logdet").select(*keep, *PARAMS)


def _diagonal(rows: DataFrame) -> DataFrame:
    """(pool, m*, s*): medians and scaled MADs of each dimension."""
    step = SCALE // 32
    long = rows.select("pool", F.posexplode(F.array(*DIMS)).alias("d", "x")).select(F.struct("pool", "d").alias("pool"), F.floor(F.col("x") / step).alias("cell"))
    med = cut(_histogram(long, F.col("cell"), {"med": 0.5}), "mcd-median")
    dev = join_groups(long, med, "pool").select("pool", F.abs(F.col("cell") - F.col("med")).alias("cell"))
    both = med.join(_histogram(dev, F.col("cell"), {"mad": 0.5}), "pool").select(
        "pool.pool", "pool.d", ((F.col("med") + 0.5) * step / SCALE).alias("m"), (1.4826 * (F.col("mad") + 0.5) * step / SCALE).alias("s"))
    return both.groupBy("pool").agg(*[F.max(F.when(F.col("d") == i, F.col(c))).alias(f"{c}{i}") for i in P for c in "ms"])


def _moments(rows: DataFrame) -> DataFrame:
    """(pool, n, m*, c*): means and covariances plus floors of each pool's rows."""
    sums = rows.groupBy("pool").agg(F.expr("cast(count(*) as double) n"), *[F.expr(f"sum({DIMS[i]}) t{i}") for i in P], *[F.expr(f"sum({DIMS[i]} * {DIMS[j]}) q{i}{j}") for i, j in LOWER])
    return sums.selectExpr("pool", "n", *[f"t{i} / n / {SCALE} m{i}" for i in P], *[
        f"q{i}{j} / n / {SCALE**2} - (t{i} / n) * (t{j} / n) / {SCALE**2} + {FLOORS[i] ** 2 if i == j else 0.0}d c{i}{j}" for i, j in LOWER])


def _signs(rows: DataFrame, diagonal: DataFrame) -> DataFrame:
    """(pool, m*, c*): medians and the covariance of the directions of rows from them, scaled by the MADs; a row at the medians has none."""
    seen = join_groups(rows, diagonal, "pool").selectExpr("pool", *[f"({d} / {SCALE} - m{i}) / s{i} z{i}" for i, d in enumerate(DIMS)])
    seen = seen.selectExpr("*", _sum(f"z{i} * z{i}" for i in P) + " r2").where("r2 > 0")
    sums = seen.groupBy("pool").agg(F.expr("count(*) n"), *[F.expr(f"sum(cast(round(z{i} * z{j} / r2 * {SIGNS}) as long)) u{i}{j}") for i, j in LOWER])
    part = lambda i, j: f"s{i} * s{j} * {len(DIMS)} * coalesce(u{i}{j} / n / {SIGNS}, {1 / len(DIMS) if i == j else 0.0}d) + {FLOORS[i] ** 2 if i == j else 0.0}d c{i}{j}"
    return diagonal.join(sums, "pool", "left").selectExpr("pool", *[f"m{i}" for i in P], *[part(i, j) for i, j in LOWER])


def squared_distance(x: list[str], at: str = "") -> Column:
    """Of a vector of fixed-point logarithms, to the estimate whose PARAMS are columns, or fields of the struct `at` (with its dot)."""
    off = [f"({v} / {SCALE} - {at}m{j})" for j, v in enumerate(x)]
    y = ["(" + _sum(f"{at}a{i}{j} * {off[j]}" for j in range(i + 1)) + ")" for i in P]
    return F.expr(_sum(f"{v} * {v}" for v in y))


def _near(rows: DataFrame, params: DataFrame, pools: int) -> DataFrame:
    """rows with params of their pool and the histogram cell of their squared distance."""
    d2 = squared_distance(DIMS)
    return join_groups(rows, params, "pool", known=pools).withColumn("cell", F.floor(F.log2(1.0 + d2) * CELLS))


def fit(rows: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """(pool, n, m*, c*): the MCD of each pool of rows (pools array<long>, DIMS), scaled so that the median of d2 is the chi-square median.

    A pool is a long whose last two bits are zero: they tell its starts apart. Every start takes TRIAL steps; then the
    one of the least determinant (the first of equal ones) goes on until nothing changes, `steps` steps in all at most.
    Floors widen the metric; the scale never narrows it again.
    """
    base = rows.withColumn("pool", F.explode("pools")).drop("pools")
    every = rows.withColumn("pool", F.explode(F.flatten(F.transform("pools", lambda p: F.array(*[p + k for k in range(STARTS)]))))).drop("pools")
    diagonal = cut(_diagonal(base), "mcd-diagonal")
    flat = diagonal.selectExpr("pool", *[f"m{i}" for i in P], *[(f"s{i} * s{i} + {FLOORS[i] ** 2}d" if i == j else "0d") + f" c{i}{j}" for i, j in LOWER])
    starts = [flat, _moments(base).drop("n"), _signs(base, diagonal)]
    params = cut(reduce(DataFrame.unionByName, [_factor(x.withColumn("pool", F.col("pool") + k), "pool") for k, x in enumerate(starts)]), "mcd-start")
    pools, covariances = params.count(), [f"c{i}{j}" for i, j in LOWER]
    sign = F.bit_xor(F.xxhash64("pool", *PARAMS))
    before, over = None, every
    for k in range(steps):
        within = _histogram(_near(over, params, pools), F.col("cell"), {"within": share})
        bound = params.select("pool", *PARAMS).join(within, "pool")
        params = cut(_factor(_moments(_near(over, bound, pools).where("cell <= within")), "pool", *covariances), "mcd-step")
        if k + 1 == min(TRIAL, steps):
            home = F.col("pool").bitwiseAND(F.lit(-4))
            best = params.groupBy(home.alias("home")).agg(F.min(F.struct(F.round("logdet", 9).alias("logdet"), F.col("pool"))).alias("best")).select("home", F.col("best.pool").alias("pool"))
            params = cut(best.join(params, "pool").drop("pool").withColumnRenamed("home", "pool"), "mcd-best")
            over = base
        elif k >= TRIAL:
            after = params.agg(sign).first()[0]
            if after == before:
                break
            before = after
    middle = _histogram(_near(base, params, pools), F.col("cell"), {"at": 0.5})
    sizes = base.groupBy("pool").agg(F.count("*").alias("n"))
    wide = F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("at") + 0.5) / CELLS) - 1) / CHI2_MEDIAN)
    return params.join(middle, "pool").join(sizes, "pool").withColumn("wide", wide).selectExpr("pool", "n", *[f"m{i}" for i in P], *[f"c{i}{j} * wide c{i}{j}" for i, j in LOWER])


def _mean(langs: DataFrame) -> dict[str, float]:
    """The mean wm*, wc* of the languages' estimates (n, m*, c*): one row; by their rows beyond NONE, others count next to nothing."""
    w = langs.selectExpr("*", f"greatest(n - {NONE}, 0) + n / 1000000 w")
    sums = w.agg(F.sum("w").alias("t"), *[F.expr(f"sum(w * m{i}) s{i}") for i in P], *[F.expr(f"sum(w * (c{i}{j} + m{i} * m{j})) q{i}{j}") for i, j in LOWER])
    got = sums.selectExpr(*[f"s{i} / t wm{i}" for i in P], *[f"q{i}{j} / t - (s{i} / t) * (s{j} / t) wc{i}{j}" for i, j in LOWER])
    return {k: v if v is not None else 0.0 for k, v in got.first().asDict().items()}


def _shrunk(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """own (key, n, m*, c*, ...) mixed with `wider` (key, wm*, wc*): n - NONE rows of the one and the rest of n + SHRINK of the other."""
    rest = [c for c in own.columns if c[0] not in "mc"]
    mixed = own.join(wider, key).selectExpr("*", f"greatest(n - {NONE}, 0) / (n + {SHRINK}) w")
    return mixed.selectExpr(*rest, *[f"w * m{i} + (1 - w) * wm{i} m{i}" for i in P], *[f"w * c{i}{j} + (1 - w) * wc{i}{j} + w * (1 - w) * (m{i} - wm{i}) * (m{j} - wm{j}) c{i}{j}" for i, j in LOWER])


def _wider(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias("w" + c) for c in df.columns if c[0] in "mc"])


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """(source_key, PARAMS): what each language and source of rows (source_key, lang_key, DIMS) is judged by.

    The keys are longs whose last two bits are zero.
    """
    got = cut(fit(rows.select(F.array("source_key", "lang_key").alias("pools"), *DIMS), share, steps), "mcd-fit")
    groups = cut(rows.select("source_key", "lang_key").distinct(), "mcd-groups")
    langs = cut(groups.select("lang_key").distinct().join(got.withColumnRenamed("pool", "lang_key"), "lang_key"), "mcd-langs")
    langs = _shrunk(langs, langs.select("lang_key", *[F.lit(v).alias(k) for k, v in _mean(langs).items()]), "lang_key")
    own = groups.join(got.withColumnRenamed("pool", "source_key"), "source_key")
    return _factor(_shrunk(own, _wider(langs, "lang_key"), "lang_key"), "source_key")


def judge(docs: DataFrame, share: float = 0.75, steps: int = 5, cutoff: float = CHI2_CUT, whole: bool = False) -> DataFrame:
    """Base counts and the verdict of every row of docs (text, lang, source).

    Returns doc_id, the five counts, base_failed, distance (null where base_failed) and kept; with whole=True the rows
    that are kept, with every column of docs, instead. Null and empty texts have no words, so they fail the base rule.
    Rows that fail it take no part in the estimates. Null languages and sources are values of their own. Repeated rows
    are judged alike and weigh as often as they occur; ties at the edge of a concentration step are all taken. Other
    columns may have any name. An empty table gives an empty result.
    """
    names = fresh(docs, "qr_stats", "qr_failed", "qr_vector", "qr_source", "qr_lang", "qr_params")
    st, failed, vec, sk, lk, pr = names
    key = lambda *c: F.xxhash64(_key(*c)).bitwiseAND(F.lit(-4))
    table = docs.withColumn(st, stat_columns(F.col("text")))
    table = table.withColumns({failed: base_failed(F.col(st)), vec: F.array(*vector(F.col(st))), lk: key(F.lit("lang"), F.col("lang")), sk: key(F.col("lang"), F.col("source"))})
    keep = every(docs) if whole else ["doc_id"]
    table = cut(table.select(*keep, st, failed, vec, sk, lk), "quality")
    rows = table.where(~F.col(failed)).select(F.col(sk).alias("source_key"), F.col(lk).alias("lang_key"), *[F.col(vec)[i].alias(d) for i, d in enumerate(DIMS)])
    params = estimates(cut(rows, "mcd-rows"), share, steps)
    params = cut(params.select(F.col("source_key").alias(sk), F.struct(*PARAMS).alias(pr)), "mcd-params")
    out = join_groups(table, params, sk, "left")
    distance = F.when(~F.col(failed), squared_distance([f"{vec}[{i}]" for i in P], pr + "."))
    kept = ~F.col(failed) & (distance <= cutoff)
    if whole:
        return out.where(kept).select(*keep)
    return out.select("doc_id", *[F.col(st)[s].alias(s) for s in STATS], F.col(failed).alias("base_failed"), F.round(distance, 6).alias("distance"), kept.alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; see judge() for odd input."""
    return judge(docs, whole=True)
