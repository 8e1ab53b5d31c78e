"""Language identification by interpolated Kneser-Ney character models, one a language.

Text is lower-cased and split into words; a word's characters, with start marks before and an end mark after, are
predicted from the characters before them. Spark counts words per language over the training rows, then the distinct
words' n-grams, then continuation counts; so what is gathered follows the corpus. A language's model is kept as sorted
hash arrays: interpolated log probabilities of seen n-grams and back-off weights of seen contexts. A text's score is
its cross-entropy in bits a character, found once for each distinct word of a batch.

One training row in HELD, by a hash of its text, is held back from the counts. These rows calibrate the rejection: how
far a text's bits a character may lie above its language's mean follows from its number of characters and from a
quantile of the texts held back.

Every counted n-gram is in the model. Up to MOST of them the arrays are made by the driver and broadcast; a larger model
stays in tables of the shared folder, made by the same formulas, and the texts' distinct words and n-grams are joined to it.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import column, join_groups, pieces, trim
from tidelog.storage import cut

ORDER = 4
#: n-grams of the full order, over all languages, up to which a model is gathered and broadcast (some 24 bytes each); a larger one is joined.
MOST = 1_500_000
#: One training row of so many, by its text, is held back to calibrate the rejection.
HELD = 8
#: Bits a character by which a text's mean may drift from its language's, besides the error that falls with its length.
DRIFT = 0.15
#: Share of the rows held back that may lie beyond a language's limit, and the bounds of that limit in standard errors.
BEYOND, LEAST_ERRORS, MOST_ERRORS = 0.002, 6.0, 10.0
START, STOP = "\x02", "\x03"


def crc_fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in one array, and the number of words of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(real).as_py():
        owner = np.repeat(np.arange(len(n)), n)[real.to_numpy(zero_copy_only=False)]
        n = np.bincount(owner, minlength=len(n))
        flat = flat.filter(real)
    return flat, n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for y in batches for x in pieces(y, 0)):
        langs = b.column(1).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            flat, _ = _split(b.column(0).filter(pc.equal(langs.indices, k)))
            got = pc.value_counts(flat)
            words = got.field("values").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, got.field("counts").cast(pa.int64())], names=["lang", "word", "n"])


def _ngrams(order: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[tuple[str, str], int] = {}
            for lang, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = START * (order - 1) + word + STOP
                for k in range(len(w) - order + 1):
                    g = lang, w[k : k + order]
                    got[g] = got.get(g, 0) + n
            keys = list(got)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(got.values(), pa.int64())], names=["lang", "gram", "n"])
        trim()

    return of


def _hash(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; the column count counts too."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _points(texts: pa.Array) -> np.ndarray:
    """The code points of all texts, one after another; Arrow strings are joined without a Python string for each."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(grams: list[str] | pa.Array, width: int | None = None) -> np.ndarray:
    """The code points of grams of one length, a row each."""
    if isinstance(grams, list):
        return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), width or -1)
    return _points(grams).reshape(len(grams), width or -1)


@dataclass
class Table:
    """Sorted hashes and a value for each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


@dataclass
class Kn:
    """One language: for k = 1..order, log2 probabilities of k-grams; for k = 1..order-1, log2 back-off of contexts of k characters."""

    grams: list[Table]
    backs: list[Table]
    floor: float

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of the last column of each row given those before it."""
        n, order = codes.shape
        out, live = np.zeros(n), np.arange(n)
        for k in range(order, 0, -1):
            sub = codes[live, order - k :]
            found, v = self.grams[k - 1].get(_hash(sub))
            out[live[found]] += v[found]
            live = live[~found]
            if not len(live):
                return out
            if k > 1:
                seen, w = self.backs[k - 2].get(_hash(codes[live, order - k : order - 1]))
                out[live] += np.where(seen, w, 0.0)
        out[live] += self.floor
        return out


def train_language(counts: list[tuple[np.ndarray, np.ndarray]], alphabet: int) -> Kn:
    """Interpolated Kneser-Ney from the code points of grams of length 1, 2, ... and their counts: raw at the top, continuations below."""
    grams: list[Table] = []
    backs: list[Table] = []
    lower = Table(np.zeros(0, np.uint64), np.zeros(0))
    floor, unseen = 1.0 / (alphabet + 1), 0.0
    for k, (codes, c) in enumerate(counts, 1):
        ones, twos = int((c == 1).sum()), int((c == 2).sum())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, ctx = np.unique(_hash(codes[:, :-1]), return_inverse=True)
        total = np.bincount(ctx, c, len(contexts))
        mass = d * np.bincount(ctx, minlength=len(contexts)) / total
        if k > 1:
            found, v = lower.get(_hash(codes[:, 1:]))
            below = np.where(found, v, 0.0)
        else:
            below = np.full(len(codes), floor)
        lower = Table.of(_hash(codes), np.maximum(c - d, 0) / total[ctx] + mass[ctx] * below)
        grams.append(Table(lower.keys, np.log2(lower.values)))
        if k == 1:
            unseen = np.log2((float(mass[0]) if len(contexts) else 1.0) * floor)
        else:
            backs.append(Table(contexts, np.log2(mass)))
    return Kn(grams, backs, float(unseen))


class Model:
    """All languages: predict() gives language, score and rejection of texts.

    known holds the finished log2 probabilities, under every language, of all n-grams of the full order that any of
    them has seen, so that most characters take one search; the others back off through the languages' own arrays.
    """

    def __init__(self, langs: dict[str, Kn], order: int, seen: np.ndarray | None = None):
        self.names, self.order = sorted(langs), order
        self.langs = [langs[n] for n in self.names]
        self.scale = np.tile([0.0, 1.0, MOST_ERRORS], (len(self.names), 1))
        seen = np.zeros((0, order), np.uint32) if seen is None else seen
        keys, first = np.unique(_hash(seen), return_index=True)
        rows = [self._backed_off(seen[first[k : k + 100_000]]) for k in range(0, len(keys), 100_000)]
        self.keys, self.known = keys, np.concatenate(rows) if rows else np.zeros((0, len(self.names)))

    def _backed_off(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([m.symbols(codes) for m in self.langs], axis=1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability under each language of the last column of each row given those before it."""
        if not len(self.keys):
            return self._backed_off(codes)
        h = _hash(codes)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out, new = self.known[at], self.keys[at] != h
        if new.any():
            out[new] = self._backed_off(codes[new])
        return out

    def word_bits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word (with its end mark) under each language, and its characters (with that mark)."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        bits = np.zeros((len(words), len(self.langs)))
        for a in range(0, len(words), 10_000):
            n = size[a : a + 10_000]
            flat = _points(pc.binary_join_element_wise(START * (self.order - 1), words.slice(a, 10_000).cast(pa.string()), STOP, ""))
            first = np.cumsum(n + self.order - 1) - (n + self.order - 1)
            ends = np.cumsum(n) - n
            begin = np.repeat(first - ends, n) + np.arange(n.sum())
            bits[a : a + 10_000] = -np.add.reduceat(self.symbols(flat[begin[:, None] + np.arange(self.order)]), ends)
        return bits, size

    def _occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, word's bits under each language by column, word's characters) of every word, as indices into the different words."""
        flat, per = _split(texts)
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        bits, size = self.word_bits(coded.dictionary)
        return np.repeat(np.arange(len(texts)), per), coded.indices.to_numpy(zero_copy_only=False), np.ascontiguousarray(bits.T), size

    def _totals(self, n: int, owner: np.ndarray, at: np.ndarray, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros((n, len(self.names))), np.zeros(n)
        return np.stack([np.bincount(owner, b[at], n) for b in bits], axis=1), np.bincount(owner, size[at], n)

    def measure(self, texts: pa.Array) -> np.ndarray:
        """The sums MEASURES of each text's words under the language that fits it best, a row each."""
        n = len(texts)
        owner, at, bits, size = self._occurrences(texts)
        total, _ = self._totals(n, owner, at, bits, size)
        if not len(at):
            return np.zeros((n, len(MEASURES)))
        b, z = bits[total.argmin(1)[owner], at], size[at]
        return np.stack([np.bincount(owner, x, n) for x in (z, b, b * b, b * z, z * z)], axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, bits a character, rejected) of each text."""
        n = len(texts)
        if not self.names or not n:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        total, chars = self._totals(n, *self._occurrences(texts))
        return verdicts(self.names, self.scale, total, chars, _letters(texts))


def _letters(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def verdicts(names: list[str], scale: np.ndarray, total: np.ndarray, chars: np.ndarray, letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits a character, rejected) of texts from their bits under each language, characters and whether they have a letter."""
    n = len(total)
    size = np.maximum(chars, 1)
    h = total / size[:, None]
    best = h.argmin(1)
    low = h[np.arange(n), best]
    # a posterior tempered by the square root of the length: neighbouring characters are not independent
    gap = (h - low[:, None]) * np.sqrt(size)[:, None]
    score = 1.0 / np.exp2(-np.minimum(gap, 60)).sum(1)
    mean, sd, errors = scale[best].T
    rejected = ~letter | (low > mean + errors * standard_error(sd, size))
    lang = [names[b] if ok else "und" for b, ok in zip(best, letter)]
    return lang, np.where(letter, score, 0.0), low, rejected


def standard_error(sd, chars):
    """Of the bits a character of a text of so many characters."""
    return np.sqrt(DRIFT**2 + sd**2 / chars)


def train(rows: DataFrame, order: int = ORDER, most: int = MOST) -> Model | Joined:
    """A model of all n-grams of rows (text, lang). Null texts and languages are left out; no rows: a model without languages.

    One row in HELD, by its text, is not counted and calibrates the rejection; a language that would have no other rows
    keeps them all, and is calibrated on what it learned. Repeated rows count as often as they occur. The driver receives
    the n-grams with their counts where they are at most `most` of the full order; a larger model is made of tables and
    holds the same values. Sums over any number of rows are made by Spark.
    """
    rows = rows.where("text is not null and lang is not null").select("text", "lang")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    alone = [r["lang"] for r in rows.groupBy("lang").agg(F.min(held).alias("all_held")).where("all_held").collect()]  # a row a language
    held = held & ~F.col("lang").isin(alone)
    words = rows.where(~held).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut(words, "langid-words")
    level = cut(words.mapInArrow(_ngrams(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    large = level.limit(most + 1).count() > most
    levels = [level.withColumn("k", F.lit(order))]
    for k in range(order - 1, 0, -1):
        # continuation counts: the different characters before a (k)-gram
        level = level.select("lang", F.substring("gram", 2, order).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        if k > 1 or large:
            level = cut(level, "langid-level")
        levels.append(level.withColumn("k", F.lit(k)))
    levels.reverse()
    if large:
        model = _train_tables(levels, order)
    else:
        counts: dict[str, list] = {}
        for df in levels:
            got = df.select("lang", "gram", "n", "k").toArrow()
            for lang in pc.unique(got["lang"]).to_pylist():
                of = got.filter(pc.equal(got["lang"], lang)).combine_chunks()
                gram, = of["gram"].cast(pa.string()).chunks
                counts.setdefault(lang, []).append((_codes(gram, of["k"][0].as_py()), of["n"].to_numpy().astype(float)))
        alphabet = len(np.unique(np.concatenate([v[0][0].ravel() for v in counts.values()]))) if counts else 0
        seen = np.concatenate([v[-1][0] for v in counts.values()]) if counts else None
        model = Model({lang: train_language(v, alphabet) for lang, v in counts.items()}, order, seen)
        del counts, seen
    model = _calibrate(model, rows.where(held), rows.where(~held))
    trim()  # what the driver gathered goes back to the system
    return model


#: Sums over the words of a text: characters, bits, squared bits, bits times characters, squared characters.
MEASURES = ("chars", "bits", "bits2", "cross", "chars2")


def _calibrate(model: Model | Joined, held: DataFrame, learned: DataFrame) -> Model | Joined:
    """Sets scale: mean bits a character of each language, their spread by character, and the limit in standard errors.

    The limit is the least that leaves at most a share BEYOND of the language's rows outside, within LEAST_ERRORS and
    MOST_ERRORS. Languages with no row held back are measured on the rows they learned from.
    """
    model.scale = np.tile([0.0, 1.0, MOST_ERRORS], (len(model.names), 1))
    left = set(model.names)
    for rows in (held, learned):
        if not left:
            break
        got = cut(_measured(rows.where(F.col("lang").isin(sorted(left))), model).where("chars > 0"), "langid-measured")
        found = {r["lang"]: r for r in got.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in MEASURES]).collect()}  # a row a language
        for lang, r in found.items():
            mean = r["bits"] / r["chars"]
            spread = max(r["bits2"] - 2 * mean * r["cross"] + mean**2 * r["chars2"], 0.0) / r["chars"]
            model.scale[model.names.index(lang), :2] = mean, max(spread, 0.25) ** 0.5
        if not found:
            continue
        place = lambda k: F.element_at(F.create_map(*[x for lang in found for x in (F.lit(lang), F.lit(float(model.scale[model.names.index(lang), k])))]), F.col("lang"))
        errors = (F.col("bits") / F.col("chars") - place(0)) / F.sqrt(DRIFT**2 + place(1) ** 2 / F.col("chars"))
        cell = F.ceil(F.least(F.greatest(errors, F.lit(LEAST_ERRORS)), F.lit(MOST_ERRORS)) * 64)
        beyond: dict[str, list] = {}
        for r in got.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n")).collect():  # a few hundred cells a language
            beyond.setdefault(r["lang"], []).append((r["cell"], r["n"]))
        for lang, cells in beyond.items():
            may, limit = BEYOND * found[lang]["n"], LEAST_ERRORS
            for at, n in sorted(cells, reverse=True):
                may -= n
                if may < 0:
                    limit = at / 64
                    break
            model.scale[model.names.index(lang), 2] = limit
        left -= set(found)
    return model


def _measured(rows: DataFrame, model: Model | Joined) -> DataFrame:
    """(lang, MEASURES) of rows (text, lang) under the language that fits each best."""
    if isinstance(model, Joined):
        return _totals_joined(rows, model, ["lang"])[0].select(F.col("k0").alias("lang"), *[F.col("own")[c].alias(c) for c in MEASURES])
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pickle.dumps(model)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(sent)
        for b in (x for y in batches for x in pieces(y, 0, 2 << 20)):
            yield pa.RecordBatch.from_arrays([b.column(1), *map(pa.array, m.measure(b.column(0)).T)], names=["lang", *MEASURES])

    return rows.select("text", "lang").mapInArrow(of, "lang string, " + ", ".join(f"{c} double" for c in MEASURES))


@dataclass
class Joined:
    """A model in tables: for k = 1..order, (lang, gram, v) with log2 probabilities; for k = 1..order-1, (lang, context, w) with log2 back-off."""

    names: list[str]
    order: int
    grams: list[DataFrame]
    backs: list[DataFrame]
    floor: DataFrame  # (lang, floor)
    scale: np.ndarray | None = None  # mean, spread and limit of each language

    def word_bits(self, words: DataFrame) -> DataFrame:
        """(word, bits) of different words: bits of each (with its end mark) under each language, in the order of names."""
        order = self.order
        parts = words.select("word", F.concat(F.lit(START * (order - 1)), "word", F.lit(STOP)).alias("w"))
        parts = parts.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - (order - 1)), lambda i: F.substring(F.col("w"), i, F.lit(order)))).alias("gram"))
        parts = cut(parts.groupBy("word", "gram").agg(F.count("*").alias("times")), "langid-parts")
        floors = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["floor"]).alias("floor")) for r in self.floor.collect()])  # a row a language
        out = parts.select("gram").distinct().select("gram", F.inline(floors))
        bits = F.col("floor")
        for k in range(1, order + 1):
            tail = F.substring(F.col("gram"), order - k + 1, k)
            out = out.withColumn("tail", tail).join(self.grams[k - 1].select("lang", F.col("gram").alias("tail"), F.col("v").alias(f"v{k}")), ["lang", "tail"], "left").drop("tail")
            if k > 1:
                context = F.substring(F.col("gram"), order - k + 1, k - 1)
                out = out.withColumn("context", context).join(self.backs[k - 2].select("lang", "context", F.col("w").alias(f"w{k}")), ["lang", "context"], "left").drop("context")
                bits = bits + F.coalesce(F.col(f"w{k}"), F.lit(0.0))
            bits = F.coalesce(F.col(f"v{k}"), bits)
        by_gram = out.select("gram", F.struct("lang", (-bits).alias("b")).alias("x")).groupBy("gram").agg(F.sort_array(F.collect_list("x")).alias("x"))
        by_gram = cut(by_gram.select("gram", F.col("x.b").alias("b")), "langid-gram-bits")
        sums = [F.sum(F.col("times") * F.col("b")[i]) for i in range(len(self.names))]
        return cut(join_groups(parts, by_gram, "gram").groupBy("word").agg(F.array(*sums).alias("bits")), "langid-word-bits")


def _train_tables(levels: list[DataFrame], order: int) -> Joined:
    """What train_language does, by joins: levels (lang, gram, n) of length 1, 2, ..."""
    alphabet = levels[0].select("gram").distinct().count()
    base = 1.0 / (alphabet + 1)
    grams, backs, floor = [], [], None
    for k, level in enumerate(levels, 1):
        of = lambda x: F.count(F.when(F.col("n") == x, 1)).cast("double")
        d = level.groupBy("lang").agg(of(1).alias("ones"), of(2).alias("twos"))
        d = d.select("lang", F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5).alias("d"))
        level = level.select("lang", "gram", "n", F.substring("gram", 1, k - 1).alias("context"))
        contexts = level.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("types")).join(F.broadcast(d), "lang")
        contexts = cut(contexts.withColumn("mass", F.col("d") * F.col("types") / F.col("total")), "langid-contexts")
        if k == 1:
            level = level.join(F.broadcast(contexts), ["lang", "context"]).withColumn("below", F.lit(base))
            floor = contexts.select("lang", F.log2(F.col("mass") * base).alias("floor"))
        else:
            lower = grams[-1].select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"))
            level = level.join(contexts, ["lang", "context"]).withColumn("tail", F.substring("gram", 2, order)).join(lower, ["lang", "tail"], "left").na.fill(0.0, ["below"])
            backs.append(contexts.select("lang", "context", F.log2("mass").alias("w")))
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("mass") * F.col("below")
        level = level.select("lang", "gram", p.alias("p"))
        grams.append(cut(level.withColumn("v", F.log2("p")), "langid-model"))
    floor = cut(floor, "langid-floor")
    return Joined(sorted(r["lang"] for r in floor.collect()), order, grams, backs, floor)  # a row a language


def predict(docs: DataFrame, model: Model | Joined, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits, rejected of every row of docs, from its text alone.

    und, score 0 and rejected: null texts, texts without a letter, and all texts if no language was learned. rejected
    also where the text fits no language. keep: columns to return instead of doc_id.
    """
    if isinstance(model, Joined):
        return _predict_joined(docs, model, keep or ["doc_id"])
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pickle.dumps(model)))
    keep = keep or ["doc_id"]
    rows = docs.select("text", *[column(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(sent)
        for b in (x for y in batches for x in pieces(y, 0, 2 << 20)):
            lang, score, bits, rejected = m.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], names=[*b.schema.names[1:], "lang_pred", "score", "bits", "rejected"])

    trim()
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join([f"k{i} {kinds[f'k{i}'].simpleString()}" for i in range(len(keep))] + ["lang_pred string", "score double", "bits double", "rejected boolean"])
    out = rows.mapInArrow(of, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits", "rejected")


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, n) of every different word of each text."""
    for b in (x for y in batches for x in pieces(y, 1)):
        flat, per = _split(b.column(1))
        rows = pa.array(np.repeat(b.column(0).to_numpy(), per))
        got = pa.table({"row": rows, "word": flat.cast(pa.string())}).group_by(["row", "word"]).aggregate([([], "count_all")]).select(["row", "word", "count_all"])
        yield from got.rename_columns(["row", "word", "n"]).combine_chunks().to_batches()


def _totals_joined(docs: DataFrame, model: Joined, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row, total, chars, own, k0, k1, ...) of every row of docs, by joins, and the written rows (row, text, k0, k1, ...) themselves.

    Rows are numbered in a written table, so repeated rows keep their own values.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "text", *[column(c).alias(f"k{i}") for i, c in enumerate(keep)]), "langid-rows")
    found = cut(rows.select("row", "text").mapInArrow(_doc_words, "row long, word string, n long"), "langid-doc-words")
    known = model.word_bits(found.select("word").distinct())
    n, z = F.col("n"), (F.length("word") + 1).cast("double")
    sums = [F.sum(n * z).alias("chars"), F.sum(n * z * z).alias("chars2")]
    for i in range(len(model.names)):
        b = F.col("bits")[i]
        sums += [F.sum(n * b).alias(f"b{i}"), F.sum(n * b * b).alias(f"q{i}"), F.sum(n * b * z).alias(f"x{i}")]
    scored = join_groups(found, known, "word").groupBy("row").agg(*sums)
    each = [F.struct(F.col(f"b{i}").alias("bits"), F.lit(i).alias("i"), F.col("chars"), F.col(f"q{i}").alias("bits2"), F.col(f"x{i}").alias("cross"), F.col("chars2")) for i in range(len(model.names))]
    scored = scored.select("row", F.array(*[F.col(f"b{i}") for i in range(len(model.names))]).alias("total"), "chars", F.array_min(F.array(*each)).alias("own"))
    return rows.join(scored, "row", "left").select("row", "total", "chars", "own", *[f"k{i}" for i in range(len(keep))]), rows


def _predict_joined(docs: DataFrame, model: Joined, keep: list[str]) -> DataFrame:
    """predict by joins."""
    scored, rows = _totals_joined(docs, model, keep)
    scored = scored.select("row", "total", "chars")
    names, scale = model.names, model.scale

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_letters(b.column(1)))], names=["row", "letter"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.array([x or [0.0] * len(names) for x in b.column(1).to_pylist()], float).reshape(b.num_rows, len(names))
            chars = np.array(pc.fill_null(b.column(2), 0.0))
            lang, score, bits, rejected = verdicts(names, scale, total, chars, np.array(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], names=["row", "lang_pred", "score", "bits", "rejected"])

    with_letters = rows.select("row", "text").mapInArrow(letters, "row long, letter boolean")
    said = with_letters.join(scored, "row").select("row", "total", "chars", "letter").mapInArrow(of, "row long, lang_pred string, score double, bits double, rejected boolean")
    return rows.join(said, "row").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits", "rejected")


_models: dict[str, Model] = {}


def _loaded(sent) -> Model:
    """The model of a broadcast, once a worker."""
    name, raw = sent.value
    if name not in _models:
        _models.clear()
        _models[name] = pickle.loads(raw)
    return _models[name]


def identify(docs: DataFrame, order: int = ORDER, most: int = MOST) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected of every row of docs.

    Learns from rows whose crc32(doc_id as text) mod 3 is not 1. An empty table gives an empty result; a null doc_id
    counts as the empty text there.
    """
    rows = docs.select("doc_id", "text", "lang", (crc_fold() == 1).alias("held_out"))
    model = train(rows.where(~F.col("held_out")), order, most)
    out = predict(rows, model, ["doc_id", "held_out"])
    return out


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised, with the columns of docs.

    Null texts, texts without a letter and texts that fit no learned language go; null languages teach nothing; an empty
    table, or one without a row to learn from, gives an empty result.

    The verdict is attached to each row in one pass, so repeated ids and other columns stay as they are.
    """
    model = train(docs.where(crc_fold() != 1))
    out = predict(docs, model, list(docs.columns))
    names = out.columns
    return out.toDF(*[f"c{i}" for i in range(len(names))]).where(~F.col(f"c{len(names) - 1}")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
