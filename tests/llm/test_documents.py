"""Operators over documents, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, rows_of
from tidelog.llm import bpe, langid, media, mixing, quality, sharding, simhash
from tidelog.llm.common import read
from tidelog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_base_counts(spark, odd, empty, sf):
    for docs in (odd, read(spark, sf, "documents").unionByName(odd.limit(0), allowMissingColumns=True)):
        text = collections.defaultdict(list)
        for r in docs.collect():
            text[r.doc_id].append(base(r.text))
        for r in quality.judge(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in text[r.doc_id]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.judge(odd).count() == odd.count()


def planted(make):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(80, 600))) for _ in range(400)]
    junk = [" ".join(w + "%%%" for w in rng.choices(vocabulary, k=300)) for _ in range(8)]
    return make(rows_of(texts + junk)), len(texts)


def test_outliers_go_and_clean_documents_stay(make):
    docs, clean = planted(make)
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[k] for k in range(clean)) and not any(got[k] for k in range(clean, len(got)))
    kept = quality.stage(docs)
    assert kept.columns == docs.columns and kept.count() == clean
    again = {r.doc_id: r.distance for r in quality.judge(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.distance for r in quality.judge(docs).collect()}


def test_moderate_outliers_go(make):
    """Menus, a few symbols and repeated lines, all within what the base rule lets pass."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(rng.choices(vocabulary, k=rng.randint(80, 600))) for _ in range(400)]
    menus = [" | ".join(rng.sample(sorted(set(vocabulary)), k)) for k in (40, 80, 150, 300)]
    marked = [" ".join(w + "%" * (i % 3 == 0) for i, w in enumerate(rng.choices(vocabulary, k=k))) for k in (90, 400)]
    lines = ["\n".join([" ".join(rng.choices(vocabulary, k=200)), *["home"] * 20]) for _ in range(2)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(make(rows_of(clean + menus + marked + lines))).collect()}
    assert all(got[k] == (False, True) for k in range(400))
    assert all(got[k] == (False, False) for k in range(400, len(got)))


def test_few_rows_are_judged_too(make):
    """Too few for a pool of their own: a rare language against the table, a rare source against its language."""
    docs, clean = planted(make)
    rows = docs.collect()
    few = [(1000 + k, rows[k].text, lang, "rare", *rows[k][4:]) for lang in ("xx", "en") for k in (0, 1, clean)]
    few = [(1000 + k, *r[1:]) for k, r in enumerate(few)]
    got = {r.doc_id: r for r in quality.judge(make([tuple(r) for r in rows] + few)).collect()}
    assert [got[1000 + k].kept for k in range(6)] == [True, True, False] * 2
    assert all(got[1000 + k].distance is not None for k in range(6))


def mcd(x, share=0.75, steps=5):
    """Centre and covariance of the least determinant that concentration reaches from three starts, in NumPy."""
    n, v, step, floors = len(x), x / quality.SCALE, quality.SCALE // 32, np.diag(np.square(quality.FLOORS))
    at = lambda cells, part: np.sort(cells, axis=0)[int(np.ceil(n * part)) - 1]
    cells = x // step
    med = at(cells, 0.5)
    m, s = (med + 0.5) * step / quality.SCALE, 1.4826 * (at(abs(cells - med), 0.5) + 0.5) * step / quality.SCALE
    z = (v - m) / s
    z = z[(z**2).sum(1) > 0]
    u = np.round(np.einsum("ki,kj->kij", z, z) / (z**2).sum(1)[:, None, None] * quality.SIGNS).mean(0) / quality.SIGNS if len(z) else np.eye(5) / 5
    moments = lambda w: (w.mean(0), np.cov(w.T, bias=True).reshape(5, 5) + floors)
    distance = lambda m, c: (np.linalg.solve(np.linalg.cholesky(c), (v - m).T) ** 2).sum(0)
    cell = lambda m, c: np.floor(np.log2(1 + distance(m, c)) * quality.CELLS)
    ends = []
    for m, c in ((m, np.diag(s**2) + floors), moments(v), (m, np.outer(s, s) * 5 * u + floors)):
        for _ in range(quality.TRIAL):
            near = cell(m, c)
            m, c = moments(v[near <= at(near, share)])
        ends.append((round(np.linalg.slogdet(c)[1], 9), len(ends), m, c))
    _, _, m, c = min(ends, key=lambda e: e[:2])
    for _ in range(steps - quality.TRIAL):
        near = cell(m, c)
        m, c = moments(v[near <= at(near, share)])
    return m, c * max(1.0, (2 ** ((at(cell(m, c), 0.5) + 0.5) / quality.CELLS) - 1) / quality.CHI2_MEDIAN)


def test_verdicts_equal_brute_force_mcd(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    source = {r.doc_id: (r.lang, r.source) for r in docs.select("doc_id", "lang", "source").collect()}
    got = quality.judge(docs).collect()
    x, of = {}, collections.defaultdict(list)
    for r in got:
        if not r.base_failed:
            n = r.n_words
            stats = (n, r.word_chars / (n + 1), 100 * r.n_symbols / (r.word_chars + 50), r.n_dup_lines, 100 * r.n_repeat_words / (n + 50))
            x[r.doc_id] = np.floor(np.log1p(stats) * quality.SCALE + 0.5).astype(int)
            for key in (source[r.doc_id][0], source[r.doc_id]):
                of[key].append(r.doc_id)
    fits = {key: mcd(np.array([x[k] for k in ids])) for key, ids in of.items()}

    def shrunk(key, wider):
        w = max(0, len(of[key]) - quality.NONE) / (len(of[key]) + quality.SHRINK)
        (m, c), (wm, wc) = fits[key], wider
        return w * m + (1 - w) * wm, w * c + (1 - w) * wc + w * (1 - w) * np.outer(m - wm, m - wm)

    rows = {lang: max(0, len(of[lang]) - quality.NONE) + len(of[lang]) / 1e6 for lang in {lang for lang, _ in source.values()} if lang in of}
    mean = sum(n * fits[k][0] for k, n in rows.items()) / sum(rows.values())
    wide = sum(n * (fits[k][1] + np.outer(fits[k][0], fits[k][0])) for k, n in rows.items()) / sum(rows.values()) - np.outer(mean, mean)
    langs = {lang: shrunk(lang, (mean, wide)) for lang, _ in source.values() if lang in of}
    own = {key: shrunk(key, langs[key[0]]) for key in source.values() if key in of}
    assert len(own) > 40
    for r in got:
        if r.base_failed:
            assert not r.kept and r.distance is None
        else:
            m, c = own[source[r.doc_id]]
            d2 = (np.linalg.solve(np.linalg.cholesky(c), x[r.doc_id] / quality.SCALE - m) ** 2).sum()
            assert r.distance == pytest.approx(d2, rel=1e-5, abs=1e-5) and r.kept == (d2 <= quality.CHI2_CUT)


def test_fingerprints_and_components(spark, odd, empty, sf):
    import xxhash

    def slow(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for docs in (odd, read(spark, sf, "documents")):
        text = collections.defaultdict(set)
        for r in docs.collect():
            text[r.doc_id].add(slow(r.text))
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == docs.count() and all(int(r.fingerprint, 16) in text[r.doc_id] for r in got)
        fps = sorted({(int(r.fingerprint, 16), r.component_id) for r in got if r.doc_id is not None})
        for a, ca in fps:
            for b, cb in fps:
                assert (a ^ b).bit_count() > 4 or ca == cb
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_of_every_grid(spark, blocks):
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:150]:
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)], "node long, fp long")
    got = [(r.a, r.b) for r in simhash.links(df, blocks=blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_odd_graphs(spark):
    edges = [(k, k + 1) for k in range(60, 0, -1)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 62)) and all(got[k] == 100 for k in range(100, 140)) and got[301] == 300 and 200 not in got


def test_near_duplicate_stage(make, odd):
    kept = simhash.stage(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 0 in ids and 1 not in ids and None in ids


def test_mixing(spark, odd, empty, sf):
    docs = read(spark, sf, "documents").unionByName(odd, allowMissingColumns=True)
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    size, largest = collections.Counter(), collections.Counter()
    for r in got:
        size[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        goal = {s: 3 * size[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 0.5 * largest[s]), s  # a source of ten documents can come no nearer
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.copies) for r in rows)
    assert key(got) == key(mixing.copies(docs.repartition(7)).collect())
    assert mixing.copies(empty).count() == 0 and mixing.stage(empty).count() == 0
    staged = mixing.stage(docs)
    assert staged.columns == docs.columns and staged.count() == sum(r.copies for r in got)


def test_components_are_exactly_what_links_reach(spark):
    """Over sf0.01: component_id is the smallest doc_id of a union-find over all pairs, and the bound lets few pairs through to the exact test."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = simhash.near_duplicates(docs).collect()
    fp = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
    root = list(range(len(got)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = set()
    for a in range(len(got)):
        for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= 4) + a + 1:
            root[find(a)] = find(b)
            if fp[a] != fp[b]:
                pairs.add((min(int(fp[a]), int(fp[b])), max(int(fp[a]), int(fp[b]))))
    least = {}
    for k, r in enumerate(got):
        least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [least[find(k)] for k in range(len(got))]
    nodes = simhash.fingerprints(docs).groupBy("fp").agg(F.min("doc_id").alias("node"))
    bound = simhash.candidates(nodes).count()
    assert len(pairs) <= bound <= 4 * len(pairs) + 50


def test_inclusion_follows_probability(spark, make):
    """Over seeds, a unit is drawn about as often as its share, the largest documents too; each mix comes near its target."""
    rng = random.Random(2)
    rows = [(k, "w " * int(rng.lognormvariate(3, 1) + 1), "en", "a" if k < 240 else "b", 1, 1, "", "", "") for k in range(300)]
    docs = make(rows).cache()
    seen, large, seeds = collections.Counter(), collections.Counter(), 12
    for seed in range(seeds):
        got = mixing.copies(docs, weights=(1, 3), seed=seed).collect()
        mine = [r for r in got if r.source == "a"]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 0.01 * mine[0].target
        for r in mine:
            seen[r.doc_id] += r.copies
        for r in sorted(mine, key=lambda r: -r.size)[:14]:
            large[r.doc_id] += r.copies
    share = mine[0].target / mine[0].source_size
    assert sum(seen.values()) / (240 * seeds) == pytest.approx(share, abs=0.06)
    assert sum(large.values()) / (14 * seeds) == pytest.approx(share, abs=0.2)


def test_rows_without_ids_are_dealt_like_others(spark):
    """100,000 rows without an id, two thirds of them all alike: no bucket is large, and reruns agree."""
    docs = spark.range(0, 100_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("w "), F.col("id"))).otherwise("same").alias("text"), F.lit("s").alias("source"))
    got = mixing.copies(docs)
    assert got.count() == 100_000 and got.agg(F.sum("copies")).first()[0] == pytest.approx(100_000, abs=2)
    assert mixing.stage(docs).where("text = 'same'").count() == got.where("size = 1").agg(F.sum("copies")).first()[0]


def test_columns_with_internal_names(spark, odd):
    """Extra columns that bear the names used inside come back untouched from every stage of the library."""
    names = ["mcd_m0", "mcd_y0", "mcd_factor", "qr_stats", "qr_vector", "qr_source", "qr_params", "pool", "pools", "cell", "n", "m0", "u1", "u2", "num", "key", "copies", "mix_copies",
             "mix_copies_id", "mix_copies_rows", "mix_one", "mix_rows", "component_id", "sh_hash", "count", "k0", "k1", "row", "bits", "rejected", "lang_pred", "jg_salt", "a.b"]
    docs = odd.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    long = docs.withColumn("text", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n"))) for k in range(60)]))
    for stage in (quality.stage, langid.stage, simhash.stage, mixing.stage):
        for df in (docs, long):
            got = stage(df)
            assert got.columns == docs.columns
            for r in got.collect():
                assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
        assert stage(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    size = [rng.randint(0, 900) for _ in range(500)]
    p = mixing.flight([0.3] * 500, size, [rng.random() for _ in size])
    assert sum(1 for x in p if 0 < x < 1) <= 2
    assert sum(p) == pytest.approx(150) and sum(a * b for a, b in zip(p, size)) == pytest.approx(0.3 * sum(size))


def greedy(sizes, capacity):
    n, run = 1, 0
    for x in sizes:
        if x > capacity:
            return 10**9
        if run + x > capacity:
            n, run = n + 1, 0
        run += x
    return n


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts(spark, seed):
    rng = random.Random(seed)
    n = [0, 3, 40, 4000][seed]
    rows = [(rng.choice([rng.getrandbits(64) - (1 << 63), rng.randrange(50)]), rng.choice([1, 5, 300, 10_000 if seed < 3 else 40])) for _ in range(n)]
    if seed == 3:
        rows += [(7, 50)] * 3000
    group = collections.Counter()
    for k, s in rows:
        group[k] += s
    order = sorted(group)
    sizes = [group[k] for k in order]
    lo, hi = 0, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(sizes, mid) <= 5 else (mid + 1, hi)
    at, capacity = sharding.cuts(spark.createDataFrame(rows, "key long, size long"), 5)
    assert capacity == lo and len(at) == 4
    parts = collections.Counter()
    for k in order:
        parts[sum(k >= c for c in at)] += group[k]
    assert max(parts.values(), default=0) == lo


def test_shards(odd, empty):
    got = sharding.shard(odd).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count() and sharding.shard(empty).count() == 0
    by = collections.defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        by[r["shard"]].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    home = collections.defaultdict(set)
    for r in got:
        home[text[r.doc_id]].add(r["shard"])
    assert all(len(x) == 1 for x in home.values())


def test_shards_are_even_beside_a_large_group(spark, make):
    """Half of all bytes are one text: no shard is empty, the others hold equal shares, and the capacity is that text's."""
    texts = [f"{k:06d} " + "x" * 43 for k in range(4000)] + ["the same " + "x" * 91] * 2000
    got = sharding.shard(make(rows_of(texts))).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    bytes_ = sorted(r["bytes"] for r in got)
    rest = bytes_[:-1]
    assert len(bytes_) == 8 and bytes_[-1] == 2000 * 101 and max(rest) - min(rest) <= 0.01 * 4000 * 51 / 7
    sizes = [random.Random(k).randint(1, 900) for k in range(3000)]
    rows = spark.createDataFrame([(k << 50, n) for k, n in enumerate(sizes)], "key long, size long")
    at, capacity = sharding.cuts(rows, 8)
    shards = np.bincount(np.searchsorted(np.array(at), [k << 50 for k in range(3000)], side="right"), sizes, 8)
    assert shards.max() <= capacity and shards.min() >= 0.99 * sum(sizes) / 8


def test_bpe_is_tiktokens(odd, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(odd).collect()}
    for k, t in text.items():
        assert ids[k] == own.encode_ordinary(t)
    for r in bpe.decode(bpe.encode(odd)).collect():
        assert bytes(r.payload).decode() == text[r.doc_id]
    for r in bpe.digests(odd).collect():
        want = own.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.digests(empty).count() == 0
    c, rng = bpe.codec(path, P.PATTERN), random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(["the", " ", "ing", "é", "日", "\n", "'s", "9", "<unk>", "▁", "ab", "\U0001f600"]) for _ in range(rng.randint(0, 30)))
        assert c.encode(t) == own.encode_ordinary(t)


def test_language_id(spark, odd, empty, sf):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odds = langid.identify(odd).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(odds) == odd.count()
    for r in odds:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.stage(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_foreign_mixed_and_random_texts_are_rejected(spark):
    """By models that have not seen French; own-language texts of the same lengths stay."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    model = langid.train(docs.where("lang <> 'fr'"))
    tokens = {x: " ".join(r.text for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(40).collect()).split() for x in ("en", "fr")}
    rng = random.Random(5)

    def part(lang, n):
        at = rng.randrange(len(tokens[lang]) - n)
        return tokens[lang][at : at + n]

    def rejected(make, n):
        return model.predict(pa.array([" ".join(make(n)) for _ in range(40)]))[3].mean()

    for n in (50, 60, 100, 200):
        assert rejected(lambda n: part("en", n), n) == 0
        assert rejected(lambda n: part("fr", n), n) > 0.9
        assert rejected(lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)], n) == 1
        assert rejected(lambda n: part("en", n // 2) + part("fr", n // 2), n) > (0.5 if n < 100 else 0.9)


def test_a_model_of_any_size_is_whole(spark, make, odd, sf):
    """A model too large to gather gives the verdicts of a gathered one, a rare language among them."""
    rare = make([(5000 + k, "q\u014dx z\u014dq " * 30 + f"x{k}", "rare", "a", 1, 1, "s", "f", "b") for k in range(6)])
    docs = odd.union(rare).select("doc_id", "text", "lang").union(read(spark, sf, "documents").select("doc_id", "text", "lang"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.lang_pred, r.bits)
    one, two = (sorted(langid.identify(docs, most=most).collect(), key=key) for most in (10**9, 100))
    assert len(one) == len(two) == docs.count()
    for a, b in zip(one, two):
        assert (a.doc_id, a.lang_pred, a.rejected, a.held_out) == (b.doc_id, b.lang_pred, b.rejected, b.held_out)
        assert (a.score, a.bits) == pytest.approx((b.score, b.bits), abs=1e-6)
    assert {r.lang_pred for r in two if 5000 <= (r.doc_id or 0) < 5006} == {"rare"}


def test_kneser_ney_sums_to_one(spark):
    """Over the alphabet and the unseen symbol, each context's probabilities sum to one."""
    docs = spark.createDataFrame([("abab abba baab", "x"), ("abc cab", "x")], "text string, lang string")
    m = langid.train(docs, order=3)
    kn = m.langs[0]
    alphabet = "abc" + langid.STOP
    for ctx in ("ab", "\x02\x02", "zz", "ba"):
        codes = langid._codes([ctx + c for c in alphabet + "?"])
        assert np.exp2(kn.symbols(codes)).sum() == pytest.approx(1.0, abs=1e-9)


def _kneser_ney(words, order, alphabet):
    """log2 p(c | context) from the definition, by recursion over plain dictionaries."""
    levels = [collections.Counter()]
    for w, n in words.items():
        w = langid.START * (order - 1) + w + langid.STOP
        for k in range(len(w) - order + 1):
            levels[0][w[k : k + order]] += n
    while len(levels) < order:
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    levels.reverse()

    def p(context, c):
        counts = levels[len(context)]
        ones, twos = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        seen = {g: n for g, n in counts.items() if g[:-1] == context}
        below = p(context[1:], c) if context else 1 / (alphabet + 1)
        if not seen:
            return below
        total = sum(seen.values())
        return max(seen.get(context + c, 0) - d, 0) / total + d * len(seen) / total * below

    return lambda context, c: np.log2(p(context, c))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_its_definition(spark, order):
    rng = random.Random(order)
    texts = {lang: [" ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(40)) for _ in range(20)] for lang, letters in (("x", "abc"), ("y", "bcde"))}
    rows = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts], "text string, lang string")
    held = {r.text for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(langid.HELD)) == 0).collect()}
    counts = {lang: collections.Counter(w for t in ts if t not in held for w in t.split()) for lang, ts in texts.items()}
    model = langid.train(rows, order)
    alphabet = len({c for w in counts.values() for x in w for c in x} | {langid.STOP})
    assert model.names == ["x", "y"] and held
    want = [_kneser_ney(counts[lang], order, alphabet) for lang in model.names]
    grams = ["".join(rng.choices("abcdef" + langid.STOP, k=order)) for _ in range(200)] + [langid.START * (order - 1) + c for c in "abf"]
    got = model.symbols(langid._codes(grams))
    for g, row in zip(grams, got):
        assert row == pytest.approx([w(g[:-1], g[-1]) for w in want], abs=1e-9)


def test_scripts_never_seen_and_gibberish_are_rejected(spark):
    """With blanks and without, short and long; texts of the languages learned stay, but for one in a hundred."""
    docs = read(spark, "/root/testdata/sf0.1", "documents").where("text is not null")
    model = langid.train(docs.where(langid.crc_fold() != 1))
    strange = ["\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", "\u0e1b\u0e23\u0e30\u0e40\u0e17\u0e28\u0e44\u0e17\u0e22", "\u4e2d\u534e\u4eba\u6c11\u5171\u548c\u56fd", "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "qzxvjkwq", "xxxx", "wq zx kv"]
    texts = [sep.join([t] * n) for t in strange for n in (2, 20, 80) for sep in ("", " ")]
    assert model.predict(pa.array(texts))[3].all()
    held = docs.where(langid.crc_fold() == 1).select("text").toArrow()["text"].combine_chunks()
    assert model.predict(held.cast(pa.string()))[3].mean() < 0.01


def test_media(odd, empty):
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    got = media.document_media(odd).collect()
    assert len(got) == odd.count() and media.document_media(empty).count() == 0
    same = {}
    for r in got:
        raw = text[r.doc_id]
        assert (r.position, r.caption, r.before, r.after) == (1, f"document {r.doc_id}", f"Document {r.doc_id}", f"{len(raw)} bytes")
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        png = media.to_png(p)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest()) and media.from_png(png).tobytes() == p


def test_damaged_media_is_an_error(spark, make):
    stored = media.store(make(rows_of(["one text", "one text", "another"])))
    other = media.to_png(media.pad(b"not what the digest says"))
    assert media.read_back(stored).count() == 2
    with pytest.raises(Exception, match="reads back as"):
        media.read_back(stored.withColumn("media", F.when(F.col("doc_id") == 1, F.lit(other)).otherwise(F.col("media")))).collect()


def test_interleaved_items(spark):
    html = '<body><p>One <b>two</b><figure><img src="sha256:%s" alt="x"><figcaption>A &amp; b</figcaption></figure>three<img src="u.png" alt="alt">four<script>no</script></body>' % ("a" * 64)
    got = media.items(html)
    assert [(x["position"], x["kind"], x["text"], x["caption"]) for x in got] == [(0, "text", "One two", None), (1, "image", None, "A & b"), (2, "text", "three", None), (3, "image", None, "alt"), (4, "text", "four", None)]
    seqs = media.sequences(spark.createDataFrame([(1, html), (2, None), (3, html)], "doc_id long, html string"))
    flat = media.resolve(seqs, spark.createDataFrame([("a" * 64, 7)], "digest string, payload_bytes long"))
    back = {r.doc_id: r["items"] for r in media.gather(flat).collect()}
    assert [(x.position, x.payload_bytes) for x in back[1]] == [(0, None), (1, 7), (2, None), (3, None), (4, None)] and back[1] == back[3] and 2 not in back
    assert ODD
