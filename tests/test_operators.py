"""Operators against small cases and plain Python models."""

import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import frames, keyspace
from tidelog.operators import consume, groups, machine, metadata, ops, placement, produce, retention, ring
from tidelog.sources import segments as framed
from tidelog.streaming import live

records = st.builds(frames.Record, st.integers(0, 2**40), st.integers(0, 2**40), st.none() | st.binary(max_size=16), st.binary(max_size=64), st.lists(st.tuples(st.binary(max_size=8), st.binary(max_size=8)), max_size=3).map(tuple))


@settings(max_examples=100, deadline=None)
@given(st.lists(records, max_size=6), st.integers(0, 200), st.integers(0, 255))
def test_frames_round_trip_and_damage(rows, at, byte):
    data = b"".join(map(frames.pack, rows))
    assert [r for r, *_ in frames.scan(data)] == rows
    torn = list(frames.scan(data[: max(0, len(data) - 1)]))
    assert [r for r, *_ in torn] == rows[: max(0, len(rows) - 1)]
    if at < len(data) and data[at] != byte:
        bad = data[:at] + bytes([byte]) + data[at + 1 :]
        got = list(frames.scan(bad))
        assert [r for r, *_ in got] == rows[: len(got)] and len(got) < len(rows)


def test_frames_in_the_jvm_equal_pythons(spark):
    rows = [(0, 5, None, b"v", [(b"h", b"1")]), (1, 6, b"", b"", []), (2**40, 2**41, b"\xff\x00", b"x" * 300, [(b"a", b""), (b"a", b"b")])]
    df = spark.createDataFrame(rows, "offset long, timestamp long, key binary, value binary, headers array<struct<key: binary, value: binary>>")
    f = frames.frame(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("value"), F.col("headers"))
    for r in df.select("*", f.alias("f"), frames.frame_bytes(F.col("key"), F.col("value"), F.col("headers")).alias("n")).collect():
        want = frames.pack(frames.Record(r.offset, r.timestamp, None if r.key is None else bytes(r.key), bytes(r.value), tuple((bytes(h.key), bytes(h.value)) for h in r.headers)))
        assert bytes(r.f) == want and r.n == len(want)


def test_framed_source(spark, tmp_path):
    log = spark.createDataFrame([(k, 100 + k, None if k % 3 == 0 else f"k{k}", f"v{k}") for k in range(50)], "offset long, timestamp long, key string, value string").coalesce(1)
    made = framed.write_framed(log, f"file://{tmp_path}", 20).collect()
    assert sum(r.records for r in made) == 50
    framed.register(spark)
    got = spark.read.format("framed").option("path", f"file://{tmp_path}").load()
    assert sorted((r.offset, r.key) for r in got.collect()) == [(k, None if k % 3 == 0 else f"k{k}".encode()) for k in range(50)]
    assert [r.offset for r in got.where("offset = 7").collect()] == [7]
    first = sorted(tmp_path.glob("*.log"))[0]
    first.write_bytes(first.read_bytes()[:-3])
    assert got.count() == 49
    scan = framed.scan_files(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.log")).collect()
    assert sum(r.records for r in scan) == 49 and any(r.valid_bytes < r.total_bytes for r in scan)


def test_framed_folder_recovers_seals_and_forgets(spark, tmp_path):
    """Files outside the manifest are not read; a torn tail is cut off once; headers come back; a sealed folder refuses."""
    folder = f"file://{tmp_path}/f"
    head = F.array(F.struct(F.lit("h").alias("key"), F.col("offset").cast("string").alias("value"))).alias("headers")
    log = spark.range(60).select(F.col("id").alias("offset"), (F.col("id") + 5).alias("timestamp"), F.lit("k").alias("key"), F.repeat(F.lit("v"), F.when(F.col("id") == 3, 9_000_000).otherwise(5)).alias("value"), head).coalesce(1)
    framed.write_framed(log.where("offset < 30"), folder, 10)
    framed.write_framed(log.where("offset >= 30"), folder, 10)
    framed.register(spark)
    load = lambda: spark.read.format("framed").option("path", folder).load()
    (tmp_path / "f" / "00000000000000000000-lost.log").write_bytes(frames.pack(frames.Record(0, 0, b"k", b"left by a lost task")))
    got = load().collect()
    assert sorted(r.offset for r in got) == list(range(60)) and all(r.headers[0].value == str(r.offset).encode() for r in got)
    assert max(len(r.value) for r in got) == 9_000_000
    torn = next(p for p in tmp_path.glob("f/*-*.log") if p.name.startswith("0" * 18 + "50"))
    torn.write_bytes(torn.read_bytes()[:-3])
    assert framed.recover(spark, folder).agg(F.max("lost")).first()[0] > 0 and framed.recover(spark, folder).agg(F.max("lost")).first()[0] == 0
    assert sorted(r.offset for r in load().collect()) == list(range(59))
    old = framed.manifest(spark, folder).where("file < '00000000000000000030'")
    names = [r.file for r in old.collect()]
    framed.delete(spark, folder, old)
    assert sorted(r.offset for r in load().collect()) == list(range(30, 59)) and not any((tmp_path / "f" / n).exists() for n in names)
    framed.seal(folder)
    with pytest.raises(framed.Sealed):
        framed.write_framed(log, folder)


def test_keyspace(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "k string").select(keyspace.position(F.col("k"), 1 << 32).alias("p"))
    assert len({r.p for r in df.collect()}) == 3
    blocks = spark.createDataFrame([(0, 4, 4, 8), (4, 8, 0, 4), (4, 8, 8, 12), (0, 4, 8, 12), (0, 4, 4, 6)], "a long, b long, c long, d long")
    assert [r[0] for r in blocks.select(keyspace.buddies(*map(F.col, "abcd"))).collect()] == [True, True, False, False, False]
    t = {r.vnode: r.token for r in keyspace.even_tokens(spark, 3, 16).collect()}
    assert t == {"v0": 0, "v1": 5, "v2": 10}


def test_routing_of_uneven_blocks(spark):
    ranges = spark.createDataFrame([("t", 1, 0, 128), ("t", 2, 128, 192), ("t", 3, 192, 200)], "topic string, seq long, key_start long, key_end long")
    recs = spark.createDataFrame([(k, "t", k) for k in range(256)] + [(999, "other", 3)], "id long, topic string, pos long")
    got = {r.id: r.range_seq for r in produce.route(recs, ranges).collect()}
    assert got == {k: 1 if k < 128 else 2 if k < 192 else 3 for k in range(200)}
    assert {r.id for r in produce.unroutable(recs, ranges, "id").collect()} == {*range(200, 256), 999}
    assert produce.route(recs, ranges.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [3, 1 << 20])
def test_offsets_are_contiguous_and_continue(spark, bucket):
    rng = random.Random(2)
    recs = [(k * 2, "t", rng.randrange(3)) for k in range(200)]
    df = spark.createDataFrame(recs, "seq long, topic string, range_seq long")
    base = spark.createDataFrame([("t", 1, 70)], "topic string, range_seq long, next_offset long")
    got = {r.seq: r.offset for r in produce.assign_offsets(df, "seq", base, bucket).collect()}
    at = {0: 0, 1: 70, 2: 0}
    for seq, _, r in recs:
        assert got[seq] == at[r]
        at[r] += 1


def test_segment_roll_overshoots_by_a_batch(spark):
    df = spark.createDataFrame([("t", 0, b, 10) for b in (0, 0, 0, 1, 2, 3)], "topic string, range_seq long, batch long, frame_bytes long")
    got = {r.batch: r.seg_seq for r in produce.segment_roll(df, 20).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_sparse_index_and_folds_over_batches(spark):
    """Keys that span several Arrow batches keep their state."""
    n = 25_000
    log = spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("range_seq"), (F.col("id") % 2).alias("seg_seq"), F.expr("id div 2").alias("offset"), F.lit(100).cast("long").alias("frame_bytes"))
    got = metadata.sparse_index(log, 250).collect()
    assert len(got) == 2 * -(-n // 6) and all(r.position == r.offset * 100 and r.offset % 3 == 0 for r in got)
    one = spark.range(n).select(F.lit("i").alias("identifier"), F.lit("a").alias("action"), F.col("id").alias("seq"), F.col("id").alias("ts"))
    assert ops.token_bucket(one, 5, 10**9).where("allowed").count() == 5


def test_topic_names(spark):
    names = ["a", "A.b_c-9", "", ".", "..", "...", "a b", "a\n", "é", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(produce.valid_topic(F.col("n")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, False, False, False, True, False, False, False, False]


def test_group_resume_and_rewind(spark):
    m, answers = machine.fold([("create_topic", "t", 2), ("split_range", ("t", 0))])
    assert answers == [("ok", ("t", 0)), ("ok", (("t", 1), ("t", 2)))]
    ranges = m.tables(spark)["ranges"]
    log = spark.createDataFrame([("t", 0, k, k % 4) for k in range(20)] + [("t", 1, k, k % 2) for k in range(5)] + [("t", 2, k, 2 + k % 2) for k in range(5)], "topic string, range_seq long, offset long, pos long")
    none = spark.createDataFrame([], "group string, topic string, range_seq long, source_index long, source_offset long, commit_seq long")
    seen, positions = [], none
    for _ in range(20):
        page = consume.fetch_group(log, ranges, positions, "g", 4)
        rows = page.collect()
        if not rows:
            break
        assert max((sum(r.reader == s for r in rows) for s in (1, 2))) <= 4
        seen += [(r.reader, r.source_index, r.offset) for r in rows]
        nxt = consume.next_positions(page).select(F.lit("g").alias("group"), "*", F.lit(len(seen)).cast("long").alias("commit_seq"))
        positions = spark.createDataFrame(positions.unionByName(nxt).collect(), none.schema)
    assert len(seen) == len(set(seen)) == 30
    for s in (1, 2):
        own = [x[1:] for x in seen if x[0] == s]
        assert own == sorted(own)
    back = spark.createDataFrame([("g", "t", 1, 0, 0, 999)], none.schema)
    assert consume.fetch_group(log, ranges, positions.unionByName(back), "g", 100).count() == 15  # a stale cursor rewinds


def test_cursors(spark):
    df = spark.createDataFrame([([("t", 1, 0, 5), ("a", 2, 1, 7)],)], f"p {consume.CURSOR}").select(consume.encode_cursor(F.col("p")).alias("t"))
    back = df.select(consume.decode_cursor(F.col("t")).alias("p")).first().p
    assert [tuple(x) for x in back] == [("a", 2, 1, 7), ("t", 1, 0, 5)]
    bad = spark.createDataFrame([("not-base64!!",), ("Z2FyYmFnZQ==",), ("W10=",), ("",), (None,), ("abc",)], "t string").select(consume.decode_cursor(F.col("t")).alias("p"))
    assert all(r.p is None for r in bad.collect())
    assert consume.bounds(None, None, None) == (100, 0, 100) and consume.bounds(0, 99_999, 10**6) == (1, 30_000, 10_000)


def test_machine_errors():
    m = machine.Metadata()
    do = m.apply
    assert do("nope") == ("error", "unknown_command")
    assert do("create_topic", "a b", 4) == ("error", "invalid_topic_name") and do("create_topic", "t", 33) == ("error", "invalid_keyspace_bits")
    assert do("create_topic", "t", 2)[0] == "ok" and do("create_topic", "t", 2) == ("error", "already_exists")
    assert do("split_range", ("t", 9)) == ("error", "no_such_range")
    assert do("split_range", ("t", 0))[0] == "ok" and do("split_range", ("t", 0)) == ("error", "sealed")
    assert do("split_range", ("t", 1))[0] == "ok" and do("split_range", ("t", 3)) == ("error", "cannot_split")
    assert do("merge_ranges", ("t", 2), ("t", 3)) == ("error", "not_buddies") and do("merge_ranges", ("t", 2), ("u", 3)) == ("error", "different_topic")
    assert do("merge_ranges", ("t", 3), ("t", 4)) == ("ok", ("t", 5)) and m.ranges["t", 5].parents == (0, 1, 3, 4)
    assert do("register_segment", "s", ("t", 5), ["a"], 0) == ("ok", "s") and do("register_segment", "s", ("t", 5), ["a"], 0) == ("error", "segment_exists")
    assert do("delete_segment", "s") == ("error", "segment_active") and do("seal_segment", "s", 3, 30, 9)[0] == "ok"
    assert do("commit_offset", "g", "t", {2: (0, 5), 0: (0, 1)})[0] == "ok" and m.offsets["g", "t"] == {2: (0, 5)}
    assert do("define_policy", "p", {"x": 1}) == ("error", "invalid_policy") and do("set_topic_policy", "t", "p") == ("error", "no_such_policy")
    assert do("define_policy", "p", {"max_bytes": None})[0] == "ok" and do("set_topic_policy", "t", "p")[0] == "ok"
    assert do("begin_migration", "t")[0] == "ok" and do("seal_topic", "t") == ("error", "migrating") and do("delete_segment", "s") == ("error", "migrating")
    bundle = do("extract_topic", "t")[1]
    assert "t" not in m.topics and not m.ranges and do("insert_topic", bundle)[0] == "ok" and do("insert_topic", bundle)[0] == "ok" and len(m.ranges) == 6
    assert do("delete_segment", "s")[0] == "ok" and do("seal_topic", "t")[0] == "ok" and not any(r.state == "active" for r in m.ranges.values())
    assert do("delete_topic", "t")[0] == "ok" and not m.offsets


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["create_topic", "split_range", "merge_ranges", "seal_topic", "delete_topic"]), st.sampled_from("ab"), st.integers(0, 9), st.integers(0, 9)), max_size=40))
def test_machine_keeps_ranges_tiled(steps):
    m = machine.Metadata()
    for op, t, a, b in steps:
        args = {"create_topic": (t, 4), "split_range": ((t, a),), "merge_ranges": ((t, a), (t, b)), "seal_topic": (t,), "delete_topic": (t,)}[op]
        m.apply(op, *args)
        for t_ in m.topics.values():
            r = sorted((r.key_start, r.key_end) for r in m.ranges.values() if r.topic == t_.name and r.state == "active")
            if t_.state == "active":
                assert r[0][0] == 0 and r[-1][1] == 16 and all(x[1] == y[0] for x, y in zip(r, r[1:]))


def test_placement_properties(spark):
    items = spark.createDataFrame([(f"s{k}",) for k in range(60)], "segment string")
    mk = lambda n: spark.createDataFrame([(f"b{k}", f"r{k % 3}" if k != 4 else None) for k in range(n)], "broker string, rack string")
    a = {r.segment: r.replicas for r in placement.place(items, mk(8), 3).collect()}
    b = {r.segment: r.replicas for r in placement.place(items, mk(9), 3).collect()}
    assert all(len(set(x)) == 3 for x in a.values())
    assert all(set(b[s]) - set(a[s]) <= {"b8"} for s in a)
    brokers = [f"b{k}" for k in range(8)]
    rack = {r.broker: r.rack for r in mk(8).collect()}
    import hashlib

    for r in placement.spread(items, mk(8), 4, "rack").collect():
        order = sorted(brokers, key=lambda x: (hashlib.md5(f"{r.segment}|{x}".encode()).hexdigest(), x), reverse=True)
        lists = {}
        for x in order:
            lists.setdefault(rack[x], []).append(x)
        want = []
        while any(lists.values()):
            want += [v.pop(0) for v in list(lists.values()) if v]
        assert r.replicas == want[:4]
    got = dict(placement.place_balanced([f"v{k}" for k in range(30)], brokers, 3))
    load = [sum(x in v for v in got.values()) for x in brokers]
    assert max(load) <= -(-90 // 8) and all(len(set(v)) == 3 for v in got.values())
    seg = spark.createDataFrame([("t", "dup", "active", ["a", "a"]), ("t", "ok", "active", ["a", "b"]), ("t", "lost", "sealed", ["x", "y"])], "topic string, segment string, state string, replica_set array<string>")
    live_ = ["a", "b", "c"]
    assert {r.segment for r in placement.under_replicated(seg, live_, 2).collect()} == {"dup", "lost"}
    abc = spark.createDataFrame([(x,) for x in live_], "broker string")
    assert {r.status for r in placement.heal_sealed(seg, abc, live_, 2).collect()} == {"no_live_source"}
    assert placement.failover(seg, ["b"]).collect()[0].replicas == ["b", "a"]


def test_quorum_commit(spark):
    seg = spark.createDataFrame([("s", ["a", "b", "c"]), ("n", ["a", "b"])], "segment string, replica_set array<string>")
    acks = spark.createDataFrame([("s", "a", 9), ("s", "b", 4), ("s", "b", 7), ("s", "x", 99), ("n", "a", 3)], "segment string, broker string, offset long")
    assert {r.segment: r.commit_offset for r in placement.quorum_commit(seg, acks).collect()} == {"s": 7, "n": None}


def test_ring(spark):
    r = spark.createDataFrame([("a", 4), ("b", 8), ("c", 12)], "vnode string, token long")
    own = {x.h: x.v for x in spark.range(16).select(F.col("id").alias("h"), ring.owner(F.col("id"), ring.vnodes_of(r)).alias("v")).collect()}
    assert own == {h: "a" if h <= 4 or h > 12 else "b" if h <= 8 else "c" for h in range(16)}
    assert {x.vnode: (x.start, x.stop, x.length) for x in ring.arcs(r, 16).collect()} == {"a": (12, 4, 8), "b": (4, 8, 4), "c": (8, 12, 4)}
    # the arc of a, (12, 4], is halved at 0; of the four arcs of 4 that are left, the last by name follows
    assert ring.reshard_plan([("a", 4), ("b", 8), ("c", 12)], 5, 16) == ("ok", [("vnode_0", 0, "a"), ("vnode_14", 14, "vnode_0")])
    status, steps = ring.reshard_plan([("a", 4), ("b", 12)], 6, 16)
    assert status == "ok" and len(steps) == 4 and len({t for _, t, _ in steps} | {4, 12}) == 6
    assert ring.reshard_plan([], 3) == ("error", "empty_ring") and ring.reshard_plan([("a", 1), ("b", 2)], 1) == ("error", "cannot_shrink") and ring.reshard_plan([("a", 0)], 9, 4)[0] == "error"


def test_retention_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [("t", r, k, k, rng.randrange(100), rng.randrange(1000)) for r in range(20) for k in range(rng.randrange(12))]
    seg = spark.createDataFrame(rows, "topic string, range_seq long, seg_seq long, start_offset long, byte_size long, sealed_at long").withColumn("state", F.lit("sealed"))
    eff = spark.createDataFrame([("t", 500, 150)], "name string, max_age_ms long, max_bytes long")
    want = set()
    for r in range(20):
        own = [x for x in rows if x[1] == r]
        total = sum(x[4] for x in own)
        for x in own:
            if total > 150:
                want.add((r, x[2]))
                total -= x[4]
    assert {(r.range_seq, r.seg_seq) for r in retention.by_size(seg, eff).collect()} == want
    aged = {(x[1], x[2]) for x in rows if 1000 - x[5] > 500}
    assert {(r.range_seq, r.seg_seq) for r in retention.expired(seg, eff, 1000).collect()} == want | aged


def test_members(spark):
    hb = spark.createDataFrame([("g", "t", "a", 0), ("g", "t", "b", 50), ("g", "t", "a", 10)], "group string, topic string, member string, hb_ms long")
    assert [r.member for r in groups.live_members(hb, 120, 100).collect()] == ["b"]
    v = spark.createDataFrame([("m", "alive", 1), ("m", "dead", 1), ("m", "suspect", 1), ("n", "dead", 1), ("n", "alive", 2)], "member string, status string, incarnation long")
    assert {r.member: r.status for r in groups.merge_views(v).collect()} == {"m": "dead", "n": "alive"}


def test_lockout_escalation(spark):
    a = spark.createDataFrame([("u", "i", k * 10, k, False) for k in range(50)] + [("w", "i", k, k, k == 3) for k in range(8)], "username string, ip string, ts long, seq long, ok boolean")
    got = {r.fails: r.duration_ms for r in ops.lockouts(a, 5, 100).where("username = 'u'").collect()}
    assert [got[n] for n in (5, 9, 10, 15, 20, 25, 50)] == [100, 100, 300, 900, 2400, 7200, 7200]
    assert {(r.username, r.fails) for r in ops.failed_attempts(a).collect()} == {("u", 50), ("w", 4)}
    assert [r.remaining_ms for r in ops.locked(a, 5, 100, 490 + 7199).collect()] == [1] and ops.locked(a, 5, 100, 490 + 7200).count() == 0


def test_token_bucket_and_stream(spark, tmp_path):
    rows = [("i", "a", k, t) for k, t in enumerate([0, 1, 2, 3, 4, 5, 150, 160, 1000])]
    df = spark.createDataFrame(rows, "identifier string, action string, seq long, ts long")
    want = [(r.seq, r.allowed, r.retry_after_ms) for r in ops.token_bucket(df, 5, 100).orderBy("seq").collect()]
    assert [w[1] for w in want] == [True] * 5 + [False] + [True] * 3 and 0 < want[5][2] <= 100
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = live.limited_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 5, 100)
    q = s.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    for _ in range(120):  # state that can time out keeps the query running
        if spark.table("buckets").count() == len(want):
            break
        time.sleep(0.5)
    q.stop()
    assert [(r.seq, r.allowed, r.retry_after_ms) for r in spark.table("buckets").orderBy("seq").collect()] == want


def test_produce_and_deliver_streams(spark, tmp_path):
    recs = spark.createDataFrame([(k, "t", f"k{k}", f"v{k}", k % 16) for k in range(40)], "seq long, topic string, key string, value string, pos long")
    active = spark.createDataFrame([("t", 1, 0, 8), ("t", 2, 8, 16)], "topic string, seq long, key_start long, key_end long")
    for part in (recs.where("seq < 25"), recs.where("seq >= 25")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = live.produce_stream(spark.readStream.schema(recs.schema).parquet(f"{tmp_path}/in"), active, f"{tmp_path}/log", f"{tmp_path}/cp", "seq")
        q.awaitTermination(120)
    log = spark.read.parquet(f"{tmp_path}/log")
    for r in (1, 2):
        assert sorted(x.offset for x in log.where(f"range_seq = {r}").collect()) == list(range(log.where(f"range_seq = {r}").count()))
    seen = []
    q = live.deliver(spark, f"{tmp_path}/log", log.schema, f"{tmp_path}/cp2", lambda df, _: seen.append(df.count()), 1)
    q.awaitTermination(120)
    assert sum(seen) == 40 and len(seen) > 1
    assert live.credit_window([("produce", 5), ("ack", 2), ("ack", 0), ("ack", 2)], 2, 10) == [2, 2, 0, 1]


def test_lease(spark):
    c = spark.createDataFrame([("l", 0, "acquire", "a", 0, 10, 0), ("l", 1, "acquire", "b", 0, 10, 9), ("l", 2, "acquire", "b", 0, 10, 10), ("l", 3, "release", "a", 1, 0, 11), ("l", 4, "release", "b", 2, 0, 12), ("l", 5, "acquire", "a", 0, 10, 12)],
                              "lease string, seq long, op string, candidate string, fence long, duration_ms long, now long")
    assert [r.answer for r in ops.lease_fold(c).orderBy("seq").collect()] == ["ok 1", "held a", "ok 2", "ok", "ok", "ok 3"]


def test_exposition_escapes(spark):
    t = spark.createDataFrame([('a"b\\c\n', 3)], "topic string, n long")
    lines = [r.line for r in ops.exposition(t, [("m", "gauge", "Help", "n")]).orderBy("ord").collect()]
    assert lines == ["# HELP m Help\n# TYPE m gauge", 'm{topic="a\\"b\\\\c\\n"} 3']


def test_percentiles_are_samples(spark):
    rng = random.Random(6)
    xs = [rng.randrange(50) for _ in range(101)]
    df = spark.createDataFrame([("o", x) for x in xs], "op string, ms long")
    r = ops.percentiles(df, "op", "ms").first()
    xs.sort()
    assert (r.p50, r.p95, r.p99) == tuple(xs[-(-p * len(xs) // 100) - 1] for p in (50, 95, 99))


def test_metadata_queries(spark):
    m, _ = machine.fold([("create_topic", "t", 4), ("split_range", ("t", 0)), ("register_segment", "x", ("t", 1), ["a"], 0), ("seal_segment", "x", 100, 4096, 7), ("register_segment", "y", ("t", 1), ["a"], 100), ("commit_offset", "g", "t", {1: (0, 3)})])
    t = m.tables(spark)
    o = metadata.overview(t["topics"], t["ranges"], t["segments"], t["committed"]).first()
    assert (o.range_count, o.active_range_count, o.segment_count, o.active_segment_count, o.total_bytes, o.groups) == (3, 2, 2, 1, 4096, "g")
    assert metadata.tiling(t["ranges"], 16).first().tiled
    d = metadata.detail(t["ranges"], t["segments"].withColumn("seg_seq", F.col("start_offset"))).first()
    assert [r.seq for r in d.ranges] == [0, 1, 2] and [s.start_offset for s in d.ranges[1].segments] == [0, 100]
    assert struct.calcsize(">H") == 2


def test_plans(spark, sf):
    """Filters and columns reach the scan; broadcasts of ranges are equi-joins; no Python in the hot paths."""
    from tidelog.plans import catalog

    plan = lambda n: catalog.QUERIES[n](spark, sf)._jdf.queryExecution().toString()
    p = plan("route_records")
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p and "Python" not in p
    assert "Cartesian" not in plan("range_history") and "NestedLoop" not in plan("range_history")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan("audit_by_type")
    assert "TakeOrdered" in plan("audit_latest")


def test_a_batch_with_an_unroutable_record_is_refused(spark, tmp_path):
    """Nothing of it is appended; with ranges that own it the stream goes on, and no record is lost or written twice."""
    recs = spark.createDataFrame([(k, "t", f"k{k}", f"v{k}", k % 16) for k in range(40)], "seq long, topic string, key string, value string, pos long")
    half = spark.createDataFrame([("t", 1, 0, 8)], "topic string, seq long, key_start long, key_end long")
    full = half.union(spark.createDataFrame([("t", 2, 8, 12), ("t", 3, 12, 16)], half.schema))
    recs.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda active: live.produce_stream(spark.readStream.schema(recs.schema).parquet(f"{tmp_path}/in"), active, f"{tmp_path}/log", f"{tmp_path}/cp", "seq")
    q = run(half)
    with pytest.raises(Exception, match="no range for position"):
        q.awaitTermination(120)
    assert not (tmp_path / "log").exists()
    assert run(full).awaitTermination(120)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(r.seq for r in log.collect()) == list(range(40))
    got = produce.produced(recs.withColumn("batch", F.expr("seq div 8")), full.where("seq <> 3"), "batch")
    assert got.count() == 40 and {r.batch for r in got.where("accepted").collect()} == {0, 2, 4}


def test_placement_moves_nothing(spark):
    """Scoring is done row by row: its plans hold no exchange and no window."""
    items = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("segment"))
    brokers = spark.createDataFrame([(f"b{k}", f"r{k % 3}") for k in range(9)], "broker string, rack string")
    for df in (placement.place(items, brokers, 3), placement.spread(items, brokers, 3, "rack"), placement.ranked(items, brokers)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_as_of_in_blocks_equals_the_scan(spark):
    rng = random.Random(1)
    starts = [("t", r, o, o // 3) for r in (1, 2) for o in sorted(rng.sample(range(3000), 40))]
    wanted = [("t", r, o) for r in (1, 2, 3) for o in range(0, 4000, 7)]
    s = spark.createDataFrame(starts, "topic string, range_seq long, offset long, position long")
    w = spark.createDataFrame(wanted, "topic string, range_seq long, target long")
    want = {(t, r, o, max(x)[0], max(x)[1]) for t, r, o in wanted if (x := [(a, p) for _, rr, a, p in starts if rr == r and a <= o])}
    for block in (1, 100, 1 << 12):
        assert {tuple(x) for x in metadata.as_of(w, "target", s, "offset", block).select("topic", "range_seq", "target", "offset", "position").collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_owner_equals_the_scan(spark, n):
    rng = random.Random(n)
    tokens = sorted(rng.sample(range(1 << 32), n))
    r = [(f"v{t}", t) for t in tokens]
    hashes = [0, (1 << 32) - 1, *tokens, *[t + 1 for t in tokens[:-1]], *rng.sample(range(1 << 32), 200)]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    got = {x.h: x.v for x in df.select("h", ring.owner(F.col("h"), r).alias("v")).collect()}
    for h in hashes:
        assert got[h] == f"v{next((t for t in tokens if t >= h), tokens[0])}"


def test_readers_of_a_stored_log_scan_what_they_ask_for(spark, tmp_path):
    log = spark.range(2000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), (F.col("id") % 4).alias("range_seq"), F.col("id").alias("offset"), (F.col("id") % 256).alias("pos"), F.lit("v").alias("value"))
    stored = produce.store(log, f"file://{tmp_path}/log")
    assert stored.count() == 2000 and stored.dtypes == log.dtypes
    plan = metadata.segment_read(stored, "t1", 1, 100, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "(range_seq" in plan and "GreaterThanOrEqual(offset,100)" in plan
    plan = produce.slice_of(stored, 64, 128).select("offset")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos,64), LessThan(pos,128)" in plan and "value" not in plan


def test_long_poll_and_windows(spark, tmp_path):
    """A poll returns as soon as there is something, and empty-handed when its time is over; sessions and seconds are counted as events come."""
    asked = []

    def fetch():
        asked.append(1)
        return spark.range(2).where(F.lit(len(asked) >= 3))

    assert len(live.long_poll(fetch, 20_000, 10)) == 2 and len(asked) == 3
    began = time.monotonic()
    assert live.long_poll(lambda: spark.range(0), 300, 50) == [] and time.monotonic() - began >= 0.3
    rows = [("g", "t", "m", s) for s in (0, 1, 2, 30, 31)]
    spark.createDataFrame(rows, "group string, topic string, member string, s long").select("group", "topic", "member", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/hb")
    read = lambda: spark.readStream.schema("group string, topic string, member string, at timestamp").parquet(f"{tmp_path}/hb")
    for name, df in (("sessions", live.member_stream(read(), "10 seconds")), ("seconds", live.per_second(read()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.beats for r in spark.table("sessions").collect()) == [2, 3]
    assert sorted(r.events for r in spark.table("seconds").collect()) == [1] * 5
