"""Registered queries over the fixture tables, each with the DuckDB SQL of the same rows where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import frames, keyspace
from tidelog.operators import consume, groups, machine, metadata, ops, placement, produce, retention, ring
from tidelog.plans.fixtures import DEAD, KEYSPACE, SQL, Fixture
from tidelog.sources import segments as framed
from tidelog.storage import new_path
from tidelog.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register fixture -> DataFrame under its name; sql goes on from the fixture's tables."""

    def of(f: Callable[[Fixture], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(Fixture(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = SQL + sql
        return f

    return of


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long, and names that SQL does not reserve."""
    df = df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])
    return df.withColumnsRenamed({"offset": "off", "group": "grp", "key": "k", "value": "v", "timestamp": "ts_ms"})


# records, routing, offsets


@query("select event_id, pos from rec")
def key_position(x):
    return x.records.select("event_id", "pos")


@query("select event_id, frame_bytes from rec")
def frame_size(x):
    return x.records.select("event_id", "frame_bytes")


@query("select doc_id, (39 + octet_length(encode(source)) + octet_length(encode(text)) + 8 + 4 + octet_length(encode(lang)))::bigint frame_bytes from documents")
def frame_size_headers(x):
    headers = F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")))
    return x.table("documents").select("doc_id", frames.frame_bytes(F.col("source"), F.col("text"), headers).alias("frame_bytes"))


@query("select o_orderkey order_id, (('0x' || substr(md5(o_custkey::varchar), 1, 8))::ubigint % 4096)::bigint pos, ((('0x' || substr(md5(o_custkey::varchar), 1, 8))::ubigint % 4096) // 512)::bigint range_seq from orders")
def route_orders(x):
    o = x.table("orders").select(F.col("o_orderkey").alias("order_id"), F.lit("orders").alias("topic"), keyspace.position(F.col("o_custkey").cast("string"), 4096).alias("pos"))
    blocks = x.spark.range(8).select(F.lit("orders").alias("topic"), F.col("id").alias("seq"), (F.col("id") * 512).alias("key_start"), (F.col("id") * 512 + 512).alias("key_end"))
    return produce.route(o, blocks).drop("topic")


@query("select event_id, topic, range_seq from routed")
def route_records(x):
    return produce.route(x.records, x.by_epoch, ("topic", "epoch")).select("event_id", "topic", "range_seq")


@query("select event_id from rec where epoch = 3 and pos >= 128 and topic <> 'click'")
def unroutable(x):
    some = x.by_epoch.where("not (epoch = 3 and seq = 2) or topic = 'click'")
    return produce.unroutable(x.records, some, "event_id", ("topic", "epoch")).select("event_id")


@query(", b as (select topic, batch, count(*) records, count(*) filter (epoch = 3 and pos >= 128 and topic <> 'click') bad from rec group by 1, 2) select topic, batch, records, bad = 0 accepted from b")
def produce_rejected(x):
    """Batches with a record that no range owns are refused whole."""
    some = x.by_epoch.where("not (epoch = 3 and seq = 2) or topic = 'click'")
    got = produce.produced(x.records, some, "batch", ("topic", "epoch"))
    return got.groupBy("topic", "batch").agg(F.count("*").alias("records"), F.bool_and("accepted").alias("accepted"))


@query("select event_id, topic, range_seq, off from log")
def assign_offsets(x):
    return x.log.select("event_id", "topic", "range_seq", "offset")


@query("select event_id, topic, range_seq, off from log")
def assign_offsets_bucketed(x):
    routed = produce.route(x.records, x.by_epoch, ("topic", "epoch"))
    return produce.assign_offsets(routed, "event_id", bucket=64).select("event_id", "topic", "range_seq", "offset")


@query("select batch, topic, range_seq, min(off) as \"first\", max(off) as \"last\" from log group by 1, 2, 3")
def placements(x):
    return produce.placements(x.log)


@query("select topic, range_seq, off, timestamp ts_ms, key k, value v, pos, frame_bytes from log")
def produce_log(x):
    return x.log.select("topic", "range_seq", "offset", "timestamp", "key", "value", "pos", "frame_bytes")


@query("select topic, count(*) records, sum(octet_length(encode(value)))::bigint value_bytes, sum(frame_bytes)::bigint frame_bytes, count(distinct batch) batches from log group by 1")
def produce_stats(x):
    return produce.stats(x.stored)


@query("select event_id, pos from log where pos >= 64 and pos < 128")
def slice_filter(x):
    return produce.slice_of(x.stored, 64, 128).select("event_id", "pos")


@query(""", b as (select topic, range_seq, batch, sum(frame_bytes)::bigint bytes, row_number() over (partition by topic, range_seq order by batch) i from log group by 1, 2, 3),
r(topic, range_seq, batch, bytes, i, seg_seq, size) as (select topic, range_seq, batch, bytes, i, 0::bigint, bytes from b where i = 1
  union all select b.topic, b.range_seq, b.batch, b.bytes, b.i, case when r.size >= 2048 then r.seg_seq + 1 else r.seg_seq end, case when r.size >= 2048 then b.bytes else r.size + b.bytes end
  from r join b on b.topic = r.topic and b.range_seq = r.range_seq and b.i = r.i + 1)
select topic, range_seq, batch, bytes, seg_seq from r""")
def segment_roll(x):
    return produce.segment_roll(x.log, 2048)


@query(""", b as (select topic, range_seq, batch, sum(frame_bytes)::bigint bytes, max(timestamp) t_, row_number() over (partition by topic, range_seq order by batch) i from log group by 1, 2, 3),
r(topic, range_seq, batch, bytes, i, seg_seq, size, since, last_) as (select topic, range_seq, batch, bytes, i, 0::bigint, bytes, t_, t_ from b where i = 1
  union all select topic, range_seq, batch, bytes, i, case when full_ then seg_seq + 1 else seg_seq end, case when full_ then bytes else size + bytes end, case when full_ then t_ else since end, t_
  from (select b.*, r.seg_seq, r.size, r.since, r.size >= 8192 or r.last_ - r.since >= 86400000 full_ from r join b on b.topic = r.topic and b.range_seq = r.range_seq and b.i = r.i + 1))
select topic, range_seq, batch, bytes, seg_seq from r""")
def segment_roll_by_age(x):
    """A day, or eight kilobytes."""
    return produce.segment_roll(x.log, 8192, 86_400_000)


@query("select event_id // 10 batch, event_id seq, (frame_bytes + case when pos % 3 = 0 then 8 + 3 + octet_length(encode(topic)) else 0 end)::bigint frame_bytes, case when pos % 3 = 0 then 'src=' || topic else '' end headers from rec where event_id // 10 not in (select event_id // 10 from rec where pos = 7)")
def build_records_with_headers(x):
    """A header without a value is left out; so are null headers."""
    heads = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("src"), F.col("topic"), F.lit("none"), F.lit(None).cast("string")))
    raw = x.records.select(F.expr("event_id div 10").alias("batch"), F.col("event_id").alias("seq"), F.col("key"), F.when(F.col("pos") != 7, F.col("value")).alias("value"), heads.alias("headers"))
    got = produce.build_records(raw)
    return got.select("batch", "seq", "frame_bytes", F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"])), ",").alias("headers"))


@query("select topic, count(*) filter (event_id % 3 = 0) consumed, coalesce(sum(octet_length(encode(value))) filter (event_id % 3 = 0), 0)::bigint consumed_bytes, count(*) filter (event_id % 5 = 0) denied, count(*) filter (event_id % 7 = 0) replicated from log group by 1")
def traffic_counters(x):
    """Consumed records and bytes, refused requests and replicated records of each topic."""
    e = F.col("event_id")
    return ops.counters(x.log, {"consumed": e % 3 == 0, "denied": e % 5 == 0, "replicated": e % 7 == 0}, {"consumed_bytes": ("consumed", F.octet_length("value"))})


@query("select segment, state = 'active' and (coalesce(byte_size, 0) >= 4000 or t - coalesce(sealed_at, t) >= 3600000) as seal from segments, tmax")
def should_seal(x):
    age = F.lit(x.now) - F.coalesce("sealed_at", F.lit(x.now))
    return x.segments.select("segment", F.coalesce(produce.should_seal(F.coalesce("byte_size", F.lit(0)), age, F.col("state"), 4000, 3_600_000), F.lit(False)).alias("seal"))


@query("select o_orderkey, o_orderpriority as name, regexp_full_match(o_orderpriority, '[A-Za-z0-9._-]+') as valid from orders")
def valid_topics(x):
    return x.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), produce.valid_topic(F.col("o_orderpriority")).alias("valid"))


@query("select event_id // 10 batch, event_id seq, frame_bytes from rec where event_id // 10 not in (select event_id // 10 from rec where pos = 7)")
def build_records(x):
    raw = x.records.select(F.expr("event_id div 10").alias("batch"), F.col("event_id").alias("seq"), F.col("key"), F.when(F.col("pos") != 7, F.col("value")).alias("value"))
    return produce.build_records(raw).select("batch", "seq", "frame_bytes")


# reading


@query("select topic, reader, source_index, range_seq, off, event_id from hist")
def range_history(x):
    active = x.ranges.where("state = 'active'")
    return consume.history(x.stored, active, x.ranges).select("topic", "reader", "source_index", "range_seq", "offset", "event_id")


@query(", e as (select topic, range_seq, min(start_offset) earliest from segments where seg_seq > 0 group by 1, 2) select h.topic, reader, h.source_index, off, event_id from hist h left join e on e.topic = h.topic and e.range_seq = h.range_seq where off >= coalesce(earliest, 0)")
def consume_cross_epoch(x):
    """After retention has dropped the first segment of every range that has more than one."""
    left = metadata.earliest(x.segments.where("seg_seq > 0"))
    active = x.ranges.where("state = 'active'")
    return consume.clamp(consume.history(x.stored, active, x.ranges), left).select("topic", "reader", "source_index", "offset", "event_id")


@query("select topic, reader, source_index, off, event_id from (select *, row_number() over (partition by topic, reader order by source_index, off) i from hist) where i <= 10")
def fetch_page(x):
    return consume.page(consume.history(x.stored, x.ranges.where("state = 'active'"), x.ranges), 10).select("topic", "reader", "source_index", "offset", "event_id")


@query("select topic, reader, source_index, off, event_id from (select *, row_number() over (partition by topic, reader order by source_index, off) i from hist) where i > 10 and i <= 20")
def fetch_resume(x):
    full = consume.history(x.stored, x.ranges.where("state = 'active'"), x.ranges)
    first = consume.page(full, 10)
    return consume.page(consume.after(full, consume.next_positions(first)), 10).select("topic", "reader", "source_index", "offset", "event_id")


@query("""select topic, reader, source_index, off, event_id from (select h.topic, reader, h.source_index, off, event_id, row_number() over (partition by h.topic, reader order by h.source_index, off) i
from hist h left join committed c on c.grp = 'g1' and c.topic = h.topic and c.range_seq = h.reader where c.grp is null or (h.source_index, off) >= (c.source_index, c.source_offset)) where i <= 10""")
def fetch_group(x):
    return consume.fetch_group(x.stored, x.ranges, x.commits, "g1", 10).select("topic", "reader", "source_index", "offset", "event_id")


_ASSIGN = """, a as (select topic, seq range_seq, arg_max(member, struct_pack(s := md5(topic || '/' || seq || '|' || member), m := member)) member from ranges, members where state = 'active' group by 1, 2) """


@query(_ASSIGN + """select topic, reader, source_index, off, event_id from (select h.topic, reader, h.source_index, off, event_id, row_number() over (partition by h.topic, reader order by h.source_index, off) i
from hist h join a on a.topic = h.topic and a.range_seq = h.reader and a.member = 'm1' left join committed c on c.grp = 'g1' and c.topic = h.topic and c.range_seq = h.reader
where c.grp is null or (h.source_index, off) >= (c.source_index, c.source_offset)) where i <= 10""")
def fetch_member(x):
    a = groups.assign(x.ranges, x.members)
    return consume.fetch_member(x.stored, x.ranges, x.commits, a, "g1", "m1", 10).select("topic", "reader", "source_index", "offset", "event_id")


@query("select topic, key k, value v, timestamp ts_ms from log")
def client_view(x):
    return consume.client_view(x.stored)


@query("select grp, topic, range_seq, source_index, source_offset from committed")
def committed_positions(x):
    return consume.committed(x.commits, x.ranges)


@query("select grp, count(*) as \"ranges\", true round_trip from committed group by 1 union all select 'x', -1, false from range(4)")
def cursor_decode(x):
    """Cursors of every group's positions, decoded again, and malformed ones."""
    p = F.struct("topic", "range_seq", "source_index", "source_offset")
    good = consume.committed(x.commits, x.ranges).groupBy("group").agg(consume.encode_cursor(F.collect_list(p)).alias("token"))
    bad = x.spark.createDataFrame([("x", t) for t in ("not-base64!!", "Z2FyYmFnZQ==", "W3sidG9waWMiOjF9XQ==", "")], "group string, token string")
    d = good.unionByName(bad).withColumn("p", consume.decode_cursor(F.col("token")))
    return d.select("group", F.coalesce(F.size("p"), F.lit(-1)).alias("ranges"), (F.col("p").isNotNull() & (consume.encode_cursor(F.col("p")) == F.col("token"))).alias("round_trip"))


# metadata


@query("select topic, seq, key_start, key_end from ranges where state = 'active'")
def active_ranges(x):
    return metadata.active_ranges(x.ranges).select("topic", "seq", "key_start", "key_end")


@query("select topic, seq, state from ranges where topic = 'view' and seq = 3")
def range_lookup(x):
    return x.ranges.where("topic = 'view' and seq = 3").select("topic", "seq", "state")


@query(f"select topic, bool_and(ok) tiled from (select topic, case when row_number() over w = 1 then key_start = 0 else true end and coalesce(lead(key_start) over w, {KEYSPACE}) = key_end ok from ranges where state = 'active' window w as (partition by topic order by key_start)) group by 1")
def keyspace_tiling(x):
    return metadata.tiling(x.ranges, KEYSPACE)


@query("select topic, seq, key_start, key_start + (key_end - key_start) // 2 split_at, key_end from ranges where state = 'active' and key_end - key_start >= 2")
def split_candidates(x):
    return metadata.split_candidates(x.ranges)


@query("select a.topic, a.seq low_seq, b.seq high_seq, a.key_start, b.key_end from ranges a join ranges b on a.topic = b.topic and a.state = 'active' and b.state = 'active' and a.key_end - a.key_start = b.key_end - b.key_start and xor(a.key_start, a.key_end - a.key_start) = b.key_start and a.key_start < b.key_start")
def buddy_pairs(x):
    return metadata.buddy_pairs(x.ranges)


@query("select 'range' kind, (select count(*) from ranges where topic = 'click' and seq <> 4) orphans union all select 'segment', (select count(*) from segments where range_seq = 4)")
def metadata_integrity(x):
    """With a topic and a range taken away."""
    return metadata.integrity(x.topics.where("name <> 'click'"), x.ranges.where("seq <> 4"), x.segments)


_OVER = """, r as (select topic, count(*) range_count, count(*) filter (state = 'active') active_range_count from ranges group by 1),
s as (select topic, count(*) segment_count, count(*) filter (state = 'active') active_segment_count, sum(coalesce(byte_size, 0))::bigint total_bytes from segments group by 1),
g as (select topic, string_agg(distinct grp, ',' order by grp) grps from committed group by 1),
o as (select name topic, range_count, active_range_count, segment_count, active_segment_count, total_bytes, coalesce(grps, '') as "groups" from topics left join r on r.topic = name left join s on s.topic = name left join g on g.topic = name)"""


@query(_OVER + " select * from o")
def topics_overview(x):
    return metadata.overview(x.topics, x.ranges, x.segments, consume.committed(x.commits, x.ranges))


_VIOL = """, cov as (select topic, segment, count(distinct coalesce(rack, ' none')) covered from (select topic, segment, unnest(replica_set) broker from placed) join brokers using (broker) group by 1, 2),
viol as (select topic, count(*) violations from cov where covered < 3 group by 1)"""


@query(_OVER + _VIOL + " select o.*, coalesce(violations, 0) violations from o left join viol using (topic)")
def overview_annotated(x):
    o = metadata.overview(x.topics, x.ranges, x.segments, consume.committed(x.commits, x.ranges))
    return o.join(placement.domain_violations(x.placed, x.brokers, "rack", 3), "topic", "left").na.fill(0, ["violations"])


@query("select r.topic, r.seq, r.key_start, r.key_end, r.state range_state, s.seg_seq, s.state segment_state, s.start_offset, s.length, s.byte_size from ranges r left join segments s on s.topic = r.topic and s.range_seq = r.seq")
def topic_detail(x):
    return metadata.flat_detail(x.ranges, x.segments)


@query("select topic, range_seq, min(start_offset) earliest from segments group by 1, 2")
def earliest_offset(x):
    return metadata.earliest(x.segments)


@query(", w as (select topic, range_seq, off from log where event_id % 7 = 0) select w.topic, w.range_seq, w.off, s.seg_seq, s.start_offset from w asof join segments s on w.topic = s.topic and w.range_seq = s.range_seq and w.off >= s.start_offset")
def locate_segment(x):
    return metadata.locate(x.segments, x.log.where("event_id % 7 = 0").select("topic", "range_seq", "offset"))


@query(" select l.topic, l.range_seq, l.off, s.seg_seq, s.start_offset from log l asof join segments s on l.topic = s.topic and l.range_seq = s.range_seq and l.off >= s.start_offset")
def locate_every(x):
    """The segment of every log row."""
    return metadata.locate(x.segments, x.stored.select("topic", "range_seq", "offset"))


@query("select topic, range_seq, off, event_id from log where topic = 'view' and range_seq = 2 and off >= 5 order by off limit 20")
def segment_read(x):
    return metadata.segment_read(x.stored, "view", 2, 5, 20).select("topic", "range_seq", "offset", "event_id")


@query(", w as (select topic, range_seq, max(off) + d off from log, (values (-1), (1), (5)) t(d) group by topic, range_seq, d), e as (select topic, range_seq, min(off) lo, max(off) + 1 hi from log group by 1, 2) select w.topic, w.range_seq, w.off, case when w.off >= lo and w.off < hi then 'ok' when w.off = hi then 'eof' else 'out_of_range' end status from w join e using (topic, range_seq)")
def log_read(x):
    top = x.stored.groupBy("topic", "range_seq").agg(F.max("offset").alias("o"))
    wanted = top.select("topic", "range_seq", F.explode(F.array(F.col("o") - 1, F.col("o") + 1, F.col("o") + 5)).alias("offset"))
    return metadata.read_status(x.stored, wanted)


@query(", i as (select topic, range_seq, off, sum(frame_bytes) over (partition by topic, range_seq order by off) - frame_bytes p from log), k as (select * from i where off % 16 = 0), w as (select topic, range_seq, off target from log where event_id % 11 = 0) select w.topic, w.range_seq, target, k.off, p::bigint as position from w asof join k on w.topic = k.topic and w.range_seq = k.range_seq and target >= k.off")
def sparse_seek(x):
    """An index entry every 16 records."""
    from pyspark.sql import Window as W

    before = F.sum("frame_bytes").over(W.partitionBy("topic", "range_seq").orderBy("offset")) - F.col("frame_bytes")
    index = x.log.withColumn("position", before).where("offset % 16 = 0").select("topic", "range_seq", "offset", "position")
    return metadata.sparse_seek(index, x.log.where("event_id % 11 = 0").select("topic", "range_seq", F.col("offset").alias("target")))


@query(", i as (select topic, range_seq, off, sum(frame_bytes) over (partition by topic, range_seq order by off) - frame_bytes p from log), k as (select * from i where off % 16 = 0) select l.topic, l.range_seq, l.off target, k.off, p::bigint as position from log l asof join k on l.topic = k.topic and l.range_seq = k.range_seq and l.off >= k.off")
def sparse_seek_every(x):
    """sparse_seek for the offset of every log row."""
    from pyspark.sql import Window as W

    before = F.sum("frame_bytes").over(W.partitionBy("topic", "range_seq").orderBy("offset")) - F.col("frame_bytes")
    index = x.log.withColumn("position", before).where("offset % 16 = 0").select("topic", "range_seq", "offset", "position")
    return metadata.sparse_seek(index, x.log.select("topic", "range_seq", F.col("offset").alias("target")))


@query(""", i as (select topic, range_seq, event_id // 500 seg_seq, off, (sum(frame_bytes) over w - frame_bytes)::bigint p, row_number() over w k from log window w as (partition by topic, range_seq, event_id // 500 order by off)),
r(topic, range_seq, seg_seq, off, p, k, last, hit) as (select topic, range_seq, seg_seq, off, p, k, p, true from i where k = 1
  union all select i.topic, i.range_seq, i.seg_seq, i.off, i.p, i.k, case when i.p - r.last >= 1024 then i.p else r.last end, i.p - r.last >= 1024
  from r join i on i.topic = r.topic and i.range_seq = r.range_seq and i.seg_seq = r.seg_seq and i.k = r.k + 1)
select topic, range_seq, seg_seq, off, p as position from r where hit""")
def sparse_index(x):
    log = x.log.withColumn("seg_seq", F.expr("event_id div 500"))
    return metadata.sparse_index(log, 1024)


@query("select 'topic' kind, 'view' ident union all select 'range', topic || '/' || seq from ranges where topic = 'view' union all select 'segment', topic || '/' || range_seq || '/' || seg_seq from segments where topic = 'view' union all select 'offset', grp || '/' || range_seq || '/' || source_index || '/' || source_offset from committed where topic = 'view'")
def export_topic(x):
    return metadata.export_topic("view", x.topics, x.ranges, x.segments, consume.committed(x.commits, x.ranges))


@query(", w(name, bits) as (values ('view', 8), ('new-topic', 8), ('a b', 8), ('.', 8), ('', 8), ('big', 33), ('none', 0), ('wide', 32)) select w.name, bits::bigint bits, case when not regexp_full_match(w.name, '[A-Za-z0-9._-]+') or w.name in ('.', '..') then 'invalid_topic_name' when t.name is not null then 'already_exists' when bits < 1 or bits > 32 then 'invalid_keyspace_bits' else 'ok' end answer, case when regexp_full_match(w.name, '[A-Za-z0-9._-]+') and w.name not in ('.', '..') and t.name is null and bits between 1 and 32 then (1::bigint << bits)::bigint end key_end from w left join topics t on t.name = w.name")
def create_topics(x):
    w = x.spark.createDataFrame([("view", 8), ("new-topic", 8), ("a b", 8), (".", 8), ("", 8), ("big", 33), ("none", 0), ("wide", 32)], "name string, bits long")
    return metadata.create_topics(w, x.topics)


@query("select topic, seq, state from ranges")
def merged_metadata(x):
    parts = [x.ranges.where(F.pmod(keyspace.hash32(F.col("topic")), F.lit(3)) == k).select("topic", "seq", "state") for k in range(3)]
    return metadata.merged(*parts)


@query("select topic, seq, key_start, key_end, state, array_to_string(parents, ',') parents from ranges")
def metadata_fold(x):
    """A command log over every topic folded, then its ranges: split, split, merge, with refused commands in between."""
    log = []
    for (t,) in x.topics.select("name").orderBy("name").collect():
        log += [("create_topic", t, 8), ("create_topic", t, 8), ("split_range", (t, 0)), ("split_range", (t, 0)), ("split_range", (t, 1)), ("merge_ranges", (t, 2), (t, 3)), ("merge_ranges", (t, 3), (t, 4))]
    m, _ = machine.fold(log)
    return m.tables(x.spark)["ranges"].withColumn("parents", F.array_join(F.col("parents").cast("array<string>"), ","))


# placement


@query("select segment, array_to_string(replica_set, ',') replicas from placed")
def placement_hrw(x):
    return placement.place(x.segments, x.brokers, 3).select("segment", F.array_join("replicas", ",").alias("replicas"))


_SPREAD = """, t as (select segment, broker, coalesce(rack, ' none') value, rnk, row_number() over (partition by segment, coalesce(rack, ' none') order by rnk) turn, min(rnk) over (partition by segment, coalesce(rack, ' none')) best from scored),
u as (select *, row_number() over (partition by segment order by turn, best) i from t),
sp as (select segment, string_agg(broker, ',' order by i) replicas, count(distinct value) covered from u where i <= 3 group by 1)"""


@query(_SPREAD + " select segment, replicas from sp")
def placement_spread(x):
    return placement.spread(x.segments, x.brokers, 3, "rack").select("segment", F.array_join("replicas", ",").alias("replicas"))


@query(_SPREAD + " select segment, replicas, covered, 4::bigint required, case when covered < 4 then 'insufficient_domains' else 'ok' end status from sp")
def placement_hard(x):
    return placement.place_hard(x.segments, x.brokers, 3, "rack", 4).withColumn("replicas", F.array_join("replicas", ","))


@query(_VIOL + " select * from viol")
def domain_violations(x):
    return placement.domain_violations(x.placed, x.brokers, "rack", 3)


_UNDER = f", un as (select *, len(list_filter(replica_set, lambda b: b not in {DEAD})) live_replicas from placed where len(list_filter(replica_set, lambda b: b not in {DEAD})) < 3) "


@query(_UNDER + "select segment, live_replicas from un")
def under_replicated(x):
    return placement.under_replicated(x.placed, x.live, 3).select("segment", "live_replicas")


_HEAL = _UNDER + f""", lr as (select segment, broker, row_number() over (partition by segment order by rnk) i from scored where broker not in {DEAD}),
nw as (select segment, list(broker order by i) replicas from lr where i <= 3 group by 1),
hl as (select un.*, replicas, list_filter(replicas, lambda b: not list_contains(replica_set, b)) to_add, list_filter(replica_set, lambda b: b not in {DEAD}) src from un join nw using (segment))"""


@query(_HEAL + " select segment, state, array_to_string(replica_set, ',') before, array_to_string(replicas, ',') after from hl")
def heal_plan(x):
    h = placement.heal(x.placed, x.brokers, x.live, 3)
    return h.select("segment", "state", F.array_join("replica_set", ",").alias("before"), F.array_join("replicas", ",").alias("after"))


@query(_HEAL + " select segment, array_to_string(to_add, ',') to_add, src[1] source, case when len(to_add) = 0 then 'no_copy' when len(src) = 0 then 'no_live_source' else 'copy' end status from hl where state = 'sealed'")
def heal_sealed_plan(x):
    h = placement.heal_sealed(x.placed, x.brokers, x.live, 3)
    return h.select("segment", F.array_join("to_add", ",").alias("to_add"), "source", "status")


@query(f", f as (select segment, replica_set, list_filter(replica_set, lambda b: b not in {DEAD})[1] p from placed where state = 'active' and replica_set[1] in {DEAD}) select segment, p promoted, array_to_string(list_prepend(p, list_filter(replica_set, lambda b: b <> p)), ',') replicas from f where p is not null")
def failover_plan(x):
    return placement.failover(x.placed, x.live).select("segment", "promoted", F.array_join("replicas", ",").alias("replicas"))


@query(""", a as (select segment, broker, (ascii(substr(md5(broker || segment), 1, 1)) * 10 + rnk)::bigint off from scored where rnk <= 2 or substr(md5(segment || broker), 1, 1) < '4'),
b as (select segment, broker, max(off) off from a group by 1, 2),
c as (select segment, list_sort(list(coalesce(off, -1)), 'DESC') o from (select segment, unnest(replica_set) broker from placed) left join b using (segment, broker) group by 1)
select segment, case when o[2] >= 0 then o[2] end commit_offset from c""")
def quorum_commit(x):
    scored = placement.ranked(x.segments.select("segment"), x.brokers.select("broker"))
    acks = scored.where((F.col("rank") <= 2) | (F.substring(F.md5(F.concat("segment", "broker")), 1, 1) < "4")).select("segment", "broker", (F.ascii(F.substring(F.md5(F.concat("broker", "segment")), 1, 1)) * 10 + F.col("rank")).cast("long").alias("offset"))
    return placement.quorum_commit(x.placed, acks)


@query("select topic || '/' || range_seq segment, off // 100 batch_no, min(off) as \"first\", max(off) as \"last\", count(*) records from log where event_id % 3 = 0 group by 1, 2")
def catchup_gap(x):
    s = x.stored.select(F.concat_ws("/", "topic", F.col("range_seq").cast("string")).alias("segment"), "offset", "event_id")
    return placement.catchup_gap(s.select("segment", "offset"), s.where("event_id % 3 <> 0").select("segment", "offset"), 100)


@query()
def placement_balanced(x):
    got = placement.place_balanced([f"v{k}" for k in range(64)], [r[0] for r in x.brokers.select("broker").collect()], 3)
    return x.spark.createDataFrame([(v, ",".join(b)) for v, b in got], "vnode string, replicas string")


# retention


_EFF = ", eff as (select name, case policy when 'short' then 3600000 when 'no_limit' then null else 86400000 end::bigint max_age_ms, case policy when 'no_limit' then null else 2000 end::bigint max_bytes, case policy when 'short' then null else 'rack' end::varchar spread_by from topics) "


def _settings(x):
    return retention.effective(x.topics, x.policies, 86_400_000, 2_000, "rack")


@query(_EFF + "select name, max_age_ms, max_bytes from eff")
def effective_retention(x):
    return _settings(x).select("name", "max_age_ms", "max_bytes")


@query(_EFF + "select name, spread_by from eff")
def effective_spread(x):
    return _settings(x).select("name", "spread_by")


_AGE = "select topic, range_seq, seg_seq from segments, eff, tmax where state = 'sealed' and name = topic and t - sealed_at > max_age_ms"
_SIZE = "select topic, range_seq, seg_seq from (select *, sum(byte_size) over (partition by topic, range_seq order by start_offset desc) suffix from segments where state = 'sealed') join eff on name = topic where suffix > max_bytes"


@query(_EFF + _AGE)
def retention_age(x):
    return retention.by_age(x.segments, _settings(x), x.now)


@query(_EFF + _SIZE)
def retention_size(x):
    return retention.by_size(x.segments, _settings(x))


@query(_EFF + _AGE + " union " + _SIZE)
def retention_expired(x):
    return retention.expired(x.segments, _settings(x), x.now)


# ring


_H = "('0x' || substr(md5({}), 1, 8))::ubigint::bigint"
_OWN = "coalesce((select arg_min(vnode, token) from {ring} r where r.token >= {h}), (select arg_min(vnode, token) from {ring}))"


@query(f", k as (select distinct user_id::varchar as key from events), h as (select key, {_H.format('key')} hash from k), r2 as (select * from ring union all select (select arg_min(vnode, token) from ring), 4294967296) select key k, hash, vnode from h asof join r2 on h.hash <= r2.token")
def ring_route(x):
    return ring.route(x.records.select("key").distinct(), "key", x.ring)


@query("select vnode, coalesce(lag(token) over (order by token), max(token) over ()) as start, token as stop, 536870912::bigint length from ring")
def ring_arcs(x):
    return ring.arcs(x.ring)


@query(", r3 as (select * from ring where vnode <> 'v4'), a as (select vnode, lag(token) over (order by token) s, token, max(token) over () m from r3) select vnode, coalesce(s, m) as start, token as stop, case when s is null then 4294967296 - m + token else token - s end length from a order by length desc, vnode desc limit 1")
def largest_arc(x):
    return ring.largest_arc(x.ring.where("vnode <> 'v4'"))


@query(f""", t as (select distinct o_custkey::varchar topic from orders), h as (select topic, {_H.format('topic')} hash from t),
b as (select * from ring where vnode not in ('v2', 'v5')), b2 as (select * from b union all select (select arg_min(vnode, token) from b), 4294967296), a2 as (select * from ring union all select (select arg_min(vnode, token) from ring), 4294967296),
x as (select topic, hash, vnode from_vnode from h asof join b2 on hash <= token), y as (select topic, vnode to_vnode from h asof join a2 on hash <= token)
select topic, from_vnode, to_vnode from x join y using (topic) where from_vnode <> to_vnode""")
def displaced_topics(x):
    t = x.table("orders").select(F.col("o_custkey").cast("string").alias("topic")).distinct()
    return ring.displaced(t, x.ring.where("vnode not in ('v2', 'v5')"), x.ring)


@query("select vnode, token from ring")
def vnode_tokens(x):
    return x.ring


_VP = ", vp as (select vnode, token, list(broker order by md5(vnode || '|' || broker) desc, broker desc)[1:3] replicas from ring, {} group by 1, 2)"


@query(_VP.format("brokers") + " select vnode, token, array_to_string(replicas, ',') replicas from vp")
def vnode_placement(x):
    return ring.vnode_placement(x.ring, x.brokers, 3).withColumn("replicas", F.array_join("replicas", ","))


@query(_VP.format("brokers") + _VP.format("live").replace("vp as", "dp as") + " select vnode, array_to_string(list_filter(d.replicas, lambda b: not list_contains(c.replicas, b)), ',') as \"add\", array_to_string(list_filter(c.replicas, lambda b: not list_contains(d.replicas, b)), ',') as remove from dp d join vp c using (vnode) where len(list_filter(d.replicas, lambda b: not list_contains(c.replicas, b))) + len(list_filter(c.replicas, lambda b: not list_contains(d.replicas, b))) > 0 and vnode <> 'v0'")
def rebalance_plan(x):
    """v0 cannot be read, so nothing is planned for it."""
    readable = x.ring.where("vnode <> 'v0'")
    now = ring.vnode_placement(readable, x.brokers, 3)
    want = ring.vnode_placement(readable, x.brokers.where(F.col("broker").isin(x.live)), 3)
    return ring.rebalance(now, want).select("vnode", F.array_join("add", ",").alias("add"), F.array_join("remove", ",").alias("remove"))


@query(", p as (select topic as scope, event_id tick, case when pos % 4 = 0 then '' when pos % 4 = 1 then 'a' else 'b' end plan from rec), c as (select *, (coalesce(lag(plan) over (partition by scope order by tick), '-') <> plan)::int ch from p), i as (select *, sum(ch) over (partition by scope order by tick) isl from c), r as (select scope, tick, plan, row_number() over (partition by scope, isl order by tick) run from i) select scope, tick, plan, run from r where plan <> '' and run % 3 = 0")
def stable_plan(x):
    plan = F.when(F.col("pos") % 4 == 0, "").when(F.col("pos") % 4 == 1, "a").otherwise("b")
    return ring.stable_plans(x.records.select(F.col("topic").alias("scope"), F.col("event_id").alias("tick"), plan.alias("plan")), 3)


@query("select topic as ring, max(pos) as version, max_by(topology, struct_pack(a := pos, b := topology)) topology from (select topic, pos, 't' || (user_id % 5) topology from rec) group by 1")
def topology_merge(x):
    v = x.records.select(F.col("topic").alias("ring"), F.col("pos").alias("version"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("topology"))
    return ring.newest_topology(v)


@query("select 'vnode_' || (token - 268435456) vnode, token - 268435456 token, vnode split_from from ring order by ring.token desc limit 5")
def reshard_plan(x):
    _, steps = ring.reshard_plan(ring.vnodes_of(x.ring), 13)
    return x.spark.createDataFrame(steps, "vnode string, token long, split_from string")


# groups


@query(_ASSIGN + "select m.member, coalesce(string_agg(topic || '/' || range_seq, ',' order by topic || '/' || range_seq), '') as \"ranges\" from members m left join a using (member) group by 1")
def group_assignment(x):
    return groups.assignment_of(x.ranges, x.members)


@query("select grp, topic, member, max(hb_ms) last_ms from heartbeats group by 1, 2, 3 having max(hb_ms) >= (select t from tmax) - 3600000")
def live_members(x):
    return groups.live_members(x.heartbeats, x.now, 3_600_000)


@query(f", h as (select name topic, {_H.format('name')} hash from topics), r2 as (select * from ring union all select (select arg_min(vnode, token) from ring), 4294967296) select topic, vnode, case when vnode in ('v0', 'v1', 'v2', 'v3') then 'n' || vnode else 'local' end node from h asof join r2 on h.hash <= r2.token")
def coordinator_route(x):
    leaders = x.ring.where("vnode < 'v4'").select("vnode", F.concat(F.lit("n"), "vnode").alias("leader"))
    return groups.coordinators(x.topics.select(F.col("name").alias("topic")), x.ring, leaders, "local")


_MERGE = ", v as (select 'm' || (user_id % 20) member, ['alive', 'suspect', 'dead'][(event_id % 3) + 1] status, event_id // 2 incarnation, event_id % 3 rk from rec), w as (select member, max_by(status, struct_pack(a := incarnation, b := rk)) status, max(incarnation) incarnation from v group by 1) "


def _views(x):
    status = F.element_at(F.array(*map(F.lit, ("alive", "suspect", "dead"))), (F.col("event_id") % 3 + 1).cast("int"))
    return x.records.select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("member"), status.alias("status"), F.expr("event_id div 2").alias("incarnation"))


@query(_MERGE + "select * from w")
def membership_merge(x):
    return groups.merge_views(_views(x))


@query(_MERGE + "select member from w where status = 'alive'")
def alive_members(x):
    return groups.alive(groups.merge_views(_views(x)))


# operations


@query("select event_id, timestamp ts_ms, event_type, username from audit order by timestamp desc, event_id desc limit 50")
def audit_latest(x):
    return ops.latest(x.audit, 50).select("event_id", "timestamp", "event_type", "username")


@query("select event_id, username from audit where event_type = 'error' order by timestamp desc, event_id desc limit 50")
def audit_by_type(x):
    return ops.latest(x.audit, 50, event_type="error").select("event_id", "username")


@query("select event_id, event_type from audit where username = 'u3' order by timestamp desc, event_id desc limit 50")
def audit_by_user(x):
    return ops.latest(x.audit, 50, username="u3").select("event_id", "event_type")


@query("select event_type, count(*) events from audit group by 1")
def audit_stats(x):
    return ops.audit_stats(x.audit)


@query("select event_id from audit, tmax where timestamp >= t - 259200000")
def audit_retained(x):
    return ops.retained(x.audit, x.now, 259_200_000).select("event_id")


@query(", l as (select event_id, timestamp // 86400000 as day, timestamp, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"username\":\"' || username || '\"}' line from audit), r as (select *, sum(octet_length(encode(line)) + 1) over (partition by day order by timestamp desc, event_id desc) run from l) select event_id, day, line from r where run <= 4096")
def audit_rotation(x):
    lines = x.audit.select("event_id", "timestamp", F.expr("timestamp div 86400000").alias("day"), ops.json_line("event_id", "event_type", "username").alias("line"))
    return ops.rotate(lines, 4096).select("event_id", "day", "line")


@query("select action, identifier, blocked, place from (select event_type as action, username identifier, count(*) blocked, row_number() over (partition by event_type order by count(*) desc, username) place from audit group by 1, 2) where place <= 5")
def top_blocked(x):
    return ops.top_blocked(x.audit.select(F.col("event_type").alias("action"), F.col("username").alias("identifier")), 5)


@query("select ip, count(*) connections from audit group by 1")
def connections_per_ip(x):
    return ops.per_ip(x.audit)


@query("select event_id connection_id, ip from audit where event_type = 'click'")
def connections_by_topic(x):
    c = x.audit.select(F.col("event_id").alias("connection_id"), "ip", F.col("event_type").alias("topic"), F.col("timestamp").alias("opened_ms"))
    return ops.connections_of(c, "click").select("connection_id", "ip")


_PCT = ", s as (select event_type op, round(value * 100)::bigint ms, row_number() over (partition by event_type order by value) i, count(*) over (partition by event_type) n from events) "


@query(_PCT + ", p as (select op, max(n) n, list(ms order by i) l from s group by 1) select op, l[greatest(1, ceil(50 * n / 100.0))::bigint] p50, l[greatest(1, ceil(95 * n / 100.0))::bigint] p95, l[greatest(1, ceil(99 * n / 100.0))::bigint] p99 from p")
def latency_percentiles(x):
    s = x.table("events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 100).cast("long").alias("ms"))
    return ops.percentiles(s, "op", "ms")


@query(_PCT + ", p as (select op, max(n) n, list(ms order by i) l from s group by 1) select op, l[floor(50 * (n - 1) / 100.0 + 0.5)::bigint + 1] p50, l[floor(99 * (n - 1) / 100.0 + 0.5)::bigint + 1] p99 from p")
def bench_percentiles(x):
    s = x.table("events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 100).cast("long").alias("ms"))
    return ops.percentiles(s, "op", "ms", (50, 99), "round")


@query("select timestamp // 1000 as second, count(*) events from rec, tmax where timestamp > t - 300000000 group by 1")
def metrics_history(x):
    return ops.history(x.records, x.now, 300_000)


@query(_OVER + """ select '0000/0' as ord, '# HELP log_topic_ranges Ranges per topic' || chr(10) || '# TYPE log_topic_ranges gauge' as line union all select '0000/1' || topic, 'log_topic_ranges{topic="' || topic || '"} ' || range_count from o
union all select '0001/0', '# HELP log_topic_bytes Stored bytes per topic' || chr(10) || '# TYPE log_topic_bytes gauge' union all select '0001/1' || topic, 'log_topic_bytes{topic="' || topic || '"} ' || total_bytes from o""")
def prometheus_topics(x):
    o = metadata.overview(x.topics, x.ranges, x.segments, consume.committed(x.commits, x.ranges))
    return ops.exposition(o, [("log_topic_ranges", "gauge", "Ranges per topic", "range_count"), ("log_topic_bytes", "gauge", "Stored bytes per topic", "total_bytes")])


_ACL = ", acl as (select distinct 'u' || user_id username, case when pos % 2 = 0 then 'produce' else 'consume' end operation, case when pos % 3 = 0 then 'prefix' else 'literal' end kind, case when pos % 3 = 0 then substr(topic, 1, 2) else topic end resource from rec where pos % 5 = 0), us as (select distinct 'u' || user_id username, user_id % 11 = 0 as admin, case when user_id % 7 = 0 then ['consume'] else [] end::varchar[] permissions from rec), rq as (select distinct 'u' || user_id username, case when event_id % 2 = 0 then 'produce' else 'consume' end operation, topic from rec) "
_HIT = "((kind = 'literal' and resource = q.topic) or (kind = 'prefix' and starts_with(q.topic, resource)))"


def _acl(x):
    p = F.col("pos")
    return x.records.where(p % 5 == 0).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.when(p % 2 == 0, "produce").otherwise("consume").alias("operation"), F.when(p % 3 == 0, "prefix").otherwise("literal").alias("kind"), F.when(p % 3 == 0, F.substring("topic", 1, 2)).otherwise(F.col("topic")).alias("resource")).distinct()


@query(_ACL + f"select distinct a.username, a.operation, q.name topic from acl a, (select name, name topic from topics) q where {_HIT}")
def acl_match(x):
    t = x.topics.select(F.col("name").alias("topic"))
    names = [r[0] for r in t.collect()]
    each = _acl(x).withColumn("topic", F.explode(F.array(*map(F.lit, names))))
    return each.where(ops.acl_matches(F.col("kind"), F.col("resource"), F.col("topic"))).select("username", "operation", "topic").distinct()


@query(_ACL + f", w as (select q.*, case when admin then 'admin' when list_contains(permissions, operation) then 'global' when exists (select 1 from acl a where a.username = q.username and a.operation = q.operation and {_HIT}) then 'grant' else 'denied' end why from rq q join us using (username)) select username, operation, topic, why, why <> 'denied' allowed from w")
def authorize(x):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username")
    users = x.records.select(name, (F.col("user_id") % 11 == 0).alias("admin"), F.when(F.col("user_id") % 7 == 0, F.array(F.lit("consume"))).otherwise(F.array().cast("array<string>")).alias("permissions")).distinct()
    requests = x.records.select(name, F.when(F.col("event_id") % 2 == 0, "produce").otherwise("consume").alias("operation"), "topic").distinct()
    return ops.authorize(requests, users, _acl(x), strict=False)


@query("select username, ip, max_by(fails, seq) fails from fails group by 1, 2 having max_by(fails, seq) > 0")
def failed_attempts(x):
    return ops.failed_attempts(x.attempts)


_LOCK = ", lk as (select username, ip, seq, fails, [1, 3, 9, 24, 72][least(fails // 3, 5)] * 300000::bigint duration_ms, ts from fails where not ok and fails >= 3) "


@query(_LOCK + "select username, ip, seq, fails, duration_ms, ts + duration_ms locked_until from lk")
def lockout_levels(x):
    return ops.lockouts(x.attempts, 3, 300_000)


@query(_LOCK + ", la as (select username, ip, max(seq) seq from attempts group by 1, 2) select username, ip, ts + duration_ms - (t - 86400000) remaining_ms from lk join la using (username, ip, seq), tmax where ts + duration_ms > t - 86400000")
def locked_accounts(x):
    return ops.locked(x.attempts, 3, 300_000, x.now - 86_400_000)


_SESS = ", ss as (select 't' || user_id token, 'u' || user_id username, '10.0.0.' || (user_id % 7) ip, max(timestamp) // 1000 + 3600 expires_at from rec group by user_id), ck as (select event_id check_id, 't' || (user_id + (pos % 50 = 0)::int * 100000) token, '10.0.0.' || ((user_id + (pos % 9 = 0)::int) % 7) ip from rec) "


def _sessions(x):
    u = F.col("user_id").cast("string")
    return x.records.groupBy("user_id").agg(F.max("timestamp").alias("t")).select(F.concat(F.lit("t"), u).alias("token"), F.concat(F.lit("u"), u).alias("username"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip"), F.expr("t div 1000 + 3600").alias("expires_at"))


@query(_SESS + "select check_id, case when s.token is null then 'invalid_session' when expires_at < (t // 1000) then 'session_expired' when ck.ip <> s.ip then 'session_hijack_attempt' else 'ok' end status, coalesce((ck.ip <> s.ip)::bigint, 0) hijack_events, coalesce((expires_at < (t // 1000))::bigint, 0) expired_events from ck left join ss s using (token), tmax")
def session_status(x):
    odd = (F.col("pos") % 9 == 0).cast("long")
    checks = x.records.select(F.col("event_id").alias("check_id"), F.concat(F.lit("t"), (F.col("user_id") + (F.col("pos") % 50 == 0).cast("long") * 100_000).cast("string")).alias("token"), F.concat(F.lit("10.0.0."), ((F.col("user_id") + odd) % 7).cast("string")).alias("ip"))
    return ops.session_status(checks, _sessions(x), x.now // 1000)


@query(_SESS + "select token, username from ss, tmax where expires_at >= t // 1000")
def active_sessions(x):
    return ops.active_sessions(_sessions(x), x.now // 1000).select("token", "username")


@query("select 'c' || (c_custkey % 1000) username, min_by('r' || (c_nationkey % 3), c_custkey) as role from customer where c_custkey % 1000 >= 50 group by 1")
def import_users(x):
    name = F.concat(F.lit("c"), (F.col("c_custkey") % 1000).cast("string")).alias("username")
    new = x.table("customer").select(name, F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("role"), F.col("c_custkey").alias("seq"))
    return ops.import_users(new, x.spark.range(50).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("username")))


@query(", ch as (select event_id seq, case when pos % 3 = 0 then 'revoke' else 'grant' end op, 'u' || (user_id % 40) username, 'produce' operation, 'literal' kind, topic resource from rec) select username, operation, kind, resource from ch group by 1, 2, 3, 4 having max_by(op, seq) = 'grant'")
def acl_grants(x):
    ch = x.records.select(F.col("event_id").alias("seq"), F.when(F.col("pos") % 3 == 0, "revoke").otherwise("grant").alias("op"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("username"), F.lit("produce").alias("operation"), F.lit("literal").alias("kind"), F.col("topic").alias("resource"))
    return ops.grants(ch)


# sequential and binary operators


@query()
def frame_encode(x):
    f = frames.frame(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("value"))
    return x.stored.select("topic", "range_seq", "offset", F.sha2(f, 256).alias("frame_sha256"), F.octet_length(f).alias("frame_bytes"))


@query("select off, timestamp ts_ms, key k, value v from log")
def frame_scan(x):
    """The log as framed files, read back by the data source."""
    folder = new_path(x.spark, "framed")
    framed.write_framed(x.stored.repartition(4, "topic", "range_seq"), folder, 2000)
    framed.register(x.spark)
    got = x.spark.read.format("framed").option("path", folder).load()
    return got.select("offset", "timestamp", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(""", q as (select username identifier, event_type as action, event_id seq, timestamp t, row_number() over (partition by username, event_type order by event_id) i from audit),
r(identifier, action, seq, i, tokens, last, start, allowed, wait) as (select identifier, action, seq, i, 2::bigint, t, t, true, 0::bigint from q where i = 1
  union all select identifier, action, seq, i, case when have > 0 then have - 1 else tokens end, case when have > 0 then t else last end, case when have > 0 and more > 0 then t else start end, have > 0, case when have > 0 then 0 else greatest(0, start + 3600000 - t) end
  from (select q.identifier, q.action, q.seq, q.i, q.t, r.tokens, r.last, r.start, case when q.t - r.last >= 3600000 then 3 else ((q.t - r.last) * 3) // 3600000 end more, least(3, r.tokens + case when q.t - r.last >= 3600000 then 3 else ((q.t - r.last) * 3) // 3600000 end) have
    from r join q on q.identifier = r.identifier and q.action = r.action and q.i = r.i + 1))
select identifier, action, seq, allowed, wait retry_after_ms from r""")
def token_bucket(x):
    r = x.audit.select(F.col("username").alias("identifier"), F.col("event_type").alias("action"), F.col("event_id").alias("seq"), F.col("timestamp").alias("ts"))
    return ops.token_bucket(r, 3, 3_600_000)


@query(""", c as (select topic lease, event_id seq, pos % 5 = 0 rel, 'n' || (user_id % 3) cand, pos % 4 fence, timestamp t, row_number() over (partition by topic order by event_id) i from rec),
r(lease, seq, i, answer, holder, token, until) as (select lease, seq, i, case when rel then 'ok' else 'ok 1' end, case when not rel then cand end, (not rel)::bigint, case when rel then 0 else t + 600000 end from c where i = 1
  union all select c.lease, c.seq, c.i,
    case when c.rel then 'ok' when r.holder is null or r.holder = c.cand or c.t >= r.until then 'ok ' || (r.token + (r.holder is distinct from c.cand)::bigint) else 'held ' || r.holder end,
    case when c.rel then case when r.holder = c.cand and r.token = c.fence then null else r.holder end when r.holder is null or r.holder = c.cand or c.t >= r.until then c.cand else r.holder end,
    case when not c.rel and (r.holder is null or r.holder = c.cand or c.t >= r.until) then r.token + (r.holder is distinct from c.cand)::bigint else r.token end,
    case when not c.rel and (r.holder is null or r.holder = c.cand or c.t >= r.until) then c.t + 600000 else r.until end
  from r join c on c.lease = r.lease and c.i = r.i + 1)
select lease, seq, answer, holder, token fence_now from r""")
def lease_fold(x):
    c = x.records.select(F.col("topic").alias("lease"), F.col("event_id").alias("seq"), F.when(F.col("pos") % 5 == 0, "release").otherwise("acquire").alias("op"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("candidate"), (F.col("pos") % 4).alias("fence"), F.lit(600_000).cast("long").alias("duration_ms"), F.col("timestamp").alias("now"))
    return ops.lease_fold(c)


@query(""", e as (select topic, event_id seq, pos % 3 = 0 ack, 1 + pos % 7 n, row_number() over (partition by topic order by event_id) i from rec),
r(topic, seq, i, sent, flight, waiting) as (select topic, seq, i, case when ack then 0 else least(10, n) end, case when ack then 0 else least(10, n) end, case when ack then 0 else n - least(10, n) end from e where i = 1
  union all select topic, seq, i, greatest(0, least(10 - f, w)), f + greatest(0, least(10 - f, w)), w - greatest(0, least(10 - f, w))
  from (select e.topic, e.seq, e.i, case when e.ack then greatest(0, r.flight - e.n) else r.flight end f, case when e.ack then r.waiting else r.waiting + e.n end w from r join e on e.topic = r.topic and e.i = r.i + 1))
select topic, seq, sent::bigint delivered, flight::bigint in_flight, waiting::bigint waiting from r""")
def credit_window(x):
    """Each record produces or acknowledges a few; ten may be in flight."""
    kind = F.when(F.col("pos") % 3 == 0, "ack").otherwise("produce")
    return live.credit_fold(x.records.select("topic", F.col("event_id").alias("seq"), kind.alias("kind"), (1 + F.col("pos") % 7).alias("n")), 10)


@query("select event_id, topic from rec order by md5('7|' || event_id || '|' || topic) limit 100")
def reservoir_sample(x):
    return ops.reservoir(x.records.select("event_id", "topic"), 100, 7)


@query("select event_type as op, count(value) n, min(round(value * 100)::bigint) least, max(round(value * 100)::bigint) most from events group by 1")
def reservoir_extremes(x):
    s = x.table("events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 100).cast("long").alias("ms"))
    return ops.extremes(s, "op", "ms")


# requests, groups, stores and control loops


@query("""select 'member' as how, topic, reader, source_index, off, event_id from (select h.topic, reader, h.source_index, off, event_id, row_number() over (partition by h.topic, reader order by h.source_index, off) i
from hist h join (select topic, seq range_seq, arg_max(member, struct_pack(s := md5(topic || '/' || seq || '|' || member), m := member)) member from ranges, members where state = 'active' group by 1, 2) a on a.topic = h.topic and a.range_seq = h.reader and a.member = 'm1' left join committed c on c.grp = 'g1' and c.topic = h.topic and c.range_seq = h.reader
where c.grp is null or (h.source_index, off) >= (c.source_index, c.source_offset)) where i <= 5
union all select 'cursor', topic, reader, source_index, off, event_id from (select *, row_number() over (partition by topic, reader order by source_index, off) i from hist where (source_index, off) >= (1, 3)) where i <= 5
union all select 'start', topic, reader, source_index, off, event_id from (select *, row_number() over (partition by topic, reader order by source_index, off) i from hist where topic = 'view') where i <= 5""")
def fetch_precedence(x):
    """A member's request goes before its cursor, a cursor before its group; without any of them it starts at the beginning."""
    cursor = x.ranges.where("state = 'active'").select("topic", F.col("seq").alias("range_seq"), F.lit(1).cast("long").alias("source_index"), F.lit(3).cast("long").alias("source_offset"))
    a = groups.assign(x.ranges, x.members)
    asked = {"member": {"assignment": a, "cursor": cursor, "group": "g1", "member": "m1"}, "cursor": {"cursor": cursor, "group": "g1"}, "start": {"topic": "view"}}
    parts = [consume.fetch(x.stored, x.ranges, x.commits, most=5, **how).select(F.lit(name).alias("how"), "topic", "reader", "source_index", "offset", "event_id") for name, how in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(""", c as (select 'g' || (user_id % 3) grp, topic, event_id seq, case when event_id % 10 = 9 then 'tick' when pos % 7 = 0 then 'leave' when pos % 7 = 1 then 'heartbeat' else 'poll' end op, 'm' || (user_id % 4) m, timestamp t from rec),
k as (select *, row_number() over (partition by grp, topic order by seq) i from c),
s0 as (select grp, topic, 0::bigint i, 0::bigint seq, 'ok' answer, [] :: struct(m varchar, hb bigint)[] ms, null::varchar held, 0::bigint gen, ''::varchar m from k group by 1, 2),
r as (select * from s0 union all select grp, topic, i, seq, answer, ms, case when len(ms) = 0 then null when moved then fresh else held end, case when len(ms) = 0 then 0 when moved and fresh is distinct from held then gen + 1 else gen end, m
  from (select *, list_max(list_transform(ms, lambda x: md5(topic || '/2|' || x.m) || x.m))[33:] || ',' || list_max(list_transform(ms, lambda x: md5(topic || '/5|' || x.m) || x.m))[33:] fresh
    from (select k.grp, k.topic, k.i, k.seq, k.m, r.held, r.gen, case when k.op = 'heartbeat' and not list_contains(list_transform(r.ms, lambda x: x.m), k.m) then 'unknown_member' else 'ok' end answer,
      k.op in ('leave', 'tick') or (k.op = 'poll' and not list_contains(list_transform(r.ms, lambda x: x.m), k.m)) moved,
      case when k.op = 'tick' then list_filter(r.ms, lambda x: x.hb >= k.t - 36000000) when k.op = 'leave' then list_filter(r.ms, lambda x: x.m <> k.m)
        when k.op = 'poll' or list_contains(list_transform(r.ms, lambda x: x.m), k.m) then list_append(list_filter(r.ms, lambda x: x.m <> k.m), {'m': k.m, 'hb': k.t}) else r.ms end ms
      from r join k on k.grp = r.grp and k.topic = r.topic and k.i = r.i + 1)))
select grp, topic, seq, answer, gen generation, len(ms)::bigint members, (case when held is null then 0 else (split_part(held, ',', 1) = m)::int + (split_part(held, ',', 2) = m)::int end)::bigint owned from r where i > 0""")
def group_coordinator(x):
    op = F.when(F.col("event_id") % 10 == 9, "tick").when(F.col("pos") % 7 == 0, "leave").when(F.col("pos") % 7 == 1, "heartbeat").otherwise("poll")
    c = x.records.select(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group"), "topic", F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("member"), F.col("timestamp").alias("now"))
    active = {}
    for r in x.ranges.where("state = 'active'").select("topic", "seq").collect():  # cluster metadata
        active.setdefault(r["topic"], []).append(r["seq"])
    return groups.coordinator(c, active, 36_000_000)


_USERS = ", ch as (select event_id seq, case when pos % 4 = 0 then 'delete' when pos % 4 = 1 then 'password' else 'put' end op, 'u' || (user_id % 300) username, 's' || pos secret, timestamp as now_ms from rec), ub as (select *, coalesce(last_value(case when op <> 'password' then op end ignore nulls) over (partition by username order by seq rows between unbounded preceding and 1 preceding) = 'put', false) there from ch), ua as (select *, case when op = 'put' and there then 'user_exists' when op = 'password' and not there then 'user_not_found' else 'ok' end answer from ub) "


def _user_changes(x):
    p = F.col("pos")
    op = F.when(p % 4 == 0, "delete").when(p % 4 == 1, "password").otherwise("put")
    return x.records.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("u"), (F.col("user_id") % 300).cast("string")).alias("username"), F.concat(F.lit("s"), p.cast("string")).alias("secret"), F.col("timestamp").alias("now"))


@query(_USERS + "select seq, username, op, answer, case op when 'put' then true when 'delete' then false else there end exists_after from ua")
def user_commands(x):
    return ops.user_answers(_user_changes(x)).select("seq", "username", "op", "answer", "exists_after")


@query(_USERS + ", lf as (select *, max(seq) filter (op = 'put') over (partition by username) p from ua where answer = 'ok') select username, max_by(secret, seq) secret, min(now_ms) created, max_by(now_ms, seq) updated from lf where seq >= p group by 1 having max_by(op, seq) <> 'delete'")
def user_store(x):
    return ops.users_after(_user_changes(x))


@query(", ch as (select event_id seq, case when pos % 4 = 0 then 'revoke' else 'create' end op, 't' || (user_id % 200) token, 'u' || user_id username, '10.0.0.' || (user_id % 7) ip, 'ua' || (pos % 3) agent, timestamp // 1000 as s from rec), st as (select token, max_by(username, seq) username, max_by(ip, seq) ip, max_by(agent, seq) agent, max_by(s, seq) + 3600 expires_at from ch group by 1 having max_by(op, seq) = 'create') select event_id check_id, case when st.token is null then 'invalid_session' when expires_at < t // 1000 then 'session_expired' when '10.0.0.' || (user_id % 7) <> st.ip or 'ua' || (pos % 2) <> agent then 'session_hijack_attempt' else 'ok' end status, coalesce(('10.0.0.' || (user_id % 7) <> st.ip or 'ua' || (pos % 2) <> agent)::bigint, 0) hijack_events, coalesce((expires_at < t // 1000)::bigint, 0) expired_events from rec left join st on st.token = 't' || (user_id % 200), tmax")
def session_store(x):
    """Sessions created and revoked, then checked against address and user agent."""
    u, p = F.col("user_id"), F.col("pos")
    ip, token = F.concat(F.lit("10.0.0."), (u % 7).cast("string")).alias("ip"), F.concat(F.lit("t"), (u % 200).cast("string")).alias("token")
    agent = lambda n: F.concat(F.lit("ua"), (p % n).cast("string")).alias("agent")
    changes = x.records.select(F.col("event_id").alias("seq"), F.when(p % 4 == 0, "revoke").otherwise("create").alias("op"), token, F.concat(F.lit("u"), u.cast("string")).alias("username"), ip, agent(3), F.expr("timestamp div 1000").alias("now"))
    checks = x.records.select(F.col("event_id").alias("check_id"), token, ip, agent(2))
    return ops.session_status(checks, ops.sessions_after(changes, 3600), x.now // 1000, bind_agent=True)


@query(_VP.format("brokers") + _VP.format("live").replace("vp as", "dp as") + " select vnode, array_to_string(list_sort(replicas), ',') replicas from dp")
def apply_plan(x):
    """The rebalance plan applied, twice: every vnode has the members it should have."""
    now = ring.vnode_placement(x.ring, x.brokers, 3)
    want = ring.vnode_placement(x.ring, x.brokers.where(F.col("broker").isin(x.live)), 3)
    plan = ring.rebalance(now, want)
    return ring.apply_plan(ring.apply_plan(now, plan), plan).select("vnode", F.array_join(F.sort_array("replicas"), ",").alias("replicas"))


@query(_VP.format("brokers") + " select vnode, replicas[1] node from vp where replicas[1] <> 'b4'")
def leading_vnodes(x):
    """Each vnode is led by its first replica, but where that is b4, whose leader is no replica."""
    vp = ring.vnode_placement(x.ring, x.brokers, 3)
    first = F.get("replicas", F.lit(0))
    return ring.leading(vp, vp.select("vnode", F.when(first == "b4", "elsewhere").otherwise(first).alias("leader")))


@query(_HEAL + " select s.segment, array_to_string(coalesce(h.replicas, s.replica_set), ',') replicas from placed s left join hl h using (segment)")
def apply_heal(x):
    """The heal plan's commands applied: replica sets of all segments after it."""
    h = placement.heal(x.placed, x.brokers, x.live, 3).select("segment", F.lit(1).alias("seq"), "replicas")
    return placement.apply_heal(x.placed, h).select("segment", F.array_join("replica_set", ",").alias("replicas"))


@query(_MERGE + "select min(member) member from w where status = 'alive' having count(*) > 0")
def live_leader(x):
    return groups.leader(groups.merge_views(_views(x)))


_STEPS = [("create_topic", "ok"), ("define_policy", "ok"), ("set_topic_policy", "ok"), ("set_topic_policy", "no_such_policy"), ("begin_migration", "ok"), ("split_range", "migrating"), ("commit_offset", "migrating"),
          ("end_migration", "ok"), ("commit_offset", "ok"), ("split_range", "ok"), ("seal_topic", "ok"), ("split_range", "sealed"), ("extract_topic", "ok"), ("seal_topic", "no_such_topic"), ("insert_topic", "ok"),
          ("begin_migration", "ok"), ("delete_topic", "migrating"), ("end_migration", "ok"), ("delete_topic", "ok"), ("delete_topic", "no_such_topic"), ("begin_migration", "no_such_topic"), ("no_command", "unknown_command")]


@query(", st(step, command, answer) as (values " + ", ".join(f"({k}::bigint, '{c}', '{a}')" for k, (c, a) in enumerate(_STEPS)) + ") select name topic, step, command, answer from topics, st")
def topic_commands(x):
    """What the command log answers for each topic: policies, migration and its fence, sealing, moving out and in, deletion."""
    m, out = machine.Metadata(), []
    for (t,) in x.topics.select("name").orderBy("name").collect():
        bundle = None
        args = [(t, 8), ("short", {"max_age_ms": 1}), (t, "short"), (t, "nope"), (t,), ((t, 0),), ("g", t, {0: (0, 1)}), (t,), ("g", t, {0: (0, 1)}), ((t, 0),), (t,), ((t, 1),), (t,), (t,), None, (t,), (t,), (t,), (t,), (t,), (t,), ()]
        for step, ((command, _), a) in enumerate(zip(_STEPS, args)):
            kind, value = m.apply(command, *((bundle,) if a is None else a))
            bundle = value if command == "extract_topic" else bundle
            out.append((t, step, command, kind if kind == "ok" else value))
    return x.spark.createDataFrame(out, "topic string, step long, command string, answer string")


@query("select topic, segment, state, start_offset, length, byte_size, case when state = 'active' then 'b1,b2' else 'b0' end replicas from segments where seg_seq > 0 or state = 'active'")
def segment_commands(x):
    """Every segment registered while its range was open, sealed where it is, given new replicas where it is not; sealed first segments are deleted, active ones refuse."""
    log: list[tuple] = []
    by: dict = {}
    for r in x.segments.orderBy("topic", "range_seq", "seg_seq").collect():  # the command log is control state, a row a segment
        by.setdefault(r["topic"], {}).setdefault(r["range_seq"], []).append(r)
    for t, ranges in by.items():
        log.append(("create_topic", t, 8))
        for seq in range(6):
            if after := {1: ("split_range", (t, 0)), 3: ("split_range", (t, 1)), 5: ("merge_ranges", (t, 3), (t, 4))}.get(seq):
                # the segments of both children are registered before the next change of ranges
                log.append(after)
            for s in ranges.get(seq, []):
                log.append(("register_segment", s["segment"], (t, seq), ["b0"], s["start_offset"]))
                log.append(("seal_segment", s["segment"], s["length"], s["byte_size"], s["sealed_at"]) if s["state"] == "sealed" else ("set_segment_replicas", s["segment"], ["b1", "b2"]))
        log += [("delete_segment", s[0]["segment"]) for s in ranges.values()]
    m, _ = machine.fold(log)
    return m.tables(x.spark)["segments"].select("topic", F.col("id").alias("segment"), "state", "start_offset", "length", "byte_size", F.array_join("replica_set", ",").alias("replicas"))


@query("select event_id, '{\"at\":\"' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || '\",\"event_type\":\"' || event_type || '\"}' line from audit")
def audit_iso_lines(x):
    a = x.audit.withColumn("at", ops.iso8601(F.col("timestamp")))
    return a.select("event_id", ops.json_line("at", "event_type").alias("line"))


@query("select timestamp // 86400000 as day, '{\"event_id\":' || event_id || ',\"username\":\"' || username || '\"}' line from audit")
def audit_sink(x):
    """Audit lines written as text, a folder a day, and read back."""
    path = new_path(x.spark, "audit")
    ops.write_lines(x.audit.select(F.expr("timestamp div 86400000").alias("day"), ops.json_line("event_id", "username").alias("line")), path, "day")
    return x.spark.read.text(path).select(F.col("day").cast("long").alias("day"), F.col("value").alias("line"))
