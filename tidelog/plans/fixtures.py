"""Logs and metadata derived from the driver tables, once as DataFrames and once as DuckDB SQL.

events are records: topic = event_type, key = user_id, arrival = event_id. Each topic's root range is split, one child is
split again and its halves are merged, at fixed shares of the events; so ranges 2 and 5 are active at the end.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.frames import frame_bytes
from tidelog.functions.keyspace import even_tokens, position
from tidelog.operators import placement
from tidelog.operators.produce import assign_offsets, route, store
from tidelog.storage import new_path

KEYSPACE = 256
#: seq, block, epochs in which it is active, parents
RANGES = [(0, 0, 256, 0, 1, []), (1, 0, 128, 1, 2, [0]), (2, 128, 256, 1, 4, [0]), (3, 0, 64, 2, 3, [0, 1]), (4, 64, 128, 2, 3, [0, 1]), (5, 0, 128, 3, 4, [0, 1, 3, 4])]
DEAD = ("b3", "b7")
TS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


_stored: dict[tuple[str, str], str] = {}


class Fixture:
    """Tables of one data folder, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("events").count()

    @cached_property
    def records(self) -> DataFrame:
        n, e = self.n, F.col("event_id")
        epoch = F.when(2 * e < n, 0).when(4 * e < 3 * n, 1).when(10 * e < 9 * n, 2).otherwise(3)
        key = F.col("user_id").cast("string")
        return self.table("events").select("event_id", "user_id", F.col("event_type").alias("topic"), key.alias("key"), F.col("props").alias("value"), F.expr(TS).alias("timestamp"),
                                           position(key, KEYSPACE).alias("pos"), epoch.cast("long").alias("epoch"), F.expr("event_id div 50").alias("batch"), frame_bytes(key, F.col("props")).alias("frame_bytes"))

    @cached_property
    def topics(self) -> DataFrame:
        policy = F.when(F.col("name") == "click", "short").when(F.col("name") == "error", "no_limit")
        return self.table("events").select(F.col("event_type").alias("name")).distinct().withColumn("policy", policy)

    @cached_property
    def by_epoch(self) -> DataFrame:
        rows = [(s, a, b, e) for s, a, b, lo, hi, _ in RANGES for e in range(lo, hi)]
        blocks = self.spark.createDataFrame(rows, "seq long, key_start long, key_end long, epoch long")
        return self._per_topic(blocks)

    def _per_topic(self, rows: DataFrame) -> DataFrame:
        listed = F.array(*[F.struct(*[F.lit(v).alias(c) if not isinstance(v, list) else F.array(*[F.lit(x).cast("long") for x in v]).cast("array<long>").alias(c) for c, v in r.asDict().items()]) for r in rows.collect()])
        return self.topics.select(F.col("name").alias("topic"), F.inline(listed))

    @cached_property
    def ranges(self) -> DataFrame:
        rows = [(s, a, b, "active" if hi == 4 else "sealed", p) for s, a, b, _, hi, p in RANGES]
        return self._per_topic(self.spark.createDataFrame(rows, "seq long, key_start long, key_end long, state string, parents array<long>"))

    @cached_property
    def log(self) -> DataFrame:
        return assign_offsets(route(self.records, self.by_epoch, ("topic", "epoch")), "event_id")

    @cached_property
    def stored(self) -> DataFrame:
        """The log as a stored table, written once an application and data folder: what readers read."""
        at = self.spark.sparkContext.applicationId, self.dir
        if at not in _stored:
            path = new_path(self.spark, "log")
            store(self.log, path)
            _stored[at] = path
        return self.spark.read.schema(self.log.schema).parquet(_stored[at]).select(*self.log.columns)

    @cached_property
    def segments(self) -> DataFrame:
        s = self.log.groupBy("topic", "range_seq", F.expr("event_id div 500").alias("chunk")).agg(F.min("offset").alias("start_offset"), F.count("*").alias("length"), F.sum("frame_bytes").alias("byte_size"), F.max("timestamp").alias("sealed_at"))
        w = W.partitionBy("topic", "range_seq")
        s = s.withColumn("seg_seq", (F.row_number().over(w.orderBy("chunk")) - 1).cast("long"))
        open_ = F.col("range_seq").isin(2, 5) & (F.col("seg_seq") == F.max("seg_seq").over(w))
        s = s.withColumn("open", open_)
        sealed = lambda c: F.when(~F.col("open"), F.col(c)).alias(c)
        return s.select("topic", "range_seq", "seg_seq", F.concat_ws("/", "topic", F.col("range_seq").cast("string"), F.col("seg_seq").cast("string")).alias("segment"), F.when(F.col("open"), "active").otherwise("sealed").alias("state"), "start_offset", sealed("length"), sealed("byte_size"), sealed("sealed_at"))

    @cached_property
    def brokers(self) -> DataFrame:
        return self.table("supplier").where("s_suppkey < 10").select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("broker"), F.when(F.col("s_suppkey") != 9, F.concat(F.lit("r"), (F.col("s_nationkey") % 4).cast("string"))).alias("rack"))

    @cached_property
    def live(self) -> list[str]:
        return sorted(r[0] for r in self.brokers.select("broker").collect() if r[0] not in DEAD)

    @cached_property
    def placed(self) -> DataFrame:
        return placement.placed(self.segments, self.brokers, 3, name="replica_set")

    @cached_property
    def commits(self) -> DataFrame:
        size = F.create_map(*[F.lit(x) for s, *_, p in RANGES for x in (s, len(p))])
        return self.log.where("offset % 10 = 9").select(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group"), "topic", "range_seq", size[F.col("range_seq").cast("int")].cast("long").alias("source_index"), (F.col("offset") + 1).alias("source_offset"), F.col("event_id").alias("commit_seq"))

    @cached_property
    def ring(self) -> DataFrame:
        return even_tokens(self.spark, 8)

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self.records.select(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group"), "topic", F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("member"), F.col("timestamp").alias("hb_ms"))

    @cached_property
    def members(self) -> DataFrame:
        return self.records.select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("member")).distinct()

    @cached_property
    def now(self) -> int:
        return self.records.agg(F.max("timestamp")).first()[0] or 0

    @cached_property
    def audit(self) -> DataFrame:
        return self.records.select("event_id", "timestamp", F.col("topic").alias("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip"))

    @cached_property
    def attempts(self) -> DataFrame:
        a = self.audit.where(F.col("event_type").isin("error", "purchase"))
        return a.select("username", "ip", F.col("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))

    @cached_property
    def policies(self) -> DataFrame:
        return self.spark.createDataFrame([("short", True, 3_600_000, False, None, True, None), ("no_limit", True, None, True, None, False, None)], "name string, has_max_age boolean, max_age_ms long, has_max_bytes boolean, max_bytes long, has_spread_by boolean, spread_by string")


_BLOCKS = ", ".join(f"({s}::bigint, {a}::bigint, {b}::bigint, {lo}, {hi}, {p}::bigint[])" for s, a, b, lo, hi, p in RANGES)

#: The same tables for DuckDB. offset is called off.
SQL = f"""
with recursive n as (select count(*) n from events),
rec as (select event_id, user_id, event_type topic, user_id::varchar as key, props as value, (epoch_us(ts) // 1000)::bigint as timestamp,
  (('0x' || substr(md5(user_id::varchar), 1, 8))::ubigint % {KEYSPACE})::bigint pos,
  (case when 2 * event_id < n then 0 when 4 * event_id < 3 * n then 1 when 10 * event_id < 9 * n then 2 else 3 end)::bigint epoch,
  event_id // 50 batch, (39 + octet_length(encode(user_id::varchar)) + octet_length(encode(props)))::bigint frame_bytes from events, n),
topics as (select distinct event_type as name, case event_type when 'click' then 'short' when 'error' then 'no_limit' end as policy from events),
blocks(seq, key_start, key_end, e_from, e_to, parents) as (values {_BLOCKS}),
ranges as (select name topic, seq, key_start, key_end, case when e_to = 4 then 'active' else 'sealed' end state, parents from topics, blocks),
routed as (select rec.*, b.seq range_seq from rec join blocks b on rec.epoch >= b.e_from and rec.epoch < b.e_to and rec.pos >= b.key_start and rec.pos < b.key_end),
log as (select *, row_number() over (partition by topic, range_seq order by event_id) - 1 as off from routed),
seg0 as (select topic, range_seq, event_id // 500 chunk, min(off) start_offset, count(*) length, sum(frame_bytes)::bigint byte_size, max(timestamp) sealed_at from log group by 1, 2, 3),
seg1 as (select *, row_number() over (partition by topic, range_seq order by chunk) - 1 seg_seq from seg0),
seg2 as (select *, range_seq in (2, 5) and seg_seq = max(seg_seq) over (partition by topic, range_seq) is_open from seg1),
segments as (select topic, range_seq, seg_seq, topic || '/' || range_seq || '/' || seg_seq segment, case when is_open then 'active' else 'sealed' end state, start_offset,
  case when not is_open then length end length, case when not is_open then byte_size end byte_size, case when not is_open then sealed_at end sealed_at from seg2),
brokers as (select 'b' || s_suppkey broker, case when s_suppkey <> 9 then 'r' || (s_nationkey % 4) end rack from supplier where s_suppkey < 10),
live as (select broker from brokers where broker not in {DEAD}),
scored as (select segment, broker, rack, row_number() over (partition by segment order by md5(segment || '|' || broker) desc, broker desc) rnk from segments, brokers),
placed as (select s.*, r.replica_set from segments s join (select segment, list(broker order by rnk) replica_set from scored where rnk <= 3 group by 1) r using (segment)),
commits as (select 'g' || (user_id % 3) as grp, topic, range_seq, len(b.parents)::bigint source_index, off + 1 source_offset, event_id commit_seq from log join blocks b on b.seq = range_seq where off % 10 = 9),
ring as (select 'v' || i vnode, (i * 4294967296::bigint) // 8 token from range(8) t(i)),
lin0 as (select topic, seq, key_start, key_end, list_append(parents, seq) srcs from ranges where state = 'active'),
lin as (select topic, seq, key_start, key_end, unnest(srcs) source, generate_subscripts(srcs, 1) - 1 source_index from lin0),
hist as (select l.*, lin.seq reader, lin.source_index from log l join lin on l.topic = lin.topic and l.range_seq = lin.source
  where lin.source = lin.seq or (l.pos >= lin.key_start and l.pos < lin.key_end)),
committed as (select grp, topic, range_seq, max_by(source_index, commit_seq) source_index, max_by(source_offset, commit_seq) source_offset from commits where range_seq in (2, 5) group by 1, 2, 3),
heartbeats as (select 'g' || (user_id % 3) grp, topic, 'm' || (user_id % 4) member, timestamp hb_ms from rec),
members as (select distinct member from heartbeats),
tmax as (select max(timestamp) t from rec),
audit as (select event_id, timestamp, topic event_type, 'u' || user_id username, '10.0.0.' || (user_id % 7) ip from rec),
attempts as (select username, ip, timestamp ts, event_id seq, event_type = 'purchase' ok from audit where event_type in ('error', 'purchase')),
runs as (select *, sum(ok::int) over (partition by username, ip order by seq) g from attempts),
fails as (select *, sum((not ok)::int) over (partition by username, ip, g order by seq)::bigint fails from runs)
"""
