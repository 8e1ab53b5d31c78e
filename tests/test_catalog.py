"""Every registered query with SQL, against DuckDB: the same rows, names and kinds of columns."""

import datetime

import duckdb
import pytest

from tidelog.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    cur = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    kinds = {"long": "BIGINT", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = dict(zip(cols, [str(d[1]).upper() for d in cur.description]))
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    for c, t in df.dtypes:
        assert kinds[t] in types[c] or types[c] in ("NUMBER", "STRING", "BOOL"), (c, t, types[c])
    order = sorted(cols)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key([r[c] for c in order] for r in got) == key([dict(zip(cols, r))[c] for c in order] for r in want)
    assert got or name in ("unroutable", "failover_plan", "locked_accounts", "buddy_pairs", "live_leader")
    assert not any(isinstance(v, (datetime.datetime, float)) for r in got for v in r)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["locate_every", "sparse_seek_every"])
def test_lookups_cover_the_whole_log(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() == catalog.QUERIES["produce_log"](spark, sf).count()


def test_frames_of_the_whole_log_equal_pythons(spark, sf):
    """frame_encode over every log row, against the frames that plain Python packs."""
    import hashlib

    from tidelog.functions import frames
    from tidelog.plans.fixtures import Fixture

    log = Fixture(spark, sf).log.collect()
    want = {(r.topic, r.range_seq, r.offset): frames.pack(frames.Record(r.offset, r.timestamp, r.key.encode(), r.value.encode())) for r in log}
    got = catalog.QUERIES["frame_encode"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        data = want[r.topic, r.range_seq, r.off]
        assert (r.frame_sha256, r.frame_bytes) == (hashlib.sha256(data).hexdigest(), len(data))


def test_balanced_placement_over_all_vnodes(spark, sf):
    """Three different brokers each, loads one apart at most, and the best brokers wherever there is room."""
    import collections

    got = catalog.QUERIES["placement_balanced"](spark, sf).collect()
    load = collections.Counter(b for r in got for b in r.replicas.split(","))
    assert len(got) == 64 and all(len(set(r.replicas.split(","))) == 3 for r in got)
    assert max(load.values()) - min(load.values()) <= 1 or max(load.values()) <= -(-64 * 3 // len(load))
