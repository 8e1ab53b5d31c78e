"""Shared pieces of the operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, join_groups, pieces, words


@pytest.mark.parametrize("most", [50_000, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_groups_join_the_same_salted_or_broadcast(spark, most, how):
    rows = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k, "x") for k in range(300)], "key string, n long, jg_salt string")
    groups = spark.createDataFrame([("hot", 1.5), ("k0", 2.5), ("other", 3.5)], "key string, g double")
    got = join_groups(rows, groups, "key", how, most)
    assert set(got.columns) == {"key", "n", "jg_salt", "g"}
    want = {(k, 1.5 if k % 3 else 2.5 if k == 0 else None) for k in range(300) if how == "left" or k % 3 or k == 0}
    assert sorted(map(str, ((r.n, r.g) for r in got.collect()))) == sorted(map(str, want))


def test_pieces_cover_a_batch_once():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 500, None, "", "b" * 5000, "c"])], names=["t"])
    for most in (1, 600, 10**9):
        parts = list(pieces(b, 0, most))
        assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist() and all(p.num_rows for p in parts)
    assert list(pieces(b.slice(0, 0), 0)) == []


def test_words_and_names(spark):
    df = spark.createDataFrame([("\x0ba  b\tc\x85d\n",), (None,), (" ",)], "Text string")
    assert [r.w for r in df.select(words(F.col("text")).alias("w")).collect()] == [["a", "b", "c\x85d"], [], []]
    assert fresh(df, "TEXT", "x", "x") == ["_TEXT", "x", "_x"]
