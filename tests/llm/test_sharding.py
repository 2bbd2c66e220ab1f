import zlib
from collections import Counter

import duckdb
import pytest

from framewright.llm import sharding as op


def table_of(spark, n=4000):
    rows = [(i, f"text é {i % 90}") for i in range(n)] + [(None, None), (None, ""), (7, "text é 7"), (7, "text é 7"), (-1, "x" * 300_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS size", "3 AS row", "4 AS slot", "5 AS _range").repartition(7)


def test_rows_equal_sql_and_their_contract(spark, tmp_path):
    df = table_of(spark)
    a, b = op.topology(24), op.topology(25)
    got = op.placed(df, a, b)
    rows = got.collect()
    df.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    r = con.sql(op.oracle(a, b))
    at = [r.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(x) for x in rows))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
    slots = {}
    for x in rows:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(map(len, slots.values())) < 1.5 * len(rows) / 24
    moved = [x for x in rows if x.grown_shard != x.shard]
    assert {x.grown_shard for x in moved} == {24} and 0.5 / 25 < len(moved) / len(rows) < 2 / 25
    one = next(x for x in rows if x.doc_id == -1)
    assert (one.size, one.text_crc32, one.law) == (300_008, zlib.crc32(b"x" * 300_000), "key")
    assert sorted((x.size, x.text_crc32) for x in rows if x.doc_id is None) == [(8, 0), (8, 0)]


@pytest.mark.parametrize("n", [24, 25, 30, 47])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    ids = spark.range(3000)
    got = ids.select(op.shard_of(ids.id, op.topology(n)).alias("a"), op.shard_of(ids.id, op.topology(n + 1)).alias("b")).collect()
    assert {x.b for x in got if x.a != x.b} == {n}


def test_weights_hold_at_every_level_and_movement_stays_in_their_subtrees(spark):
    leaves = [("east", "a", 0, 1.0), ("east", "a", 1, 3.0), ("east", "b", 2, 2.0), ("west", "a", 3, 6.0), ("west", "b", 4, 0.0), ("west", "b", 5, 4.0)]
    heavier = [(*x[:3], 9.0) if x[2] == 2 else x for x in leaves]
    ids = spark.range(16_000)
    got = ids.select(op.shard_of(ids.id, leaves).alias("a"), op.shard_of(ids.id, heavier).alias("b")).collect()
    count = Counter(x.a for x in got)
    assert 4 not in count and all(abs(count[s] / len(got) - w / 16) < 0.02 for _, _, s, w in leaves if w)
    moved = {(x.a, x.b) for x in got if x.a != x.b}
    assert moved and all(b in (0, 1, 2) for _, b in moved)  # the region east grows: rows only come into it
    assert not any(a in (0, 1, 2) and b in (0, 1) for a, b in moved)  # and within it only into the rack that grows
    for bad in ([], [("r", "k", 0, 0.0)], [("r", "k", 0, -1.0)]):
        with pytest.raises(ValueError):
            op.tree(bad)
    with pytest.raises(ValueError):
        op.topology(23)


def test_empty_table_and_written_shards(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.placed(empty, op.topology(24), op.topology(25)).collect() == []
    df = table_of(spark, 300)
    op.write_shards(df, f"{tmp_path}/out", op.topology(24))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == df.count() and set(df.columns) <= set(back.columns)


def test_equal_rows_and_hot_keys_spread_over_ranges(spark, monkeypatch):
    from framewright.llm import common

    monkeypatch.setattr(common, "RANGE_ROWS", 50)
    df = spark.createDataFrame([(1, "same")] * 3000 + [(2, "b")] * 5, "doc_id long, text string").repartition(4)
    rows = op.placed(df, op.topology(24), op.topology(25)).collect()
    for shard in {x.shard for x in rows}:
        assert sorted(x.slot for x in rows if x.shard == shard) == list(range(sum(x.shard == shard for x in rows)))


def test_main_path_runs_no_python(spark):
    plan = op.placed(table_of(spark, 50).where("doc_id > 3"), op.topology(24), op.topology(25))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
