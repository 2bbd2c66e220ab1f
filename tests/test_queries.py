import datetime
import decimal
import glob
import os

import duckdb
import pytest

from framewright.plans import queries as q

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name in q.ORACLES:
        r = duck.sql(q.ORACLES[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        want = sorted(str([plain(x[i]) for i in at]) for x in r.fetchall())
        assert sorted(str([plain(x[c]) for c in cols]) for x in rows) == want
    else:
        assert rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_structure_only_null_of_every_label(spark):
    labels = {f"label{r.label}" for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().collect()}
    null = [(r.structure, r["at"]) for r in q.QUERIES["anm_null"](spark, SF).collect()]
    assert len(labels) == 10 and sorted(null) == sorted((k, i) for k in labels for i in range(27))
    tested = [(r.structure, r.traj_id) for r in q.QUERIES["beyond_structure_test"](spark, SF).collect()]
    assert sorted(tested) == sorted((a, b) for a in labels for b in labels if a != b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_negative_controls_judge_six_baselines_of_every_label_by_its_clock(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(1200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(70_050).select(F.col("id").alias("event_id"), F.randn(5).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = q.QUERIES["negative_controls"](spark, str(tmp_path)).collect()
    assert [(r.structure, r.baseline) for r in got] == [(k, n) for k in ("label0", "label1") for n, _ in q.controls.BASELINES]
    clock = {(r.structure, r.baseline): r.clock_ok for r in got}
    assert {k for k, ok in clock.items() if ok} == {("label0", "real_full_run"), ("label1", "real_full_run")}  # 600 of 1,000 ps
    assert len(q.QUERIES["negative_controls"](spark, SF).collect()) == 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_unrelated_test_takes_the_default_number_of_draws(spark):
    p = q.QUERIES["unrelated_test"](spark, SF).first().p_value_upper_bound * (q.nulls.DRAWS + 1)
    assert abs(p - round(p)) < 1e-6
